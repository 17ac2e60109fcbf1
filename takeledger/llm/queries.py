"""The registered queries opN_<name> of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeledger.llm.common import remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from takeledger.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(docs.filter("not held_out").join(labels, "doc_id"))
    return toxicity.score_documents(docs, model, ["doc_id", "held_out"])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from takeledger.llm.suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from takeledger.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = langid.fit(docs.filter("not held_out"))
    return langid.identify(docs, model, ["doc_id", "held_out"])


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from takeledger.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from takeledger.llm import ngram_lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    return ngram_lm.score_documents(docs, ngram_lm.fit(docs.filter("not held_out")), ["doc_id", "held_out"])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from takeledger.llm import pii

    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from takeledger.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from takeledger.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from takeledger.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from takeledger.llm.decontam import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from takeledger.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from takeledger.llm.centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from takeledger.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_toxicity, op2_suffix_dedup, op3_language_id, op4_token_counts, op5_language_model, op6_personal_data, op7_bpe_round_trip,
        op8_nearest_vectors, op9_jaccard_join, op10_decontamination, op11_whitening, op12_centroid_clusters, op13_simhash,
    )
    return {f.__name__: f for f in each}


#: Bytes as hex, two digits each; a byte goes if one of the 50 strings around it came earlier.
_OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, q, substr(h, 2 * q + 1, 1098) AS t FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 500)) AS q FROM d)),
b AS (SELECT doc_id, q + unnest(range(0, least(500, len(t) // 2))) AS p, unnest(list_transform(range(0, least(500, len(t) // 2)), lambda i: substr(t, 2 * i + 1, 2))) AS x FROM q),
w AS (SELECT doc_id, q + unnest(range(0, least(500, len(t) // 2 - 49))) AS p, unnest(list_transform(range(0, least(500, len(t) // 2 - 49)), lambda i: substr(t, 2 * i + 1, 100))) AS s FROM q WHERE len(t) >= 100),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE m < doc_id),
c AS (SELECT b.doc_id, b.p, x, coalesce(max(hit.p) OVER (PARTITION BY b.doc_id ORDER BY b.p) >= b.p - 49, false) AS gone FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.p = b.p),
g AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS opens FROM c),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(CASE WHEN gone THEN '' ELSE x END, '' ORDER BY p) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

#: All pairs that share a shingle, and components by walking the links.
_OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F])+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS g FROM i),
z AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS whole FROM s GROUP BY doc_id),
copies AS (SELECT doc_id, count(*) OVER (PARTITION BY whole) AS n_copies FROM z),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (g) JOIN z zx ON zx.doc_id = x.doc_id JOIN z zy ON zy.doc_id = y.doc_id WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, zx.n, zy.n HAVING count(*) >= 0.8 * (zx.n + zy.n - count(*))),
c AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.node WHERE c.root < p.b),
r AS (SELECT node, min(root) AS class_id FROM c GROUP BY node),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT documents.doc_id, class_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links FROM documents JOIN r ON r.node = documents.doc_id LEFT JOIN copies ON copies.doc_id = documents.doc_id LEFT JOIN l ON l.a = documents.doc_id
"""


#: Every window with at most two substitutions in twelve words holds four in a row as they are
#: (two in shorter items): diagonals that share such a run are held against each other word by word.
_OP10 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS dw FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, iw, least(len(iw), 12) AS size, CASE WHEN len(iw) < 12 THEN 2 ELSE 4 END AS run FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS iw FROM benchmark WHERE item_id IS NOT NULL) WHERE len(iw) >= 5),
q AS (SELECT item_id, run, k, array_to_string(iw[k : k + run - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(iw) - run + 2)) AS k FROM i)),
runs AS (SELECT DISTINCT run FROM i),
p AS (SELECT doc_id, run, k, array_to_string(dw[k : k + run - 1], ' ') AS g FROM (SELECT doc_id, dw, run, unnest(range(1, len(dw) - run + 2)) AS k FROM d, runs)),
diagonal AS (SELECT DISTINCT doc_id, item_id, p.k - q.k AS shift FROM p JOIN q USING (run, g)),
w AS (SELECT doc_id, item_id, size, len(iw) AS n_item, shift + s AS place, len(list_filter(range(1, size + 1), lambda t: dw[shift + s + t] = iw[s + t])) AS n
  FROM (SELECT doc_id, item_id, shift, dw, iw, size, unnest(range(0, len(iw) - size + 1)) AS s FROM diagonal JOIN d USING (doc_id) JOIN i USING (item_id)) WHERE shift + s >= 0 AND shift + s + size <= len(dw)),
best AS (SELECT *, max(n) OVER (PARTITION BY doc_id, item_id) AS most FROM w)
SELECT doc_id, item_id, CAST(most AS BIGINT) AS n_matched, CAST(max(size) AS BIGINT) AS n_window, CAST(max(n_item) AS BIGINT) AS n_item, CAST(min(place) AS BIGINT) AS first_token
FROM best WHERE n = most AND most >= 0.8 * size GROUP BY doc_id, item_id, most
"""

#: One step of a round: the nearest centroid of every vector, by distance, then by number.
_NEAR = """a{i} AS (SELECT nth, vec_id, x, min(struct_pack(d := d, k := k)) AS m FROM (
  SELECT nth, vec_id, v.x, k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} c) GROUP BY nth, vec_id, x)"""
#: The other: floors of the means, entry by entry; centroids without vectors stay.
_MOVE = """s{i} AS (SELECT k, list(CAST(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS BIGINT) ORDER BY d) AS y
  FROM (SELECT m.k AS k, d, sum(x[d]) AS s, count(*) AS n FROM a{i}, range(1, 65) r(d) GROUP BY m.k, d) GROUP BY k),
c{j} AS (SELECT k, coalesce(y, x) AS x FROM c{i} LEFT JOIN s{i} USING (k))"""
_OP12 = (
    """
WITH v AS (SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, x FROM v QUALIFY k < 40),
"""
    + ",\n".join(f"{_NEAR.format(i=i)},\n{_MOVE.format(i=i, j=i + 1)}" for i in range(5))
    + f""",
{_NEAR.format(i=5)}
SELECT vec_id, CAST(m.k AS INT) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256 FROM a5 JOIN c5 ON c5.k = m.k
"""
)


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the other queries are held against brute force in tests."""
    return {"op2_suffix_dedup": _OP2, "op9_jaccard_join": _OP9, "op10_decontamination": _OP10, "op12_centroid_clusters": _OP12}
