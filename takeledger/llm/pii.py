"""Personal data: base patterns, and terms that disclose them by corpus co-occurrence.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeledger.llm.common import settled

#: The base patterns in their order. Possessive repeats and the look-behind make matching linear;
#: they find what `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+` and the like find.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched for the kind at all.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
#: Characters before and after a base span that are its context.
CONTEXT = 80
#: Different contexts in which a term and an entity must meet, and the disclosed share of the
#: entity's information from which a term is generalised, and from which it is removed.
SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
#: Terms that are broadcast at most, to count them where texts are read; more are joined later.
BROADCAST_TERMS = 500_000
#: Terms of fewer letters disclose nothing.
SHORTEST = 3
#: Elements between the marks of running sums, and characters of a piece of text: positions are
#: found by mark and piece, so that a text's work grows with its length and spans, not their product.
BLOCK, PIECE = 64, 256

#: In the order that spans are sorted by.
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
_WORD = r"[\p{L}\p{N}]+"


def _let(value: Column, body) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, fold) -> Column:
    """For each element of an array of integers the fold, from 0, of all elements before it."""

    def marked(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int"))
        marks = F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.aggregate(F.slice(v, b * BLOCK + 1, BLOCK), F.element_at(a, -1), fold))))
        return _let(marks, lambda m: F.transform(v, lambda x, i: F.aggregate(F.slice(v, i - i % BLOCK + 1, i % BLOCK), F.get(m, F.floor(i / BLOCK).cast("int")), fold)))

    return _let(values, marked)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, low: Column, high: Column) -> Column:
    """Characters low to high, exclusive, of the text of these pieces."""
    first, last = (F.floor(c / PIECE).cast("int") for c in (low, high - 1))

    def part(k: Column) -> Column:
        skip = F.greatest(low - k * PIECE, F.lit(0))
        return F.substr(F.get(pieces, k), skip + 1, F.least(high - k * PIECE, F.lit(PIECE)) - skip)

    return F.when(high > low, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            (F.substr(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substr(digits, i, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(digits.between(14, 19), _luhn(F.regexp_replace(value, "[^0-9]", ""))).otherwise(False)
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, kind: str, rank: int, valid) -> Column:
    """Spans of all valid matches of the pattern, from the lengths of what lies before and between."""

    def spans(m: Column) -> Column:
        skips = F.transform(F.slice(m["gaps"], 1, F.size(m["found"])), F.length)
        steps = F.zip_with(skips, m["found"], lambda n, v: n + F.length(v))
        places = F.struct(skips.alias("skip"), _before(steps, lambda a, x: a + x).alias("at"))

        def each(p: Column) -> Column:
            def span(v: Column, i: Column) -> Column:
                start = F.get(p["at"], i) + F.get(p["skip"], i)
                made = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(v)).alias("end"), F.lit(kind).alias("kind"), v.alias("value"))
                return F.when(valid(v), made)

            return F.filter(F.transform(m["found"], span), lambda x: x.isNotNull())

        return _let(places, each)

    return _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), spans)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind as listed; code points, end exclusive."""
    none = F.array().cast(f"array<{_SPAN}>")
    each = [F.when(HINTS[k](text), _located(text, p, k, i, lambda v, k=k: _valid(k, v))).otherwise(none) for i, (k, p) in enumerate(KINDS.items())]
    return F.array_sort(F.concat(*each))


def _clear(added: Column, base: Column) -> Column:
    """The added spans that overlap no base span, by end.

    Sorted together, base spans by start and added ones by end, an added span is clear if no base
    span before it ends behind its start.
    """
    events = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("which"), s["end"].alias("top"), s.alias("span"))),
        F.transform(added, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("which"), F.lit(0).alias("top"), s.alias("span"))),
    ))

    def picked(e: Column) -> Column:
        most = _before(F.transform(e, lambda x: x["top"]), lambda a, x: F.greatest(a, x))
        return _let(most, lambda m: F.filter(F.transform(e, lambda x, i: F.when((x["which"] == 0) & (F.get(m, i) <= x["span"]["start"]), x["span"])), lambda s: s.isNotNull()))

    return _let(events, picked)


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _words(text: Column) -> Column:
    """The different words of a text, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))


def _filled(text: Column, spans: Column, fill) -> Column:
    """The text with fill(span, end of the spans before) for every span; spans are sorted."""
    ends = F.transform(spans, lambda s: s["end"])
    parts = F.struct(_pieces(text).alias("p"), F.length(text).alias("n"), _before(ends, lambda a, x: F.greatest(a, x)).alias("at"))

    def whole(m: Column) -> Column:
        cut = lambda s, i: F.concat(_cut(m["p"], F.get(m["at"], i), F.greatest(F.get(m["at"], i), s["start"])), fill(s, F.get(m["at"], i)))
        return F.concat(F.array_join(F.transform(spans, cut), ""), _cut(m["p"], F.coalesce(F.array_max(ends), F.lit(0)), m["n"]))

    return _let(parts, whole)


def _spots(text: Column, spans: Column) -> Column:
    """(entity, window, whole left, whole right) of every base span of a text.

    The window is the span's context with every base span blanked, so that words of base spans
    are no terms; of a word that a base span cuts, the rest counts as a word.
    """
    blank = _filled(text, spans, lambda s, at: F.repeat(F.lit("\n"), s["end"] - F.greatest(at, s["start"])))

    def each(m: Column) -> Column:
        def spot(s: Column) -> Column:
            low, high = F.greatest(F.lit(0), s["start"] - CONTEXT), F.least(m["n"], s["end"] + CONTEXT)
            return F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), _cut(m["p"], low, high).alias("window"), (low == 0).alias("left"), (high == m["n"]).alias("right"))

        return F.transform(spans, spot)

    return _let(F.struct(_pieces(blank).alias("p"), F.length(text).alias("n")), each)


def context_terms(near: DataFrame) -> DataFrame:
    """(entity, term, context) of the words in windows as _spots gives them; cut ones are left out."""
    words = _located(F.col("window"), _WORD, "term", len(KINDS), lambda v: F.length(v) >= SHORTEST)
    terms = near.select("entity", "left", "right", F.length("window").alias("n"), F.xxhash64("window").alias("context"), F.explode(words).alias("w"))
    whole = (F.col("left") | (F.col("w.start") > 0)) & (F.col("right") | (F.col("w.end") < F.col("n")))
    return terms.filter(whole).select("entity", F.lower("w.value").alias("term"), "context")


#: Terms of an entity up to which its texts are asked for each of them.
WIDE = 64


def _few(df: DataFrame) -> DataFrame:
    """df, broadcast if it has at most BROADCAST_TERMS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def disclosing_terms(spanned: DataFrame) -> DataFrame:
    """(term, disclosure): the largest share of any entity's information that a term gives away.

    With N texts, df the number of texts that hold a term or an entity, and both the number of
    texts that hold the two anywhere, disclosure = log(N both / df(e) df(t)) / log(N / df(e)),
    their pointwise mutual information against the entity's information content. A pair counts
    if it meets in SUPPORT different contexts, so that copies of one context are no evidence.
    spanned has text and spans; each of its rows is a text.
    """
    text = F.col("text")
    marked = spanned.filter(F.size("spans") > 0).select(F.monotonically_increasing_id().alias("row"), _spots(text, F.col("spans")).alias("spots"), _words(text).alias("words"))
    holding = settled(marked, "holding")
    near = holding.select("row", F.inline("spots"))
    met = context_terms(near).distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= SUPPORT)
    met = settled(met.select("entity", "term"), "met")
    wanted = _few(met.select("term").distinct())
    n = spanned.count()
    df_t = spanned.select(F.explode(_words(text)).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df_t"))
    entities = near.select("row", "entity").join(_few(met.select("entity").distinct()), "entity", "left_semi").distinct()
    df_e = entities.groupBy("entity").agg(F.count("*").alias("df_e"))
    held = holding.select("row", F.explode("words").alias("term")).join(wanted, "term", "left_semi")
    # an entity with few terms asks each of its texts for these; one with many, which may be in a
    # third of all texts, is met with the terms that each text has, and pairs are counted first
    wide = settled(met.groupBy("entity").agg(F.count("*").alias("terms")).filter(F.col("terms") > WIDE).select("entity"), "wide")
    few_wide = _few(wide)
    narrow = entities.join(_few(met.join(few_wide, "entity", "left_anti")), "entity").join(held, ["row", "term"]).groupBy("entity", "term").agg(F.count("*").alias("both"))
    broad = entities.join(few_wide, "entity", "left_semi").join(held, "row").groupBy("entity", "term").agg(F.count("*").alias("both"))
    both = narrow.unionByName(broad.join(met.join(few_wide, "entity", "left_semi"), ["entity", "term"], "left_semi"))
    scored = both.join(df_t, "term").join(df_e, "entity")
    information = F.log(F.lit(float(max(n, 2))) / F.col("df_e"))
    mutual = F.log(F.lit(float(max(n, 2))) * F.col("both") / (F.col("df_e") * F.col("df_t")))
    disclosure = F.when(information > 0, F.least(F.lit(1.0), mutual / information)).otherwise(0.0)
    return scored.groupBy("term").agg(F.max(disclosure).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)


def term_spans(rows: DataFrame, secret: DataFrame) -> DataFrame:
    """(id, h, s, disclosure): a span of every place of a secret term in rows of id, h, text.

    Texts are dealt out in pieces that end where a word does, so that a word carries its piece
    only; the place in its piece is reckoned for hits.
    """
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}+{_WORD[:-1]}*+"), F.lit(0))
    skips = lambda p: _before(F.transform(p, F.length), lambda a, x: a + x)
    placed = rows.select("id", "h", F.inline(_let(pieces, lambda p: F.zip_with(p, skips(p), lambda x, n: F.struct(x.alias("piece"), n.alias("skip"))))))
    words = F.regexp_extract_all("piece", F.lit(_WORD), F.lit(0))
    placed = placed.select("id", "h", "piece", "skip", F.posexplode(words).alias("k", "word")).withColumn("term", F.lower("word"))
    long = lambda c, n: F.length(F.array_join(F.slice(c, 1, n), ""))
    start = (F.col("skip") + long(F.split("piece", _WORD, -1), F.col("k") + 1) + long(words, F.col("k"))).alias("start")
    if secret.count() <= BROADCAST_TERMS:
        hits = placed.join(F.broadcast(secret), "term").select("id", "h", start, "word", "disclosure")
    else:  # of each word only its place is shuffled
        hits = placed.select("id", "h", "term", "word", start).join(secret, "term")
    kind = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    end = F.col("start") + F.length("word")
    return hits.select("id", "h", F.struct(F.col("start"), F.lit(len(KINDS)).alias("rank"), end.alias("end"), kind.alias("kind"), F.col("word").alias("value")).alias("s"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, base, spans) of every row of docs: the base spans, and those of the method added.

    Added spans have kind `generalise` or `remove`: all words, in any text and outside base
    spans, which over the whole corpus disclose the value of some base span by at least
    GENERALISE or REMOVE. Null and empty texts have no spans; repeated rows are counted and
    reported each; added spans of rows that repeat an id and text are the same. Extra columns are
    ignored; an empty table gives no rows. h is a hash of the text. Texts are not shuffled (only
    spans and words are) unless entities that are repeated exceed BROADCAST_TERMS.
    """
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).select("id", F.xxhash64(text).alias("h"), text.alias("text"))
    spanned = rows.withColumn("spans", base_spans(F.col("text")))
    secret = settled(disclosing_terms(spanned), "secret")
    added = term_spans(rows, secret).groupBy("id", "h").agg(F.collect_set("s").alias("added"))
    base = spanned.select("id", "h", F.col("spans").alias("base"))
    joined = base.join(added.withColumnsRenamed({"id": "id2", "h": "h2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    all_spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", _clear(F.col("added"), F.col("base")))))
    return joined.select(F.col("id").alias(id_col), "h", "base", all_spans.alias("spans"))


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, the hash of their spelling, and the spelling of all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(id_col, *map(count, KINDS), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


#: What stands in a text for a span of each base kind. A removed term leaves nothing; one that is
#: generalised leaves what kind of word it is.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": ""}


def generalised(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{N}+$"), "[NUMBER]").when(word.rlike(r"\p{N}"), "[CODE]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced; of overlapping spans the later is cut to its rest."""
    mask = F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv])
    return _filled(text, spans, lambda s, at: F.when(s["start"] < at, "").when(s["kind"] == "generalise", generalised(s["value"])).otherwise(F.element_at(mask, s["kind"])))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns and rows, with personal data and disclosing terms masked in the text."""
    spans = find_spans(docs, id_col, text_col).filter(F.size("spans") > 0).select(F.col(id_col).alias("__id"), F.col("h").alias("__h"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__h"])
    text = docs[text_col]
    joined = docs.join(spans, docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__h")), "left")
    done = F.when(F.col("__spans").isNull(), text).otherwise(masked(text, F.col("__spans")))
    return joined.select(*[done.alias(c) if c == text_col else docs[c] for c in docs.columns])
