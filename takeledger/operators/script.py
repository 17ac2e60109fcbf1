"""Screenplays: who speaks where, next to whom, and where a passage is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from takeledger.functions import normalize as n
from takeledger.sources import versions

#: Shared turns from which a tie is strong, and lines of a principal part.
STRONG_TURNS, PRINCIPAL_LINES = 6, 3


#: Fixed value: a run of words in capitals, which names whoever is called so.
CAPITALS = r"\b[A-Z]{2,}(?:\s+[A-Z]{2,})*\b"


def character_stats(lines: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Lines and scenes of each speaker of a script, and the role that their rank gives.

    Cues and words that are no characters are left out. A scene is also one's own where an action
    line names it in capitals. actions: script_id, scene, action.
    """
    someone = lambda c: ~n.is_no_character(c) & ~n.is_transition(c)
    spoken = lines.withColumn("speaker", n.character_name(F.col("speaker"))).filter("length(speaker) >= 2").filter(someone(F.col("speaker")))
    each = spoken.groupBy("script_id", "speaker", "scene").agg(F.count("*").alias("lines"))
    if actions is not None:
        named = actions.select("script_id", "scene", F.explode(F.regexp_extract_all("action", F.lit(CAPITALS), F.lit(0))).alias("speaker"))
        named = named.filter(someone(F.col("speaker"))).join(each.select("script_id", "speaker").distinct(), ["script_id", "speaker"], "left_semi")
        each = each.unionByName(named.select("script_id", "speaker", "scene", F.lit(0).cast("long").alias("lines"))).groupBy("script_id", "speaker", "scene").agg(F.sum("lines").alias("lines"))
    each = each.groupBy("script_id", "speaker").agg(F.sum("lines").alias("lines"), F.count("*").alias("scenes"))
    rank = F.row_number().over(Window.partitionBy("script_id").orderBy(F.desc("lines"), "speaker"))
    role = F.when((F.col("rank") == 1) & (F.col("lines") > 0), "Lead").when(F.col("lines") >= PRINCIPAL_LINES, "Principal Cast").when(F.col("lines") > 0, "Supporting Character").otherwise("Background / Non-Speaking")
    return each.withColumn("rank", rank).withColumn("role", role)


def turn_adjacency(lines: DataFrame) -> DataFrame:
    """Each line with the speaker before it in the scene."""
    return lines.withColumn("previous", F.lag("speaker").over(Window.partitionBy("script_id", "scene").orderBy("place")))


def relationships(lines: DataFrame) -> DataFrame:
    """Pairs of speakers: shared scenes and adjoining turns, from each scene's cast."""
    cast = lines.select("script_id", "scene", "speaker").distinct()
    pairs = cast.withColumnRenamed("speaker", "a").join(cast.withColumnRenamed("speaker", "b"), ["script_id", "scene"]).filter("a < b").groupBy("script_id", "a", "b").agg(F.count("*").alias("shared_scenes"))
    turns = turn_adjacency(lines).filter("previous is not null and previous <> speaker").groupBy("script_id", F.least("speaker", "previous").alias("a"), F.greatest("speaker", "previous").alias("b")).agg(F.count("*").alias("turns"))
    strength = F.when(F.col("turns") >= STRONG_TURNS, "Principal Dialogue Counterpart").when(F.col("turns") > 0, "Key Dialogue Counterpart").otherwise("Shared Scene Presence")
    return pairs.join(turns, ["script_id", "a", "b"], "left").withColumn("turns", F.coalesce("turns", F.lit(0))).withColumn("strength", strength)


#: Fixed value: what a passage has to weigh. Weights are compared to six places.
LEAST_WEIGHT, PLACES = 1.0, 6
#: Words of scenes, and terms of queries, that a task holds at a time.
BLOCK_WORDS, BLOCK_TERMS = 1 << 20, 1 << 19
#: Blocks of queries that a script has if they hold LEAST_TERMS, so that small scripts spread too.
LEAST_BLOCKS, LEAST_TERMS = 8, 1 << 14
#: Scenes of a query that are read first, by what they can weigh at most.
READ_FIRST = 8


class _Scenes:
    """The words of whole scenes by term, and the windows of one to three lines of each scene.

    words: scene, place, terms (a line's). codes: a number for each of the terms, in order.
    """

    def __init__(self, words: pa.Table, codes: np.ndarray, terms: int):
        scene = words["scene"].combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(scene.dictionary).to_numpy()
        self.names = scene.dictionary.take(pa.array(order))
        of_line, place = np.argsort(order)[scene.indices.to_numpy()], words["place"].to_numpy().astype(np.int64)
        # windows begin up to two lines above a line; by scene and start they have a number
        s, p = np.tile(of_line, 3), np.concatenate([place - back for back in range(3)])
        by = np.lexsort((p, s))
        new = np.append(True, (np.diff(s[by]) != 0) | (np.diff(p[by]) != 0))
        windows = np.empty(len(s), np.int64)
        windows[by] = np.cumsum(new) - 1
        self.starts, of_start = p[by][new], s[by][new]
        self.bounds = np.searchsorted(of_start, np.arange(len(order) + 1))
        # a term at a place counts once, whoever said it
        line = np.repeat(np.arange(len(place)), pc.list_value_length(words["terms"]).to_numpy())
        s, p = of_line[line], place[line]
        by = np.lexsort((p, s, codes))
        t, s, p = codes[by], s[by], p[by]
        changes = np.append(True, (np.diff(t) != 0) | (np.diff(s) != 0))
        once = changes | np.append(True, np.diff(p) != 0)
        t, s, p, changes, line = t[once], s[once], p[once], changes[once], line[by][once]
        lines = np.diff(np.append(np.nonzero(changes)[0], len(t)))
        self.scene, self.weight = s, np.repeat(1.0 / lines, lines)
        self.once = np.where(changes, self.weight, 0.0)
        # how far below the term is said again in the scene: a window counts its last place only
        self.gap = np.append(np.where(changes[1:], 3, np.minimum(np.diff(p), 3)), 3)
        self.windows = windows.reshape(3, -1)[:, line]
        self.spans = np.searchsorted(t, np.arange(terms + 1))

    def _read(self, at: np.ndarray, chosen: np.ndarray) -> tuple[float, int, int] | None:
        """(loss, size, window): the best window of the chosen scenes, shorter and earlier ones first."""
        at, found = at[chosen[self.scene[at]]], None
        scenes = np.nonzero(chosen)[0]
        low, sizes = self.bounds[scenes], np.diff(self.bounds)[scenes]
        shift = np.zeros(len(chosen), np.int64)
        shift[scenes] = low - (np.cumsum(sizes) - sizes)
        windows, weight, gap = self.windows[:, at] - shift[self.scene[at]], self.weight[at], self.gap[at]
        number = np.repeat(shift[scenes], sizes) + np.arange(sizes.sum())
        for size in (1, 2, 3):
            said = sum(np.bincount(windows[back], np.where(gap > size - 1 - back, weight, 0.0), len(number)) for back in range(size))
            said = np.where(self.starts[number] >= 0, np.floor(said * 10**PLACES + 0.5) / 10**PLACES, 0.0)
            best = int(np.argmax(said))
            if said[best] >= LEAST_WEIGHT and (found is None or -said[best] < found[0]):
                found = (-float(said[best]), size, int(number[best]))
        return found

    def best(self, terms: np.ndarray) -> tuple[float, int, int] | None:
        """The best window for the terms: a scene weighs no more than its terms together, so those
        are read that can weigh most, and then all that still reach what these do."""
        low = self.spans[terms]
        lengths = self.spans[terms + 1] - low
        at = np.repeat(low - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        most = np.bincount(self.scene[at], self.once[at], len(self.names))
        # half a unit of the last place for each of the sums that were rounded, and for their order
        slack = 10.0**-PLACES
        first = most >= LEAST_WEIGHT - slack
        if not first.any():
            return None
        if first.sum() > READ_FIRST:
            first &= most >= np.partition(most, -READ_FIRST)[-READ_FIRST]
        found = self._read(at, first)
        reach = LEAST_WEIGHT if found is None else -found[0]
        rest = (most >= reach - slack) & ~first
        if rest.any() and (other := self._read(at, rest)) is not None:
            found = other if found is None else min(found, other)
        return found


def _met(words: pa.Table, asked: pa.Table, schema: pa.Schema) -> pa.Table:
    """Each asked query of a block with its best window among a block's scenes."""
    if not len(words) or not len(asked):
        return schema.empty_table()
    flat = [pc.list_flatten(t["terms"]).combine_chunks() for t in (words, asked)]
    coded = pa.concat_arrays(flat).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    scenes = _Scenes(words, codes[: len(flat[0])], len(coded.dictionary))
    ends = np.cumsum(pc.list_value_length(asked["terms"]).to_numpy())
    wanted = np.split(codes[len(flat[0]) :], ends[:-1])
    found = [(i, b) for i, terms in enumerate(wanted) if (b := scenes.best(terms)) is not None]
    if not found:
        return schema.empty_table()
    rows, (loss, size, window) = [i for i, _ in found], zip(*[b for _, b in found])
    window = np.array(window)
    scene = scenes.names.take(pa.array(np.searchsorted(scenes.bounds, window, "right") - 1))
    kept = asked.select(["query", "script_id"]).take(pa.array(rows))
    return pa.Table.from_arrays([*kept.columns, pa.array(loss), pa.array(size, pa.int32()), scene, pa.array(scenes.starts[window])], names=["query", "script_id", "loss", "size", "scene", "start"]).cast(schema)


def located(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """Best window of one to three lines for each query's terms in a scene.

    A term weighs 1 over the lines of the scene that hold it; a window needs 1.0; shorter and
    earlier windows win ties. terms: query, script_id, term. One row a query and script: of its
    scenes' best windows the one that weighs most.

    Scenes and queries of a script are dealt in blocks, and each block of queries meets each block
    of scenes in a task of its own: there a query's terms are looked up in the scenes' words, and
    of the scenes only those are read whole whose terms together weigh enough.
    """
    said = lines.select("script_id", "scene", "place", F.array_distinct(n.anchor_terms(F.col("line"))).alias("terms"))
    said = versions.stored(said.filter("size(terms) > 0").dropna(subset=["script_id", "scene", "place"]), "said")
    asked = versions.stored(terms.dropna(subset=["query", "script_id", "term"]).groupBy("query", "script_id").agg(F.collect_set("term").alias("terms")), "asked")
    held = F.sum(F.size("terms"))
    words = said.groupBy("script_id").agg(F.ceil(held / BLOCK_WORDS).alias("scene_blocks"))
    wanted = asked.groupBy("script_id").agg(F.greatest(F.ceil(held / BLOCK_TERMS), F.least(F.lit(LEAST_BLOCKS), F.ceil(held / LEAST_TERMS))).alias("query_blocks"))
    # stored, so that its size is known: small counts are broadcast, many are shuffled
    blocks = versions.stored(words.join(wanted, "script_id"), "blocks")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    block = ["script_id", "scene_block", "query_block"]
    scenes = said.join(blocks, "script_id").select("script_id", F.pmod(F.xxhash64("scene"), "scene_blocks").alias("scene_block"), each("query_blocks").alias("query_block"), "scene", "place", "terms")
    queries = asked.join(blocks, "script_id").select("script_id", each("scene_blocks").alias("scene_block"), F.pmod(F.xxhash64("query"), "query_blocks").alias("query_block"), "query", "terms")
    kinds = {"query": asked, "script_id": asked, "scene": said, "start": said}
    kind = lambda c: kinds[c].schema["place" if c == "start" else c].dataType
    schema = StructType([StructField("query", kind("query")), StructField("script_id", kind("script_id")), StructField("loss", DoubleType()), StructField("size", IntegerType()), StructField("scene", kind("scene")), StructField("start", kind("start"))])
    arrow = to_arrow_schema(schema)
    met = scenes.groupBy(*block).cogroup(queries.groupBy(*block)).applyInArrow(lambda w, q: _met(w, q, arrow), schema)
    best = met.groupBy("query", "script_id").agg(F.min(F.struct("loss", "size", "scene", "start")).alias("best"))
    return best.select("query", "script_id", "best.scene", "best.size", "best.start", (-F.col("best.loss")).alias("weight"))


def shot_segments(lines: DataFrame) -> DataFrame:
    """A running segment number that a transition cue advances."""
    w = Window.partitionBy("script_id", "scene").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("segment", F.sum(n.is_transition(F.col("line")).cast("int")).over(w))


#: Words of a description that tell, and what each of them says; the first that holds any wins.
WOMAN = ["woman", "female", "girl", "lady", "she", "her", "actress", "mother", "sister", "daughter"]
MAN = ["man", "male", "guy", "boy", "gentleman", "he", "his", "him", "actor", "father", "brother", "son"]
NEITHER = ["non-binary", "androgynous", "gender-non-conforming"]
#: Traits and the pieces of speech that hint at them.
TRAITS = {
    "Commanding": ["must", "now", "order", "stand", "step", "move", "stop"],
    "Inquisitive": ["who", "what", "why", "where", "how", "?"],
    "Guarded": ["careful", "listen", "wait", "quiet", "don't"],
    "Urgent": ["hurry", "quick", "run", "late", "!"],
}
#: A name in capitals with an appositive, and an age in it.
DESCRIPTOR = r"\b([A-Z][A-Z0-9'\-]*(?:\s+[A-Z][A-Z0-9'\-]*){0,3})\s*,\s*([^.;]{3,120})"
AGE = r"(?i)\b((?:early|mid|late)[\s-]+\d{2}s|\d{2}s|\d{1,2}\s*(?:years old|yo)|aged?\s*\d{1,2})\b"


def _holds_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.lit(words), lambda w: F.contains(text, w))


def pronoun_tally(lines: DataFrame, actions: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """Pronouns in the action lines that name a character, of scenes it speaks in, and the label.

    The label is what the character's description says, if it says anything, and otherwise the
    pronoun that is commonest. actions: script_id, scene, action; described: script_id, speaker,
    description.
    """
    cast = lines.select("script_id", "scene", "speaker").filter("speaker <> ''").distinct()
    kinds = {"she": r"\b(she|her|hers)\b", "he": r"\b(he|him|his)\b", "they": r"\b(they|them|their)\b"}
    said = actions.select("script_id", "scene", F.upper("action").alias("named"), *[F.regexp_count(F.lower("action"), F.lit(p)).alias(k) for k, p in kinds.items()])
    near = cast.join(said, ["script_id", "scene"]).filter(F.contains("named", F.upper("speaker"))).groupBy("script_id", "speaker").agg(*[F.sum(k).alias(k) for k in kinds])
    counts = cast.select("script_id", "speaker").distinct().join(near, ["script_id", "speaker"], "left").fillna(0, [*kinds])
    most = lambda k: F.expr(" and ".join(f"{k} > {o}" for o in kinds if o != k))
    label = F.when(most("she"), "woman").when(most("he"), "man").when(most("they"), "non-binary").otherwise("")
    if described is not None:
        counts = counts.join(described.select("script_id", "speaker", F.lower("description").alias("d")), ["script_id", "speaker"], "left")
        told = F.coalesce("d", F.lit(""))
        label = F.when(_holds_any(told, WOMAN), "woman").when(_holds_any(told, MAN), "man").when(_holds_any(told, NEITHER), "non-binary").otherwise(label)
    return counts.withColumn("label", label).drop("d")


def trait_hints(lines: DataFrame) -> DataFrame:
    """(script_id, speaker, traits): the traits that a character's own lines hint at, in order."""
    own = lines.groupBy("script_id", "speaker").agg(*[F.bool_or(_holds_any(F.lower("line"), words)).alias(t) for t, words in TRAITS.items()])
    traits = F.array_compact(F.array(*[F.when(F.col(t), t) for t in TRAITS]))
    return own.select("script_id", "speaker", F.array_join(traits, ",").alias("traits"))


def descriptors(lines: DataFrame, actions: DataFrame) -> DataFrame:
    """(script_id, speaker, full_name, description, age): how the script introduces each speaker.

    The first action line that has the name in capitals and an appositive; a full name in the
    action belongs to the cue that begins it. actions: script_id, scene, place, action.
    """
    told = actions.select("script_id", "scene", "place", F.posexplode(F.regexp_extract_all("action", F.lit(DESCRIPTOR), F.lit(0))).alias("at", "m"))
    told = told.select("script_id", "scene", "place", "at", F.trim(F.regexp_extract("m", DESCRIPTOR, 1)).alias("full_name"), F.rtrim(F.regexp_replace(F.trim(F.regexp_extract("m", DESCRIPTOR, 2)), ",+$", "")).alias("description"))
    told = told.filter(~n.is_no_character(F.col("full_name")))
    cues = lines.select("script_id", "speaker").distinct().withColumn("first_word", F.substring_index("speaker", " ", 1))
    told = told.withColumn("first_word", F.substring_index("full_name", " ", 1))
    same = (F.col("full_name") == F.col("speaker")) | F.col("full_name").startswith(F.concat("speaker", F.lit(" "))) | F.col("speaker").startswith(F.concat("full_name", F.lit(" ")))
    met = told.join(cues, ["script_id", "first_word"]).filter(same)
    first = met.groupBy("script_id", "speaker").agg(F.min_by(F.struct("full_name", "description"), F.struct("scene", "place", "at")).alias("d"))
    return first.select("script_id", "speaker", "d.full_name", "d.description", F.regexp_extract("d.description", AGE, 1).alias("age"))


def character_evidence(lines: DataFrame, actions: DataFrame, headings: DataFrame, most: int = 5, settings: int = 8) -> DataFrame:
    """(script_id, speaker, said, done, settings, silent): what a script has on each character.

    The first lines it says, the first action lines of any scene that name it, the different
    settings of its scenes in order, and whether it appears in actions but never speaks.
    headings: script_id, scene, setting, speaker (who appears in the scene).
    """
    named = headings.select("script_id", "speaker").filter("speaker <> ''").distinct()
    by = lambda *o: F.row_number().over(Window.partitionBy("script_id", "speaker").orderBy(*o))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c]), "|")
    said = lines.withColumn("k", by("scene", "place")).filter(F.col("k") <= most).groupBy("script_id", "speaker").agg(join("line").alias("said"))
    acts = headings.select("script_id", "scene", "speaker").distinct().join(actions, ["script_id", "scene"]).filter(F.contains(F.upper("action"), F.upper("speaker")))
    done = acts.withColumn("k", by("scene", "place")).filter(F.col("k") <= most).groupBy("script_id", "speaker").agg(join("action").alias("done"))
    where = headings.groupBy("script_id", "speaker", "setting").agg(F.min("scene").alias("scene"))
    where = where.withColumn("k", by("scene", "setting")).filter(F.col("k") <= settings).groupBy("script_id", "speaker").agg(join("setting").alias("settings"))
    out = named.join(said, ["script_id", "speaker"], "left").join(done, ["script_id", "speaker"], "left").join(where, ["script_id", "speaker"], "left")
    return out.fillna("", ["said", "done", "settings"]).withColumn("silent", (F.col("said") == "") & (F.col("done") != ""))
