"""Printed reports as they come out of a text layer: camera, script and offload layouts.

Each layout is read line by line: every line gets a kind by its shape, and what a line inherits
from the lines above it (roll, slate, date) is the last value stated so far, folded where the
document is. No parser shuffles; a document that can't be read is one row with its `error`.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.functions.privacy import is_contact
from takeledger.sources.documents import KEYS, Lines, folded, kept, lines_of, settled
from takeledger.sources.paperwork import parse_thumbnail_report, scene_timing_rows, thumbnail_blocks

#: A slate of a script log (compound scenes, wild tracks), a take label, timecodes.
SLATE = r"(?:\d+[A-Z]{0,2}(?:[+-]\d+[A-Z]{0,2})*/(?:\d+[A-Z]?|WT)|\d+WT)"
TAKE = r"(?:\d+(?:\.\d+)?(?:[A-Z](?![A-Za-z]))?\s*\*?|\d+\*|FALSE)"
TIMECODE = r"\d{2}:\d{2}:\d{2}:\d{2}"
#: A card with its day stamp, a card of three digits, any card.
CARDS = [r"\b([A-Z]0*\d{1,3})\s{0,3}(\d{2}0[1-9]\d{2}|\d{2}1[0-2]\d{2})", r"\b([A-Z]\d{3})\b", r"\b([A-Z]0*\d{1,3})\b"]
#: Page furniture of each layout.
CAMERA_SKIPS = r"Camera Report|Generated using|zoelog\.io|Page |SCENE TAKE CLIP|Continued on next page"
SCRIPT_SKIPS = r"(?i:EDITOR'S LOG)|Date:|Slate Take|Script / Continuity|Page |Day:Day "
CLIP_SKIPS = r"^(?:Clips Report|Pomfort|Offloads|Preview Name)"
UNITS = {"TB": 1 << 40, "GB": 1 << 30, "MB": 1 << 20, "KB": 1 << 10, "BYTES": 1}


def _group(text: Column, pattern: str, i: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, i)), F.lit(""))


def _lines(docs: DataFrame, skips: str, near: int = 0, **of_document: Column) -> DataFrame:
    rows = lines_of(docs, near, **of_document).withColumn("line", F.trim("line"))
    return rows.filter((F.col("line") != "") & ~F.col("line").rlike(skips))


def _bytes(text: Column, pattern: str) -> Column:
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return (F.regexp_extract(text, pattern, 1).try_cast("double") * F.try_element_at(unit, F.upper(F.regexp_extract(text, pattern, 2)))).cast("bigint")


def card(text: Column) -> Column:
    """The camera roll that a script line names, normalised; null where it names none."""
    named = lambda p: n.once(F.regexp_extract(text, p, 1), lambda c: F.when(c != "", c))
    # what CARDS find is a letter and up to three digits behind zeros
    return n.once(F.coalesce(*map(named, CARDS)), lambda c: F.concat(F.substring(c, 1, 1), F.lpad(F.regexp_extract(c, r"^.0*(\d+)$", 1), 3, "0")))


def stamp(text: Column) -> Column:
    """The DDMMYY stamp beside a card as DD/MM/YYYY; null where it is no date."""
    part = lambda raw, i: F.substring(raw, i, 2)
    dated = lambda raw: F.when(part(raw, 1).try_cast("int").between(1, 31) & part(raw, 3).try_cast("int").between(1, 12), F.concat(part(raw, 1), F.lit("/"), part(raw, 3), F.lit("/20"), part(raw, 5)))
    return n.once(F.regexp_extract(text, CARDS[0], 2), dated)


def report_date() -> Column:
    """The date printed in a document's head, if it is one."""
    pattern = r"(?<!\d)(\d{2})/(\d{2})/(\d{4})(?!\d)"
    fits = F.regexp_extract("content", pattern, 1).try_cast("int").between(1, 31) & F.regexp_extract("content", pattern, 2).try_cast("int").between(1, 12)
    return F.when(fits, F.regexp_extract("content", pattern, 0))


def unified(rows: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """Marks belong to the take: what one row of a document has, all rows of the take have."""

    def fold(t: Lines) -> None:
        whole = t["slate"].notna() & t["take_id"].notna()
        for m in marks:
            own = t[m].fillna(False).astype(bool)
            t[m] = t.any(own, "slate", "take_id").where(whole, own)

    return folded(rows, "", fold)


# ---- camera

def parse_camera_log(docs: DataFrame) -> DataFrame:
    """Camera logs by roll and setup: roll headers, setups with lens and exposure, takes with clips.

    A take line is a take and a clip number; a setup line may end in one. Rolls, magazines and
    exposure hold until they are stated anew, a note holds for its setup. A note that names takes
    marks these as effects shots, one that names none marks all takes below it.
    """
    line = F.col("line")
    # fixed values: the shapes of a roll header, a setup, a take line, and a take at a setup's end
    roll, slate = r"ROLL\s*([A-Z]\d{3})", r"^(\d+[A-Z]?/\d+)"
    take, inline = r"^(\d+[A-Z*]?|FC|FALSE)\s+(\d{3,4})$", r"(?:EI|ISO\d+)(\d+[A-Z*]?|FC|FALSE)\s+(\d{3,4})$"
    kind = F.when(line.rlike(roll), "roll").when(line.rlike(slate), "setup").when(F.contains(line, F.lit("Notes")), "note").when(line.rlike(take), "take").otherwise("other")
    rows = _lines(docs, CAMERA_SKIPS).withColumn("kind", kind)
    at = lambda k, v: F.when(F.col("kind") == k, v)
    lens = F.coalesce(_group(line, r"Lens\((.*?)\)"), _group(line, r"Lens([0-9A-Za-z/ ]+?)(?:Stop|Filters|Color|FPS|$)"))
    stated = {
        "camera_roll": at("roll", n.camera_roll(_group(line, roll))), "magazine": at("roll", _group(line, r"MAGAZINE\s*(#[A-Za-z0-9]+)")),
        "camera": at("roll", _group(line, r"CAMERA\s*([A-Za-z0-9 ]+?)(?:MAGAZINE|$)")), "slate": at("setup", n.slate(_group(line, slate))),
        "lens": at("setup", lens), "stop": at("setup", F.regexp_replace(_group(line, r"Stop([A-Za-z0-9 ./?]+?)(?:Color|FPS|Shutter|Filters|$)"), r"\?", "")),
        "fps": at("setup", _group(line, r"(?i)FPS\s*(\d+(?:\.\d+)?)fps").try_cast("double")), "iso": at("setup", _group(line, r"(?i)ISO\s*(\d+)").try_cast("int")),
        "shutter": at("setup", _group(line, r"Shutter([0-9.]+)")),
    }
    raw = F.coalesce(at("take", _group(line, take)), at("setup", _group(line, inline)))
    clip = F.coalesce(at("take", _group(line, take, 2)), at("setup", _group(line, inline, 2)))
    carried = list(stated)
    rows = rows.select("*", *[v.alias(k) for k, v in stated.items()], at("note", F.trim(F.expr("substring(line, instr(line, 'Notes') + 5)"))).alias("setup_note"), raw.alias("raw"), clip.alias("number"))

    def fold(t: Lines) -> None:
        for k in carried:
            t[k] = t.last(t[k])
        t["setup"] = t.count(t["kind"] == "setup")
        t["setup_note"] = t.last(t["setup_note"], "setup")

    rows = folded(rows, "setup int", fold, passing=True).filter(kept(F.expr("raw is not null and slate is not null and camera_roll is not null")))
    rows = rows.withColumn("t", n.take(F.col("raw")))
    t, note = F.col("t"), F.upper(F.coalesce("setup_note", F.lit("")))
    named = r"TOMAS?\s*([\d\s,YEAND]+)"
    listed = F.array_contains(F.regexp_extract_all(F.regexp_extract(note, named, 1), F.lit(r"\d+"), F.lit(0)), t["take_id"])
    vfx = F.when(F.col("kind") == "setup", F.contains(F.upper(line), F.lit("VFX"))).when(~F.contains(note, F.lit("VFX")), t["vfx"]).when(note.rlike(named), listed).otherwise(True)
    return rows.select(
        *KEYS, "place", "slate", t["take_id"].alias("take_id"), "camera_roll", F.concat("camera_roll", F.lit("_C"), F.lpad(F.col("number").cast("int").cast("string"), 3, "0")).alias("clip_name"),
        F.coalesce("fps", F.lit(24.0)).alias("fps"), "lens", "stop", "iso", "shutter", "magazine", "camera", t["starred"].alias("starred"), t["pickup"].alias("pickup"),
        (t["false_start"] | F.col("raw").isin("FC", "FALSE")).alias("false_start"), F.coalesce(vfx, F.lit(False)).alias("vfx"),
        ((F.col("kind") == "take") & (t["mos"] | note.rlike(r"MOS|M\.O\.S"))).alias("mos"), F.coalesce("setup_note", t["note"]).alias("note"), "error",
    )


# ---- script

MARKS = ("starred", "pickup", "false_start", "wild", "vfx", "mos")


def _script_rows(rows: DataFrame, slate: Column, raw_take: Column, text: Column, note: Column) -> DataFrame:
    """What a timecode log's row returns; text is searched for marks."""
    rows = settled(rows, t=n.take(raw_take), slate_said=slate, text_said=F.upper(text))
    rows = settled(rows, normal=n.slate(F.col("slate_said")))
    t, upper, normal, slate = F.col("t"), F.col("text_said"), F.col("normal"), F.col("slate_said")
    marks = {"starred": t["starred"], "pickup": t["pickup"], "false_start": t["false_start"], "wild": F.contains(F.upper(slate), F.lit("WT")) | t["wild"], "vfx": F.contains(upper, F.lit("VFX")) | t["vfx"], "mos": F.contains(upper, F.lit("MOS")) | F.contains(F.upper(slate), F.lit("MOS")) | t["mos"]}
    made = [F.substring_index(normal, "/", 1).alias("scene"), normal.alias("slate"), t["take_id"].alias("take_id"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in marks.items()], F.coalesce(F.nullif(F.trim(note), F.lit("")), t["note"]).alias("note")]
    return unified(rows.select(*KEYS, "document", "place", *made, "camera_roll", "timecode_in", "timecode_out", "recording_date", "stated_day", "inherited", "error"), MARKS).drop("document")


# fixed values: the shapes of a take on one line, and of the head of one over several
ONE_LINE = rf"^({SLATE})\s+(\d+[A-Z*]?|FALSE)\s+({TIMECODE})\s*(?:\d{{2}}:\d{{2}}:\d{{2}}(?!:))?\s*({TIMECODE})?(.*)"
HEAD = rf"^(\d+[A-Z]?/\d+|\d+WT)\s+(\d+[A-Z*]?|FALSE)(?:(?=\d{{2}}:\d{{2}}:\d{{2}})|\s+)({TIMECODE})?"
TIMECODE_SKIPS = r"DAILY TIMECODE LOG|Date:|Page "


def _timecode_kind(line: Column) -> Column:
    """What a line of a timecode log is: a take on one line, a head, a time, a card, text."""
    single = line.rlike(ONE_LINE) & card(F.regexp_extract(line, ONE_LINE, 5)).isNotNull()
    return F.when(single, "one").when(line.rlike(HEAD), "head").when(line.rlike(rf"^{TIMECODE}$"), "time").when(card(line).isNotNull(), "card").otherwise("text")


def has_timecode_rows() -> Column:
    """Whether a document's content gives a row of a timecode log: a take on one line, or a card
    below a head."""
    lines = F.transform(F.split(F.coalesce("content", F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    kinds = F.transform(F.filter(lines, lambda x: (x != "") & ~x.rlike(TIMECODE_SKIPS)), _timecode_kind)
    below = lambda k: F.aggregate(k, F.lit(0), lambda a, x: F.when((a == 2) | ((a == 1) & (x == "card")), 2).when((x == "head") | (a == 1), 1).otherwise(0)) == 2
    return n.once(kinds, lambda k: F.array_contains(k, "one") | below(k))


def parse_timecode_log(docs: DataFrame) -> DataFrame:
    """Timecode logs, takes on one line or over several, one row a take and card.

    On one line: slate, take, timecodes, card and date. Over several: slate and take with the
    first timecode, the last timecode on a line of its own, then a line for each card. Other lines
    belong to the note of the row above, before the first row to its own; lines that are somebody's
    contact details to none.
    """
    line = F.col("line")
    rest = F.regexp_extract(line, ONE_LINE, 5)
    rows = _lines(docs, TIMECODE_SKIPS, report_date=report_date())
    rows = settled(rows, kind=_timecode_kind(line))
    at = lambda k, v: F.when(F.col("kind") == k, v)
    plain = (F.col("kind") != "head") & ~line.rlike(r"^(?:Lens:|Script /)") & ~is_contact(line)
    rows = rows.select("*", at("head", _group(line, HEAD)).alias("head_slate"), at("head", _group(line, HEAD, 2)).alias("head_take"), at("head", F.coalesce(_group(line, HEAD, 3), F.lit(""))).alias("started"), plain.alias("plain"))

    def fold(t: Lines) -> None:
        t["block"] = t.count(t["kind"] == "head")
        t["started"] = t.last(t["started"], "block")
        t["head_slate"], t["head_take"] = t.last(t["head_slate"]), t.last(t["head_take"])
        # the first time of a block ends its take, if the head has a first timecode
        ends = (t["kind"] == "time") & (t.count(t["kind"] == "time", "block") == 1) & (t["started"] != "")
        t["ended"] = t.last(t["line"].where(ends & t["started"].notna()), "block")
        t["row"] = (t["kind"] == "one") | ((t["kind"] == "card") & (t["block"] > 0))
        t["nth"] = t.count(t["row"])
        free = t["line"].where(t["plain"].astype(bool) & ~t["row"] & ~ends)
        t["own"] = t.said(free.where((t["nth"] == 0) & (t["block"] > 0)), t["row"], "block")
        t["after"] = t.joined(free, "nth").where(t["nth"] > 0, "")

    found = folded(rows, "block int, ended string, row boolean, nth int, own string, after string", fold).filter(kept(F.col("row")))
    single = F.col("kind") == "one"
    found = found.select(
        "*", F.when(single, card(rest)).otherwise(card(line)).alias("camera_roll"), F.coalesce(stamp(F.when(single, rest).otherwise(line)), "report_date").alias("recording_date"),
        F.when(single, F.regexp_extract(line, ONE_LINE, 3)).otherwise(F.nullif("started", F.lit(""))).alias("timecode_in"), F.when(single, _group(line, ONE_LINE, 4)).otherwise(F.col("ended")).alias("timecode_out"),
        F.lit(None).cast("string").alias("stated_day"), F.lit(False).alias("inherited"),
    )
    slate, take = F.when(single, F.regexp_extract(line, ONE_LINE, 1)).otherwise(F.col("head_slate")), F.when(single, F.regexp_extract(line, ONE_LINE, 2)).otherwise(F.col("head_take"))
    note = F.concat_ws(" ", F.nullif(F.when(single, F.trim(rest)).otherwise(F.col("own")), F.lit("")), F.nullif("after", F.lit("")))
    return _script_rows(found, slate, take, F.when(single, line).otherwise(F.col("own")), note)


def parse_editor_log(docs: DataFrame) -> DataFrame:
    """Detailed logs of an editor's facing pages: setups, their takes, a row for each card.

    A setup states its card, and may state its date and the day it was shot on, which holds for all
    its rows; takes with a duration but no card are on the setup's card. Wild tracks stand alone.
    Scene headings end a page; a row of an unknown setup ends the setup above it.

    What a line says is read by its shape alone, and slates and takes are normalised where they are
    stated; the fold carries them down and gives the marks of a row to its take.
    """
    line = F.col("line")
    # fixed values: the shapes of a setup, a take below it, a wild track, a scene heading, a day
    setup, sub = rf"^({SLATE})\s+({TAKE})\s*(.*)", rf"^({TAKE})\s+(.*)"
    wild = r"(?i)(\d+WT)\s+(\d+[A-Z*]?)\s+.*?(?:Wild Track:)?\s*.*?(?:n/a)?\s*(\d{6})?\s*(\d+:\d+)?\s*(.*)"
    heading = r"(?i)^(?:\d+[A-Z]{0,2}\.?\s+(?:\d+[A-Z]{0,2})?\s*)?(?:INT|EXT)[./]"
    day = r"Shot on Day:\s*Day\s*([0-9A-Za-z]+)"
    HEADING, DAY, WILD, SETUP, SPLIT, SUB, UNKNOWN, TEXT = range(8)
    shape = (
        F.when(line.rlike(heading), HEADING).when(line.rlike(day), DAY).when(line.rlike(wild), WILD).when(line.rlike(setup), SETUP)
        .when(line.rlike(rf"^{SLATE}$") & F.col("ahead").rlike(rf"^{TAKE}\s+Scene\(s\):"), SPLIT).when(line.rlike(sub), SUB).when(F.contains(line, F.lit("Scene(s):")), UNKNOWN).otherwise(TEXT)
    )
    of_document = [*KEYS, "document", "report_date", "place"]
    rows = _lines(docs, SCRIPT_SKIPS, near=3, report_date=report_date()).select(*of_document, "line", shape.alias("shape"))

    def by_shape(*said: tuple[int, Column]) -> Column:
        out = F.lit(None).cast("string")
        for k, v in said:
            out = F.when(F.col("shape") == k, v).otherwise(out)
        return out

    part = lambda p, i: F.regexp_extract(line, p, i)
    squeezed = lambda p, i: F.replace(part(p, i), F.lit(" "), F.lit(""))
    scenes = F.contains(line, F.lit("Scene(s):"))
    rows = rows.select(
        *of_document, "shape", F.when(F.col("shape").isin(SETUP, SUB, TEXT), line).alias("text"), scenes.alias("scenes"), ((F.col("shape") == WILD) & line.rlike(r"^\d+WT\s")).alias("alone"),
        by_shape((SETUP, part(setup, 3)), (SUB, part(sub, 2)), (WILD, F.coalesce(_group(line, wild, 5), F.lit("Wild Track"))), (TEXT, line)).alias("rest"),
        # a take of no setup, which the fold may find to be text
        F.when((F.col("shape") == SUB) & ~scenes, line).alias("loose"),
        by_shape((SETUP, part(setup, 1)), (SPLIT, line), (WILD, part(wild, 1))).alias("slate_said"), by_shape((SETUP, squeezed(setup, 2)), (SUB, squeezed(sub, 1)), (WILD, part(wild, 2))).alias("take_said"),
        by_shape((DAY, n.once(_group(line, day), n.shoot_day))).alias("day_said"),
    )
    slate, carded, loose = F.col("slate_said"), F.when(F.col("shape") != WILD, F.col("rest")), F.col("loose")
    stated = lambda c, v: F.when(c.isNotNull(), v)
    rows = rows.select(
        *of_document, "shape", "scenes", "alone", "rest", "loose", "day_said", "text", "slate_said", stated(slate, n.slate(slate)).alias("slate"), stated(F.col("take_said"), n.take(F.col("take_said"))).alias("t"),
        stated(carded, card(carded)).alias("card"), stated(carded, stamp(carded)).alias("stamp"), stated(loose, card(loose)).alias("loose_card"), stated(loose, stamp(loose)).alias("loose_stamp"),
    )
    names = lambda c, w: n.names(F.col(c), w)
    flags = {
        "scenes": F.col("scenes"), "alone": F.col("alone"), "contact": F.when(F.col("shape") == TEXT, is_contact(F.col("rest"))).when(loose.isNotNull(), is_contact(loose)),
        "vfx": names("text", "VFX"), "mos": names("text", "MOS"), "setup_vfx": (F.col("shape") == SETUP) & names("rest", "VFX"), "setup_mos": (F.col("shape") == SETUP) & names("rest", "MOS"),
        "slate_wild": names("slate_said", "WT"), "slate_mos": names("slate_said", "MOS"), **{f"take_{m}": F.col("t")[m] for m in MARKS},
    }
    # all that a line is or isn't, in one number
    bits = {k: 1 << i for i, k in enumerate(flags)}
    said_of = reduce(add, [F.when(c, bits[k]).otherwise(0) for k, c in flags.items()])
    rows = rows.select(*of_document, "shape", "rest", "loose", "day_said", "slate", F.col("t")["take_id"].alias("take_id"), F.col("t")["note"].alias("take_note"), "card", "stamp", "loose_card", "loose_stamp", said_of.alias("flags"))

    def fold(t: Lines) -> None:
        is_ = lambda *k: t["shape"].isin(k)
        has = lambda k: (t["flags"] & bits[k]) != 0
        slate_from = t.latest(is_(HEADING, SETUP, SPLIT, UNKNOWN))
        in_setup = t.at(is_(SETUP, SPLIT), slate_from)
        # a line that begins like a take of no setup is none, unless it belongs to an unknown one
        lone = is_(SUB) & ~in_setup
        if lone.any():
            turned = lone & ~has("scenes")
            t["shape"] = t["shape"].mask(lone, UNKNOWN).mask(turned, TEXT)
            for c, free in (("rest", "loose"), ("card", "loose_card"), ("stamp", "loose_stamp")):
                t[c] = t[c].mask(lone, t[free].where(turned))
        text, wild_, takes, opens = is_(TEXT), is_(WILD), is_(SETUP, SUB), is_(HEADING, SETUP, SPLIT, UNKNOWN)
        t["setup_id"], t["block"] = t.count(opens), t.count(opens | (wild_ & has("alone")))
        take_from = t.latest(takes | opens)
        inside = takes | (text & in_setup & t.at(takes, take_from))
        named = t["card"].where(inside)
        stamped = t["stamp"].where(named.notna())
        bare = is_(SUB) & named.isna()
        held = bare & t["rest"].where(bare).str.match(r"\d+:\d{2}\b").eq(True) if bare.any() else bare
        # a row without a card has none of its own, so the last card so far stands above it
        above = t.last(named, "block").where(named.isna())
        t["inherited"] = held & above.notna()
        t["camera_roll"] = named.where(named.notna(), above).mask(wild_, None)
        t["recording_date"] = stamped.where(stamped.notna(), t.first(stamped, "block")).where(lambda d: d.notna() & ~wild_, t["report_date"])
        t["row"] = wild_ | named.notna() | t["inherited"]
        t["day_stated"] = t.final(t["day_said"], "block")
        # a line of text that names a card has what was said in its setup before it
        free = text & named.isna() & in_setup & ~has("contact")
        said = t["rest"].where((is_(SETUP) & (t["rest"] != "")) | free)
        before = t.said(said, t["row"] & text, "setup_id")
        t["note"] = t["rest"].mask(text & (before != ""), before)
        spoken = {m: has(m) | (text & (t.count(said.notna() & has(m).mask(is_(SETUP), has(f"setup_{m}")), "setup_id") > 0)) for m in ("vfx", "mos")}
        # a wild track has its own slate and take, other rows have those stated above them
        own = np.arange(len(wild_))
        slate_from, take_from = slate_from.mask(wild_, own), take_from.mask(wild_, own)
        told = {m: t.at(has(f"slate_{m}"), slate_from) for m in ("wild", "mos")}
        marked = {m: t["row"] & (t.at(has(f"take_{m}"), take_from) | spoken.get(m, False) | told.get(m, False)) for m in MARKS}
        t["slate"] = t.at(t["slate"], slate_from)
        t["take_id"], t["take_note"] = t.at(t["take_id"], take_from), t.at(t["take_note"], take_from)
        whole = t["slate"].notna() & t["take_id"].notna() & t["row"]
        for m, flag in marked.items():
            t[m] = t.any(flag & whole, "slate", "take_id").where(whole, flag)

    adds = f"{', '.join(f'{m} boolean' for m in MARKS)}, note string, camera_roll string, recording_date string, day_stated string, inherited boolean, row boolean"
    found = folded(rows, adds, fold, left=["report_date", "shape", "rest", "loose", "day_said", "card", "stamp", "loose_card", "loose_stamp", "flags"]).filter(kept(F.col("row")))
    return found.select(
        *KEYS, "place", F.substring_index("slate", "/", 1).alias("scene"), "slate", "take_id", *[F.coalesce(m, F.lit(False)).alias(m) for m in MARKS], F.coalesce(F.nullif(F.trim("note"), F.lit("")), F.col("take_note")).alias("note"),
        "camera_roll", *[F.lit(None).cast("string").alias(c) for c in ("timecode_in", "timecode_out")], "recording_date", F.col("day_stated").alias("stated_day"), "inherited", "error",
    )


def parse_script_log(docs: DataFrame) -> DataFrame:
    """Editor's logs that say so; of the rest timecode logs, and what gives no row of that layout
    as an editor's log."""
    content, title = F.coalesce("content", F.lit("")), F.lit("EDITOR'S LOG")
    as_editor = F.contains(content, title) | F.contains(F.upper(content), title) | ~has_timecode_rows()
    routed = settled(docs, as_editor=as_editor)
    return parse_timecode_log(routed.filter("not as_editor")).unionByName(parse_editor_log(routed.filter("as_editor")))


# ---- offloads

def named_sound(base: Column) -> Column:
    """struct(slate, take_id, pickup, wild) of a sound file's name without its ending."""
    # fixed values: scene, shot and take; scene and wild take; scene and take
    forms = [r"(?i)^(.+?)-([A-Za-z0-9_]+)T([A-Za-z0-9_*]+)$", r"(?i)^(.+?)WTT([A-Za-z0-9_*]+)$", r"(?i)^(.+?)T([A-Za-z0-9_*]+)$"]
    part = lambda f, i: F.regexp_extract(base, forms[f], i)
    shot = F.regexp_replace(part(0, 2), "(?i)pk", "")
    slate = F.when(base.rlike(forms[0]), F.concat_ws("/", part(0, 1), shot)).when(base.rlike(forms[1]), F.concat(part(1, 1), F.lit("/WT"))).when(base.rlike(forms[2]), part(2, 1))
    raw = F.when(base.rlike(forms[0]), part(0, 3)).when(base.rlike(forms[1]), part(1, 2)).when(base.rlike(forms[2]), part(2, 2))
    return n.once(n.take(raw), lambda t: _named_sound(base, forms, part, slate, raw, t))


def _named_sound(base: Column, forms: list[str], part, slate: Column, raw: Column, t: Column) -> Column:
    pickup = base.rlike(forms[0]) & (F.contains(F.upper(part(0, 2)), F.lit("PK")) | t["pickup"])
    wild = F.contains(F.upper(slate), F.lit("WT")) | t["wild"]
    return F.struct(n.slate(slate).alias("slate"), F.coalesce(t["take_id"], raw).alias("take_id"), F.coalesce(pickup, F.lit(False)).alias("pickup"), F.coalesce(wild, F.lit(False)).alias("wild"))


#: The shapes of a day's reel (reel, camera, clips, duration, files, size), of a sound
#: clip and of a camera clip.
REEL = r"([A-C]_0*\d{3,4}_[A-Za-z0-9]+)\s+([A-C_]+)\s+(\d+)\s*([\d:]+\s*(?:min|h|sec))\s+(\d+)?\s*([\d.]+)\s*(GB|TB|MB)"
SOUND_CLIP = r"^([+A-Za-z0-9_\-]+)\s+(Sound Dev:.+?)\s+(\d+:\d+\s*(?:min|sec)|\d+\s*sec)$"
VIDEO_CLIP = r"^([A-C]_0*\d{3,4}C\d{3,4}\S*)\s+([A-C])_\s+(.+?)\s+(\d+:\d+\s*(?:min|sec)|\d+(?:\.\d+)?\s*sec)\s+(\d+x\d+)\s+([\d.]+°\s*@\s*\d+fps)\s+([\d.]+\s*mm)\s+(\S+(?:\s+\d+/\d+)?)\s+(\d+)\s+(\d+\s*K)"

OFFLOAD = ["file_name", "camera_roll", "slate", "take_id", "size_bytes", "checksum", "checksum_type", "volume", "reel_tape", "card_type", "pickup", "wild", "details"]


def _offload(rows: DataFrame, **values: Column) -> DataFrame:
    none = {"size_bytes": "bigint", "pickup": "boolean", "wild": "boolean", "details": "map<string,string>"}
    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string").alias("error")
    return rows.select(*KEYS, "place", *[values.get(c, F.lit(None)).cast(none.get(c, "string")).alias(c) for c in OFFLOAD], error)


def parse_volume_report(docs: DataFrame) -> DataFrame:
    """Files of a volume: its name, then its checksum, then its size; sound folders stand above."""
    line = F.col("line")
    # fixed values: the shapes of a file's name, a checksum, a size
    name, hashed, sized = r"(?i)^([+A-Za-z0-9_\-.]+\.(?:WAV|MOV|BRAW|ARI|ARX|MXF|MP4))$", r"(?i)(XXH64|MD5|SHA1):([a-f0-9]+)", r"(?i)([\d.]+)\s*(MB|GB|KB|Bytes)"
    volume = _group(F.col("content"), r"Volume Report[^\n]*\n[^\n]*\n([^\n]+)")
    rows = _lines(docs, r"^\b$", volume=volume).withColumn("is_name", line.rlike(name))
    below = lambda c: F.when(~F.col("is_name"), c)
    rows = rows.select("*", _group(line, r"\b(\d{2}Y\d{2}M\d{2})\b").alias("folder"), _group(line, name).alias("file_name"), below(_group(line, hashed, 2)).alias("checksum"), below(F.upper(_group(line, hashed))).alias("hash_type"), below(line.rlike(sized)).alias("sized"))

    def fold(t: Lines) -> None:
        t["block"] = t.count(t["is_name"])
        t["folder"] = t.last(t["folder"])
        for c in ("file_name", "checksum", "hash_type"):
            t[c] = t.last(t[c], "block")
        ready = t["sized"].eq(True) & t["checksum"].notna() & (t["block"] > 0)
        t["ready"] = ready & (t.count(ready, "block") == 1)

    rows = folded(rows, "block int, ready boolean", fold, passing=True).filter(kept(F.col("ready")))
    is_wav = F.lower("file_name").endswith(".wav")
    rows = rows.withColumn("s", F.when(is_wav, named_sound(F.regexp_replace("file_name", r"\.[^.]*$", ""))))
    s = F.col("s")
    roll = F.when(~is_wav, n.camera_roll(_group(F.col("file_name"), r"^([A-Z]\d{3})")))
    return _offload(rows, file_name=F.col("file_name"), camera_roll=roll, slate=s["slate"], take_id=s["take_id"], size_bytes=_bytes(line, sized), checksum=F.col("checksum"), checksum_type=F.col("hash_type"), volume=F.col("volume"), reel_tape=F.col("folder"), card_type=F.when(is_wav, "sound").otherwise("camera"), pickup=F.coalesce(s["pickup"], F.lit(False)), wild=F.coalesce(s["wild"], F.lit(False)))


def parse_day_report(docs: DataFrame) -> DataFrame:
    """Reels of a shooting day: each stands for as many clips as it counts, of even size."""
    line = F.col("line")
    rows = _lines(docs, r"^\b$").filter(line.rlike(REEL))
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    name = F.regexp_extract(line, REEL, 1)
    roll = n.camera_roll(F.concat(F.substring_index(name, "_", 1), F.regexp_extract(name, r"_0*?(\d{3})_", 1)))
    rows = rows.select(*KEYS, "place", name.alias("reel"), roll.alias("roll"), F.regexp_extract(line, REEL, 3).cast("int").alias("clips"), (F.regexp_extract(line, REEL, 6).try_cast("double") * F.element_at(unit, F.regexp_extract(line, REEL, 7))).cast("bigint").alias("bytes"))
    rows = rows.filter("clips > 0").withColumn("clip", F.explode(F.sequence(F.lit(1), F.col("clips"))))
    return _offload(rows, file_name=F.concat("roll", F.lit("_C"), F.lpad(F.col("clip").cast("string"), 3, "0"), F.lit(".mxf")), camera_roll=F.col("roll"), size_bytes=F.floor(F.col("bytes") / F.col("clips")), checksum=F.lit("VERIFIED-BACKUP-3+"), checksum_type=F.lit("XXH64"), volume=F.col("reel"), card_type=F.lit("camera"), pickup=F.lit(False), wild=F.lit(False))


def parse_clips_report(docs: DataFrame) -> DataFrame:
    """Sound and camera clips, a line each, with what the line says of lens and exposure."""
    line = F.col("line")
    rows = _lines(docs, CLIP_SKIPS).withColumn("is_sound", line.rlike(SOUND_CLIP)).filter(F.col("is_sound") | line.rlike(VIDEO_CLIP))
    rows = rows.withColumn("s", F.when(F.col("is_sound"), named_sound(F.regexp_extract(line, SOUND_CLIP, 1))))
    s = F.col("s")
    clip = F.regexp_extract(line, VIDEO_CLIP, 1)
    roll = n.camera_roll(F.concat(F.substring(clip, 1, 1), F.regexp_extract(clip, r"_0*?(\d{3})C", 1)))
    fields = {"camera": 2, "model": 3, "duration": 4, "resolution": 5, "shutter": 6, "focal_length": 7, "tstop": 8, "iso": 9, "white_balance": 10}
    told = F.create_map(*[x for k, i in fields.items() for x in (F.lit(k), F.regexp_extract(line, VIDEO_CLIP, i))])
    heard = F.create_map(F.lit("recorder"), F.regexp_extract(line, SOUND_CLIP, 2), F.lit("duration"), F.regexp_extract(line, SOUND_CLIP, 3))
    name = F.when(F.col("is_sound"), F.concat(F.regexp_extract(line, SOUND_CLIP, 1), F.lit(".WAV"))).when(F.contains(clip, F.lit(".")), clip).otherwise(F.concat(clip, F.lit(".mxf")))
    video_only = lambda c: F.when(~F.col("is_sound"), c)
    return _offload(rows, file_name=name, camera_roll=video_only(roll), slate=s["slate"], take_id=s["take_id"], checksum=F.lit("VERIFIED"), checksum_type=F.lit("XXH64"), volume=video_only(F.concat(F.lit("Camera Card "), roll)), card_type=F.when(F.col("is_sound"), "sound").otherwise("camera"), pickup=F.coalesce(s["pickup"], F.lit(False)), wild=F.coalesce(s["wild"], F.lit(False)), details=F.when(F.col("is_sound"), heard).otherwise(told))


def parse_thumbnails(docs: DataFrame) -> DataFrame:
    rows = parse_thumbnail_report(docs).withColumn("place", F.col("block").cast("int"))
    return _offload(rows, file_name=F.col("file_name"), camera_roll=F.col("camera_roll"), slate=F.col("slate"), take_id=F.col("take_id"), card_type=F.col("card_type"), pickup=F.lit(False), wild=F.lit(False), details=F.create_map(F.lit("fps"), F.col("fps").cast("string"), F.lit("duration"), F.col("duration")))


def parse_offload_text(docs: DataFrame) -> DataFrame:
    """Files of any offload report, by what it says it is; a layout that gives nothing yields to
    the next: thumbnails to clips, clips and shooting days to volumes."""
    text = F.coalesce("content", F.lit(""))
    has = lambda *words: F.exists(F.lit([*words]), lambda w: F.contains(text, w))
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    clips = F.exists(lines, lambda x: (x != "") & ~x.rlike(CLIP_SKIPS) & (x.rlike(SOUND_CLIP) | x.rlike(VIDEO_CLIP)))
    thumbs = F.exists(thumbnail_blocks(), lambda b: n.is_clip_name(F.regexp_extract(b, r"(?m)^Name[ \t]+(.*)$", 1)))
    layout = (
        F.when(has("Thumbnail Report"), F.when(thumbs, "thumbnails").when(clips, "clips").otherwise("volume")).when(has("Volume Report", "XXH64:", "MD5:"), "volume")
        .when(has("Shooting Day Report"), F.when(F.exists(lines, lambda x: x.rlike(REEL)), "day").otherwise("volume")).when(has("Clips Report"), F.when(clips, "clips").otherwise("volume")).otherwise("volume")
    )
    routed, out = settled(docs, layout=layout), None
    for name, parse in (("thumbnails", parse_thumbnails), ("clips", parse_clips_report), ("day", parse_day_report), ("volume", parse_volume_report)):
        rows = parse(routed.filter(F.col("layout") == name))
        out = rows if out is None else out.unionByName(rows)
    return out


def scene_timings(docs: DataFrame) -> DataFrame:
    """(KEYS, place, scene, read, shoot, difference) of the table of scene timings of a daily report."""
    return docs.select(*KEYS, F.posexplode(scene_timing_rows()).alias("place", "t")).select(*KEYS, "place", "t.*")
