"""Paperwork to rows: reading, classifying, routing and parsing documents.

Documents are rows (production_id, shoot_day, doc_id, filename, content). Parsers explode
documents into lines and work on expressions; only quoted delimited text needs a reader of its
own, a small Arrow-batched helper. A document that yields no row goes to `rejected`, and so does
one that a parser fails on, which is a row with its `error`.
"""

from __future__ import annotations

import csv
import io
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.sources.documents import KEYS, Lines, folded, kept, lines_of, message, settled

#: Columns that a field goes by in camera and sound reports.
CAMERA_FIELDS = {"slate": ["SLATE", "SCENE/SHOT", "SCENE"], "take": ["TAKE"], "roll": ["ROLL", "CAMERA ROLL", "CAMERAROLL", "REEL"], "clip_name": ["CLIP NAME", "CLIPNAME", "CLIP", "FILE NAME", "FILENAME"], "timecode_in": ["START TC", "START", "TC IN", "TIMECODE IN"], "timecode_out": ["END TC", "END", "TC OUT", "TIMECODE OUT"], "lens": ["LENS", "FOCAL LENGTH"], "fps": ["FPS", "FRAME RATE"], "iso": ["ISO", "EI/ISO", "EI"], "shutter": ["SHUTTER", "ANGLE"]}
SOUND_FIELDS = {"slate": ["SCENE", "SLATE", "NAME"], "take": ["TAKE"], "file_name": ["FILE NAME", "FILENAME", "CLIP NAME"], "roll": ["SOUND ROLL", "TAPE", "ROLL", "SOUND_ROLL"], "timecode_in": ["START", "START TC", "TC IN", "TIMECODE IN"], "timecode_out": ["END", "END TC", "TC OUT", "TIMECODE OUT"], "duration": ["LENGTH", "DURATION"], "note": ["NOTES", "NOTE", "COMMENTS"], "tracks": ["TRACKS", "CHANNELS"]}
#: Labels of the daily report.
SCENE_LABELS = {"scheduled": "Scenes Scheduled", "complete": "Scenes Complete", "part_complete": "Scenes Part Complete", "scheduled_not_shot": "Scenes Scheduled Not Shot", "shot_not_scheduled": "Scenes Shot Not Scheduled"}
TIME_LABELS = {"general_call": r"CITACI\w*N\s+GENERAL", "first_shot_morning": r"PRIMER\s+MOTOR\s+MA\w*ANA", "snack": "BOCATA", "lunch": "COMIDA", "first_shot_afternoon": r"PRIMER\s+MOTOR\s+TARDE", "wrap": "WRAP"}
OTHER_LABELS = [r"Set-?Ups", r"Total\s+P\w*ginas", r"Camera\s+Cards", r"Sound\s+Cards", "Slates"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files with their content, size, checksum and name."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("content").cast("string").alias("content"), F.octet_length("content").alias("size"), F.sha2("content", 256).alias("checksum"))


# ---- classifying and routing

#: Fixed value: the production of demonstration paperwork.
DEMO = "DEMO_PRODUCTION"


def classified(docs: DataFrame) -> DataFrame:
    """doc_type, department, axis, display_name and is_multimodal by the first rule that the name or
    first text meets; inferred_production where the paperwork names it."""
    name, text = F.upper(F.coalesce("filename", F.lit(""))), F.upper(F.substring(F.coalesce("content", F.lit("")), 1, 2000))
    has = lambda c, *words: F.exists(F.lit([*words]), lambda w: F.contains(c, w))
    rules = [
        (has(name, "FACING", "LINED"), "script_lined", "script", "belief", "Script Lined / Facing Pages (Handwritten Multimodal)"),
        (has(name, "EDITOR", "TCLOG", "DETAILED") | has(text, "DAILY EDITOR'S LOG", "TIMECODE LOG", "DETAILED EDITOR'S LOG"), "script_timecode", "script", "belief", "Script Supervisor Editor's / Timecode Log"),
        (has(name, "CAM_", "CAMERA") | has(text, "ZOELOG") | (has(text, "ROLL") & has(text, "SCENE TAKE CLIP")), "camera_csv", "camera", "belief", "Camera Report"),
        (name.endswith(".ALE") | has(name, "SOUND", "REPORT.CSV") | has(text, "SOUND REPORT", "B-WAV", "FIELD_DELIM"), "sound_ale", "sound", "belief", "Sound Report"),
        (has(name, "VOLUME", "CLIPS", "SILVERSTACK", "THUMBNAIL", "SHOOTING DAY", "SHOOTING_DAY", "OFFLOAD") | has(text, "POMFORT", "SILVERSTACK", "VOLUME REPORT", "SHOOTING DAY REPORT"), "offload", "dit", "existence", "Silverstack DIT Offload Manifest"),
        (has(name, "PARTEPROD", "PARTE_PROD", "DPR") | has(text, "PARTE DE PRODUCCION"), "dpr", "office", "intent", "Daily Production Report (Office DPR)"),
    ]
    kind = F.lit("camera_csv|camera|belief|Generic Paperwork Drop")
    for condition, *values in reversed(rules):
        kind = F.when(condition, "|".join(values)).otherwise(kind)
    parts = F.split(kind, r"\|")
    out = docs.withColumn("doc_type", parts[0]).withColumn("department", parts[1]).withColumn("axis", parts[2]).withColumn("display_name", parts[3])
    by_hand = (F.col("display_name") == "Camera Report") & is_handwritten(text)
    demo = has(name, "DEMO") | has(F.upper(F.substring(F.coalesce("content", F.lit("")), 1, 3000)), "DEMO PRODUCTION")
    return (
        out.withColumn("is_multimodal", (F.col("doc_type") == "script_lined") | by_hand)
        .withColumn("display_name", F.when(by_hand, "Camera Report (handwritten)").otherwise(F.col("display_name")))
        .withColumn("inferred_production", F.when(demo, DEMO))
    )


def inferred_day(filename: Column, content: Column, calendar: dict[str, str] | None = None) -> Column:
    """Shoot day by `SDn`, `_Dn`, `#n` in the name, a known date, or `Day: Day n` in the text."""
    name, text = F.upper(F.coalesce(filename, F.lit(""))), F.upper(F.substring(F.coalesce(content, F.lit("")), 1, 3000))
    found = [F.when(name.rlike(p), F.regexp_replace(F.regexp_extract(name, p, 1), "^0+(?=[0-9])", "")) for p in (r"SD(\d+)", r"[_\-]D0*(\d+)", r"#(\d+)")]
    dated = lambda c: [F.when(F.contains(c, F.lit(k.upper())), v) for k, v in (calendar or {}).items()]
    stated = F.when(text.rlike(r"DAY\s*:\s*DAY\s*\d+"), F.regexp_extract(text, r"DAY\s*:\s*DAY\s*0*(\d+)", 1))
    return F.coalesce(*found, *dated(name), stated, *dated(text))


#: Fixed value: slates (and commas) from which a camera report has been typed.
TYPED_ROWS = 2


def is_handwritten(content: Column) -> Column:
    """A camera report that is ink: it says camera report or roll, has no tab, under two commas,
    and under two different slates beside its dates."""
    text = F.upper(F.coalesce(content, F.lit("")))
    undated = F.regexp_replace(text, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", " ")
    slates = F.size(F.array_distinct(F.regexp_extract_all(undated, F.lit(r"\b\d{1,3}[A-Z]?/\d{1,3}[A-Z]?\b"), F.lit(0))))
    report = F.contains(text, F.lit("CAMERA REPORT")) | F.contains(text, F.lit("ROLL"))
    return report & ~F.contains(text, F.lit("\t")) & (F.regexp_count(text, F.lit(",")) < TYPED_ROWS) & (slates < TYPED_ROWS)


def routed(docs: DataFrame) -> DataFrame:
    return classified(docs).withColumn("topic", F.concat(F.lit("production.raw."), "department"))


# ---- delimited reports

#: A column by one of these names makes a row a header.
HEADER_MARKS = {"SCENE", "SLATE", "FILE NAME", "FILENAME", "TAKE", "START TC"}


def _cells(text: str) -> Iterator[dict[str, str]]:
    """Data rows of Avid column/data blocks, or of CSV below the first row that looks like a header.

    Rows are read as they are asked for; none is held.
    """
    lines = text.splitlines()
    at = lambda mark: next((i + 1 for i, x in enumerate(lines) if x.strip().upper() == mark), None)
    facts = dict(x.replace('"', "").replace(",", "").split(":", 1) for x in lines[:40] if ":" in x.split(",")[0])
    facts = {f"#{k.strip().upper()}": v.strip() for k, v in facts.items() if k.strip() and v.strip()}
    names, first = at("COLUMN"), at("DATA")
    if names and first:
        head, body = lines[names].split("\t") if names < len(lines) else [], (lines[i].split("\t") for i in range(first, len(lines)))
    else:
        del lines
        body = csv.reader(io.StringIO(text.strip()))
        head = next((r for r in body if HEADER_MARKS & {c.strip().upper() for c in r}), [])
    names = [c.strip().upper() for c in head]
    for row in body:
        cells = {h: c.strip() for h, c in zip(names, row) if h and c.strip()}
        yield facts | cells if cells else {}


#: Rows that a reader of delimited text hands on at once.
READ_ROWS = 4096
_READ = pa.schema([*[(k, pa.string()) for k in KEYS], ("place", pa.int32()), ("cells", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


def _read(key: tuple, rows: list[tuple[int, dict[str, str]]], error: str | None = None) -> pa.RecordBatch:
    """Rows of one document, or the one row of a document that can't be read."""
    size = 1 if error else len(rows)
    if error:
        places, cells = pa.nulls(1, pa.int32()), pa.nulls(1, _READ.field("cells").type)
    else:
        ends, names, values = [0], [], []
        for _, c in rows:
            names += c.keys()
            values += c.values()
            ends.append(len(names))
        places, cells = pa.array([p for p, _ in rows], pa.int32()), pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
    return pa.RecordBatch.from_arrays([*[pa.array([k] * size, pa.string()) for k in key], places, cells, pa.array([error] * size, pa.string())], schema=_READ)


def _delimited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents are read twice: whether they can be read, then for their rows, READ_ROWS at a time,
    so that a task holds the text of a document and not its rows."""
    for b in batches:
        for i in range(b.num_rows):
            key, text = tuple(b.column(k)[i].as_py() for k in KEYS), b.column("content")[i].as_py() or ""
            try:
                deque(_cells(text), maxlen=0)
            except Exception as error:  # of this document; the others are read
                yield _read(key, [], message(error))
                continue
            stated = ((place, cells) for place, cells in enumerate(_cells(text)) if cells)
            while rows := list(islice(stated, READ_ROWS)):
                yield _read(key, rows)


def delimited_rows(docs: DataFrame) -> DataFrame:
    """Every data row of a delimited report as a map from header to cell; what the lines above
    the table state of the whole report stands under `#` and its name. A report that can't be
    read is one row with its error."""
    text = docs.select(*[F.col(k).cast("string").alias(k) for k in KEYS], F.col("content").cast("string").alias("content"))
    return text.mapInArrow(_delimited, "production_id string, shoot_day string, doc_id string, filename string, place int, cells map<string,string>, error string")


def has_table() -> Column:
    """Whether a document's content has a line that delimited_rows takes for the head of a table."""
    marks = "|".join(sorted(HEADER_MARKS))
    text = F.coalesce("content", F.lit(""))
    return text.rlike(rf'(?im)(?:^|,)[ "]*(?:{marks})[ "]*\r?(?:,|$)') | text.rlike(r"(?ims)^\s*column\s*$.*^\s*data\s*$")


def has_clip_elements() -> Column:
    """Whether a document's content has an element of a clip, so that it is read as XML."""
    return F.contains(F.coalesce("content", F.lit("")), F.lit("<Clip"))


def _field(names: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at("cells", F.lit(x)) for x in names])


def parse_camera_csv(docs: DataFrame) -> DataFrame:
    rows = delimited_rows(docs).select(*KEYS, "place", "error", *[_field(v).alias(k) for k, v in CAMERA_FIELDS.items()]).filter(kept(n.is_take_label(F.col("slate"))))
    rows = rows.withColumn("t", n.take(F.col("take")))
    t = F.col("t")
    return rows.select(*KEYS, "place", n.slate(F.col("slate")).alias("slate"), t["take_id"].alias("take_id"), n.camera_roll(F.col("roll")).alias("camera_roll"), "clip_name", "timecode_in", "timecode_out", F.coalesce(F.col("fps").try_cast("double"), F.lit(24.0)).alias("fps"), "lens", F.col("iso").try_cast("int").alias("iso"), "shutter", t["starred"].alias("starred"), t["pickup"].alias("pickup"), t["vfx"].alias("vfx"), t["note"].alias("note"), "error")


def parse_sound_log(docs: DataFrame) -> DataFrame:
    """Sound rows; slates and takes that are missing come from the file name.

    Tracks in columns of their own (`TRK 1`, `TRACK 1`, `CH 1`) stand before a tracks column.
    """
    rows = delimited_rows(docs).select(*KEYS, "place", "cells", "error", *[_field(v).alias(k) for k, v in SOUND_FIELDS.items()])
    each = F.map_filter("cells", lambda k, v: k.rlike("^(?:TRK|TRACK|CH) "))
    listed = F.array_sort(F.transform(F.map_entries(each), lambda e: F.concat(F.initcap(e["key"]), F.lit(": "), e["value"])))
    tracks = F.coalesce(F.nullif(F.array_join(listed, ", "), F.lit("")), "tracks")
    plain, wild = r"(?i)^([A-Z0-9+]+)-([A-Z0-9]+?)T?(\d+)\.WAV$", r"(?i)^(.+?)WTT?(\d+)\.WAV$"
    name = F.coalesce("file_name", F.lit(""))
    named = F.when(name.rlike(wild), F.concat(F.regexp_extract(name, wild, 1), F.lit("/WT"))).when(name.rlike(plain), F.concat_ws("/", F.regexp_extract(name, plain, 1), F.regexp_extract(name, plain, 2)))
    take = F.coalesce("take", F.when(name.rlike(wild), F.regexp_extract(name, wild, 2)).when(name.rlike(plain), F.regexp_extract(name, plain, 3)))
    is_wild = F.upper(F.concat_ws(" ", "slate", "file_name")).rlike("WT|WILD")
    rows = settled(rows, normal=F.coalesce(n.slate(n.clip_stem(F.col("slate"))), F.upper(named)), is_wild=is_wild, t=n.take(take))
    normal, is_wild = F.col("normal"), F.col("is_wild")
    slate = F.when(is_wild & ~normal.contains("/") & (normal != "WT"), F.concat(normal, F.lit("/WT"))).otherwise(normal)
    t = F.col("t")
    return settled(rows, norm=slate).filter(kept(n.is_take_label(F.col("norm")))).select(*KEYS, "place", F.col("norm").alias("slate"), t["take_id"].alias("take_id"), n.sound_roll(F.col("roll")).alias("sound_roll"), "file_name", "timecode_in", "timecode_out", "duration", tracks.alias("tracks"), _field(["#SAMPLE RATE"]).alias("sample_rate"), _field(["#BIT DEPTH"]).alias("bit_depth"), (is_wild | t["wild"]).alias("wild"), t["starred"].alias("starred"), F.coalesce("note", t["note"]).alias("note"), "error")


# ---- offloads

_CLIP = "FileName string, Reel string, Bytes string, Hash struct<_VALUE:string,_type:string>, DurationFrames string"


def parse_media_xml(docs: DataFrame) -> DataFrame:
    """Clips of an XML offload report; text that is no XML gives no rows."""
    volume = f"array<struct<_name:string,Clip:array<struct<{_CLIP.replace(' string', ':string').replace('Hash struct', 'Hash:struct')}>>>>"
    doc = F.from_xml("content", f"Volume {volume}, Volumes struct<Volume:{volume}>", {"mode": "PERMISSIVE"})
    volumes = docs.select(*KEYS, doc.alias("x")).select(*KEYS, F.explode(F.concat(F.coalesce("x.Volume", F.array().cast(volume)), F.coalesce("x.Volumes.Volume", F.array().cast(volume)))).alias("v"))
    clips = volumes.select(*KEYS, F.col("v._name").alias("volume"), F.explode("v.Clip").alias("c")).filter("trim(c.FileName) <> ''")
    return clips.select(*KEYS, "volume", F.trim("c.FileName").alias("file_name"), n.camera_roll(F.col("c.Reel")).alias("camera_roll"), F.coalesce(F.trim("c.Bytes").try_cast("bigint"), F.lit(0)).alias("size_bytes"), F.trim("c.Hash._VALUE").alias("checksum"), F.when(F.col("c.Hash").isNotNull(), F.coalesce("c.Hash._type", F.lit("MD5"))).alias("checksum_type"), F.col("c.DurationFrames").try_cast("bigint").alias("duration_frames"))


def thumbnail_blocks() -> Column:
    """A document's content cut before every line that begins with `Name`; the first cut has none."""
    return F.split(F.concat(F.lit("\n"), F.regexp_replace(F.coalesce("content", F.lit("")), r"\r\n", "\n")), r"\n(?=Name\s+\S)")


def parse_thumbnail_report(docs: DataFrame) -> DataFrame:
    """Blocks that begin with `Name`, a labelled value on each line."""
    labels = {"file_name": "Name", "reel": "Reel/Tape", "scene": "Scene", "shot": "Shot", "take": "Take", "fps": "Sensor FPS", "duration": "Duration"}
    blocks = docs.select(*KEYS, F.posexplode(thumbnail_blocks()).alias("block", "text")).filter("block > 0")
    blocks = blocks.select(*KEYS, "block", *[F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^{p}[ \t]+(.*)$", 1)), F.lit("")).alias(k) for k, p in labels.items()]).filter(n.is_clip_name(F.col("file_name")))
    kind = F.when(F.lower("file_name").endswith(".wav"), "sound").otherwise("camera")
    return blocks.select(*KEYS, "block", "file_name", n.camera_roll(F.col("reel")).alias("camera_roll"), n.slate(F.concat_ws("/", "scene", "shot")).alias("slate"), n.take(F.col("take"))["take_id"].alias("take_id"), kind.alias("card_type"), F.col("fps").try_cast("double").alias("fps"), "duration")


# ---- script and office

def _labelled(text: Column, label: str) -> Column:
    """What follows a label, up to the next label or the line's end; null where it is absent.

    Labels may hold letters with accents, which count as letters here.
    """
    labels = [*SCENE_LABELS.values(), *TIME_LABELS.values(), *OTHER_LABELS]
    stop = "|".join(labels)
    pattern = rf"(?iU){label}\s*:(.*?)(?=(?:{stop})\s*:|\n|$)"
    return F.when(text.rlike(rf"(?iU){label}\s*:"), F.trim(F.regexp_extract(text, pattern, 1)))


#: The head of the table of scene timings, its rows, and a scene's range of slates.
TIMINGS, TIMED = r"(?i)individual\s+scene\s+timings", r"^(\d+[A-Za-z]*)\s+(\S+)\s+(\S+)\s+(\S+)"
RANGE = r"^(\d+[A-Za-z]*)\s*/\s*(\w+)\s*(?:[-–—\x{FFFD}]\s*(\w+))?$"


def scene_timing_rows() -> Column:
    """A document's table of scene timings: array of (scene, read, shoot, difference), in its order."""
    lines = F.transform(F.split(F.coalesce("content", F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    head = F.array_position(F.transform(lines, lambda x: x.rlike(TIMINGS)), True)
    below = F.filter(lines, lambda x, i: (head > 0) & (i >= head) & x.rlike(TIMED))
    return F.transform(below, lambda x: F.struct(*[F.regexp_extract(x, TIMED, i).alias(c) for i, c in enumerate(("scene", "read", "shoot", "difference"), 1)]))


def parse_daily_report(docs: DataFrame) -> DataFrame:
    """A day as the office states it: scene lists, times, set-ups, pages, cards, slate ranges, timings.

    A range without an end is one slate. A document without a scene list, a time or a range is no
    daily report and gives no row.
    """
    text = F.col("content")
    parts = lambda label: F.transform(F.split(_labelled(text, label), "[,;]"), lambda x: F.trim(x))
    scene = lambda raw: F.struct(F.regexp_extract(raw, r"^(\d+)", 1).alias("scene"), raw.alias("raw"))
    lists = {k: F.transform(F.filter(parts(v), lambda x: x.rlike(r"^\d+[A-Za-z]*$")), scene) for k, v in SCENE_LABELS.items()}
    times = F.map_filter(F.create_map(*[x for k, p in TIME_LABELS.items() for x in (F.lit(k), F.nullif(F.regexp_extract(F.coalesce(_labelled(text, p), F.lit("")), r"(\d{1,2}:\d{2})", 1), F.lit("")))]), lambda k, v: v.isNotNull())
    end = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, RANGE, 3), F.lit("")), F.regexp_extract(x, RANGE, 2)).try_cast("int")
    span = lambda x: F.struct(F.regexp_extract(x, RANGE, 1).alias("scene"), F.regexp_extract(x, RANGE, 2).try_cast("int").alias("first"), end(x).alias("last"))
    ranges = F.transform(F.filter(F.coalesce(parts("Slates"), F.array().cast("array<string>")), lambda x: x.rlike(RANGE)), span)
    stated = F.filter(F.array(*[F.when(_labelled(text, v).isNotNull(), F.lit(k)) for k, v in SCENE_LABELS.items()]), lambda x: x.isNotNull())
    out = docs.select(
        *KEYS, *[c.alias(k) for k, c in lists.items()], times.alias("times"), F.regexp_extract(F.coalesce(_labelled(text, r"Set-?Ups"), F.lit("")), r"(\d+)", 1).try_cast("int").alias("set_ups"),
        F.nullif(_labelled(text, r"Total\s+P\w*ginas"), F.lit("")).alias("pages"), _labelled(text, r"Camera\s+Cards").alias("camera_cards"), _labelled(text, r"Sound\s+Cards").alias("sound_cards"),
        ranges.alias("slate_ranges"), scene_timing_rows().alias("scene_timings"), stated.alias("fields_present"),
    )
    return out.filter((F.size("fields_present") > 0) | (F.size("times") > 0) | (F.size("slate_ranges") > 0))


def screenplay_id(text: Column) -> Column:
    return F.substring(F.sha2(F.rtrim(text).cast("binary"), 256), 1, 16)


HEADING = r"^\s*(?:(\d+[A-Z]?)[.\s]+)?(INT\./EXT\.|INT/EXT|I/E|INT|EXT)[.\s]+(.+?)(?:\s+-\s+([^-]+?))?\s*$"


def _is_cue(line: Column, above: Column, ahead: Column) -> Column:
    """A line in capitals that names a speaker: below a blank line, above one that isn't."""
    text = F.trim(line)
    capitals = (text == F.upper(text)) & text.rlike(r"^[A-Z][A-Z .'\-]+(?:\s*\([^)]*\))?$")
    return ~line.rlike(HEADING) & capitals & F.coalesce(F.trim(above) == "", F.lit(True)) & (F.trim(ahead) != "") & ~n.is_transition(line)


#: What a title block may say besides its title, and what a reader is warned of.
TITLED, AUTHORED = r"(?i)^title:\s*(.*)$", r"(?i)^(?:authors?|written by|credit):\s*(.*)$"
CREDITED, OTHER_KEYS = r"(?i)^(?:written by|screenplay by|story by|by )\s*(.*)$", r"(?i)^(?:draft|date|contact|copyright|source|notes|revision):"
WARNINGS = {
    "headings": "No INT./EXT. scene headings found; the whole file was treated as a single scene.",
    "title": "Could not identify a title in the text; used the file name instead.",
    "cues": "No character cues were detected. Character names should sit on their own line in capitals, above their dialogue.",
    "scenes": "No scenes could be extracted from this file.",
}


def screenplay_heads(docs: DataFrame) -> DataFrame:
    """(KEYS, script_id, title, author, headings, warnings): what each screenplay says of itself.

    The title block is what stands before the first heading, or the first paragraph where there is
    none. A labelled title or author counts before a plain one: the first line that says nothing
    else, a credit. Without a title the file's name stands for it.
    """
    lines = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", ""), r"\r?\n")
    first = lambda x, test: F.array_position(F.transform(x, test), True)
    rows = docs.select(*KEYS, "content", lines.alias("lines")).select("*", first("lines", lambda x: x.rlike(HEADING)).alias("head"), first("lines", lambda x: F.trim(x) == "").alias("blank"))
    block = F.slice("lines", F.lit(1), F.greatest(F.when(F.col("head") > 0, F.col("head")).otherwise(F.col("blank")) - 1, F.lit(0)).cast("int"))
    said = F.filter(F.transform(block, lambda x: F.regexp_replace(x, r"^[#*_>\s]+|[*_\s]+$", "")), lambda x: x != "")
    rows = rows.withColumn("said", said)
    credit = F.get(F.filter(F.transform(F.filter("said", lambda x: x.rlike(CREDITED) & ~x.rlike(AUTHORED)), lambda x: F.trim(F.regexp_extract(x, CREDITED, 1))), lambda x: x != ""), F.lit(0))
    plain = F.get(F.filter("said", lambda x: ~x.rlike(TITLED) & ~x.rlike(AUTHORED) & ~x.rlike(CREDITED) & ~x.rlike(OTHER_KEYS)), F.lit(0))
    labelled = lambda p: F.try_element_at(F.filter(F.transform(F.filter("said", lambda x: x.rlike(p)), lambda x: F.trim(F.regexp_extract(x, p, 1))), lambda x: x != ""), F.lit(-1))
    title, author = F.coalesce(labelled(TITLED), plain), F.coalesce(labelled(AUTHORED), credit)
    after = F.transform("lines", lambda x, i: (i >= F.size(block)) & _is_cue(x, F.get("lines", i - 1), F.coalesce(F.get("lines", i + 1), F.lit(""))))
    body = F.exists("lines", lambda x: F.trim(x) != "")
    warned = [
        F.when(F.col("head") == 0, WARNINGS["headings"]), F.when(F.col("title").isNull() & (F.size(block) > 0), WARNINGS["title"]),
        F.when(~F.exists(after, lambda x: x), WARNINGS["cues"]), F.when(~body, WARNINGS["scenes"]),
    ]
    rows = rows.select("*", title.alias("title"), author.alias("author"))
    return rows.select(*KEYS, screenplay_id(F.coalesce("content", F.lit(""))).alias("script_id"), F.coalesce("title", "filename").alias("title"), "author", F.size(F.filter("lines", lambda x: x.rlike(HEADING))).alias("headings"), F.array_compact(F.array(*warned)).alias("warnings"))


def parse_screenplay(docs: DataFrame) -> DataFrame:
    """Lines of dialogue and action with their scene: number, place, time of day, speaker.

    A cue is a line in capitals between a blank line and a spoken one; scenes without a number
    are numbered in order; what stands before the first heading is the title block.
    """
    text = F.trim("line")
    rows = lines_of(docs, near=1).withColumn("heading", F.col("line").rlike(HEADING))
    rows = rows.withColumn("cue", _is_cue(F.col("line"), F.col("above"), F.col("ahead"))).select("*", (F.col("heading") | (text == "") | F.col("cue")).alias("part"), F.when(F.col("cue"), n.character_name(F.col("line"))).alias("speaker"), F.when(F.col("heading"), F.col("line")).alias("head")).drop("above", "ahead")

    def fold(t: Lines) -> None:
        t["scene_index"], t["block"] = t.count(t["heading"]), t.count(t["part"])
        t["speaker"], t["head"] = t.last(t["speaker"], "block"), t.last(t["head"])

    rows = folded(rows, "scene_index int, block int", fold, passing=True).filter(kept((F.col("scene_index") > 0) & (F.trim("line") != "") & ~F.col("cue") & ~F.col("heading")))
    kind = F.when(F.col("speaker").isNull(), "action").when(F.trim("line").rlike(r"^\(.*\)$"), "parenthetical").otherwise("dialogue")
    number = F.coalesce(F.nullif(F.regexp_extract("head", HEADING, 1), F.lit("")), F.col("scene_index").cast("string"))
    return rows.select(*KEYS, "scene_index", number.alias("scene"), F.regexp_extract("head", HEADING, 2).alias("setting"), F.trim(F.regexp_extract("head", HEADING, 3)).alias("location"), F.trim(F.regexp_extract("head", HEADING, 4)).alias("time_of_day"), "place", kind.alias("kind"), "speaker", F.trim("line").alias("line"), "error")
