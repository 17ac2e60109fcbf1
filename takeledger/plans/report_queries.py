"""Queries over report texts: documents are written from the witness rows, so that the rows
themselves are what the parsers have to read back.

Each query groups rows into the documents that a department would hand in, in the printed layout of
the report, and parses them; its SQL reads the rows alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.sources import ingest, paperwork, reports, versions
from takeledger.sources.adapters import cte, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DOCUMENT = ["production_id", "shoot_day", "doc_id"]


def drafted(rows: DataFrame, order: list[str], line: str, head: str = "", name: str = "report.txt", keys: list[str] = DOCUMENT) -> DataFrame:
    """Documents of rows: a head, then for each row, by `order`, the lines that `line` says of it.

    line: SQL over x, the row, and before, the row above it (null above the first).
    """
    columns = [*order, *[c for c in rows.columns if c not in (*keys, *order) and re.search(rf"\b(?:x|before)\.{c}\b", line)]]
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    said = F.expr(f"transform(rows, (x, i) -> transform(array(named_struct('x', x, 'before', get(rows, i - 1))), p -> {re.sub(r"\b(x|before)\b(?!')", r"p.\1", line)})[0])")
    made = listed.select(*keys, F.lit(name).alias("filename"), F.concat(F.lit(head), F.array_join(said, "\n"), F.lit("\n")).alias("content"))
    for c in DOCUMENT:
        made = made if c in keys else made.withColumn(c, F.lit("1"))
    return made.select(*DOCUMENT, "filename", "content")


def handed_in(docs: DataFrame) -> DataFrame:
    """Documents stored, so that parsers read them as they would any: a text is made once, however
    many layouts are told apart, and no task holds rows and what is read of them together."""
    return versions.stored(docs, "documents")


def written(*said, **also) -> DataFrame:
    """Drafted documents, handed in."""
    return handed_in(drafted(*said, **also))


def reads(name: str, tables: str, job: Callable[..., DataFrame], sql: str) -> None:
    names = tables.split()
    QUERIES[name] = lambda spark, d: job(*[frame(spark, d, t) for t in names])
    ORACLES[name] = cte(*names).rstrip() + (", " + sql.lstrip()[len("WITH "):] if sql.lstrip().startswith("WITH ") else " " + sql)


def _filed(witness: DataFrame, department: str) -> DataFrame:
    return witness.filter(F.col("department") == department).select(*DOCUMENT, "seq", "slate", "raw_take", "raw_roll", "camera_roll", "sound_roll", "clip_name", "timecode_in", "note")


# ---- delimited reports

_TAKE_ID = "regexp_extract(raw_take, '^T?0*([0-9]+)', 1) || CASE WHEN contains(raw_take, 'PK') THEN 'PK' ELSE '' END"
_CAMERA_LINE = "concat_ws(',', x.slate, x.raw_take, x.raw_roll, x.clip_name, x.timecode_in, '', '\"50mm, prime\"', '25', '800', '172.8')"
_CAMERA_HEAD = "Camera Report\nSCENE,TAKE,CAMERA ROLL,CLIP NAME,START TC,END TC,LENS,FPS,ISO,SHUTTER\n"


def _camera_csv(w: DataFrame) -> DataFrame:
    return paperwork.parse_camera_csv(written(_filed(w, "camera"), ["seq"], _CAMERA_LINE, _CAMERA_HEAD)).select(*DOCUMENT, "slate", "take_id", "camera_roll", "clip_name", "timecode_in", "lens", "fps", "iso", "starred", "pickup", "vfx", "error")


reads("parse_camera_csv", "witness", _camera_csv, f"""
SELECT production_id, shoot_day, doc_id, replace(slate, '-', '/') AS slate, {_TAKE_ID} AS take_id, camera_roll, clip_name, timecode_in, '50mm, prime' AS lens, 25.0::DOUBLE AS fps, 800 AS iso,
  contains(raw_take, '*') AS starred, contains(raw_take, 'PK') AS pickup, contains(raw_take, 'VFX') AS vfx, CAST(NULL AS VARCHAR) AS error FROM witness WHERE department = 'camera'""")

_SOUND_LINE = r"concat_ws('\t', regexp_replace(x.slate, '/', '-') || 'T0' || regexp_extract(x.raw_take, '([0-9]+)', 1) || '.WAV', '2', x.timecode_in, x.slate, x.raw_take, x.sound_roll)"


def _sound_log(w: DataFrame) -> DataFrame:
    head = "Heading\nFIELD_DELIM\tTABS\nSample Rate: 48000\n\nColumn\nFile Name\tTracks\tStart\tScene\tTake\tSound Roll\n\nData\n"
    return paperwork.parse_sound_log(written(_filed(w, "sound"), ["seq"], _SOUND_LINE, head, "day.ALE")).select(*DOCUMENT, "slate", "take_id", "sound_roll", "file_name", "timecode_in", "tracks", "sample_rate", "wild", "starred", "error")


reads("parse_sound_log", "witness", _sound_log, f"""
SELECT production_id, shoot_day, doc_id, replace(slate, '-', '/') AS slate, {_TAKE_ID} AS take_id, sound_roll, replace(slate, '/', '-') || 'T0' || regexp_extract(raw_take, '([0-9]+)', 1) || '.WAV' AS file_name,
  timecode_in, '2' AS tracks, '48000' AS sample_rate, false AS wild, contains(raw_take, '*') AS starred, CAST(NULL AS VARCHAR) AS error FROM witness WHERE department = 'sound'""")

# ---- printed layouts: rolls and setups are stated once, takes inherit them

_MARK = "regexp_extract({0}.raw_take, '([0-9]+)', 1) || CASE WHEN contains({0}.raw_take, '*') THEN '*' ELSE '' END"
_SLASHED = "regexp_replace({0}.slate, '-', '/')"
_LOG_LINE = f"""concat(CASE WHEN before IS NULL OR before.camera_roll <> x.camera_roll THEN concat('ROLL', x.camera_roll, ' MAGAZINE #7', chr(10)) ELSE '' END,
  CASE WHEN before IS NULL OR before.camera_roll <> x.camera_roll OR before.slate <> x.slate THEN concat({_SLASHED.format('x')}, ' Lens(', substr(x.slate, 1, 2), 'mm) ISO400', chr(10)) ELSE '' END,
  {_MARK.format('x')}, ' ', right(x.clip_name, 3))"""


def _camera_log(w: DataFrame) -> DataFrame:
    docs = written(_filed(w, "camera"), ["camera_roll", "slate", "seq"], _LOG_LINE, "Camera Report\n")
    return reports.parse_camera_log(docs).select(*DOCUMENT, "slate", "take_id", "camera_roll", "clip_name", "lens", "iso", "magazine", "starred", "error")


_DIGITS = "regexp_extract(raw_take, '([0-9]+)', 1)"
#: A take is digits here, without leading zeros.
_NUMBER = f"CAST(CAST({_DIGITS} AS INT) AS VARCHAR)"
reads("parse_camera_log", "witness", _camera_log, f"""
SELECT production_id, shoot_day, doc_id, replace(slate, '-', '/') AS slate, {_NUMBER} AS take_id, camera_roll, clip_name, replace(substr(slate, 1, 2), '-', '/') || 'mm' AS lens, 400 AS iso, '#7' AS magazine,
  contains(raw_take, '*') AS starred, CAST(NULL AS VARCHAR) AS error FROM witness WHERE department = 'camera'""".replace("replace(substr(slate, 1, 2), '-', '/')", "substr(slate, 1, 2)"))

_TC_LINE = f"""CASE WHEN x.seq % 2 = 0 THEN concat({_SLASHED.format('x')}, ' ', {_MARK.format('x')}, ' ', x.timecode_in, ' ', x.camera_roll, ' 280726 wide')
  ELSE concat({_SLASHED.format('x')}, ' ', {_MARK.format('x')}, ' ', x.timecode_in, chr(10), '23:00:00:00', chr(10), 'in the rain', chr(10), x.camera_roll, ' 310826') END"""


def _timecode_log(w: DataFrame) -> DataFrame:
    docs = written(_filed(w, "script"), ["seq"], _TC_LINE, "DAILY TIMECODE LOG\n")
    return reports.parse_script_log(docs).select(*DOCUMENT, "slate", "take_id", "camera_roll", "timecode_in", "timecode_out", "recording_date", "note", "starred", "error")


_STAR = "bool_or(contains(raw_take, '*')) OVER (PARTITION BY production_id, shoot_day, doc_id, replace(slate, '-', '/'), regexp_extract(raw_take, '([0-9]+)', 1)::INT) AS starred"
reads("parse_timecode_log", "witness", _timecode_log, f"""
SELECT production_id, shoot_day, doc_id, replace(slate, '-', '/') AS slate, {_NUMBER} AS take_id, camera_roll, timecode_in, CASE WHEN seq % 2 = 1 THEN '23:00:00:00' END AS timecode_out,
  CASE WHEN seq % 2 = 0 THEN '28/07/2026' ELSE '31/08/2026' END AS recording_date, CASE WHEN seq % 2 = 0 THEN camera_roll || ' 280726 wide' ELSE 'in the rain' END AS note, {_STAR}, CAST(NULL AS VARCHAR) AS error
FROM witness WHERE department = 'script'""")

_EDITOR_LINE = f"""concat(CASE WHEN before IS NULL OR before.slate <> x.slate THEN concat({_SLASHED.format('x')}, ' ') ELSE '' END, {_MARK.format('x')}, ' Scene(s): wide ', x.camera_roll, ' 280726 2:46')"""


def _editor_log(w: DataFrame) -> DataFrame:
    docs = written(_filed(w, "script"), ["slate", "seq"], _EDITOR_LINE, "DETAILED EDITOR'S LOG\nDate: 01/08/2026\n")
    return reports.parse_script_log(docs).select(*DOCUMENT, "slate", "take_id", "camera_roll", "recording_date", "note", "inherited", "starred", "error")


reads("parse_editor_log", "witness", _editor_log, f"""
SELECT production_id, shoot_day, doc_id, replace(slate, '-', '/') AS slate, {_NUMBER} AS take_id, camera_roll, '28/07/2026' AS recording_date, 'Scene(s): wide ' || camera_roll || ' 280726 2:46' AS note,
  false AS inherited, {_STAR}, CAST(NULL AS VARCHAR) AS error FROM witness WHERE department = 'script'""")

# ---- offloads

_FILES = "SELECT production_id, shoot_day, volume AS doc_id, file_name, checksum, size_bytes % 1000 + 1 AS kb, camera_roll FROM media"


def _media(m: DataFrame) -> DataFrame:
    return m.select("production_id", "shoot_day", F.col("volume").alias("doc_id"), "file_name", "checksum", (F.col("size_bytes") % 1000 + 1).alias("kb"), "camera_roll")


def _volume_report(m: DataFrame) -> DataFrame:
    docs = written(_media(m), ["file_name", "checksum", "kb"], "concat(x.file_name, chr(10), 'XXH64:', x.checksum, chr(10), CAST(x.kb AS STRING), ' KB')", "Volume Report\nprinted\nCARD 7\n")
    return reports.parse_offload_text(docs).select(*DOCUMENT, "file_name", "slate", "take_id", "size_bytes", "checksum", "volume", "card_type", "error")


reads("parse_volume_report", "media", _volume_report, f"""
WITH f AS ({_FILES}), s AS (SELECT *, ends_with(file_name, '.WAV') AS wav FROM f)
SELECT production_id, shoot_day, doc_id, file_name, CASE WHEN wav THEN replace(split_part(file_name, 'T', 1), '-', '/') END AS slate, CASE WHEN wav THEN CAST(CAST(regexp_extract(file_name, 'T([0-9]+)', 1) AS INT) AS VARCHAR) END AS take_id,
  CAST(kb * 1024 AS BIGINT) AS size_bytes, checksum, 'CARD 7' AS volume, CASE WHEN wav THEN 'sound' ELSE 'camera' END AS card_type, CAST(NULL AS VARCHAR) AS error FROM s""")


def _clips_report(m: DataFrame) -> DataFrame:
    sound = _media(m).filter("file_name like '%.WAV'")
    docs = written(sound, ["file_name", "checksum", "kb"], "concat(replace(x.file_name, '.WAV', ''), ' Sound Dev:Mix664 ', CAST(x.kb % 60 AS STRING), ':10 min')", "Clips Report\n")
    return reports.parse_offload_text(docs).select(*DOCUMENT, "file_name", "slate", "take_id", F.col("details")["duration"].alias("duration"), "checksum", "card_type")


reads("parse_clips_report", "media", _clips_report, f"""
WITH f AS ({_FILES})
SELECT production_id, shoot_day, doc_id, file_name, replace(split_part(file_name, 'T', 1), '-', '/') AS slate, CAST(CAST(regexp_extract(file_name, 'T([0-9]+)', 1) AS INT) AS VARCHAR) AS take_id,
  CAST(kb % 60 AS VARCHAR) || ':10 min' AS duration, 'VERIFIED' AS checksum, 'sound' AS card_type FROM f WHERE ends_with(file_name, '.WAV')""")


def _media_xml(m: DataFrame) -> DataFrame:
    line = "concat('<Clip><FileName>', x.file_name, '</FileName><Reel>', x.camera_roll, '</Reel><Bytes>', CAST(x.kb AS STRING), '</Bytes><Hash type=\"xxh\">', x.checksum, '</Hash></Clip>')"
    docs = written(_media(m), ["file_name", "checksum", "kb"], line, "<Report><Volume name='V'>").withColumn("content", F.concat("content", F.lit("</Volume></Report>")))
    return paperwork.parse_media_xml(docs).select(*DOCUMENT, "volume", "file_name", "camera_roll", "size_bytes", "checksum", "checksum_type")


reads("parse_media_xml", "media", _media_xml, f"""
WITH f AS ({_FILES}) SELECT production_id, shoot_day, doc_id, 'V' AS volume, file_name, nullif(camera_roll, '') AS camera_roll, CAST(kb AS BIGINT) AS size_bytes, checksum, 'xxh' AS checksum_type FROM f""")

# ---- office and script

_OFFICE = {"scheduled": "Scenes Scheduled", "complete": "Scenes Complete", "not_shot": "Scenes Scheduled Not Shot", "shot_not_scheduled": "Scenes Shot Not Scheduled"}


def _daily_report(scenes: DataFrame) -> DataFrame:
    state = scenes.select("production_id", "shoot_day", F.coalesce("state", "office_state").alias("state"), "scene").distinct()
    lists = state.groupBy("production_id", "shoot_day").agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == k, F.col("scene")))), ", ").alias(k) for k in _OFFICE], F.count("*").alias("n"))
    text = F.concat(F.lit("PARTE DE PRODUCCION\n"), *[F.concat(F.lit(f"{label}: "), k, F.lit("\n")) for k, label in _OFFICE.items()], F.lit("WRAP: 18:55\nSet-Ups: "), F.col("n").cast("string"), F.lit("\nSlates: 27/7 - 8\n"))
    docs = lists.select("production_id", "shoot_day", F.lit("D1").alias("doc_id"), F.lit("DPR.txt").alias("filename"), text.alias("content"))
    read = paperwork.parse_daily_report(docs)
    joined = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<struct<scene:string,raw:string>>")), lambda x: x["scene"]), ",")
    return read.select("production_id", "shoot_day", joined("scheduled").alias("scheduled"), joined("complete").alias("complete"), joined("scheduled_not_shot").alias("not_shot"), joined("shot_not_scheduled").alias("shot_not_scheduled"), "set_ups", F.col("times")["wrap"].alias("wrap"), F.col("slate_ranges")[0]["last"].alias("last_shot"))


_LISTED = "coalesce(string_agg(scene, ',' ORDER BY scene) FILTER (WHERE state = '{0}'), '') AS {0}"
reads("parse_daily_report", "scene_events", _daily_report, f"""
WITH s AS (SELECT DISTINCT production_id, shoot_day, coalesce(state, office_state) AS state, scene FROM scene_events)
SELECT production_id, shoot_day, {", ".join(_LISTED.format(k) for k in _OFFICE)}, CAST(count(*) AS INT) AS set_ups, '18:55' AS wrap, 8 AS last_shot FROM s GROUP BY ALL""")


def _timed_report(scenes: DataFrame) -> DataFrame:
    """One row a timed scene of daily reports that also state pages and slates with and without an end."""
    rows = scenes.select("production_id", "shoot_day", "scene").distinct()
    head = "Total Paginas: 3 2/8\nSlates: 27/7, 49/1 - 9, none\nIndividual Scene Timings\nScene Read Shoot Diff\n"
    read = paperwork.parse_daily_report(written(rows, ["scene"], "concat(x.scene, ' 1:10 1:', x.scene, ' +0:10')", head, "DPR.txt", ["production_id", "shoot_day"]))
    slates = F.array_join(F.transform("slate_ranges", lambda r: F.concat(r["scene"], F.lit("/"), r["first"].cast("string"), F.lit("-"), r["last"].cast("string"))), ",")
    return read.select("production_id", "shoot_day", "pages", slates.alias("slates"), F.inline("scene_timings"))


reads("daily_report_timings", "scene_events", _timed_report, """
WITH s AS (SELECT DISTINCT production_id, shoot_day, scene FROM scene_events)
SELECT production_id, shoot_day, '3 2/8' AS pages, '27/7-7,49/1-9' AS slates, scene, '1:10' AS read, '1:' || scene AS shoot, '+0:10' AS difference FROM s""")


def _screenplay(lines: DataFrame) -> DataFrame:
    """A conversation as a scene of its script: cues, some with a parenthetical, and one line each."""
    said = lines.select(F.lit("P").alias("production_id"), F.lit("1").alias("shoot_day"), F.col("script_id").alias("doc_id"), "scene", "place", "speaker", F.concat(F.lit("says "), F.trim(F.regexp_replace(F.coalesce("line", F.lit("")), r"\s+", " "))).alias("line"))
    line = """concat(CASE WHEN before IS NULL OR before.scene <> x.scene THEN concat('INT. ROOM ', CAST(x.scene AS STRING), ' - NIGHT', chr(10), chr(10), 'it is dark', chr(10)) ELSE '' END,
      chr(10), x.speaker, chr(10), CASE WHEN x.place % 3 = 1 THEN concat('(slowly)', chr(10)) ELSE '' END, x.line, chr(10))"""
    return paperwork.parse_screenplay(written(said, ["scene", "place"], line, "Title: A play\n\n")).select("doc_id", "setting", "location", "time_of_day", "kind", "speaker", "line", "error")


reads("parse_screenplay", "lines", _screenplay, r"""
WITH s AS (SELECT script_id AS doc_id, scene, place, speaker, rtrim('says ' || trim(regexp_replace(coalesce(line, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS line FROM lines),
x AS (SELECT doc_id, scene, 'dialogue' AS kind, speaker, line FROM s UNION ALL SELECT doc_id, scene, 'parenthetical', speaker, '(slowly)' FROM s WHERE place % 3 = 1
  UNION ALL SELECT DISTINCT doc_id, scene, 'action', NULL, 'it is dark' FROM s)
SELECT doc_id, 'INT' AS setting, 'ROOM ' || CAST(scene AS VARCHAR) AS location, 'NIGHT' AS time_of_day, kind, speaker, line, CAST(NULL AS VARCHAR) AS error FROM x""")

# ---- classifying and refusing

#: What a drop is called or says, and what that makes of it: type, department, axis, shown, by hand.
_NAMED = [
    ("SD031_CAM_A.csv", "camera_csv", "camera", "belief", "Camera Report", "false"), ("x_D07_FACING.pdf", "script_lined", "script", "belief", "Script Lined / Facing Pages (Handwritten Multimodal)", "true"),
    ("DetailedEditor#12.txt", "script_timecode", "script", "belief", "Script Supervisor Editor''s / Timecode Log", "false"), ("mix.ALE", "sound_ale", "sound", "belief", "Sound Report", "false"),
    ("day_offload.xml", "offload", "dit", "existence", "Silverstack DIT Offload Manifest", "false"), ("DPR.pdf", "dpr", "office", "intent", "Daily Production Report (Office DPR)", "false"),
    ("q.bin", "camera_csv", "camera", "belief", "Generic Paperwork Drop", "false"), ("demo_camera.txt", "camera_csv", "camera", "belief", "Camera Report", "false"),
]
_TOLD = [
    ("scene take clip of roll A120", "camera_csv", "camera", "belief", "Camera Report (handwritten)", "true"), ("Timecode Log of day: day 9", "script_timecode", "script", "belief", "Script Supervisor Editor''s / Timecode Log", "false"),
    ("B-WAV 48000", "sound_ale", "sound", "belief", "Sound Report", "false"), ("Pomfort Volume", "offload", "dit", "existence", "Silverstack DIT Offload Manifest", "false"),
    ("Parte de produccion", "dpr", "office", "intent", "Daily Production Report (Office DPR)", "false"), ("roll scene take clip 27/7, 27/8, 27/9", "camera_csv", "camera", "belief", "Camera Report", "false"),
    ("dear all", "camera_csv", "camera", "belief", "Generic Paperwork Drop", "false"),
]
_DAYS_NAMED = {"SD031_CAM_A.csv": "31", "x_D07_FACING.pdf": "7", "DetailedEditor#12.txt": "12"}


def _classified(w: DataFrame) -> DataFrame:
    nth = lambda values, i: F.element_at(F.lit([v[0] for v in values]), (F.col("seq") % len(values) + 1).cast("int")) if i else F.lit("")
    by_name = w.select("seq", nth(_NAMED, 1).alias("filename"), F.lit("").alias("content"))
    by_text = w.select("seq", F.lit("drop.txt").alias("filename"), nth(_TOLD, 1).alias("content"))
    found = paperwork.classified(by_name.union(by_text)).withColumn("day", paperwork.inferred_day(F.col("filename"), F.col("content")))
    return found.groupBy("doc_type", "department", "axis", "display_name", "is_multimodal", "inferred_production", "day").agg(F.count("*").alias("documents"))


def _expected(values: list[tuple], of: Callable[[str], str]) -> str:
    rows = ", ".join(f"({i}, '{t}', '{d}', '{a}', '{s}', {h}, {of(v)})" for i, (v, t, d, a, s, h) in enumerate(values))
    return f"SELECT * FROM witness JOIN (VALUES {rows}) e(i, doc_type, department_, axis_, display_name, is_multimodal, day) ON seq % {len(values)} = i"


reads("classify_documents", "witness", _classified, f"""
WITH e AS (SELECT doc_type, department_, axis_, display_name, is_multimodal, CASE WHEN i = 7 THEN 'DEMO_PRODUCTION' END AS inferred_production, day FROM ({_expected(_NAMED, lambda v: f"'{_DAYS_NAMED[v]}'" if v in _DAYS_NAMED else "CAST(NULL AS VARCHAR)")})
  UNION ALL SELECT doc_type, department_, axis_, display_name, is_multimodal, NULL, day FROM ({_expected(_TOLD, lambda v: "'9'" if "day 9" in v else "CAST(NULL AS VARCHAR)")}))
SELECT doc_type, department_ AS department, axis_ AS axis, display_name, is_multimodal, inferred_production, day, count(*) AS documents FROM e GROUP BY ALL""")


def _refusals(w: DataFrame) -> DataFrame:
    """Camera reports of which some are broken: a cell too long to read, no table, nothing, no production."""
    docs = drafted(_filed(w, "camera"), ["seq"], _CAMERA_LINE, _CAMERA_HEAD, "CAM_A.csv")
    text = F.when(F.col("doc_id") == "D7", F.concat("content", F.lit('"'), F.repeat(F.lit("x"), 140_000), F.lit('"\n'))).when(F.col("doc_id") == "D8", "camera").when(F.col("doc_id") == "D9", " ").otherwise(F.col("content"))
    docs = docs.select(F.when(F.col("doc_id") == "D10", " ").otherwise(F.col("production_id")).alias("production_id"), "shoot_day", F.concat_ws("/", "production_id", "shoot_day", "doc_id").alias("doc_id"), "filename", text.alias("content"))
    docs = handed_in(docs)
    return ingest.rejected(docs, ingest.parsed(docs)).groupBy("doc_type", "error_type", "reason").agg(F.count("*").alias("documents"))


reads("refused_documents", "witness", lambda w: _refusals(w), """
WITH d AS (SELECT DISTINCT production_id, shoot_day, doc_id FROM witness WHERE department = 'camera'),
r AS (SELECT * FROM (VALUES ('D7', 'SYSTEM_ERROR', 'Error: field larger than field limit (131072)'), ('D8', 'PARSER_FAILURE', 'no valid rows'), ('D9', 'PARSER_FAILURE', 'empty document')) v(doc_id, error_type, reason))
SELECT 'camera_csv' AS doc_type, error_type, reason, count(*) AS documents FROM d JOIN r USING (doc_id) GROUP BY ALL""")

# ---- cells and descriptions written by hand

_ANNOTATIONS = [("21/1:4", "21/1", "4"), ("5", None, "5"), ("a:b:3", "a:b", "3"), (":4", None, ":4"), ("21/1:", None, "21/1:"), (" 49WT : 2 ", "49WT", "2"), ("", None, "")]
_ROLLS = [("#B004 +1", "B004"), ("B 004", "B004"), ("b_12 mag2", "B12"), (" no card", "no card"), ("", ""), ("xA1", "xA1"), ("C12345", "C1234")]
_PRODUCTIONS = [(" night watch ", "NIGHT_WATCH"), ("Night-Watch", "NIGHT-WATCH"), ("the  big one!", "THE_BIG_ONE!"), (" ", None), ("a", "A")]
_SHOTS = [
    ("Extreme close-up, low angle", "ECU", "LOW_ANGLE", "STATIC"), ("macro of the lock; crane", "ECU", "EYE_LEVEL", "CRANE"), ("Medium close-up, handheld", "CU", "EYE_LEVEL", "HANDHELD"),
    ("MCU, bird view, dolly in", "MCU", "HIGH_ANGLE", "DOLLY_IN"), ("Over the shoulder, pull back", "OTS", "EYE_LEVEL", "DOLLY_OUT"), ("EWS of the security gate, glide", "EWS", "EYE_LEVEL", "SLIDER"),
    ("Wide shot, overhead, steadicam", "WS", "HIGH_ANGLE", "STEADICAM"), ("medium wide, canted, jib", "MWS", "DUTCH_ANGLE", "CRANE"), ("POV insert, dutch, crane", "POV", "DUTCH_ANGLE", "CRANE"),
    ("cutaway, tilt", "INSERT", "EYE_LEVEL", "PAN_TILT"), ("He waits.", "", "EYE_LEVEL", "STATIC"), ("A company of two", "", "EYE_LEVEL", "PAN_TILT"),
]


def _pick(column: str, values: list[tuple]) -> Column:
    return F.element_at(F.lit([v[0] for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def _values(values: list[tuple], columns: str) -> str:
    quoted = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join(f'({i}, ' + ', '.join(map(quoted, v[1:])) + ')' for i, v in enumerate(values))}) {columns}"


def _cells(w: DataFrame) -> DataFrame:
    split = n.split_slate_take(_pick("seq", _ANNOTATIONS))
    made = w.select(split["slate"].alias("slate"), split["take"].alias("take"), n.clean_roll_token(_pick("seq", _ROLLS)).alias("roll"), n.production_id(_pick("seq", _PRODUCTIONS)).alias("production"))
    return made.groupBy("slate", "take", "roll", "production").agg(F.count("*").alias("cells"))


reads("handwritten_cells", "witness", _cells, f"""
SELECT a.slate, a.take, r.roll, p.production, count(*) AS cells FROM witness w JOIN {_values(_ANNOTATIONS, 'a(i, slate, take)')} ON w.seq % 7 = a.i JOIN {_values(_ROLLS, 'r(j, roll)')} ON w.seq % 7 = r.j
JOIN {_values(_PRODUCTIONS, 'p(k, production)')} ON w.seq % 5 = p.k GROUP BY ALL""")


def _shot_sizes(w: DataFrame) -> DataFrame:
    made = w.select(n.shot_size(_pick("seq", _SHOTS), F.col("seq") % 5 == 0, F.col("seq") % 2 == 0).alias("s")).select("s.*")
    return made.groupBy("size", "angle", "movement").agg(F.count("*").alias("shots"))


reads("shot_sizes", "witness", _shot_sizes, f"""
SELECT CASE WHEN s.size <> '' THEN s.size WHEN seq % 2 = 0 AND seq % 5 <> 0 THEN 'WS' ELSE 'MS' END AS size, angle, movement, count(*) AS shots
FROM witness JOIN {_values(_SHOTS, 's(i, size, angle, movement)')} ON seq % {len(_SHOTS)} = i GROUP BY ALL""")

_CUES = [("CUT TO:", 1), ("> SMASH CUT TO:", 1), ("intercut", 1), ("FADE TO BLACK.", 1), ("WIPE TO:", 1), ("Cut to the chase", 0), ("**DISSOLVE TO**", 1), ("IRIS TO WHITE.", 1), ("WIPE TO", 0), ("fade in", 1), ("TOMORROW", 0), ("", 0)]


def _segments(lines: DataFrame) -> DataFrame:
    from takeledger.operators import script

    return script.shot_segments(lines.withColumn("line", _pick("nth", _CUES))).select("script_id", "scene", "place", "segment")


QUERIES["shot_segments"] = lambda spark, d: _segments(frame(spark, d, "lines").withColumn("nth", F.col("scene") * 5 + F.col("place")))
ORACLES["shot_segments"] = cte("lines") + f"""
SELECT script_id, scene, place, CAST(sum(c.cue) OVER (PARTITION BY script_id, scene ORDER BY place) AS BIGINT) AS segment
FROM lines JOIN (VALUES {", ".join(f"({i}, {c})" for i, (_, c) in enumerate(_CUES))}) c(i, cue) ON (scene * 5 + place) % {len(_CUES)} = c.i"""


def _backfill(w: DataFrame) -> DataFrame:
    """Logs of which some state a date, some have a claim already, and some state nothing."""
    from takeledger.operators import rollups

    docs = written(_filed(w, "script"), ["seq"], "x.slate")
    nth = F.substring("doc_id", 2, 9).cast("int")
    docs = docs.withColumn("filename", F.concat("doc_id", F.lit(".txt"))).withColumn("content", F.when(nth % 3 == 0, F.concat(F.lit("Date: 28/07/2026\n"), "content")).otherwise(F.regexp_replace("content", "[^A-Z]", " ")))
    docs = docs.select("production_id", F.concat_ws("/", *DOCUMENT).alias("doc_id"), "filename", "content", nth.alias("nth"))
    return rollups.backfill_summary(docs.drop("nth"), docs.filter("nth % 5 = 0").select("doc_id"))


reads("backfill_summary", "witness", _backfill, """
WITH d AS (SELECT DISTINCT production_id, shoot_day, doc_id, CAST(substr(doc_id, 2) AS INT) AS nth FROM witness WHERE department = 'script')
SELECT production_id, count(*) AS documents, count(*) FILTER (WHERE nth % 5 = 0) AS claimed, count(*) FILTER (WHERE nth % 5 <> 0 AND nth % 3 = 0) AS stated,
  count(*) FILTER (WHERE nth % 5 <> 0 AND nth % 3 <> 0) AS silent, coalesce(string_agg(doc_id || '.txt', ',' ORDER BY doc_id || '.txt') FILTER (WHERE nth % 5 <> 0 AND nth % 3 <> 0), '') AS silent_files
FROM d GROUP BY ALL""")


def _diagnosis(w: DataFrame, dates: DataFrame) -> DataFrame:
    from takeledger.operators import reconcile, rollups

    return rollups.take_diagnosis(w, reconcile.sound_roll_mismatches(w).unionByName(reconcile.date_disagreements(dates))).withColumn("evidence", F.sha2("evidence", 256))


reads("take_diagnosis", "witness shoot_dates", _diagnosis, """
WITH take AS (SELECT production_id, shoot_day, slate, take_id, sha256(string_agg(department || ' ' || camera_roll || ' ' || sound_roll || ' ' || timecode_in, '; ' ORDER BY seq, department || ' ' || camera_roll || ' ' || sound_roll || ' ' || timecode_in)) AS evidence FROM witness GROUP BY ALL),
s AS (SELECT DISTINCT production_id, shoot_day, slate, 'ROLL_MISMATCH ' || rolls AS f FROM (SELECT production_id, shoot_day, slate, take_id, string_agg(DISTINCT sound_roll, ',' ORDER BY sound_roll) AS rolls
  FROM witness WHERE sound_roll <> '' GROUP BY ALL HAVING count(DISTINCT sound_roll) > 1)),
d AS (SELECT production_id, shoot_day, 'SHOOT_DATE_DISAGREEMENT ' || string_agg(DISTINCT date, ',' ORDER BY date) AS f FROM shoot_dates GROUP BY ALL HAVING count(DISTINCT date) >= 2),
found AS (SELECT t.production_id, t.shoot_day, t.slate, t.take_id, f FROM take t JOIN s USING (production_id, shoot_day, slate) UNION SELECT t.production_id, t.shoot_day, t.slate, t.take_id, f FROM take t JOIN d USING (production_id, shoot_day))
SELECT take.*, coalesce(g.findings, '') AS findings FROM take LEFT JOIN (SELECT production_id, shoot_day, slate, take_id, string_agg(f, '; ' ORDER BY f) AS findings FROM found GROUP BY ALL) g USING (production_id, shoot_day, slate, take_id)""")

_HEADS = [("Title: The Play\\nAuthor: Ann\\n", "The Play", "Ann", 0), ("# **NIGHT**\\nDraft: 3\\nby Bo Li\\n", "NIGHT", "Bo Li", 0), ("", "file.txt", None, 0), ("Written by: Cy\\nStory by Di\\nLate title\\nTITLE: Last\\n", "Last", "Cy", 0), ("Date: now\\n", "file.txt", None, 1)]


def _heads(lines: DataFrame) -> DataFrame:
    said = lines.select(F.lit("P").alias("production_id"), F.lit("1").alias("shoot_day"), F.col("script_id").alias("doc_id"), "scene", "place", "speaker")
    docs = written(said, ["scene", "place"], "concat(CASE WHEN before IS NULL OR before.scene <> x.scene THEN concat('INT. ROOM - DAY', chr(10), chr(10)) ELSE '' END, CASE WHEN x.scene % 2 = 0 THEN x.speaker ELSE 'he' END, chr(10), 'speaks', chr(10))", name="file.txt")
    head = F.element_at(F.lit([h[0].replace("\\n", "\n") for h in _HEADS]), (F.col("doc_id").cast("int") % len(_HEADS) + 1).cast("int"))
    read = paperwork.screenplay_heads(docs.withColumn("content", F.concat(head, "content")))
    return read.select("doc_id", "title", "author", "headings", F.size(F.filter("warnings", lambda x: x.contains("title"))).alias("untitled"), F.size(F.filter("warnings", lambda x: x.contains("cues"))).alias("without_cues"))


reads("screenplay_heads", "lines", _heads, f"""
SELECT script_id AS doc_id, h.title, h.author, CAST(count(DISTINCT scene) AS INT) AS headings, max(h.untitled) AS untitled, CASE WHEN bool_or(scene % 2 = 0) THEN 0 ELSE 1 END AS without_cues
FROM lines JOIN (VALUES {", ".join(f"({i}, '{t}', {f"'{a}'" if a else 'CAST(NULL AS VARCHAR)'}, {u})" for i, (_, t, a, u) in enumerate(_HEADS))}) h(i, title, author, untitled) ON CAST(script_id AS INT) % {len(_HEADS)} = h.i GROUP BY ALL""")
