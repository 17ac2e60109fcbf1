"""Domain tables derived from the generated ones, by expressions that Spark and DuckDB both read.

`frame(spark, sf_dir, name)` is the DataFrame, `cte(name)` the same as SQL. {div} is integer
division, the only operator the two engines spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SCENE = "CAST(l_orderkey % 180 + 1 AS STRING)"
_TAKE = "CAST((l_orderkey {div} 180) % 9 + 1 AS STRING)"
_SLATE = f"{_SCENE} || CASE WHEN l_returnflag = 'N' THEN '-' ELSE '/' END || CAST(l_linenumber AS STRING)"
#: On every ninth day the effects unit files in place of the sound department.
_DEPARTMENT = "CASE l_partkey % 4 WHEN 0 THEN 'camera' WHEN 1 THEN CASE WHEN l_orderkey % 9 = 8 THEN 'vfx' ELSE 'sound' END WHEN 2 THEN 'script' ELSE 'dit' END"
_LETTER = "substr('ABC', CAST(l_suppkey % 3 + 1 AS INT), 1)"
_ROLL_NUMBER = "CAST((l_orderkey % 36) * 2 + CASE WHEN l_quantity > 47 THEN 1 ELSE 0 END AS STRING)"
_ROLL = f"CASE WHEN l_partkey % 4 = 1 THEN '' ELSE {_LETTER} || lpad({_ROLL_NUMBER}, 3, '0') END"
_CLIP = "CAST(l_linenumber * 10 + (l_orderkey {div} 180) % 9 + 1 AS STRING)"
_TIMECODE = "lpad(CAST(l_orderkey % 12 + 8 AS STRING), 2, '0') || ':' || lpad(CAST(l_linenumber * 7 AS STRING), 2, '0') || ':' || lpad(CAST((l_orderkey {div} 12) % 60 AS STRING), 2, '0') || ':' || lpad(CAST(CAST(l_quantity AS INT) % 24 AS STRING), 2, '0')"
_CLIP_FILE = f"{_LETTER} || '_' || lpad({_ROLL_NUMBER}, 4, '0') || 'C' || lpad({_CLIP}, 3, '0') || '_260728.mov'"
_SOUND_FILE = f"{_SCENE} || '-' || CAST(l_linenumber AS STRING) || 'T' || lpad({_TAKE}, 2, '0') || '.WAV'"
#: What a fifth of the volumes report of a file, beside a name that says nothing.
_REPORTED = "CASE WHEN l_suppkey % 5 = 1 THEN {} END"
_REQUIREMENT = "'R' || CAST(o_orderkey % 150 AS STRING)"
_KEY = "CAST(substr(props, 7, length(props) - 7) AS INT)"

#: name -> (table, filter, {column: expression})
TABLES: dict[str, tuple[str, str, dict[str, str]]] = {
    "witness": ("lineitem", "true", {
        "seq": "l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey",
        "production_id": "'P' || CAST(l_orderkey % 3 AS STRING)",
        "shoot_day": "CAST(l_orderkey % 36 + 1 AS STRING)",
        "axis": "CASE WHEN l_partkey % 4 = 3 THEN 'existence' ELSE 'belief' END",
        "department": _DEPARTMENT,
        "entity_type": "'take'",
        "doc_id": "'D' || CAST(l_suppkey % 50 AS STRING)",
        "scene": _SCENE,
        "slate": _SLATE,
        "take_id": _TAKE,
        "raw_take": f"CASE l_linenumber % 4 WHEN 0 THEN 'T0' || {_TAKE} WHEN 1 THEN {_TAKE} || '*' WHEN 2 THEN {_TAKE} || 'PK' ELSE {_TAKE} || ' VFX' END",
        "raw_roll": f"CASE WHEN l_partkey % 4 = 1 THEN '' WHEN l_linenumber % 2 = 0 THEN lower({_LETTER}) || '_0' || lpad({_ROLL_NUMBER}, 3, '0') || '_1EIC' ELSE {_ROLL} END",
        "camera_roll": _ROLL,
        "sound_roll": "CASE WHEN l_partkey % 4 = 1 THEN 'SR' || lpad(CAST(l_suppkey % 4 + 1 AS STRING), 2, '0') ELSE '' END",
        "starred": "CASE WHEN l_partkey % 4 = 2 THEN l_linestatus = 'F' END",
        "timecode_in": _TIMECODE,
        "clip_name": f"CASE WHEN l_partkey % 4 = 0 THEN {_ROLL} || '_C' || lpad({_CLIP}, 3, '0') ELSE '' END",
        "note": "CASE WHEN l_partkey % 4 = 2 AND l_suppkey % 3 > 0 THEN 'note ' || CAST(l_partkey % 13 AS STRING) ELSE '' END",
        "created_at": "l_shipdate",
        "payload_json": f"'{{{{\"slate\":\"' || {_SLATE} || '\",\"take_id\":\"' || {_TAKE} || '\",\"camera_roll\":\"' || {_ROLL} || '\"}}}}'",
    }),
    "media": ("lineitem", "l_partkey % 4 = 3 AND l_tax < 0.07", {
        "production_id": "'P' || CAST(l_orderkey % 3 AS STRING)",
        # every twelfth day is offloaded with the day before
        "shoot_day": "CAST(l_orderkey % 36 + 1 - CASE WHEN l_orderkey % 12 = 11 THEN 1 ELSE 0 END AS STRING)",
        "file_name": f"CASE l_suppkey % 5 WHEN 0 THEN {_SOUND_FILE} WHEN 1 THEN 'card' || CAST(l_partkey AS STRING) || '.mov' ELSE {_CLIP_FILE} END",
        "volume": "'V' || CAST(l_suppkey % 7 AS STRING)",
        "camera_roll": f"CASE WHEN l_suppkey % 5 > 0 THEN {_ROLL} ELSE '' END",
        "scene": _REPORTED.format(_SCENE),
        "shot": _REPORTED.format("CAST(CASE WHEN l_partkey % 8 = 3 THEN l_linenumber ELSE l_orderkey % 180 + 1 END AS STRING)"),
        "take_id": _REPORTED.format(f"lpad({_TAKE}, 2, '0')"),
        "size_bytes": "l_orderkey * 1000 + l_linenumber",
        "frames": "CAST(l_quantity AS BIGINT) * 24",
        "checksum": "'c' || CAST(l_partkey AS STRING)",
    }),
    "scene_events": ("lineitem", "l_linenumber = 1", {
        "production_id": "'P' || CAST(l_orderkey % 3 AS STRING)",
        "shoot_day": "CAST((l_orderkey + l_partkey % 2) % 36 + 1 AS STRING)",
        "axis": "CASE WHEN l_partkey % 5 < 2 THEN 'intent' ELSE 'belief' END",
        "scene": _SCENE,
        "state": "CASE WHEN l_partkey % 5 < 2 THEN 'scheduled' END",
        "office_state": "CASE l_partkey % 5 WHEN 2 THEN 'complete' WHEN 3 THEN 'not_shot' WHEN 4 THEN 'shot_not_scheduled' END",
    }),
    "slate_ranges": ("lineitem", "l_linenumber = 2", {
        "production_id": "'P' || CAST(l_orderkey % 3 AS STRING)",
        "shoot_day": "CAST(l_orderkey % 36 + 1 AS STRING)",
        "scene": _SCENE,
        "first": f"CASE WHEN l_partkey % 2 = 0 THEN {_SCENE} || '/1' ELSE '5' END",
        "last": "CASE WHEN l_partkey % 2 = 0 THEN '5' ELSE '1' END",
        "seq": "l_orderkey * 100000000 + l_partkey",
    }),
    "shoot_dates": ("lineitem", "true", {
        "production_id": "'P' || CAST(l_orderkey % 3 AS STRING)",
        "shoot_day": "CAST(l_orderkey % 36 + 1 AS STRING)",
        "department": _DEPARTMENT,
        "date": "CASE WHEN l_suppkey % 9 = 0 AND l_orderkey % 36 % 5 = 0 THEN '1995-02-0' || CAST(l_orderkey % 3 + 1 AS STRING) ELSE '1995-01-' || lpad(CAST(l_orderkey % 36 % 28 + 1 AS STRING), 2, '0') END",
        "created_at": "l_shipdate",
        "seq": "l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey",
    }),
    "wraps": ("lineitem", "l_linenumber = 4 AND l_orderkey % 36 < 30", {
        "production_id": "'P' || CAST(l_orderkey % 3 AS STRING)",
        "shoot_day": "CAST(l_orderkey % 36 + 1 AS STRING)",
        "wrap_time": "CASE WHEN l_suppkey % 5 = 0 THEN '02:30' ELSE '18:' || lpad(CAST(l_suppkey % 60 AS STRING), 2, '0') END",
        "created_at": "l_shipdate",
        "seq": "l_orderkey * 100000000 + l_partkey",
    }),
    "requirement_events": ("orders", "true", {
        "event_id": "o_orderkey",
        "requirement_id": _REQUIREMENT,
        "production_id": "'P' || CAST(o_orderkey % 150 % 3 AS STRING)",
        "action": "CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'updated' ELSE 'created' END",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'blocked' ELSE 'open' END",
        "priority": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'normal' ELSE 'low' END",
        "assignee": "'@c' || CAST(o_custkey % 22 AS STRING)",
        "resolved_by": "CASE WHEN o_orderstatus = 'F' THEN '@r' || CAST(o_custkey % 5 AS STRING) END",
        "target_type": "'scene'",
        "target_id": "CAST(o_orderkey % 150 + 1 AS STRING)",
        "shoot_day": "CAST(o_orderkey % 36 + 1 AS STRING)",
        "created_at": "o_orderdate",
    }),
    "tag_events": ("orders", "true", {
        "event_id": "o_orderkey",
        "production_id": "'P' || CAST(o_orderkey % 3 AS STRING)",
        "target_type": "CASE WHEN o_custkey % 2 = 0 THEN 'scene' ELSE 'shot' END",
        "target_id": "CAST(o_orderkey % 200 + 1 AS STRING)",
        "action": "CASE WHEN o_custkey % 11 = 0 THEN 'cleared' ELSE 'set' END",
        "status": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ready' WHEN '2' THEN 'in_progress' WHEN '3' THEN 'review' WHEN '4' THEN 'done' ELSE '' END",
        "needs": "CASE o_custkey % 3 WHEN 0 THEN 'sound,vfx' WHEN 1 THEN 'music' ELSE '' END",
        "descriptors": "CASE o_custkey % 7 WHEN 0 THEN 'establishment' WHEN 1 THEN 'night,establishment' ELSE '' END",
        "created_at": "o_orderdate",
    }),
    "user_activity": ("events", "true", {
        "event_id": "event_id",
        "production_id": f"'P' || CAST({_KEY} % 3 AS STRING)",
        "shoot_day": f"CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST({_KEY} % 36 + 1 AS STRING) END",
        "actor": "'@c' || CAST(user_id % 20 AS STRING)",
        "department": "CASE user_id % 4 WHEN 0 THEN 'camera' WHEN 1 THEN 'sound' WHEN 2 THEN 'script' ELSE 'dit' END",
        "action": "CASE event_type WHEN 'view' THEN 'viewed' WHEN 'click' THEN 'acknowledged' WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'resolved' ELSE 'updated' END",
        "target_type": "'requirement'",
        "target_id": f"'R' || CAST({_KEY} AS STRING)",
        "lag": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 60 END",
        "actor_source": "CASE WHEN event_id % 9 = 0 THEN 'default' ELSE 'header' END",
        "created_at": "ts",
    }),
    "findings": ("orders", "true", {
        "event_id": "o_orderkey",
        "production_id": "'P' || CAST(o_orderkey % 3 AS STRING)",
        "shoot_day": "CAST(o_orderkey % 36 + 1 AS STRING)",
        "finding": "CASE o_custkey % 3 WHEN 0 THEN 'ROLL_MISMATCH' WHEN 1 THEN 'TIMECODE_DRIFT' ELSE 'PAPERWORK_WITHOUT_MEDIA' END",
        "severity": "CASE o_custkey % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'CRITICAL' END",
        "entity_id": "CAST(o_orderkey % 120 + 1 AS STRING) || '/' || CAST(o_custkey % 4 AS STRING)",
        "roll": "substr('ABC', CAST(o_custkey % 3 + 1 AS INT), 1) || lpad(CAST(o_orderkey % 72 AS STRING), 3, '0')",
        "department": "CASE o_custkey % 4 WHEN 0 THEN 'camera' WHEN 1 THEN 'sound' WHEN 2 THEN 'script' ELSE 'dit' END",
        "doc_id": "'D' || CAST(o_custkey % 50 AS STRING)",
        "resolved": "o_orderstatus = 'F'",
        "description": "'order ' || CAST(o_orderkey AS STRING)",
        "created_at": "o_orderdate",
    }),
    "refusals": ("orders", "o_orderstatus = 'P'", {
        "doc_type": "CASE o_custkey % 3 WHEN 0 THEN 'camera_report' WHEN 1 THEN 'sound_log' ELSE 'offload_report' END",
        "error_type": "CASE WHEN o_orderkey % 2 = 0 THEN 'PARSER_FAILURE' ELSE 'VALIDATION_ERROR' END",
    }),
    # what is spoken, and what is done: the first word of a turn stands for a name
    "cues": ("conversations", "true", {
        "script_id": "CAST(conv_id % 10 AS STRING)",
        "scene": "conv_id",
        "place": "turn",
        "speaker": "upper(regexp_extract(text, '([A-Za-z]+)', 1))",
        "line": "text",
    }),
    "actions": ("conversations", "true", {
        "script_id": "CAST(conv_id % 10 AS STRING)",
        "scene": "conv_id",
        "place": "turn",
        "action": "text",
    }),
    # what is done, with speakers named in capitals here and there
    "deeds": ("conversations", "true", {
        "script_id": "CAST(conv_id % 10 AS STRING)",
        "scene": "conv_id + 1",
        "action": "CASE conv_id % 4 WHEN 0 THEN 'then ASSISTANT, alone, waits. CUT TO' WHEN 1 THEN 'THE USER ASSISTANT is no one' WHEN 2 THEN 'NOBODY comes to USER' ELSE 'the user waits' END",
    }),
    "lines": ("conversations", "true", {
        "script_id": "CAST(conv_id % 10 AS STRING)",
        "scene": "conv_id",
        "place": "turn",
        "speaker": "upper(role)",
        "line": "text",
    }),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, condition, columns = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(condition.format(div="div"))
    return rows.selectExpr(*[f"{e.format(div='div')} AS {c}" for c, e in columns.items()])


def cte(*names: str) -> str:
    """WITH clauses of the named tables, for the oracle."""
    parts = []
    for name in names:
        table, condition, columns = TABLES[name]
        listed = ", ".join(f"{e.format(div='//')} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {listed} FROM {table} WHERE {condition.format(div='//')})")
    return "WITH " + ", ".join(parts) + " "
