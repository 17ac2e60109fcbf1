"""The registered queries over the generated tables, each with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.functions import privacy
from takeledger.operators import analytics as a
from takeledger.operators import ledger, reconcile, rollups, script, status
from takeledger.plans import report_queries
from takeledger.sources import adapters, versions
from takeledger.sources.adapters import cte, frame
from takeledger.streaming import jobs as streaming

NOW, LATER = "2001-09-01 00:00:00", "2024-02-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str, job: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Registers job(*frames of the named adapter tables) as a query, and its oracle."""
    names = tables.split()
    QUERIES[name] = lambda spark, d: job(*[frame(spark, d, t) for t in names])
    if sql is not None:
        text, sql = cte(*names), sql.lstrip()
        # further WITH parts of the oracle follow the adapters'
        ORACLES[name] = text.rstrip() + sql[len("WITH"):].join((",", "")) if sql.startswith("WITH") else text + sql


def _set(c: str, when: str = "true") -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER (WHERE ({when}) AND {c} IS NOT NULL)), ','), '')"


#: The newest row of each finding and of each requirement, tag and take, for the oracles.
_FINDINGS = "WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY production_id, shoot_day, finding, entity_id ORDER BY created_at DESC, event_id DESC) AS rn FROM findings) WHERE rn = 1) "
_REQUIREMENTS = "WITH req AS (SELECT production_id, requirement_id, status, priority, assignee, action, raised_at, created_at AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY production_id, requirement_id ORDER BY created_at DESC, event_id DESC) AS rn, min(created_at) OVER (PARTITION BY production_id, requirement_id) AS raised_at FROM requirement_events) WHERE rn = 1), acked AS (SELECT DISTINCT target_id FROM user_activity WHERE action = 'acknowledged') "
_REQ_ONLY = _REQUIREMENTS[: _REQUIREMENTS.index(", acked AS")] + " "
_TAGS = "WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY production_id, target_type, target_id ORDER BY created_at DESC, event_id DESC) AS rn FROM tag_events) WHERE rn = 1) "
_REQ_TARGETS = "req AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY production_id, requirement_id ORDER BY created_at DESC, event_id DESC) AS rn FROM requirement_events) WHERE rn = 1)"
_DAYS = "production_id, shoot_day"
_RAISED = ", raised AS (SELECT production_id, requirement_id, shoot_day FROM (SELECT *, row_number() OVER (PARTITION BY production_id, requirement_id ORDER BY created_at, event_id) AS rn FROM requirement_events) WHERE rn = 1) "

# ---- aggregations

query("production_shape", "witness", a.production_shape, "SELECT production_id, axis, department, count(*) AS events, count(DISTINCT shoot_day) AS days FROM witness GROUP BY ALL")
query("department_arrivals", "witness", a.department_arrivals, f"SELECT {_DAYS}, department, count(*) AS events, min(created_at) AS first_filed, max(created_at) AS last_filed FROM witness GROUP BY ALL")
query("roll_disagreements", "witness", a.roll_disagreements, f"""WITH t AS (SELECT {_DAYS}, department, json_extract_string(payload_json, '$.slate') AS slate, json_extract_string(payload_json, '$.take_id') AS take_id, json_extract_string(payload_json, '$.camera_roll') AS roll FROM witness)
SELECT {_DAYS}, slate, take_id, substr(roll, 1, 1) AS camera, {_set('roll')} AS rolls, {_set('department')} AS witnesses FROM t WHERE roll <> '' GROUP BY {_DAYS}, slate, take_id, substr(roll, 1, 1) HAVING count(DISTINCT roll) > 1 AND count(DISTINCT department) > 1""")
query("scene_coverage", "witness", a.scene_coverage, f"""WITH t AS (SELECT * EXCLUDE (scene), split_part(slate, '/', 1) AS scene FROM witness)
SELECT production_id, scene, count(DISTINCT shoot_day) AS days, {_set('shoot_day')} AS shoot_days, count(DISTINCT slate) AS slates, count(*) AS takes, {_set('department')} AS departments FROM t WHERE regexp_matches(scene, '^[0-9]') GROUP BY ALL""")
query("discrepancy_health", "findings", a.discrepancy_health, _FINDINGS + f"SELECT production_id, finding, severity, count(*) FILTER (WHERE NOT resolved) AS open, count(*) FILTER (WHERE resolved) AS resolved, {_set('shoot_day', 'NOT resolved')} AS open_days, min(description) FILTER (WHERE NOT resolved) AS example FROM cur GROUP BY ALL")
query("editorial_state", "tag_events", a.editorial_state, _TAGS + "SELECT production_id, status, count(*) AS targets FROM cur WHERE action <> 'cleared' AND status <> '' GROUP BY ALL")
query("requirement_ageing", "requirement_events", lambda e: a.requirement_ageing(e, NOW), f"""WITH e AS (SELECT production_id, requirement_id, date_diff('hour', min(created_at), coalesce(max(created_at) FILTER (WHERE action = 'resolved'), TIMESTAMP '{NOW}')) AS hours, max(CASE WHEN status = 'blocked' THEN 1 ELSE 0 END) AS blocked FROM requirement_events GROUP BY ALL)
SELECT production_id, count(*) AS requirements, round(avg(hours), 1) AS avg_hours_open, CAST(max(hours) AS BIGINT) AS longest_hours_open, CAST(sum(blocked) AS BIGINT) AS ever_blocked FROM e GROUP BY ALL""")
_SYNC = f"""WITH w AS (SELECT {_DAYS}, arg_max(wrap_time, struct_pack(c := created_at, s := seq)) AS wrap_time FROM wraps GROUP BY ALL), d AS (SELECT {_DAYS}, arg_min(date, struct_pack(c := created_at, s := seq)) AS shoot_date FROM shoot_dates GROUP BY ALL), f AS (SELECT {_DAYS}, department, min(created_at) AS first_filed, count(*) AS events FROM witness GROUP BY ALL), j AS (SELECT * FROM f LEFT JOIN d USING ({_DAYS}) LEFT JOIN w USING ({_DAYS})) """
query("department_sync_lag", "witness shoot_dates wraps", a.department_sync_lag, _SYNC + f"SELECT {_DAYS}, department, first_filed, events, shoot_date, wrap_time FROM j")
query("sync_matrix", "witness shoot_dates wraps", a.sync_matrix, _SYNC + f""", m AS (SELECT *, try_cast(shoot_date AS TIMESTAMP) + to_hours(CAST(split_part(wrap_time, ':', 1) AS INT)) + to_minutes(CAST(split_part(wrap_time, ':', 2) AS INT)) + to_days(CASE WHEN CAST(split_part(wrap_time, ':', 1) AS INT) < 6 THEN 1 ELSE 0 END) AS wrapped_at FROM j), g AS (SELECT *, CAST(epoch_us(first_filed) - epoch_us(wrapped_at) AS DOUBLE) / 1e6 AS lag_seconds FROM m)
SELECT {_DAYS}, department, first_filed, events, shoot_date, wrap_time, wrapped_at, lag_seconds, CASE WHEN lag_seconds IS NULL THEN NULL WHEN lag_seconds <= 172800 THEN 'handover' ELSE 'backfill' END AS measurement, lag_seconds IS NOT NULL AS measurable FROM g""")
_ACK = "count(*) AS acknowledged, round(avg(lag / 60), 3) AS avg_minutes, round(quantile_cont(lag / 60, 0.5), 3) AS median_minutes, round(max(lag / 60), 3) AS max_minutes FROM user_activity WHERE action = 'acknowledged' AND lag IS NOT NULL"
query("time_to_acknowledge", "user_activity", lambda x: a.time_to_acknowledge(x, ["department", "target_type"]), f"SELECT production_id, department, target_type, {_ACK} GROUP BY production_id, department, target_type")
query("time_to_acknowledge_by_actor", "user_activity", lambda x: a.time_to_acknowledge(x, ["actor"], positive=True), f"SELECT production_id, actor, {_ACK} AND lag > 0 GROUP BY production_id, actor")
query("department_attention", "user_activity", a.department_attention, "SELECT production_id, department, actor, count(*) FILTER (WHERE action = 'viewed') AS views, count(*) FILTER (WHERE action = 'acknowledged') AS acks, count(DISTINCT target_id) AS targets, max(created_at) AS last_seen FROM user_activity GROUP BY ALL")
query("actions_by_actor_and_day", "user_activity", a.actions_by_actor_and_day, f"SELECT {_DAYS}, actor, count(*) FILTER (WHERE action IN ('created', 'updated', 'resolved')) AS mutations, count(*) FILTER (WHERE action = 'viewed') AS views, count(DISTINCT target_type || target_id) AS targets, min(created_at) AS first_act, max(created_at) AS last_act FROM user_activity WHERE actor_source <> 'default' GROUP BY ALL")
query("actions_by_department_and_hour", "user_activity", a.actions_by_department_and_hour, "SELECT production_id, department, CAST(hour(created_at) AS INT) AS hour, count(*) AS actions FROM user_activity GROUP BY ALL")
_TOUCH = "WITH r AS (SELECT production_id, requirement_id, min(created_at) AS raised, arg_min(assignee, struct_pack(c := created_at, e := event_id)) AS actor FROM requirement_events GROUP BY ALL), t AS (SELECT target_id AS requirement_id, actor, min(created_at) AS touched FROM user_activity WHERE action <> 'created' GROUP BY ALL), l AS (SELECT r.*, touched, CAST(epoch_us(touched) - epoch_us(raised) AS DOUBLE) / 6e7 AS minutes FROM r LEFT JOIN t USING (requirement_id, actor)) "
query("first_touch_lag", "requirement_events user_activity", lambda e, x: a.first_touch_percentiles(e, x), _TOUCH + "SELECT production_id, actor, count(*) AS requirements, count(touched) AS touched, round(quantile_cont(minutes, 0.5), 2) AS median_minutes, round(quantile_cont(minutes, 0.9), 2) AS p90_minutes FROM l GROUP BY ALL")
query("take_throughput", "witness", a.take_throughput, f"SELECT {_DAYS}, camera_roll, count(*) AS takes, min(created_at) AS first_take, max(created_at) AS last_take, CAST(epoch_us(max(created_at)) - epoch_us(min(created_at)) AS DOUBLE) / 6e7 AS minutes FROM witness WHERE camera_roll <> '' GROUP BY ALL")
query("discrepancy_age", "findings", lambda f: a.discrepancy_age(f, NOW), _FINDINGS + f", g AS (SELECT *, round_even(greatest(0, CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at) AS DOUBLE) / 3.6e9), 1) AS age FROM cur WHERE NOT resolved) SELECT production_id, finding, severity, count(*) AS open, round(avg(age), 2) AS avg_hours, max(age) AS max_hours FROM g GROUP BY ALL")
query("sound_camera_agreement", "witness", a.sound_camera_agreement, f"""WITH s AS (SELECT DISTINCT {_DAYS}, slate, take_id, sound_roll FROM witness WHERE sound_roll <> ''), c AS (SELECT DISTINCT {_DAYS}, slate, take_id, camera_roll FROM witness WHERE camera_roll <> '')
SELECT production_id, sound_roll, camera_roll, count(*) AS takes FROM s JOIN c USING ({_DAYS}, slate, take_id) GROUP BY ALL""")
query("cross_day_patterns", "findings witness", a.cross_day_patterns, f"""{_FINDINGS},
take AS (SELECT {_DAYS}, slate, take_id, substr(camera_roll, 1, 1) AS camera, list(DISTINCT camera_roll) AS rolls
  FROM witness WHERE camera_roll <> '' GROUP BY ALL),
pair AS (SELECT production_id, shoot_day, a, b FROM (SELECT *, unnest(rolls) AS a FROM take), unnest(rolls) u(b) WHERE a < b),
doubt AS (SELECT {_DAYS}, slate, take_id, bool_or(len(rolls) > 1) AS apart FROM take GROUP BY ALL),
sound AS (SELECT DISTINCT {_DAYS}, slate, take_id, sound_roll, coalesce(apart, false) AS apart
  FROM witness LEFT JOIN doubt USING ({_DAYS}, slate, take_id) WHERE sound_roll <> '')
SELECT production_id, 'finding' AS pattern, finding AS value, count(DISTINCT shoot_day) AS days, count(*) AS times,
  round(CAST(count(*) FILTER (WHERE resolved) AS DOUBLE) / count(*), 4) AS rate FROM cur GROUP BY ALL
UNION ALL SELECT production_id, 'rolls', a || ',' || b, count(DISTINCT shoot_day), count(*), 1.0 FROM pair GROUP BY ALL
UNION ALL SELECT production_id, 'sound_roll', sound_roll, count(DISTINCT shoot_day), count(*),
  round(CAST(count(*) FILTER (WHERE apart) AS DOUBLE) / count(*), 4) FROM sound GROUP BY ALL""")
query("open_by_severity", "findings", a.open_by_severity, _FINDINGS + "SELECT production_id, count(*) FILTER (WHERE NOT resolved AND severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE NOT resolved AND severity = 'WARNING') AS warning, count(*) FILTER (WHERE resolved) AS resolved FROM cur GROUP BY ALL")
query("last_filing", "witness", lambda e: a.last_filing(e, NOW), f"SELECT production_id, department, max(created_at) AS last_filed, count(*) AS events, count(DISTINCT shoot_day) AS days, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(created_at))) / 60000000) AS BIGINT) AS minutes_ago FROM witness GROUP BY ALL")
query("takes_per_day", "witness", a.takes_per_day, f"""
SELECT {_DAYS}, count(DISTINCT slate || ':' || take_id) AS takes, count(DISTINCT slate) AS slates,
  count(*) FILTER (WHERE starred) AS starred, count(*) FILTER (WHERE contains(raw_take, 'PK')) AS pickups,
  count(*) FILTER (WHERE contains(raw_take, 'VFX')) AS vfx, count(*) FILTER (WHERE camera_roll = '') AS without_roll
FROM witness GROUP BY ALL""")
query("requirement_state", "requirement_events", a.requirement_state, _REQ_ONLY + "SELECT production_id, status, priority, count(*) AS requirements FROM req WHERE action <> 'deleted' GROUP BY ALL")
query("productions_overview", "witness", a.productions_overview, f"SELECT production_id, {_set('shoot_day')} AS days, count(*) AS events, count(DISTINCT shoot_day || '|' || slate || '|' || take_id) AS takes, max(created_at) AS last_activity FROM witness GROUP BY ALL")


_KINDS = ", ".join(f"('{k}')" for k in a.FINDINGS)
query("active_discrepancies", "findings", a.active_discrepancies, f"""{_FINDINGS},
grid AS (SELECT DISTINCT production_id, k.finding, s.severity
  FROM findings, (VALUES {_KINDS}) k(finding), (VALUES ('CRITICAL'), ('WARNING'), ('INFO')) s(severity))
SELECT grid.production_id, grid.finding, grid.severity, count(cur.event_id) AS open
FROM grid LEFT JOIN cur ON cur.production_id = grid.production_id AND cur.finding = grid.finding
  AND cur.severity = grid.severity AND NOT cur.resolved GROUP BY ALL""")
query("rejection_counts", "refusals", a.rejection_counts, """
SELECT doc_type, error_type, count(*) AS rejections FROM refusals GROUP BY ALL""")
query("ingest_counts", "witness", a.ingest_counts, "SELECT department, axis, count(*) AS events FROM witness GROUP BY ALL")
_NEEDED, _TOLD = ["sound", "music", "foley"], ["establishment", "night", "plate"]
query("tag_summary", "tag_events", lambda t: a.tag_summary(t, ["ready", "in_progress", "review", "locked"], _NEEDED, _TOLD), f"""{_TAGS},
live AS (SELECT * FROM cur WHERE action <> 'cleared'),
v AS (SELECT production_id, 'need' AS kind, unnest(string_split(needs, ',')) AS value FROM live UNION ALL SELECT production_id, 'descriptor', unnest(string_split(descriptors, ',')) FROM live
  UNION ALL SELECT production_id, CASE WHEN status = '' THEN 'no_status' ELSE 'status' END, status FROM live)
SELECT p.production_id, k.kind, k.value, (SELECT count(*) FROM v WHERE v.production_id = p.production_id AND v.kind = k.kind AND v.value = k.value) AS targets
FROM (SELECT DISTINCT production_id FROM tag_events) p, (VALUES ('no_status', ''), ('status', 'ready'), ('status', 'in_progress'), ('status', 'review'), ('status', 'locked'),
  ('need', 'sound'), ('need', 'music'), ('need', 'foley'), ('descriptor', 'establishment'), ('descriptor', 'night'), ('descriptor', 'plate')) k(kind, value)""")
query("outstanding_work", "tag_events", lambda t: status.outstanding(t, _NEEDED), f"""{_TAGS}
SELECT * FROM (SELECT production_id, unnest(string_split(needs, ',')) AS need, target_type, target_id, status FROM cur WHERE action <> 'cleared') WHERE need IN ('sound', 'music', 'foley')""")
_EVIDENCE = """SELECT production_id, scene, count(DISTINCT shoot_day) AS days, count(DISTINCT slate || ':' || take_id) AS takes,
  count(DISTINCT CASE WHEN starred THEN slate || ':' || take_id END) AS circled, count(DISTINCT doc_id) AS documents,
  bool_or(department = 'script') AS has_script, bool_or(department = 'camera') AS has_camera,
  bool_or(department = 'sound') AS has_sound, bool_or(axis = 'existence') AS has_existence,
  bool_or(contains(raw_take, 'VFX')) AS has_vfx, false AS has_wild FROM witness GROUP BY ALL"""
query("scene_evidence", "witness", a.scene_evidence, _EVIDENCE)
query("media_offloaded", "media", a.media_offloaded, f"""
SELECT {_DAYS}, volume, camera_roll, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes,
  CAST(sum(frames) AS BIGINT) AS frames, count(DISTINCT checksum) AS checksums FROM media GROUP BY ALL""")
query("discrepancy_cuts", "findings", lambda f: a.discrepancy_cuts(f, f), f"""{_FINDINGS},
o AS (SELECT * FROM cur WHERE NOT resolved),
said AS (SELECT o.production_id, o.shoot_day, o.finding, o.entity_id, f.roll, f.department, f.doc_id
  FROM o JOIN findings f USING ({_DAYS}, finding, entity_id)),
c AS (SELECT production_id, 'day' AS cut, shoot_day AS value FROM o
  UNION ALL SELECT production_id, 'kind', finding FROM o UNION ALL SELECT production_id, 'slate', entity_id FROM o
  UNION ALL (SELECT production_id, 'roll', roll FROM (SELECT DISTINCT {_DAYS}, finding, entity_id, roll FROM said))
  UNION ALL (SELECT production_id, 'department', department FROM (SELECT DISTINCT {_DAYS}, finding, entity_id, department FROM said))
  UNION ALL (SELECT production_id, 'document', doc_id FROM (SELECT DISTINCT {_DAYS}, finding, entity_id, doc_id FROM said)))
SELECT production_id, cut, value, count(*) AS open FROM c GROUP BY ALL""")
query("table_sizes", "witness media findings requirement_events user_activity", lambda *f: _sizes(dict(zip(("witness", "media", "findings", "requirement_events", "user_activity"), f))), " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("witness", "media", "findings", "requirement_events", "user_activity")))


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("table_name", "rows")


# ---- joins

_REQ_COLUMNS = "requirement_id, production_id, status, priority, assignee, action, raised_at, updated_at"
query("unacknowledged_requirements", "requirement_events user_activity", a.unacknowledged, _REQUIREMENTS + f"SELECT {_REQ_COLUMNS} FROM req WHERE requirement_id NOT IN (SELECT target_id FROM acked)")
query("unacknowledged_blocking_wrap", "requirement_events user_activity", lambda e, x: a.unacknowledged_blocking(e, x).select("production_id", "shoot_day", "requirement_id", "status", "place"), _REQUIREMENTS + _RAISED + f"SELECT {_DAYS}, requirement_id, status, place FROM (SELECT req.production_id, shoot_day, requirement_id, status, CAST(row_number() OVER (PARTITION BY req.production_id, shoot_day ORDER BY updated_at DESC, requirement_id DESC) AS INT) AS place FROM req JOIN raised USING (production_id, requirement_id) WHERE status IN ('open', 'in_progress', 'blocked') AND requirement_id NOT IN (SELECT target_id FROM acked)) WHERE place <= 50")
query("unreviewed_days", "witness user_activity", a.unreviewed_days, f"""WITH f AS (SELECT {_DAYS}, count(*) AS events FROM witness GROUP BY ALL), s AS (SELECT {_DAYS}, count(*) FILTER (WHERE action = 'viewed') AS views, count(*) FILTER (WHERE action = 'acknowledged') AS acks, {_set('actor')} AS seen_by FROM user_activity GROUP BY ALL)
SELECT {_DAYS}, events, coalesce(views, 0) AS views, coalesce(acks, 0) AS acks, coalesce(seen_by, '') AS seen_by FROM f LEFT JOIN s USING ({_DAYS})""")


def _crew(activity: DataFrame) -> DataFrame:
    """Who acts in the tool, with a role by handle."""
    return activity.select(F.col("actor").alias("handle")).distinct().withColumn("role", F.concat(F.lit("role"), F.substring("handle", 3, 1)))


query("requirements_by_day_and_role", "requirement_events user_activity", lambda e, x: a.requirements_by_day_and_role(e, _crew(x)), f"""{_REQ_ONLY}{_RAISED}
SELECT {_DAYS}, 'role' || substr(assignee, 3, 1) AS role, count(*) AS requirements FROM req JOIN raised USING (production_id, requirement_id)
WHERE assignee IN (SELECT actor FROM user_activity) GROUP BY ALL""")
query("attach_requirements_to_takes", "witness requirement_events", lambda w, e: status.take_requirements(w, ledger.latest(e, ["production_id", "requirement_id"], ["created_at", "event_id"])), f"""
WITH req AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY production_id, requirement_id ORDER BY created_at DESC, event_id DESC) AS rn FROM requirement_events) WHERE rn = 1)
SELECT w.production_id, slate, take_id, count(*) FILTER (WHERE status <> 'resolved') AS open, count(*) FILTER (WHERE status = 'resolved') AS resolved
FROM (SELECT DISTINCT production_id, slate, take_id FROM witness) w
JOIN req ON req.production_id = w.production_id AND target_id = split_part(slate, '/', 1) GROUP BY ALL""")
query("crew_workload", "requirement_events user_activity", lambda e, x: status.crew_workload(_crew(x), e), f"""{_REQ_ONLY},
crew AS (SELECT DISTINCT actor AS handle, 'crew' AS kind FROM user_activity),
o AS (SELECT assignee AS handle, requirement_id, status, updated_at, row_number() OVER (PARTITION BY assignee
  ORDER BY CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 9 END, updated_at DESC, requirement_id) AS place
  FROM req WHERE status <> 'resolved'),
l AS (SELECT handle, count(*) AS open, count(*) FILTER (WHERE status = 'blocked') AS blocked, max(updated_at) AS last_change,
  string_agg(CASE WHEN place <= 5 THEN requirement_id END, ',' ORDER BY place) AS current FROM o GROUP BY ALL)
SELECT handle, coalesce(kind, 'external') AS kind, coalesce(open, 0) AS open, coalesce(blocked, 0) AS blocked, last_change, coalesce(current, '') AS current
FROM crew FULL JOIN l USING (handle)""")
query("workload_order", "requirement_events user_activity", lambda e, x: status.workload_order(status.crew_workload(_crew(x), e), 10).select("handle", "open", "place"), f"""{_REQ_ONLY},
l AS (SELECT assignee AS handle, count(*) AS open FROM req WHERE status <> 'resolved' GROUP BY ALL),
m AS (SELECT handle, coalesce(open, 0) AS open FROM (SELECT DISTINCT actor AS handle FROM user_activity) FULL JOIN l USING (handle))
SELECT handle, open, CAST(row_number() OVER (ORDER BY open DESC, handle) AS INT) AS place FROM m QUALIFY place <= 10""")
query("list_requirements", "requirement_events", lambda e: status.listed(a.latest_requirements(e), ["updated_at", "requirement_id"], 25, assignee="@C7", status="open").select("production_id", "requirement_id", "updated_at"), f"""{_REQ_ONLY}
SELECT production_id, requirement_id, updated_at FROM req WHERE assignee = '@c7' AND status = 'open' ORDER BY updated_at DESC, requirement_id DESC LIMIT 25""")
query("list_tags", "tag_events", lambda t: status.listed(ledger.latest(t, ["production_id", "target_type", "target_id"], ["created_at", "event_id"]).filter("action <> 'cleared'"), ["created_at", "event_id"], 40, needs="VFX", target_type="scene").select("production_id", "target_id", "created_at"), f"""{_TAGS}
SELECT production_id, target_id, created_at FROM cur WHERE action <> 'cleared' AND target_type = 'scene' AND list_contains(string_split(needs, ','), 'vfx')
ORDER BY created_at DESC, event_id DESC LIMIT 40""")


def _live(events: DataFrame) -> DataFrame:
    wanted = [("all", "ALL", "ALL"), ("one", "P1", "ALL"), ("day", "ALL", "7"), ("both", "P2", "9")]
    subscriptions = events.sparkSession.createDataFrame(wanted, "subscription string, production_id string, shoot_day string")
    return status.live_events(events, subscriptions).groupBy("subscription", "department").agg(F.count("*").alias("events"))


query("live_event_match", "witness", _live, "SELECT s.subscription, department, count(*) AS events FROM witness w JOIN (VALUES ('all', 'ALL', 'ALL'), ('one', 'P1', 'ALL'), ('day', 'ALL', '7'), ('both', 'P2', '9')) s(subscription, p, d) ON (s.p = 'ALL' OR s.p = w.production_id) AND (s.d = 'ALL' OR s.d = w.shoot_day) GROUP BY ALL")
query("character_relationships", "lines", script.relationships, """WITH c AS (SELECT DISTINCT script_id, scene, speaker FROM lines), p AS (SELECT a.script_id, a.speaker AS a, b.speaker AS b, count(*) AS shared_scenes FROM c a JOIN c b ON a.script_id = b.script_id AND a.scene = b.scene AND a.speaker < b.speaker GROUP BY ALL), l AS (SELECT *, lag(speaker) OVER (PARTITION BY script_id, scene ORDER BY place) AS prev FROM lines), t AS (SELECT script_id, least(speaker, prev) AS a, greatest(speaker, prev) AS b, count(*) AS turns FROM l WHERE prev IS NOT NULL AND prev <> speaker GROUP BY ALL)
SELECT script_id, a, b, shared_scenes, coalesce(turns, 0) AS turns, CASE WHEN coalesce(turns, 0) >= 6 THEN 'Principal Dialogue Counterpart' WHEN coalesce(turns, 0) > 0 THEN 'Key Dialogue Counterpart' ELSE 'Shared Scene Presence' END AS strength FROM p LEFT JOIN t USING (script_id, a, b)""")
query("character_stats", "lines deeds", script.character_stats, """
WITH e AS (SELECT script_id, speaker, count(*) AS lines FROM lines GROUP BY ALL),
d AS (SELECT script_id, scene, CASE (scene - 1) % 4 WHEN 0 THEN 'ASSISTANT' ELSE 'USER' END AS speaker FROM deeds WHERE (scene - 1) % 4 IN (0, 2)),
c AS (SELECT script_id, speaker, scene FROM lines UNION SELECT d.script_id, d.speaker, d.scene FROM d JOIN e ON e.script_id = d.script_id AND e.speaker = d.speaker),
g AS (SELECT script_id, speaker, count(*) AS scenes FROM c GROUP BY ALL),
r AS (SELECT e.*, scenes, CAST(row_number() OVER (PARTITION BY script_id ORDER BY lines DESC, speaker) AS INT) AS rank FROM e JOIN g USING (script_id, speaker))
SELECT script_id, speaker, lines, scenes, rank, CASE WHEN rank = 1 THEN 'Lead' WHEN lines >= 3 THEN 'Principal Cast' ELSE 'Supporting Character' END AS role FROM r""")
query("turn_adjacency", "lines", lambda x: script.turn_adjacency(x).drop("line"), "SELECT script_id, scene, place, speaker, lag(speaker) OVER (PARTITION BY script_id, scene ORDER BY place) AS previous FROM lines")
_PRONOUNS = {"she": "she|her|hers", "he": "he|him|his", "they": "they|them|their"}
query("pronoun_tally", "cues actions", script.pronoun_tally, """
WITH c AS (SELECT DISTINCT script_id, scene, speaker FROM cues WHERE speaker <> ''),
t AS (SELECT c.script_id, c.speaker, """ + ", ".join(f"CAST(sum(len(regexp_extract_all(lower(action), '\\b({p})\\b'))) AS BIGINT) AS {k}" for k, p in _PRONOUNS.items()) + """
  FROM c JOIN actions x ON x.script_id = c.script_id AND x.scene = c.scene AND contains(upper(action), speaker) GROUP BY ALL),
n AS (SELECT script_id, speaker, coalesce(she, 0) AS she, coalesce(he, 0) AS he, coalesce(they, 0) AS they
  FROM (SELECT DISTINCT script_id, speaker FROM c) LEFT JOIN t USING (script_id, speaker))
SELECT *, CASE WHEN she > he AND she > they THEN 'woman' WHEN he > she AND he > they THEN 'man' WHEN they > she AND they > he THEN 'non-binary' ELSE '' END AS label FROM n""")
query("trait_hints", "cues", script.trait_hints, "SELECT script_id, speaker, array_to_string(list_filter([" + ", ".join(
    "CASE WHEN bool_or(" + " OR ".join(f"contains(lower(line), '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + f") THEN '{t}' END" for t, words in script.TRAITS.items()
) + "], lambda x: x IS NOT NULL), ',') AS traits FROM cues GROUP BY ALL")

# ---- detectors

_F = "entity_id, finding, severity, detail"
_TAKE = f"{_DAYS}, slate, take_id"
query("circled_take_mismatch", "witness", reconcile.circled_mismatches, f"WITH s AS (SELECT {_TAKE}, doc_id, arg_max(starred, seq) AS starred FROM witness WHERE department = 'script' AND starred IS NOT NULL GROUP BY ALL) SELECT {_DAYS}, slate || ' Take ' || take_id AS entity_id, 'CIRCLED_TAKE_MISMATCH' AS finding, 'CRITICAL' AS severity, CAST(count(*) AS VARCHAR) AS detail FROM s GROUP BY {_TAKE} HAVING bool_or(starred) AND NOT bool_and(starred)")
query("timecode_drift", "witness", reconcile.timecode_drifts, f"""WITH o AS (SELECT {_TAKE}, timecode_in AS tc, row_number() OVER (PARTITION BY {_TAKE} ORDER BY seq, timecode_in) AS rn FROM witness), f AS (SELECT {_TAKE}, rn, ((CAST(substr(tc, 1, 2) AS BIGINT) * 60 + CAST(substr(tc, 4, 2) AS BIGINT)) * 60 + CAST(substr(tc, 7, 2) AS BIGINT)) * 24 + CAST(substr(tc, 10, 2) AS BIGINT) AS fr FROM o WHERE rn <= 2), d AS (SELECT {_TAKE}, abs(max(fr) FILTER (WHERE rn = 1) - max(fr) FILTER (WHERE rn = 2)) AS drift FROM f GROUP BY {_TAKE} HAVING count(*) = 2)
SELECT {_DAYS}, slate || ' Take ' || take_id AS entity_id, 'TIMECODE_DRIFT' AS finding, 'WARNING' AS severity, CAST(drift AS VARCHAR) AS detail FROM d WHERE drift > 1 AND drift <= 240""")
query("camera_roll_mismatch", "witness", reconcile.camera_roll_mismatches, f"SELECT {_DAYS}, slate || ' Take ' || take_id AS entity_id, 'ROLL_MISMATCH' AS finding, 'CRITICAL' AS severity, substr(camera_roll, 1, 1) || ':' || {_set('camera_roll')} AS detail FROM witness WHERE camera_roll <> '' GROUP BY {_TAKE}, substr(camera_roll, 1, 1) HAVING count(DISTINCT camera_roll) > 1")
query("sound_roll_mismatch", "witness", reconcile.sound_roll_mismatches, f"SELECT {_DAYS}, slate || ' Take ' || take_id AS entity_id, 'ROLL_MISMATCH' AS finding, 'WARNING' AS severity, {_set('sound_roll')} AS detail FROM witness WHERE sound_roll <> '' GROUP BY {_TAKE} HAVING count(DISTINCT sound_roll) > 1")
_CLIPS = f"""WITH l AS (SELECT {_DAYS}, slate, take_id, clip_name, upper(substr(clip_name, 1, 1)) AS cam, try_cast(substr(clip_name, 2, 3) AS INT) AS roll, try_cast(substr(clip_name, 7) AS INT) AS clip
  FROM witness WHERE axis = 'belief' AND clip_name <> ''),
m AS (SELECT {_DAYS}, file_name, regexp_extract(file_name, '^([A-Z])_[0-9]', 1) AS cam, try_cast(regexp_extract(file_name, '^[A-Z]_([0-9]+)C', 1) AS INT) AS roll,
  try_cast(regexp_extract(file_name, 'C([0-9]+)_', 1) AS INT) AS clip, regexp_extract(file_name, '^([0-9]+-[0-9]+)T', 1) AS slate, try_cast(regexp_extract(file_name, 'T([0-9]+)[.]WAV$', 1) AS INT) AS take FROM media) """
query("paperwork_without_media", "witness media", reconcile.paperwork_without_media, _CLIPS + f"""
SELECT DISTINCT {_DAYS}, slate || ' Take ' || take_id || ' (' || clip_name || ')' AS entity_id, 'PAPERWORK_WITHOUT_MEDIA' AS finding, 'CRITICAL' AS severity, clip_name AS detail
FROM l WHERE ({_DAYS}) IN (SELECT ({_DAYS}) FROM m)
AND NOT EXISTS (SELECT 1 FROM m WHERE m.production_id = l.production_id AND m.shoot_day = l.shoot_day AND m.cam = l.cam AND m.roll = l.roll AND m.clip = l.clip)""")
query("media_without_paperwork", "witness media", reconcile.media_without_paperwork, _CLIPS + f"""
SELECT DISTINCT {_DAYS}, file_name AS entity_id, 'MEDIA_WITHOUT_PAPERWORK' AS finding, 'WARNING' AS severity, '' AS detail FROM m
WHERE NOT EXISTS (SELECT 1 FROM l WHERE m.production_id = l.production_id AND m.shoot_day = l.shoot_day AND m.cam = l.cam AND m.roll = l.roll AND m.clip = l.clip)
AND NOT EXISTS (SELECT 1 FROM witness w WHERE axis = 'belief' AND m.production_id = w.production_id AND m.shoot_day = w.shoot_day
  AND m.slate = replace(w.slate, '/', '-') AND m.take = CAST(w.take_id AS INT))""")
query("awaiting_offload", "witness media", reconcile.awaiting_offload, f"""
SELECT {_DAYS}, shoot_day AS entity_id, 'AWAITING_OFFLOAD' AS finding, 'INFO' AS severity,
  CAST(count(*) AS VARCHAR) || ':' || array_to_string(list_slice(list_sort(list(DISTINCT slate)), 1, 20), ',') AS detail
FROM witness WHERE axis = 'belief' AND clip_name <> '' AND ({_DAYS}) NOT IN (SELECT ({_DAYS}) FROM media) GROUP BY {_DAYS}""")
query("scene_findings", "scene_events witness", reconcile.scene_findings, f"""WITH mat AS (SELECT DISTINCT {_DAYS}, scene FROM witness), c AS (SELECT DISTINCT {_DAYS}, scene, office_state FROM scene_events WHERE office_state IS NOT NULL), p AS (SELECT DISTINCT {_DAYS}, scene FROM scene_events WHERE axis = 'intent' AND state = 'scheduled')
SELECT {_DAYS}, scene AS entity_id, 'SCENE_COMPLETE_WITHOUT_MATERIAL' AS finding, 'WARNING' AS severity, '' AS detail FROM c WHERE office_state IN ('complete', 'part_complete') AND ({_DAYS}) IN (SELECT ({_DAYS}) FROM mat) AND ({_DAYS}, scene) NOT IN (SELECT ({_DAYS}, scene) FROM mat)
UNION ALL SELECT {_DAYS}, scene, 'SCENE_SCHEDULED_NOT_SHOT', 'INFO', '' FROM c WHERE office_state IN ('scheduled_not_shot', 'not_shot')
UNION ALL SELECT {_DAYS}, scene, 'SCENE_SHOT_NOT_SCHEDULED', 'INFO', '' FROM c WHERE office_state = 'shot_not_scheduled' AND ({_DAYS}, scene) NOT IN (SELECT ({_DAYS}, scene) FROM p)""")
query("slates_outside_range", "witness slate_ranges", reconcile.slates_outside_range, f"""WITH r AS (SELECT {_DAYS}, scene, arg_max(first, seq) AS f, arg_max(last, seq) AS l FROM slate_ranges GROUP BY ALL), e AS (SELECT {_DAYS}, scene, CASE WHEN contains(f, '/') THEN CAST(split_part(f, '/', 2) AS BIGINT) ELSE CAST(f AS BIGINT) END AS a, CAST(l AS BIGINT) AS b FROM r), s AS (SELECT DISTINCT {_DAYS}, slate, split_part(replace(slate, '-', '/'), '/', 1) AS scene, CAST(split_part(replace(slate, '-', '/'), '/', 2) AS BIGINT) AS shot FROM witness)
SELECT {_DAYS}, slate AS entity_id, 'SLATE_OUTSIDE_STATED_RANGE' AS finding, 'WARNING' AS severity, CAST(least(a, b) AS VARCHAR) || '-' || CAST(greatest(a, b) AS VARCHAR) AS detail FROM s JOIN e USING ({_DAYS}, scene) WHERE shot < least(a, b) OR shot > greatest(a, b)""")
query("shoot_date_disagreement", "shoot_dates", reconcile.date_disagreements, f"SELECT {_DAYS}, shoot_day AS entity_id, 'SHOOT_DATE_DISAGREEMENT' AS finding, 'WARNING' AS severity, {_set('date')} AS detail FROM shoot_dates GROUP BY {_DAYS} HAVING count(DISTINCT date) >= 2")
_DETECTORS = ("circled_take_mismatch", "timecode_drift", "camera_roll_mismatch", "sound_roll_mismatch", "paperwork_without_media", "media_without_paperwork", "awaiting_offload", "scene_findings", "slates_outside_range", "shoot_date_disagreement")
query("reconcile_counts", "witness media scene_events slate_ranges shoot_dates", lambda *t: reconcile.reconcile(*t).groupBy("production_id", "finding", "severity").agg(F.count("*").alias("findings")))
ORACLES["reconcile_counts"] = "SELECT production_id, finding, severity, count(*) AS findings FROM (" + " UNION ALL ".join(f"SELECT production_id, finding, severity FROM ({ORACLES[d]})" for d in _DETECTORS) + ") GROUP BY ALL"
query("unify_take_marks", "witness", lambda w: reconcile.unified_marks(w).select("production_id", "doc_id", "slate", "take_id", "seq", "starred"), """
SELECT production_id, doc_id, slate, take_id, seq, CASE WHEN bool_or(coalesce(starred, false)) OVER (PARTITION BY production_id, doc_id, slate, take_id) THEN true ELSE starred END AS starred FROM witness""")
query("witness_authors", "witness", lambda w: w.groupBy(reconcile.witness_author(F.col("department"), F.col("camera_roll")).alias("author")).agg(F.count("*").alias("claims")), "SELECT CASE department WHEN 'camera' THEN 'Camera ' || substr(camera_roll, 1, 1) WHEN 'sound' THEN 'Sound Department' WHEN 'script' THEN 'Script Supervisor' WHEN 'vfx' THEN 'Vfx' ELSE 'DIT' END AS author, count(*) AS claims FROM witness GROUP BY ALL")

# ---- trails and windows

query("latest_findings", "findings", lambda f: a.current_findings(f).select("production_id", "shoot_day", "finding", "entity_id", "resolved", "event_id"), _FINDINGS + "SELECT production_id, shoot_day, finding, entity_id, resolved, event_id FROM cur")
query("project_takes", "witness", ledger.projected_takes, f"SELECT production_id, shoot_day, slate, take_id, camera_roll, department, starred, created_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY {_TAKE}, camera_roll ORDER BY created_at DESC, seq DESC) AS rn FROM witness) WHERE rn = 1")
query("first_acknowledgement", "user_activity", ledger.first_acknowledgement, "SELECT production_id, target_type, target_id, actor, created_at AS acknowledged_at FROM (SELECT *, row_number() OVER (PARTITION BY production_id, target_type, target_id ORDER BY created_at, event_id) AS rn FROM user_activity WHERE action = 'acknowledged') WHERE rn = 1")
query("target_history", "user_activity", lambda x: ledger.history(x, ["target_id"], ["created_at", "event_id"], 5).select("target_id", "event_id", "action", "place"), "SELECT target_id, event_id, action, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, event_id DESC) AS INT) AS place FROM user_activity) WHERE place <= 5")
query("target_timeline", "user_activity", lambda x: ledger.timeline(x, ["target_id"], ["created_at", "event_id"], "action"), "SELECT target_id, string_agg(action, '>' ORDER BY created_at, event_id) AS timeline, count(*) AS events FROM user_activity GROUP BY ALL")
_OLD = ", ".join(f"lag({c}) OVER w AS o{c}" for c in ("status", "priority", "assignee", "resolved_by"))
query("requirement_changes", "requirement_events", ledger.requirement_changes, f"""WITH s AS (SELECT *, {_OLD}, row_number() OVER w AS n FROM requirement_events WINDOW w AS (PARTITION BY requirement_id ORDER BY created_at, event_id)), c AS (SELECT *, CASE WHEN n = 1 THEN 'created' WHEN ostatus = 'resolved' AND status <> 'resolved' THEN 'reopened' WHEN ostatus <> status THEN 'status_changed' WHEN oassignee <> assignee THEN 'reassigned' WHEN opriority <> priority THEN 'updated' END AS change FROM s)
SELECT requirement_id, production_id, event_id, change, concat_ws(',', CASE WHEN ostatus <> status THEN 'status:' || ostatus || '>' || status END, CASE WHEN opriority <> priority THEN 'priority:' || opriority || '>' || priority END, CASE WHEN oassignee <> assignee THEN 'assignee:' || oassignee || '>' || assignee END, CASE WHEN ostatus = 'resolved' AND status <> 'resolved' THEN 'resolved_by:' || oresolved_by || '>' END) AS fields FROM c WHERE change IS NOT NULL""")

# ---- ranking and sets

_AGE = f"least(14.0::DOUBLE, round_even(greatest(0, CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us({{}}) AS DOUBLE) / 3.6e9), 1) / 24)"
_SCORES = f"""{_FINDINGS}, {_REQUIREMENTS[len("WITH "):]}{_RAISED},
s AS (SELECT {_DAYS}, 'finding' AS source, 'discrepancy:' || finding || ':' || entity_id AS key, 'Take ' || entity_id AS label,
  CASE severity WHEN 'CRITICAL' THEN 'critical' WHEN 'WARNING' THEN 'high' ELSE 'medium' END AS priority,
  round(CASE severity WHEN 'CRITICAL' THEN 90.0 WHEN 'WARNING' THEN 60.0 ELSE 25.0 END::DOUBLE + {_AGE.format("created_at")}, 2) AS score FROM cur WHERE NOT resolved
UNION ALL SELECT production_id, shoot_day, 'requirement', 'requirement:' || requirement_id || ':unacknowledged', 'Requirement ' || requirement_id,
  CASE WHEN priority IN ('low', 'medium', 'high', 'critical') THEN priority ELSE 'medium' END,
  round(CASE priority WHEN 'critical' THEN 90.0 ELSE 60.0 END::DOUBLE + 28 + {_AGE.format("raised_at")}, 2)
  FROM req JOIN raised USING (production_id, requirement_id) WHERE status IN ('open', 'in_progress', 'blocked') AND requirement_id NOT IN (SELECT target_id FROM acked)) """
query("rank_blockers", "findings requirement_events user_activity", lambda f, e, x: status.rank_blockers(f, e, x, NOW), _SCORES + f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {_DAYS} ORDER BY score DESC, priority, label, key) AS INT) AS rank FROM s) WHERE rank <= 10""")
_CLEAN = f"""{_FINDINGS}, {_REQ_TARGETS}, {_TAGS[len("WITH cur"):].join(("tag", ""))},
ev AS ({_EVIDENCE}),
sc AS (SELECT *, CAST(has_script AS INT) AS hs, CAST(has_camera AS INT) AS hc, CAST(has_sound OR has_wild AS INT) AS ho, CAST(has_existence AS INT) AS he FROM ev),
cand AS (SELECT production_id, scene, takes, circled, documents,
  takes * 4 + documents * 2 + circled * 18 + hs * 12 + hc * 12 + CAST(has_sound AS INT) * 8 + he * 20 - CAST(has_vfx AS INT) * 6 AS score
  FROM sc WHERE hs + hc + ho + he + CASE WHEN circled > 0 THEN 1 ELSE 0 END >= 3 AND he = 1
  AND (production_id, scene) NOT IN (SELECT (production_id, split_part(entity_id, '/', 1)) FROM cur WHERE NOT resolved)
  AND (production_id, scene) NOT IN (SELECT (production_id, target_id) FROM req WHERE status <> 'resolved')
  AND (production_id, scene) NOT IN (SELECT (production_id, target_id) FROM tag WHERE target_type = 'scene' AND action <> 'cleared' AND status = 'review')),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY production_id ORDER BY score DESC, circled DESC, takes DESC, scene) AS INT) AS rank FROM cand) """


def _candidates(w: DataFrame, f: DataFrame, e: DataFrame, t: DataFrame) -> DataFrame:
    """Scenes under review stand for those that are queued already."""
    now = ledger.latest(t, ["production_id", "target_type", "target_id"], ["created_at", "event_id"])
    queued = now.filter("target_type = 'scene' and action <> 'cleared' and status = 'review'").select("production_id", F.col("target_id").alias("scene"))
    return status.candidate_scenes(w, f, status.blocked_scenes(e), queued)


query("candidate_scenes", "witness findings requirement_events tag_events", _candidates, _CLEAN + "SELECT production_id, scene, takes, circled, documents, score, rank FROM ranked WHERE rank <= 100")


def _dealt(w: DataFrame, f: DataFrame, e: DataFrame, t: DataFrame) -> DataFrame:
    load = w.select("production_id").distinct().select("production_id", F.explode(F.lit(["@ana", "@bo", "@cy"])).alias("handle")).withColumn("load", F.when(F.col("handle") == "@bo", 0).otherwise(2))
    return status.assigned(_candidates(w, f, e, t), load, 6).select("production_id", "scene", "rank", "handle")


query("assign_candidates", "witness findings requirement_events tag_events", _dealt, _CLEAN + ", slots AS (SELECT handle, CAST(row_number() OVER (ORDER BY load + i, handle) AS INT) AS rank FROM (VALUES ('@ana', 2), ('@bo', 0), ('@cy', 2)) l(handle, load), range(6) t(i)) SELECT production_id, scene, rank, handle FROM ranked JOIN slots USING (rank) WHERE rank <= 6")
query("missing_paperwork", "witness", status.missing_paperwork, f"""
WITH f AS (SELECT DISTINCT {_DAYS}, department FROM witness)
SELECT d.production_id, d.shoot_day, e.department FROM (SELECT DISTINCT {_DAYS} FROM f) d JOIN (SELECT DISTINCT production_id, department FROM f) e USING (production_id)
WHERE (d.production_id, d.shoot_day, e.department) NOT IN (SELECT (production_id, shoot_day, department) FROM f)""")
_STATUSES = ["ready", "in_progress", "review", "done"]
_STATES = ", ".join(f"('{x}')" for x in [*_STATUSES, "no_status", "tagged_but_unknown"])


def _progress(w: DataFrame, t: DataFrame) -> DataFrame:
    # spellings are few beside witnesses: slates are normalised after they are distinct
    known = w.select("production_id", "scene", "slate").distinct().select("production_id", F.explode(F.array(F.struct(F.lit("scene").alias("t"), F.col("scene").alias("i")), F.struct(F.lit("shot").alias("t"), n.slate(F.col("slate")).alias("i")))).alias("k"))
    return status.editorial_progress(known.select("production_id", F.col("k.t").alias("target_type"), F.col("k.i").alias("target_id")), t, _STATUSES)


query("editorial_progress", "witness tag_events", _progress, f"""{_TAGS},
k AS (SELECT DISTINCT production_id, 'scene' AS target_type, scene AS target_id, 1 AS known FROM witness
  UNION ALL SELECT DISTINCT production_id, 'shot', replace(slate, '-', '/'), 1 FROM witness),
live AS (SELECT * FROM cur WHERE action <> 'cleared'),
j AS (SELECT production_id, target_type, CASE WHEN known IS NULL THEN 'tagged_but_unknown' ELSE coalesce(status, 'no_status') END AS value
  FROM k FULL JOIN (SELECT production_id, target_type, target_id, status FROM live WHERE status <> '') USING (production_id, target_type, target_id)),
g AS (SELECT DISTINCT production_id, target_type, v.value FROM j, (VALUES {_STATES}) v(value))
SELECT production_id, target_type, 'state' AS kind, g.value, (SELECT count(*) FROM j WHERE j.production_id = g.production_id AND j.target_type = g.target_type AND j.value = g.value) AS targets FROM g
UNION ALL SELECT production_id, target_type, 'need', need, count(*) FROM (SELECT production_id, target_type, unnest(string_split(needs, ',')) AS need FROM live WHERE status <> 'done') WHERE need <> '' GROUP BY ALL""")

# ---- scalar functions

query("normalize_camera_rolls", "witness", lambda w: w.groupBy("raw_roll", n.camera_roll(F.col("raw_roll")).alias("roll")).agg(F.count("*").alias("rows")), "SELECT raw_roll, CASE WHEN raw_roll = '' THEN NULL ELSE upper(substr(raw_roll, 1, 1)) || lpad(CAST(CAST(regexp_extract(raw_roll, '^[A-Za-z]_?0*([0-9]+)', 1) AS INT) AS VARCHAR), 3, '0') END AS roll, count(*) AS rows FROM witness GROUP BY ALL")
query("normalize_takes", "witness", lambda w: w.select("raw_take", n.take(F.col("raw_take")).alias("t")).groupBy("raw_take", "t.take_id", "t.starred", "t.pickup", "t.vfx", "t.note").agg(F.count("*").alias("rows")), "SELECT raw_take, regexp_extract(raw_take, '^T?0*([0-9]+)', 1) || CASE WHEN contains(raw_take, 'PK') THEN 'PK' ELSE '' END AS take_id, contains(raw_take, '*') AS starred, contains(raw_take, 'PK') AS pickup, contains(raw_take, 'VFX') AS vfx, CASE WHEN contains(raw_take, 'VFX') THEN 'VFX' END AS note, count(*) AS rows FROM witness GROUP BY ALL")
query("normalize_slates", "witness", lambda w: w.groupBy(n.slate(F.col("slate")).alias("slate")).agg(F.count("*").alias("rows")), "SELECT replace(slate, '-', '/') AS slate, count(*) AS rows FROM witness GROUP BY ALL")


def documents(name: str, job: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: job(spark.read.parquet(f"{d}/documents.parquet"))
    ORACLES[name] = sql


_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_INTERNATIONAL = r"\+\d{1,3}[\s.-]?(?:\(?\d{2,4}\)?[\s.-]?){2,}\d{2,4}"
_LABELLED = r"(?i)\b(tel|tlf|phone|mobile|m[oó]vil|movil|cel|celular|whatsapp)\b\s*[:.]?\s*[+()\d][\d\s().-]{6,}"
documents("contact_documents", lambda d: d.filter(privacy.is_contact(F.col("text"))).select("doc_id"), f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_EMAIL}') OR regexp_matches(text, '{_LABELLED}') OR regexp_matches(text, '{_INTERNATIONAL}')")
documents("redact_contacts", lambda d: d.select("doc_id", F.sha2(privacy.redacted(F.col("text")), 256).alias("redacted_sha256")), f"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '[email removed]', 'g'), '{_LABELLED}', '\\1: [phone removed]', 'g'), '{_INTERNATIONAL}', '[phone removed]', 'g')) AS redacted_sha256 FROM documents")
documents("dedupe_documents", lambda d: ledger.deduplicated(d.select("doc_id", "source", F.sha2("text", 256).alias("checksum")), ["source", "checksum"], ["doc_id"]), "SELECT doc_id, source, sha256(text) AS checksum, CAST(row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS INT) AS copy FROM documents")
_WORD = r"(^|[^\p{L}\p{N}_])(%s)($|[^\p{L}\p{N}_])"
_FILLERS = """cinematic expressive distinctive distinguishing striking mysterious intense rugged appropriate suitable typical generic various certain undefined unspecified presence characterful
compelling memorable interesting unique somewhat perhaps possibly likely maybe tbd"""
_THINGS = """black white grey gray brown blue green red amber navy olive tan blonde charcoal cream rust ochre auburn ginger silver gold wool cotton linen leather denim silk canvas tweed velvet
corduroy nylon suede rubber brass steel plastic fur scar freckle stubble mole tattoo beard braid ponytail moustache hair eyes eye cheekbone cheekbones jaw jawline brow chin nose lips mouth
skin complexion shoulders build frame hands posture collar cuff cuffs button buttons zip lapel hem seam pocket boot boots glove gloves coat jacket shirt dress trousers skirt vest
scarf belt hat cap apron uniform tie watch ring chain frayed torn patched stained faded worn creased cracked scuffed bleached"""
documents("vague_documents", lambda d: d.select("doc_id", *[n.is_vague(F.col("text"), f).alias(f) for f in ("notes", *n.LEAST_WORDS)]), f"""
WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
y AS (SELECT doc_id, NOT regexp_matches(t, '[^ \\t\\n\\x0B\\f\\r]') OR regexp_matches(t, '(^|[^a-z])({"|".join(_FILLERS.split())})([^a-z]|$)')
    OR regexp_matches(t, 'to be (defined|determined|decided)|not (described|specified|stated)|refine to lock|consistent across|set a reference|tbd|unknown|n/a|placeholder|lorem ipsum') AS notes,
  len(regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+')) AS words, regexp_matches(t, '{_WORD % "[0-9]+s?"}') OR regexp_matches(t, '{_WORD % "|".join(_THINGS.split())}') OR regexp_matches(t, '''[0-9]') AS concrete FROM x)
SELECT doc_id, notes, notes OR words < 10 OR NOT concrete AS actor_reference, notes OR words < 12 OR NOT concrete AS look_and_costume, notes OR words < 10 OR NOT concrete AS facial_features FROM y""")

# ---- rollups

_CARDS = _set("camera_roll", "camera_roll <> ''")
_ORDERED = "array_to_string(list_transform(list_sort(list(DISTINCT CAST(shoot_day AS INT))), lambda x: CAST(x AS VARCHAR)), ',')"
query("sequence_shoot_days", "witness", rollups.sequence_shoot_days, f"SELECT production_id, scene, {_ORDERED} AS days FROM witness GROUP BY ALL")
_NOTES = "array_to_string(list_transform(list_sort(list({{'k': {k}, 'n': note}}) FILTER (WHERE {k} <= {most})), lambda x: x.n), '; ')"
query("sequence_rollup", "witness", rollups.sequence_rollup, f"""
WITH w AS (SELECT *, replace(slate, '-', '/') || ':' || take_id AS take FROM witness),
n AS (SELECT *, row_number() OVER (PARTITION BY production_id, scene ORDER BY times DESC, note) AS common, row_number() OVER (PARTITION BY production_id, scene ORDER BY seq, note) AS early
  FROM (SELECT production_id, scene, note, count(*) AS times, min(seq) AS seq FROM w WHERE department = 'script' AND note <> '' GROUP BY ALL)),
d AS (SELECT production_id, scene, {_NOTES.format(k='common', most=2)} AS descriptions, {_NOTES.format(k='early', most=3)} AS comments FROM n GROUP BY ALL),
r AS (SELECT production_id, scene, count(DISTINCT take) AS takes, count(DISTINCT CASE WHEN starred THEN take END) AS circled, {_set('take', 'starred')} AS circled_takes,
  bool_or(contains(raw_take, 'VFX')) AS vfx, bool_or(contains(raw_take, 'PK')) AS pickup, {_CARDS} AS cards, {_ORDERED} AS days, {_set('doc_id')} AS documents FROM w GROUP BY ALL)
SELECT r.*, coalesce(descriptions, '') AS descriptions, coalesce(comments, '') AS comments FROM r LEFT JOIN d USING (production_id, scene)""")
_NORMAL = f"""WITH l AS (SELECT DISTINCT {_DAYS}, replace(slate, '-', '/') AS slate, take_id, camera_roll, clip_name, try_cast(substr(clip_name, 7) AS INT) AS clip FROM witness),
m AS (SELECT *, try_cast(regexp_extract(file_name, 'C([0-9]+)_', 1) AS INT) AS clip, regexp_extract(file_name, '^[A-Z]_0*([0-9]+)C', 1) AS roll,
  replace(regexp_extract(file_name, '^([0-9]+-[0-9]+)T', 1), '-', '/') AS wav_slate, try_cast(regexp_extract(file_name, 'T([0-9]+)[.]WAV$', 1) AS INT) AS wav_take FROM media),
x AS (SELECT l.production_id, l.shoot_day, slate, l.take_id, file_name FROM l JOIN m ON m.production_id = l.production_id AND m.shoot_day = l.shoot_day AND clip_name <> ''
    AND substr(file_name, 1, 1) = substr(clip_name, 1, 1) AND m.roll = CAST(CAST(substr(clip_name, 2, 3) AS INT) AS VARCHAR) AND m.clip = l.clip
  UNION SELECT l.production_id, l.shoot_day, l.slate, l.take_id, file_name FROM l JOIN m ON m.production_id = l.production_id AND m.shoot_day = l.shoot_day
    AND wav_slate = l.slate AND wav_take = CAST(l.take_id AS INT)
  UNION SELECT l.production_id, l.shoot_day, l.slate, l.take_id, file_name FROM l JOIN m ON m.production_id = l.production_id AND m.shoot_day = l.shoot_day
    AND m.scene || '/' || m.shot = l.slate AND m.shot <> m.scene AND CAST(m.take_id AS INT) = CAST(l.take_id AS INT)
    AND (m.camera_roll = '' OR l.camera_roll = '' OR m.camera_roll = l.camera_roll)) """
query("match_take_media", "witness media", lambda w, m: rollups.match_take_media(w.withColumn("slate", n.slate(F.col("slate"))), m), _NORMAL + f"SELECT {_DAYS}, slate, take_id, file_name FROM x")
_SAID = "arg_max(concat_ws(' ', camera_roll, sound_roll, timecode_in), struct_pack(s := seq, t := concat_ws(' ', camera_roll, sound_roll, timecode_in))) FILTER (WHERE department = '{0}') AS {0}_said"
query("take_rollup", "witness media", rollups.take_rollup, _NORMAL + f""",
f AS (SELECT {_DAYS}, slate, take_id, count(DISTINCT file_name) FILTER (WHERE NOT ends_with(file_name, '.WAV')) AS video_files, count(DISTINCT file_name) FILTER (WHERE ends_with(file_name, '.WAV')) AS audio_files,
  {_set('volume')} AS volumes FROM x JOIN (SELECT DISTINCT {_DAYS}, file_name, volume FROM media) USING ({_DAYS}, file_name) GROUP BY ALL),
w AS (SELECT {_DAYS}, replace(slate, '-', '/') AS slate, take_id, count(*) AS claims, {_CARDS} AS cards, {_set('substr(camera_roll, 1, 1)', "camera_roll <> ''")} AS angles, bool_or(coalesce(starred, false)) AS starred,
  bool_or(contains(raw_take, 'VFX')) AS vfx, bool_or(contains(raw_take, 'PK')) AS pickup, {_set('doc_id')} AS documents, count(DISTINCT department) AS departments,
  {", ".join(_SAID.format(d) for d in ("camera", "sound", "script"))} FROM witness GROUP BY {_DAYS}, replace(slate, '-', '/'), take_id)
SELECT w.*, coalesce(video_files, 0) AS video_files, coalesce(audio_files, 0) AS audio_files, coalesce(volumes, '') AS volumes FROM w LEFT JOIN f USING ({_DAYS}, slate, take_id)""")
query("sequence_flags", "findings", rollups.sequence_flags, _FINDINGS + "SELECT production_id, split_part(entity_id, '/', 1) AS scene, count(*) AS open, bool_or(severity = 'CRITICAL') AS critical FROM cur WHERE NOT resolved GROUP BY ALL")
query("shot_description", "witness", lambda w: rollups.shot_description(w.filter("department = 'script'").select("production_id", "slate", F.concat_ws(" ", "doc_id", "raw_take").alias("note"), "seq")), "WITH f AS (SELECT production_id, replace(slate, '-', '/') AS slate, doc_id || ' ' || raw_take AS note, min(seq) AS seq FROM witness WHERE department = 'script' GROUP BY production_id, replace(slate, '-', '/'), doc_id || ' ' || raw_take), r AS (SELECT *, row_number() OVER (PARTITION BY production_id, slate ORDER BY seq, note) AS n FROM f) SELECT production_id, slate, string_agg(note, '; ' ORDER BY n) AS description FROM r WHERE n <= 6 GROUP BY ALL")
query("slates_covered", "slate_ranges witness", rollups.slates_covered, f"WITH r AS (SELECT {_DAYS}, scene, arg_max(first, seq) AS f, arg_max(last, seq) AS l FROM slate_ranges GROUP BY ALL), e AS (SELECT {_DAYS}, scene, CASE WHEN contains(f, '/') THEN CAST(split_part(f, '/', 2) AS BIGINT) ELSE CAST(f AS BIGINT) END AS a, CAST(l AS BIGINT) AS b FROM r), s AS (SELECT {_DAYS}, scene, unnest(range(least(a, b), greatest(a, b) + 1)) AS shot FROM e), g AS (SELECT DISTINCT {_DAYS}, scene, CAST(split_part(replace(slate, '-', '/'), '/', 2) AS BIGINT) AS shot, 1 AS seen FROM witness) SELECT {_DAYS}, scene, count(*) AS stated, count(seen) AS covered FROM s LEFT JOIN g USING ({_DAYS}, scene, shot) GROUP BY ALL")
query("seconds_since_target_created", "user_activity requirement_events", lambda x, e: rollups.seconds_since_created(x, e).select("event_id", "target_id", "seconds"), "WITH r AS (SELECT requirement_id, min(created_at) AS raised FROM requirement_events GROUP BY ALL) SELECT event_id, target_id, CASE WHEN raised IS NOT NULL THEN greatest(0.0::DOUBLE, CAST(epoch_us(created_at) - epoch_us(raised) AS DOUBLE) / 1e6) END AS seconds FROM user_activity LEFT JOIN r ON requirement_id = target_id")
query("pre_editing_progress", "requirement_events", rollups.pre_editing_progress, _REQ_ONLY + "SELECT production_id, assignee, count(*) AS total, count(*) FILTER (WHERE status = 'resolved') AS done, array_to_string(list_slice(list(requirement_id ORDER BY updated_at DESC, requirement_id DESC), 1, 8), ',') AS recent, round(CAST(100 * count(*) FILTER (WHERE status = 'resolved') AS DOUBLE) / count(*), 1) AS share FROM req GROUP BY ALL")
query("character_lines", "lines", lambda x: rollups.character_lines(x, 5).select("script_id", "speaker", "scene", "place", "index"), "SELECT script_id, speaker, scene, place, index FROM (SELECT *, CAST(row_number() OVER (PARTITION BY script_id, speaker ORDER BY scene, place) AS INT) AS index FROM lines) WHERE index <= 5")
query("validate_vocabulary", "user_activity", lambda x: rollups.validated(x.withColumn("action", F.when(F.col("event_id") % 50 == 0, "danced").otherwise(F.col("action"))), {"action": ["viewed", "acknowledged", "created", "resolved"]}, ["actor", "shoot_day"])[1].groupBy("reason").agg(F.count("*").alias("rows")), "SELECT CASE WHEN shoot_day = '' THEN 'missing shoot_day' ELSE 'unknown action' END AS reason, count(*) AS rows FROM user_activity WHERE shoot_day = '' OR event_id % 50 = 0 OR action NOT IN ('viewed', 'acknowledged', 'created', 'resolved') GROUP BY ALL")
query("open_oldest_first", "requirement_events", rollups.open_oldest_first, _REQ_ONLY + "SELECT production_id, requirement_id, status, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY production_id ORDER BY raised_at, requirement_id) AS INT) AS place FROM req WHERE status IN ('blocked', 'open')) WHERE place <= 50")
query("open_findings", "findings", rollups.open_findings, _FINDINGS + "SELECT production_id, shoot_day, finding, severity, entity_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY production_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, created_at DESC, event_id) AS INT) AS place FROM cur WHERE NOT resolved) WHERE place <= 50")
_HOURS = f"round_even(greatest(0, CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(since) AS DOUBLE) / 3.6e9), 1)"
_URGENT = "array_to_string(list_transform(list_sort(list({{'k': place, 'i': id}}) FILTER (WHERE place <= 5)), lambda x: x.i), ',')".replace("{{", "{").replace("}}", "}")
query("production_status", "findings requirement_events witness", lambda f, e, w: rollups.production_status(rollups.status_items(f, e, w, NOW)), _FINDINGS + _REQ_ONLY.replace("WITH req", ", req") + f""",
filed AS (SELECT DISTINCT {_DAYS}, department FROM witness),
gap AS (SELECT d.production_id, d.shoot_day, e.department FROM (SELECT DISTINCT {_DAYS} FROM filed) d JOIN (SELECT DISTINCT production_id, department FROM filed) e USING (production_id)
  WHERE (d.production_id, d.shoot_day, e.department) NOT IN (SELECT (production_id, shoot_day, department) FROM filed)),
lastly AS (SELECT {_DAYS}, max(created_at) AS since FROM witness GROUP BY ALL),
item AS (SELECT production_id, CASE status WHEN 'resolved' THEN 'done' WHEN 'in_progress' THEN 'running' WHEN 'blocked' THEN 'blocking' ELSE 'left' END AS bucket, 'requirement' AS kind, requirement_id AS id,
    CASE WHEN priority IN ('critical', 'high', 'medium', 'low') THEN priority ELSE 'medium' END AS severity, CASE WHEN status = 'resolved' THEN updated_at ELSE raised_at END AS since FROM req
  UNION ALL SELECT production_id, CASE WHEN resolved THEN 'done' ELSE 'blocking' END, 'discrepancy', shoot_day || ':' || finding || ':' || entity_id,
    CASE WHEN severity = 'CRITICAL' THEN 'critical' ELSE 'high' END, created_at FROM cur
  UNION ALL SELECT production_id, 'missing', 'paperwork', shoot_day || ':' || department, 'high', since FROM gap JOIN lastly USING ({_DAYS})),
c AS (SELECT production_id, {", ".join(f"count(*) FILTER (WHERE bucket = '{b}') AS \"{b}\"" for b in rollups.BUCKETS)} FROM item GROUP BY ALL),
o AS (SELECT *, {_HOURS} AS age, row_number() OVER (PARTITION BY production_id ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, {_HOURS} DESC, kind, id) AS place
  FROM item WHERE bucket IN ('blocking', 'missing')),
u AS (SELECT production_id, {_URGENT} AS urgent, max(' Most urgent: ' || id || ' (' || severity || ' for ' || CAST(CAST(round(age) AS BIGINT) AS VARCHAR) || 'h).') FILTER (WHERE place = 1) AS top FROM o GROUP BY ALL)
SELECT c.*, coalesce(urgent, '') AS urgent, {" || ', ' || ".join(f"CAST(\"{b}\" AS VARCHAR) || ' {b}'" for b in rollups.BUCKETS)} || '.' || coalesce(top, '') AS headline FROM c LEFT JOIN u USING (production_id)""")
query("events_of_days", "witness", lambda w: w.groupBy("production_id", "shoot_day", "doc_id").agg(F.count("*").alias("events")), f"SELECT {_DAYS}, doc_id, count(*) AS events FROM witness GROUP BY ALL")
query("take_witnesses", "witness", lambda w: w.groupBy("production_id", n.slate(F.col("slate")).alias("slate"), n.take(F.col("raw_take"))["take_id"].alias("take")).agg(F.count("*").alias("claims")), """
SELECT production_id, replace(slate, '-', '/') AS slate, regexp_extract(raw_take, '^T?0*([0-9]+)', 1) || CASE WHEN contains(raw_take, 'PK') THEN 'PK' ELSE '' END AS take, count(*) AS claims FROM witness GROUP BY ALL""")
query("purge_documents", "witness", lambda w: ledger.purged(w, w.filter("doc_id in ('D1', 'D2')")).groupBy("doc_id").agg(F.count("*").alias("events")), "SELECT doc_id, count(*) AS events FROM witness WHERE doc_id NOT IN ('D1', 'D2') GROUP BY ALL")
query("locate_passages", "lines", lambda x: script.located(x, x.select(F.concat_ws(":", "scene", "place").alias("query"), "script_id", F.explode(n.anchor_terms(F.col("line"))).alias("term"))))

_STOP = """
a an and are as at be but by for from had has have he her hers him his how in into is it its of on onto or our out over she so that the their them then there these they this to up
was we were what when where which who will with you your
abandoned again alt angle camera cam circled close complete cont contd continued cover coverage cu cut day ecu end ext false good insert int lens mcu mos ms mws night note ots pickup
pov printed reset roll scene scenes series setup shot shots slate sound start tail take takes top vfx wide wild wt ws"""
#: Words of a line that anchor a passage.
_ANCHORS = (
    "list_filter(list_transform(regexp_extract_all(coalesce(line, ''), '[A-Za-z][A-Za-z''’-]{2,}'), lambda w: trim(replace(lower(w), '’', ''''), '''-')), lambda w: length(w) >= 3 AND w NOT IN ("
    + ", ".join(f"'{w}'" for w in _STOP.split()) + "))"
)
query("anchor_terms", "lines", lambda x: x.select("script_id", F.explode(n.anchor_terms(F.col("line"))).alias("term")).groupBy("script_id", "term").agg(F.count("*").alias("times")),
      f"SELECT script_id, term, count(*) AS times FROM (SELECT script_id, unnest({_ANCHORS}) AS term FROM lines) GROUP BY ALL")
#: Every window of one to three lines of every scene of the script, for every line's terms.
ORACLES["locate_passages"] = cte("lines") + f""",
t AS (SELECT DISTINCT script_id, scene, place, unnest({_ANCHORS}) AS term FROM lines),
w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY script_id, scene, term) AS weight FROM t),
hit AS (SELECT scene_q || ':' || place_q AS query, w.script_id, w.scene, w.place, w.term, w.weight
  FROM (SELECT script_id, scene AS scene_q, place AS place_q, term FROM t) q JOIN w USING (script_id, term)),
win AS (SELECT DISTINCT query, script_id, scene, size, place - back AS start, term, weight
  FROM hit, (VALUES (1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)) v(size, back) WHERE place - back >= 0),
sums AS (SELECT query, script_id, scene, size, start, round(sum(weight), 6) AS weight FROM win GROUP BY ALL HAVING round(sum(weight), 6) >= 1.0),
best AS (SELECT *, row_number() OVER (PARTITION BY query, script_id ORDER BY weight DESC, size, scene, start) AS n FROM sums)
SELECT query, script_id, scene, CAST(size AS INT) AS size, start, weight FROM best WHERE n = 1"""


def _stream_rate(name: str, table: str, count: str, by: str, job: Callable[[DataFrame], DataFrame], interval: str, late: str) -> None:
    """A streaming count over the table's rows: the windows that the watermark has closed."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, condition, columns = adapters.TABLES[table]
        path = f"{sf_dir}/{source}.parquet"
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        out = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        stream = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern of just this name
        stream = stream.filter(condition.format(div="div"))
        stream = stream.selectExpr(*[f"{e.format(div='div')} AS {c}" for c, e in columns.items()]).withColumn("created_at", F.col("created_at").cast("timestamp"))
        closed = job(stream)
        streaming.run_available(closed, streaming.keep_batch(f"{out}/table"), f"{out}/offsets")
        versions.discard(spark, f"{out}/offsets")
        return spark.read.schema(closed.schema).option("recursiveFileLookup", "true").parquet(f"{out}/table")

    QUERIES[name] = run
    counted = f"SELECT time_bucket(INTERVAL '{interval}', created_at) AS \"from\", {by}, count(*) AS {count} FROM {table} GROUP BY ALL"
    ORACLES[name] = cte(table) + f"SELECT * FROM ({counted}) WHERE \"from\" + INTERVAL '{interval}' <= (SELECT max(created_at) FROM {table}) - INTERVAL '{late}'"


_stream_rate("stream_filing_rate", "witness", "events", "department", streaming.filing_rate, "1 day", "7 days")
_stream_rate("stream_action_rate", "user_activity", "acts", "action", streaming.action_rate, "1 hour", "2 hours")

QUERIES |= report_queries.QUERIES
ORACLES |= report_queries.ORACLES
