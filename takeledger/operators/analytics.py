"""Questions over whole productions. Every job is keyed by production_id, never filtered by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.operators.ledger import first_value, latest, latest_value
from takeledger.operators.quantiles import with_quantiles

P = "production_id"
DAY = [P, "shoot_day"]
#: Acts that change something, and severities from the worst.
MUTATIONS = ["created", "updated", "resolved"]
SEVERITIES = ["CRITICAL", "WARNING", "INFO"]


def joined_set(c, when=None):
    """Sorted distinct values as one comma-separated text."""
    value = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.sort_array(F.collect_set(value if when is None else F.when(when, value))), ",")


def spread(rows: DataFrame, *arrays: str) -> DataFrame:
    """One row for each place of a row's arrays, side by side; `once` holds on one of them.

    Sets over them combine before a shuffle and are as wide as what they hold, however many arrays.
    """
    others = [c for c in rows.columns if c not in arrays]
    whole = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in arrays})
    laid = whole.select(*others, F.posexplode_outer(F.arrays_zip(*arrays)).alias("place", "x"))
    return laid.select(*others, *[F.col(f"x.{c}").alias(c) for c in arrays], (F.coalesce("place", F.lit(0)) == 0).alias("once"))


def production_shape(events: DataFrame) -> DataFrame:
    return events.groupBy(P, "axis", "department").agg(F.count("*").alias("events"), F.countDistinct("shoot_day").alias("days"))


def department_arrivals(events: DataFrame) -> DataFrame:
    return events.groupBy(*DAY, "department").agg(F.count("*").alias("events"), F.min("created_at").alias("first_filed"), F.max("created_at").alias("last_filed"))


def roll_disagreements(events: DataFrame) -> DataFrame:
    """One camera of a take on several rolls, said by several departments. The payload is parsed once."""
    takes = events.filter(F.col("entity_type") == "take").select(*DAY, "department", F.json_tuple("payload_json", "slate", "take_id", "camera_roll").alias("slate", "take_id", "camera_roll"))
    key = [*DAY, "slate", "take_id", "camera"]
    said = takes.filter("camera_roll <> ''").withColumn("camera", F.substring("camera_roll", 1, 1)).select(*key, "camera_roll", "department").distinct()
    # distinct claims combine by hash before they are gathered (as lists: under sets Catalyst drops the distinct)
    whole = lambda c: F.array_distinct(F.collect_list(c))
    found = said.groupBy(*key).agg(whole("camera_roll").alias("r"), whole("department").alias("d"))
    found = found.filter((F.size("r") > 1) & (F.size("d") > 1))
    return found.select(*DAY, "slate", "take_id", "camera", F.array_join(F.sort_array("r"), ",").alias("rolls"), F.array_join(F.sort_array("d"), ",").alias("witnesses"))


def scene_coverage(events: DataFrame) -> DataFrame:
    """Days, slates, takes and departments of each scene, counted over what differs already."""
    takes = events.filter("slate <> ''").withColumn("scene", n.scene_of_slate(F.col("slate"))).filter(F.col("scene").rlike("^[0-9]"))
    each = takes.groupBy(P, "scene", "slate").agg(F.collect_set("shoot_day").alias("days"), F.collect_set("department").alias("departments"), F.count("*").alias("takes"))
    found = spread(each, "days", "departments").groupBy(P, "scene").agg(F.collect_set("days").alias("d"), F.count_if("once").alias("slates"), F.sum(F.when(F.col("once"), F.col("takes"))).alias("takes"), F.collect_set("departments").alias("by"))
    return found.select(P, "scene", F.size("d").cast("long").alias("days"), F.array_join(F.sort_array("d"), ",").alias("shoot_days"), "slates", "takes", F.array_join(F.sort_array("by"), ",").alias("departments"))


def current_findings(snapshots: DataFrame) -> DataFrame:
    """The newest row of each finding; readers collapse what every run wrote again."""
    return latest(snapshots, [*DAY, "finding", "entity_id"], ["created_at", "event_id"])


def discrepancy_health(snapshots: DataFrame) -> DataFrame:
    now = current_findings(snapshots)
    return now.groupBy(P, "finding", "severity").agg(
        F.count_if(F.expr("not resolved")).alias("open"), F.count_if(F.expr("resolved")).alias("resolved"),
        joined_set("shoot_day", ~F.col("resolved")).alias("open_days"), F.min(F.when(~F.col("resolved"), F.col("description"))).alias("example"),
    )


def editorial_state(tags: DataFrame) -> DataFrame:
    order = ["created_at", "event_id"]
    now = tags.groupBy(P, "target_type", "target_id").agg(latest_value("status", order).alias("status"), latest_value("action", order).alias("action"))
    return now.filter("action <> 'cleared' and status <> ''").groupBy(P, "status").agg(F.count("*").alias("targets"))


def requirement_ageing(events: DataFrame, now: str) -> DataFrame:
    """Hour marks between raising and resolving, or now."""
    each = events.groupBy(P, "requirement_id").agg(F.min("created_at").alias("raised"), F.max(F.when(F.col("action") == "resolved", F.col("created_at"))).alias("resolved"), F.max((F.col("status") == "blocked").cast("int")).alias("blocked"))
    hours = n.hour_boundaries(F.col("raised"), F.coalesce("resolved", F.lit(now).cast("timestamp")))
    return each.withColumn("hours", hours).groupBy(P).agg(F.count("*").alias("requirements"), F.round(F.avg("hours"), 1).alias("avg_hours_open"), F.max("hours").alias("longest_hours_open"), F.sum("blocked").alias("ever_blocked"))


def department_sync_lag(events: DataFrame, dates: DataFrame, wraps: DataFrame) -> DataFrame:
    order = ["created_at", "seq"]
    wrapped = wraps.groupBy(*DAY).agg(latest_value("wrap_time", order).alias("wrap_time"))
    dated = dates.groupBy(*DAY).agg(first_value("date", order).alias("shoot_date"))
    filed = events.groupBy(*DAY, "department").agg(F.min("created_at").alias("first_filed"), F.count("*").alias("events"))
    return filed.join(dated, DAY, "left").join(wrapped, DAY, "left")


def sync_matrix(events: DataFrame, dates: DataFrame, wraps: DataFrame, hours: float = n.HANDOVER_HOURS) -> DataFrame:
    """Filing lags with their class; days that state no wrap or date keep a null lag."""
    rows = department_sync_lag(events, dates, wraps).withColumn("wrapped_at", n.wrap_moment(F.col("shoot_date"), F.col("wrap_time")))
    lag = n.lag_seconds(F.col("wrapped_at"), F.col("first_filed"))
    return rows.withColumn("lag_seconds", lag).withColumn("measurement", n.classify_lag(F.col("lag_seconds"), hours)).withColumn("measurable", F.col("lag_seconds").isNotNull())


def time_to_acknowledge(activity: DataFrame, by: list[str], positive: bool = False) -> DataFrame:
    acts = activity.filter("action = 'acknowledged' and lag is not null" + (" and lag > 0" if positive else ""))
    minutes = F.col("lag") / 60
    totals = acts.groupBy(P, *by).agg(F.count("*").alias("acknowledged"), F.round(F.avg(minutes), 3).alias("avg_minutes"), F.round(F.max(minutes), 3).alias("max_minutes"))
    return with_quantiles(totals, acts, [P, *by], minutes, {"median_minutes": 0.5}).withColumn("median_minutes", F.round("median_minutes", 3))


def latest_requirements(events: DataFrame) -> DataFrame:
    order = ["created_at", "event_id"]
    return events.groupBy(P, "requirement_id").agg(*[latest_value(c, order).alias(c) for c in ("status", "priority", "assignee", "action")], F.min("created_at").alias("raised_at"), F.max("created_at").alias("updated_at"))


def unacknowledged(events: DataFrame, activity: DataFrame) -> DataFrame:
    """Requirements nobody has acknowledged; the trail is aggregated before the join."""
    acks = activity.filter("target_type = 'requirement'").groupBy(F.col("target_id").alias("requirement_id")).agg(F.count_if(F.expr("action = 'acknowledged'")).alias("acks"))
    return latest_requirements(events).join(acks, "requirement_id", "left").filter("coalesce(acks, 0) = 0").drop("acks")


def unacknowledged_blocking(events: DataFrame, activity: DataFrame, top: int = 50) -> DataFrame:
    """Open ones by the day they were raised on, newest first, `top` a day."""
    from takeledger.operators.ledger import history

    days = events.groupBy(P, "requirement_id").agg(first_value("shoot_day", ["created_at", "event_id"]).alias("shoot_day"))
    open_ = unacknowledged(events, activity).filter("status in ('open', 'in_progress', 'blocked')").join(days, [P, "requirement_id"])
    return history(open_, DAY, ["updated_at", "requirement_id"], top)


def unreviewed_days(events: DataFrame, activity: DataFrame) -> DataFrame:
    filed = events.groupBy(*DAY).agg(F.count("*").alias("events"))
    seen = activity.groupBy(*DAY).agg(F.count_if(F.expr("action = 'viewed'")).alias("views"), F.count_if(F.expr("action = 'acknowledged'")).alias("acks"), joined_set("actor").alias("seen_by"))
    return filed.join(seen, DAY, "left").select(*DAY, "events", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("acks", F.lit(0)).alias("acks"), F.coalesce("seen_by", F.lit("")).alias("seen_by"))


def department_attention(activity: DataFrame) -> DataFrame:
    return activity.groupBy(P, "department", "actor").agg(F.count_if(F.expr("action = 'viewed'")).alias("views"), F.count_if(F.expr("action = 'acknowledged'")).alias("acks"), F.countDistinct("target_id").alias("targets"), F.max("created_at").alias("last_seen"))


def attributed(activity: DataFrame) -> DataFrame:
    """Without rows whose actor was a default; unknown sources stay."""
    return activity.filter("coalesce(actor_source, '') <> 'default'")


def actions_by_actor_and_day(activity: DataFrame) -> DataFrame:
    return attributed(activity).groupBy(*DAY, "actor").agg(F.count_if(F.col("action").isin(MUTATIONS)).alias("mutations"), F.count_if(F.expr("action = 'viewed'")).alias("views"), F.countDistinct("target_type", "target_id").alias("targets"), F.min("created_at").alias("first_act"), F.max("created_at").alias("last_act"))


def actions_by_department_and_hour(activity: DataFrame) -> DataFrame:
    return activity.groupBy(P, "department", F.hour("created_at").alias("hour")).agg(F.count("*").alias("actions"))


def first_touch_lag(events: DataFrame, activity: DataFrame) -> DataFrame:
    """Minutes until each requirement's assignee did anything to it but create it."""
    raised = events.groupBy(P, "requirement_id").agg(F.min("created_at").alias("raised"), first_value("assignee", ["created_at", "event_id"]).alias("actor"))
    touched = activity.filter("target_type = 'requirement' and action <> 'created'").groupBy(F.col("target_id").alias("requirement_id"), "actor").agg(F.min("created_at").alias("touched"))
    return raised.join(touched, ["requirement_id", "actor"], "left").withColumn("minutes", (n.micros(F.col("touched")) - n.micros(F.col("raised"))) / 6e7)


def first_touch_percentiles(events: DataFrame, activity: DataFrame) -> DataFrame:
    lag = first_touch_lag(events, activity)
    shares = {"median_minutes": 0.5, "p90_minutes": 0.9}
    totals = lag.groupBy(P, "actor").agg(F.count("*").alias("requirements"), F.count("touched").alias("touched"))
    return with_quantiles(totals, lag, [P, "actor"], F.col("minutes"), shares).withColumns({c: F.round(c, 2) for c in shares})


def requirements_by_day_and_role(events: DataFrame, crew: DataFrame) -> DataFrame:
    """Latest assignee's role against the day of raising. crew: handle, role."""
    days = events.groupBy(P, "requirement_id").agg(first_value("shoot_day", ["created_at", "event_id"]).alias("shoot_day"))
    return latest_requirements(events).join(days, [P, "requirement_id"]).join(crew, F.col("assignee") == F.col("handle")).groupBy(*DAY, "role").agg(F.count("*").alias("requirements"))


def take_throughput(events: DataFrame) -> DataFrame:
    rolls = events.filter("entity_type = 'take' and camera_roll <> ''")
    return rolls.groupBy(*DAY, "camera_roll").agg(F.count("*").alias("takes"), F.min("created_at").alias("first_take"), F.max("created_at").alias("last_take"), ((n.micros(F.max("created_at")) - n.micros(F.min("created_at"))) / 6e7).alias("minutes"))


def discrepancy_age(snapshots: DataFrame, now: str) -> DataFrame:
    age = n.hours_between(F.col("created_at"), F.lit(now).cast("timestamp"))
    return current_findings(snapshots).filter("not resolved").withColumn("age", age).groupBy(P, "finding", "severity").agg(F.count("*").alias("open"), F.round(F.avg("age"), 2).alias("avg_hours"), F.max("age").alias("max_hours"))


def sound_camera_agreement(events: DataFrame) -> DataFrame:
    """How often each sound roll goes with each camera roll on the same take."""
    take = [*DAY, "slate", "take_id"]
    sound = events.filter("sound_roll <> ''").select(*take, "sound_roll").distinct()
    camera = events.filter("camera_roll <> ''").select(*take, "camera_roll").distinct()
    return sound.join(camera, take).groupBy(P, "sound_roll", "camera_roll").agg(F.count("*").alias("takes"))


def cross_day_patterns(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """What comes back over the days of a production: (P, pattern, value, days, times, rate).

    finding: a kind of finding, on so many days, raised so often, resolved at that rate. rolls: two
    rolls said of one camera on a take, on so many days and takes. sound_roll: takes of a sound
    roll, on so many days, and the rate of those whose camera rolls disagree.
    """
    row = lambda pattern, value, days, times, rate: [P, F.lit(pattern).alias("pattern"), value.alias("value"), days.cast("long").alias("days"), times.cast("long").alias("times"), F.round(rate, 4).alias("rate")]
    kinds = current_findings(snapshots).groupBy(P, "finding", "shoot_day").agg(F.count("*").alias("n"), F.count_if(F.expr("resolved")).alias("r")).groupBy(P, "finding").agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.sum("r").alias("r"))
    letter = F.substring("camera_roll", 1, 1)
    rolls = events.groupBy(*DAY, "slate", "take_id", letter.alias("camera")).agg(F.collect_set(F.when(F.col("camera_roll") != "", F.col("camera_roll"))).alias("rolls")).filter("camera <> ''")
    apart = rolls.filter(F.size("rolls") > 1).withColumn("a", F.explode("rolls")).withColumn("b", F.explode("rolls")).filter("a < b")
    pairs = apart.groupBy(P, "a", "b", "shoot_day").agg(F.count("*").alias("n")).groupBy(P, "a", "b").agg(F.count("*").alias("d"), F.sum("n").alias("n"))
    doubtful = rolls.groupBy(*DAY, "slate", "take_id").agg(F.bool_or(F.size("rolls") > 1).alias("apart"))
    sound = events.filter("sound_roll <> ''").select(*DAY, "slate", "take_id", "sound_roll").distinct().join(doubtful, [*DAY, "slate", "take_id"], "left")
    per = sound.groupBy(P, "sound_roll", "shoot_day").agg(F.count("*").alias("n"), F.count_if(F.coalesce("apart", F.lit(False))).alias("x")).groupBy(P, "sound_roll").agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.sum("x").alias("x"))
    return (
        kinds.select(*row("finding", F.col("finding"), F.col("d"), F.col("n"), F.col("r") / F.col("n")))
        .unionByName(pairs.select(*row("rolls", F.concat_ws(",", "a", "b"), F.col("d"), F.col("n"), F.lit(1.0))))
        .unionByName(per.select(*row("sound_roll", F.col("sound_roll"), F.col("d"), F.col("n"), F.col("x") / F.col("n"))))
    )


def open_by_severity(snapshots: DataFrame) -> DataFrame:
    now = current_findings(snapshots)
    return now.groupBy(P).agg(F.count_if(F.expr("not resolved and severity = 'CRITICAL'")).alias("critical"), F.count_if(F.expr("not resolved and severity = 'WARNING'")).alias("warning"), F.count_if(F.expr("resolved")).alias("resolved"))


def last_filing(events: DataFrame, now: str) -> DataFrame:
    return events.groupBy(P, "department").agg(F.max("created_at").alias("last_filed"), F.count("*").alias("events"), F.countDistinct("shoot_day").alias("days")).withColumn("minutes_ago", F.floor((n.micros(F.lit(now).cast("timestamp")) - n.micros(F.col("last_filed"))) / 60_000_000))


def takes_per_day(events: DataFrame) -> DataFrame:
    """Takes, slates, marks and rows without a roll of each day, counted over the takes."""
    raw = F.col("raw_take")
    each = events.select(*DAY, "slate", "take_id", F.coalesce("starred", F.lit(False)).alias("starred"), n.is_pickup(raw).alias("pickup"), n.is_vfx(raw).alias("vfx"), (F.col("camera_roll") == "").alias("bare"))
    each = each.groupBy(*DAY, "slate", "take_id").agg(*[F.count_if(F.col(c)).alias(c) for c in ("starred", "pickup", "vfx", "bare")])
    slates = each.groupBy(*DAY, "slate").agg(F.count("*").alias("takes"), *[F.sum(c).alias(c) for c in ("starred", "pickup", "vfx", "bare")])
    return slates.groupBy(*DAY).agg(F.sum("takes").alias("takes"), F.count("*").alias("slates"), F.sum("starred").alias("starred"), F.sum("pickup").alias("pickups"), F.sum("vfx").alias("vfx"), F.sum("bare").alias("without_roll"))


def requirement_state(events: DataFrame) -> DataFrame:
    return latest_requirements(events).filter("action <> 'deleted'").groupBy(P, "status", "priority").agg(F.count("*").alias("requirements"))


def productions_overview(events: DataFrame) -> DataFrame:
    takes = events.groupBy(*DAY, "slate", "take_id").agg(F.count("*").alias("events"), F.max("created_at").alias("last"))
    days = takes.groupBy(*DAY).agg(F.count("*").alias("takes"), F.sum("events").alias("events"), F.max("last").alias("last"))
    return days.groupBy(P).agg(joined_set("shoot_day").alias("days"), F.sum("events").alias("events"), F.sum("takes").alias("takes"), F.max("last").alias("last_activity"))


#: The kinds of findings.
FINDINGS = [
    "CIRCLED_TAKE_MISMATCH", "TIMECODE_DRIFT", "ROLL_MISMATCH", "PAPERWORK_WITHOUT_MEDIA", "MEDIA_WITHOUT_PAPERWORK", "AWAITING_OFFLOAD",
    "SCENE_COMPLETE_WITHOUT_MATERIAL", "SCENE_SCHEDULED_NOT_SHOT", "SCENE_SHOT_NOT_SCHEDULED", "SLATE_OUTSIDE_STATED_RANGE", "SHOOT_DATE_DISAGREEMENT",
]


def active_discrepancies(snapshots: DataFrame) -> DataFrame:
    """Open findings of each production by kind and severity, zeros included."""
    counts = current_findings(snapshots).filter("not resolved").groupBy(P, "finding", "severity").agg(F.count("*").alias("open"))
    grid = snapshots.select(P).distinct().withColumn("finding", F.explode(F.lit(FINDINGS))).withColumn("severity", F.explode(F.lit(SEVERITIES)))
    return grid.join(counts, [P, "finding", "severity"], "left").fillna(0, ["open"])


def rejection_counts(rejected: DataFrame) -> DataFrame:
    """Refused documents by kind and kind of error."""
    return rejected.groupBy("doc_type", "error_type").agg(F.count("*").alias("rejections"))


#: Documents that record what people did to the tool, not paperwork of the shoot.
AUDIT = ["requirement_event", "production_crew_event", "discrepancy_resolution"]


def paperwork_only(events: DataFrame) -> DataFrame:
    return events.filter(~F.coalesce("doc_type", F.lit("")).isin(AUDIT))


def ingest_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("department", "axis").agg(F.count("*").alias("events"))


#: What tags may say: how far a target is, what it waits for, what it is.
STATUSES = ["finished_shooting", "covered_per_script", "ready_to_edit", "mounted", "finished", "picture_lock", "colour_sound_vfx", "conformed", "dcp"]
NEEDS = ["sfx", "subtitles", "translation"]
DESCRIPTORS = ["establishment"]


def tag_summary(tags: DataFrame, statuses: list[str] = STATUSES, needs: list[str] = NEEDS, descriptors: list[str] = DESCRIPTORS) -> DataFrame:
    """Targets of each production by current status, without one, by each need and each descriptor.

    Every known value has a row, zero where no target has it; values outside the lists are not
    counted. needs and descriptors are comma-separated.
    """
    now = latest(tags, [P, "target_type", "target_id"], ["created_at", "event_id"]).filter("action <> 'cleared'")
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    many = lambda kind, c: F.transform(F.array_distinct(F.split(F.coalesce(c, F.lit("")), ",")), lambda v: row(kind, v))
    status = F.when(F.coalesce("status", F.lit("")) == "", row("no_status", F.lit(""))).otherwise(row("status", F.col("status")))
    own = F.concat(F.array(status), many("need", F.col("needs")), many("descriptor", F.col("descriptors")) if "descriptors" in now.columns else F.array().cast("array<struct<kind:string,value:string>>"))
    counts = now.select(P, F.inline(own)).groupBy(P, "kind", "value").agg(F.count("*").alias("targets"))
    known = [("no_status", ""), *[("status", v) for v in statuses], *[("need", v) for v in needs], *[("descriptor", v) for v in descriptors]]
    grid = tags.select(P).distinct().select(P, F.inline(F.array(*[row(k, F.lit(v)) for k, v in known])))
    return grid.join(counts, [P, "kind", "value"], "left").fillna(0, ["targets"])


def scene_evidence(events: DataFrame) -> DataFrame:
    """What there is of each scene: days, takes, circled takes, documents, and who filed what.

    Different values are counted as such, spread over the tasks: no row holds a scene's takes.
    """
    has = {"script": F.col("department") == "script", "camera": F.col("department") == "camera", "sound": F.col("department") == "sound", "existence": F.col("axis") == "existence", "vfx": n.is_vfx(F.col("raw_take")), "wild": F.upper("slate").rlike("(^|[/_ -])WT$")}
    flags = [F.bool_or(F.coalesce(c, F.lit(False))).alias(f"has_{k}") for k, c in has.items()]
    each = events.groupBy(P, "scene", "slate", "take_id", "shoot_day", "doc_id").agg(F.bool_or(F.coalesce("starred", F.lit(False))).alias("starred"), *flags)
    take = F.struct("slate", "take_id")
    return each.groupBy(P, "scene").agg(F.count_distinct("shoot_day").alias("days"), F.count_distinct(take).alias("takes"), F.count_distinct(F.when(F.col("starred"), take)).alias("circled"), F.count_distinct("doc_id").alias("documents"), *[F.bool_or(f"has_{k}").alias(f"has_{k}") for k in has])


def media_offloaded(media: DataFrame) -> DataFrame:
    """Files, bytes, frames and different checksums of each volume and roll of a day."""
    each = media.groupBy(*DAY, "volume", "camera_roll", "checksum").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum("frames").alias("frames"))
    return each.groupBy(*DAY, "volume", "camera_roll").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("frames").alias("frames"), F.count("checksum").alias("checksums"))


def discrepancy_cuts(snapshots: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Open findings by day, kind, slate, and by the rolls, departments and documents that speak of them.

    witnesses: P, shoot_day, finding, entity_id, roll, department, doc_id; one row a claim. A
    finding counts once for each different value.
    """
    key = [*DAY, "finding", "entity_id"]
    open_ = current_findings(snapshots).filter("not resolved").select(*key)
    cut = lambda name, value: F.struct(F.lit(name).alias("cut"), F.col(value).alias("value"))
    own = open_.select(P, F.explode(F.array(cut("day", "shoot_day"), cut("kind", "finding"), cut("slate", "entity_id"))).alias("c"))
    claims = open_.join(witnesses.select(*key, "roll", "department", "doc_id"), key)
    said = claims.select(*key, F.explode(F.array(cut("roll", "roll"), cut("department", "department"), cut("document", "doc_id"))).alias("c")).filter("c.value <> ''").distinct()
    return own.union(said.select(P, "c")).groupBy(P, F.col("c.cut").alias("cut"), F.col("c.value").alias("value")).agg(F.count("*").alias("open"))
