"""Ranked work: blockers, candidate scenes and who gets them, workload, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.operators import analytics as a
from takeledger.operators.ledger import first_value, latest

P = "production_id"
DAY = [P, "shoot_day"]


def rank_blockers(snapshots: DataFrame, events: DataFrame, activity: DataFrame, now: str, top: int = 10) -> DataFrame:
    """Open findings and unacknowledged open requirements of each production and day, worst first.

    Score: 90, 60 or 25 by severity and a point a day of age up to 14; a requirement is CRITICAL
    or else a WARNING, and gets 20 as it waits for acknowledgement and 8 as a requirement. Ties go
    by priority, label and key, all as text.
    """
    moment = F.lit(now).cast("timestamp")
    days = lambda c: F.least(F.lit(14.0), n.hours_between(c, moment) / 24)
    severity = F.col("severity")
    base = F.when(severity == "CRITICAL", 90.0).when(severity == "WARNING", 60.0).otherwise(25.0)
    priority = F.when(severity == "CRITICAL", "critical").when(severity == "WARNING", "high").otherwise("medium")
    target = F.when(F.contains("finding", F.lit("SCENE")), "Scene").when(F.contains("finding", F.lit("SLATE")), "Shot").otherwise("Take")
    findings = a.current_findings(snapshots).filter("not resolved").select(
        *DAY, F.lit("finding").alias("source"), F.concat_ws(":", F.lit("discrepancy"), "finding", "entity_id").alias("key"), F.concat_ws(" ", target, "entity_id").alias("label"), priority.alias("priority"),
        F.round(base + days(F.col("created_at")), 2).alias("score"),
    )
    raised_on = events.groupBy(P, "requirement_id").agg(first_value("shoot_day", ["created_at", "event_id"]).alias("shoot_day"))
    level = F.when(F.col("priority") == "critical", 90.0).otherwise(60.0)
    known = F.when(F.col("priority").isin("low", "medium", "high", "critical"), F.col("priority")).otherwise("medium")
    waiting = a.unacknowledged(events, activity).filter("status in ('open', 'in_progress', 'blocked')").join(raised_on, [P, "requirement_id"]).select(
        *DAY, F.lit("requirement").alias("source"), F.concat(F.lit("requirement:"), "requirement_id", F.lit(":unacknowledged")).alias("key"), F.concat_ws(" ", F.lit("Requirement"), "requirement_id").alias("label"), known.alias("priority"),
        F.round(level + 28 + days(F.col("raised_at")), 2).alias("score"),
    )
    w = Window.partitionBy(*DAY).orderBy(F.desc("score"), "priority", "label", "key")
    return findings.unionByName(waiting).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def blocked_scenes(events: DataFrame) -> DataFrame:
    """(P, scene) of requirements that are not resolved; their target is a scene, or begins with one."""
    scene = F.when(F.col("target_type") == "scene", F.col("target_id")).otherwise(F.substring_index("target_id", "/", 1))
    return latest(events, [P, "requirement_id"], ["created_at", "event_id"]).filter("status <> 'resolved'").select(P, scene.alias("scene")).filter("scene <> ''")


def candidate_scenes(witnesses: DataFrame, snapshots: DataFrame, blocked: DataFrame, queued: DataFrame, top: int = 100) -> DataFrame:
    """Scenes with three reasons and material on disk, by clean score, the first `top`.

    Scenes with an open finding, blocked by a requirement or queued already are left out. blocked
    and queued: P, scene.
    """
    seen = a.scene_evidence(witnesses)
    is_ = lambda c: F.col(c).cast("int")
    reasons = is_("has_script") + is_("has_camera") + (F.col("has_sound") | F.col("has_wild")).cast("int") + is_("has_existence") + (F.col("circled") > 0).cast("int")
    score = F.col("takes") * 4 + F.col("documents") * 2 + F.col("circled") * 18 + is_("has_script") * 12 + is_("has_camera") * 12 + is_("has_sound") * 8 + is_("has_existence") * 20 - is_("has_vfx") * 6
    open_ = a.current_findings(snapshots).filter("not resolved").select(P, F.substring_index("entity_id", "/", 1).alias("scene"))
    taken = open_.union(blocked.select(P, "scene")).union(queued.select(P, "scene")).distinct()
    clean = seen.filter((F.col("takes") > 0) & (reasons >= 3) & F.col("has_existence")).join(taken, [P, "scene"], "left_anti").withColumn("score", score)
    w = Window.partitionBy(P).orderBy(F.desc("score"), F.desc("circled"), F.desc("takes"), "scene")
    return clean.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(P, "scene", "takes", "circled", "documents", "score", "rank")


def assigned(candidates: DataFrame, load: DataFrame, top: int) -> DataFrame:
    """The first `top` scenes of each production dealt to the least loaded, ties by handle.

    Instead of a loop: every assistant offers slots at the loads it would pass through, the
    slots ordered by (load, handle) are exactly the order of a greedy deal. load: P, handle, load.
    """
    slots = load.withColumn("level", F.explode(F.sequence(F.col("load"), F.col("load") + top - 1)))
    slots = slots.withColumn("rank", F.row_number().over(Window.partitionBy(P).orderBy("level", F.lower("handle")))).filter(F.col("rank") <= top)
    return candidates.filter(F.col("rank") <= top).join(slots.select(P, "rank", "handle"), [P, "rank"])


#: Priorities from the most urgent.
PRIORITIES = ["critical", "high", "medium", "low"]


def _urgency(priority: Column) -> Column:
    return F.coalesce(F.array_position(F.lit(PRIORITIES), priority), F.lit(0)).cast("int")


def crew_workload(crew: DataFrame, events: DataFrame, most: int = 5) -> DataFrame:
    """Open requirements of every crew member; unknown handles are external, none unassigned.

    With the latest change and the current items: the `most` first by priority, then the newest.
    """
    open_ = a.latest_requirements(events).filter("status <> 'resolved'").withColumn("handle", n.handle(F.col("assignee"), "@unassigned"))
    rank = F.when(_urgency(F.col("priority")) == 0, 9).otherwise(_urgency(F.col("priority")))
    place = F.row_number().over(Window.partitionBy("handle").orderBy(rank, F.desc("updated_at"), "requirement_id"))
    first = open_.withColumn("place", place).filter(F.col("place") <= most).groupBy("handle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "requirement_id"))), lambda x: x["requirement_id"]), ",").alias("current"))
    load = open_.groupBy("handle").agg(F.count("*").alias("open"), F.count_if(F.expr("status = 'blocked'")).alias("blocked"), F.max("updated_at").alias("last_change"))
    kind = F.when(F.col("role").isNotNull(), "crew").when(F.col("handle") == "@unassigned", "unassigned").otherwise("external")
    members = crew.select(n.handle(F.col("handle")).alias("handle"), "role").join(load.join(first, "handle"), "handle", "full")
    return members.select("handle", kind.alias("kind"), F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("blocked", F.lit(0)).alias("blocked"), "last_change", F.coalesce("current", F.lit("")).alias("current"))


def workload_order(load: DataFrame, most: int = 50) -> DataFrame:
    """The members with the most open work first; ties by handle."""
    w = Window.orderBy(F.desc("open"), "handle")
    return load.orderBy(F.desc("open"), "handle").limit(most).withColumn("place", F.row_number().over(w))


def missing_paperwork(events: DataFrame) -> DataFrame:
    """Departments of a production that filed on other days but not on this one."""
    filed = events.select(*DAY, "department").distinct()
    due = filed.select(*DAY).distinct().join(filed.select(P, "department").distinct(), P)
    return due.join(filed, [*DAY, "department"], "left_anti")


def setup_gaps(productions: DataFrame, crew: DataFrame, events: DataFrame, scripts: DataFrame) -> DataFrame:
    """Productions without active crew, without any event, or without a script."""
    lacks = lambda other, what: productions.select(P).distinct().join(other.select(P).distinct(), P, "left_anti").withColumn("missing", F.lit(what))
    return lacks(crew, "crew").union(lacks(events, "events")).union(lacks(scripts, "script"))


def editorial_progress(known: DataFrame, tags: DataFrame, statuses: list[str]) -> DataFrame:
    """Known targets against their tags: how many have each status (zeros included), none, or a
    tag without being known, and how many still owe each need.

    known: P, target_type, target_id. Rows: P, target_type, kind (state, need), value, targets.
    """
    now = latest(tags, [P, "target_type", "target_id"], ["created_at", "event_id"]).filter("action <> 'cleared'")
    key = [P, "target_type", "target_id"]
    both = known.select(*key).distinct().withColumn("known", F.lit(1)).join(now.filter("status <> ''").select(*key, "status"), key, "full")
    state = F.when(F.col("known").isNull(), "tagged_but_unknown").otherwise(F.coalesce("status", F.lit("no_status")))
    counts = both.groupBy(P, "target_type", F.lit("state").alias("kind"), state.alias("value")).agg(F.count("*").alias("targets"))
    grid = both.select(P, "target_type").distinct().select(P, "target_type", F.lit("state").alias("kind"), F.explode(F.lit([*statuses, "no_status", "tagged_but_unknown"])).alias("value"))
    states = grid.join(counts, [P, "target_type", "kind", "value"], "full").fillna(0, ["targets"])
    owed = now.filter("status <> 'done'").select(P, "target_type", F.lit("need").alias("kind"), F.explode(F.split("needs", ",")).alias("value")).filter("value <> ''")
    return states.unionByName(owed.groupBy(P, "target_type", "kind", "value").agg(F.count("*").alias("targets")))


def outstanding(tags: DataFrame, needs: list[str]) -> DataFrame:
    """(P, need, target_type, target_id, status): every target that waits for each kind of work."""
    now = latest(tags, [P, "target_type", "target_id"], ["created_at", "event_id"]).filter("action <> 'cleared'")
    each = now.select(P, F.explode(F.array_distinct(F.split("needs", ","))).alias("need"), "target_type", "target_id", F.coalesce("status", F.lit("")).alias("status"))
    return each.filter(F.col("need").isin(needs))


def listed(rows: DataFrame, order: list[str], most: int, **wanted: object) -> DataFrame:
    """Rows with all the wanted values, newest first by `order`, the first `most`.

    A value for a column of text is compared without case; for a comma-separated list column
    (needs, descriptors) it has to be among them; None asks for nothing.
    """
    for c, value in wanted.items():
        if value is not None:
            text = F.lower(F.col(c).cast("string"))
            same = text == F.lit(str(value).lower())
            rows = rows.filter(F.array_contains(F.split(text, ","), str(value).lower()) if c in ("needs", "descriptors") else same)
    return rows.orderBy(*[F.desc(c) for c in order]).limit(most)


def take_requirements(takes: DataFrame, requirements: DataFrame) -> DataFrame:
    """Requirements on each take, its shot or its scene. requirements: P, target_type, target_id, status."""
    keys = F.explode(F.array(F.struct(F.lit("take").alias("t"), F.concat_ws(" Take ", "slate", "take_id").alias("i")), F.struct(F.lit("shot").alias("t"), F.col("slate").alias("i")), F.struct(F.lit("scene").alias("t"), n.scene_of_slate(F.col("slate")).alias("i"))))
    asked = takes.select(P, "slate", "take_id").distinct().select(P, "slate", "take_id", keys.alias("k"))
    hung = requirements.select(P, F.col("target_type").alias("tt"), F.col("target_id").alias("ti"), "status")
    joined = asked.join(hung, (asked[P] == hung[P]) & (F.col("k.t") == F.col("tt")) & (F.col("k.i") == F.col("ti"))).select(asked[P], "slate", "take_id", "status")
    return joined.groupBy(P, "slate", "take_id").agg(F.count_if(F.expr("status <> 'resolved'")).alias("open"), F.count_if(F.expr("status = 'resolved'")).alias("resolved"))


#: Subscriptions that are broadcast at most.
BROADCAST_SUBSCRIPTIONS = 100_000


def live_events(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Changes that each subscription asks for; ALL stands for any production or day.

    An event is looked up under the four keys that can ask for it, so that many subscriptions
    are an equi-join.
    """
    either = lambda c: F.array(F.lit("ALL"), F.col(c))
    asked = events.withColumn("p", F.explode(either(P))).withColumn("d", F.explode(either("shoot_day")))
    s = subscriptions.select("subscription", F.col(P).alias("p"), F.col("shoot_day").alias("d"))
    s = F.broadcast(s) if s.limit(BROADCAST_SUBSCRIPTIONS + 1).count() <= BROADCAST_SUBSCRIPTIONS else s
    return asked.join(s, ["p", "d"]).select("subscription", *events.columns)
