"""One row a take, scene or day from everything that was said of it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.operators import analytics as a
from takeledger.operators.reconcile import LOOSE_CLIP, LOOSE_FILE, camera_of, clip_number, file_numbers, sound_file, wav_names
from takeledger.operators.status import missing_paperwork
from takeledger.sources import versions
from takeledger.sources.documents import settled

P = "production_id"
DAY = [P, "shoot_day"]
TAKE = [*DAY, "slate", "take_id"]


def shooting_order(day: Column) -> Column:
    """Numeric days first, by number, then the rest by text."""
    number = day.try_cast("bigint")
    return F.struct(number.isNull().alias("text"), F.coalesce(number, F.lit(0)).alias("number"), day.alias("day"))


def in_shooting_order(days: Column) -> Column:
    return F.transform(F.array_sort(F.transform(days, shooting_order)), lambda x: x["day"])


def _plain_take(take: Column) -> Column:
    """A take's number, or its text without marks."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(take, F.lit("")), "VFX|PK", ""), "FC", "FALSE"))
    return F.when(bare.rlike("^[0-9]{1,18}$"), bare.try_cast("bigint").cast("string")).otherwise(F.upper(bare))


#: Characters of a clip's name by which it can meet the files that contain it.
GRAM = 8


def _grams(name: Column, size: Column | int) -> Column:
    """All substrings of that length, as keys; none of a shorter name."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(name) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit("gram:"), F.substr(name, i, size))))).otherwise(F.array().cast("array<string>"))


def match_take_media(takes: DataFrame, media: DataFrame) -> DataFrame:
    """Files of each take, by any of three ways.

    What the volume reports of the file: scene, take and a shot that says more than the scene (a
    slate without a shot needs none), unless both sides name different rolls. The clip's name:
    camera, roll and number, or the whole name anywhere in the file's. The name of a sound file.

    A name meets the files that contain it by its last GRAM characters, which are held against all
    substrings of that length of a file's name, and then by the whole; a shorter name by the
    substrings of its own length, of which the files of days with such names have keys too.
    """
    scene = lambda c: F.upper(F.regexp_replace(c, r"^\++", ""))
    name, slate = F.col("file_name"), F.col("slate")
    shot = F.get(F.split(slate, "/"), F.lit(1))
    by_shot = F.concat_ws(":", F.lit("shot"), scene(F.substring_index(slate, "/", 1)), _plain_take(F.col("take_id")), F.upper(F.coalesce(shot, F.lit(""))))
    clip = F.when(F.col("clip_name") != "", F.concat(F.lit("gram:"), F.right("clip_name", F.lit(GRAM))))
    sound = F.when(_plain_take(F.col("take_id")).rlike("^[0-9]+$"), wav_names(slate, _plain_take(F.col("take_id")))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array_compact(F.array(by_shot, clip, clip_number(F.col("clip_name"), LOOSE_CLIP))), sound)
    logged = takes.select(*TAKE, F.coalesce("clip_name", F.lit("")).alias("clip_name"), F.upper(F.coalesce("camera_roll", F.lit(""))).alias("roll")).distinct()
    logged = logged.withColumn("key", F.explode(F.array_distinct(keys)))
    informative = F.coalesce("shot", F.lit("")) != ""
    informative = informative & ~F.upper("shot").isin(F.upper("scene"), scene(F.col("scene")))
    reported = F.concat_ws(":", F.lit("shot"), scene(F.col("scene")), _plain_take(F.col("take_id")))
    shots = F.array(F.concat(reported, F.lit(":")), F.when(informative, F.concat(reported, F.lit(":"), F.upper(F.substring_index("shot", "/", -1)))))
    known = F.when((F.coalesce("scene", F.lit("")) != "") & (F.coalesce("take_id", F.lit("")) != ""), F.array_compact(shots)).otherwise(F.array().cast("array<string>"))
    short = logged.filter((F.col("clip_name") != "") & (F.length("clip_name") < GRAM)).groupBy(*DAY).agg(F.collect_set(F.length("clip_name")).alias("sizes"))  # below GRAM each
    files = media.filter("file_name <> ''").select(*DAY, "file_name", "camera_roll", "scene", "shot", "take_id").distinct().join(short, DAY, "left")
    grams = F.concat(_grams(name, GRAM), F.flatten(F.transform(F.coalesce("sizes", F.array().cast("array<int>")), lambda k: _grams(name, k))))
    files = files.select(*DAY, "file_name", F.upper(F.coalesce("camera_roll", F.lit(""))).alias("file_roll"), F.explode(F.array_distinct(F.concat(known, grams, file_numbers(name, LOOSE_FILE), sound_file(name)))).alias("key"))
    conflict = F.col("key").startswith("shot:") & (F.col("roll") != "") & (F.col("file_roll") != "") & (F.col("roll") != F.col("file_roll"))
    within = ~F.col("key").startswith("gram:") | F.contains("file_name", "clip_name")
    return logged.join(files, [*DAY, "key"]).filter(~conflict & within).select(*TAKE, "file_name").distinct()


#: Endings of sound files.
SOUND_FILES = r"(?i)\.(wav|mp3|aif|aiff|bwf)$"


def take_rollup(witnesses: DataFrame, media: DataFrame) -> DataFrame:
    """One row a take, with slates as they normalise.

    Cards, angles (cameras), documents, marks that any row has, what each department said last,
    and the picture and sound files with their volumes.
    """
    card = F.when(F.col("camera_roll") != "", F.col("camera_roll"))
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    last = lambda d: F.max(F.when(F.col("department") == d, F.struct("seq", F.concat_ws(" ", "camera_roll", "sound_roll", "timecode_in").alias("said")))).alias(d)
    # by the slates as they are written, which are few beside the rows that name them
    written = witnesses.groupBy(*TAKE).agg(
        F.count("*").alias("claims"), F.collect_set(card).alias("cards"), any_(F.col("starred")).alias("starred"), any_(n.is_vfx(F.col("raw_take"))).alias("vfx"), any_(n.is_pickup(F.col("raw_take"))).alias("pickup"),
        F.collect_set("doc_id").alias("documents"), F.collect_set("department").alias("departments"), *map(last, ("camera", "sound", "script")),
    )
    whole = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    rows = written.withColumn("slate", n.slate(F.col("slate"))).groupBy(*TAKE).agg(
        F.sum("claims").alias("claims"), whole("cards").alias("cards"), *[F.bool_or(c).alias(c) for c in ("starred", "vfx", "pickup")],
        F.array_join(whole("documents"), ",").alias("documents"), F.size(whole("departments")).alias("departments"), *[F.max(d)["said"].alias(f"{d}_said") for d in ("camera", "sound", "script")],
    )
    angles = F.array_join(F.sort_array(F.array_distinct(F.transform("cards", camera_of))), ",")
    rows = rows.select(*TAKE, "claims", F.array_join("cards", ",").alias("cards"), angles.alias("angles"), *[c for c in rows.columns if c not in (*TAKE, "claims", "cards")])
    # settled: else the optimiser drops this distinct and normalises, and filters, each witness
    named = witnesses.select(*DAY, F.col("slate").alias("written"), "take_id", "clip_name", "camera_roll").distinct()
    said = settled(named, slate=n.slate(F.col("written")))
    volumes = media.select(*DAY, "file_name", "volume").distinct()
    sound = F.col("file_name").rlike(SOUND_FILES)
    files = match_take_media(said, media).join(volumes, [*DAY, "file_name"]).groupBy(*TAKE, "file_name").agg(F.collect_set("volume").alias("v"))
    files = files.groupBy(*TAKE).agg(F.count_if(~sound).alias("video_files"), F.count_if(sound).alias("audio_files"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))), ",").alias("volumes"))
    return rows.join(files, TAKE, "left").fillna(0, ["video_files", "audio_files"]).fillna("", ["volumes"])


def sequence_rollup(witnesses: DataFrame) -> DataFrame:
    """One row a scene over all its days.

    Cards, takes, the list of circled ones, marks, documents, the two commonest notes of the
    script department and its first three different ones, by arrival. Takes are combined before
    they are counted.
    """
    said = witnesses.withColumn("slate", n.slate(F.col("slate")))
    take = F.concat("slate", F.lit(":"), "take_id")
    card = F.when(F.col("camera_roll") != "", F.col("camera_roll"))
    each = said.groupBy(P, "scene", take.alias("take")).agg(
        F.bool_or(F.coalesce("starred", F.lit(False))).alias("starred"), F.bool_or(n.is_vfx(F.col("raw_take"))).alias("vfx"), F.bool_or(n.is_pickup(F.col("raw_take"))).alias("pickup"),
        F.collect_set(card).alias("cards"), F.collect_set("shoot_day").alias("days"), F.collect_set("doc_id").alias("docs"),
    )
    starred = F.col("once") & F.col("starred")
    rows = a.spread(each, "cards", "days", "docs").groupBy(P, "scene").agg(
        F.count_if("once").alias("takes"), F.count_if(starred).alias("circled"), F.array_join(F.array_sort(F.collect_list(F.when(starred, F.col("take")))), ",").alias("circled_takes"),
        F.bool_or("vfx").alias("vfx"), F.bool_or("pickup").alias("pickup"), F.array_join(F.array_sort(F.collect_set("cards")), ",").alias("cards"),
        F.array_join(in_shooting_order(F.collect_set("days")), ",").alias("days"), F.array_join(F.array_sort(F.collect_set("docs")), ",").alias("documents"),
    )
    notes = said.filter("department = 'script' and note <> ''").groupBy(P, "scene", "note").agg(F.count("*").alias("times"), F.min("seq").alias("seq"))
    place = lambda *by: F.row_number().over(Window.partitionBy(P, "scene").orderBy(*by))
    notes = notes.withColumn("common", place(F.desc("times"), "note")).withColumn("early", place("seq", "note")).filter("common <= 2 or early <= 3")
    listed = lambda c, most: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= most, F.struct(c, "note")))), lambda x: x["note"]), "; ")
    notes = notes.groupBy(P, "scene").agg(listed("common", 2).alias("descriptions"), listed("early", 3).alias("comments"))
    return rows.join(notes, [P, "scene"], "left").fillna("", ["descriptions", "comments"])


def sequence_shoot_days(witnesses: DataFrame) -> DataFrame:
    return witnesses.groupBy(P, "scene").agg(F.array_join(in_shooting_order(F.collect_set("shoot_day")), ",").alias("days"))


def sequence_flags(snapshots: DataFrame) -> DataFrame:
    """Scenes with open findings whose entity begins with one of their slates."""
    return a.current_findings(snapshots).filter("not resolved").groupBy(P, n.scene_of_slate(F.col("entity_id")).alias("scene")).agg(F.count("*").alias("open"), F.bool_or(F.col("severity") == "CRITICAL").alias("critical"))


def shot_description(notes: DataFrame, most: int = 6) -> DataFrame:
    """The first different notes on each slate, in order. notes: P, slate, note, seq."""
    first = notes.groupBy(P, n.slate(F.col("slate")).alias("slate"), "note").agg(F.min("seq").alias("seq"))
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy(P, "slate").orderBy("seq", "note"))).filter(F.col("n") <= most)
    return kept.groupBy(P, "slate").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "note"))), lambda x: x["note"]), "; ").alias("description"))


def slates_covered(ranges: DataFrame, witnesses: DataFrame) -> DataFrame:
    """How many slates of the stated range of each scene and day were logged.

    A range is its two ends: what is inside is counted from what was logged, never listed.
    """
    ends = ranges.groupBy(*DAY, "scene").agg(F.max_by(F.struct(n.shot_number(F.col("first")).alias("a"), n.shot_number(F.col("last")).alias("b")), "seq").alias("r"))
    stated = ends.select(*DAY, "scene", F.least("r.a", "r.b").alias("low"), F.greatest("r.a", "r.b").alias("high")).filter("low is not null")
    logged = witnesses.select(*DAY, n.scene_and_shot(F.col("slate")).alias("s")).select(*DAY, F.col("s.scene").alias("scene"), F.col("s.shot").alias("shot")).distinct()
    inside = F.count_if(F.col("shot").between(F.col("low"), F.col("high")))
    return stated.join(logged, [*DAY, "scene"], "left").groupBy(*DAY, "scene", "low", "high").agg(inside.alias("covered")).select(*DAY, "scene", (F.col("high") - F.col("low") + 1).alias("stated"), "covered")


def seconds_since_created(activity: DataFrame, events: DataFrame) -> DataFrame:
    """Each act with the seconds since its requirement was raised, never below zero."""
    raised = events.groupBy(F.col("requirement_id").alias("target_id")).agg(F.min("created_at").alias("raised"))
    gap = F.greatest(F.lit(0.0), (n.micros(F.col("created_at")) - n.micros(F.col("raised"))) / 1e6)
    return activity.join(raised, "target_id", "left").withColumn("seconds", F.when(F.col("raised").isNotNull(), gap)).drop("raised")


def backfilled_dates(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """Date claims of documents that have none yet but state a date."""
    from takeledger.sources.ingest import date_claims

    return date_claims(docs.join(claims.select("doc_id").distinct(), "doc_id", "left_anti"))


def backfill_summary(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """(production_id, documents, claimed, stated, silent, silent_files): what a backfill would do.

    Documents that have a claim already, that state a date, and that state none; the names of the
    last in order.
    """
    date = n.shoot_date(F.col("content"), F.col("filename"))
    known = claims.select("doc_id").distinct().withColumn("known", F.lit(True))
    state = F.when(F.col("known"), "claimed").when(F.col("date").isNotNull(), "stated").otherwise("silent")
    each = docs.withColumn("date", date).join(known, "doc_id", "left").select(P, "filename", state.alias("state"))
    counts = [F.count_if(F.col("state") == k).alias(k) for k in ("claimed", "stated", "silent")]
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == "silent", F.coalesce("filename", F.lit(""))))), ",")
    return each.groupBy(P).agg(F.count("*").alias("documents"), *counts, names.alias("silent_files"))


def take_diagnosis(witnesses: DataFrame, findings: DataFrame) -> DataFrame:
    """The evidence lines of each take, and what was found of it, of its slate, or of its whole day."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" ", "department", "camera_roll", "sound_roll", "timecode_in").alias("t")))), lambda x: x["t"]), "; ")
    evidence = witnesses.groupBy(*TAKE).agg(lines.alias("evidence"))
    said = F.concat_ws(" ", "finding", "detail").alias("f")
    whole = F.col("entity_id") == F.col("shoot_day")
    by_slate = findings.filter(~whole).select(*DAY, F.split_part("entity_id", F.lit(" Take "), F.lit(1)).alias("slate"), said).groupBy(*DAY, "slate").agg(F.collect_set("f").alias("of_slate"))
    by_day = findings.filter(whole).select(*DAY, said).groupBy(*DAY).agg(F.collect_set("f").alias("of_day"))
    none = F.array().cast("array<string>")
    found = F.array_join(F.array_sort(F.array_union(F.coalesce("of_slate", none), F.coalesce("of_day", none))), "; ")
    both = evidence.join(by_slate, [*DAY, "slate"], "left").join(by_day, DAY, "left")
    return both.select(*TAKE, "evidence", found.alias("findings"))


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.filter("read_at is null").groupBy(F.lower("recipient").alias("recipient")).agg(F.count("*").alias("unread"))


def pre_editing_progress(events: DataFrame) -> DataFrame:
    """Queue requirements of each assistant: total, done, share, and the latest eight."""
    now = a.latest_requirements(events)
    place = F.row_number().over(Window.partitionBy(P, "assignee").orderBy(F.desc("updated_at"), F.desc("requirement_id")))
    newest = now.withColumn("place", place).filter("place <= 8").groupBy(P, "assignee").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "requirement_id"))), lambda x: x["requirement_id"]), ",").alias("recent"))
    counts = now.groupBy(P, "assignee").agg(F.count("*").alias("total"), F.count_if(F.expr("status = 'resolved'")).alias("done"))
    return counts.join(newest, [P, "assignee"]).withColumn("share", F.round(100 * F.col("done") / F.col("total"), 1))


def character_lines(lines: DataFrame, most: int) -> DataFrame:
    """The first lines of each speaker, with scene and place."""
    w = Window.partitionBy("script_id", "speaker").orderBy("scene", "place")
    return lines.withColumn("index", F.row_number().over(w)).filter(F.col("index") <= most)


def script_context(targets: DataFrame, scenes: DataFrame) -> DataFrame:
    """Script scenes for each target: its scene numbers joined, with a status where there is none.

    targets: production_id, script_id, target; scenes: script_id, scene, ...
    """
    asked = targets.withColumn("numbers", n.scene_numbers(F.col("target"))).withColumn("number", F.explode_outer("numbers"))
    found = asked.join(scenes.withColumnRenamed("script_id", "sid"), (F.col("script_id") == F.col("sid")) & (F.col("number") == F.col("scene")), "left")
    state = F.when(F.col("script_id").isNull(), "no_script").when(F.col("number").isNull(), "no_scene_number").when(F.col("sid").isNull(), "scene_not_in_script").otherwise("found")
    return found.withColumn("status", state).drop("sid", "numbers")


def script_productions(links: DataFrame, script_ids: DataFrame) -> DataFrame:
    """The productions that shoot each asked script. links: production_id, script_id."""
    return links.join(script_ids.select("script_id").distinct(), "script_id", "left_semi").select("script_id", P).distinct()


def scenes_by_number(scenes: DataFrame, asked: DataFrame) -> DataFrame:
    """Every scene filed under each asked number of its script, in order; numbers may repeat.

    scenes: script_id, scene, place; asked: script_id, scene.
    """
    same = F.upper(F.trim("scene")).alias("scene")
    found = scenes.withColumn("scene", same).join(asked.select("script_id", same).distinct(), ["script_id", "scene"])
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("script_id", "scene").orderBy("place")))


def numbered_scenes(headings: DataFrame) -> DataFrame:
    """A running number for headings that have none. headings: script_id, place, number."""
    w = Window.partitionBy("script_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return headings.withColumn("number", F.coalesce("number", F.sum(F.col("number").isNull().cast("int")).over(w).cast("string")))


def validated(rows: DataFrame, vocabulary: dict[str, list[str]], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows inside closed lists with their required fields, and the rest with the first reason."""
    wrong = [F.when(~F.coalesce(F.col(c).isin(values), F.lit(False)), F.lit(f"unknown {c}")) for c, values in vocabulary.items()]
    missing = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing {c}")) for c in required]
    marked = rows.withColumn("reason", F.coalesce(*missing, *wrong))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def open_oldest_first(events: DataFrame, top: int = 50) -> DataFrame:
    """Blocked and open requirements of each production by age."""
    w = Window.partitionBy(P).orderBy("raised_at", "requirement_id")
    return a.latest_requirements(events).filter("status in ('blocked', 'open')").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select(P, "requirement_id", "status", "place")


def open_findings(snapshots: DataFrame, top: int = 50) -> DataFrame:
    """Open findings of each production, worst and then newest first."""
    worst = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    w = Window.partitionBy(P).orderBy(worst, F.desc("created_at"), "event_id")
    return a.current_findings(snapshots).filter("not resolved").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select(P, "shoot_day", "finding", "severity", "entity_id", "place")


#: Buckets of work, and how urgent each severity is.
BUCKETS = ["done", "running", "blocking", "left", "missing"]
URGENCY = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def status_items(snapshots: DataFrame, events: DataFrame, witnesses: DataFrame, now: str) -> DataFrame:
    """(P, bucket, kind, id, severity, since, age_hours): all that a production's status is made of.

    Requirements by their status, findings (resolved are done, the rest block), and the departments
    that filed on other days of the production but not on one, which are missing since its last
    filing. Severities outside the known ones are medium, of findings high.
    """
    moment = F.lit(now).cast("timestamp")
    known = lambda c, other: F.when(F.lower(c).isin(*URGENCY), F.lower(c)).otherwise(other).alias("severity")
    status = F.col("status")
    bucket = F.when(status == "resolved", "done").when(status == "in_progress", "running").when(status == "blocked", "blocking").otherwise("left")
    since = F.when(status == "resolved", F.col("updated_at")).otherwise(F.col("raised_at"))
    work = a.latest_requirements(events).select(P, bucket.alias("bucket"), F.lit("requirement").alias("kind"), F.col("requirement_id").alias("id"), known(F.col("priority"), "medium"), since.alias("since"))
    found = a.current_findings(snapshots).select(P, F.when(F.col("resolved"), "done").otherwise("blocking").alias("bucket"), F.lit("discrepancy").alias("kind"), F.concat_ws(":", "shoot_day", "finding", "entity_id").alias("id"), known(F.col("severity"), "high"), F.col("created_at").alias("since"))
    last = witnesses.groupBy(*DAY).agg(F.max("created_at").alias("since"))
    gaps = missing_paperwork(witnesses).join(last, DAY).select(P, F.lit("missing").alias("bucket"), F.lit("paperwork").alias("kind"), F.concat_ws(":", "shoot_day", "department").alias("id"), F.lit("high").alias("severity"), "since")
    items = work.unionByName(found).unionByName(gaps)
    return items.withColumn("age_hours", n.hours_between(F.col("since"), moment))


def production_status(items: DataFrame, most: int = 5) -> DataFrame:
    """(P, counts of each bucket, urgent, headline): items as status_items gives them.

    urgent: what blocks or is missing, by severity, then the oldest; the headline counts the
    buckets and names the first.
    """
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in URGENCY.items() for x in kv]), F.col("severity"))
    counts = items.groupBy(P).agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
    place = F.row_number().over(Window.partitionBy(P).orderBy(F.desc(rank), F.desc_nulls_last("age_hours"), "kind", "id"))
    first = items.filter("bucket in ('blocking', 'missing')").withColumn("place", place).filter(F.col("place") <= most)
    top = F.max(F.when(F.col("place") == 1, F.concat(F.lit(" Most urgent: "), "id", F.lit(" ("), "severity", F.coalesce(F.concat(F.lit(" for "), F.round("age_hours").cast("long").cast("string"), F.lit("h")), F.lit("")), F.lit(")."))))
    urgent = first.groupBy(P).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ",").alias("urgent"), top.alias("top"))
    line = F.concat(F.concat_ws(", ", *[F.concat(F.col(b).cast("string"), F.lit(f" {b}")) for b in BUCKETS]), F.lit("."), F.coalesce("top", F.lit("")))
    return counts.join(urgent, P, "left").withColumn("urgent", F.coalesce("urgent", F.lit(""))).withColumn("headline", line).drop("top")


def rebuilt(trails: dict[str, DataFrame], path: str) -> DataFrame:
    """(table_name, before, rows): every table written anew from its trail.

    The tables are a version of their own; readers follow once all of them are written, so that a
    rebuild that fails half way leaves them what they had. The version before stays for those who
    still read it, older ones go.
    """
    spark = next(iter(trails.values())).sparkSession
    known = versions.current(spark, path)
    version = f"version={uuid.uuid4().hex}"
    counts = []
    for name, rows in trails.items():
        before = rebuilt_table(spark, path, name)
        rows.write.parquet(f"{path}/{version}/{name}")
        counts.append((name, before.count() if before is not None else 0, spark.read.parquet(f"{path}/{version}/{name}").count()))
    versions.move(spark, path, {"version": version, "tables": sorted(trails)})
    for old in versions.folders(spark, path, "version="):
        if old not in (version, known and known["version"]):
            versions.discard(spark, f"{path}/{old}")
    return spark.createDataFrame(counts, "table_name string, before long, rows long")


def rebuilt_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the newest whole rebuild; None where there is none."""
    known = versions.current(spark, path)
    return spark.read.parquet(f"{path}/{known['version']}/{name}") if known and name in known["tables"] else None
