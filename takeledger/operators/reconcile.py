"""Cross-checks of what departments say of a take, a scene, a day; one finding a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.sources import versions
from takeledger.sources.documents import settled

DAY = ["production_id", "shoot_day"]
TAKE = [*DAY, "slate", "take_id"]
#: Frames of drift that are no finding, and beyond which it is another take.
LEAST_DRIFT, MOST_DRIFT = 1, 240
#: Takes whose bounds are broadcast; with more of them timecodes are sorted as they come.
BROADCAST_TAKES = 500_000


def finding(df: DataFrame, entity: Column, kind: str, severity: str, detail: Column) -> DataFrame:
    return df.select(*DAY, entity.alias("entity_id"), F.lit(kind).alias("finding"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def take_entity() -> Column:
    return F.concat("slate", F.lit(" Take "), "take_id")


def finding_id(df: DataFrame) -> DataFrame:
    """A stable id, so that writing the same finding again changes nothing."""
    return df.withColumn("finding_id", F.sha2(F.concat_ws("|", *DAY, "finding", "entity_id", "detail"), 256))


def camera_of(roll: Column) -> Column:
    """The camera's letter, A where the roll names none."""
    return F.when(roll.rlike("^[A-Za-z]"), F.upper(F.substring(roll, 1, 1))).otherwise("A")


def circled_mismatches(witnesses: DataFrame) -> DataFrame:
    """Script documents that disagree on a take's mark; the last claim of a document counts."""
    said = witnesses.filter("department = 'script' and starred is not null").groupBy(*TAKE, "doc_id").agg(F.max_by("starred", "seq").alias("starred"))
    both = said.groupBy(*TAKE).agg(F.bool_or("starred").alias("yes"), F.bool_and("starred").alias("all"), F.count("*").alias("documents")).filter("yes and not all")
    return finding(both, take_entity(), "CIRCLED_TAKE_MISMATCH", "CRITICAL", F.col("documents"))


def roll_mismatches(witnesses: DataFrame, camera: bool = True, sound: bool = True) -> DataFrame:
    """One camera of a take on several rolls, and sound on several cards, in one pass by take.

    A sound roll and a recorder's folder may name the same card, which is no finding. Claims are made
    distinct by hash before rolls are gathered (as lists: under sets Catalyst drops the distinct), so
    that a take's lists hold rolls and not witnesses; sound is the claim without a camera.
    """
    roll, card = F.col("camera_roll"), F.col("sound_roll")
    claims = []
    if camera:
        claims.append(F.struct(camera_of(roll).alias("camera"), roll.alias("roll")))
    if sound:
        claims.append(F.struct(F.lit("").alias("camera"), card.alias("roll")))
    said = witnesses.select(*TAKE, F.inline(F.array(*claims))).filter("roll <> ''").distinct()
    several = said.groupBy(*TAKE, "camera").agg(F.sort_array(F.collect_list("roll")).alias("rolls")).filter("size(rolls) > 1")
    is_sound = F.col("camera") == ""
    plain = F.exists("rolls", lambda r: r.startswith("SR") | r.rlike(r"^\d+$"))
    folder = F.exists("rolls", lambda r: r.contains("Y") & r.contains("M"))
    listed = F.array_join("rolls", ",")
    return several.filter(~(is_sound & plain & folder)).select(
        *DAY, take_entity().alias("entity_id"), F.lit("ROLL_MISMATCH").alias("finding"),
        F.when(is_sound, "WARNING").otherwise("CRITICAL").alias("severity"),
        F.when(is_sound, listed).otherwise(F.concat("camera", F.lit(":"), listed)).alias("detail"),
    )


def camera_roll_mismatches(witnesses: DataFrame) -> DataFrame:
    return roll_mismatches(witnesses, sound=False)


def sound_roll_mismatches(witnesses: DataFrame) -> DataFrame:
    return roll_mismatches(witnesses, camera=False)


def timecode_drifts(witnesses: DataFrame, fps: float = 24.0) -> DataFrame:
    """Drift between the first two witnesses, by arrival, that state a timecode."""
    first = F.row_number().over(Window.partitionBy(*TAKE).orderBy("seq", "timecode_in"))
    two = witnesses.filter("timecode_in <> ''").select(*TAKE, "seq", "timecode_in").withColumn("n", first).filter("n <= 2")
    said = lambda i: F.max(F.when(F.col("n") == i, F.col("timecode_in")))
    both = two.groupBy(*TAKE).agg(n.frame_drift(said(1), said(2), fps).alias("drift"))
    return finding(both.filter((F.col("drift") > LEAST_DRIFT) & (F.col("drift") <= MOST_DRIFT)), take_entity(), "TIMECODE_DRIFT", "WARNING", F.col("drift"))


#: How a logged clip and a file spell camera, roll and number; and more loosely.
CLIP, FILE = r"^([A-Za-z])(\d{3,4})_C(\d{3,4})", r"([A-Z])_0*(\d+)C0*(\d+)(?!\d)"
LOOSE_CLIP, LOOSE_FILE = r"^([A-Z])_?(\d{3,4})_?C(\d{3,4})", r"([A-Z])_?0*(\d+)_?C0*(\d+)(?!\d)"


def clip_number(clip: Column, pattern: str) -> Column:
    parts = [F.regexp_extract(clip, pattern, i) for i in (1, 2, 3)]
    return F.when(clip.rlike(pattern), F.concat_ws(":", F.lit("clip"), F.upper(parts[0]), parts[1].try_cast("int").cast("string"), parts[2].try_cast("int").cast("string")))


def file_numbers(name: Column, pattern: str) -> Column:
    whole = F.regexp_extract_all(F.upper(name), F.lit(pattern), F.lit(0))
    return F.transform(whole, lambda m: F.concat_ws(":", F.lit("clip"), F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2), F.regexp_extract(m, pattern, 3)))


def _logged_keys(takes: DataFrame) -> DataFrame:
    """Keys by which a logged clip can meet a file: its stem, and camera, roll and number."""
    stem = F.concat(F.lit("stem:"), F.upper(n.clip_stem(F.col("clip_name"))))
    return takes.withColumn("key", F.explode(F.array_compact(F.array(stem, clip_number(F.col("clip_name"), CLIP)))))


def wav_names(slate: Column, take: Column) -> Column:
    """Keys of the sound files that a take may have: `27-7T`, `49WTT` and the like, and the number.

    Scene, a dash, a slash or nothing, shot and T; for wild tracks and slates without a shot the
    scene and any of the ways to write so. Leading plus signs do not count.
    """
    scene = F.regexp_replace(F.substring_index(slate, "/", 1), r"^\++", "")
    shot = F.get(F.split(slate, "/"), F.lit(1))
    wild = [gap + way for gap in ("", "-", "/") for way in ("WTT", "WT", "T", "-WTT", "-WT", "-T")]
    ends = F.when(F.coalesce(shot, F.lit("")).isin("", "WT"), F.array(*map(F.lit, dict.fromkeys(wild)))).otherwise(F.array(*[F.concat(F.lit(gap), shot, F.lit("T")) for gap in ("", "-", "/")]))
    number = F.when(take.rlike(r"^[0-9]{1,18}$"), take.try_cast("bigint")).otherwise(0)
    return F.transform(ends, lambda e: F.concat(F.lit("wav:"), F.upper(F.concat(scene, e)), F.lit(":"), number.cast("string")))


def sound_file(name: Column) -> Column:
    """The key of a sound file's name as an array; other files have none."""
    wav = r"(?i)^\+?(.*T)0*([0-9]{1,18})\.WAV$"
    key = F.concat(F.lit("wav:"), F.upper(F.regexp_extract(name, wav, 1)), F.lit(":"), F.regexp_extract(name, wav, 2))
    return F.when(name.rlike(wav), F.array(key)).otherwise(F.array().cast("array<string>"))


def _file_keys(media: DataFrame) -> DataFrame:
    name = F.col("file_name")
    stem = F.array(F.concat(F.lit("stem:"), F.upper(n.clip_stem(name))))
    return media.withColumn("key", F.explode(F.array_distinct(F.concat(stem, file_numbers(name, FILE), sound_file(name)))))


def existence_findings(witnesses: DataFrame, media: DataFrame) -> DataFrame:
    """Logged clips without a file, and files that nothing logs, from one table of keys.

    Clips count on days that have an offload. Every key's rows learn whether the other side has
    the key too; a clip or file that none of its keys brings together is a finding.
    """
    said = witnesses.filter("axis = 'belief'")
    logged = said.filter("clip_name <> ''").select(*TAKE, "clip_name").distinct()
    takes = said.select(*TAKE).distinct()
    files = media.filter("file_name <> ''").select(*DAY, "file_name").distinct()
    nobody = [F.lit(None).cast("string").alias(c) for c in ("slate", "take_id", "clip_name", "file_name")]
    sides = [
        _logged_keys(logged).select(*DAY, "key", F.lit(False).alias("is_file"), "slate", "take_id", "clip_name", nobody[3]),
        # a take's sound file is no trace of its clip: these keys only show that a file is known
        takes.select(*DAY, F.explode(F.array_distinct(wav_names(F.col("slate"), F.col("take_id")))).alias("key")).select(*DAY, "key", F.lit(False).alias("is_file"), *nobody),
        _file_keys(files).select(*DAY, "key", F.lit(True).alias("is_file"), *nobody[:3], "file_name"),
    ]
    by_key = Window.partitionBy(*DAY, "key")
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).withColumn("met", F.min("is_file").over(by_key) != F.max("is_file").over(by_key)).filter("is_file or clip_name is not null")
    alone = rows.groupBy(*DAY, "is_file", "slate", "take_id", "clip_name", "file_name").agg(F.bool_or("met").alias("met")).filter("not met")
    # both kinds in one select: as a union each would make the table of keys for itself
    found = alone.join(files.select(*DAY).distinct().withColumn("offloaded", F.lit(True)), DAY, "left").filter("(is_file and not startswith(file_name, '.')) or (not is_file and offloaded)")
    clip = F.concat("slate", F.lit(" Take "), "take_id", F.lit(" ("), "clip_name", F.lit(")"))
    either = lambda file, paper: F.when(F.col("is_file"), file).otherwise(paper)
    return found.select(
        *DAY, either(F.col("file_name"), clip).alias("entity_id"), either("MEDIA_WITHOUT_PAPERWORK", "PAPERWORK_WITHOUT_MEDIA").alias("finding"),
        either("WARNING", "CRITICAL").alias("severity"), either("", F.col("clip_name")).alias("detail"),
    )


def paperwork_without_media(witnesses: DataFrame, media: DataFrame) -> DataFrame:
    return existence_findings(witnesses, media).filter("finding = 'PAPERWORK_WITHOUT_MEDIA'")


def media_without_paperwork(witnesses: DataFrame, media: DataFrame) -> DataFrame:
    return existence_findings(witnesses, media).filter("finding = 'MEDIA_WITHOUT_PAPERWORK'")


def awaiting_offload(witnesses: DataFrame, media: DataFrame, rows: str = "1") -> DataFrame:
    """Days with logged clips and no file at all: one row, with the count of takes and 20 slates.

    `rows` says how many witnesses a row stands for. They are counted by slate first, by hash.
    """
    logged = witnesses.filter("axis = 'belief' and clip_name <> ''").groupBy(*DAY, "slate").agg(F.sum(F.expr(rows)).alias("takes"))
    logged = logged.join(media.select(*DAY).distinct(), DAY, "left_anti")
    found = logged.groupBy(*DAY).agg(F.sum("takes").alias("takes"), F.array_join(F.slice(F.sort_array(F.collect_list("slate")), 1, 20), ",").alias("slates"))
    return finding(found, F.col("shoot_day"), "AWAITING_OFFLOAD", "INFO", F.concat_ws(":", "takes", "slates"))


def scene_findings(scenes: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Office's plan and belief against what the other departments filed on the day."""
    # a day's slates are few beside its witnesses: scenes are read from what is distinct already
    filed = witnesses.select(*DAY, "slate", F.col("scene").alias("said")).distinct()
    material = settled(filed, scene=n.scene_of_slate(F.regexp_replace("slate", "-", "/"), F.col("said"))).select(*DAY, "scene").distinct()
    claims = scenes.filter("office_state is not null").select(*DAY, "scene", "office_state").distinct()
    done = claims.filter("office_state in ('complete', 'part_complete')").select(*DAY, "scene").distinct()
    done = done.join(material.select(*DAY).distinct(), DAY, "left_semi").join(material, [*DAY, "scene"], "left_anti")
    planned = scenes.filter("axis = 'intent' and state = 'scheduled'").select(*DAY, "scene").distinct()
    unplanned = claims.filter("office_state = 'shot_not_scheduled'").join(planned, [*DAY, "scene"], "left_anti")
    skipped = claims.filter("office_state in ('scheduled_not_shot', 'not_shot')")
    scene = F.col("scene")
    return (
        finding(done, scene, "SCENE_COMPLETE_WITHOUT_MATERIAL", "WARNING", F.lit(""))
        .unionByName(finding(skipped, scene, "SCENE_SCHEDULED_NOT_SHOT", "INFO", F.lit("")))
        .unionByName(finding(unplanned, scene, "SCENE_SHOT_NOT_SCHEDULED", "INFO", F.lit("")))
    )


def slates_outside_range(witnesses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Slates whose shot lies outside what the report states for the scene; the last range counts."""
    # the same ends are stated again and again: their shots are read once
    stated = ranges.groupBy(*DAY, "scene", "first", "last").agg(F.max("seq").alias("seq"))
    ends = stated.groupBy(*DAY, "scene").agg(F.max_by(F.struct(n.shot_number(F.col("first")).alias("a"), n.shot_number(F.col("last")).alias("b")), "seq").alias("r"))
    ends = ends.select(*DAY, "scene", F.least("r.a", "r.b").alias("low"), F.greatest("r.a", "r.b").alias("high")).filter("low is not null and high is not null")
    slates = settled(witnesses.select(*DAY, "slate").distinct(), s=n.scene_and_shot(F.col("slate")))
    slates = slates.select(*DAY, "slate", F.col("s.scene").alias("scene"), F.col("s.shot").alias("shot")).filter("shot is not null")
    out = slates.join(ends, [*DAY, "scene"]).filter("shot < low or shot > high")
    return finding(out, F.col("slate"), "SLATE_OUTSIDE_STATED_RANGE", "WARNING", F.concat_ws("-", "low", "high"))


def date_disagreements(dates: DataFrame) -> DataFrame:
    found = dates.select(*DAY, "date").distinct().groupBy(*DAY).agg(F.collect_list("date").alias("d")).filter(F.size("d") >= 2)
    return finding(found, F.col("shoot_day"), "SHOOT_DATE_DISAGREEMENT", "WARNING", F.array_join(F.sort_array("d"), ","))


def claims(witnesses: DataFrame) -> DataFrame:
    """What is claimed of takes, each once: how many witnesses say so, and the first with a timecode."""
    timed = F.when(F.col("timecode_in") != "", F.col("seq"))
    return witnesses.groupBy(*TAKE, "axis", "scene", "camera_roll", "sound_roll", "clip_name").agg(F.count("*").alias("witnesses"), F.min(timed).alias("seq"))


def earliest(witnesses: DataFrame, said: DataFrame) -> DataFrame:
    """The witnesses that can be the first two of their take with a timecode; `said` are their claims.

    Two claims have two rows, so that a take's second row is never behind its second claim's first.
    Takes of one claim, and rows without a place, stay whole. Takes of one hash share the later
    bound, or have none if one of them has none.
    """
    if said.select(*TAKE).distinct().count() > BROADCAST_TAKES:
        return witnesses
    take, place = F.xxhash64(*TAKE), F.row_number().over(Window.partitionBy(*TAKE).orderBy(F.asc_nulls_last("seq")))
    two = said.select(take.alias("take"), F.col("seq").alias("bound"), place.alias("place")).filter("place <= 2")
    bounds = two.groupBy("take").agg(*[F.expr(f"{e} filter (where place = {i})").alias(c) for c, e, i in (("takes", "count(*)", 1), ("bounded", "count(bound)", 2), ("bound", "max(bound)", 2))])
    bounds = bounds.filter("takes = bounded").select("take", "bound")
    return witnesses.join(F.broadcast(bounds), take == F.col("take"), "left").filter("bound is null or seq is null or seq <= bound").select(witnesses.columns)


def reconcile(witnesses: DataFrame, media: DataFrame, scenes: DataFrame, ranges: DataFrame, dates: DataFrame) -> DataFrame:
    """All findings of all productions and days.

    Claims, files and what is said of scenes are made distinct once and stored: most checks read these.
    """
    said = versions.stored(claims(witnesses), "claims")
    files = versions.stored(media.select(*DAY, "file_name").distinct(), "files")
    planned = versions.stored(scenes.select(*DAY, "scene", "axis", "state", "office_state").distinct(), "scenes")
    parts = [
        circled_mismatches(witnesses), roll_mismatches(said), timecode_drifts(earliest(witnesses, said)), existence_findings(said, files), awaiting_offload(said, files, "witnesses"),
        scene_findings(planned, said), slates_outside_range(said, ranges), date_disagreements(dates),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_resolutions(findings: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Findings marked resolved by a person's call, by id first, else by day and entity."""
    by_id = resolutions.select("finding_id", F.col("resolution").alias("r1")).dropDuplicates(["finding_id"])
    by_key = resolutions.select(*DAY, "entity_id", F.col("resolution").alias("r2")).dropDuplicates([*DAY, "entity_id"])
    joined = finding_id(findings).join(by_id, "finding_id", "left").join(by_key, [*DAY, "entity_id"], "left")
    return joined.withColumn("resolution", F.coalesce("r1", "r2")).drop("r1", "r2")


def unified_marks(witnesses: DataFrame) -> DataFrame:
    """Every row, with the mark that any row of its document gives the take."""
    marks = witnesses.filter("starred").select("production_id", "doc_id", "slate", "take_id").distinct().withColumn("marked", F.lit(True))
    return witnesses.join(marks, ["production_id", "doc_id", "slate", "take_id"], "left").withColumn("starred", F.coalesce("marked", "starred")).drop("marked")


def witness_author(department: Column, camera_roll: Column) -> Column:
    camera = F.concat(F.lit("Camera "), F.when(camera_roll.rlike("^[A-Za-z]"), F.upper(F.substring(camera_roll, 1, 1))).otherwise("A"))
    return F.when(department == "camera", camera).when(department == "sound", "Sound Department").when(department == "script", "Script Supervisor").when(department == "dit", "DIT").otherwise(F.initcap(department))
