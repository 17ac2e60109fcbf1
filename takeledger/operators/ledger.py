"""Latest state, first values, history and changes of append-only trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: an aggregation that combines before the shuffle, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return newest.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(*rows.columns)


def latest_value(value: str, order: list[str]) -> Column:
    return F.max_by(value, F.struct(*order))


def first_value(value: str, order: list[str]) -> Column:
    return F.min_by(value, F.struct(*order))


def first_acknowledgement(activity: DataFrame) -> DataFrame:
    """Who acknowledged each target first, and when."""
    acts = activity.filter("action = 'acknowledged'")
    first = acts.groupBy("production_id", "target_type", "target_id").agg(F.min_by(F.struct("actor", "created_at"), F.struct("created_at", "event_id")).alias("f"))
    return first.select("production_id", "target_type", "target_id", F.col("f.actor").alias("actor"), F.col("f.created_at").alias("acknowledged_at"))


def history(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The newest `limit` rows of each key, with their place."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def timeline(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Everything done to a target, oldest first, as one line."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, value)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[value]), ">").alias("timeline"), F.count("*").alias("events"))


#: What a requirement's events may change, and what goes when it is opened again.
REQUIREMENT_FIELDS = ["status", "priority", "assignee"]
RESOLUTION = ["resolution_note", "resolved_by", "resolved_at"]


def requirement_changes(events: DataFrame) -> DataFrame:
    """What each event changed against the one before: action name and fields with both values.

    Opening a resolved requirement again takes its resolution with it: what the event before still
    said of it is cleared, whether or not this one repeats it.
    """
    w = Window.partitionBy("requirement_id").orderBy("created_at", "event_id")
    told = [f for f in RESOLUTION if f in events.columns]
    fields = [*REQUIREMENT_FIELDS, *told]
    seen = events.select("requirement_id", "production_id", "event_id", "created_at", *fields, *[F.lag(f).over(w).alias(f"old_{f}") for f in fields], F.row_number().over(w).alias("n"))
    changed = [F.when(F.col(f"old_{f}") != F.col(f), F.concat(F.lit(f"{f}:"), f"old_{f}", F.lit(">"), f)) for f in REQUIREMENT_FIELDS]
    reopened = (F.col("old_status") == "resolved") & (F.col("status") != "resolved")
    cleared = [F.when(reopened & F.col(f"old_{f}").isNotNull(), F.concat(F.lit(f"{f}:"), F.col(f"old_{f}").cast("string"), F.lit(">"))) for f in told]
    name = F.when(F.col("n") == 1, "created").when(reopened, "reopened").when(F.col("old_status") != F.col("status"), "status_changed").when(F.col("old_assignee") != F.col("assignee"), "reassigned").when(F.col("old_priority") != F.col("priority"), "updated")
    return seen.select("requirement_id", "production_id", "event_id", name.alias("change"), F.concat_ws(",", *changed, *cleared).alias("fields")).filter("change is not null")


def deduplicated(documents: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each document with its place among those of the same content; 1 is kept, later are copies."""
    return documents.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def forward_filled(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], block: Column | None = None) -> DataFrame:
    """The last value stated so far down a report; `block` rows begin a new section."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = list(keys)
    if block is not None:
        rows = rows.withColumn("__block", F.sum(block.cast("int")).over(w))
        parts.append("__block")
    inner = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for c in columns:
        rows = rows.withColumn(c, F.last(c, ignorenulls=True).over(inner))
    return rows.drop("__block")


def projected_takes(witnesses: DataFrame) -> DataFrame:
    """The takes index: the last event of each day, slate, take and roll."""
    keys = ["production_id", "shoot_day", "slate", "take_id", "camera_roll"]
    return latest(witnesses.select(*keys, "department", "starred", "created_at", "seq"), keys, ["created_at", "seq"])


def purged(events: DataFrame, deleted: DataFrame) -> DataFrame:
    return events.join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")


def write_takes(witnesses: DataFrame, table: str, buckets: int) -> DataFrame:
    """The witnesses as a table in buckets of a take, sorted by arrival in it.

    Written once, every check that goes by take reads it without a shuffle.
    """
    take = ["production_id", "shoot_day", "slate", "take_id"]
    witnesses.write.mode("overwrite").bucketBy(buckets, *take).sortBy(*take, "seq").saveAsTable(table)
    return witnesses.sparkSession.table(table)
