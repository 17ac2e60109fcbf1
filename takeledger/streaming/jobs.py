"""Structured Streaming forms of the jobs; each works on any streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from takeledger.operators import status
from takeledger.operators.ledger import latest
from takeledger.sources import ingest as sources
from takeledger.sources import versions

#: Days that are broadcast at most.
BROADCAST_DAYS = 100_000


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All data that is there now, in batches, then stop."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


@contextmanager
def without_idle_batches(spark: SparkSession) -> Iterator[None]:
    """No batches without data: with timers of the clock there would always be another one."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a repeated batch overwrites: one folder a batch."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def filing_rate(events: DataFrame, interval: str = "1 day", late: str = "7 days") -> DataFrame:
    """Events of each department in tumbling windows; rows later than `late` are not counted."""
    w = F.window("created_at", interval)
    return events.withWatermark("created_at", late).groupBy(w.alias("w"), "department").agg(F.count("*").alias("events")).select(F.col("w.start").alias("from"), "department", "events")


def action_rate(activity: DataFrame, late: str = "2 hours") -> DataFrame:
    w = F.window("created_at", "1 hour")
    return activity.withWatermark("created_at", late).groupBy(w.alias("w"), "action").agg(F.count("*").alias("acts")).select(F.col("w.start").alias("from"), "action", "acts")


def deduplicated(docs: DataFrame, within: str = "1 day") -> DataFrame:
    """Without re-uploads: the first document of each checksum in a day; state ends with the watermark."""
    return docs.withWatermark("uploaded_at", within).dropDuplicatesWithinWatermark(["production_id", "shoot_day", "checksum"])


def live_feed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A stream of changes joined with static subscriptions."""
    return status.live_events(events, subscriptions)


def first_acknowledgements(created: DataFrame, acks: DataFrame, within: str = "30 days") -> DataFrame:
    """Requirements with their acknowledgements inside a time bound; unanswered ones end as null."""
    c = created.withWatermark("created_at", "1 day").alias("c")
    a = acks.withWatermark("acted_at", "1 day").alias("a")
    bound = (F.col("a.target_id") == F.col("c.requirement_id")) & (F.col("a.acted_at") >= F.col("c.created_at")) & (F.col("a.acted_at") <= F.col("c.created_at") + F.expr(f"interval {within}"))
    return c.join(a, bound, "leftOuter").select("c.requirement_id", "c.created_at", "a.actor", "a.acted_at")


def ingest(docs: DataFrame, spine: str, dead_letters: str, claims: str, checkpoint: str) -> None:
    """Documents as they arrive to spine events, rejects and date claims; batches are idempotent."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        said = sources.parsed(batch).persist()
        keep_batch(spine)(said.filter(F.col("entity_type") != sources.FAILED), number)
        keep_batch(dead_letters)(sources.rejected(batch, said), number)
        said.unpersist()
        keep_batch(claims)(sources.date_claims(batch), number)
        batch.unpersist()

    run_available(docs, each, checkpoint)


#: Batches of changes from which a table of current rows is folded into a new version.
FOLD_BATCHES = 20


def newest_rows(rows: DataFrame, keys: list[str], order: list[str], keep: timedelta = timedelta(days=30)) -> DataFrame:
    """The stream of a trail's rows that are newest of their key when they come.

    State is the order of a key's newest row: a row that another one has overtaken goes no further,
    and none is too late to be held against it. A timer ends the state when nothing has come for
    `keep`; a key that comes back then is passed on again, and readers settle which row is newer.
    """
    names, wait = rows.columns, max(int(keep.total_seconds() * 1000), 1)

    def newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable").iloc[[-1]]
        mine = tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x for x in found[order].iloc[0])
        if not state.exists or tuple(state.get) < mine:
            state.update(mine)
            yield found[names]
        state.setTimeoutDuration(wait)

    known = StructType([rows.schema[c] for c in order])
    return rows.groupBy(*keys).applyInPandasWithState(newest, rows.schema, known, "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_state(rows: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, keep: timedelta = timedelta(days=30)) -> None:
    """Current rows of a trail kept up to date: batches of changes upon a version that folds them.

    Only rows that moved their key are written. After FOLD_BATCHES batches the version and the
    changes become a new version; then what they were made of goes. A repeated batch writes its
    changes again, under the same name.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/changes={number}")
        known = versions.current(spark, path)
        if number - (known["upto"] if known else -1) < FOLD_BATCHES:
            return
        version = f"version={number}"
        latest(current_state(spark, path, batch.schema, keys, order, number), keys, order).write.mode("overwrite").parquet(f"{path}/{version}")
        versions.move(spark, path, {"version": version, "upto": number})
        gone = [f for f in versions.folders(spark, path, "changes=") if int(f.split("=")[1]) <= number]
        for folder in [*gone, *[f for f in versions.folders(spark, path, "version=") if f not in (version, known and known["version"])]]:
            versions.discard(spark, f"{path}/{folder}")

    with without_idle_batches(rows.sparkSession):
        run_available(newest_rows(rows, keys, order, keep), each, checkpoint)


def current_state(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str], upto: int | None = None) -> DataFrame:
    """The newest row of each key of a table that latest_state keeps."""
    known = versions.current(spark, path)
    since = known["upto"] if known else -1
    changes = [f for f in versions.folders(spark, path, "changes=") if since < int(f.split("=")[1]) and (upto is None or int(f.split("=")[1]) <= upto)]
    parts = [f"{path}/{f}" for f in [*([known["version"]] if known else []), *changes]]
    rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return latest(rows, keys, order)


#: What a finding is: the same of these is the same finding, said again.
FINDING = ["production_id", "shoot_day", "finding", "entity_id", "severity", "detail"]


def _read_below(spark: SparkSession, path: str, schema: StructType, below: int) -> DataFrame:
    """Rows (and `batch`) of the batches before a number, whatever a repeated run has left."""
    if not versions.folders(spark, path, "batch="):
        return spark.createDataFrame([], StructType([*schema.fields, StructField("batch", IntegerType())]))
    known = StructType([*schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(known).option("basePath", path).parquet(path).filter(F.col("batch") < below)


def reconcile_touched(events: DataFrame, spine: str, detect: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """After each batch, what changed in the findings of just the days that it touched.

    Events go to the spine first, a folder a batch. The days' findings as they are now are held
    against those that stand open: new ones are written as open, ones that no longer hold as
    withdrawn, the rest is left alone. detect: events to findings (FINDING). A repeated batch
    writes the same again.
    """
    schema = events.schema

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keep_batch(spine)(batch, number)
        days = batch.select("production_id", "shoot_day").distinct()
        days = F.broadcast(days) if days.limit(BROADCAST_DAYS + 1).count() <= BROADCAST_DAYS else days
        touched = _read_below(spark, spine, schema, number + 1).drop("batch").join(days, ["production_id", "shoot_day"], "left_semi")
        now = detect(touched).select(*FINDING).distinct().withColumn("holds", F.lit(True))
        stood = open_findings(spark, path, number).join(days, ["production_id", "shoot_day"], "left_semi").withColumn("stood", F.lit(True))
        same = [now[c].eqNullSafe(stood[c]) for c in FINDING]
        both = now.join(stood, reduce(and_, same), "full").select(*[F.coalesce(now[c], stood[c]).alias(c) for c in FINDING], "holds", "stood")
        changed = both.filter("holds is null or stood is null").select(*FINDING, F.col("holds").isNull().alias("withdrawn"))
        keep_batch(path)(changed, number)

    run_available(events, each, checkpoint)


def open_findings(spark: SparkSession, path: str, below: int = 2**31 - 1) -> DataFrame:
    """The findings (FINDING) that stand open after the batches before `below`."""
    schema = StructType([*[StructField(c, StringType()) for c in FINDING], StructField("withdrawn", BooleanType())])
    rows = _read_below(spark, path, schema, below)
    return rows.groupBy(*FINDING).agg(F.max_by("withdrawn", "batch").alias("withdrawn")).filter("not withdrawn").select(*FINDING)
