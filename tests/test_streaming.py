"""State, withdrawals and versions over several batches, against the same in one go."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from takeledger.operators import reconcile, rollups
from takeledger.sources import versions
from takeledger.streaming import jobs

TRAIL = "production_id string, target_id string, created timestamp, event_id long, status string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def stream_of(spark, rows, schema, folder, parts):
    """A stream of as many batches, the rows of each in order."""
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1)
    return source.option("recursiveFileLookup", "true").parquet(folder)


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_latest_state_over_batches(spark, tmp_path, monkeypatch, few_partitions):
    """Old events, ties, a repeated batch, state that ends, and versions that fold: always the newest rows."""
    rng = random.Random(1)
    rows = [(f"P{i % 2}", f"t{rng.randrange(6)}", at(rng.randrange(40)), i, f"s{i}") for i in range(60)]
    keys, order = ["production_id", "target_id"], ["created", "event_id"]
    want = {}
    for p, t, c, e, s in rows:
        want[p, t] = max(want.get((p, t), (at(-1), 0, "")), (c, e, s))
    monkeypatch.setattr(jobs, "FOLD_BATCHES", 2)
    parts = [range(0, 20), range(20, 40), range(0, 20), range(40, 60)]
    for name, keep in (("long", datetime.timedelta(days=30)), ("short", datetime.timedelta(0))):
        out = str(tmp_path / name)
        stream = stream_of(spark, rows, TRAIL, f"{out}/in", parts)
        jobs.latest_state(stream, keys, order, f"{out}/state", f"{out}/offsets", keep=keep)
        got = jobs.current_state(spark, f"{out}/state", stream.schema, keys, order).collect()
        assert {(r.production_id, r.target_id): (r.created, r.event_id, r.status) for r in got} == want and len(got) == len(want)
        assert len(versions.folders(spark, f"{out}/state", "version=")) <= 2 and len(versions.folders(spark, f"{out}/state", "changes=")) <= 2
        if name == "long":  # the third batch brings nothing new
            changes = spark.read.schema(stream.schema).parquet(*[f"{out}/state/{f}" for f in versions.folders(spark, f"{out}/state", "changes=")])
            assert changes.filter(F.col("event_id") < 20).count() == 0
    assert jobs.current_state(spark, str(tmp_path / "none"), stream.schema, keys, order).count() == 0


WITNESS = "production_id string, shoot_day string, slate string, take_id string, department string, doc_id string, camera_roll string, sound_roll string, starred boolean, timecode_in string, seq long"


def detect(w):
    return reconcile.circled_mismatches(w).unionByName(reconcile.roll_mismatches(w)).unionByName(reconcile.timecode_drifts(w))


def test_findings_follow_the_events_in_any_order(spark, tmp_path, few_partitions):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        rows.append((f"P{i % 2}", str(i % 3), f"{i % 4}/1", "1", rng.choice(["script", "camera"]), f"d{rng.randrange(3)}", rng.choice(["A001", "A002", "B001"]), "", rng.choice([True, False, None]), rng.choice(["10:00:00:00", "10:00:00:09", "11:00:00:00"]), i))
    # the last script row of each document settles the marks: what stood open before is withdrawn
    rows += [(p, d, f"{s}/1", "1", "script", f"d{k}", "", "", True, "", 1000 + k) for p in ("P0", "P1") for d in "012" for s in range(4) for k in range(3)]
    whole = {tuple(r[c] for c in jobs.FINDING) for r in detect(spark.createDataFrame(rows, WITNESS)).collect()}
    half = detect(spark.createDataFrame(rows[:120], WITNESS)).filter("finding = 'CIRCLED_TAKE_MISMATCH'").count()
    assert half and whole and not [f for f in whole if f[2] == "CIRCLED_TAKE_MISMATCH"]
    late_first = [range(120, len(rows)), range(60, 120), range(0, 60)]
    for name, parts in (("order", [range(0, 60), range(60, 120), range(120, len(rows))]), ("late", late_first)):
        out = str(tmp_path / name)
        stream = stream_of(spark, rows, WITNESS, f"{out}/in", parts)
        jobs.reconcile_touched(stream, f"{out}/spine", detect, f"{out}/findings", f"{out}/offsets")
        got = jobs.open_findings(spark, f"{out}/findings").collect()
        assert {tuple(r[c] for c in jobs.FINDING) for r in got} == whole and len(got) == len(whole)
        said = spark.read.parquet(f"{out}/findings")
        assert said.filter("withdrawn").count() > 0
        # nothing is said twice: every row of a finding turns the one before it
        flips = said.groupBy(*jobs.FINDING).agg(F.sum(F.when(F.col("withdrawn"), -1).otherwise(1)).alias("n")).filter("n not in (0, 1)")
        assert flips.count() == 0


def test_rebuild_keeps_the_old_tables_until_all_are_written(spark, tmp_path):
    path = str(tmp_path / "tables")
    one, two = spark.range(3), spark.range(5)
    assert rollups.rebuilt_table(spark, path, "a") is None
    assert [tuple(r) for r in rollups.rebuilt({"a": one, "b": two}, path).collect()] == [("a", 0, 3), ("b", 0, 5)]
    broken = two.select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        rollups.rebuilt({"a": two, "b": broken}, path)
    assert rollups.rebuilt_table(spark, path, "a").count() == 3 and rollups.rebuilt_table(spark, path, "b").count() == 5
    old = rollups.rebuilt_table(spark, path, "a")
    assert [tuple(r) for r in rollups.rebuilt({"a": two, "b": one}, path).collect()] == [("a", 3, 5), ("b", 5, 3)]
    assert old.count() == 3 and rollups.rebuilt_table(spark, path, "a").count() == 5
    rollups.rebuilt({"a": one}, path)
    assert len(versions.folders(spark, path, "version=")) == 2 and rollups.rebuilt_table(spark, path, "b") is None
