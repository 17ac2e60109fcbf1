import pytest
from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.functions import privacy as p


def each(spark, f, pairs):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, a string")
    got = [r[0] for r in df.orderBy("i").select(f(F.col("a"))).collect()]
    assert got == [b for _, b in pairs]


def test_camera_roll(spark):
    each(spark, n.camera_roll, [(x, y) for y, xs in {"A120": ["A120", "A_0120", "A_0120_1EIC", "a120"], "B039": ["B039", "B_0039_2EIC", "B39"], "C001": ["C001", "C_0001", "C1"]}.items() for x in xs] + [("", None), (None, None), ("ROLL?", "ROLL?"), ("A00000001234", "A1234")])


def test_sound_roll(spark):
    each(spark, n.sound_roll, [(x, "SR01") for x in ("SR01", "SR_001", "R01", "01")] + [(x, None) for x in ("280726", "20260728", "n/a", "MOS", "", None, "boom")] + [("26Y07M27", "26Y07M27"), ("sr12b", "SR12B")])


def test_slate(spark):
    each(spark, n.slate, [(x, "27/7") for x in ("27/7", "27-7", "27-7T01", "27/7T01")] + [("64A-1", "64A/1")] + [(x, "49/WT") for x in ("49WT", "49/WT", "49-WT", "49 WT", "49_WT", "49WTT01", "WT49", "WT/49")] + [("WT", "WT"), ("WILD", "WT"), (None, None), (" ", None)])


def test_scene_compound(spark):
    each(spark, n.scene_compound, [("21+25", ["21", "25"]), ("73C-74AC", ["73C", "74AC"]), ("64A", ["64A"]), (None, []), ("INT-EXT", ["INT-EXT"])])


@pytest.mark.parametrize(
    "raw,want",
    [(x, {"take_id": "1"}) for x in ("1", "01", "T1", "T01", "TK01", "TAKE 01")]
    + [("3*", {"take_id": "3", "starred": True}), ("T03*", {"take_id": "3", "starred": True}), ("3 VFX", {"take_id": "3", "vfx": True, "note": "VFX"}), ("2PK", {"take_id": "2PK", "pickup": True}), ("T02PK", {"take_id": "2PK", "pickup": True})]
    + [("FALSE", {"take_id": "FALSE", "valid": False, "false_start": True}), ("FC", {"take_id": "FALSE", "valid": False}), ("WT 01", {"take_id": "1", "wild": True}), ("WTT01", {"take_id": "1", "wild": True})]
    + [("1.1", {"take_id": "1.1"}), ("01.2", {"take_id": "1.2"}), ("2.10", {"take_id": "2.10"}), ("2.1*", {"take_id": "2.1", "starred": True}), ("1 MOS", {"take_id": "1", "mos": True}), (None, {"take_id": None, "valid": False}), ("*", {"take_id": None, "valid": False})],
)
def test_take(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "a string").select(n.take(F.col("a")).alias("t")).first()["t"].asDict()
    assert {k: got[k] for k in want} == want


def test_days_dates_and_times(spark):
    each(spark, n.shoot_day, [(x, "31") for x in ("SD31", "D031", "#31", "260728_SD31", "31")] + [(None, None)])
    each(spark, lambda c: n.shoot_date(c, F.lit("x"))["date"], [("260728_SD31 DATE: 01/02/2020", "2026-07-28"), ("Date: 28-7-26", "2026-07-28"), ("on 28.07.2026", "2026-07-28"), ("nothing", None), ("45/13/2026", None)])
    each(spark, lambda c: n.timecode_frames(c), [("10:14:22:05", (10 * 3600 + 14 * 60 + 22) * 24 + 5), ("10:14:22;00", (10 * 3600 + 14 * 60 + 22) * 24), ("1:2:3:4", None), (None, None)])
    each(spark, lambda c: n.wrap_moment(F.lit("2026-07-28"), c).cast("string"), [("18:55", "2026-07-28 18:55:00"), ("02:30", "2026-07-29 02:30:00"), ("25:00", None), ("x", None), (None, None)])
    each(spark, lambda c: n.classify_lag(c.cast("double")), [("172800", "handover"), ("172801", "backfill"), ("-5", "handover"), (None, None)])
    each(spark, n.size_bytes, [("5.5 KB", 5632), ("1 GB", 1 << 30), ("12", 12), ("x", None)])


def test_names_and_privacy(spark):
    each(spark, n.clip_stem, [("A120_C001.MOV", "A120_C001"), (None, ""), ("a.txt", "a.txt")])
    each(spark, lambda c: n.scene_and_shot(c)["shot"], [("27/7", 7), ("49/WT", None), ("64A-12B", 12), (None, None)])
    each(spark, n.scene_numbers, [("21+25/3", ["21", "25"]), ("WT", []), ("7/1", ["7"])])
    each(spark, n.handle, [("ana", "@ana"), ("@ana", "@ana"), (None, ""), (" ", "")])
    each(spark, p.redacted, [("A120 280726 2:46", "A120 280726 2:46"), ("tel: 600 123 456 x", "tel: [phone removed]x"), ("me@x.co", "[email removed]"), ("+34 600 123 456", "[phone removed]")])
    each(spark, p.is_contact, [("A120 280726", False), ("mobile 600123456", True), (None, False)])
