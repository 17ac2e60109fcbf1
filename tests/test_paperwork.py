from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.operators import reconcile
from takeledger.sources import ingest, reports
from takeledger.sources import paperwork as p
from takeledger.streaming import jobs

CAMERA = 'SCENE,TAKE,CAMERA ROLL,CLIP NAME,START TC,END TC,LENS,FPS,ISO,SHUTTER\n27/7,1,A_0120,A120_C001,09:00:00:00,09:01:00:00,"32mm, prime",24,800,180\n27-7,T02*,A120,A120_C002,,,,x,,\ncall me at office,1,A1,,,,,,,\n'
ALE = "Heading\nFIELD_DELIM\tTABS\n\nColumn\nName\tTracks\tStart\tEnd\tTape\tScene\tTake\tNotes\tSound Roll\n\nData\n27-7T01.WAV\t2\t09:00:00:00\t09:01:00:00\t280726\t27-7\t1\tok\tSR_001\n49WTT01.WAV\t2\t\t\t\t49WT\t\t\tSR01\n"
TC_LOG = "DAILY TIMECODE LOG\nDate: 31/08/2026\n\n1/1 1 09:00:00:00 A001 310826 Alice at the terminal\nmore of it\ncall tel: 600 123 456\n1/2 2* 09:24:00:00 A001 310826 Circled\n"
XML = '<Report><Volume name="V1"><Clip><FileName>A120C001.mov</FileName><Reel>A_0120</Reel><Bytes>12</Bytes><Hash type="xxHash">ab</Hash></Clip><Clip><FileName>A120C002.mov</FileName></Clip></Volume></Report>'
DPR = "PARTE DE PRODUCCION\nScenes Scheduled: 27, 49A\nScenes Complete: 27\nScenes Shot Not Scheduled:\nBOCATA: 11:07 Camera Cards: A120 - A123\nWRAP: 18:55\nSet-Ups: 14\nSlates: 27/7 - 8, 49/1 - 9\n"
SCRIPT = "Title: X\n\nINT. SERVER ROOM - NIGHT\n\nLights blink.\n\nALICE\n(mutters)\nThe hash is not matching.\n\nBOB (V.O.)\nWhat?\n\nCUT TO:\n\n12. EXT. ROOF - DAY\n\nALICE\nHere.\n"
THUMBS = "Pomfort Report\n\nName A001C001_260831.MOV\nReel/Tape A_0001_1EIC\nScene 1\nShot 1\nTake 1\nSensor FPS 24.000\n\nName 1-1T01.WAV\nScene 1\nShot 1\nTake 1\n"


def docs(spark, *texts):
    return spark.createDataFrame([("P1", "31", f"d{i}", f"f{i}", t) for i, t in enumerate(texts)], "production_id string, shoot_day string, doc_id string, filename string, content string")


def test_camera_and_sound(spark):
    got = p.parse_camera_csv(docs(spark, CAMERA, None, "")).orderBy("place").collect()
    assert [(r.slate, r.take_id, r.camera_roll, r.starred, r.fps, r.iso) for r in got] == [("27/7", "1", "A120", False, 24.0, 800), ("27/7", "2", "A120", True, 24.0, None)]
    assert got[0].lens == "32mm, prime"
    got = p.parse_sound_log(docs(spark, ALE)).orderBy("place").collect()
    assert [(r.slate, r.take_id, r.sound_roll, r.wild, r.tracks) for r in got] == [("27/7", "1", "SR01", False, "2"), ("49/WT", None, "SR01", True, "2")]


def test_timecode_log_xml_thumbnails(spark):
    got = reports.parse_timecode_log(docs(spark, TC_LOG)).orderBy("place").collect()
    assert [(r.slate, r.take_id, r.starred, r.camera_roll, r.note) for r in got] == [("1/1", "1", False, "A001", "A001 310826 Alice at the terminal more of it"), ("1/2", "2", True, "A001", "A001 310826 Circled")]
    got = p.parse_media_xml(docs(spark, XML, "no xml", None)).orderBy("file_name").collect()
    assert [(r.volume, r.file_name, r.camera_roll, r.size_bytes, r.checksum_type) for r in got] == [("V1", "A120C001.mov", "A120", 12, "xxHash"), ("V1", "A120C002.mov", None, 0, None)]
    got = p.parse_thumbnail_report(docs(spark, THUMBS)).orderBy("block").collect()
    assert [(r.file_name, r.camera_roll, r.slate, r.card_type) for r in got] == [("A001C001_260831.MOV", "A001", "1/1", "camera"), ("1-1T01.WAV", None, "1/1", "sound")]


def test_daily_report_and_screenplay(spark):
    r = p.parse_daily_report(docs(spark, DPR, "nothing")).collect()
    assert len(r) == 1 and [x.raw for x in r[0].scheduled] == ["27", "49A"] and r[0].shot_not_scheduled == [] and r[0].part_complete is None
    assert r[0].times == {"snack": "11:07", "wrap": "18:55"} and r[0].set_ups == 14 and r[0].camera_cards == "A120 - A123"
    assert [tuple(x) for x in r[0].slate_ranges] == [("27", 7, 8), ("49", 1, 9)]
    got = p.parse_screenplay(docs(spark, SCRIPT)).orderBy("place").collect()
    assert [(x.scene, x.kind, x.speaker, x.line) for x in got] == [("1", "action", None, "Lights blink."), ("1", "parenthetical", "ALICE", "(mutters)"), ("1", "dialogue", "ALICE", "The hash is not matching."), ("1", "dialogue", "BOB", "What?"), ("1", "action", None, "CUT TO:"), ("12", "dialogue", "ALICE", "Here.")]
    assert (got[0].location, got[0].time_of_day, got[-1].setting) == ("SERVER ROOM", "NIGHT", "EXT")


def test_daily_report_pages_single_slates_and_timings(spark):
    text = "Total Páginas: 3 2/8  Camera Cards: A1\nSlates: 27/7, 49A/1\ufffd9; x, 5\nNo table yet\n12 a b c\nINDIVIDUAL SCENE TIMINGS\nScene Read Shoot Diff\n27 1:10 1:20 +0:10\n\nnote\n49A 1 2 3 4\n"
    got = p.parse_daily_report(docs(spark, text, None, "", "Slates: none\n")).collect()
    assert len(got) == 1 and got[0].pages == "3 2/8" and got[0].camera_cards == "A1" and got[0].times == {}
    assert [tuple(x) for x in got[0].slate_ranges] == [("27", 7, 7), ("49A", 1, 9)]
    accents = p.parse_daily_report(docs(spark, "Citación General: 07:00  Primer motor mañana: 8:15\n")).collect()
    assert accents[0].times == {"general_call": "07:00", "first_shot_morning": "8:15"}
    assert [tuple(x) for x in got[0].scene_timings] == [("27", "1:10", "1:20", "+0:10"), ("49A", "1", "2", "3")]


def test_screenplay_heads(spark):
    got = p.screenplay_heads(docs(spark, SCRIPT, "A PLAIN TITLE\nby Ann\n\nno scene here\n", "", None, "title:\nPlain\nAuthor: A\nAuthor: B\n\nINT. X - DAY\n\nBO\nHi.\n", "INT. X - DAY\nhe waits\n")).orderBy("doc_id").collect()
    w = p.WARNINGS
    assert [(r.title, r.author, r.headings, r.warnings) for r in got] == [
        ("X", None, 2, []), ("A PLAIN TITLE", "Ann", 0, [w["headings"], w["cues"]]), ("f2", None, 0, [w["headings"], w["cues"], w["scenes"]]),
        ("f3", None, 0, [w["headings"], w["cues"], w["scenes"]]), ("Plain", "B", 1, []), ("f5", None, 1, [w["cues"]]),
    ]


def test_classify_route_infer(spark):
    df = spark.createDataFrame([("x_SD031_CAM_A.csv", ""), ("mix.ALE", ""), ("a.txt", "Timecode log"), ("v_D07_offload.xml", ""), ("DPR#12.pdf", ""), ("q.bin", "day : day 9")], "filename string, content string")
    got = [(r.department, r.topic, r.day) for r in p.routed(df).withColumn("day", p.inferred_day(F.col("filename"), F.col("content"))).collect()]
    assert got == [(d, f"production.raw.{d}", day) for d, day in (("camera", "31"), ("sound", None), ("script", None), ("dit", "7"), ("office", "12"), ("camera", "9"))]


def test_stream_equals_batch(spark, tmp_path):
    src = docs(spark, CAMERA, ALE, TC_LOG, "empty camera").withColumn("filename", F.concat("filename", F.when(F.col("doc_id") == "d0", "CAM_").when(F.col("doc_id") == "d1", "SOUND").otherwise("")))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.ingest(stream, *[str(tmp_path / x) for x in ("spine", "dead", "claims", "check")])
    want = ingest.parsed_events(src)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "spine")).collect()) == sorted(r.event_id for r in want.collect())
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "dead")).collect()} == {"d3"}
    assert {(r.doc_id, r.date) for r in spark.read.parquet(str(tmp_path / "claims")).collect()} == {("d2", "2026-08-31")}


def test_silent_detectors(spark):
    rows = [("P1", "31", "27/7", "1", "camera", "belief", "D1", "A120", "", None, "", "A120_C001", 1), ("P1", "31", "27/7", "1", "camera", "belief", "D1", "B039", "", None, "", "", 2), ("P1", "31", "27/7", "1", "script", "belief", "D2", "A120", "", True, "10:14:22:00", "", 3), ("P1", "31", "27/7", "1", "sound", "belief", "D3", "", "SR01", False, "10:14:22:05", "", 4)]
    w = spark.createDataFrame(rows, "production_id string, shoot_day string, slate string, take_id string, department string, axis string, doc_id string, camera_roll string, sound_roll string, starred boolean, timecode_in string, clip_name string, seq long")
    assert reconcile.circled_mismatches(w).count() == 0 and reconcile.camera_roll_mismatches(w).count() == 0 and reconcile.sound_roll_mismatches(w).count() == 0
    assert [r.detail for r in reconcile.timecode_drifts(w).collect()] == ["5"]
    media = spark.createDataFrame([("P1", "31", "A_0120C001_260728_091309_h1EIC.mxf"), ("P1", "31", "Z_0001C009.mov")], "production_id string, shoot_day string, file_name string")
    assert reconcile.paperwork_without_media(w, media).count() == 0 and reconcile.awaiting_offload(w, media).count() == 0
    assert [r.entity_id for r in reconcile.media_without_paperwork(w, media).collect()] == ["Z_0001C009.mov"]
    assert reconcile.awaiting_offload(w, media.limit(0)).count() == 1 and reconcile.paperwork_without_media(w, media.limit(0)).count() == 0
    assert w.select(n.scene_of_slate(F.col("slate")).alias("s")).first().s == "27"
