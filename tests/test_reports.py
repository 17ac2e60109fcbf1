"""Printed layouts: literal reports and what each says, line by line."""

from tests.test_paperwork import docs
from takeledger.sources import ingest, reports

CAMERA_LOG = """Demo Camera Report
ROLLA120 DATE28 Jul 2026 CAMERAArri Alexa 35 MAGAZINE #5
27/7 Lens(Cooke Anamorphic/i 50mm) StopF2 7/10 Color Temp6000K FPS24fps ISO800 Shutter172.8
1 001
2* 002
FC 003
Page 1
49/1 Lens65mmStopT2.8?Color Temp6000KFPS25fpsShutter180ISO400EI1 004
Notes VFX EN TOMAS 3 y 4
2 005
3 006
ROLL B039
117/1 Lens32mm
Notes VFX MOS
1* 001
"""
TIMECODE_LOG = """DAILY TIMECODE LOG
Date: 28/07/2026
27/7 109:26:12:04
09:28:58:12
slow push in
A1202807262:461
B392807262:46
after the fact
call tel: 600 123 456
49WT 1 10:00:00:00
C005
41+122A/4 2* 11:00:00:00 11:00:10 11:01:00:00 11:00:50 VFX plate A120 310726 2:46 1
"""
EDITOR_LOG = """DETAILED EDITOR'S LOG
printed 01/08/2026
27/7 1 Scene(s): 27 wide A120 280726 2:46
Shot on Day: Day 11
1 Dolly - wide B039 2:46
2* 2:53
49/1
1 Scene(s): 49
2 C005 1:10
6WT 1 Scene(s): 6 Wild Track: 6WT n/a 280726 0:29 pasos
Shot on Day: Day 12
64A 64AINT. OFFICE - DAY
5 D002 0:10
"""
VOLUME = """Volume Report
printed
664 SD
26Y07M27 5.51 GB
+99BDF-9T01.WAV
XXH64:1b742d797173f0d4
60.49 MB
49WTT02.WAV
MD5:abc123 1.5 KB
64A-2PkT5.WAV
XXH64:ff
1 KB
2 KB
A120_C001_260728.MOV
XXH64:aa
1 GB
lost.WAV
"""
DAY = "Shooting Day Report\nA_0120_1EIC A_ 3 10:31 min 7 10 GB\nB_0039_1C9B B_ 0 10:00 min 3 1 GB\n"
CLIPS = """Clips Report
27-7T01 Sound Dev: Mix664 S#KA05 3:00 min
A_0120C001_260728_091309_h1EIC A_ ARRI ALEXA 35 2:45 min 4608x3164 172.8° @ 24fps 50.0 mm 2 9/10 800 6000 K
"""


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("doc_id", "place", "file_name" if "file_name" in df.columns else "place").collect()]


def test_camera_log(spark):
    got = reports.parse_camera_log(docs(spark, CAMERA_LOG, None, ""))
    assert rows(got, "slate", "take_id", "camera_roll", "clip_name", "fps", "lens", "iso", "vfx") == [
        ("27/7", "1", "A120", "A120_C001", 24.0, "Cooke Anamorphic/i 50mm", 800, False),
        ("27/7", "2", "A120", "A120_C002", 24.0, "Cooke Anamorphic/i 50mm", 800, False),
        ("27/7", "FALSE", "A120", "A120_C003", 24.0, "Cooke Anamorphic/i 50mm", 800, False),
        ("49/1", "1", "A120", "A120_C004", 25.0, "65mm", 400, False),
        ("49/1", "2", "A120", "A120_C005", 25.0, "65mm", 400, False),
        ("49/1", "3", "A120", "A120_C006", 25.0, "65mm", 400, True),
        ("117/1", "1", "B039", "B039_C001", 25.0, "32mm", 400, True),
    ]
    assert [r.magazine for r in got.collect()] == ["#5"] * 7
    assert {(r.slate, r.mos, r.starred) for r in got.collect() if r.slate == "117/1"} == {("117/1", True, True)}


def test_timecode_log_in_both_layouts(spark):
    got = reports.parse_timecode_log(docs(spark, TIMECODE_LOG))
    assert rows(got, "slate", "take_id", "camera_roll", "timecode_in", "timecode_out", "recording_date", "note", "wild", "vfx") == [
        ("27/7", "1", "A120", "09:26:12:04", "09:28:58:12", "28/07/2026", "slow push in", False, False),
        ("27/7", "1", "B039", "09:26:12:04", "09:28:58:12", "28/07/2026", "slow push in after the fact", False, False),
        ("49/WT", "1", "C005", "10:00:00:00", None, "28/07/2026", None, True, False),
        ("41+122A/4", "2", "A120", "11:00:00:00", "11:01:00:00", "31/07/2026", "11:00:50 VFX plate A120 310726 2:46 1", False, True),
    ]


def test_editor_log_and_fallback(spark):
    got = reports.parse_script_log(docs(spark, EDITOR_LOG))
    assert rows(got, "slate", "take_id", "camera_roll", "recording_date", "stated_day", "inherited", "starred", "wild") == [
        ("27/7", "1", "A120", "28/07/2026", "11", False, False, False),
        ("27/7", "1", "B039", "28/07/2026", "11", False, False, False),
        ("27/7", "2", "B039", "28/07/2026", "11", True, True, False),
        ("49/1", "2", "C005", "01/08/2026", None, False, False, False),
        ("6/WT", "1", None, "01/08/2026", "12", False, False, True),
    ]


def test_offload_layouts_and_router(spark):
    got = reports.parse_offload_text(docs(spark, VOLUME, DAY, CLIPS, "nothing", None))
    assert rows(got, "doc_id", "file_name", "camera_roll", "slate", "take_id", "size_bytes", "checksum", "card_type", "pickup", "wild") == [
        ("d0", "+99BDF-9T01.WAV", None, "+99BDF/9", "1", int(60.49 * 2**20), "1b742d797173f0d4", "sound", False, False),
        ("d0", "49WTT02.WAV", None, "49/WT", "2", 1536, "abc123", "sound", False, True),
        ("d0", "64A-2PkT5.WAV", None, "64A/2", "5", 1024, "ff", "sound", True, False),
        ("d0", "A120_C001_260728.MOV", "A120", None, None, 2**30, "aa", "camera", False, False),
        ("d1", "A120_C001.mxf", "A120", None, None, 10 * 2**30 // 3, "VERIFIED-BACKUP-3+", "camera", False, False),
        ("d1", "A120_C002.mxf", "A120", None, None, 10 * 2**30 // 3, "VERIFIED-BACKUP-3+", "camera", False, False),
        ("d1", "A120_C003.mxf", "A120", None, None, 10 * 2**30 // 3, "VERIFIED-BACKUP-3+", "camera", False, False),
        ("d2", "27-7T01.WAV", None, "27/7", "1", None, "VERIFIED", "sound", False, False),
        ("d2", "A_0120C001_260728_091309_h1EIC.mxf", "A120", None, None, None, "VERIFIED", "camera", False, False),
    ]
    first = {r.file_name: r for r in got.collect()}
    assert (first["+99BDF-9T01.WAV"].volume, first["+99BDF-9T01.WAV"].reel_tape) == ("664 SD", "26Y07M27")
    assert first["A_0120C001_260728_091309_h1EIC.mxf"].details["tstop"] == "2 9/10"


def test_events_of_all_kinds_and_late_takes(spark):
    named = {"d0": "CAM_A.txt", "d1": "DetailedEditor.txt", "d2": "Volume.txt", "d3": "DPR.txt", "d4": "CAM_empty.txt"}
    base = docs(spark, CAMERA_LOG, EDITOR_LOG, VOLUME, "PARTE DE PRODUCCION\nScenes Complete: 27\n", " ")
    src = spark.createDataFrame([(r.production_id, r.shoot_day, r.doc_id, named[r.doc_id], r.content) for r in base.collect()], base.schema)
    events = ingest.parsed_events(src)
    assert {(r.doc_id, r.entity_type, r.axis): r["count"] for r in events.groupBy("doc_id", "entity_type", "axis").count().collect()} == {("d0", "take", "belief"): 7, ("d1", "take", "belief"): 5, ("d2", "media", "existence"): 4, ("d3", "day", "intent"): 1}
    assert {r.shoot_day for r in ingest.late_takes(events, src).collect()} == {"11", "12"}
    refused = ingest.rejected(src, events).collect()
    assert [(r.doc_id, r.error_type, r.reason) for r in refused] == [("d4", "PARSER_FAILURE", "empty document")]


def test_scene_timings(spark):
    text = "WRAP: 18:55\nIndividual Scene Timings\nScene Read Shoot Diff\n27 1:10 1:20 +0:10\n49A 0:30 0:20 -0:10\n"
    assert rows(reports.scene_timings(docs(spark, text, "27 1 2 3")), "scene", "read", "shoot", "difference") == [("27", "1:10", "1:20", "+0:10"), ("49A", "0:30", "0:20", "-0:10")]


def test_no_parser_shuffles(spark):
    from takeledger.sources import paperwork

    src = docs(spark, CAMERA_LOG, TIMECODE_LOG, EDITOR_LOG, VOLUME)
    parsers = [
        paperwork.parse_camera_csv, paperwork.parse_sound_log, paperwork.parse_media_xml, paperwork.parse_thumbnail_report, paperwork.parse_daily_report, paperwork.parse_screenplay,
        reports.parse_camera_log, reports.parse_timecode_log, reports.parse_editor_log, reports.parse_script_log, reports.parse_volume_report, reports.parse_day_report,
        reports.parse_clips_report, reports.parse_offload_text, reports.scene_timings,
    ]
    for parse in parsers:
        assert "Exchange" not in parse(src)._jdf.queryExecution().executedPlan().toString(), parse.__name__


def test_a_document_that_fails_is_one_row_and_the_others_are_read(spark):
    from takeledger.sources.documents import folded, lines_of

    def fold(t):
        if (t["line"] == "bad").any():
            raise ValueError("no such line")
        t["above"] = t.count(t["line"] != "")

    src = docs(spark, "a\nb", "ok\nbad\nx", "", None, "c", "a\nb").coalesce(1)
    got = folded(lines_of(src), "above int", fold).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.place, r.above, r.error) for r in got] == [
        ("d0", 0, 1, None), ("d0", 1, 2, None), ("d1", None, None, "ValueError: no such line"), ("d2", 0, 0, None), ("d3", 0, 0, None), ("d4", 0, 1, None), ("d5", 0, 1, None), ("d5", 1, 2, None),
    ]
    # a cell beyond what the reader of delimited text takes
    wide = "SCENE,TAKE\n27/7,1\n27/7,\"" + "x" * 140000 + '"\n'
    named = spark.createDataFrame([("P", "1", f"d{i}", "CAM_A.csv", t) for i, t in enumerate((wide, "SCENE,TAKE\n27/7,1\n", "nothing"))] + [("", "1", "d3", "CAM_A.csv", wide)], src.schema)
    said = ingest.parsed(named)
    assert [r.doc_id for r in ingest.parsed_events(named).collect()] == ["d1"]
    refused = sorted((r.doc_id, r.error_type, r.reason[:25]) for r in ingest.rejected(named, said).collect())
    assert refused == [("d0", "SYSTEM_ERROR", "Error: field larger than "), ("d2", "PARSER_FAILURE", "no valid rows"), ("d3", "INVALID", "no production or day")]


def test_documents_across_batches(spark):
    long = "ROLLA120\n27/7 Lens(50mm)\n" + "\n".join(f"{i} {i:03d}" for i in range(1, 400))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = reports.parse_camera_log(docs(spark, long, "1 001", long, CAMERA_LOG).coalesce(1)).groupBy("doc_id", "lens").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.doc_id, r["count"]) for r in got if r.lens == "50mm") == [("d0", 399), ("d2", 399)] and sum(r["count"] for r in got) == 399 * 2 + 7


def test_lines_of_long_documents_leave_with_their_batch(spark):
    from takeledger.sources import paperwork
    from takeledger.sources.documents import Lines, Passing, folded, lines_of

    scene = "INT. ROOM - DAY\n\nit rains\n\nANN\n" + "\n".join(f"word {i}" for i in range(25)) + "\n\nBO\n(low)\nyes\n\nit stops\n\n"
    src = docs(spark, scene * 4, "", "it rains", scene, None, scene * 2).coalesce(1)
    log = docs(spark, CAMERA_LOG * 3, "1 001", CAMERA_LOG).coalesce(1)
    volumes = docs(spark, VOLUME * 3, VOLUME, "none").coalesce(1)
    read = lambda: [sorted(map(str, p(d).collect())) for p, d in ((paperwork.parse_screenplay, src), (reports.parse_camera_log, log), (reports.parse_volume_report, volumes))]
    whole = read()
    assert all(whole)

    def fold(t):
        if not isinstance(t, Passing):
            raise ValueError("a whole document")
        t["most"], t["nth"] = len(t.frame), t.count(t["line"] != "")
        t["begun"], t["newest"] = t.first(t["line"].where(t["line"].str.startswith("word"))), t.last(t["line"].where(t["line"] == "BO"))

    try:
        for size in ("1", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert read() == whole
        lines = folded(lines_of(src), "most int, nth int, begun string, newest string", fold, passing=True).orderBy("doc_id", "place").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r.most for r in lines) == 7 and all(r.error is None for r in lines)
    of = [r for r in lines if r.doc_id == "d0"]
    assert [r.nth for r in of] == [sum(x.line != "" for x in of[: i + 1]) for i in range(len(of))]
    assert {r.begun for r in of[5:]} == {"word 0"} and {r.newest for r in of[35:]} == {"BO"} and [r.newest for r in lines if r.doc_id == "d3"][0] is None
    assert issubclass(Passing, Lines)


def test_delimited_rows_leave_in_bounded_batches_and_not_from_a_document_that_fails(spark):
    import pyarrow as pa

    from takeledger.sources import paperwork

    size = paperwork.READ_ROWS
    long = "SCENE,TAKE\n" + "".join(f"27/7,{i}\n" for i in range(2 * size + 5))
    late = long + '27/7,"' + "x" * 140000 + '"\n'
    batch = pa.RecordBatch.from_pylist([{"production_id": "P", "shoot_day": "1", "doc_id": d, "filename": "f", "content": t} for d, t in (("d0", long), ("d1", late), ("d2", None))])
    got = list(paperwork._delimited(iter([batch])))
    assert [(b.num_rows, b.column("doc_id")[0].as_py(), b.column("error")[0].as_py() is None) for b in got] == [(size, "d0", True), (size, "d0", True), (5, "d0", True), (1, "d1", False)]
    assert dict(got[2].column("cells")[4].as_py()) == {"SCENE": "27/7", "TAKE": str(2 * size + 4)} and got[2].column("place")[4].as_py() == 2 * size + 4


def test_expressions_of_parsers_are_written_out_once(spark):
    from takeledger.plans import registry
    from takeledger.sources import paperwork

    src = docs(spark, "x")
    for parse in (paperwork.parse_sound_log, reports.parse_script_log, reports.parse_offload_text):
        plan = parse(src)._jdf.queryExecution().optimizedPlan().toString()
        # the filters of a settled column name it, and don't hold what it is made of
        assert max(len(x) for x in plan.split("\n") if "Filter" in x[:80]) < 2500, parse.__name__
    plan = registry.QUERIES["editorial_progress"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(x) for x in plan.split("\n") if "Filter" in x[:120]) < 2500


def test_events_carry_department_and_axis_of_their_kind(spark):
    from takeledger.sources import paperwork

    names = {"camera_csv": "CAM_A.csv", "sound_ale": "mix.ALE", "script_timecode": "DetailedEditor.txt", "script_lined": "x_FACING.pdf", "offload": "offload.xml", "dpr": "DPR.pdf"}
    src = spark.createDataFrame([("P", "1", k, v, "") for k, v in names.items()], "production_id string, shoot_day string, doc_id string, filename string, content string")
    assert {r.doc_type: (r.department, r.axis) for r in paperwork.classified(src).collect()} == {k: v[2:] for k, v in ingest.PARSERS.items()}
    assert "Join" not in ingest.parsed(src)._jdf.queryExecution().optimizedPlan().toString()


def test_what_a_script_line_runs_through_is_small_enough_for_the_jvm_to_compile(spark, capsys):
    import re

    # methods of more than 8,000 bytes are interpreted for ever, line by line
    for parse in (reports.parse_editor_log, reports.parse_script_log):
        parse(docs(spark, EDITOR_LOG)).explain("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 8000, (parse.__name__, sizes)


def test_editor_log_of_odd_lines(spark):
    text = "\n".join((
        "4 lone A001", "5 lone Scene(s): B002", "27/7 1 moß C003", "vfx at dusk", "for D004 ſ", "2 VfX 010126", "02* 0:12 n", "27/7 1 E005", "INT. HALL", "3 F006", "x Scene(s): G007", "1 H008",
        "49/2", "", "1 Scene(s): 49", "MÖS I009 \u2028 J010", "x 12WT 2 Wild Track: 12WT n/a 280726 0:29 mos", "Shot on Day: Day SD012",
    ))
    got = reports.parse_editor_log(docs(spark, text, text))
    want = [
        ("27/7", "1", "C003", "moß C003", True, True, False, False), ("27/7", "1", "D004", "moß C003 vfx at dusk", True, True, False, False), ("27/7", "2", "D004", "0:12 n", False, False, True, True),
        ("27/7", "1", "E005", "E005", True, True, False, False), ("49/2", "1", "I009", "MÖS I009 \u2028 J010", False, False, False, False), ("12/WT", "2", None, "12WT n/a 280726 0:29 mos", False, False, False, False),
    ]
    assert rows(got, "doc_id", "slate", "take_id", "camera_roll", "note", "vfx", "mos", "starred", "inherited") == [(d, *w) for d in ("d0", "d1") for w in want]
