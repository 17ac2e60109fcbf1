"""Operators without a registered query: small cases each."""

import datetime
import random
import re

from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.functions import privacy
from takeledger.operators import analytics, ledger, reconcile, rollups, script, status
from takeledger.sources import ingest, paperwork
from takeledger.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def test_scalars(spark):
    lit = F.lit
    got = spark.range(1).select(
        n.split_slate_take(lit("21/1:4")).alias("a"), n.clean_roll_token(lit("#b004 +1")).alias("b"), n.shot_size(lit("Wide, low angle, dolly in")).alias("c"), n.shot_size(lit(None).cast("string")).alias("d"),
        n.clean_note(lit("Day 3  > 10:00:00 Scene(s): 4  he   waits")).alias("e"), n.target_id(lit("shot"), lit(" 27-7 ")).alias("f"), n.target_id(lit("scene"), lit("27/7")).alias("g"), n.production_id(lit(" the big one! ")).alias("h"),
        paperwork.is_handwritten(lit("some words only")).alias("i"), paperwork.is_handwritten(lit("27/7,1,x\n49/1,2,y")).alias("j"), paperwork.screenplay_id(lit("abc  ")).alias("k"), paperwork.screenplay_id(lit("abc")).alias("l"),
    ).first()
    assert (got.a.slate, got.a.take, got.b, tuple(got.c), tuple(got.d)) == ("21/1", "4", "B004", ("MS", "LOW_ANGLE", "DOLLY_IN"), ("MS", "EYE_LEVEL", "STATIC"))
    assert (got.e, got.f, got.g, got.h) == ("he waits", "27/7", "27", "THE_BIG_ONE!")
    assert not got.i and not got.j and got.k == got.l and len(got.k) == 16


def each(spark, function, cases):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string").select("i", function(F.col("a")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [w for _, w in cases]


def test_words_and_cues_by_hand(spark):
    each(spark, n.anchor_terms, [("The SLATE: Maya's lamp’s 'well-lit' x-ray, who knew? roll", ["maya's", "lamp's", "well-lit", "x-ray", "knew"]), (None, []), ("lamp lamp ab", ["lamp", "lamp"]), ("'''it--", [])])
    cues = ["CUT TO:", "> SMASH CUT TO:", "quick cut to", "HARD CUT TO BLACK.", "INTERCUT", "FADE IN:", "FADE TO BLACK", "WIPE TO:", "ZOOM TO WHITE.", "## CUT TO <", "TO:"]
    others = ["CUT TO the chase", "Match cut", "Wipe to:", "ALICE", "", None, "FADE TO"]
    each(spark, n.is_transition, [(c, True) for c in cues] + [(c, False) for c in others])
    each(spark, paperwork.is_handwritten, [("hello world", False), ("", False), (None, False), ("Camera report 7/9/2026 27/7", True), ("roll A1 27/7 27/8", False), ("roll, a, b", False), ("roll\tA", False), ("x" * 3000 + " roll", True)])
    each(spark, n.is_vague, [("", True), (" ", True), ("a typical man", True), ("typically", False), ("to be decided", True), ("n/a", True), ("a red coat", False)])
    costume = "he wears a long grey coat over a blue shirt and brown boots"
    each(spark, lambda c: n.is_vague(c, "look_and_costume"), [(costume, False), ("a red coat", True), ("he is a person who walks to the place and then comes back here", True)])
    each(spark, lambda c: n.shot_size(c, F.lit(True), F.lit(True))["size"], [("", "MS"), ("security detail", "INSERT"), ("ms", "MS")])
    each(spark, lambda c: n.shot_size(c, first=F.lit(True))["size"], [("", "WS"), ("Medium close up", "CU"), ("point of view", "POV")])


def test_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    got = paperwork.read_documents(spark, str(tmp_path / "in")).first()
    assert (got.filename, got.content, got.size) == ("a.txt", "hello", 5) and got.checksum.startswith("2cf24dba")
    d = spark.createDataFrame([("demo.txt", "P1", False), ("x", "P1", False), ("y", "P2", True), (None, "A DEMO", None)], "filename string, production_id string, synthetic boolean")
    assert {r.filename for r in privacy.servable(d).collect()} == {"demo.txt", "y", None} and privacy.servable(d, True).count() == 4
    e = spark.createDataFrame([("P1", "1", "a"), ("P2", "2", "b")], "production_id string, shoot_day string, x string")
    ingest.write_spine(e, str(tmp_path / "spine"))
    ingest.write_spine(e, str(tmp_path / "spine"))
    assert spark.read.parquet(str(tmp_path / "spine")).filter("production_id = 'P1'").count() == 2
    w = spark.createDataFrame([("requirement_event",), ("camera_csv",), (None,)], "doc_type string")
    assert analytics.paperwork_only(w).count() == 2


def test_trails(spark):
    rows = spark.createDataFrame([("d", 0, "A", None), ("d", 1, None, "x"), ("d", 2, "B", None), ("d", 3, None, None)], "doc string, place int, roll string, note string")
    got = ledger.forward_filled(rows, ["doc"], ["place"], ["roll", "note"], F.col("roll") == "B").orderBy("place").collect()
    assert [(r.roll, r.note) for r in got] == [("A", None), ("A", "x"), ("B", None), ("B", None)]
    heads = spark.createDataFrame([("s", 0, None), ("s", 1, "12"), ("s", 2, None)], "script_id string, place int, number string")
    assert [r.number for r in rollups.numbered_scenes(heads).orderBy("place").collect()] == ["1", "12", "2"]
    notes = spark.createDataFrame([("@Ana", None), ("@ana", None), ("@bo", at(1))], "recipient string, read_at timestamp")
    assert [tuple(r) for r in rollups.unread_counts(notes).collect()] == [("@ana", 2)]
    tags = spark.createDataFrame([(1, "vfx,sound", "Open"), (2, "", "open"), (3, "sound", "done")], "id int, needs string, status string")
    assert [r.id for r in status.listed(tags, ["id"], 5, needs="Sound", status=None).collect()] == [3, 1]
    assert [r.id for r in status.listed(tags, ["id"], 1, status="OPEN").collect()] == [2]


def test_findings_meet_resolutions_and_takes(spark):
    rows = [("P", "1", "27/7", "1", "camera", "A120", "", "10:00:00:00", 1), ("P", "1", "27/7", "1", "sound", "", "SR01", "", 2)]
    w = spark.createDataFrame(rows, "production_id string, shoot_day string, slate string, take_id string, department string, camera_roll string, sound_roll string, timecode_in string, seq long")
    f = spark.createDataFrame([("P", "1", "27/7 Take 1", "ROLL_MISMATCH", "CRITICAL", "x")], "production_id string, shoot_day string, entity_id string, finding string, severity string, detail string")
    got = rollups.take_diagnosis(w, f).first()
    assert got.evidence == "camera A120  10:00:00:00; sound  SR01 " and got.findings == "ROLL_MISMATCH x"
    known = reconcile.finding_id(f).first().finding_id
    for rid, entity, want in ((known, "other", "kept"), ("none", "27/7 Take 1", "kept"), ("none", "other", None)):
        r = spark.createDataFrame([(rid, "P", "1", entity, "kept")], "finding_id string, production_id string, shoot_day string, entity_id string, resolution string")
        assert reconcile.with_resolutions(f, r).first().resolution == want


def test_sound_files_meet_takes_and_wild_tracks(spark):
    rows = [("27/7", "1"), ("49/WT", "2"), ("64A/2", "5"), ("12/3", "4"), ("99BDF", "1")]
    takes = spark.createDataFrame([("P", "1", s, t, "belief", "", "") for s, t in rows], "production_id string, shoot_day string, slate string, take_id string, axis string, clip_name string, camera_roll string")
    names = ["27-7T01.WAV", "277T1.wav", "27-7T11.WAV", "49WTT02.WAV", "49-WTT2.WAV", "+64A/2T005.WAV", "1-23T04.WAV", "+99BDF-T01.WAV", ".27-7T01.WAV", "x.mov"]
    media = spark.createDataFrame([("P", "1", f, "", None, None, None) for f in names], "production_id string, shoot_day string, file_name string, camera_roll string, scene string, shot string, take_id string")
    assert {r.entity_id for r in reconcile.media_without_paperwork(takes, media).collect()} == {"27-7T11.WAV", "1-23T04.WAV", "x.mov"}
    met = {(r.slate, r.file_name) for r in rollups.match_take_media(takes, media).collect()}
    assert met == {("27/7", "27-7T01.WAV"), ("27/7", "277T1.wav"), ("49/WT", "49WTT02.WAV"), ("49/WT", "49-WTT2.WAV"), ("64A/2", "+64A/2T005.WAV"), ("99BDF", "+99BDF-T01.WAV")}


def test_reported_files_meet_takes_by_shot(spark):
    takes = spark.createDataFrame([("P", "1", s, t, c, r) for s, t, c, r in (("49/5", "1", "", "A120"), ("49/6", "1", "", ""), ("50", "2", "", ""), ("51/1", "1", "A121_C004", "A121"))], "production_id string, shoot_day string, slate string, take_id string, clip_name string, camera_roll string")
    files = [("a", "A120", "49", "5", "01"), ("b", "B001", "49", "49/5", "1"), ("c", "", "49", "49", "1"), ("d", "", "+50", None, "2"), ("e", "", "49", "6", "1VFX"), ("card_A121_C004_x.mov", "", None, None, None), ("A_0121C0041.mxf", "", None, None, None), ("A_0121_C004.mxf", "", None, None, None)]
    media = spark.createDataFrame([("P", "1", *f) for f in files], "production_id string, shoot_day string, file_name string, camera_roll string, scene string, shot string, take_id string")
    met = {(r.slate, r.file_name) for r in rollups.match_take_media(takes, media).collect()}
    assert met == {("49/5", "a"), ("50", "d"), ("49/6", "e"), ("51/1", "card_A121_C004_x.mov"), ("51/1", "A_0121_C004.mxf")}


def test_scripts(spark):
    lines = spark.createDataFrame([("s", 1, 0, "MAYA", "Stop! Who is there?"), ("s", 1, 1, "BO", "me"), ("s", 2, 0, "MAYA", "wait")], "script_id string, scene int, place int, speaker string, line string")
    acts = spark.createDataFrame([("s", 1, 5, "MAYA CHEN, 30s, sits hunched. THE DAY, it goes."), ("s", 1, 6, "Maya waits, she nods to her left."), ("s", 2, 1, "ZED, aged 40, runs.")], "script_id string, scene int, place int, action string")
    assert {(r.speaker, r.traits) for r in script.trait_hints(lines).collect()} == {("MAYA", "Commanding,Inquisitive,Guarded,Urgent"), ("BO", "")}
    d = script.descriptors(lines, acts)
    assert [(r.speaker, r.full_name, r.description, r.age) for r in d.collect()] == [("MAYA", "MAYA CHEN", "30s, sits hunched", "30s")]
    tally = {r.speaker: (r.she, r.he, r.label) for r in script.pronoun_tally(lines, acts).collect()}
    assert tally == {"MAYA": (2, 0, "woman"), "BO": (0, 0, "")}
    told = spark.createDataFrame([("s", "BO", "an old gentleman")], "script_id string, speaker string, description string")
    assert {r.speaker: r.label for r in script.pronoun_tally(lines, acts, told).collect()}["BO"] == "man"
    heads = spark.createDataFrame([("s", 1, "LAB", "MAYA"), ("s", 2, "ROOF", "MAYA"), ("s", 2, "ROOF", "ZED")], "script_id string, scene int, setting string, speaker string")
    seen = {r.speaker: r for r in script.character_evidence(lines, acts, heads).collect()}
    assert seen["MAYA"].said == "Stop! Who is there?|wait" and seen["MAYA"].settings == "LAB|ROOF" and not seen["MAYA"].silent and seen["ZED"].silent
    links = spark.createDataFrame([("P1", "s"), ("P2", "s"), ("P3", "t")], "production_id string, script_id string")
    assert {r.production_id for r in rollups.script_productions(links, lines).collect()} == {"P1", "P2"}
    scenes = spark.createDataFrame([("s", "12a", 4, "x"), ("s", "12A", 9, "y"), ("s", "13", 1, "z")], "script_id string, scene string, place int, body string")
    asked = spark.createDataFrame([("s", "12A")], "script_id string, scene string")
    assert [(r.nth, r.body) for r in rollups.scenes_by_number(scenes, asked).orderBy("nth").collect()] == [(1, "x"), (2, "y")]
    targets = spark.createDataFrame([("P", "s", "13"), ("P", "s", "99"), ("P", None, "1"), ("P", "s", "none")], "production_id string, script_id string, target string")
    assert {r.target: r.status for r in rollups.script_context(targets, scenes).collect()} == {"13": "found", "99": "scene_not_in_script", "1": "no_script", "none": "no_scene_number"}


def test_gaps_and_dates(spark):
    p = lambda *x: spark.createDataFrame([(v,) for v in x], "production_id string")
    got = status.setup_gaps(p("A", "B"), p("A"), p("A", "B"), p("B")).collect()
    assert {tuple(r) for r in got} == {("B", "crew"), ("A", "script")}
    docs = spark.createDataFrame([("P", "1", f"d{i}", "f", t) for i, t in enumerate(("Date: 31/08/2026", "Date: 30/08/2026", "none"))], "production_id string, shoot_day string, doc_id string, filename string, content string")
    have = spark.createDataFrame([("d0",)], "doc_id string")
    assert [(r.doc_id, r.date) for r in rollups.backfilled_dates(docs, have).collect()] == [("d1", "2026-08-30")]


def stream(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def kept(spark, df, folder):
    jobs.run_available(df, jobs.keep_batch(f"{folder}/out"), f"{folder}/offsets")
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out").collect()


def test_rates_close_windows_and_leave_late_rows(spark, tmp_path):
    schema = "created_at timestamp, department string"
    batches = [[(at(1, 1), "camera"), (at(1, 2), "camera")], [(at(12), "sound")], [(at(12, 1), "sound")], [(at(1, 5), "camera"), (at(11), "sound")], [(at(25), "script")]]
    rows = kept(spark, jobs.filing_rate(stream(spark, str(tmp_path / "in"), batches, schema)), str(tmp_path))
    got = {(r["from"].day, r.department): r.events for r in rows}
    # the row of day 1 that comes after day 12 is late; day 25's window is still open
    assert got == {(1, "camera"): 2, (11, "sound"): 1, (12, "sound"): 2}


def test_stream_dedupe_feed_and_acknowledgements(spark, tmp_path):
    schema = "production_id string, shoot_day string, checksum string, uploaded_at timestamp"
    batches = [[("P", "1", "a", at(1, 1)), ("P", "1", "a", at(1, 2))], [("P", "1", "a", at(1, 3)), ("P", "2", "a", at(1, 4))]]
    docs = stream(spark, str(tmp_path / "docs"), batches, schema)
    assert len(kept(spark, jobs.deduplicated(docs), str(tmp_path / "d"))) == 2
    wanted = spark.createDataFrame([("all", "ALL", "ALL"), ("day", "P", "2"), ("none", "Q", "ALL")], "subscription string, production_id string, shoot_day string")
    fed = kept(spark, jobs.live_feed(docs, wanted), str(tmp_path / "f"))
    assert sorted(r.subscription for r in fed) == ["all"] * 4 + ["day"]
    created = stream(spark, str(tmp_path / "c"), [[("R1", at(1)), ("R2", at(1))], [("R9", datetime.datetime(2024, 6, 1))]], "requirement_id string, created_at timestamp")
    acks = stream(spark, str(tmp_path / "a"), [[("R1", "@ana", at(3))], [("R9", "@bo", datetime.datetime(2024, 6, 2))]], "target_id string, actor string, acted_at timestamp")
    got = {r.requirement_id: r.actor for r in kept(spark, jobs.first_acknowledgements(created, acks), str(tmp_path / "k"))}
    assert got["R1"] == "@ana" and got.get("R2", None) is None


def test_names_inside_file_names(spark):
    """Any substring, short names too, against plain containment."""
    rng = random.Random(4)
    clips = ["".join(rng.choices("AB1_", k=rng.randint(1, 11))) for _ in range(40)] + ["A001_C001", "C001"]
    names = ["".join(rng.choices("AB1_", k=rng.randint(1, 30))) + ".mov" for _ in range(60)] + ["xA001_C001_9.mov", "A001_C0011.mov", "a001_c001.mov"]
    takes = spark.createDataFrame([("P", str(i % 2), f"S{i}", "x", c, "") for i, c in enumerate(clips)], "production_id string, shoot_day string, slate string, take_id string, clip_name string, camera_roll string")
    media = spark.createDataFrame([("P", str(i % 2), f, "", None, None, None) for i, f in enumerate(names)], "production_id string, shoot_day string, file_name string, camera_roll string, scene string, shot string, take_id string")
    got = {(r.slate, r.file_name) for r in rollups.match_take_media(takes, media).collect()}
    want = {(f"S{i}", f) for i, c in enumerate(clips) for j, f in enumerate(names) if i % 2 == j % 2 and c in f}
    assert want <= got and len(want) > 50
    loose = re.compile(r"^[A-Z]_?\d{3,4}_?C\d{3,4}")
    assert all(loose.match(clips[int(s[1:])]) for s, f in got - want)  # camera, roll and number


def test_ranges_of_any_length(spark):
    ranges = spark.createDataFrame([("P", "1", "27", "1", "99999999999", 1), ("P", "1", "28", "9", "3", 1), ("P", "1", "29", "x", "3", 1)], "production_id string, shoot_day string, scene string, first string, last string, seq long")
    logged = spark.createDataFrame([("P", "1", s) for s in ("27/7", "27-7", "27/8", "28/3", "28/10", "29/1")], "production_id string, shoot_day string, slate string")
    assert {(r.scene, r.stated, r.covered) for r in rollups.slates_covered(ranges, logged).collect()} == {("27", 99999999999, 2), ("28", 7, 1), ("29", 1, 0)}


def test_a_ledger_of_takes_needs_no_shuffle(spark):
    rows = [("P", "1", f"{i % 5}/1", str(i % 3), "script" if i % 2 else "camera", f"D{i % 4}", f"A{i % 2:03d}", "SR01" if i % 4 else "SR02", bool(i // 7 % 2), f"10:00:00:{i % 20:02d}", i) for i in range(60)]
    w = spark.createDataFrame(rows, "production_id string, shoot_day string, slate string, take_id string, department string, doc_id string, camera_roll string, sound_roll string, starred boolean, timecode_in string, seq long")
    spark.sql("DROP TABLE IF EXISTS takes_of_test")
    kept = ledger.write_takes(w, "takes_of_test", 4)
    for check in (reconcile.circled_mismatches, reconcile.roll_mismatches, reconcile.timecode_drifts):
        assert "Exchange" not in check(kept)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, check(kept).collect())) == sorted(map(tuple, check(w).collect())) != []
    spark.sql("DROP TABLE takes_of_test")


def test_reopening_takes_the_resolution_with_it(spark):
    rows = [("r", "P", 1, at(1), "open", None), ("r", "P", 2, at(2), "resolved", "@a"), ("r", "P", 3, at(3), "open", "@a"), ("r", "P", 4, at(4), "dismissed", None), ("r", "P", 5, at(5), "open", None)]
    e = spark.createDataFrame([(*r[:5], "low", "@b", r[5]) for r in rows], "requirement_id string, production_id string, event_id int, created_at timestamp, status string, priority string, assignee string, resolved_by string")
    got = [(r.event_id, r.change, r.fields) for r in ledger.requirement_changes(e).orderBy("event_id").collect()]
    assert got == [(1, "created", ""), (2, "status_changed", "status:open>resolved"), (3, "reopened", "status:resolved>open,resolved_by:@a>"), (4, "status_changed", "status:open>dismissed"), (5, "status_changed", "status:dismissed>open")]



def test_rolls_of_a_take_are_compared_by_camera_and_sound_apart(spark):
    rows = [
        ("P", "1", "5/1", "1", "A001", "SR01"), ("P", "1", "5/1", "1", "A002", "25Y07M12"), ("P", "1", "5/1", "1", "B001", None),
        ("P", "1", "5/1", "1", "A001", "SR01"), ("P", "1", "5/1", "2", "a003", "SR01"), ("P", "1", "5/1", "2", "A004", "SR02"),
        ("P", "1", "5/1", "3", "7", ""), ("P", "1", "5/1", "3", "8", None), ("P", "1", "5/1", "4", None, None), ("P", "1", "5/1", "4", "", ""),
    ]
    w = spark.createDataFrame(rows, "production_id string, shoot_day string, slate string, take_id string, camera_roll string, sound_roll string")
    said = lambda df: sorted((r.entity_id, r.severity, r.detail) for r in df.collect())
    camera = [("5/1 Take 1", "CRITICAL", "A:A001,A002"), ("5/1 Take 2", "CRITICAL", "A:A004,a003"), ("5/1 Take 3", "CRITICAL", "A:7,8")]
    sound = [("5/1 Take 2", "WARNING", "SR01,SR02")]
    assert said(reconcile.camera_roll_mismatches(w)) == camera
    assert said(reconcile.sound_roll_mismatches(w)) == sound
    assert said(reconcile.roll_mismatches(w)) == sorted(camera + sound)
    assert said(reconcile.roll_mismatches(w.limit(0))) == []


def test_take_rollup_normalises_slates_after_they_are_distinct(spark):
    from takeledger.plans import registry

    plan = registry.QUERIES["take_rollup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    said = [line.lstrip(" :+-").split(" ")[0] for line in plan if "WILD" in line]
    assert said and set(said) <= {"Aggregate", "Generate"}


def reconciled(spark, rows, media, scenes, ranges, dates):
    """All findings by the checks that read the witnesses themselves, and by the one job."""
    day = "production_id string, shoot_day string, "
    w = spark.createDataFrame(rows, day + "slate string, take_id string, department string, axis string, doc_id string, scene string, camera_roll string, sound_roll string, starred boolean, timecode_in string, clip_name string, seq long")
    m, s = spark.createDataFrame(media, day + "file_name string"), spark.createDataFrame(scenes, day + "scene string, axis string, state string, office_state string")
    r, d = spark.createDataFrame(ranges, day + "scene string, first string, last string, seq long"), spark.createDataFrame(dates, day + "date string")
    alone = [
        *[check(w) for check in (reconcile.circled_mismatches, reconcile.camera_roll_mismatches, reconcile.sound_roll_mismatches, reconcile.timecode_drifts)],
        *[check(w, m) for check in (reconcile.paperwork_without_media, reconcile.media_without_paperwork, reconcile.awaiting_offload)],
        reconcile.scene_findings(s, w), reconcile.slates_outside_range(w, r), reconcile.date_disagreements(d),
    ]
    said = lambda df: sorted(map(str, df.collect()))
    return sum(map(said, alone), []), said(reconcile.reconcile(w, m, s, r, d))


def test_all_checks_find_together_what_each_finds_alone(spark, monkeypatch):
    rng = random.Random(12)
    day = lambda: (rng.choice(["P0", "P1", None]), rng.choice(["1", "2", "3", None]))
    pick = rng.choice
    rows = [
        (*day(), pick(["1/1", "1-2", "2/7", None]), pick(["1", "2", None]), pick(["script", "camera"]), pick(["belief", "existence", None]), pick(["d1", "d2", None]), pick(["1", "9", "", None]),
         pick(["A001", "A002", "b1", "", None]), pick(["SR01", "SR02", "25Y07M12", "", None]), pick([True, False, None]), pick(["10:00:00:00", "10:00:00:05", "10:00:01:00", "x", "", None]), pick(["A001_C001", "A002_C002", "", None]), pick([*range(9), None]))
        for _ in range(900)
    ]
    # one claim of a take that many rows make, and the same place twice
    rows += [("P2", "1", "5/1", "1", "camera", "belief", "d", "5", "A001", "", None, f"10:00:00:{t:02d}", "A001_C009", seq) for seq, t in ((7, 20), (3, 4), (3, 9), (5, 1), (9, 2))]
    media = [(*day(), pick(["A_0001C001.mov", "1-1T01.WAV", "1-2T02.wav", ".x", "z.mov", "", None])) for _ in range(12)]
    scenes = [(*day(), pick(["1", "2", "9", None]), pick(["intent", "belief"]), pick(["scheduled", None]), pick(["complete", "part_complete", "not_shot", "scheduled_not_shot", "shot_not_scheduled", None])) for _ in range(60)]
    # each place once: which of two last ranges counts is open
    ranges = [(*day(), pick(["1", "2", None]), pick(["1/3", "2", "x", None]), pick(["4", "3", None]), seq) for seq in range(40)]
    dates = [(*day(), pick(["1995-01-01", "1995-01-02", None])) for _ in range(30)]
    alone, together = reconciled(spark, rows, media, scenes, ranges, dates)
    kinds = {k for k in ("CIRCLED", "ROLL_MISMATCH", "TIMECODE_DRIFT", "PAPERWORK_WITHOUT", "MEDIA_WITHOUT", "AWAITING", "COMPLETE_WITHOUT", "NOT_SHOT", "NOT_SCHEDULED", "OUTSIDE", "DATE_DIS") if not any(k in f for f in alone)}
    assert not kinds and together == sorted(alone)
    assert any("5/1 Take 1" in f and "TIMECODE_DRIFT" in f and "detail='5'" in f for f in together)
    monkeypatch.setattr(reconcile, "BROADCAST_TAKES", 0)
    assert reconciled(spark, rows, media, scenes, ranges, dates)[1] == together


def test_takes_of_one_hash_keep_their_first_witnesses(spark, monkeypatch):
    rows = [("P", "1", "1/1", t, "b", "", r, "", "", f"10:00:00:{seq:02d}", seq) for t, r, seq in (("1", "A1", 1), ("1", "A2", 2), ("1", "A1", 9), ("2", "A1", 3), ("2", "A2", 6), ("2", "A2", 8))]
    w = spark.createDataFrame(rows, "production_id string, shoot_day string, slate string, take_id string, axis string, scene string, camera_roll string, sound_roll string, clip_name string, timecode_in string, seq long")
    kept = lambda df: sorted((r.take_id, r.seq) for r in reconcile.earliest(df, reconcile.claims(df)).collect())
    assert kept(w) == [("1", 1), ("1", 2), ("2", 3), ("2", 6)]
    monkeypatch.setattr(reconcile.F, "xxhash64", lambda *_: F.length("slate").cast("long"))
    assert kept(w) == [("1", 1), ("1", 2), ("2", 3), ("2", 6)]
    lone = w.filter("take_id = '1' or camera_roll = 'A2'")  # take 2 has one claim, and so no bound
    assert kept(lone) == [("1", 1), ("1", 2), ("1", 9), ("2", 6), ("2", 8)]


def test_reconcile_reads_each_table_for_few_checks(spark):
    from takeledger.plans import registry

    plan = registry.QUERIES["reconcile_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # marks, timecodes, ranges and dates; claims, files and scenes were read once before
    assert plan.count("l_orderkey") and sum("Relation" in line and "l_orderkey" in line for line in plan.split("\n")) == 4
