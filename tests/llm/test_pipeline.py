import corpus_pipeline
from takeledger.llm import decontam, jaccard

WORDS = "the of and to in that was for with on as his they at be this from have or by one had not but what all were when we there can an your which their".split()

BENCH = " ".join(w + "yy" for w in WORDS)


def text(seed, n=40):
    return " ".join(WORDS[(seed * 7 + k * k * (seed % 5 + 1)) % len(WORDS)] + "abcdefghij"[(seed + k) % 10] for k in range(n))


def test_each_stage_takes_effect(spark, tmp_path):
    rows = [(i, text(i), "en", "s", 1) for i in range(30)]
    rows += [(100, text(1), "en", "s", 1), (101, text(2) + " tail", "en", "s", 1), (102, None, None, None, None), (103, "123 456", "en", "s", 1), (104, "", "en", "s", 1)]
    rows += [(105, "so " + BENCH + " end", "en", "s", 1), (106, " ".join(w + "zz" for w in WORDS) + " mail me at some.one@mail.example.com soon", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {100, 101, 102, 103, 104, 105} & set(got) and {1, 2, 106} <= set(got)
    assert all(len(r.ids) == r.n_tokens for r in got.values())
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == docs.columns, name
        before = {r.doc_id: r.text for r in now.collect()}
        kept = {r.doc_id: r.text for r in after.collect()}
        if name == "near_duplicates":
            assert set(kept) == {r.doc_id for r in jaccard.near_duplicates(now).collect() if r.doc_id == r.class_id}
        if name == "decontamination":
            bench = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
            assert set(before) - set(kept) == {r.doc_id for r in decontam.overlaps(now, bench).collect()} == {105}
        if name == "personal_data":
            assert set(before) == set(kept) and "[EMAIL]" in kept[106] and "example.com" not in kept[106]
        now = spark.createDataFrame(after.collect(), docs.schema)


def test_odd_rows_through_every_stage(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, clashing columns, then no rows at all."""
    rows = [(i, text(i), "en", "s", 1, "x", 0.5) for i in range(12)]
    rows += [(None, text(40), "en", None, None, None, None), (3, text(3), "en", "s", 1, "x", 0.5), (50, None, None, None, None, None, None), (51, "", "en", "s", 0, "", 0.0)]
    rows += [(52, "so long " + " ".join(text(k, 200) for k in range(400)), "en", "s", 1, "x", 1.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__lang_pred` string, score double"
    docs = spark.createDataFrame(rows, schema.replace("`__lang_pred`", "spans"))
    for frame in (docs, docs.limit(0)):
        folder = str(tmp_path / ("full" if frame is docs else "none"))
        frame.coalesce(2).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, BENCH), (2, None), (None, BENCH), (3, "")], "item_id long, text string").limit(4 if frame is docs else 0).write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, folder)
            assert after.columns == docs.columns, name
            kept = after.collect()
            if name == "near_duplicates":
                assert [r.doc_id for r in kept].count(3) == (1 if frame is docs else 0)
            assert all(r.doc_id not in (50, 51) for r in kept)
            now = spark.createDataFrame(kept, docs.schema)
        got = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in got} == {r.doc_id for r in kept} and ((52 in {r.doc_id for r in got}) == (frame is docs))
        assert len(got) == len(kept)
