import public_tokenizers
from tokenizers import Tokenizer

from takeledger.llm.tokencount import RankMerger, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "aaaaaaaaaaa", "Hello  world\n\n don't  ", "naïve café ñandú 你好 🙂🙂", "x<|endoftext|>y <|endoftext|>", "a b" * 3000, "lorem1234 ipsum_-- !!", "ab" * 4000, "   x\t\t\r\n y", "loooooooong" * 50]


def expected():
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in TEXTS]


def test_merger_equals_library():
    assert RankMerger(PATH).counts(TEXTS) == expected()


def test_query_shape_and_limit(spark):
    rows = [(i, t, "other") for i, t in enumerate(TEXTS)] + [(3, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts(df, PATH).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, n in enumerate(expected()):
        assert by[i].n_tokens == n and by[i].n_bytes == len((TEXTS[i] or "").encode()) and by[i].over_limit == (n > 512)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
