import random

import public_tokenizers
from tokenizers import Tokenizer

from takeledger.llm.bpe import BacktrackingBpe, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(3)
    letters = "abcdefgimnorstuy'0123456789 .éñßΣσςİ²½́你好🙂\t\n_-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    texts += ["".join(rng.choice("abet") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return texts + ["a" * 3000, "ab" * 2000, "x<|endoftext|>y <|startoftext|>Z", "\x1c a\x1fb\x85c", "", " ", "don't we'll 'S'T", "l'été É", "word " * 5000]


def test_encoding_and_decoding_equal_the_library():
    coder, lib, texts = BacktrackingBpe(PATH), library(), odd_texts()
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        spelled, ids = coder.encode(text)
        assert ids.tolist() == want.ids and spelled == " ".join(map(str, want.ids))
        assert coder.decode(ids).decode() == lib.decode(want.ids, skip_special_tokens=False)


def test_query_form(spark):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "y"), (2, None, "z"), (3, "", None), (None, "word", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_decode(df, PATH, outputs=("ids", "decoded")).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].ids == library().encode("Hello there", add_special_tokens=False).ids
    assert by[2].n_tokens == by[3].n_tokens == 0 and by[2].decoded == ""
    assert encode_decode(df.limit(0), PATH).count() == 0
