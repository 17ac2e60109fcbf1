"""From raw documents to token ids: five stages, each over all rows that the one before kept.

All stages take tables without rows, null and empty texts, texts of any length, repeated rows and
columns besides doc_id and text of any name; what each makes of them stands in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeledger.llm import bpe, decontam, jaccard, langid, pii
from takeledger.llm.common import discard, settled_at, shared_folder, table, temporary, tuned


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those between two languages, go.

    A table without any known language keeps nothing. Repeated rows stay as often as they are.
    """
    tuned(spark)
    names = ("__lang_pred", "__score", "__ambiguous")
    found = langid.identify(docs, langid.fit(docs), docs.columns, names=names)
    return found.filter(f"{names[0]} <> '{langid.UNDETERMINED}' and not {names[2]}").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays.

    Texts without a word have no copies and stay. Of rows that repeat a doc_id one stays; rows
    without a doc_id all stay.
    """
    tuned(spark)
    return jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark passage go.

    Null and empty texts repeat nothing; rows without a doc_id stay; an empty benchmark takes
    nothing; repeated rows go or stay together.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are masked; n_chars is counted anew.

    All rows stay: null texts as null, empty ones as empty, repeated ones as often as they are.
    """
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text decoded from the ids, of every row.

    Null and empty texts have no ids.
    """
    tuned(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("ids", "decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: Language, banding, seeds and co-occurrence are beyond one SQL statement; tests/llm holds them
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written and read back.

    What a stage wrote on its way goes when its rows are written, and so do the rows of the stage
    before.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"stage-{name}")
        with temporary(spark):
            docs = settled_at(stage(spark, docs, sf_dir), path)
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
