"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

1. language ID: documents that it rejects go;
2. SimHash near-dedup: the smallest doc_id of each group stays;
3. secret scans: found secrets are replaced by [REDACTED];
4. mixing: documents are repeated or left out to meet their source's target, in training order;
5. SentencePiece: ids of each document, with the round trip.

Every stage defines its result for nulls, empty and very long texts and repeated rows as its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibron.llm import langid, mixing, pieces, secrets, simhash
from calibron.llm.common import map_texts, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_rejected(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = pieces.default_model()

    def run(texts: list[str | None]) -> list:
        model = pieces.model_of(path)
        ids = model.encode(texts)
        return [ids, [len(i) for i in ids], [model.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]]

    return map_texts(docs, run, "ids array<int>, n_tokens long, round_trip boolean", keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", tokens_stage),
]

#: The language and token stages have no SQL form. The tests run every stage; near duplicates, secrets and
#: tokens are held against brute force or the library in the tests of their operators, the language stage by accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; every stage's result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents").select(*(F.col(c) for c in COLUMNS))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
