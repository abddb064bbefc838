"""From raw documents to token counts: toxic documents go, repeated lines go, near copies go, contaminated documents go, and the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.llm import bpe, decontam, linededup, neardup, toxicity
from ledgersift.llm.common import drop_stored, store, stored
from ledgersift.llm.queries import table, vocabulary_path

TOXIC_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC_SCORE; null and empty texts score 0 and stay, equal texts score alike."""
    field = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(F.col("text"), field) < TOXIC_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line that stands earlier taken out, long ones also if it differs by one edit.

    n_chars is that of the new text (null for a null one). The first of equal lines is that of the smallest doc_id, null ids last.
    """
    return linededup.dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id (null ids last); null and empty texts are one class."""
    return neardup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; null and empty texts have no tokens."""
    return bpe.report(docs, bpe.Tokenizer(spark, vocabulary_path()))


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near dedup", drop_near_copies), ("decontamination", drop_contaminated), ("bpe", encode)]

#: A trained field, sampling and tokens can't be stated in SQL; tests/llm tests the stages against brute force and planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents.

    What each stage keeps is written to the shared checkpoint folder before the next reads it; then the tables before it are deleted, so
    no more than two states of the documents lie there. The last state stays, as the result reads it.
    """
    docs, began = table(spark, sf_dir, "documents"), stored()
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
        drop_stored(spark, began)
    return STAGES[-1][1](spark, docs, sf_dir)
