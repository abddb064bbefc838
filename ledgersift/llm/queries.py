"""Queries over the whole given tables for the operators of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.llm import bpe, conversations, decontam, fingerprint, linededup, neardup, pagetext, quality, secrets, sharding, substring, toxicity, vectorcodes
from ledgersift.llm.common import fold_of
from ledgersift.llm.structure_sql import OP11_SQL, OP13_SQL

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _scored(docs: DataFrame, score, folds: int, held_out: int, least: float) -> DataFrame:
    got = docs.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), score.alias("score"))
    return got.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(docs, quality.score(F.col("text"), quality.train(docs, table(spark, sf_dir, "labels"))), 3, 1, 0.5)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: estimates of the text's distinct shingles and of the share of them that the edited text holds."""

    def of(doc_id: int | None, text: str, following: str) -> tuple:
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        a, b, c = (fingerprint.sketch(x) for x in (text, edited, following))
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        likeness = fingerprint.resemblance(a, b), fingerprint.resemblance(a, c)
        return (doc_id, n, digest, fingerprint.pack(a), fingerprint.pack(b), *likeness, fingerprint.distinct(a), fingerprint.containment(a, b))

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "distinct_shingles double, contained_in_edited double"
    )
    return fingerprint.with_next(table(spark, sf_dir, "documents"), of, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    got = docs.select("doc_id", held_out, toxicity.tags(F.col("text"), toxicity.train(docs, table(spark, sf_dir, "labels"))).alias("x"))
    return got.select("doc_id", "held_out", "x.score", (F.col("x.score") >= 0.3).cast("int").alias("predicted"), "x.offsets")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.documents(table(spark, sf_dir, "documents"), SHARDS)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), bpe.Tokenizer(spark, vocabulary_path()))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.report(table(spark, sf_dir, "pages"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.report(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (op1_quality, op2_decontamination, op3_substring_dedup, op4_secret_scan, op5_fingerprints, op6_toxicity, op7_near_dedup, op8_sharding, op9_bpe, op10_line_dedup, op11_conversation_repair, op12_page_text, op13_vector_codes, pipeline)
    return {f.__name__: f for f in found}


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS p FROM d),
x AS (SELECT p.doc_id, p.p, md5(array_to_string(d.w[p.p:p.p + 49], ' ')) AS h FROM p JOIN d USING (doc_id)),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
g AS (SELECT DISTINCT x.doc_id, unnest(range(x.p, x.p + 50)) AS i FROM x JOIN f USING (h) WHERE f.first < x.doc_id),
n AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT n.doc_id, count(g.i) AS gone, string_agg(CASE WHEN g.i IS NULL THEN n.word END, ' ' ORDER BY n.i) AS kept
      FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, doc_id * 1000000000 + place AS k FROM l WHERE trim(line) <> ''),
s AS (SELECT line, length(line) AS n, min(k) AS k FROM e GROUP BY line),
f AS (SELECT * FROM s WHERE n >= 20),
c AS (
  SELECT a.line AS x, b.line AS y, a.k AS kx, b.k AS ky FROM f a JOIN f b ON a.n = b.n AND left(a.line, a.n // 2) = left(b.line, a.n // 2) AND a.k < b.k
  UNION SELECT a.line, b.line, a.k, b.k FROM f a JOIN f b ON a.n = b.n AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) AND a.k < b.k
  UNION SELECT a.line, b.line, a.k, b.k FROM f a JOIN f b ON a.n = b.n - 1 AND left(a.line, a.n // 2) = left(b.line, (b.n - 1) // 2)
  UNION SELECT a.line, b.line, a.k, b.k FROM f a JOIN f b ON a.n = b.n - 1 AND right(a.line, a.n - a.n // 2) = right(b.line, b.n - 1 - (b.n - 1) // 2)),
m AS (SELECT DISTINCT CASE WHEN kx < ky THEN y ELSE x END AS line FROM c
  WHERE len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: left(x, i) = left(y, i)))
      + len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: right(x, i) = right(y, i))) >= greatest(length(x), length(y)) - 1),
g AS (SELECT e.doc_id, e.place FROM e JOIN s ON s.line = e.line LEFT JOIN m ON m.line = e.line WHERE m.line IS NOT NULL OR e.k > s.k),
k AS (SELECT l.doc_id, count(*) AS n, count(g.place) AS gone, string_agg(CASE WHEN g.place IS NULL THEN l.line END, chr(10) ORDER BY l.place) AS kept
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.place = l.place GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op10_line_dedup": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op13_vector_codes": OP13_SQL}
