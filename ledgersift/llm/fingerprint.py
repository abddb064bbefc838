"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch keeps the k smallest distinct hashes. Sketches of parts merge into the sketch of the whole, and give
estimates of resemblance, containment and the number of distinct shingles. A text of one to four words is one
shingle; a null, empty or wordless text has the empty sketch, and two empty sketches have resemblance 1.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersift.llm.common import SALTS, lower_bound, shingles, store

K, WORDS = 128, 5


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    return smallest(shingles(text, words), k)


def smallest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, in order."""
    take = 4 * k
    while True:
        part = np.unique(np.partition(hashes, take)[:take] if take < len(hashes) else hashes)
        if len(part) >= k or take >= len(hashes):
            return part[:k]
        take *= 4


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    both = merge([a, b], k)
    return float((np.isin(both, a) & np.isin(both, b)).mean()) if len(both) else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles (exact below k)."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j / (1 + j) * (distinct(a, k) + distinct(b, k)) / distinct(a, k))


def pack(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def unpack(s: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s or ""), "<u8")


def fingerprint(text: Column, k: int = K) -> Column:
    """The sketch as base64 text ('' for no shingles)."""

    @F.pandas_udf("string")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([pack(sketch(x, k)) for x in batch], dtype=object)

    return of(F.coalesce(text, F.lit("")))


def compare(a: Column, b: Column, k: int = K) -> Column:
    """Struct of resemblance, containment of a in b, and distinct shingles of a and b."""

    @F.pandas_udf("resemblance double, containment double, distinct_a double, distinct_b double")
    def of(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for s, t in zip(x, y, strict=True):
            u, v = unpack(s), unpack(t)
            rows.append((resemblance(u, v, k), containment(u, v, k), distinct(u, k), distinct(v, k)))
        return pd.DataFrame(rows, columns=["resemblance", "containment", "distinct_a", "distinct_b"])

    return of(a, b)


def merged(sketches: DataFrame, key: str, sketch_col: str, k: int = K, salts: int = 16) -> DataFrame:
    """One sketch per key; a key's rows are merged in ``salts`` parts first, each from a stream of batches."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for batch in batches:
            for g, s in zip(batch["g"], batch["s"], strict=True):
                found[g] = merge([found[g], unpack(s)], k) if g in found else unpack(s)[:k]
        if found:
            yield pd.DataFrame({"g": list(found), "s": [pack(x) for x in found.values()]})

    rows = sketches.select(F.col(key).alias("g"), F.coalesce(F.col(sketch_col), F.lit("")).alias("s"))
    schema = T.StructType([T.StructField("g", rows.schema["g"].dataType), T.StructField("s", T.StringType())])
    salted = rows.repartition("g", F.pmod(F.xxhash64("s"), F.lit(salts))).mapInPandas(part, schema)
    return salted.repartition("g").mapInPandas(part, schema).select(F.col("g").alias(key), F.col("s").alias(sketch_col))


#: Documents are dealt over ranges of about so many by id; a range is sorted and streamed, so their greatest number bounds no work.
RANGE_ROWS, MOST_RANGES = 10_000, 16_384
#: Rows that a task holds before it hands them on.
OUT_ROWS = 500


def with_next(docs: DataFrame, of, schema: str, ranges: int | None = None) -> DataFrame:
    """Apply ``of(id, text, next_text)`` to each document and the next one by descending id (after the last: the first).

    Texts move once: ids are cut into ranges at approximate quantiles, each range is sorted in a task, and a range's
    first document is also sent to the end of the range before it. Equal ids are ordered by a hash of their texts, then by text, and
    null ids, which come last, likewise; an id with many rows is cut into SALTS ranges of that hash. Equal rows follow each other.
    An empty table has no rows.
    """
    spark = docs.sparkSession
    rows = docs.count()
    n = ranges or min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS))
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    cuts = sorted(set(base.select(F.col("_id").cast("double").alias("_id")).na.drop().approxQuantile("_id", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    # range 0 has the largest ids; null ids come after all
    known = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    above = F.lit(len(cuts)) - lower_bound(known, len(cuts), lambda c: c <= F.col("_id")) if cuts else F.lit(0)
    often = base.groupBy("_id").count().filter(F.col("count") * n > max(4 * rows, n)).select("_id", F.lit(True).alias("_often"))  # fewer than n / 4 ids
    part = F.when(F.col("_often"), F.floor((F.col("_th") / F.lit(2.0**63) + 1) * (SALTS / 2)).cast("int")).otherwise(0)
    place = F.when(F.col("_id").isNull(), len(cuts) + 1).otherwise(above).cast("long") * (SALTS + 1) + part
    dealt = base.join(F.broadcast(often.withColumnRenamed("_id", "_many")), F.col("_id").eqNullSafe(F.col("_many")), "left").select("_id", "_th", "_text", place.alias("_range"), F.lit(0).alias("_tail"))
    top = store(dealt.groupBy("_range").agg(F.max(F.struct("_id", F.bitwise_not("_th").alias("_last"))).alias("m")).select(F.col("_range").alias("_of"), F.col("m._id").alias("_top"), F.bitwise_not("m._last").alias("_first")))
    order = [r[0] for r in top.select("_of").orderBy("_of").collect()]  # numbers of ranges, at most MOST_RANGES x SALTS
    if not order:
        return spark.createDataFrame([], schema)
    before = spark.createDataFrame([(b, order[i - 1]) for i, b in enumerate(order)], "_of long, _before long")
    ends = F.broadcast(top.join(F.broadcast(before), "_of"))
    heads = dealt.join(ends, (F.col("_range") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_top")) & (F.col("_th") == F.col("_first")))
    heads = heads.groupBy("_before").agg(F.min("_text").alias("_text")).select(F.lit(None).cast("long").alias("_id"), F.xxhash64("_text").alias("_th"), "_text", F.col("_before").alias("_range"), F.lit(1).alias("_tail"))
    moved = dealt.unionByName(heads).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_range").sortWithinPartitions("_range", "_tail", F.desc_nulls_last("_id"), "_th", "_text")
    # ids as text, for pandas would make floats of ids beside a null
    moved = moved.select(F.col("_id").cast("string").alias("_id"), "_text", "_tail")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, out = None, []
        frame = lambda: pd.DataFrame(out, columns=names, dtype=object)
        for batch in batches:
            for i, text, tail in zip(batch["_id"], batch["_text"], batch["_tail"], strict=True):
                if held is not None:
                    out.append(of(held[0], held[1], text))
                held = None if tail else (None if i is None else int(i), text)
                if len(out) >= OUT_ROWS:
                    yield frame()
                    out = []
        yield frame()

    names = T.StructType.fromDDL(schema).names
    return moved.mapInPandas(walk, schema)
