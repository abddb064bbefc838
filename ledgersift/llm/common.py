"""Shared helpers: shared scratch folder, word splitting and vectorised rolling hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than the six ASCII blanks; ``bytes.split()`` splits on just those.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_tables: dict[str, list[np.ndarray]] = {"power": [np.ones(1, np.uint64)] * 2, "inverse": [np.ones(1, np.uint64)] * 2}


#: A key with over one HOT_PARTS-th of all rows is hot; there are fewer than HOT_PARTS such keys, whatever the input.
HOT_PARTS = 2048
#: Tasks over which a hot key is spread.
SALTS = 64


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only on a local master, where driver and tasks share a machine."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
        known = spark.sparkContext.getCheckpointDir()
    return known


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, partitioned as it is, and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: as cut(), but columns and filters reach the scan."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[str] = []


def stored() -> int:
    """How many tables store() has written so far."""
    return len(_written)


def drop_stored(spark: SparkSession, since: int) -> None:
    """Delete the tables that store() wrote after the first ``since``, but for the last one."""
    for path in _written[since:-1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _written[since:-1]


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """Inner join of rows with groups (written, one row a key, ``size`` rows each), hot keys apart.

    Hot keys are broadcast, fewer than HOT_PARTS rows; of all others none has more than one HOT_PARTS-th of the rows.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot, rest = groups.filter(F.col(size) * HOT_PARTS > total).drop(size), groups.filter(F.col(size) * HOT_PARTS <= total).drop(size)
    of_rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(of_rest)


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The keys that hold over one HOT_PARTS-th of ``total`` rows, and over SALTS rows: fewer than HOT_PARTS."""
    return store(rows.groupBy(key).count().filter(F.col("count") * HOT_PARTS > max(total, SALTS * HOT_PARTS)).select(key, F.lit(True).alias("_hot")))


def join_salted(rows: DataFrame, key: list[str], spread: str, table: DataFrame, hot: DataFrame) -> DataFrame:
    """Inner join of rows with table (one row a key), the rows of the keys in ``hot`` (key and _hot, fewer than HOT_PARTS) dealt over SALTS tasks by ``spread``.

    Rows of a hot key in table are repeated SALTS times.
    """
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    return dealt.join(table.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(salts)).drop("_hot"), [*key, "_salt"]).drop("_salt")


def lower_bound(values: Column, n: int, before) -> Column:
    """Number of the first of ``n`` sorted values for which ``before(value)`` is false; n if there is none (binary search)."""

    def step(s: Column, _) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up, down = F.struct((middle + 1).alias("lo"), s["hi"].alias("hi")), F.struct(s["lo"].alias("lo"), middle.alias("hi"))
        return F.when(s["lo"] < s["hi"], F.when(before(F.get(values, middle)), up).otherwise(down)).otherwise(s)

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, step, lambda s: s["lo"])


def pack(docs: DataFrame) -> DataFrame:
    """All columns in one, _row, so that no name of theirs can clash with an operator's own."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def unpack(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs out of _row, some of them changed."""
    return rows.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def labelled_sample(labels: DataFrame, id_col: str, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out fold, chosen by a hash of the id; repeated ids keep the larger label."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label"))
    return one.filter(fold_of(F.col("_id"), folds) != held_out).orderBy(F.xxhash64("_id"), "_id").limit(rows)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Powers of both bases and of their inverses, modulo 2^64."""
    if len(_tables["power"][0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        for name, bases in (("power", _BASES), ("inverse", [pow(b, -1, 1 << 64) for b in _BASES])):
            rows = [np.full(size, b, np.uint64) for b in bases]
            for row in rows:
                row[0] = 1
            _tables[name] = [np.multiply.accumulate(row) for row in rows]
    return _tables["power"], _tables["inverse"]


class WordHasher:
    """Prefix sums over the words of a text, so the hash of any run of words costs four look-ups.

    Each word enters by a hash of its bytes, so no letters of one word make up for those of another. A run is hashed by two bases, and
    the two values are mixed; both depend on the word sequence alone.
    """

    def __init__(self, words: list[bytes]):
        n = len(words)
        self._words = words
        codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        powers, self._inverses = _powers(n + 1)
        self._sums = []
        for power in powers:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(codes * power[:n], out=sums[1:])
            self._sums.append(sums)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word starts and ends in the words joined by one space."""
        lens = np.fromiter(map(len, self._words), np.int64, len(self._words))
        ends = np.cumsum(lens + 1) - 1
        return ends - lens, ends

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the word runs first..last, both inclusive."""
        one, two = ((s[last + 1] - s[first]) * inverse[first] for s, inverse in zip(self._sums, self._inverses, strict=True))
        return mix(mix(one + (last - first).astype(np.uint64)) ^ two)

    def windows(self, width: int) -> np.ndarray:
        n = len(self._words) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        one, two = ((s[width:] - s[:n]) * inverse[:n] for s, inverse in zip(self._sums, self._inverses, strict=True))
        return mix(mix(one + np.uint64(width - 1)) ^ two)


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of the ``width``-word shingles in order; a shorter text is one shingle, a wordless one has none."""
    words = split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    return WordHasher(words).windows(min(width, len(words)))
