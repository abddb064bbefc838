"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text's shingles are runs of five words; a shingle's weight is (1 + ln tf) * idf, idf being ln((n + PRIOR) / df) over its largest
value, and at least FLOOR. n and df count texts that are no copies of each other: a text that shares a bucket of plain min-hashes with
another is left to the one with the smaller hash, and a text that stands in several rows counts once. Counted by rows, a large group of
near copies would make its own shingles frequent, and what its copies differ in would outweigh what they share. Document frequencies
come from all documents, in a count sketch of fixed size, less what other shingles put into a cell on average; those within the
sketch's error (three deviations of a cell) count as the error.
Equal texts are one class from the start. Null texts are empty texts; texts without words are in no class but that of
equal texts. A class is a connected component of the links at or above the threshold; its id is its smallest doc_id. Empty tables
have no rows, and repeated rows are in one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.common import HOT_PARTS, cut, hot_keys, join_groups, join_salted, mix, pack, shingles, store, unpack

SIMILARITY, WORDS = 0.8, 5
#: 16 bands of 4 samples find a pair of similarity 0.8 with probability 0.9998.
BANDS, ROWS = 16, 4
SKETCH_BITS, SLICES = 20, 64
#: Documents without the shingle that are added to the real ones, so that a small table has no common shingles; the least idf.
PRIOR, FLOOR = 100, 0.05
#: Bands of plain min-hashes that tell copies for the document frequencies; parts of one text that stands in several rows.
COPY_BANDS, SHARE = 8, 1 << 16
#: Tasks whose sketches are added up together, before these sums are.
MERGED = 256
#: Candidate texts up to this number are looked up by a broadcast set of 8-byte hashes, more by a shuffle.
BROADCAST_IDS = 200_000
#: Room for rounding in the bounds on weights.
SLACK = 1e-5
#: Cells of a text's sketch, a power of two near its number of shingles.
LEAST_CELLS, MOST_CELLS = 64, 1024
#: Texts in so many pairs or more have their sketches sent by blocks of about so many texts, not once a pair.
DENSE, BLOCK = 16, 512
#: Texts whose weights a task keeps while it compares pairs.
KEPT_TEXTS = 64

_DRAWS = 1 << 15
_rng = np.random.default_rng(91)
_scale = _rng.gamma(2.0, 1.0, _DRAWS).astype(np.float32)
_offset = _rng.random(_DRAWS).astype(np.float32)
_log_c = np.log(_rng.gamma(2.0, 1.0, _DRAWS)).astype(np.float32)
_lines = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_POINTS = (np.arange(COPY_BANDS * ROWS, dtype=np.uint64) << np.uint64(59)) + np.uint64(0x2545F4914F6CDD1D >> 5)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def copy_keys(h: np.ndarray) -> np.ndarray:
    """Keys of bands of plain min-hashes: the first shingle hashes from evenly spaced points of the ring on."""
    rows = h[np.searchsorted(h, _POINTS) % len(h)].reshape(ROWS, COPY_BANDS)
    out = _BAND[:COPY_BANDS].copy()
    for row in rows:
        out = mix(out ^ row)
    return out


def _shares(base: DataFrame) -> DataFrame:
    """_text, _share of the rows of _r, _text: in parts of SHARE, how far a row counts for the document frequencies."""

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            sets = [np.unique(shingles(text, WORDS)) for text in batch]
            yield pd.Series([copy_keys(h).view(np.int64) if len(h) else np.empty(0, np.int64) for h in sets], dtype=object)

    texts = store(base.select("_r", keys("_text").alias("_k")).groupBy("_r").agg(F.max("_k").alias("_k"), F.count("*").alias("_n")))
    bands = texts.select("_r", F.explode("_k").alias("_key"))
    several = bands.groupBy("_key").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"), F.count("*").alias("_n"))
    several = store(several.filter(F.col("_lo") != F.col("_hi")).select("_key", "_lo", "_n"))
    copies = join_groups(bands, several, ["_key"], "_n").filter(F.col("_r") != F.col("_lo")).select("_r").distinct()
    part = F.when(F.col("_copy"), 0).otherwise(F.round(F.lit(SHARE) / F.col("_n"))).cast("long")
    shares = cut(texts.select("_r", "_n").join(copies.withColumn("_copy", F.lit(True)), "_r", "left").select("_r", "_n", part.alias("_share")))
    others = shares.filter(F.col("_share") != SHARE).select("_r", "_share")
    if others.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return base.join(F.broadcast(others), "_r", "left").select("_text", F.coalesce("_share", F.lit(SHARE)).alias("_share"))
    total = shares.agg(F.sum("_n")).first()[0]
    hot = shares.filter(F.col("_n") * HOT_PARTS > total).select("_r", F.lit(True).alias("_hot"))  # fewer than HOT_PARTS texts
    rows = base.withColumn("_row", F.monotonically_increasing_id())
    return join_salted(rows, ["_r"], "_row", shares.select("_r", "_share"), hot).select("_text", "_share")


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts that are no copies of each other, and the counts of them by shingle in the cells of the sketch."""
    size = (1 << SKETCH_BITS) // SLICES

    def packed(s: np.ndarray) -> tuple[int, bytes]:
        kind = np.min_scalar_type(int(s.max()))
        return kind.itemsize, s.astype(kind).tobytes()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for batch in batches:
            for text, share in zip(batch["_text"], batch["_share"], strict=True):
                n += share
                if share:
                    np.add.at(total, _cells(np.unique(shingles(text, WORDS))), share)
        if n:
            rows = [(s, n if s == 0 else 0, *packed(x)) for s, x in enumerate(total.reshape(SLICES, size))]
            yield pd.DataFrame(rows, columns=["s", "n", "w", "b"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            for s, g, n, w, b in zip(batch["s"], batch["g"], batch["n"], batch["w"], batch["b"], strict=True):
                got = sums.setdefault((s, g), [0, np.zeros(size, np.int64)])
                got[0] += n
                got[1] += np.frombuffer(b, f"<u{w}").astype(np.int64)
        if sums:
            yield pd.DataFrame([(s, n, *packed(x)) for (s, _), (n, x) in sums.items()], columns=["s", "n", "w", "b"])

    schema = "s int, n long, w int, b binary"
    text = F.coalesce("text", F.lit("")).alias("_text")
    rows = _shares(docs.select(F.xxhash64(text).alias("_r"), text)).mapInPandas(count, schema)
    rows = rows.withColumn("g", (F.spark_partition_id() / MERGED).cast("int")).repartition("s", "g").mapInPandas(add, schema)
    rows = rows.withColumn("g", F.lit(0)).repartition("s").mapInPandas(add, schema).collect()  # the sketch: at most 8 MB
    total = np.zeros((SLICES, size), np.int64)
    for r in rows:
        total[r["s"]] += np.frombuffer(r["b"], f"<u{r['w']}").astype(np.int64)
    return round(sum(r["n"] for r in rows) / SHARE), total.ravel() / SHARE


def idf(n: int, counts: np.ndarray) -> np.ndarray:
    """For each cell of the sketch the weight that it gives a shingle, and its document frequency."""
    others = counts.sum() / len(counts)
    df = np.clip(counts - others, max(1.0, 3 * np.sqrt(others)), max(n, 1))
    least = df.min()
    return np.stack([np.maximum(np.log((n + PRIOR) / df) / np.log((n + PRIOR) / least), FLOOR), df]).astype(np.float32)


def weighted(text: str | None, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in order of hash, their weights, and their document frequencies."""
    h, tf = np.unique(shingles(text, WORDS), return_counts=True)
    cells = _cells(h)
    return h, (1 + np.log(tf)).astype(np.float32) * table[0, cells], table[1, cells]


def similarity(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Weighted Jaccard similarity; 0 without shingles."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    most = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - least
    return least / most if most else 0.0


def samples(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash of (shingle, level) for each consistent weighted sample; a shingle's draws for a sample come from tables by hash."""
    best, key, level = np.full(len(_lines), np.inf, np.float32), np.zeros(len(_lines), np.uint64), np.zeros(len(_lines), np.float32)
    log_w, rows = np.log(w), np.arange(len(_lines))
    for start in range(0, len(h), 2048):
        x, lw = h[start : start + 2048], log_w[start : start + 2048]
        at = _lines[:, None] * x  # a row a sample, so that the least of each lies in one piece
        at >>= np.uint64(49)
        at = at.view(np.int64)
        r, beta = _scale.take(at, mode="clip"), _offset.take(at, mode="clip")
        t = np.floor(lw / r + beta)
        a = _log_c.take(at, mode="clip") - r * (t - beta + 1)
        k = a.argmin(axis=1)
        better = a[rows, k] < best
        best = np.where(better, a[rows, k], best)
        key = np.where(better, x[k], key)
        level = np.where(better, t[rows, k], level)
    return mix(key ^ level.astype(np.int64).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def band_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    rows = samples(h, w).reshape(BANDS, ROWS)
    out = _BAND.copy()
    for i in range(ROWS):
        out = mix(out ^ rows[:, i])
    return out


def _bands(docs: DataFrame, table) -> DataFrame:
    """_r, _key for each text with shingles, written."""

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                h, w, _ = weighted(text, table.value)
                out.append(band_keys(h, w).view(np.int64) if len(h) else np.empty(0, np.int64))
            yield pd.Series(out, dtype=object)

    return store(docs.select("_r", keys("_text").alias("_k")).groupBy("_r").agg(F.max("_k").alias("_k"))).select("_r", F.explode("_k").alias("_key"))


def _verify(pairs: DataFrame, docs: DataFrame, table, least: float) -> DataFrame:
    """The pairs (_a, _b) of text hashes at or above the similarity."""
    ids = cut(pairs.select(F.explode(F.array("_a", "_b")).alias("_r")).distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select("_r", "_text").join(F.broadcast(ids) if few else ids, "_r", "left_semi").dropDuplicates(["_r"])

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of = lru_cache(KEPT_TEXTS)(lambda text: weighted(text, table.value))
        for x, y in batches:
            yield pd.Series([similarity(of(a), of(b)) >= least for a, b in zip(x, y, strict=True)], dtype=bool)

    # the text that copies were made from is in a pair with each of them
    total = pairs.count()
    both = join_salted(pairs, ["_a"], "_b", texts.withColumnsRenamed({"_r": "_a", "_text": "_ta"}), hot_keys(pairs, "_a", total))
    both = join_salted(both, ["_b"], "_a", texts.withColumnsRenamed({"_r": "_b", "_text": "_tb"}), hot_keys(pairs, "_b", total))
    return both.filter(near("_ta", "_tb")).select("_a", "_b")


def components(links: DataFrame) -> DataFrame:
    """_r, _label (the smallest hash of the component) of all linked texts; labels spread along links and are halved by jumps.

    A text that many are linked to, and a label that many have, are hot keys of the two joins, and dealt over tasks.
    """
    both = cut(links.unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct())
    hot = hot_keys(both, "_b", both.count())
    labels = cut(both.groupBy(F.col("_a").alias("_r")).agg(F.least(F.min("_b"), F.min("_a")).alias("_label")))
    n = labels.count()
    while True:
        seen = join_salted(both, ["_b"], "_a", labels.withColumnsRenamed({"_r": "_b"}), hot).groupBy(F.col("_a").alias("_r")).agg(F.min("_label").alias("_near"))
        lower = store(labels.join(seen, "_r").select("_r", F.least("_label", "_near").alias("_next"), F.col("_label").alias("_was")))
        jumps = lower.select(F.col("_r").alias("_next"), F.col("_next").alias("_jump"))  # every label is a linked text
        done = cut(join_salted(lower, ["_next"], "_r", jumps, hot_keys(lower, "_next", n)).select("_r", F.least("_next", "_jump").alias("_label"), "_was"))
        labels = done.select("_r", "_label")
        if done.filter(F.col("_label") != F.col("_was")).isEmpty():
            return labels


def sketch(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weights of a text's shingles added up in cells by the first bits of their hashes, and their sum."""
    cells = min(max(1 << (len(h) - 1).bit_length(), LEAST_CELLS), MOST_CELLS)
    at = (h >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)
    return np.append(np.bincount(at, w, cells), w.sum(dtype=np.float64)).astype(np.float32)


def at_most(a: np.ndarray, b: np.ndarray) -> float:
    """No less than the similarity of two texts, from their sketches: they share no more of a cell than the lighter one has there."""
    x, y = (a[:-1], b[:-1]) if len(a) <= len(b) else (b[:-1], a[:-1])
    shared = float(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum(dtype=np.float64))
    return shared / max(float(a[-1]) + float(b[-1]) - shared, 1e-9) + SLACK


def _dealt(pairs: DataFrame, sketches: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The pairs with their cell, a block of each side, and the sketches of each cell's texts: a text goes to 2 * blocks cells at most, however many pairs it is in."""
    block = lambda c: F.pmod(F.xxhash64(F.lit("block"), c), F.lit(blocks)).cast("int")
    cells = pairs.select("_a", "_b", block("_a").alias("_ca"), block("_b").alias("_cb"))
    texts = cells.select("_ca", "_cb", F.col("_a").alias("_r")).unionByName(cells.select("_ca", "_cb", F.col("_b").alias("_r")))
    return cells, store(texts.distinct().join(sketches, "_r"))


def _within_reach(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (_a, _b) that can be at or above the similarity by their sketches (_r, _sketch), which are far shorter than the texts.

    In a group of texts just under the similarity pairs grow with the square of the texts. Pairs of two texts with DENSE pairs or more
    each are compared by cells of two blocks, so sketches are sent by texts and blocks there; all others are fewer than DENSE a text.
    """

    @F.pandas_udf("boolean")
    def can(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([at_most(np.frombuffer(a, np.float32), np.frombuffer(b, np.float32)) >= least for a, b in zip(x, y, strict=True)], dtype=bool)

    def of_cell(here: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        sketch_of = {r: np.frombuffer(x, np.float32) for r, x in zip(held["_r"], held["_sketch"], strict=True)}
        return here.loc[[at_most(sketch_of[a], sketch_of[b]) >= least for a, b in zip(here["_a"], here["_b"], strict=True)], ["_a", "_b"]]

    ends = pairs.groupBy(F.col("_a").alias("_r")).count().unionByName(pairs.groupBy(F.col("_b").alias("_r")).count())
    many = store(ends.groupBy("_r").agg(F.sum("count").alias("_n")).filter(F.col("_n") >= DENSE).select("_r", F.lit(True).alias("_many")))
    n = many.count()
    many = F.broadcast(many) if n <= BROADCAST_IDS else many
    marked = pairs.join(many.withColumnsRenamed({"_r": "_a", "_many": "_ma"}), "_a", "left").join(many.withColumnsRenamed({"_r": "_b", "_many": "_mb"}), "_b", "left")
    marked = cut(marked.select("_a", "_b", (F.col("_ma").isNotNull() & F.col("_mb").isNotNull()).alias("_dense")))
    few = marked.filter("NOT _dense").select("_a", "_b")
    total = few.count()
    both = join_salted(few, ["_a"], "_b", sketches.withColumnsRenamed({"_r": "_a", "_sketch": "_sa"}), hot_keys(few, "_a", total))
    both = join_salted(both, ["_b"], "_a", sketches.withColumnsRenamed({"_r": "_b", "_sketch": "_sb"}), hot_keys(few, "_b", total))
    found = both.filter(can("_sa", "_sb")).select("_a", "_b")
    if not n:
        return found
    cells, held = _dealt(marked.filter("_dense"), sketches, -(-n // BLOCK))
    key = ["_ca", "_cb"]
    return found.unionByName(cells.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(of_cell, "_a long, _b long"))


def _prefixes(docs: DataFrame, ids: DataFrame, table, least: float) -> DataFrame:
    """_r, _label, _key, _w, _rest, _lead, _sketch: the rarest shingles of each text, as far as a near copy can have its first shared shingle there.

    The first row of a text has its sketch.
    Shingles are in one order for all texts, rare ones first; _w is the weight of the text, _rest that of this shingle and all after it.
    The first shared shingle of a pair at or above the similarity has a _rest of at least least / (1 + least) of both weights together
    in both texts: thus least of the own weight, and in the lighter text even 2 * least / (1 + least) of it (_lead).
    """
    lead = 2 * least / (1 + least)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r, label, text in zip(batch["_r"], batch["_label"], batch["_text"], strict=True):
                h, w, df = weighted(text, table.value)
                order = np.lexsort((h, df))
                rest = np.cumsum(w[order][::-1], dtype=np.float64)[::-1]
                rest = rest[rest >= (least - SLACK) * rest[0]]
                yield pd.DataFrame({"_r": r, "_label": label, "_key": h[order[: len(rest)]].view(np.int64), "_w": rest[0], "_rest": rest, "_lead": rest >= (lead - SLACK) * rest[0], "_sketch": [sketch(h, w).tobytes(), *[None] * (len(rest) - 1)]})

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select("_r", "_text").join(F.broadcast(ids) if few else ids, "_r").dropDuplicates(["_r"])
    return texts.select("_r", "_label", "_text").mapInPandas(rows, "_r long, _label long, _key long, _w double, _rest double, _lead boolean, _sketch binary")


def _open_pairs(docs: DataFrame, ids: DataFrame, table, least: float, known: DataFrame) -> DataFrame:
    """The pairs (_a, _b) of texts with different labels, but for those known, that can be at or above the similarity, by their rarest shingles and sketches.

    The light rows of a shingle that many texts hold are dealt over tasks, each with all its heavy rows.
    """
    both = cut(_prefixes(docs, ids, table, least))
    light = both.filter("_lead").select("_key", F.col("_r").alias("_x"), F.col("_label").alias("_lx"), F.col("_w").alias("_wx"), F.col("_rest").alias("_sx"))
    heavy = both.select("_key", F.col("_r").alias("_y"), F.col("_label").alias("_ly"), F.col("_w").alias("_wy"), F.col("_rest").alias("_sy"))
    ordered = (F.col("_wx") < F.col("_wy")) | ((F.col("_wx") == F.col("_wy")) & (F.col("_x") < F.col("_y")))
    enough = F.least("_sx", "_sy") >= (least / (1 + least) - SLACK) * (F.col("_wx") + F.col("_wy"))
    fits = (F.col("_lx") != F.col("_ly")) & ordered & (F.col("_wx") >= (least - SLACK) * F.col("_wy")) & enough
    met = join_salted(light, ["_key"], "_x", heavy, hot_keys(both, "_key", both.count()))
    pairs = cut(met.filter(fits).select(F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b")).distinct().join(known, ["_a", "_b"], "left_anti"))
    return _within_reach(pairs, both.filter("_sketch IS NOT NULL").select("_r", "_sketch"), least)


def links(docs: DataFrame, table, least: float = SIMILARITY) -> DataFrame | None:
    """Labels of the texts that have near copies among different texts; None without any.

    First each bucket compares one member with all others: the one that shares most buckets with other texts, as the source of many
    copies does. Texts that are still in different components, though they share a bucket, are then compared by their rarest
    shingles and by sketches, which leave out only pairs that cannot reach the similarity, so no link is lost.
    """
    bands = _bands(docs, table)
    several = bands.groupBy("_key").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"), F.count("*").alias("_n")).filter(F.col("_lo") != F.col("_hi"))
    several = store(several.select("_key", "_n", F.col("_n").alias("_rows")))
    members = store(join_groups(bands, several, ["_key"], "_rows"))
    shared = members.groupBy("_r").agg(F.sum("_n").alias("_shared"))
    centers = store(members.join(shared, "_r").groupBy("_key").agg(F.max_by("_r", F.struct("_shared", "_r")).alias("_center"), F.max("_n").alias("_rows")))
    members = members.select("_key", "_r")
    pairs = join_groups(members, centers, ["_key"], "_rows").filter(F.col("_r") != F.col("_center"))
    pairs = cut(pairs.select(F.least("_r", "_center").alias("_a"), F.greatest("_r", "_center").alias("_b")).distinct())
    if pairs.isEmpty():
        return None
    found = cut(_verify(pairs, docs, table, least))
    labels = None if found.isEmpty() else components(found)
    named = members.withColumn("_label", F.col("_r")) if labels is None else members.join(labels, "_r", "left").withColumn("_label", F.coalesce("_label", "_r"))
    named = store(named)
    mixed = named.groupBy("_key").agg(F.min("_label").alias("_lo"), F.max("_label").alias("_hi"), F.count("*").alias("_n")).filter(F.col("_lo") != F.col("_hi"))
    ids = cut(join_groups(named, store(mixed.select("_key", "_n")), ["_key"], "_n").select("_r", "_label").distinct())
    if ids.isEmpty():
        return labels
    more = cut(_open_pairs(docs, ids, table, least, pairs))
    if more.isEmpty():
        return labels
    near = cut(_verify(more, docs, table, least))
    if near.isEmpty():
        return labels
    return components(found.unionByName(near))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, _r, _q (hashes of the text), _class, _own (together the key of the class) and class_id of every row.

    The key comes from the texts alone; class_id, the smallest doc_id, is null where all ids of the class are, and the same for
    different classes that hold the same smallest id.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_r", F.xxhash64("_text")).withColumn("_q", F.xxhash64(F.lit("second"), "_text"))
    table = spark.sparkContext.broadcast(idf(*frequencies(docs)))
    labels = links(base.select("_r", "_text"), table, least)
    ids = base.select("doc_id", "_r", "_q")
    texts = ids.groupBy("_r", "_q").agg(F.min("doc_id").alias("_least"))
    if labels is None:
        return ids.join(texts.select("_r", "_q", F.col("_r").alias("_class"), F.col("_q").alias("_own"), F.col("_least").alias("class_id")), ["_r", "_q"])
    # equal hashes of different texts stay apart; no text without links has a label as its _r
    marked = texts.join(labels, "_r", "left").withColumn("_class", F.coalesce("_label", "_r")).withColumn("_own", F.when(F.col("_label").isNull(), F.col("_q")).otherwise(0))
    named = marked.join(marked.groupBy("_class", "_own").agg(F.min("_least").alias("class_id")), ["_class", "_own"])
    return ids.join(named.select("_r", "_q", "_class", "_own", "class_id"), ["_r", "_q"])


def report(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_key of every row; class_key tells classes apart whose ids are null or repeated."""
    return classes(docs, least).select("doc_id", "class_id", F.concat_ws("-", F.hex("_class"), F.hex("_own")).alias("class_key"))


def dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with the smallest doc_id (null ids last), then text hash, with all columns."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_r").alias("r"), F.col("_q").alias("q"))
    kept = classes(docs, least).groupBy("_class", "_own").agg(F.min(place).alias("k")).select("k.id", "k.r", "k.q")
    text = F.coalesce("_row.text", F.lit(""))
    same = F.col("_row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("r")) & (F.xxhash64(F.lit("second"), text) == F.col("q"))
    return unpack(pack(docs).join(kept, same).dropDuplicates(["id", "r", "q"]), docs)
