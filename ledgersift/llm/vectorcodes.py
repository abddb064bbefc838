"""Vector code compression: each part of a vector becomes the number of the nearest entry of its codebook (product codes), fitted by dual-tree Lloyd rounds.

Every task builds a balanced tree over the parts it holds and one over the entries. Pairs of nodes are walked level by level; integer bounds
of the distance between their boxes rule pairs out. A node left with one entry is assigned whole, by its cached sum and count; what is still
open in the leaves is settled by integer distances. All arithmetic is in integers, so results do not hang on how rows are partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.common import join_groups, store

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts in a leaf of their tree.
LEAF = 32
#: Rows that a task holds at a time.
ROWS = 16384


class Tree:
    """A balanced tree: on each level all nodes halve at the middle of their widest side. Nodes of a level are neighbours in ``order``.

    The last point is repeated to fill the tree; ``real`` tells which places are not such copies. Per level: boxes, sums and counts of nodes.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        n, self.depth = len(points), 0
        while leaf << self.depth < n:
            self.depth += 1
        self.leaf = -(-n // (1 << self.depth))
        total = self.leaf << self.depth
        self.order = np.minimum(np.arange(total), n - 1)
        self.real = np.arange(total) < n
        for level in range(self.depth):
            rows = points[self.order].reshape(1 << level, -1, points.shape[1])
            side = np.argmax(rows.max(1) - rows.min(1), axis=1)
            by = np.argsort(np.take_along_axis(rows, side[:, None, None], 2)[:, :, 0], axis=1, kind="stable")
            by += np.arange(1 << level)[:, None] * rows.shape[1]
            self.order, self.real = self.order[by.ravel()], self.real[by.ravel()]
        self.points = points[self.order].reshape(1 << self.depth, self.leaf, -1)
        there = self.real.reshape(1 << self.depth, self.leaf)
        one = (self.points.min(1), self.points.max(1), (self.points * there[:, :, None]).sum(1), there.sum(1))
        self.levels = [one]
        for _ in range(self.depth):
            lo, hi, total, count = one
            one = (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), total[::2] + total[1::2], count[::2] + count[1::2])
            self.levels.append(one)
        self.levels.reverse()


def _pairs(tree: Tree, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Walk both trees: (level, node, entry) of the nodes assigned whole, and at last (-1, leaf, entry) of the pairs left open, by leaf and entry."""
    other = Tree(entries, 1)
    q, e, at, below = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while True:
        (lo, hi, _, _), (elo, ehi, _, _) = tree.levels[at], other.levels[below]
        gap = np.maximum(np.maximum(elo[e] - hi[q], lo[q] - ehi[e]), 0)
        far = np.maximum(hi[q] - elo[e], ehi[e] - lo[q])
        least, most = (gap * gap).sum(1), (far * far).sum(1)
        # pairs stand by node, so the best upper bound of each node is a minimum over its run
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        best = np.repeat(np.minimum.reduceat(most, start), np.diff(np.r_[start, len(q)]))
        keep = least <= best
        q, e = q[keep], e[keep]
        if below == other.depth:
            alone = np.r_[True, q[1:] != q[:-1]] & np.r_[q[1:] != q[:-1], True]
            if alone.any():
                yield at, q[alone], other.order[e[alone]]
                q, e = q[~alone], e[~alone]
            if not len(q):
                return
            if at == tree.depth:
                index = other.order[e]
                by = np.lexsort((index, q))
                yield -1, q[by], index[by]
                return
        if at < tree.depth:
            q, e, at = (2 * q[:, None] + [0, 1]).ravel(), np.repeat(e, 2), at + 1
        if below < other.depth:
            q, e, below = np.repeat(q, 2), (2 * e[:, None] + [0, 1]).ravel(), below + 1
            if below == other.depth:
                q, e = q[other.real[e]], e[other.real[e]]
        by = np.argsort(q, kind="stable")
        q, e = q[by], e[by]


def _open(tree: Tree, entries: np.ndarray, q: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, code and distance of each of its points) for the pairs left open; equal distances go to the lower entry."""
    gap = tree.points[q] - entries[index][:, None, :]
    key = (gap * gap).sum(2) * ENTRIES + index[:, None]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    best = np.minimum.reduceat(key, start, axis=0)
    return q[start], (best % ENTRIES).astype(np.int64), best // ENTRIES


def sums(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise sums and counts of the points nearest to each entry."""
    tree, total, count = Tree(points, LEAF), np.zeros_like(entries), np.zeros(len(entries), np.int64)
    for level, q, index in _pairs(tree, entries):
        if level >= 0:
            np.add.at(total, index, tree.levels[level][2][q])
            np.add.at(count, index, tree.levels[level][3][q])
        else:
            leaf, code, _ = _open(tree, entries, q, index)
            real = tree.real.reshape(-1, tree.leaf)[leaf]
            np.add.at(total, code[real], tree.points[leaf][real])
            np.add.at(count, code[real], 1)
    return total, count


def codes(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, and the squared distance."""
    tree = Tree(points, LEAF)
    code, error = np.zeros(tree.points.shape[:2], np.int64), np.zeros(tree.points.shape[:2], points.dtype)
    for level, q, index in _pairs(tree, entries):
        if level >= 0:
            span = 1 << (tree.depth - level)
            leaf = (q[:, None] * span + np.arange(span)).ravel()
            code[leaf] = np.repeat(index, span)[:, None]
            gap = tree.points[leaf] - entries[code[leaf]]
            error[leaf] = (gap * gap).sum(2)
        else:
            leaf, c, d = _open(tree, entries, q, index)
            code[leaf], error[leaf] = c, d
    out, far = np.zeros(len(points), np.int64), np.zeros(len(points), points.dtype)
    out[tree.order], far[tree.order] = code.ravel(), error.ravel()
    return out, far


def _exact(points: np.ndarray, width: int) -> np.ndarray:
    """The same numbers; as Python's integers where 64 bits could not hold sums and distances."""
    most = int(max(points.max(initial=0), -int(points.min(initial=0))))
    return points if (2 * most) ** 2 * width * ENTRIES < 2**62 and most * ROWS < 2**62 else points.astype(object)


def integers(vectors: DataFrame, vector: str, rest: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(_v: floor(256 x) of each component, and the other columns) of the rows that are kept, and the length of all _v.

    Rows go whose vector is null or holds nulls, NaN or infinities. The length is the largest one rounded up to 16; shorter vectors end in zeros.
    """
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.coalesce(fine, F.lit(False)))
    longest = rows.agg(F.max(F.size(x))).first()[0] or 0
    width = max(-(-longest // PARTS), 1) * PARTS
    whole = F.concat(F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)), F.array_repeat(F.lit(0).cast("long"), width - F.size(x)))
    return rows.select(whole.alias("_v"), *rest), width


def _numbers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("_v")).flatten().to_numpy(zero_copy_only=False)
    return _exact(flat.reshape(batch.num_rows, PARTS, width // PARTS), width // PARTS)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def fit(rows: DataFrame, width: int, first: str, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, component) after so many rounds; they start as the parts of the 64 rows with the smallest ``first``.

    None without rows. Equal ``first`` are ordered by the vector, nulls come last. The driver sees sums of entries only: 64 x width numbers.
    """
    start = [r["_v"] for r in rows.orderBy(F.col(first).asc_nulls_last(), "_v").limit(ENTRIES).collect()]
    if not start:
        return None
    books = np.array(start, object).reshape(len(start), PARTS, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        known = _held(books)

        def partial(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            total, count = known.astype(object) * 0, np.zeros(known.shape[:2], np.int64)
            for batch in _slices(batches):
                points = _numbers(batch, width)
                for part in range(PARTS):
                    t, c = sums(points[:, part], _like(known[part], points))
                    total[part] += t.astype(object)
                    count[part] += c
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry], pa.int64()), "total": pa.array([[str(v) for v in x] for x in total[part, entry]], pa.list_(pa.string()))}
            )

        found = rows.select("_v").mapInArrow(partial, "part int, entry int, n long, total array<string>")
        each = found.select("part", "entry", "n", F.posexplode("total").alias("position", "v"))
        for r in each.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("total")).collect():
            books[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return books


def _held(books: np.ndarray) -> np.ndarray:
    """As 64-bit integers where they fit."""
    return books.astype(np.int64) if books.size and max(abs(int(books.max())), abs(int(books.min()))) < 2**63 else books


def _like(entries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Entries are floors of means of points or points, so whatever holds all points holds them; a batch of small ones may not."""
    return entries.astype(points.dtype) if points.dtype == object or entries.dtype == object else entries


def digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in (() if books is None else books.ravel())).encode()).hexdigest()


def encode(rows: DataFrame, width: int, books: np.ndarray, rest: tuple[str, ...]) -> DataFrame:
    """The other columns, code (two hex digits a part) and error (null beyond 64 bits) of each row."""
    known = _held(books)
    kinds = {f.name: f.dataType for f in rows.schema}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            points = _numbers(batch, width)
            if points.dtype != object and _exact(known.reshape(-1, known.shape[2]), width // PARTS).dtype == object:
                points = points.astype(object)
            found = [codes(points[:, part], _like(known[part], points)) for part in range(PARTS)]
            error = sum(d.astype(object) for _, d in found)
            digits = np.stack([c for c, _ in found], 1).astype(np.uint8)
            text = [row.tobytes().hex() for row in digits]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            held = pa.array([int(x) if x < 2**63 else None for x in error], pa.int64())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(text, pa.string()), held], names=[*rest, "code", "error"])

    schema = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in rest), "code string", "error long"])
    return rows.mapInArrow(coded, schema)


def report(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (null beyond 64 bits), codebooks_sha256 of each row with a usable vector.

    Null, empty and repeated rows: null and non-finite vectors go; empty ones are all zeros; repeated rows each count and get equal codes. Null
    ids come last among the first entries. Fewer than 64 rows give fewer entries; a table without usable rows gives none. Errors of one label are
    added up before rows meet them, hot labels apart.
    """
    named = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("_x"), F.col(label).alias("_label"))
    rows, width = integers(named, "_x", ("vec_id", "_label"))
    books = fit(rows, width, "vec_id")
    if books is None:
        empty = rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.withColumn("codebooks_sha256", F.lit(digest(None)))
    coded = store(encode(rows, width, books, ("vec_id", "_label")).withColumns({"_none": F.col("_label").isNull(), "_label": _some(F.col("_label"), rows)}))
    by = store(coded.groupBy("_label", "_none").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n")))
    return join_groups(coded, by, ["_label", "_none"], "_n").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _some(label: Column, rows: DataFrame) -> Column:
    """The label with a value in place of null, which its own mark tells apart."""
    return F.coalesce(label, F.lit(0).cast(rows.schema["_label"].dataType))
