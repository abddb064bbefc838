"""Substring dedup: a de Bruijn graph of token k-mers, compacted through joins, finds long passages that repeat across documents.

A text is a walk whose edges are its token k-mers. Edges between two anchors are kept as one run: anchors are the k-mers of least
hash in some window, so every window holds one that its words alone determine, and equal windows have equal anchors. A join of
the anchors with their groups tells each occurrence the smallest document that has it, and whether all occurrences have one run
in and one run out. Anchors where that is so do not branch; the runs on either side are compacted into one path, a window over
each document's occurrences. All occurrences of a path have the same words, so windows inside it need no more. Windows that
touch a branch are verified at their source coordinates: two independent 64-bit hashes of their words are grouped.

Words are runs of bytes other than ASCII blanks. Null texts have no words. Rows without doc_id lose nothing and are no source;
rows with equal ids are separate documents of one rank; fully equal rows are treated alike. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.llm.common import WordHasher, join_groups, mix, pack, split_words, store, unpack

WINDOW, K = 50, 8
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _slide(op, a: np.ndarray, width: int) -> np.ndarray:
    """op over every run of ``width`` values, by doubling."""
    n, r, size = len(a) - width + 1, a, 1
    while size * 2 <= width:
        r = op(r[:-size], r[size:])
        size *= 2
    return op(r[:n], r[width - size : width - size + n])


class Anchored:
    """Anchors of one text of at least ``window`` words."""

    def __init__(self, words: list[bytes], window: int = WINDOW, k: int = K):
        self.n, self.k, self.window = len(words), k, window
        self.hasher = WordHasher(words)
        self.kmers = self.hasher.windows(k)
        reach = window - k + 1
        self.least = _slide(np.minimum, self.kmers, reach)
        padded = np.concatenate((np.zeros(reach - 1, np.uint64), self.least, np.zeros(reach - 1, np.uint64)))
        self.at = np.flatnonzero(_slide(np.maximum, padded, reach) == self.kmers)

    def around(self) -> np.ndarray:
        """For each anchor one hash of the runs into it and out of it."""
        at = self.at
        into = self.hasher.runs(np.append(0, at[:-1]), at + self.k - 1)
        out = self.hasher.runs(at, np.append(at[1:] + self.k - 1, self.n - 1))
        into[0] ^= _START
        out[-1] ^= _END
        return mix(into * _START + out)

    def own(self) -> np.ndarray:
        """For each window the number of its first anchor of least hash."""
        p = np.arange(len(self.least))
        got = np.searchsorted(self.at, p)
        values = self.kmers[self.at]
        while len(wrong := np.flatnonzero(values[got] != self.least)):
            got[wrong] += 1
        return got


def _anchors(window: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for i, th, text in zip(batch["_id"], batch["_th"], batch["_text"], strict=True):
                words = split_words(text)
                if len(words) < window:
                    continue
                a = Anchored(words, window)
                m = len(a.at)
                parts.append((np.full(m, i), np.full(m, th), a.at, a.kmers[a.at].view(np.int64), a.around().view(np.int64)))
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 5
            yield pd.DataFrame(dict(zip(("_id", "_th", "_pos", "_h", "_runs"), cols, strict=True)))

    return of


def _settle(words: list[bytes], doc: int, listed: list, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows to remove as compact paths have it, and starts of those to verify with both hashes of their words.

    A path reaches from the anchor before its first to the end of the one behind its last.
    """
    a = Anchored(words, window)
    m = len(a.at)
    begins, ends = np.append(0, a.at[:-1]), np.append(a.at[1:] + a.k, a.n)
    low, high = (np.searchsorted(a.at, [x[c] for x in listed]) for c in ("f", "l"))
    known, single = np.zeros(m, bool), np.zeros(m, bool)
    least, first, last = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    for x, i, j in zip(listed, low, high + 1, strict=True):
        known[i:j], single[i:j], least[i:j], first[i:j], last[i:j] = True, not x["b"], x["d"], begins[i], ends[j - 1]
    own = a.own()
    p = np.arange(len(own))
    inside = single[own] & (p >= first[own]) & (p + window <= last[own])
    gone = np.flatnonzero(inside & (least[own] < doc))
    open_ = np.flatnonzero(known[own] & ~inside)
    joined, (starts_, ends_) = b" ".join(words), a.hasher.places()
    s, e = starts_[open_], ends_[open_ + window - 1] if len(open_) else open_
    second = np.fromiter((xxhash.xxh3_64_intdigest(joined[i:j]) for i, j in zip(s, e, strict=True)), np.uint64, len(open_))
    return gone.astype(np.int32), open_.astype(np.int32), a.hasher.windows(window)[open_].view(np.int64), second.view(np.int64)


def _digest(text: str | None, starts, window: int) -> tuple[int, int, str]:
    """Number of words, number of removed ones, SHA-256 of those kept."""
    words, gone = _removed(text, np.asarray(starts, np.int64), window)
    kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words)
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()


_DIGEST = "n_words long, n_removed long, kept_sha256 string"
_PATHS = f"_id long, _th long, _text string, _gone array<int>, _open array<int>, _w array<long>, _v array<long>, {_DIGEST}"


def _paths(window: int):
    """For each document: the starts that paths settle, and either its text and the windows to verify or, without any, its digest."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, th, text, listed in zip(batch["_id"], batch["_th"], batch["_text"], batch["_listed"], strict=True):
                gone, open_, w, v = _settle(split_words(text), i, listed, window) if listed is not None else [np.empty(0, np.int32)] * 4
                rows.append((i, th, text, gone, open_, w, v, None, None, None) if len(open_) else (i, th, None, gone, open_, w, v, *_digest(text, gone, window)))
            got = pd.DataFrame(rows, columns=[x.split()[0] for x in _PATHS.split(", ")])
            yield got.astype({"n_words": "Int64", "n_removed": "Int64"})

    return of


def _removed(text: str | None, starts: np.ndarray, window: int) -> tuple[list[bytes], np.ndarray]:
    words = split_words(text)
    turn = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(starts)
    np.add.at(turn, starts, 1)
    np.add.at(turn, starts + window, -1)
    return words, np.cumsum(turn[:-1]) > 0


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).withColumn("_th", F.xxhash64("_text"))


def paths(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """_paths() of all documents with an id, written; texts move once."""
    base = _base(docs).filter(F.col("_id").isNotNull())
    anchors = store(base.mapInPandas(_anchors(window), "_id long, _th long, _pos int, _h long, _runs long"))
    groups = anchors.groupBy("_h").agg(*[f(c).alias(f"_{n}{c}") for c in ("_id", "_runs") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("_n"))
    nodes = store(groups.filter(F.col("_min_id") < F.col("_max_id")).select("_h", F.col("_min_id").alias("_d"), (F.col("_min_runs") != F.col("_max_runs")).alias("_b"), "_n"))
    shared = join_groups(anchors.select("_id", "_th", "_pos", "_h"), nodes, ["_h"], "_n").repartition("_id", "_th")
    shared = shared.groupBy("_id", "_th", "_pos").agg(F.min("_d").alias("_d"), F.max("_b").alias("_b"))  # equal rows once
    along = Window.partitionBy("_id", "_th").orderBy("_pos")
    path = F.sum((F.col("_b") | F.coalesce(F.lag("_b").over(along), F.lit(True))).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    compact = shared.withColumn("_path", path).groupBy("_id", "_th", "_path").agg(F.min("_pos").alias("f"), F.max("_pos").alias("l"), F.min("_d").alias("d"), F.max("_b").alias("b"))
    listed = compact.groupBy("_id", "_th").agg(F.collect_list(F.struct("f", "l", "d", "b")).alias("_listed"))
    return store(base.join(listed, ["_id", "_th"], "left").select("_id", "_th", "_text", "_listed").mapInPandas(_paths(window), _PATHS))


def verified(found: DataFrame) -> DataFrame:
    """_id, _th, _starts of the windows to verify whose words also start in a smaller document."""
    windows = found.select("_id", "_th", F.explode(F.arrays_zip("_open", "_w", "_v")).alias("x")).select("_id", "_th", F.col("x._open").alias("_p"), F.col("x._w").alias("_w"), F.col("x._v").alias("_v"))
    least = windows.groupBy("_w", "_v").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"), F.count("*").alias("_n")).filter(F.col("_least") < F.col("_most")).drop("_most")
    both = join_groups(windows, store(least), ["_w", "_v"], "_n")
    return both.filter(F.col("_least") < F.col("_id")).groupBy("_id", "_th").agg(F.collect_set("_p").alias("_starts"))


def starts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """_id, _th (hash of the text), _starts: word places at which windows to remove start, for documents that have any."""
    found = paths(docs, window)
    settled = found.filter(F.size("_gone") > 0).select("_id", "_th", F.col("_gone").alias("_starts"))
    return settled.unionByName(verified(found)).groupBy("_id", "_th").agg(F.flatten(F.collect_list("_starts")).alias("_starts"))


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    @F.pandas_udf(_DIGEST)
    def digest(text: pd.Series, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_digest(t, x, window) for t, x in zip(text, at, strict=True)], columns=["n_words", "n_removed", "kept_sha256"])

    nothing = F.array().cast("array<int>")
    found = paths(docs, window)
    closed = found.filter(F.size("_open") == 0).select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    open_ = found.filter(F.size("_open") > 0).select("_id", "_th", "_text", "_gone").join(verified(found), ["_id", "_th"], "left")
    opened = open_.select(F.col("_id").alias("doc_id"), digest("_text", F.concat("_gone", F.coalesce("_starts", nothing))).alias("x")).select("doc_id", "x.*")
    nameless = _base(docs).filter(F.col("_id").isNull()).select(F.col("_id").alias("doc_id"), digest("_text", nothing).alias("x")).select("doc_id", "x.*")
    return closed.unionByName(opened).unionByName(nameless)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, with removed words taken out of the text; a text that loses none is left as it is, another's words are joined by one space."""
    found = starts(docs, window)

    @F.pandas_udf("string")
    def keep(text: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for t, a in zip(text, at, strict=True):
            words, gone = _removed(t, np.asarray(a, np.int64), window)
            out.append(b" ".join([w for w, g in zip(words, gone, strict=True) if not g]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    packed = pack(docs)
    text = F.coalesce("_row.text", F.lit(""))
    both = packed.join(found, (F.col("_row.doc_id") == F.col("_id")) & (F.xxhash64(text) == F.col("_th")), "left")
    return unpack(both, docs, text=F.when(F.col("_starts").isNull(), F.col("_row.text")).otherwise(keep(text, F.coalesce("_starts", F.array().cast("array<int>")))))
