"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text within e edits shares at least m - q + 1 - q * e q-grams with it, all
within a diagonal band. Shared q-grams are counted in overlapping bands; bands that reach the bound are verified by banded
alignment, neighbouring ones as one region, so a text that repeats itself costs one pass for each region. Texts are compared in lower
case with runs of blanks as one space; places are given in the text as it is. e is a fixed share of m, less where the bound would not
be positive. Items under q characters have no q-gram and match exactly, where no word goes on at either end. Null and empty texts
match nothing, null and blank items occur nowhere. Equal items are all reported, equal rows each for itself; items without an id
count, with a null id. Empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.common import store

Q, EDIT_SHARE = 8, 0.08
#: Items are matched in blocks of about this many characters, one pass over the texts for each, so what is broadcast is bounded.
BLOCK_CHARS = 2_000_000
_BITS = 22
#: Neighbouring bands are aligned together, about this many diagonals at once.
PIECE = 1 << 16
_M = np.uint64(0x9E3779B97F4A7C15)
MATCH = "array<struct<item:long,start:int,end:int,edits:int>>"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def source_places(text: str) -> list[int]:
    """For each code point of the normal text the place in the text that it comes from."""
    out: list[int] = []
    blank = -1
    for i, c in enumerate(text):
        if c.isspace():
            blank = i if blank < 0 else blank
            continue
        if blank >= 0 and out:
            out.append(blank)
        blank = -1
        out += [i] * len(c.lower())
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams, by doubling (Q is a power of two)."""
    h = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    step, mult = 1, 0x9E3779B97F4A7C15
    while step < Q:
        if len(h) <= step:
            return np.empty(0, np.uint64)
        h = h[:-step] * np.uint64(mult) + h[step:]
        mult = mult * mult * 0x9E3779B97F4A7C15 % (1 << 64) | 1
        step *= 2
    return h ^ (h >> np.uint64(29))


def align(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of item within text, if it needs no more than ``limit`` edits; a row for each character of the item.

    text is a region with its first diagonal at 0 and its last at len(text) - len(item); cells outside that band and its edit margin are left out.
    """
    m, width = len(item), len(text) - len(item) + 2 * limit + 1
    if width <= 0:
        return None
    far = 1 << 20
    # column k of row i stands for text position i + k - limit
    pos = np.arange(width) - limit
    cost = np.where((pos >= 0) & (pos <= len(text)), 0, far)
    origin = pos.copy()
    ramp = np.arange(width)
    for i in range(1, m + 1):
        at = pos + i
        inside = (at >= 0) & (at <= len(text))
        same = np.zeros(width, bool)
        ok = (at >= 1) & (at <= len(text))
        same[ok] = text[at[ok] - 1] == item[i - 1]
        diagonal = cost + ~same
        above = np.append(cost[1:], far) + 1
        best = np.minimum(diagonal, above)
        first = np.where(diagonal <= above, origin, np.append(origin[1:], 0))
        run = best - ramp
        low = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == low, ramp, 0))
        cost = np.where(inside, low + ramp, far)
        origin = first[source]
        if cost.min() > limit:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(origin[k]), int(pos[k] + m)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE):
        plain = [(i, normal(t)) for i, t in items]
        self.short = [(i, t) for i, t in plain if 0 < len(t) < Q]
        self.items = [(i, points(t)) for i, t in plain if len(t) >= Q]
        self.limit = []
        for _, c in self.items:
            e = int(len(c) * share)
            while e and len(c) - Q + 1 - Q * e <= 0:
                e -= 1
            self.limit.append(e)
        self.need = np.array([len(c) - Q + 1 - Q * e for (_, c), e in zip(self.items, self.limit, strict=True)], np.int64)
        hashes = [grams(c) for _, c in self.items]
        flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.empty(0, np.int64)
        place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.empty(0, np.int64)]).astype(np.int64)
        # places of one q-gram within e + 1 of an item's characters reach two bands at most: the least and the largest place say which
        piece = place // (np.array([*self.limit, 0], np.int64)[owner] + 1)
        order = np.lexsort((place, piece, owner, flat))
        flat, owner, place, piece = flat[order], owner[order], place[order], piece[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        self.hash, self.owner, self.low, self.high = flat[first], owner[first], place[first], place[np.append(first[1:], len(flat))[: len(first)] - 1]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self._slot(flat)] = True
        # the sparsest run of hits that can hold a match: need of (m + e - q + 1) positions
        self.window = max((len(c) + e - Q + 1 for (_, c), e in zip(self.items, self.limit, strict=True)), default=0)
        self.least = int(self.need.min()) if len(self.need) else 1

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * _M) >> np.uint64(64 - _BITS)).astype(np.int64)

    def occurs(self, text: str | None) -> bool:
        """Whether any item does."""
        body = normal(text)
        return any(True for _ in self._exact(body)) or bool(self._similar(body))

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best match of each item that occurs, in the text's code points."""
        body = normal(text)
        found = [*self._exact(body), *self._similar(body)]
        if not found or body == text:
            return found
        at = source_places(text)
        return [(i, at[a], at[b - 1] + 1 if b else 0, e) for i, a, b, e in found]

    def _exact(self, body: str) -> Iterator[tuple[int, int, int, int]]:
        for i, item in self.short:
            p = body.find(item)
            while p >= 0:
                end = p + len(item)
                if not (p and item[0].isalnum() and body[p - 1].isalnum()) and not (item[-1].isalnum() and body[end : end + 1].isalnum()):
                    yield i, p, end, 0
                    break
                p = body.find(item, p + 1)

    def _similar(self, body: str) -> list[tuple[int, int, int, int]]:
        if not self.items or len(body) < Q:
            return []
        codes = points(body)
        h = grams(codes)
        at = np.flatnonzero(self.seen[self._slot(h)])
        if len(at) < self.least:
            return []
        # every hit that lies in any window of at least ``least`` hits: whole runs are marked
        run = np.flatnonzero(at[self.least - 1 :] - at[: len(at) - self.least + 1] < self.window)
        near = np.zeros(len(at) + 1, np.int64)
        near[run] += 1
        near[run + self.least] -= 1
        at = at[np.cumsum(near[:-1]) > 0]
        lo, hi = np.searchsorted(self.hash, h[at], side="left"), np.searchsorted(self.hash, h[at], side="right")
        n = hi - lo
        total = int(n.sum())
        if total < self.least:
            return []
        entry = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
        owner, where = self.owner[entry], np.repeat(at, n)
        enough = np.bincount(owner, minlength=len(self.items)) >= self.need
        best: dict[int, tuple[int, int, int]] = {}
        for k in np.flatnonzero(enough):
            e, c = self.limit[k], self.items[k][1]
            own = np.flatnonzero(owner == k)
            w, mine = where[own], entry[own]
            # bands of e + 1 diagonals; any e + 1 neighbours lie in two that touch, so a hit counts for its band and the one before
            one, other = (w - self.high[mine]) // (e + 1), (w - self.low[mine]) // (e + 1)
            low = int(one.min()) - 1
            pairs = np.unique(np.concatenate((one - 1, one, other - 1, other) if e else (one - 1, one)).astype(np.int64) * (len(codes) + 1) + np.tile(w, 4 if e else 2))
            bands = np.bincount(pairs // (len(codes) + 1) - low)
            full = np.flatnonzero(bands >= self.need[k]) + low
            for region in np.split(full, np.flatnonzero(np.diff(full) > 1) + 1):
                for part in np.split(region, range(PIECE // (e + 1), len(region), PIECE // (e + 1))):
                    if not len(part):
                        continue
                    a, b = max(0, int(part[0]) * (e + 1) - e), min(len(codes), (int(part[-1]) + 2) * (e + 1) - 1 + len(c) + e)
                    got = align(c, codes[a:b], e)
                    if got and (k not in best or (got[0], a + got[1]) < (best[k][2], best[k][0])):
                        best[k] = (a + got[1], a + got[2], got[0])
                if k in best and not best[k][2]:
                    break  # nothing that follows has less edits or starts earlier
        return [(self.items[k][0], *v) for k, v in best.items()]


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks, and the items in blocks of about ``chars`` characters; one block at a time is in the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).filter(F.col("t").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = -(-total // chars)
    return n, ([(r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()] for b in range(n))


def _found(shared, share: float):
    @F.pandas_udf(MATCH)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, share)
        for batch in batches:
            yield pd.Series([[{"item": i, "start": a, "end": b, "edits": e} for i, a, b, e in matcher.find(x)] for x in batch], dtype=object)

    return of(F.coalesce("text", F.lit("")))


def _free(shared, share: float):
    @F.pandas_udf("boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, share)
        for batch in batches:
            yield pd.Series([not matcher.occurs(x) for x in batch], dtype=bool)

    return of(F.coalesce("text", F.lit("")))


def _passes(frame: DataFrame, benchmark: DataFrame, share: float, chars: int, step) -> Iterator[DataFrame]:
    """Frames that ``step`` makes of the last one it made and one broadcast block; each but a single one is written before the next block is sent."""
    n, items = blocks(benchmark, chars)
    for block in items:
        shared = frame.sparkSession.sparkContext.broadcast(block)
        frame = step(frame, shared)
        if n > 1:
            frame = store(frame)
            shared.unpersist()
        yield frame


def matches(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, match_start, match_end (code points of the text), edits of the best place of each item in each document that holds it."""

    def step(_, shared) -> DataFrame:
        # the outer form, for explode() has the optimizer filter by size first, which evaluates the function twice
        found = docs.select("doc_id", F.explode_outer(_found(shared, share)).alias("m")).filter(F.col("m").isNotNull())
        return found.select("doc_id", F.col("m.item").alias("item_id"), F.col("m.start").alias("match_start"), F.col("m.end").alias("match_end"), F.col("m.edits").alias("edits"))

    none = docs.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("match_start", "int"), ("match_end", "int"), ("edits", "int"))]).limit(0)
    return reduce(DataFrame.unionByName, list(_passes(docs, benchmark, share, chars, step)) or [none])


def clean(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns, that hold no item."""
    left = docs
    for left in _passes(docs, benchmark, share, chars, lambda d, shared: d.filter(_free(shared, share))):
        pass
    return left
