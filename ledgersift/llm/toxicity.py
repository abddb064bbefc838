"""Toxicity: a linear-chain conditional random field over tokens, with spans and document scores.

The field has two states, plain and toxic; what it observes of a token is the evidence class of its form: how often the word, or the
longest known prefix of it, is a toxic token. No table labels tokens, only documents, so the tokens' labels are hidden states that
the fit infers, of a document labelled 0 every token being plain, of one labelled 1 some token toxic. First the rates of forms are
fitted to that by expectation and maximisation: a toxic document's blame goes to its words by their rates, so words that merely stand
beside toxic ones lose most of theirs, and each form's rate leans on that of its prefix, so endings not seen before have one and harmless
words of a toxic stem keep their own. Then the field is fitted, to the likelihood of the labels over all tokens of whole texts.

Runs of tokens without evidence are passed with powers of one matrix, so forward-backward stays exact and costs as much as there
are tokens with evidence. A document's score is the probability, over all its tokens, that any is toxic; spans are runs of tokens
by their marginals. A null, empty or wordless text has the score 0 and no spans. Equal texts count once in the fit, with the label of
the smallest doc_id; the result does not depend on the order of rows. Without labelled rows all scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.common import labelled_sample, store

#: The lexicon and the field are fitted on at most this many labelled documents, the field's weights on so many of those.
SAMPLE_ROWS, FIT_SEQUENCES = 20_000, 2_000
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Rates at which the evidence classes 1, 2, ... begin.
CLASSES = (0.02, 0.06, 0.15, 0.3, 0.5, 0.8)
#: Forms with this many times the odds of a toxic document are looked into; rows that the prefix's rate counts as; the rate of a word without any; rounds.
LEAST_ODDS, PRIOR_ROWS, PRIOR_RATE, ROUNDS = 3.0, 5.0, 1e-3, 600
FIT_STEPS, FIT_RATE, FIT_DECAY = 60, 0.3, 1e-3
#: Words whose class a task remembers, and gaps whose matrix it remembers.
CACHE_FORMS, CACHE_GAPS = 300_000, 20_000
#: Forms that a task counts before it gives them out.
COUNTED_FORMS = 50_000

_words = re.compile(r"\w+")


def forms(word: str) -> list[str]:
    """Its prefixes, from the shortest, and the word."""
    return [*(word[:n] + "*" for n in PREFIXES if len(word) > n), word]


@dataclass(frozen=True)
class Field:
    """evidence: form -> class. All weights are relative to plain: emit [class] and start of toxic, move from state to state."""

    evidence: dict[str, int]
    emit: np.ndarray
    start: float
    move: np.ndarray


def unpack_field(evidence: dict[str, int], w: np.ndarray) -> Field:
    return Field(evidence, w[4:], float(w[0]), np.array([[0.0, w[1]], [w[2], w[3]]]))


def _counts(sample: DataFrame) -> DataFrame:
    """form, n, a: words of documents that have the form, counted once a document, and those of toxic documents.

    A task gives out what it counted whenever that are COUNTED_FORMS; Spark adds them up.
    """

    def out(n: Counter[str], a: Counter[str]) -> pd.DataFrame:
        return pd.DataFrame({"form": list(n), "n": list(n.values()), "a": [a[f] for f in n]})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        a: Counter[str] = Counter()
        for batch in batches:
            for text, y in zip(batch["_text"], batch["_label"], strict=True):
                found = [f for w in set(_words.findall((text or "").lower())) for f in forms(w)]
                n.update(found)
                if y:
                    a.update(found)
                if len(n) >= COUNTED_FORMS:
                    yield out(n, a)
                    n, a = Counter(), Counter()
        if n:
            yield out(n, a)

    return sample.select("_text", "_label").mapInPandas(of, "form string, n long, a long").groupBy("form").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))


def _rates(known: dict[str, int], n: np.ndarray, a: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Rate of each form (prefixes before what they begin), from the longest forms of the words of each toxic document."""
    above = [[known[f] for f in forms(x.rstrip("*"))[:-1] if f in known] for x in known]
    parent = np.array([x[-1] if x else len(known) for x in above], np.int64)
    depth = np.array([len(x) for x in above], np.int64)
    levels = [np.flatnonzero(depth == d) for d in range(depth.max(initial=-1) + 1)]
    doc, leaf = np.repeat(np.arange(len(docs)), [len(x) for x in docs]), np.concatenate([*docs, np.empty(0, np.int64)]).astype(np.int64)

    def rates(blame: np.ndarray) -> np.ndarray:
        p = np.full(len(known) + 1, PRIOR_RATE)
        for level in levels:
            p[level] = (blame[level] + PRIOR_ROWS * p[parent[level]]) / (n[level] + PRIOR_ROWS)
        return np.minimum(p, 0.9999)

    p = rates(a)
    for _ in range(ROUNDS):
        some = -np.expm1(np.bincount(doc, np.log1p(-p[leaf]), minlength=len(docs)))
        blame = np.append(np.bincount(leaf, p[leaf] / np.maximum(some[doc], 1e-9), minlength=len(known)), 0.0)
        for level in levels[:0:-1]:
            np.add.at(blame, parent[level], blame[level])
        last, p = p, rates(blame[:-1])
        if np.abs(p - last).max() < 1e-5:
            break
    return p[:-1]


def lexicon(sample: DataFrame) -> dict[str, int]:
    """Evidence classes of the forms whose class is not that of their longest known prefix (Spark counts all forms)."""
    sizes = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("t")).first()
    n1, n0 = int(sizes["t"]), int(sizes["n"] - sizes["t"])
    counts = store(_counts(sample).filter("n > 1 OR a > 0"))
    odds = (F.col("a") + 0.5) / (F.col("n") - F.col("a") + 0.5)
    leading = counts.filter((F.col("a") > 1) & (odds * (n0 + 0.5) >= LEAST_ODDS * (n1 + 0.5)))
    # with them all that they begin: a harmless word of a toxic stem is known by itself
    stem = F.regexp_replace("form", r"\*$", "")
    prefixes = F.array(*[F.when(F.length(stem) > k, F.concat(F.left(stem, F.lit(k)), F.lit("*"))) for k in PREFIXES])
    begun = counts.withColumn("prefix", F.explode(prefixes)).join(leading.select(F.col("form").alias("prefix")), "prefix", "left_semi").drop("prefix")
    rows = leading.unionByName(begun).distinct().collect()  # a model: forms of at most SAMPLE_ROWS documents
    rows.sort(key=lambda r: (len(r["form"].rstrip("*")), not r["form"].endswith("*"), r["form"]))
    known = {r["form"]: i for i, r in enumerate(rows)}

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            longest = ((next((known[f] for f in reversed(forms(w)) if f in known), -1) for w in set(_words.findall((t or "").lower()))) for t in batch["_text"])
            yield pd.DataFrame({"x": [np.array(sorted(i for i in x if i >= 0), np.int64).tobytes() for x in longest]})

    docs = sorted(bytes(r["x"]) for r in sample.filter("_label = 1").select("_text").mapInPandas(of, "x binary").collect()) if known else []
    rate = _rates(known, np.array([r["n"] for r in rows], float), np.array([r["a"] for r in rows], float), [np.frombuffer(x, np.int64) for x in docs])
    out: dict[str, int] = {}
    for form, c in zip(known, np.searchsorted(CLASSES, rate, side="right"), strict=True):
        stem = form.rstrip("*")
        if int(c) != next((out[f] for f in reversed(forms(stem)[:-1]) if f in out), 0):
            out[form] = int(c)
    return out


class _Classes(dict):
    """Evidence class of each word met: that of its longest form known."""

    def __init__(self, evidence: dict[str, int]):
        super().__init__()
        self.evidence = evidence

    def __missing__(self, word: str) -> int:
        got = next((self.evidence[f] for f in reversed(forms(word)) if f in self.evidence), 0)
        if len(self) > CACHE_FORMS:
            self.clear()
        self[word] = got
        return got


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, whose axes come first."""
    out = np.empty((2, 2, *np.broadcast_shapes(a.shape[2:], b.shape[2:])))
    for i in (0, 1):
        for j in (0, 1):
            np.multiply(a[i, 0], b[0, j], out=out[i, j])
            out[i, j] += a[i, 1] * b[1, j]
    return out


def _scaled(m: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = m.sum(axis=(0, 1))
    return m / total, log + np.log(total)


class Likelihood:
    """Log-likelihood of document labels, for several weight vectors side by side.

    A document is a product of factors: its first token, then for each token with evidence the gap before it and the token, then the
    gap to its end. Factors are multiplied in pairs, again and again; which ones is worked out once.
    """

    def __init__(self, seqs: list[np.ndarray], toxic: list[int], classes: int):
        self.toxic = np.array(toxic, bool)
        gap, token, first, sizes = [], [], [], []
        for x in seqs:
            at = np.flatnonzero(x[1:]) + 1
            gap += [0, *(np.diff(np.append(0, at)) - 1), len(x) - 1 - (at[-1] if len(at) else 0)]
            token += [int(x[0]), *x[at], -1]
            first += [True, *[False] * (len(at) + 1)]
            sizes.append(len(at) + 2)
        self.gaps, self.gap = np.unique(np.array(gap, np.int64), return_inverse=True)
        token = np.array(token, np.int64)
        self.kind = np.where(token < 0, 2 * classes, token + classes * np.array(first, bool))
        self.levels = []
        sizes = np.array(sizes, np.int64)
        while len(sizes) and sizes.max() > 1:
            starts, half = np.cumsum(sizes) - sizes, -(-sizes // 2)
            place = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half)
            left = np.repeat(starts, half) + 2 * place
            there = 2 * place + 1 < np.repeat(sizes, half)
            self.levels.append((left, left[there] + 1, there))
            sizes = half

    def log_z(self, w: np.ndarray) -> np.ndarray:
        """[weights, documents]: log of the weight of all paths, that of the plain path being 1."""
        e = np.exp(w).T
        k, one = len(w), np.ones(len(w))
        emit = e[4:]
        move = np.array([[one, e[1]], [e[2], e[3]]])
        plain = move * np.array([one, emit[0]])
        # powers of the plain token's matrix for all gaps that occur, by squaring
        power, log = np.zeros((2, 2, k, len(self.gaps))), np.zeros((k, len(self.gaps)))
        power[0, 0] = power[1, 1] = 1
        square, square_log = plain, np.zeros(k)
        for bit in range(int(self.gaps.max(initial=0)).bit_length()):
            on = (self.gaps >> bit) & 1 == 1
            power[..., on], log[:, on] = _scaled(_times(power[..., on], square[..., None]), log[:, on] + square_log[:, None])
            square, square_log = _scaled(_times(square, square), 2 * square_log)
        # by kind of factor: a class after a gap, a class at the start, or the end, which leaves all as it is
        kinds = np.zeros((2, 2, k, 2 * len(emit) + 1))
        kinds[..., : len(emit)] = move[..., None] * np.array([np.ones_like(emit.T), emit.T])
        kinds[0, 0, :, len(emit) : -1], kinds[0, 1, :, len(emit) : -1] = 1, (e[0] * emit).T
        kinds[0, 0, :, -1] = kinds[1, 1, :, -1] = 1
        m, log = _scaled(_times(power[..., self.gap], kinds[..., self.kind]), log[:, self.gap])
        for left, right, there in self.levels:
            product, sums = m[..., left], log[:, left]
            product[..., there] = _times(product[..., there], m[..., right])
            sums[:, there] += log[:, right]
            m, log = _scaled(product, sums)
        return log + np.log(m[0].sum(axis=0))

    def of(self, w: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Mean over the documents, less a penalty on the way from the prior weights."""
        z = np.maximum(self.log_z(w), 1e-12)
        return np.where(self.toxic, np.log(-np.expm1(-z)), -z).mean(axis=1) - FIT_DECAY * ((w - prior) ** 2).sum(axis=1)


def _prior(classes: int) -> np.ndarray:
    """Weights by which a token alone is toxic at the middle rate of its class; what the sample does not show stays there."""
    rate = np.sqrt(np.array([PRIOR_RATE, *CLASSES])[:classes] * np.array([PRIOR_RATE, *CLASSES[1:], 1.0])[:classes])
    return np.array([-3.0, -3.0, 0.0, 0.5, *(np.log(rate / (1 - rate)) + 3.0)])


def _fit(seqs: list[np.ndarray], toxic: list[int], classes: int) -> np.ndarray:
    """Weights (start, three moves, emit by class) by ascent on the likelihood with differences as gradient; the same for the same rows."""
    prior = w = _prior(classes)
    if not seqs or not any(toxic):
        return np.concatenate((w[:4], np.full(classes, -30.0)))  # nothing is toxic
    likelihood, h = Likelihood(seqs, toxic, classes), 1e-4
    speed, size = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, FIT_STEPS + 1):
        around = likelihood.of(np.concatenate((w + h * np.eye(len(w)), w - h * np.eye(len(w)))), prior)
        slope = (around[: len(w)] - around[len(w) :]) / (2 * h)
        speed, size = 0.9 * speed + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        w = w + FIT_RATE * (speed / (1 - 0.9**t)) / (np.sqrt(size / (1 - 0.99**t)) + 1e-8)
    return w


def observe(text: str | None, classes: _Classes) -> np.ndarray:
    return np.array([classes[w] for w in _words.findall((text or "").lower())], np.int8)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> Field:
    """Fit on at most ``rows`` labelled documents outside the held-out fold (the field's weights on FIT_SEQUENCES of them)."""
    ids = labelled_sample(labels, "doc_id", label, folds, held_out, rows)
    sample = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(ids), "_id")
    sample = store(sample.groupBy("_text").agg(F.min(F.struct("_id", "_label")).alias("m")).select("_text", F.col("m._id").alias("_id"), F.col("m._label").alias("_label")))
    other = F.pmod(F.xxhash64("_id", F.lit("field")), F.lit(3)) == 0  # the field is fitted on rows that the lexicon has not seen
    evidence, whole = lexicon(sample.filter(~other)), lexicon(sample)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = _Classes(evidence)
        for batch in batches:
            yield pd.DataFrame([(observe(text, classes).tobytes(), int(y)) for text, y in zip(batch["_text"], batch["_label"], strict=True)], columns=["x", "y"])

    chosen = sample.filter(other).orderBy(F.xxhash64("_id", F.lit("order")), "_id").limit(FIT_SEQUENCES)
    got = sorted((bytes(x), y) for x, y in chosen.mapInPandas(of, "x binary, y int").collect() if x) if evidence else []
    return unpack_field(whole, _fit([np.frombuffer(x, np.int8) for x, _ in got], [y for _, y in got], len(CLASSES) + 1))


class Tagger:
    """Exact forward-backward of a field; the powers of the matrix of a token without evidence are kept."""

    def __init__(self, field: Field):
        self.classes = _Classes(field.evidence)
        self.emit = np.stack([np.ones(len(field.emit)), np.exp(field.emit)], 1)
        self.start, self.move = np.array([1.0, np.exp(field.start)]), np.exp(field.move)
        self.plain = self.move * self.emit[0][None, :]
        self.steps = {0: (np.eye(2), 0.0)}
        self.quiet: dict[int, float] = {0: 0.0}
        self.known = bool(field.evidence)

    def _power(self, n: int) -> tuple[np.ndarray, float]:
        """n tokens without evidence: a scaled matrix and the log of the scale."""
        if n not in self.steps:
            if len(self.steps) > CACHE_GAPS:
                self.steps = {0: (np.eye(2), 0.0)}
            half, log = self._power(n // 2)
            m = half @ half @ (self.plain if n % 2 else np.eye(2))
            self.steps[n] = m / m.sum(), 2 * log + float(np.log(m.sum()))
        return self.steps[n]

    def any_toxic(self, x: list[int]) -> float:
        """1 less the share of the path that is plain throughout."""
        v, log, last = self.start * self.emit[x[0]], 0.0, 0
        for i, c in enumerate(x):
            if c and i:
                m, scale = self._power(i - last - 1)
                v = v @ m @ self.move * self.emit[c]
                total = v.sum()
                v, log, last = v / total, log + scale + float(np.log(total)), i
        m, scale = self._power(len(x) - 1 - last)
        return float(-np.expm1(-max(0.0, log + scale + float(np.log((v @ m).sum())))))

    def marginals(self, x: list[int]) -> tuple[list[int], np.ndarray]:
        """Positions to look at (with evidence, beside evidence, first and last) and P(toxic) there; others lie between their neighbours."""
        n = len(x)
        at = sorted({0, n - 1, *(j for i, c in enumerate(x) if c for j in (i - 1, i, i + 1) if 0 <= j < n)})
        f, b = np.zeros((len(at), 2)), np.ones((len(at), 2))
        f[0] = self.start * self.emit[x[0]]
        f[0] /= f[0].sum()
        for k in range(1, len(at)):
            v = f[k - 1] @ self._power(at[k] - at[k - 1] - 1)[0] @ self.move * self.emit[x[at[k]]]
            f[k] = v / v.sum()
        for k in range(len(at) - 1, 0, -1):
            v = self._power(at[k] - at[k - 1] - 1)[0] @ (self.move @ (self.emit[x[at[k]]] * b[k]))
            b[k - 1] = v / v.sum()
        p = f * b
        return at, p[:, 1] / p.sum(axis=1)

    def score(self, text: str | None) -> float:
        if not text or not self.known:
            return 0.0
        classes = self.classes
        x = [classes[w] for w in _words.findall(text.lower())]
        if any(x):
            return self.any_toxic(x)
        if len(x) not in self.quiet:
            self.quiet[len(x)] = self.any_toxic(x)
        return self.quiet[len(x)]

    def spans(self, text: str | None, least: float = 0.5, given: float = 1.0) -> list[tuple[int, int, float]]:
        """(start, end, largest marginal) of runs of words at or above ``least``, in code points.

        With a score below 1 as ``given`` the marginals are those of a toxic text, of which some token is toxic: the likeliest has a span.
        """
        if not text or not self.known:
            return []
        lower = text.lower() if len(text.lower()) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        found = list(_words.finditer(lower))
        if not found:
            return []
        x = [self.classes[m.group()] for m in found]
        if not any(x) and self.emit[0, 1] < 1:
            return []  # a token without evidence is likelier plain than toxic wherever it stands
        at, p = self.marginals(x)
        if given < 1:
            p = np.minimum(p / given, 1.0)
            least = min(least, float(p.max()))
        out: list[list] = []
        last = -2
        for i, q in zip(at, p, strict=True):
            if q >= least:
                if i == last + 1:
                    out[-1][1], out[-1][2] = found[i].end(), max(out[-1][2], float(q))
                else:
                    out.append([found[i].start(), found[i].end(), float(q)])
                last = i
        return [tuple(x) for x in out]


def score(text: Column, field: Field) -> Column:
    """Probability that any of a text's tokens is toxic."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(field)
        for batch in batches:
            yield pd.Series([tagger.score(x) for x in batch], dtype=float)

    return of(F.coalesce(text, F.lit("")))


def spans(text: Column, field: Field, least: float = 0.5) -> Column:
    """Array of (start, end, p) of toxic spans."""

    @F.pandas_udf("array<struct<start:int,end:int,p:double>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(field)
        for batch in batches:
            yield pd.Series([[{"start": a, "end": b, "p": p} for a, b, p in tagger.spans(x, least)] for x in batch], dtype=object)

    return of(F.coalesce(text, F.lit("")))


def tags(text: Column, field: Field, least: float = 0.5, toxic: float = 0.3) -> Column:
    """Struct of score and offsets: the spans as "start-end", joined by blanks; texts with a score of ``toxic`` or more count as toxic, others have none."""

    @F.pandas_udf("score double, offsets string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(field)
        for batch in batches:
            scored = [(x, tagger.score(x)) for x in batch]
            yield pd.DataFrame([(s, " ".join(f"{a}-{b}" for a, b, _ in tagger.spans(x, least, s)) if s >= toxic else "") for x, s in scored], columns=["score", "offsets"])

    return of(F.coalesce(text, F.lit("")))
