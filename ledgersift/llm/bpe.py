"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one last token of its BPE encoding. The tokens that end
at a position come from a suffix automaton of the vocabulary, longest first; the first one whose pairing
with the last token of the prefix before it is what BPE itself would leave standing is stored, and
back-pointers then give the exact ids. Null texts are treated as empty, and empty texts have no tokens.

The automaton and the merges are arrays. The pre-tokens that a group of texts needs are walked over together, a byte of each at a time;
only those of more than CACHE_CHARS characters, and a few where a text begins, are walked over one by one.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cached results per Python worker and kind (chunks, pre-tokens); two generations of this many and a group's at most.
CACHE_ENTRIES = 50_000
#: Places for remembered pair tests per Python worker, a power of two; pairs of the long pre-tokens that are remembered.
MEMO_BITS, MEMO_PAIRS = 19, 50_000
#: Texts of so many characters together are encoded as a group, and so many chunks of a longer text.
GROUP_CHARS, GROUP_CHUNKS = 1_000_000, 200_000
#: Bytes of pre-tokens (the longest one's times their number) that are walked over at a time.
WALKED = 1 << 20
#: Stands for the start of a pre-token where a token before it is asked for.
START = -1
#: A pair of tokens as one number.
PAIR = 20
#: Chunks longer than this are encoded without being cached.
CACHE_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The letters in which a byte-level vocabulary writes bytes: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))})
    return letters


def read_text(spark: SparkSession, path: str) -> str:
    """Read a tokenizer's JSON file with Spark."""
    local = path if "://" in path else f"file://{path}"
    return spark.read.text(local, wholetext=True).first()[0]


def vocabulary_of(text: str) -> dict:
    """A tokenizer's JSON text as {ids: [(bytes, id)], merges: [(left, right, id)], special: {text: id}}."""
    data = json.loads(text)
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    vocab = data["model"]["vocab"]
    added = data["added_tokens"]
    if odd := [x["content"] for x in added if x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")]:
        raise ValueError(f"added tokens that take blanks or whole words, or are matched after normalising, are not supported: {odd}")
    merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    return {
        "ids": [(raw(token), i) for token, i in vocab.items()],
        "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges],
        "special": {x["content"]: x["id"] for x in added},
    }


class SuffixAutomaton:
    """Suffix automaton of all vocabulary entries; ``ending`` lists the entries that end in a state."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        for entry, _ in entries:
            last = 0
            for byte in entry:
                last = self._extend(last, byte)
        own: dict[int, list[tuple[int, int]]] = {}
        for entry, token in entries:
            state = 0
            for byte in entry:
                state = self.next[state][byte]
            own.setdefault(state, []).append((len(entry), token))
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            self.ending[state] = (*sorted(own.get(state, ()), reverse=True), *self.ending[self.link[state]])

    def _extend(self, last: int, byte: int) -> int:
        if (q := self.next[last].get(byte)) is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, byte, q)
        new = self._add({}, self.size[last] + 1, 0)
        p = last
        while p >= 0 and byte not in self.next[p]:
            self.next[p][byte] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][byte]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, byte, q)
        return new

    def _split(self, p: int, byte: int, q: int) -> int:
        clone = self._add(dict(self.next[q]), self.size[p] + 1, self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(byte) == q:
            self.next[p][byte] = clone
            p = self.link[p]
        return clone

    def _add(self, edges: dict[int, int], size: int, link: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        return len(self.next) - 1


class Recent:
    """Results of a function, kept in two generations; a generation of CACHE_ENTRIES or more gets old with the next group."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def rest(self) -> None:
        """Give up all, as a task does at its end: its Python worker goes on to other work."""
        self.young, self.old = {}, {}

    def turn(self) -> None:
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}

    def missing(self, texts: set[str]) -> set[str]:
        return texts.difference(self.young, self.old)

    def recall(self, text: str):
        got = self.young.get(text)
        if got is None:
            got = self.old.get(text)
            if got is None:
                got = self.make(text)
            if len(text) <= CACHE_CHARS:
                if len(self.young) >= 4 * CACHE_ENTRIES:
                    self.turn()
                self.young[text] = got
        return got


class Decoder:
    """Bytes of each id; needs no more than the vocabulary's size."""

    def __init__(self, vocabulary: dict):
        self.text_ids = {str(i): b for b, i in vocabulary["ids"]} | {str(i): s.encode() for s, i in vocabulary["special"].items()}

    def decode(self, ids: str) -> str:
        return b"".join(map(self.text_ids.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


class Encoder:
    """Exact byte-level BPE of one vocabulary; token ids after the single bytes rise in the order of the merges."""

    def __init__(self, vocabulary: dict):
        self.special = {s: str(i) for s, i in vocabulary["special"].items()}
        self.find = regex.compile(PATTERN).findall
        self.blank_runs = regex.compile(r"\s{3,}|\s{2,}\Z").finditer
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.words, self.chunks = Recent(self._word), Recent(lambda x: self.chunk(" " + x))
        self.tokens = {entry: str(token) for entry, token in vocabulary["ids"]}
        n = max(token for _, token in vocabulary["ids"]) + 1
        self.names = [""] * n
        for name in self.tokens.values():
            self.names[int(name)] = name
        self._automaton(vocabulary["ids"], n)
        merges = np.array(vocabulary["merges"], np.int64).reshape(-1, 3)
        keys = merges[:, 0] << PAIR | merges[:, 1]
        self.rank = np.argsort(keys)
        self.pairs = keys[self.rank]
        # of each token the last merge that makes it (-1: none), and what that one joins
        self.made, self.left, self.right = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.made[merges[:, 2]], self.left[merges[:, 2]], self.right[merges[:, 2]] = np.arange(len(merges)), merges[:, 0], merges[:, 1]
        self.memo = np.full(1 << MEMO_BITS, -1)
        self.known: dict[int, bool] = {}

    def _automaton(self, entries: list[tuple[bytes, int]], n: int) -> None:
        """Edges (sorted by state and byte), links and sizes of states, the longest token that ends in each, and for each token the next shorter one that ends it."""
        built = SuffixAutomaton(entries)
        keys = np.array([state << 8 | byte for state, edges in enumerate(built.next) for byte in edges])
        order = np.argsort(keys)
        self.edges, self.to = keys[order], np.array([to for edges in built.next for to in edges.values()])[order]
        self.link, self.size = np.array(built.link), np.array(built.size)
        self.longest, self.shorter, self.lengths = np.full(len(built.next), START), np.full(n, START), np.zeros(n, np.int64)
        for state, ending in enumerate(built.ending):
            for (_, token), (_, after) in zip(ending, ending[1:]):
                self.shorter[token] = after
            if ending:
                self.longest[state] = ending[0][1]
        for entry, token in entries:
            self.lengths[token] = len(entry)

    def stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves ``left`` and ``right`` side by side when given their joined bytes, for many pairs.

        Undo merges on either side, the later one first; if the two pieces that touch can merge, and that merge
        comes before (or, against the left side's, no later than) the undone merge that used one of them, BPE would have taken it.
        """
        never = 1 << 60
        out, live, a, b = np.ones(len(left), bool), np.arange(len(left)), left, right
        used_left = used_right = np.full(len(left), never)
        while len(live):
            key = a << PAIR | b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            k = np.where(self.pairs[at] == key, self.rank[at], never)
            merged = (k < used_left) & (k <= used_right) & (k < never)
            out[live[merged]] = False
            ka, kb = self.made[a], self.made[b]
            on = ~merged & ((ka >= 0) | (kb >= 0))
            first = ka >= kb
            used_left, used_right = np.where(first, ka, used_left)[on], np.where(first, used_right, kb)[on]
            a, b, live = np.where(first, self.right[a], a)[on], np.where(first, b, self.left[b])[on], live[on]
        return out

    def follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may come after the one before it; anything may begin a pre-token. Tests are remembered, one in a place."""
        key = before << PAIR | token
        at = ((key * 0x1E3779B97F4A7C15) >> (64 - MEMO_BITS)) & ((1 << MEMO_BITS) - 1)
        kept = self.memo[at]
        out = (kept & 1).astype(bool) | (before == START)
        new = np.flatnonzero((kept >> 1 != key) & (before != START))
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            stands = self.stand(asked >> PAIR, asked & ((1 << PAIR) - 1))
            out[new] = stands[back]
            self.memo[at[new]] = key[new] << 1 | out[new]
        return out

    def pretokens(self, words: list[bytes]) -> Iterator[str]:
        """Decimal ids, joined by commas, of each pre-token; those of alike length are walked over together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        out, start = [""] * len(words), 0
        while start < len(order):
            some = order[start : start + max(WALKED // int(lengths[order[start]]), 1)]
            for i, ids in zip(some.tolist(), self._walk([words[i] for i in some.tolist()], lengths[some]), strict=True):
                out[i] = ids
            start += len(some)
        return iter(out)

    def _walk(self, words: list[bytes], lengths: np.ndarray) -> list[str]:
        """The last token of each prefix of the words, which come in falling order of their lengths; then the way back from their ends."""
        n, most = len(words), int(lengths[0])
        data = np.zeros((n, most), np.uint8)
        data[np.arange(most) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        data = np.ascontiguousarray(data.T)
        last = np.full((most + 1, n), START, np.int32)
        flat = last.ravel()
        state, matched = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends = np.searchsorted(-lengths, -np.arange(most + 1), side="right")  # so many words have this length at least
        for end in range(1, most + 1):
            m = int(ends[end])
            state, matched, byte = state[:m], matched[:m], data[end - 1, :m]
            at, lost = self._edge(state, byte)
            while len(lost):
                state[lost] = self.link[state[lost]]
                matched[lost] = self.size[state[lost]]
                at[lost], still = self._edge(state[lost], byte[lost])
                lost = lost[still]
            state = self.to[at]
            matched = matched + 1
            token = self.longest[state]
            long = np.flatnonzero(self.lengths[token] > matched)
            while len(long):
                token[long] = self.shorter[token[long]]
                long = long[self.lengths[token[long]] > matched[long]]
            live = np.arange(m)
            while len(live):
                asked = token[live]
                before = flat[(end - self.lengths[asked]) * n + live].astype(np.int64)
                live = live[~self.follow(before, asked) & (self.shorter[asked] != START)]
                token[live] = self.shorter[token[live]]
            last[end, :m] = token
        back, live, end = [], np.arange(n), lengths.copy()
        while len(live):
            token = flat[end * n + live]
            back.append((live, token))
            end -= self.lengths[token]
            live, end = live[end > 0], end[end > 0]
        of = np.concatenate([x for x, _ in back[::-1]])
        ids = np.concatenate([x for _, x in back[::-1]])[np.argsort(of, kind="stable")]
        names = list(map(self.names.__getitem__, ids.tolist()))
        stops = np.cumsum(np.bincount(of, minlength=n)).tolist()
        return [",".join(names[a:b]) for a, b in zip([0, *stops], stops)]

    def _edge(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the edges by these bytes, and which there are none of."""
        key = state << 8 | byte
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return at, np.flatnonzero(self.edges[at] != key)

    def stands(self, left: int, right: int) -> bool:
        """stand() of one pair, remembered."""
        key = left << PAIR | right
        if (got := self.known.get(key)) is None:
            if len(self.known) >= MEMO_PAIRS:
                self.known.clear()
            got = self.known[key] = bool(self.stand(np.array([left]), np.array([right]))[0])
        return got

    def pretoken(self, data: bytes) -> str:
        """Decimal ids of one pre-token, as pretokens() gives them of many."""
        edges, to, link, size, longest, shorter, lengths = map(memoryview, (self.edges, self.to, self.link, self.size, self.longest, self.shorter, self.lengths))
        last, state, matched = [START], 0, 0  # the last token of each prefix
        for end, byte in enumerate(data, 1):
            while (at := bisect_left(edges, state << 8 | byte)) == len(edges) or edges[at] != state << 8 | byte:
                state = link[state]
                matched = size[state]
            state = to[at]
            matched += 1
            token = longest[state]
            while lengths[token] > matched or ((before := last[end - lengths[token]]) != START and shorter[token] != START and not self.stands(before, token)):
                token = shorter[token]
            last.append(token)
        out, end = [], len(data)
        while end:
            out.append(self.names[last[end]])
            end -= lengths[last[end]]
        return ",".join(reversed(out))

    def prepare(self, chunks: set[str]) -> None:
        """Have the ids of chunks (without the blank before them) and of their pre-tokens at hand."""
        self.words.turn()
        self.chunks.turn()
        parts = {x: self.find(" " + x) for x in self.chunks.missing(chunks)}
        wanted = self.words.missing({w for x in parts.values() for w in x if len(w) <= CACHE_CHARS})
        data = {w: w.encode("utf-8", "surrogatepass") for w in wanted}
        whole = {w: name for w, b in data.items() if (name := self.tokens.get(b)) is not None}  # its longest match is all of it, and any token may begin a pre-token
        rest = [w for w in data if w not in whole]
        self.words.young.update(whole)
        self.words.young.update(zip(rest, self.pretokens([data[w] for w in rest]), strict=True))
        recall = self.words.recall
        self.chunks.young.update((x, ",".join([recall(w) for w in ws])) for x, ws in parts.items() if len(x) <= CACHE_CHARS)

    def rest(self) -> None:
        self.words.rest()
        self.chunks.rest()

    def chunk(self, text: str) -> str:
        """Decimal ids, joined by commas, of a chunk of text that is pre-tokenized on its own."""
        parts = self.find(text)
        recall = self.words.recall
        return ",".join([recall(x) for x in parts])

    def _word(self, text: str) -> str:
        data = text.encode("utf-8", "surrogatepass")
        return self.tokens.get(data) or self.pretoken(data)

    def _words(self, text: str, out: list[str]) -> None:
        """Ids of a text without long blank runs; any of its single blanks begins a pre-token, so it is cut there."""
        first, *rest = text.split(" ")
        recall, at_hand = self.chunks.recall, self.chunks.young.get
        if first:
            out.append(self.chunk(first))
        if len(text) > GROUP_CHARS:
            for start in range(0, len(rest), GROUP_CHUNKS):
                some = rest[start : start + GROUP_CHUNKS]
                self.prepare(set(some))
                out += map(recall, some)
            return
        out += [at_hand(x) or recall(x) for x in rest]

    def _plain(self, text: str, out: list[str]) -> None:
        """A run of three blanks or more (two at the end) is a pre-token but for its last blank, which belongs to what follows."""
        last = 0
        for run in self.blank_runs(text):
            start, end = run.span()
            if start > last:
                self._words(text[last:start], out)
            if end == len(text):
                out.append(self.words.recall(run.group()))
                return
            out.append(self.words.recall(run.group()[:-1]))
            last = end - 1
        self._words(text[last:] if last else text, out)

    def pieces(self, text: str | None) -> list[str]:
        """Decimal ids, joined by commas within a piece of the text."""
        out: list[str] = []
        if not text:
            return out
        if self.cut is None or not any(s in text for s in self.special):
            self._plain(text, out)
            return out
        for x in self.cut(text):
            if x in self.special:
                out.append(self.special[x])
            elif x:
                self._plain(x, out)
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[str]:
        """Decimal ids joined by commas of each text."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str | None]) -> Iterator[str]:
        chunks: set[str] = set()
        for text in texts:
            if text and len(text) <= GROUP_CHARS:
                chunks.update(text.split(" "))
        self.prepare(chunks)
        for text in texts:
            yield ",".join(self.pieces(text))


_kept: dict[tuple, Encoder | Decoder] = {}


def _once(kind: type, key: str, shared):
    """One encoder or decoder for a vocabulary in each Python worker."""
    if (kind, key) not in _kept:
        _kept[kind, key] = kind(vocabulary_of(shared.value))
    return _kept[kind, key]


class Tokenizer:
    """Column functions for one vocabulary file; its text is broadcast, as that is far smaller than what is made from it."""

    def __init__(self, spark: SparkSession, path: str):
        text = read_text(spark, path)
        vocabulary_of(text)  # refuses what is not supported
        self.key, self.shared = path, spark.sparkContext.broadcast(text)

    def encode(self, text: Column) -> Column:
        """Decimal ids joined by commas ('' for null and empty texts)."""
        key, shared = self.key, self.shared

        @F.pandas_udf("string")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = _once(Encoder, key, shared)
            for batch in batches:
                yield pd.Series(list(encoder.encode(batch)), dtype=object)
            encoder.rest()

        return encode(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        key, shared = self.key, self.shared

        @F.pandas_udf("string")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            decoder = _once(Decoder, key, shared)
            for batch in batches:
                yield pd.Series([decoder.decode(x) for x in batch], dtype=object)

        return decode(F.coalesce(ids, F.lit("")))

    def digests(self, text: Column) -> Column:
        """Struct of n_tokens, ids_sha256 and decoded_sha256: what encode() and then decode() give, digested where they are made, so that only digests move."""
        key, shared = self.key, self.shared
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()

        @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encoder, decoder = _once(Encoder, key, shared), _once(Decoder, key, shared)
            for batch in batches:
                rows = [(ids.count(",") + 1 if ids else 0, digest(ids), digest(decoder.decode(ids))) for ids in encoder.encode(batch)]
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            encoder.rest()

        return of(F.coalesce(text, F.lit("")))


def report(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded text)."""
    return docs.select("doc_id", tokenizer.digests(F.col("text")).alias("_got")).select("doc_id", "_got.*")
