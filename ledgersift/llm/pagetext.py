"""Main text of web pages, by what repeats over the pages of a host.

A page is a list of blocks. Blocks of an article (or main) element are its text. All others form the page's stream: the words of each block
behind a mark for its element, the article a break that nothing equals. The distinct streams of a host are concatenated into a suffix array;
substrings of LONG tokens or more that stand on two pages or more are boilerplate, and blocks that they cover go. Blocks that are left are
unique runs: they stay, unless their markup names them as menus, adverts and the like.

A host with more tokens than a task should hold is dealt over parts by the hash of the stream. Each part has a suffix array of its own and
tells on how many pages each of its groups of suffixes stands; these are added up over the parts, so the result is that of one array.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgersift.llm.common import join_groups, mix, store

#: Least length of a repeated substring, in words and marks of blocks.
LONG = 5
#: Tokens of distinct streams that a task sorts at a time.
PART_TOKENS = 1 << 19

# Elements by what they hold. The last three lists are names of roles in class, id and role attributes.
WORDLESS = "script style noscript template iframe object embed svg math canvas audio video title textarea select option datalist button head".split()
FURNITURE = "nav footer aside form menu dialog fieldset".split()
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Open elements that the start of another one closes.
_CLOSED_BY = {x: {"p"} for x in BLOCKS + ["head"]} | {"li": {"p", "li"}, "dd": {"p", "dd", "dt"}, "dt": {"p", "dd", "dt"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tr": {"p", "td", "th", "tr"}}
NAMED = set(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "subscription signup popup modal overlay sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer masthead comment comments commentlist "
    "disqus respond reply replies share sharing social search login contentinfo complementary dialog".split()
)
#: Names that count outside an article only, where they may be its own parts.
NAMED_OUTSIDE = {"header", "banner", "alert", "notice"}

_RAW = "|".join(x for x in WORDLESS if x not in ("embed", "head", "option"))
_PIECES = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*?(?:/>|>(?:.*?</(?P=raw)\s*>|.*))|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:_-]*)(?P<rest>(?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ROLES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MAIN, OPEN, MARKED = "m", "o", "f"
#: Elements around whole pages at times, or left open: an article within them is one all the same.
_WEAK, WEAK = {"form", "nav", "menu", "header"}, "w"


def _marked(name: str, rest: str, inside: bool) -> bool:
    if name in FURNITURE or (name == "header" and not inside):
        return True
    if not rest:
        return False
    if _HIDDEN.search(rest):
        return True
    names = {x.lower() for m in _ROLES.finditer(rest) for x in _NAMES.findall(m[2] or m[3] or m[4] or "")}
    return bool(names & (NAMED if not inside else NAMED - NAMED_OUTSIDE)) or (not inside and "header" in names)


def blocks(html: str | None) -> list[tuple[str, str, str]]:
    """(element, kind, text) of the blocks of a page in order; kinds are MAIN, OPEN and MARKED by their elements. White space is one space."""
    found: list[tuple[str, str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str]] = [("", OPEN)]
    at, html = 0, html or ""

    def end() -> None:
        if text:
            words = " ".join(unescape("".join(text)).split())
            text.clear()
            if words:
                found.append((stack[-1][0], MARKED if stack[-1][1] == WEAK else stack[-1][1], words))

    for m in _PIECES.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if name == "br":
            text.append(" ")
        if name not in _CLOSED_BY:
            continue
        end()
        if m["close"]:
            if any(name == x for x, _ in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        while stack[-1][0] in _CLOSED_BY[name]:
            stack.pop()
        if name in VOID:
            continue
        kind = stack[-1][1]
        if kind != MARKED:
            if name == "head" or _marked(name, m["rest"], kind == MAIN):
                kind = WEAK if name in _WEAK and kind != MAIN else MARKED
            elif name in ("article", "main"):
                kind = MAIN
        stack.append((name, kind))
    text.append(html[at:])
    end()
    return found


def host_of(url: str | None) -> str:
    """The host in a url, in lower case and without user and port; empty for null or where there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, stream, rest, tokens, elements, kinds, texts) of rows (page_id, url, html).

    stream and rest are hashes of what is outside and inside the article; elements, kinds and texts are those of the blocks,
    neighbouring ones of the article joined by line feeds.
    """
    kinds = [("page_id", to_arrow_type(pages.schema["page_id"].dataType)), ("url", pa.string()), ("host", pa.string()), ("stream", pa.string()), ("rest", pa.string()), ("tokens", pa.int64())]
    schema = pa.schema([*kinds, ("elements", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(at, 256), []
                for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    got, outside, inside, tokens = [], hashlib.md5(), hashlib.md5(), 0
                    for element, kind, text in blocks(html):
                        if kind == MAIN and got and got[-1][1] == MAIN:
                            got[-1][2] += "\n" + text
                        else:
                            got.append(["" if kind == MAIN else element, kind, text])
                            tokens += 1 if kind == MAIN else 2 + text.count(" ")
                    for element, kind, text in got:
                        (inside if kind == MAIN else outside).update(f"{text}\0".encode("utf-8", "surrogatepass"))
                        outside.update(f"{kind}{element}\n".encode())
                    items = {"elements": [b[0] for b in got], "kinds": [b[1] for b in got], "texts": [b[2] for b in got]}
                    rows.append({"page_id": page, "url": url, "host": host_of(url), "stream": outside.hexdigest(), "rest": inside.hexdigest(), "tokens": tokens, **items})
                yield pa.RecordBatch.from_pylist(rows, schema)

    text = "page_id {}, url string, host string, stream string, rest string, tokens long, elements array<string>, kinds array<string>, texts array<string>"
    return pages.mapInArrow(run, text.format(pages.schema["page_id"].dataType.simpleString()))


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, by prefix doubling, and the common length of each with the one before it; equal numbers are equal tokens."""
    n = len(tokens)
    ranks, step = [np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1], 1
    while step < n and ranks[-1].max(initial=0) < n:
        then = np.zeros(n, np.int64)
        then[: n - step] = ranks[-1][step:]
        ranks.append(np.unique(ranks[-1] * (n + 1) + then, return_inverse=True)[1].astype(np.int64) + 1)
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
        a[same] += 1 << k
        b[same] += 1 << k
        common[1:][same] += 1 << k
    return order, np.minimum(common, n - np.maximum(order, np.r_[0, order[:-1]]))


class Streams:
    """The streams of a part of a host, concatenated: hashes of tokens, a number of its own for each break, the stream of each token, the block of each word."""

    def __init__(self, pdf: pd.DataFrame):
        tokens, stream, block, breaks = [], [], [], 0
        self.weight = pdf["pages"].to_numpy(np.int64)
        for s, (elements, kinds, texts) in enumerate(zip(pdf["elements"], pdf["kinds"], pdf["texts"], strict=True)):
            for i, kind in enumerate(kinds):
                if kind == MAIN:
                    new = [None]
                else:
                    new = ["<" + elements[i], *texts[i].split(" ")]
                tokens += new
                stream += [s] * len(new)
                block += [-1] + [i] * (len(new) - 1)
            tokens.append(None)
            stream.append(s)
            block.append(-1)
        known: dict[str, int] = {}
        codes = np.empty(len(tokens), np.uint64)
        for i, t in enumerate(tokens):
            if t is None:
                breaks += 1
                codes[i] = xxhash.xxh3_64_intdigest(f"\0{breaks}")
            elif (h := known.get(t)) is None:
                codes[i] = known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
            else:
                codes[i] = h
        self.codes, self.stream, self.block = codes, np.array(stream, np.int64), np.array(block, np.int64)
        # places from which LONG tokens without a break go on
        broken = np.r_[0, np.cumsum([t is None for t in tokens])]
        self.whole = np.flatnonzero(broken[LONG:] == broken[: len(broken) - LONG]) if len(broken) > LONG else np.zeros(0, np.int64)

    def keys(self, at: np.ndarray) -> list[str]:
        """128-bit hashes of the LONG tokens from each place."""
        high, low = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for i in range(LONG):
            t = self.codes[at + i]
            high, low = mix(high * np.uint64(3) + t), mix(low * np.uint64(5) + mix(t))
        return [f"{a:016x}{b:016x}" for a, b in zip(high.tolist(), low.tolist(), strict=True)]

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(first place, pages) of each group of suffixes with LONG or more common tokens, and of the single ones."""
        order, common = suffix_array(self.codes)
        fits = np.zeros(len(self.codes), bool)
        fits[self.whole] = True
        order, common = order[fits[order]], common[fits[order]]
        group = np.cumsum(common < LONG) if len(order) else order
        pair = np.unique(np.stack([group, self.stream[order]]), axis=1) if len(order) else np.zeros((2, 0), np.int64)
        first = np.r_[True, group[1:] != group[:-1]] if len(order) else np.zeros(0, bool)
        pages = np.bincount(pair[0], self.weight[pair[1]]).astype(np.int64)[group[first]] if len(order) else order
        return order[first], pages


def _frame(**columns) -> pd.DataFrame:
    """Columns of plain Python values, as Arrow takes them whatever the strings' own kind of column."""
    return pd.DataFrame({name: pd.Series(list(values), dtype=object) for name, values in columns.items()})


def _found(pdf: pd.DataFrame) -> pd.DataFrame:
    """On how many pages of a part its groups of suffixes stand; where the host has no other part, only what stands on two or more."""
    s = Streams(pdf)
    at, pages = s.repeated()
    if pdf["parts"].iat[0] == 1:
        at, pages = at[pages > 1], pages[pages > 1]
    return _frame(host=[pdf["host"].iat[0]] * len(at), part=[int(pdf["part"].iat[0])] * len(at), key=s.keys(at), pages=pages.tolist())


def _covered(pdf: pd.DataFrame, boilerplate: pd.DataFrame) -> pd.DataFrame:
    """(host, stream, keep, repeated): for each block whether it stays, and how many words repeated substrings cover."""
    if not len(pdf):
        return _frame(host=[], stream=[], keep=[], repeated=[])
    s = Streams(pdf)
    at = s.whole
    hit = np.isin(np.array(s.keys(at), object).astype("U32"), np.array(list(boilerplate["key"]), object).astype("U32")) if len(boilerplate) and len(at) else np.zeros(len(at), bool)
    ends = np.zeros(len(s.codes) + 1, np.int64)
    np.add.at(ends, at[hit], 1)
    np.add.at(ends, at[hit] + LONG, -1)
    cover, rows = np.cumsum(ends[:-1]) > 0, []
    words = s.block >= 0
    bounds = np.searchsorted(s.stream, np.arange(len(pdf) + 1))
    for i, kinds in enumerate(pdf["kinds"]):
        here = slice(bounds[i], bounds[i + 1])
        block, mask = s.block[here][words[here]], cover[here][words[here]]
        total, gone = np.bincount(block, minlength=len(kinds)), np.bincount(block, mask, minlength=len(kinds))
        keep = [kind == OPEN and bool(2 * gone[k] < total[k]) for k, kind in enumerate(kinds)]
        rows.append((pdf["host"].iat[i], pdf["stream"].iat[i], keep, int(mask.sum())))
    return _frame(**dict(zip(("host", "stream", "keep", "repeated"), zip(*rows), strict=True)))


def report(pages: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated of rows (page_id, url, html); n_repeated: words outside the article that repeated substrings cover.

    Null and empty html give an empty text. Pages without a host are one host. Pages that are equal in all their words count once for what is
    repeated, so copies of a page don't remove each other's text. Where an element is not closed, the end of the one around it closes it.
    """
    rows = store(parsed(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))))
    once = rows.groupBy("host", "stream", "rest").agg(F.count("*").alias("n"))
    groups = once.groupBy("host", "stream").agg(F.count("*").alias("pages"), F.sum("n").alias("rows"))
    # of each stream one row tells its blocks; the article's words are left out
    main = lambda i: F.get("kinds", i) == MAIN
    slim = F.transform("texts", lambda t, i: F.when(~main(i), t).otherwise(""))
    streams = rows.select("host", "stream", "tokens", "elements", "kinds", slim.alias("texts")).dropDuplicates(["host", "stream"]).join(groups, ["host", "stream"])
    parts = F.ceil(F.sum("tokens") / part_tokens).cast("int")
    hosts = streams.groupBy("host").agg(F.greatest(parts, F.lit(1)).alias("parts"))
    dealt = store(streams.join(hosts, "host").withColumn("part", F.pmod(F.xxhash64("stream"), F.col("parts")).cast("int")))
    found = dealt.groupBy("host", "part").applyInPandas(_found, "host string, part int, key string, pages long")
    # a key has a row for each part that holds it
    boilerplate = store(found.withColumn("pages", F.sum("pages").over(Window.partitionBy("host", "key"))).filter("pages > 1").select("host", "part", "key"))
    result = "host string, stream string, keep array<boolean>, repeated long"
    kept = dealt.groupBy("host", "part").cogroup(boilerplate.groupBy("host", "part")).applyInPandas(_covered, result)
    kept = store(kept.join(groups.select("host", "stream", "rows"), ["host", "stream"]))
    both = join_groups(rows.select("page_id", "url", "host", "stream", "kinds", "texts"), kept, ["host", "stream"], "rows")
    stay = F.filter("texts", lambda _, i: main(i) | F.coalesce(F.get("keep", i), F.lit(False)))
    text = both.withColumn("text", F.array_join(stay, "\n"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.col("repeated").alias("n_repeated"))
