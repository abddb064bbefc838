"""Conversation repair, page text and vector codes against brute force, on odd rows and over many parts."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgersift.llm import conversations as conv
from ledgersift.llm import common, linededup, pagetext, substring, vectorcodes

ROWS = "conv_id long, turn long, role string, text string"


def cheapest(symbols):
    """Dijkstra over (rows done, state), by cost and audit."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(symbols) and q in (0, 3):
            return cost, audit
        if (i, q) in seen:
            continue
        seen.add((i, q))
        heapq.heappush(heap, (cost + 3, audit + "I", i, 3 if q == 2 else 2))
        if i < len(symbols):
            initial, fault = symbols[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if fault not in "bd":
                more = 3 * (fault == "t")
                if to := {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, initial)):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, 3 if q == 2 else 2))


def brute_repair(rows):
    """The contract's columns by conversation, for rows after damage (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, symbols, counts = set(), [], {"b": 0, "d": 0, "t": 0, "f": 0}
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "f" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        counts[fault] += 1
        symbols.append((role[:1], fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
    cost, audit = cheapest(symbols)
    at, state, out = iter(rows), 0, []
    for edit in audit:
        if edit == "I":
            state, role, text = (3, "assistant", "") if state == 2 else (2, "user", "")
        else:
            _, role, text = next(at)
            if edit == "D":
                continue
            new = 3 if state == 2 else 1 if edit == "K" and role[:1] == "s" else 2
            role = role if edit == "K" else "assistant" if state == 2 else "user"
            state = new
        out.append(f"{role}:{text}")
    return gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damaged(rows):
    found = {}
    for c, t, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        role, text = "user" if k == 4 else space(role), "" if k == 1 else space(text)
        text = "".join(x for x in text if x not in ".!?") if k == 2 else text
        found.setdefault(c, []).extend([(t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    return found


def compare(got, rows):
    expected = {c: brute_repair(x) for c, x in damaged(rows).items()}
    assert len(got) == len(expected)
    for r in got:
        assert tuple(r[c] for c in conv.RESULT) == expected[r["conv_id"]], r["conv_id"]


def talk(r, n):
    roles = ["user", "assistant", "system", "tool", "", None, "u", "Assistant"]
    texts = ["", " \t", None, "Yes.", "No", "a b!", "é?", "x\ny. ", "end\x85"]
    return [(r.choice(roles[: r.choice([2, 8])]), r.choice(texts + [f"t{i}."])) for i in range(n)]


def test_runs_and_powers_give_the_cheapest_least_audit():
    r = random.Random(3)
    for _ in range(300):
        runs = []
        for _ in range(r.randint(0, 5)):
            symbol = (r.choice(["s", "u", "a", ""]), r.choice("fffbdt"))
            if not runs or runs[-1][0] != symbol:
                runs.append((symbol, r.choice([1, 1, 2, 3])))
        assert (conv._cost(runs), conv.edits(runs)[0]) == cheapest([s for s, n in runs for _ in range(n)])
    letters, state = conv.edits([(("u", "f"), 1 << 20)])
    assert len(letters) >= 1 << 20 and state == 3


def test_repair_on_odd_rows_ties_and_nulls(spark):
    r, rows = random.Random(4), []
    for c in [None, *range(60)]:
        for i, (role, text) in enumerate(talk(r, r.randint(1, 12))):
            rows.append((c, r.choice([None, i, i, r.randint(0, 5)]), role, text))
    frame = spark.createDataFrame(rows, ROWS)
    for name in ("n", "part", "first", "_h", "copies", "fault"):
        frame = frame.withColumn(name, F.lit("clash"))
    compare(conv.report(conv.damage(frame)).collect(), rows)
    assert conv.report(conv.damage(frame.limit(0))).collect() == []
    only = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    gone = conv.report(conv.damage(spark.createDataFrame([(only, 0, "user", "x")], ROWS))).first()
    assert tuple(gone) == (only, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_conversation_over_many_tasks_is_repaired_as_one(spark):
    r = random.Random(5)
    rows = [(7, i, role, text) for i, (role, text) in enumerate(talk(r, 900))] + [(c, i, role, text) for c in (1, 9) for i, (role, text) in enumerate(talk(r, 20))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, ROWS)
        assert conv.marked(conv.damage(frame)).filter("conv_id = 7").select("part").distinct().count() > 5
        compare(conv.report(conv.damage(frame)).collect(), rows)
        fixed = conv.repair(conv.plain(frame)).orderBy("part", "place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for c in (1, 7, 9):
        roles = "".join(x["role"][:1] for x in fixed if x["conv_id"] == c).removeprefix("s")
        assert roles == "ua" * (len(roles) // 2)


def brute_codes(rows):
    """The contract by plain loops over (vec_id, vector, label)."""
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: r[0])
    v = np.floor(256 * np.array([np.float32(r[1]) for r in rows], np.float64)).astype(np.int64).reshape(len(rows), 16, -1)
    books = v[:64].transpose(1, 0, 2).copy()
    for turn in range(3):
        far = ((v.transpose(1, 0, 2)[:, :, None, :] - books[:, None]) ** 2).sum(3)
        code = far.argmin(2)
        if turn < 2:
            for part in range(16):
                for e in set(code[part]):
                    mine = v[code[part] == e, part]
                    books[part, e] = mine.sum(0) // len(mine)
    error = far.min(2).sum(0)
    by = {}
    for r, e in zip(rows, error, strict=True):
        by[r[2]] = by.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return [(r[0], "".join(f"{code[p, i]:02x}" for p in range(16)), int(error[i]), by[r[2]], digest) for i, r in enumerate(rows)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vector_codes_equal_brute_force(spark):
    r = np.random.default_rng(6)
    centres = r.normal(0, 0.3, (20, 32))
    rows = [(i, (centres[r.integers(20)] + r.normal(0, 0.05, 32)).astype(np.float32).tolist(), None if i % 7 == 0 else int(r.integers(3))) for i in range(700)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(300)]
    rows += [(2000, None, 1), (2001, [None] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [float("inf")] + [0.0] * 31, 1)]
    got = vectorcodes.report(spark.createDataFrame(rows, VECTORS).repartition(5).withColumn("code", F.lit("clash")).withColumn("_v", F.lit(1))).collect()
    assert sorted(map(tuple, got)) == brute_codes(rows)


def test_vector_codes_on_few_short_huge_and_no_rows(spark):
    few = [(i, [i / 9.0] * 16, i % 2) for i in range(9)]
    assert sorted(map(tuple, vectorcodes.report(spark.createDataFrame(few, VECTORS)).collect())) == brute_codes(few)
    assert vectorcodes.report(spark.createDataFrame([(1, None, 2)], VECTORS)).collect() == []
    mixed = [(1, [], 1), (2, [1.0] * 20, 1), (None, [1e30] * 16, None), (3, [0.5], 2), (3, [0.5], 2)]
    got = vectorcodes.report(spark.createDataFrame(mixed, VECTORS)).collect()
    assert len(got) == 5 and all(len(x["code"]) == 32 and x["error"] == 0 for x in got)


@pytest.mark.parametrize("scale", [1, 1 << 40])
def test_dual_trees_agree_with_all_distances(scale):
    r = np.random.default_rng(7)
    for n, k, width in ((1, 1, 3), (5, 3, 2), (500, 64, 4), (3000, 37, 1)):
        points = np.floor(r.normal(0, 9, (n, width))).astype(np.int64)
        points = points if scale == 1 else points.astype(object) * scale
        entries = points[:k].copy()
        far = ((points[:, None] - entries[None]) ** 2).sum(2)
        code, error = vectorcodes.codes(points, entries)
        assert (code == far.argmin(1)).all() and (error == far.min(1)).all()
        total, count = vectorcodes.sums(points, entries)
        assert all((points[code == e].sum(0) == total[e]).all() and (code == e).sum() == count[e] for e in range(k))


def test_suffix_array_and_common_lengths():
    r = random.Random(8)
    for _ in range(100):
        n = r.randint(0, 40)
        t = [r.randint(0, r.choice([1, 3, 9])) for _ in range(n)]
        order, common = pagetext.suffix_array(np.array(t, np.uint64))
        by = sorted(range(n), key=lambda i: t[i:])
        assert order.tolist() == by
        for k in range(1, n):
            a, b = t[by[k - 1] :], t[by[k] :]
            assert common[k] == next((m for m, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</article>";</script></head><body class="blog-page"><form id="f"><header><p>Site</p></header>
<nav><ul><li><a href="x">A<li>B</ul></nav><!-- <p>no --><div class="adBox">Buy</div><article class="post"><header><h1>Head &amp;amp; &#233;</h1></header><p><b>One\n two.<br>three<p>Fo<i>u</i>r
<aside>side</aside><div class="cookie-notice"><p>cookies</div><form><input>send</form><pre> a   b </pre><p title="a>b">last &lt;p&gt;<section id="comments"><article><p>me too</article></section></article></form><footer>&copy; f</footer>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_blocks_of_a_page():
    kept = [text for _, kind, text in pagetext.blocks(PAGE) if kind == pagetext.MAIN]
    assert kept == ["Head &amp; é", "One two. three", "Four", "a b", "last <p>"]
    assert all(kind == pagetext.MARKED for _, kind, _ in pagetext.blocks(PAGE) if kind != pagetext.MAIN)
    assert pagetext.blocks(None) == pagetext.blocks("") == pagetext.blocks("<p> </p><script>x") == []
    assert pagetext.blocks("a < b <p>c") == [("", "o", "a < b"), ("p", "o", "c")]
    assert len(pagetext.blocks("<p>x" * 20000)) == 20000 and pagetext.blocks('<a title="' + "<" * 20000) == []


@pytest.mark.parametrize("part_tokens", [pagetext.PART_TOKENS, 40])
def test_what_repeats_on_a_host_goes_and_unique_runs_stay(spark, part_tokens):
    """Pages without an article: known furniture on every third page, and texts of their own; also where a host is dealt over parts."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows, expected = [], {}
    for i in range(60):
        own = [" ".join(word() for _ in range(r.randint(1, 30))) for _ in range(3)]
        f = i % 20
        top, low = f"<div>our shop number {f} sells all you want</div>", f"<div>call us at {f} {f} {f} on any day of it</div>"
        rows.append((i, "https://User@Shop.example:80/x" if i % 2 else "http://shop.example/", f"<body>{top}<p>{own[0]}<p>{own[1]}</p>{low}<div>{own[2]}</div>"))
        expected[i] = "\n".join(own)
    rows += [(100, "http://other.example/", "<div>our shop number 1 sells all you want</div>"), (101, None, None), (102, "x", ""), (None, "http://copy.example/", PAGE), (104, "http://copy.example/", PAGE)]
    rows += [(105, "http://twin.example/", "<p>" + "the same words again " * 9)] * 2
    expected |= {100: "our shop number 1 sells all you want", 101: "", 102: "", 104: "Head &amp; é\nOne two. three\nFour\na b\nlast <p>", 105: ("the same words again " * 9).strip()}
    expected[None] = expected[104]
    got = pagetext.report(pages(spark, rows).withColumn("keep", F.lit(1)).withColumn("texts", F.lit("clash")), part_tokens).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["text"] == expected[x["page_id"]] and x["n_chars"] == len(x["text"]), x["page_id"]
    assert pagetext.report(pages(spark, [])).collect() == []


def test_words_that_polynomials_of_bytes_cannot_tell_apart(spark):
    """Two texts that differ in one word of 2,048 letters, a Thue-Morse run and its complement: nothing repeats."""
    run = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = run.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join([*words, x, *words]) for x in (run, other)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["n_removed"] for r in substring.report(docs).collect()} == {0: 0, 1: 0, 2: 61}
    long = [b"ab"[bin(i).count("1") & 1 :][:1] for i in range(4096)]
    a, b = (common.WordHasher([w.translate(t) for w in long]) for t in (bytes.maketrans(b"", b""), bytes.maketrans(b"ab", b"ba")))
    assert not (a.windows(50) == b.windows(50)).any() and a.runs(np.array([0]), np.array([60])) != b.runs(np.array([0]), np.array([60]))


def test_a_text_of_very_many_lines_loses_them_in_linear_time(spark):
    text = "\n".join(["the same line of some text", "", "other"] * 60000)
    docs = spark.createDataFrame([(0, text, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = linededup.dedup(docs).first().text.split("\n")
    assert got[:3] == ["the same line of some text", "", "other"] and set(got[3:]) == {""} and len(got) == 60002


@pytest.mark.parametrize("edits", [1, 2])
def test_the_band_decides_on_short_texts(spark, edits):
    """All pairs of short lines of two letters: within so many edits or not, as the full table of distances has it."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(11)
    pairs = [("".join(r.choices("ab", k=r.randint(0, 18))), "".join(r.choices("ab", k=r.randint(0, 18)))) for _ in range(500)]
    pairs += [(a, a[:i] + r.choice(["", "a", "ab"]) + a[i + r.randint(0, 2) :]) for a, _ in pairs for i in [r.randint(0, len(a))]]
    frame = spark.createDataFrame(pairs, "a string, b string").filter(F.abs(F.length("a") - F.length("b")) <= edits)
    for x in frame.select("a", "b", linededup.bounded_distance(F.col("a"), F.col("b"), edits).alias("d")).collect():
        true = distance(x.a, x.b)
        assert x.d == true if true <= edits else x.d > edits, (x.a, x.b)
