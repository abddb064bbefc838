"""Line dedup by a segment-partition edit join, in DataFrame operations.

Lines are cut into ``edits + 1`` even segments. Two lines within ``edits`` edits share a segment that the longer one has as
a substring near the same place; substrings are looked up by length, segment number and content. Candidates are verified by a
bit-parallel edit distance in a band of ``2 * edits + 1`` diagonals, held in one 64-bit word.

The first line of a class stays: a line goes if the same line stands earlier (smaller doc_id, then place), or if a line within
``edits`` edits of it does. Blank lines always stay. All other lines are compared for equality, whatever their length; lines under
``least`` characters are not compared with edits, as one edit makes too much of a short line. Null texts have no lines; null ids
come last; equal ids are ordered by a hash of their texts, and equal rows lose the same lines. Empty tables have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.common import HOT_PARTS, cut, join_salted, pack, store, unpack

EDITS, LEAST = 1, 20
#: Texts of fewer characters go through the band as they are; longer ones lose equal halves until they are as short.
WORD = 16


def lines_of(docs: DataFrame) -> DataFrame:
    """_id, _th (hash of the text, so that repeated ids are told apart), _at, _line of all lines."""
    base = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), F.split("text", "\n").alias("_lines"))
    return base.select("_id", "_th", F.posexplode("_lines").alias("_at", "_line"))


def _starts(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """(start, length) of the segments of a line, counted from 0; the last ones take the rest."""
    parts = edits + 1
    short, more = (length / parts).cast("int"), length % parts
    out, start = [], F.lit(0)
    for k in range(parts):
        size = short + F.when(F.lit(parts - 1 - k) < more, 1).otherwise(0)
        out.append((start, size))
        start = start + size
    return out


def segment_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """Keys of a line's own segments."""
    return [F.xxhash64(F.lit(k), length, F.substring(line, start + 1, size)) for k, (start, size) in enumerate(_starts(length, edits))]


def probe_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """Keys of the substrings that segments of a line up to ``edits`` shorter can be (those of an equally long one are its own, if not moved).

    Segment k begins at most k edits off its place, and what follows it leaves edits - k for the rest (multi-match-aware bounds).
    """
    keys = []
    for shorter in range(edits + 1):
        other = length - shorter
        for k, (start, size) in enumerate(_starts(other, edits)):
            for move in range(-edits, edits + 1):
                if (shorter or move) and max(-k, shorter - (edits - k)) <= move <= min(k, shorter + (edits - k)):
                    at = start + move
                    keys.append(F.when((at >= 0) & (at + size <= length), F.xxhash64(F.lit(k), other, F.substring(line, at + 1, size))))
    return keys


def _core(a: Column, b: Column) -> Column:
    """(x, y): what is left once equal halves (of the shorter text) at either end are gone, again and again down to WORD characters; the distance stays the same."""

    def cut(s: Column, _) -> Column:
        x, y = s["x"], s["y"]
        half = F.floor(F.least(F.length(x), F.length(y)) / 2).cast("int")
        return F.when(half < WORD / 2, s).when(F.left(x, half) == F.left(y, half), F.struct(F.substring(x, half + 1, F.length(x)).alias("x"), F.substring(y, half + 1, F.length(y)).alias("y"))).when(
            F.right(x, half) == F.right(y, half), F.struct(F.left(x, F.length(x) - half).alias("x"), F.left(y, F.length(y) - half).alias("y"))
        ).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(a.alias("x"), b.alias("y")), cut)


def bounded_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two texts whose lengths differ by ``edits`` at most; exact up to ``edits``, else some larger number.

    Equal halves are taken off long texts first. Then one pass over the characters of b keeps, for each of the 2 * edits + 1 diagonals
    around it, whether the distance rises (p) or falls (n) downwards, as bits of one word that moves down a diagonal.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, width - 1
    # equal ends change no distance, and with them no text is shorter than the band
    chars = lambda x: F.filter(F.split(F.concat(x, F.lit(" " * edits)), ""), lambda c: c != "")
    gap = F.array_repeat(F.lit(None).cast("string"), edits)

    def step(s: Column, c: Column) -> Column:
        eq = F.lit(0)
        for i in range(width):
            eq = eq.bitwiseOR(F.when(F.get(s["w"], s["j"] + i).eqNullSafe(c), 1 << i).otherwise(0))
        bound = F.struct(eq.alias("q"), *[s[k].alias(k) for k in "pnjewt"])
        for f in (_diagonal(full), _horizontal(full), _vertical(full, top)):
            bound = F.get(F.transform(F.array(bound), f), F.lit(0))
        return bound

    def run(t: Column) -> Column:
        # t: columns after which the tracked cell has come to the last row
        start = F.struct(F.lit(full & ~((1 << edits) - 1)).alias("p"), F.lit(0).alias("n"), F.lit(0).alias("j"), F.lit(edits).alias("e"), F.concat(gap, t["a"], gap).alias("w"), (F.size(t["a"]) - edits).alias("t"))
        distance = F.aggregate(t["b"], start, step, lambda s: s["e"])
        if edits > 1:
            return distance
        # one edit leaves one of two halves equal, so texts that are long still are further apart; the band decides all others
        return F.when(F.least(F.size(t["a"]), F.size(t["b"])) < WORD + edits, distance).otherwise(edits + 1)

    split = F.transform(F.array(_core(a, b)), lambda s: F.struct(chars(s["x"]).alias("a"), chars(s["y"]).alias("b")))
    return F.get(F.transform(split, run), F.lit(0))


def within(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """Keep the pairs within ``edits`` edits."""
    return pairs.filter(F.when(F.abs(F.length(a) - F.length(b)) <= edits, bounded_distance(F.col(a), F.col(b), edits)) <= edits)


def _diagonal(full: int):
    """d: where a cell equals its diagonal neighbour."""
    return lambda t: F.struct((((t["q"].bitwiseAND(t["p"]) + t["p"]).bitwiseXOR(t["p"])).bitwiseOR(t["q"]).bitwiseOR(t["n"])).bitwiseAND(F.lit(full)).alias("d"), *[t[k].alias(k) for k in "pnjewt"])


def _horizontal(full: int):
    """r, f: where the distance rises or falls along a row."""
    return lambda t: F.struct(
        t["d"].alias("d"), t["n"].bitwiseOR(t["d"].bitwiseOR(t["p"]).bitwiseXOR(F.lit(full))).alias("r"), t["d"].bitwiseAND(t["p"]).alias("f"), *[t[k].alias(k) for k in "jewt"]
    )


def _vertical(full: int, top: int):
    """The next column's vertical differences, one diagonal further, and the tracked cell's distance."""

    def of(t: Column) -> Column:
        down = F.shiftright(t["d"], 1)
        at = F.lit(top - 1) - (t["j"] - t["t"])
        bit = lambda v: F.floor(v / F.pow(F.lit(2.0), at)).cast("int") % 2
        e = t["e"] + F.when(t["j"] < t["t"], 1 - F.shiftright(t["d"], top).bitwiseAND(F.lit(1))).otherwise(bit(t["r"]) - bit(t["f"]))
        return F.struct(t["f"].bitwiseOR(down.bitwiseOR(t["r"]).bitwiseXOR(F.lit(full))).alias("p"), down.bitwiseAND(t["r"]).alias("n"), (t["j"] + 1).alias("j"), e.cast("int").alias("e"), t["w"].alias("w"), t["t"].alias("t"))

    return of


#: Candidate lines up to this number are looked up by a broadcast set of hashes (16 bytes each), more by a shuffle.
BROADCAST_IDS = 200_000
#: Lines of a key with more lines than this are compared by finer keys: all but one of FINE_PARTS segments (only for one edit).
HOT_KEY, FINE_PARTS = 40, 16


def _roles(own: list[Column], other: list[Column]) -> Column:
    """(key, role): a line's own parts have role 0; what a shorter line's parts can be in it has role 1."""
    return F.array(*[F.struct(k.alias("key"), F.lit(role).alias("role")) for role, keys in enumerate((own, other)) for k in keys])


def _segment_roles(line: Column, length: Column, edits: int) -> Column:
    return _roles(segment_keys(line, length, edits), probe_keys(line, length, edits))


def _all_but_one_roles(line: Column, length: Column) -> Column:
    """With one edit, all but one of FINE_PARTS segments are equal; those behind an inserted character stand one place further."""

    def keys(size: Column, shift: int) -> list[Column]:
        cut = [(size * i / FINE_PARTS).cast("int") for i in range(FINE_PARTS + 1)]
        return [F.xxhash64(F.lit(i), size, F.left(line, cut[i]), F.substring(line, cut[i + 1] + 1 + shift, length)) for i in range(FINE_PARTS)]

    return _roles(keys(length, 0), keys(length - 1, 1))


def _keyed(lines: DataFrame, roles) -> DataFrame:
    """_r, _key, _role: once for each line text, combined in the tasks before rows move."""
    sized = lines.select("_r", "_line", F.length("_line").alias("_n"))
    keys = sized.select("_r", roles(F.col("_line"), F.col("_n")).alias("_ks")).select("_r", F.explode("_ks").alias("k"))
    return keys.select("_r", F.col("k.key").alias("_key"), F.col("k.role").alias("_role")).filter(F.col("_key").isNotNull()).distinct()


def _pairs(keyed: DataFrame) -> DataFrame:
    a = keyed.filter("_role = 0").select("_key", F.col("_r").alias("_a"))
    b = keyed.select("_key", F.col("_r").alias("_b"), "_role")
    return a.join(b, "_key").filter("_a < _b OR (_role = 1 AND _a <> _b)").select("_a", "_b")


def near_lines(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs (_a, _b) of line hashes whose lines differ by 1 to ``edits`` edits."""
    keyed = _keyed(lines, lambda line, n: _segment_roles(line, n, edits))
    shared = keyed.groupBy("_key").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"), F.min("_role").alias("_owned")).filter((F.col("_lo") != F.col("_hi")) & (F.col("_owned") == 0)).select("_key")
    active = cut(keyed.join(shared, "_key", "left_semi"))
    ids = active.select("_r").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = cut(lines.select("_r", "_line").join(F.broadcast(ids) if few else ids, "_r", "left_semi").groupBy("_r").agg(F.max("_line").alias("_line")))
    if edits == 1:
        sized = active.groupBy("_key").agg(F.count("*").alias("_n"))
        hot = active.join(sized.filter(F.col("_n") > HOT_KEY), "_key", "left_semi").select("_r").distinct()
        fine = _keyed(texts.join(hot, "_r", "left_semi"), _all_but_one_roles)
        found = _pairs(active.join(sized.filter(F.col("_n") <= HOT_KEY), "_key", "left_semi")).unionByName(_pairs(fine))
    else:
        found = _pairs(active)
    sides = found.distinct().join(texts.withColumnsRenamed({"_r": "_a", "_line": "_la"}), "_a").join(texts.withColumnsRenamed({"_r": "_b", "_line": "_lb"}), "_b")
    return within(sides, "_la", "_lb", edits).select("_a", _second("_la").alias("_qa"), "_b", _second("_lb").alias("_qb"))


def _second(line: str) -> Column:
    return F.xxhash64(F.lit("second"), line)


def removed(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """_id, _th, _gone (array of line numbers from 0) of the documents that lose lines."""
    lines = lines_of(docs).filter(F.trim("_line") != "").withColumn("_r", F.xxhash64("_line")).withColumn("_q", _second("_line"))
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("_at").alias("at"))
    firsts = lines.groupBy("_r", "_q").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    near = cut(near_lines(lines.filter(F.length("_line") >= least), edits))
    first = firsts.select("_r", "_q", "_first")
    both = near.join(first.toDF("_a", "_qa", "_fa"), ["_a", "_qa"]).join(first.toDF("_b", "_qb", "_fb"), ["_b", "_qb"])
    a, b = F.struct(F.col("_a").alias("r"), F.col("_qa").alias("q")), F.struct(F.col("_b").alias("r"), F.col("_qb").alias("q"))
    late = both.select(F.when(F.col("_fa") < F.col("_fb"), b).otherwise(a).alias("x")).select(F.col("x.r").alias("_r"), F.col("x.q").alias("_q")).distinct().withColumn("_late", F.lit(True))
    marked = store(firsts.join(late, ["_r", "_q"], "left").filter((F.col("_n") > 1) | F.col("_late")))
    total = marked.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = marked.filter(F.col("_n") * HOT_PARTS > total).select("_r", "_q", F.lit(True).alias("_hot"))  # fewer than HOT_PARTS lines
    hits = join_salted(lines.select("_id", "_th", "_at", "_r", "_q"), ["_r", "_q"], "_th", marked.drop("_n"), hot)
    return hits.filter(F.col("_late").isNotNull() | (place != F.col("_first"))).groupBy("_id", "_th").agg(F.collect_set("_at").alias("_gone"))


def _with_gone(docs: DataFrame, edits: int, least: int) -> tuple[DataFrame, Column, Column]:
    """The rows of docs in _row with the places of lines that go, those places, and the lines that stay."""
    packed = pack(docs)
    both = packed.join(removed(docs, edits, least), F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_row.text") == F.col("_th")), "left")
    gone = F.array_sort(F.coalesce("_gone", F.array().cast("array<int>")))
    ends = F.array(F.lit(-1))
    bound = F.struct(F.split("_row.text", "\n").alias("l"), F.concat(ends, gone, F.array(F.size(F.split("_row.text", "\n")))).alias("b"))

    def stretches(t: Column) -> Column:
        # the lines between two that go, stretch by stretch, so the work grows with the lines
        between = lambda k: F.slice(t["l"], F.get(t["b"], k) + 2, F.get(t["b"], k + 1) - F.get(t["b"], k) - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(t["b"]) - 2), between))

    kept = F.get(F.transform(F.array(bound), stretches), F.lit(0))
    return both, gone, F.when(F.col("_row.text").isNotNull(), kept)


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """docs with the lines that stay; other columns as they are, whatever their names."""
    both, _, kept = _with_gone(docs, edits, least)
    return unpack(both, docs, text=F.array_join(kept, "\n"))


def report(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of each document (a null text has no lines and the digest of the empty text)."""
    both, gone, kept = _with_gone(docs.select("doc_id", "text"), edits, least)
    n = F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(F.split("_row.text", "\n")))
    digest = F.sha2(F.coalesce(F.array_join(kept, "\n"), F.lit("")).cast("binary"), 256)
    return both.select(F.col("_row.doc_id").alias("doc_id"), n.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), digest.alias("kept_sha256"))
