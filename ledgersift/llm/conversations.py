"""Conversation structure repair: the cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``.

Every row is a symbol: initial of its role and fault. Equal consecutive symbols are one run. The four states of the pattern and the edits of a
row give a min-plus transition of each symbol; a run advances by its cached binary powers. Choices are unrolled block by block from the costs
behind them, so the audit needs no table of all rows.

Rows are dealt over tasks by ranges of (conversation, turn, role, text), so a conversation of any length is spread evenly. A task hands the
driver the transitions of its first and last conversation, two rows a task; these are joined to costs and states at the borders, and then every
task unrolls its own part. Only the hash of a conversation that crosses a border is a sequential pass, streamed in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgersift.llm.common import HOT_PARTS, cut, store

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States of the pattern: nothing yet, after s, after u, after a; both first and last accept.
STATES = range(4)
FAR = 1 << 60
#: What inserting does: the state after it, and the role; the state before it leaves no choice.
INSERTED = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Characters of repaired text in a row that goes from a part of a conversation to its hash.
PIECE = 1 << 20
BLANK, DUPLICATE, CUT_OFF, FINE = "b", "d", "t", "f"

Symbol = tuple[str, str]
Vector = tuple[int, int, int, int]


def _times(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def _before(m: tuple[Vector, ...], after: Vector) -> Vector:
    return tuple(min(m[i][j] + after[j] for j in STATES) for i in STATES)


@lru_cache(None)
def _inserts() -> tuple[Vector, ...]:
    """Least cost of coming from one state to another by inserting alone."""
    cost = [[0 if i == j else FAR for j in STATES] for i in STATES]
    for i in STATES:
        at = i
        for n in (1, 2):
            at = INSERTED[at][0]
            cost[i][at] = min(cost[i][at], n * INSERT)
    return tuple(map(tuple, cost))


def _moves(state: int, symbol: Symbol) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row, in order of the edits' initials."""
    initial, fault = symbol
    moves = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED * (fault == CUT_OFF)
        if (state, initial) in KEPT:
            moves.append(("K", extra, KEPT[state, initial]))
        moves.append(("R", REROLE + extra, INSERTED[state][0]))
    return moves


@lru_cache(1 << 12)
def power(symbol: Symbol, k: int) -> tuple[Vector, ...]:
    """The transition of 2^k rows of one symbol, inserts before each of them included."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    row = [[FAR] * 4 for _ in STATES]
    for i in STATES:
        for _, cost, j in _moves(i, symbol):
            row[i][j] = min(row[i][j], cost)
    return _times(_inserts(), tuple(map(tuple, row)))


#: Costs of ending in each state.
END: Vector = tuple(min(_inserts()[i][0], _inserts()[i][3]) for i in STATES)


def advance(symbol: Symbol, n: int, after: Vector) -> Vector:
    """Costs before n rows of one symbol, given those after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = _before(power(symbol, k), after)
    return after


def transition(runs: list[tuple[Symbol, int]]) -> tuple[Vector, ...]:
    """The transition of a stretch of rows."""
    columns = [tuple(0 if i == j else FAR for i in STATES) for j in STATES]
    for symbol, n in reversed(runs):
        columns = [advance(symbol, n, c) for c in columns]
    return tuple(tuple(c[i] for c in columns) for i in STATES)


def _from_least(v: Vector) -> Vector:
    least = min(v)
    return tuple(x - least for x in v)


@lru_cache(1 << 16)
def _block(symbol: Symbol, k: int, state: int, after: Vector) -> tuple[str, int]:
    """Initials of the edits of 2^k rows from a state, ASCII-least among the cheapest, and the state after them; ``after`` counts from its least."""
    if k:
        middle = _from_least(_before(power(symbol, k - 1), after))
        left, state = _block(symbol, k - 1, state, middle)
        right, state = _block(symbol, k - 1, state, after)
        return left + right, state
    cost, letters = _before(power(symbol, 0), after), ""
    while True:
        delete, *rest = [(m, j) for m, c, j in _moves(state, symbol) if c + after[j] == cost[state]] or [("", 0)]
        if delete[0] == "D":
            return letters + "D", state
        to = INSERTED[state][0]
        if INSERT + cost[to] == cost[state]:
            letters, state = letters + "I", to
        else:
            return letters + delete[0], delete[1]


def unroll(symbol: Symbol, n: int, state: int, after: Vector) -> tuple[str, int]:
    """As _block, for n rows."""
    stack = []
    for k in range(n.bit_length()):
        if n >> k & 1:
            stack.append((k, _from_least(after)))
            after = _before(power(symbol, k), after)
    letters = []
    for k, behind in reversed(stack):
        part, state = _block(symbol, k, state, behind)
        letters.append(part)
    return "".join(letters), state


def edits(runs: list[tuple[Symbol, int]], state: int = 0, after: Vector | None = None) -> tuple[str, int]:
    """Initials of the cheapest edits of a stretch of rows and the state after it; at the end (no ``after``) with the inserts that close it."""
    behind, at = [], END if after is None else after
    for symbol, n in reversed(runs):
        behind.append(at)
        at = _from_least(advance(symbol, n, at))
    letters = []
    for (symbol, n), then in zip(runs, reversed(behind), strict=True):
        part, state = unroll(symbol, n, state, then)
        letters.append(part)
    if after is None:
        while state not in (0, 3):
            letters.append("I")
            state = INSERTED[state][0]
    return "".join(letters), state


def apply(rows: list[tuple[str, str, int]], letters: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what stands after the edits; rows are (role, text, how many times)."""
    at = iter(letters)
    for role, text, n in rows:
        for _ in range(n):
            while (edit := next(at)) == "I":
                state, new = INSERTED[state]
                yield edit, new, ""
            if edit == "K":
                state = KEPT[state, role[:1]]
                yield edit, role, text
            elif edit == "R":
                state, new = INSERTED[state]
                yield edit, new, text
    for edit in at:
        state, new = INSERTED[state]
        yield edit, new, ""


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the faults that the hash of ``conv_id:turn`` plants; nulls of roles, texts and hashed ids count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    role = F.when(k == 0, "").when(k == 4, "user").otherwise(space("role"))
    text = F.when(k.isin(0, 1), "").when(k == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def plain(conversations: DataFrame) -> DataFrame:
    """The rows as they are, nulls of roles and texts as one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", one("role"), one("text"), F.lit(1).alias("copies"))


def _last_mark(text: Column) -> Column:
    """The last character that is none of the six blanks; empty if there is none."""
    return F.right(F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", ""), F.lit(1))


def marked(rows: DataFrame) -> DataFrame:
    """(part, conv_id, turn, role, text, fault, n, first): rows in order within parts; ``n`` equal ones, of which ``first`` are no duplicates.

    Equal rows are counted before they move. Which text stands earlier is known from the least turn of each (conversation, role, text), by a
    128-bit hash; hot ones meet their rows by broadcast.
    """
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    mark = _last_mark(F.col("text"))
    fault = F.when(mark == "", BLANK).when(F.instr(F.lit(".!?"), mark) > 0, FINE).otherwise(CUT_OFF)
    key = F.md5(F.concat_ws("\0", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), "role", "text").cast("binary"))
    one = store(one.withColumns({"fault": fault, "_h": F.when((fault != BLANK) & (F.col("n") > 0), key)}))
    when = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    again = one.filter("_h IS NOT NULL").groupBy("_h").agg(F.min(when).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    again = store(again)
    limit = max(again.agg(F.sum("_n")).first()[0] or 0, HOT_PARTS)
    hot, rest = again.filter(F.col("_n") * HOT_PARTS > limit).drop("_n"), again.filter(F.col("_n") * HOT_PARTS <= limit).drop("_n")
    cold = one.join(F.broadcast(hot.select("_h")), "_h", "left_anti").join(rest, "_h", "left")
    both = one.join(F.broadcast(hot), "_h").unionByName(cold)
    first = F.when((F.col("fault") == BLANK) | (F.col("n") == 0), 0).when(F.col("_first") < when, 0).otherwise(1)
    order = ["conv_id", "turn", "role", "text"]
    dealt = both.select(*order, "fault", "n", first.alias("first")).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(dealt.withColumn("part", F.spark_partition_id()))


class _Stretch:
    """The rows of one conversation within a task, and what is counted about them."""

    def __init__(self, conv_id, part: int):
        self.conv_id, self.part, self.rows, self.runs = conv_id, part, [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.first_role = self.last_role = None

    def add(self, turn, role: str, text: str | None, fault: str, n: int, first: int) -> None:
        if not n:
            return
        if text is not None:
            self.rows.append((role, text, n))
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        new = BLANK if fault == BLANK else DUPLICATE
        for symbol, times in (((initial, fault), first), ((initial, new), n - first)):
            if times and self.runs and self.runs[-1][0] == symbol:
                self.runs[-1] = (symbol, self.runs[-1][1] + times)
            elif times:
                self.runs.append((symbol, times))
        self.blank += n * (fault == BLANK)
        self.duplicate += (n - first) * (fault != BLANK)
        self.truncated += first * (fault == CUT_OFF)
        self.illegal += n - 1 if self.last_role is None else n - 1 + _illegal(self.last_role, initial)
        self.first_role, self.last_role = initial if self.first_role is None else self.first_role, initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn

    def counts(self) -> tuple[int, ...]:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal

    def join(self, other: _Stretch) -> None:
        """Take in what is counted of the stretch that follows."""
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.first_role is not None:
            self.illegal += self.last_role is not None and _illegal(self.last_role, other.first_role)
            self.first_role, self.last_role = other.first_role if self.first_role is None else self.first_role, other.last_role
        if other.first_turn is not None:
            self.turns -= self.last_turn == other.first_turn
            self.first_turn, self.last_turn = other.first_turn if self.first_turn is None else self.first_turn, other.last_turn


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[_Stretch]:
    """Conversations of a task in order; texts are taken along where there are any."""
    at = None
    for batch in batches:
        d = batch.to_pydict()
        for part, conv, turn, role, text, fault, n, first in zip(d["part"], d["conv_id"], d["turn"], d["role"], d.get("text") or [None] * batch.num_rows, d["fault"], d["n"], d["first"], strict=True):
            if at is None or conv != at.conv_id:
                if at is not None:
                    yield at
                at = _Stretch(conv, part)
            at.add(turn, role, text, fault, n, first)
    if at is not None:
        yield at


COUNTED = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_role", "last_role")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of a task: its transition and counts."""
    first = last = None
    for last in _stretches(batches):
        first = first or last
    for s in [first, last] if first is not last else [first] if first else []:
        counts = [None if (v := getattr(s, a)) is None else str(v) for a in COUNTED]
        m = [x for row in transition(s.runs) for x in row]
        yield pa.RecordBatch.from_pylist([{"part": s.part, "conv": repr(s.conv_id), "m": m, "c": counts}], pa.schema([("part", pa.int32()), ("conv", pa.string()), ("m", pa.list_(pa.int64())), ("c", pa.list_(pa.string()))]))


#: What a part of a split conversation needs: state before it, and costs after it (None at the end).
Border = tuple[int, Vector | None]


def _borders(rows: DataFrame) -> tuple[dict[tuple[int, str], Border], dict[str, tuple]]:
    """Borders of the parts of split conversations, and counts and cost of each of these conversations; two small rows a task come to the driver."""
    slim = rows.select("part", "conv_id", "turn", F.left("role", F.lit(1)).alias("role"), "fault", "n", "first")
    parts: dict[str, list] = {}
    for r in slim.mapInArrow(_ends, "part int, conv string, m array<long>, c array<string>").orderBy("part").collect():
        parts.setdefault(r["conv"], []).append(r)
    parts = {conv: found for conv, found in parts.items() if len(found) > 1}
    after: dict[tuple[int, str], Vector | None] = {}
    whole = {}
    for conv, found in parts.items():
        at, total = END, _Stretch(conv, 0)
        for r in reversed(found):
            after[r["part"], conv] = None if r is found[-1] else at
            at = _before(tuple(tuple(r["m"][4 * i : 4 * i + 4]) for i in STATES), at)
        for r in found:
            one = _Stretch(conv, r["part"])
            for a, v in zip(COUNTED, r["c"], strict=True):
                setattr(one, a, v if a.endswith("role") or v is None else int(v))
            total.join(one)
        whole[conv] = (*total.counts(), at[0])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _stretches(batches):
            if (key := (s.part, repr(s.conv_id))) in after:
                states = [edits(s.runs, q, after[key])[1] for q in STATES]
                yield pa.RecordBatch.from_pylist([{"part": s.part, "conv": key[1], "to": states}], pa.schema([("part", pa.int32()), ("conv", pa.string()), ("to", pa.list_(pa.int32()))]))

    borders, state = {}, dict.fromkeys(parts, 0)
    for r in slim.mapInArrow(exits, "part int, conv string, to array<int>").orderBy("part").collect() if parts else []:
        key = (r["part"], r["conv"])
        borders[key] = (state[r["conv"]], after[key])
        state[r["conv"]] = r["to"][state[r["conv"]]]
    return borders, whole


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, part, place, edit, role, text): the repaired rows (edits Keep, Insert and Rerole) of (conv_id, turn, role, text, copies), in order of part and place."""
    dealt = marked(rows)
    borders, _ = _borders(dealt)

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _stretches(batches):
            state, after = borders.get((s.part, repr(s.conv_id)), (0, None))
            letters, _ = edits(s.runs, state, after)
            for place, (edit, role, text) in enumerate(apply(s.rows, letters, state)):
                yield {"conv_id": s.conv_id, "part": s.part, "place": place, "edit": edit, "role": role, "text": text}

    return dealt.mapInArrow(_framed(messages, dealt, MESSAGE), f"conv_id {_kind(dealt)}, part int, place long, edit string, role string, text string")


MESSAGE = {"part": pa.int32(), "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
RESULT = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
PARTIAL = RESULT | {"part": pa.int32(), "place": pa.int64(), "piece": pa.string()}


def _kind(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _framed(make, rows: DataFrame, columns: dict[str, pa.DataType], most: int = 1000):
    """A function on Arrow batches from one that yields rows; a batch closes at ``most`` rows or some PIECE of text."""
    schema = pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), *columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in make(batches):
            held.append(row)
            size += sum(len(v) for v in row.values() if isinstance(v, str))
            if len(held) == most or size > 4 * PIECE:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of (conv_id, turn, role, text, copies).

    Rows with no copies only name their conversation. Order within a conversation: turn, nulls first, then role and text. Null conv_ids are one
    conversation. A conversation without rows has zeros, an empty audit and the hash of the empty string.
    """
    dealt = marked(rows)
    borders, whole = _borders(dealt)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for s in _stretches(batches):
            key = repr(s.conv_id)
            if key not in whole:
                letters, _ = edits(s.runs)
                cost = _cost(s.runs)
                text = "\n".join(f"{role}:{text}" for _, role, text in apply(s.rows, letters, 0))
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                yield dict(zip(RESULT, (*s.counts(), cost, letters, digest), strict=True)) | {"conv_id": s.conv_id}
                continue
            state, after = borders[s.part, key]
            letters, _ = edits(s.runs, state, after)
            for at in range(0, len(letters), PIECE):
                yield {"conv_id": s.conv_id, "part": s.part, "place": at - len(letters), "audit": letters[at : at + PIECE], "piece": ""}
            held, size, place = [], 0, 0
            for _, role, text in apply(s.rows, letters, state):
                held.append(f"\n{role}:{text}")
                size += len(held[-1])
                if size > PIECE:
                    yield {"conv_id": s.conv_id, "part": s.part, "place": place, "audit": "", "piece": "".join(held)}
                    held, size, place = [], 0, place + 1
            yield {"conv_id": s.conv_id, "part": s.part, "place": place, "audit": "", "piece": "".join(held)}

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, audit, digest, begun = None, [], None, False
        for batch in batches:
            for r in batch.to_pylist():
                if digest is None or r["conv_id"] != at:
                    if digest is not None:
                        yield _row(at, whole[repr(at)], audit, digest)
                    at, audit, digest, begun = r["conv_id"], [], hashlib.sha256(), False
                audit.append(r["audit"])
                if r["piece"]:
                    digest.update(r["piece"][not begun :].encode("utf-8", "surrogatepass"))
                    begun = True
        if digest is not None:
            yield _row(at, whole[repr(at)], audit, digest)

    schema = f"conv_id {_kind(dealt)}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    got = dealt.mapInArrow(_framed(solved, dealt, PARTIAL), schema + ", part int, place long, piece string")
    if not whole:
        return got.drop("part", "place", "piece")
    got = store(got)
    pieces = got.filter("piece IS NOT NULL").select("conv_id", "part", "place", "audit", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return got.filter("piece IS NULL").drop("part", "place", "piece").unionByName(pieces.mapInArrow(_framed(folded, dealt, RESULT), schema))


def _cost(runs: list[tuple[Symbol, int]]) -> int:
    after = END
    for symbol, n in reversed(runs):
        after = advance(symbol, n, after)
    return after[0]


def _row(conv_id, counts: tuple, audit: list[str], digest) -> dict:
    return dict(zip(RESULT, (*counts, "".join(audit), digest.hexdigest()), strict=True)) | {"conv_id": conv_id}
