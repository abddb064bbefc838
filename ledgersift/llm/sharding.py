"""Sharding: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

Rows are points on a ring that virtual nodes cut into arcs; an arc belongs to the shard of the node at its clockwise end.
A full shard passes its overflow on clockwise, so counts are at most one apart whatever the hashes are,
and only the overflow of full arcs leaves its own shard. Rows with a null id or text are hashed like others; repeated rows are
told apart by their order alone. An empty table has no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.llm.common import lower_bound

VIRTUAL_NODES = 48
#: Each arc is ranked in so many parts, so that no arc, however hot, is sorted by one task.
PARTS = 16
RING = 1 << 32


def point(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(RING))


def nodes(spark, shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise; a shard's nodes do not depend on the number of shards."""
    frame = spark.range(shards * virtual).select(point(F.lit("node"), (F.col("id") % shards).cast("string"), F.expr(f"id div {shards}").cast("string")).alias("p"), (F.col("id") % shards).cast("int").alias("s"))
    return [(r["p"], r["s"]) for r in frame.orderBy("p", "s").collect()]


def capacities(total: int, shards: int) -> list[int]:
    """As equal as they can be; the first shards take the rest."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def spill(arcs: list[tuple[int, int]], counts: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): what of each arc goes where.

    Every arc fills its own shard first, clockwise; what is left then goes on clockwise to the next arc whose shard has room.
    """
    out, used = [], [0] * len(room)
    left: dict[int, int] = {}
    for a, (_, s) in enumerate(arcs):
        take = min(counts[a], room[s] - used[s])
        if take:
            out.append((a, 0, take, s, used[s]))
            used[s] += take
        if take < counts[a]:
            left[a] = take
    for a, done in left.items():
        b = a
        while done < counts[a]:
            b = (b + 1) % len(arcs)
            s = arcs[b][1]
            take = min(counts[a] - done, room[s] - used[s])
            if take:
                out.append((a, done, done + take, s, used[s]))
                used[s] += take
                done += take
    return out


def _frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver that no Python worker has to read."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def assign(rows: DataFrame, keys: list[str], shards: int, virtual: int = VIRTUAL_NODES, parts: int = PARTS) -> DataFrame:
    """Add shard (int) and slot (long, gapless from 0 in each shard) to rows; ``keys`` place a row and break ties.

    Only counts by arc, whose number is set by the parameters, reach the driver.
    """
    spark = rows.sparkSession
    arcs = nodes(spark, shards, virtual)
    ends = F.array(*[F.lit(p) for p, _ in arcs])
    # the first node at or after the point; beyond the last one the ring closes
    found = lower_bound(F.col("_ends"), len(arcs), lambda end: end < F.col("_p")) % len(arcs)
    placed = rows.withColumn("_p", point(*[F.col(k) for k in keys[:1]])).withColumn("_ends", ends)
    # a generated column, so that the optimizer does not carry the search into the joins on it
    placed = placed.select(*rows.columns, "_p", F.explode(F.array(found)).alias("_arc")).withColumn("_part", F.pmod(F.xxhash64(*keys, F.lit("part")), F.lit(parts)).cast("int"))
    counted = placed.groupBy("_arc", "_part").count().collect()  # at most arcs x parts rows
    by_arc = [0] * len(arcs)
    for r in counted:
        by_arc[r["_arc"]] += r["count"]
    plan = spill(arcs, by_arc, capacities(sum(by_arc), shards))
    ahead, so_far = [], {}
    for r in sorted(counted, key=lambda r: (r["_arc"], r["_part"])):
        ahead.append((r["_arc"], r["_part"], so_far.get(r["_arc"], 0)))
        so_far[r["_arc"]] = so_far.get(r["_arc"], 0) + r["count"]
    before = _frame(spark, ahead, "_arc int, _part int, _before long")
    pieces = _frame(spark, plan, "_arc int, _from long, _to long, shard int, _slot long")
    rank = F.row_number().over(Window.partitionBy("_arc", "_part").orderBy("_p", *keys)) - 1
    ranked = placed.withColumn("_rank", rank).join(F.broadcast(before), ["_arc", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    got = ranked.join(F.broadcast(pieces), (ranked["_arc"] == pieces["_arc"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(pieces["_arc"])
    return got.withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_from")).drop("_p", "_arc", "_part", "_before", "_rank", "_from", "_to", "_slot")


def documents(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents under the law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(rows, ["doc_id", "text_crc32", "size"], shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
