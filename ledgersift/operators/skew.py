"""Joins for keys of which one may hold a large share of all rows: hot keys are found by counting, and their rows dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.plans.zones import zone

#: A key with over one HOT_PARTS-th of all rows is hot; there are fewer than HOT_PARTS such keys, so these may be sent to all tasks.
HOT_PARTS = 2048
#: Groups up to this number are sent to all tasks, hot or not.
FEW = 100_000
#: Cells of a hash in which rows are counted first, added up in the tasks that read them.
CELLS = 1 << 16
#: Tasks over which the rows of a hot key are dealt.
SALTS = 32


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The hot keys of rows, written. Only rows in hot cells, of which there are as few as hot keys at most, are counted by key."""
    marked = rows.select(*keys).withColumn("_cell", F.pmod(F.xxhash64(*keys), F.lit(CELLS)))
    cells = zone(marked.groupBy("_cell").agg(F.count("*").alias("_n")))
    limit = max(cells.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0], HOT_PARTS)
    few = cells.filter(F.col("_n") * HOT_PARTS > limit).select("_cell")
    counted = marked.join(F.broadcast(few), "_cell", "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"))
    return zone(counted.filter(F.col("_n") * HOT_PARTS > limit).drop("_n"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, keep=None) -> DataFrame:
    """Inner join of rows with groups (written, one row a key, of ``size`` rows each); hot groups are sent to all tasks, so their rows stay where they are.

    Only groups for which ``keep`` holds are joined; no row moves if these are at most FEW. Rows of hot keys without such a group do not move either.
    """
    wanted = groups if keep is None else groups.filter(keep)
    if wanted.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(wanted), keys)
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) * HOT_PARTS > max(total, HOT_PARTS)
    rest = rows.join(F.broadcast(groups.filter(hot).select(*keys)), keys, "left_anti").join(wanted.filter(~hot), keys)
    return rows.join(F.broadcast(wanted.filter(hot)), keys).unionByName(rest)


def join_salted(rows: DataFrame, others: DataFrame, keys: list[str], spread: list[str], hot: DataFrame) -> DataFrame:
    """Inner join of rows with others; rows of hot keys are dealt over SALTS tasks by ``spread``, and the other side's are repeated as often."""
    marked = hot.withColumn("_hot", F.lit(True))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    one = rows.join(F.broadcast(marked), keys, "left").withColumn("_salt", salt).drop("_hot")
    two = others.join(F.broadcast(marked), keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return one.join(two, [*keys, "_salt"]).drop("_salt")
