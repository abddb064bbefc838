"""Scores of the rules, the review universe and the assessments against labelled documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.operators.review import document_amounts
from ledgersift.operators.rules import RULES, line_rules
from ledgersift.plans.params import Params

#: manual_entries describes a population and is not scored.
SCORED = RULES[1:]


def hash_labels(journal: DataFrame) -> DataFrame:
    """(entry_ref, rule): a label for nine of thirty documents, by their number; one rule each."""
    k = (F.substring("entry_ref", 3, 20).cast("long") % 30).cast("int")
    rule = F.element_at(F.array(*map(F.lit, SCORED)), k + 1)
    return journal.select("entry_ref").distinct().filter(k < len(SCORED)).select("entry_ref", rule.alias("rule"))


def ratio(part: Column, whole: Column) -> Column:
    """1 where there is nothing to divide by."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def with_scores(counts: DataFrame) -> DataFrame:
    """tp, fp, fn and precision, recall and F1 to 4 places."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(p + r == 0, 1.0).otherwise(2 * p * r / (p + r))
    return counts.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f1, 4)})


def by_rule(found: DataFrame, labels: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    """Scores of each rule, zeros kept for given ``rules`` (else of those that occur); a flag on a document labelled for another rule counts for neither side."""
    known = labels.select("rule").unionByName(found.select("rule")).distinct() if rules is None else found.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    f = found.select("rule", "entry_ref").distinct().withColumn("flagged", F.lit(True))
    any_label = labels.select("entry_ref").distinct().withColumn("known", F.lit(True))
    rows = f.join(labels.distinct().withColumn("labelled", F.lit(True)), ["rule", "entry_ref"], "full_outer").join(any_label, "entry_ref", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    counts = rows.groupBy("rule").agg(
        F.count_if(flag("flagged") & flag("labelled")).alias("tp"), F.count_if(flag("flagged") & ~flag("known")).alias("fp"), F.count_if(flag("labelled") & ~flag("flagged")).alias("fn")
    )
    return with_scores(known.join(counts, "rule", "left").na.fill(0, ["tp", "fp", "fn"]))


def total(found: DataFrame, labels: DataFrame, rules: tuple[str, ...] = SCORED) -> DataFrame:
    """Scores of all scored rules together: a document is found if any of them flags it."""
    f = found.filter(F.col("rule").isin(*rules)).select("entry_ref").distinct().withColumn("flagged", F.lit(True))
    both = f.join(labels.select("entry_ref").distinct().withColumn("labelled", F.lit(True)), "entry_ref", "full_outer")
    flagged, labelled = F.col("flagged").isNotNull(), F.col("labelled").isNotNull()
    return with_scores(both.agg(F.count_if(flagged & labelled).alias("tp"), F.count_if(flagged & ~labelled).alias("fp"), F.count_if(~flagged & labelled).alias("fn")))


def universe_recall(labels: DataFrame, journal: DataFrame, universe: DataFrame, p: Params) -> DataFrame:
    """Of the labelled documents at or above materiality, how many the review universe holds."""
    large = labels.select("entry_ref").distinct().join(document_amounts(journal).filter(F.col("abs_amount") >= p.materiality), "entry_ref", "left_semi")
    both = large.join(universe.select("entry_ref").withColumn("chosen", F.lit(True)), "entry_ref", "left")
    counts = both.agg(F.count("*").alias("eligible"), F.count_if(F.col("chosen")).alias("selected"))
    return counts.withColumn("recall", F.round(ratio(F.col("selected"), F.col("eligible")), 4))


def agreement(assessed: DataFrame, labels: DataFrame) -> DataFrame:
    """How assessments agree with labels: share of labelled entries to inspect, share of labelled ones among those to inspect, clean ones accepted."""
    rows = assessed.select("entry_ref", "action").join(labels.select("entry_ref").distinct().withColumn("labelled", F.lit(True)), "entry_ref", "left").na.fill(False, ["labelled"])
    bad, look = F.col("labelled"), F.col("action") == "inspect"
    counts = rows.agg(
        F.count("*").alias("assessed"), F.count_if(bad).alias("labelled"), F.count_if(bad & look).alias("labelled_inspect"), F.count_if(look).alias("inspected"),
        F.count_if(~bad).alias("clean"), F.count_if(~bad & (F.col("action") == "accept_flag")).alias("clean_accepted"),
    )
    recall, precision = ratio(F.col("labelled_inspect"), F.col("labelled")), ratio(F.col("labelled_inspect"), F.col("inspected"))
    return counts.withColumns({"inspect_recall": F.round(recall, 4), "inspect_precision": F.round(precision, 4)})


def digests(rows: DataFrame, key: str) -> DataFrame:
    """(part, n, a, b): digests of the rows in 256 parts by ``key``, as counts and sums of two pieces of each row's MD5; no order or partitioning matters.

    Kept beside a table they tell later where another one differs. Nulls count as a value of their own.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(rows.columns)])
    piece = lambda i: F.conv(F.substring("_d", i, 15), 16, 10).cast("decimal(38,0)")
    part = F.left(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(2))
    each = rows.select(part.alias("part"), F.md5(text.cast("binary")).alias("_d"))
    return each.groupBy("part").agg(F.count("*").alias("n"), F.sum(piece(1)).alias("a"), F.sum(piece(16)).alias("b"))


def digest_tree(parts: DataFrame) -> DataFrame:
    """(node, n, digest): the parts, each sixteen of them by their first digit, and the whole (the empty node)."""
    leaf = parts.select(F.col("part").alias("node"), "n", F.sha2(F.concat_ws(":", "n", "a", "b").cast("binary"), 256).alias("digest"))

    def above(below: DataFrame, digits: int) -> DataFrame:
        by = below.groupBy(F.left("node", F.lit(digits)).alias("_up")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.concat_ws("=", "node", "digest"))).alias("_l"))
        return by.select(F.col("_up").alias("node"), "n", F.sha2(F.array_join("_l", ",").cast("binary"), 256).alias("digest"))

    middle = above(leaf, 1)
    return leaf.unionByName(middle).unionByName(above(middle, 0))


def differing(first: DataFrame, second: DataFrame) -> DataFrame:
    """(node, n, n2) of the nodes of two digest trees that differ, from the whole down; no rows if the tables are the same."""
    both = first.join(second.toDF("node", "n2", "digest2"), "node", "full_outer")
    return both.filter(~F.col("digest").eqNullSafe(F.col("digest2"))).select("node", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n2", F.lit(0)).alias("n2"))


def changed_rows(first: DataFrame, second: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """Rows of the differing parts that only one of the tables has (side 1 or 2); the other parts are filtered out as they are read."""
    leaves = F.broadcast(nodes.filter(F.length("node") == 2).select("node"))
    part = F.left(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(2))
    a, b = (t.withColumn("node", part).join(leaves, "node", "left_semi").drop("node") for t in (first, second))
    return a.exceptAll(b).withColumn("side", F.lit(1)).unionByName(b.exceptAll(a).withColumn("side", F.lit(2)))


def round_sweep(journal: DataFrame, multiples: tuple[int, ...], p: Params) -> DataFrame:
    """Flags of the round-amount rule under several multiples, in one scan."""
    rows = journal.filter(F.abs("amount") >= p.round_min).select(F.round(F.abs("amount"), 0).cast("bigint").alias("a"), F.explode(F.array(*map(F.lit, multiples))).alias("variant"))
    return rows.filter(F.col("a") % F.col("variant") == 0).groupBy("variant").agg(F.count("*").alias("flagged"))


def sweep(journal: DataFrame, labels: DataFrame, variants: dict[str, Params], rules: tuple[str, ...] = RULES[1:4]) -> DataFrame:
    """Scores of row-local rules under several sets of parameters: (variant, rule, tp, fp, fn, precision, recall, f1)."""
    one = lambda name, p: by_rule(line_rules(journal, p), labels, rules).select(F.lit(name).alias("variant"), "*")
    return reduce(DataFrame.unionByName, [one(name, p) for name, p in variants.items()])
