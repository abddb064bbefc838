"""All rules under many sets of parameters at once.

Each line or document gets a mask with a bit for each set of parameters under which a rule takes it. Amounts, gaps and counts are read once and
compared with the limits of all sets; grouped rules carry the set as a key or a count for each. Masks of a document are joined by
bit_or, so what moves is one row for each document and rule, however many sets there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.operators import evaluate, rules, skew
from ledgersift.plans.params import Params
from ledgersift.plans.zones import zone

#: A mask is a long.
MOST = 62
#: The name under which the scores of all rules together are given.
TOTAL = "all rules"


def _mask(conditions: list[Column]) -> Column:
    bits = [F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(conditions)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _has(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << i).cast("long")) != 0


def _of(values: list) -> Column:
    """The value of the set whose number is in column _v."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("_v") + 1)


def _marks(rows: DataFrame, rule: str) -> DataFrame:
    return rows.filter("mask <> 0").select(F.lit(rule).alias("rule"), "entry_ref", "mask")


def _lines(journal: DataFrame, ps: list[Params]) -> DataFrame:
    each = [rules.row_conditions(p) for p in ps]
    made = F.array(*[F.struct(F.lit(r).alias("rule"), _mask([c[r][0] for c in each]).alias("mask")) for r in rules.RULES[:4]])
    return journal.select("entry_ref", F.explode(made).alias("m")).select("m.rule", "entry_ref", "m.mask").filter("mask <> 0")


def _splitting(journal: DataFrame, ps: list[Params]) -> DataFrame:
    size = F.abs("amount")
    made = [F.when((size >= p.split_threshold * p.split_ratio) & (size < p.split_threshold), F.struct(F.lit(i).alias("_v"), F.expr(f"datediff(posting_date, DATE'2000-01-01') div {p.split_days}").alias("_bucket"))) for i, p in enumerate(ps)]
    low = journal.filter("is_manual AND account IS NOT NULL").select("entry_ref", "account", size.alias("_size"), F.explode(F.array_compact(F.array(*made))).alias("m")).select("entry_ref", "account", "_size", "m.*")
    keys = ["_v", "account", "_bucket"]
    groups = zone(low.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum")))
    keep = (F.col("_n") >= _of([p.split_count for p in ps])) & (F.col("_sum") > _of([p.split_threshold for p in ps]))
    found = skew.join_groups(low.filter("_bucket IS NOT NULL"), groups, keys, "_n", keep)
    return _marks(found.withColumn("mask", _of([1 << i for i in range(len(ps))]).cast("long")), "entry_splitting")


def _balance(journal: DataFrame, ps: list[Params]) -> DataFrame:
    by = journal.groupBy("entry_ref").agg(F.abs(F.sum("amount")).alias("_net"))
    return _marks(by.withColumn("mask", _mask([F.col("_net") > p.balance_tolerance for p in ps])), "balance_check")


def _users(journal: DataFrame, ps: list[Params]) -> DataFrame:
    manual = journal.filter("is_manual AND username IS NOT NULL").select("entry_ref", "username")
    counts = zone(manual.groupBy("username").agg(F.count("*").alias("_n")))
    rare = skew.join_groups(manual, counts, ["username"], "_n", F.col("_n") <= max(p.rare_threshold for p in ps))
    listed = manual.withColumn("mask", _mask([F.col("username").isin(*p.high_risk_users) for p in ps]))
    return _marks(rare.withColumn("mask", _mask([F.col("_n") <= p.rare_threshold for p in ps])), "unusual_users").unionByName(_marks(listed, "unusual_users"))


def _pairs(journal: DataFrame, ps: list[Params], before: DataFrame) -> DataFrame:
    """``before``: marks of the rules whose entries are left out of the baseline, under each set those of the same set."""
    pairs = zone(rules.document_pairs(journal).select("entry_ref", "debit", "credit"))
    system = journal.filter("NOT is_manual").select("entry_ref").distinct()
    out = before.groupBy("entry_ref").agg(F.bit_or("mask").alias("_out"))
    excluding = F.lit(sum(1 << i for i, p in enumerate(ps) if p.exclude_flagged)).cast("long")
    clean = F.bitwise_not(F.coalesce("_out", F.lit(0).cast("long")).bitwiseAND(excluding))
    base = zone(pairs.join(system, "entry_ref", "left_semi").join(out, "entry_ref", "left").select("entry_ref", "debit", "credit", clean.alias("_own")))
    freq = base.groupBy("debit", "credit").agg(F.array(*[F.count_if(_has(F.col("_own"), i)) for i in range(len(ps))]).alias("_freq"))
    rows = pairs.join(freq, ["debit", "credit"], "left").join(base, ["entry_ref", "debit", "credit"], "left")
    own = F.coalesce("_own", F.lit(0).cast("long"))
    others = [F.coalesce(F.get("_freq", F.lit(i)), F.lit(0)) - F.when(_has(own, i), 1).otherwise(0) for i in range(len(ps))]
    return _marks(rows.withColumn("mask", _mask([n < p.min_baseline for n, p in zip(others, ps, strict=True)])), "unusual_pairs")


def _reversals(journal: DataFrame, ps: list[Params]) -> DataFrame:
    met = rules.reversal_matches(journal, ps[0].period_end, max(p.match_days for p in ps), max(p.reversal_tolerance for p in ps))
    late = F.datediff("r_posting_date", F.lit(ps[0].period_end))
    mask = _mask([(late <= p.match_days) & (F.abs(F.col("r_amount") + F.col("amount")) <= p.reversal_tolerance) for p in ps])
    return _marks(met.select(mask.alias("mask"), F.explode(F.array("entry_ref", "r_entry_ref")).alias("entry_ref")), "reversals")


def _high_risk(journal: DataFrame, ps: list[Params]) -> DataFrame:
    users = sorted({u for p in ps for u in p.high_risk_users})
    rows = journal.filter(~F.col("is_manual") & F.col("username").isin(*users)).select("entry_ref", "username", F.coalesce(F.concat(F.lit("="), "account"), F.lit("-")).alias("_account"))
    counts = zone(rows.groupBy("username", "_account").agg(F.count("*").alias("_n")))
    share = counts.join(F.broadcast(counts.groupBy("username").agg(F.sum("_n").alias("_of"))), "username")
    mask = _mask([F.col("username").isin(*p.high_risk_users) & (F.col("_n") / F.col("_of") < p.account_share) for p in ps])
    return _marks(skew.join_groups(rows, zone(share.withColumn("mask", mask)), ["username", "_account"], "_n", F.col("mask") != 0), "high_risk_system_pairs")


def marks(journal: DataFrame, variants: dict[str, Params]) -> DataFrame:
    """(rule, entry_ref, mask), written: the documents that each rule takes, with a bit for each set, in the order of ``variants``.

    All sets have one period end. The journal is read once for each kind of rule, not for each set.
    """
    ps = list(variants.values())
    if len(ps) > MOST or len({p.period_end for p in ps}) > 1:
        raise ValueError(f"at most {MOST} sets of one period end")
    one = lambda frames: zone(reduce(DataFrame.unionByName, frames).groupBy("rule", "entry_ref").agg(F.bit_or("mask").alias("mask")))
    first = one([_lines(journal, ps), _splitting(journal, ps), _balance(journal, ps), _users(journal, ps)])
    rest = one([_pairs(journal, ps, first.filter(F.col("rule").isin(*rules.BASELINE_OUT))), _reversals(journal, ps), _high_risk(journal, ps)])
    return first.unionByName(rest)


def scores(found: DataFrame, labels: DataFrame, names: list[str], scored: tuple[str, ...] = evaluate.SCORED) -> DataFrame:
    """(variant, rule, tp, fp, fn, precision, recall, f1) of marks: of each scored rule as evaluate.by_rule() has them, and of all as evaluate.total()."""
    found = found.filter(F.col("rule").isin(*scored))
    mask, labelled, known = F.coalesce("mask", F.lit(0).cast("long")), F.col("labelled").isNotNull(), F.col("known").isNotNull()
    any_label = labels.select("entry_ref").distinct()
    rows = found.join(labels.distinct().withColumn("labelled", F.lit(True)), ["rule", "entry_ref"], "full_outer").join(any_label.withColumn("known", F.lit(True)), "entry_ref", "left")
    both = found.groupBy("entry_ref").agg(F.bit_or("mask").alias("mask")).join(any_label.withColumn("labelled", F.lit(True)), "entry_ref", "full_outer")

    def counted(rows: DataFrame, rule: Column, flagged_only: Column) -> DataFrame:
        each = [F.struct(F.lit(v).alias("variant"), F.count_if(_has(mask, i) & labelled).alias("tp"), F.count_if(_has(mask, i) & flagged_only).alias("fp"), F.count_if(~_has(mask, i) & labelled).alias("fn")) for i, v in enumerate(names)]
        return rows.groupBy(rule.alias("rule")).agg(F.array(*each).alias("v")).select("rule", F.explode("v").alias("v")).select("v.variant", "rule", "v.tp", "v.fp", "v.fn")

    counts = counted(rows, F.col("rule"), ~known).unionByName(counted(both, F.lit(TOTAL), ~labelled))
    wanted = [(v, r) for v in names for r in (*scored, TOTAL)]
    grid = found.sparkSession.createDataFrame(wanted, "variant string, rule string")
    return evaluate.with_scores(F.broadcast(grid).join(counts, ["variant", "rule"], "left").na.fill(0, ["tp", "fp", "fn"]))


def flagged(found: DataFrame, names: list[str]) -> DataFrame:
    """(variant, rule, documents): how many documents each rule takes under each set."""
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.count_if(_has(F.col("mask"), i)).alias("documents")) for i, v in enumerate(names)])
    return found.groupBy("rule").agg(each.alias("v")).select("rule", F.explode("v").alias("v")).select("v.variant", "rule", "v.documents")
