"""Hot keys, sampling by counted keys, sweeps, loads, isolated rules and digests."""

import datetime as dt
import hashlib
import time
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import functions as F

from ledgersift.operators import evaluate, review, rules, skew, sweep
from ledgersift.plans.params import Params
from ledgersift.plans.zones import zone
from ledgersift.sources import ledger

P = Params(period_end=dt.date(2026, 6, 30), rare_threshold=3, balance_tolerance=40, split_count=3, match_days=20, account_share=0.2, high_risk_users=("U1", "S1"))
SCHEMA = (
    "entry_ref string, line_no int, posting_date date, document_date date, entry_created_date date, account string, username string, is_manual boolean, "
    "entry_type_source string, amount decimal(18,2), currency string, description string, source_doc string"
)


def journal(spark, n=400):
    """Lines of which one batch user and one account hold more than a third."""
    rows = []
    for i in range(n):
        user = "BATCH" if i % 5 < 2 else f"{'S' if i % 2 else 'U'}{i % 23}"
        day = dt.date(2026, 6, 1) + dt.timedelta(i * 7 % 45)
        amount = Decimal((9000 + i * 13 % 1200) if i % 3 else (i * 37 % 300) * 100 - 12000)
        rows.append((f"JE{i // 2}", i % 2 + 1, day, day - dt.timedelta(i % 9), day, None if i % 31 == 0 else str(1000 + (0 if i % 5 < 2 else i % 7)), None if i % 29 == 0 else user, i % 2 == 0 or i % 5 < 2, "derived", amount if i % 2 else -amount, "USD", "d", None))
    return spark.createDataFrame(rows, SCHEMA)


def test_hot_keys_are_dealt_over_tasks(spark):
    """One key with a third of all rows: joins give the same rows, and no task holds more than an eighth of them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 4001)).alias("k")).repartition(16)
        others = rows.select("k").distinct().withColumn("v", F.length("k"))
        assert [r.k for r in skew.hot_keys(rows, ["k"]).collect()] == ["hot"]
        met = skew.join_salted(rows, others, ["k"], ["id"], skew.hot_keys(rows, ["k"]))
        groups = zone(rows.groupBy("k").agg(F.count("*").alias("n")))
        joined = skew.join_groups(rows, groups, ["k"], "n")
        for got in (met, joined):
            assert got.count() == 30000 and got.select("id").distinct().count() == 30000
            assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 30000 / 8
        assert skew.join_groups(rows, groups, ["k"], "n", F.col("n") <= 5).filter("k = 'hot'").count() == 0
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sweep_equals_the_rules_set_by_set(spark):
    j = zone(journal(spark))
    sets = {
        "a": P, "b": replace(P, window_days=1, round_multiple=500, gap_days=2, split_ratio=0.8, split_days=30, balance_tolerance=3000, rare_threshold=9, match_days=5, high_risk_users=("U3",), account_share=0.9),
        "c": replace(P, min_baseline=3, exclude_flagged=False, reversal_tolerance=900, split_count=6, split_threshold=9700, post_close_days=2, round_min=100, rare_threshold=0, high_risk_users=()),
    }
    found, labels = zone(sweep.marks(j, sets)), evaluate.hash_labels(j)
    docs = {(r.variant, r.rule): r.documents for r in sweep.flagged(found, list(sets)).collect() if r.documents}
    scored = {(r.variant, r.rule): (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in sweep.scores(found, labels, list(sets)).collect()}
    assert len(scored) == 3 * 10
    for name, p in sets.items():
        flags = zone(rules.flags(j, p))
        assert {(name, r.rule): r["count"] for r in flags.select("rule", "entry_ref").distinct().groupBy("rule").count().collect()} == {k: n for k, n in docs.items() if k[0] == name}
        for r in evaluate.by_rule(flags, labels, evaluate.SCORED).collect():
            assert scored[name, r.rule] == (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1)
        t = evaluate.total(flags, labels).first()
        assert scored[name, sweep.TOTAL] == (t.tp, t.fp, t.fn, t.precision, t.recall, t.f1)


def test_sample_takes_the_smallest_keys_of_each_stratum(spark):
    j, p = journal(spark, 900), replace(P, sample_size=40)
    got = review.sample(j, p).collect()
    month = {}
    for r in j.select("entry_ref", F.date_format("posting_date", "yyyy-MM").alias("m")).collect():
        month[r.entry_ref] = min(month.get(r.entry_ref, r.m), r.m)
    assert len(got) == 40 and all(r.stratum == month[r.entry_ref] for r in got)
    for m in set(month.values()):
        order = sorted((e for e, x in month.items() if x == m), key=lambda e: hashlib.sha256(f"42:{e}".encode()).hexdigest())
        chosen = {r.entry_ref for r in got if r.stratum == m}
        assert chosen == set(order[: len(chosen)])


def test_load_counts_while_it_writes(spark, tmp_path):
    raw = spark.createDataFrame([(i, f"E{i % 7}" if i % 5 else None, "1", "2026-04-05", str(i), "U") for i in range(50)], "staging_seq long, ENTRY string, LINE string, POST string, AMOUNT string, USERID string")
    t = ledger.typed(ledger.bind_columns(raw, {"entry_ref": "entry", "posting_date": "post", "amount": "amount", "username": "userid"}), P)
    lines, rejects, figures = ledger.load(t, P, str(tmp_path / "x"))
    assert figures.first() == ledger.reconcile(t, P).first() and figures.first().paused
    assert sorted(lines.collect()) == sorted(ledger.journal_of(t).collect()) and sorted(rejects.collect()) == sorted(ledger.rejects_of(t).collect())


def test_rules_run_apart_and_fail_or_stop_alone(spark):
    j = zone(journal(spark, 60))

    def breaks(journal, p):
        return journal.select(F.raise_error(F.lit("in a task")).cast("string").alias("rule"), "entry_ref", "line_no", "username", "amount", F.lit("").alias("flag_reason"))

    def hangs(journal, p):
        time.sleep(30)
        return rules.balance_check(journal, p)

    whole = rules.run(j, P, write=zone)[0]
    found, notes = rules.run(j, P, write=zone, makers={"reversals": breaks, "balance_check": hangs}, workers=4, seconds=20)
    outcome = {r.rule: (r.outcome, r.note) for r in notes.collect()}
    assert outcome["reversals"][0] == "failed" and outcome["balance_check"][0] == "cancelled" and sum(o == "ok" for o, _ in outcome.values()) == 8
    kept = found.groupBy("rule").count()
    assert {tuple(r) for r in kept.filter("rule <> 'unusual_pairs'").collect()} == {tuple(r) for r in whole.groupBy("rule").count().filter("rule NOT IN ('reversals', 'balance_check', 'unusual_pairs')").collect()}


def test_digests_place_a_change(spark):
    one = zone(spark.range(5000).select(F.concat(F.lit("E"), F.col("id")).alias("entry_ref"), (F.col("id") % 9).alias("x")))
    two = zone(one.withColumn("x", F.when(F.col("entry_ref") == "E77", 100).otherwise(F.col("x"))).filter("entry_ref <> 'E78'").repartition(7))
    trees = [zone(evaluate.digest_tree(evaluate.digests(t, "entry_ref"))) for t in (one, two)]
    assert evaluate.differing(trees[0], evaluate.digest_tree(evaluate.digests(one.repartition(9), "entry_ref"))).count() == 0
    nodes = evaluate.differing(*trees)
    parts = {hashlib.md5(e.encode()).hexdigest()[:2] for e in ("E77", "E78")}
    assert {r.node for r in nodes.collect()} == parts | {x[0] for x in parts} | {""}
    got = sorted(tuple(r) for r in evaluate.changed_rows(one, two, "entry_ref", nodes).collect())
    assert got == [("E77", 5, 1), ("E77", 100, 2), ("E78", 6, 1)]


def test_documents_move_once_a_step(spark):
    """Pairs and the cross-reference deal each of their inputs by document once; early lines are not multiplied to find what reverses them."""
    j = zone(journal(spark))
    found = rules.line_rules(j, P)
    moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moves(rules.document_pairs(j)) == 2
        assert moves(review.cross_reference(found, j)) == 2
        met = rules.reversal_matches(j, P.period_end, P.match_days, P.reversal_tolerance)
        early = met._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
        assert early.count("Generate explode") == 2  # the late lines' buckets and salts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_line_steps_are_compiled(spark):
    """The rules by line and the reasons of a line use no function with a lambda, which Spark would run uncompiled with all that is inside it."""
    j = zone(journal(spark))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = rules.line_rules(j, P)
    assert "lambda" not in plan(found) and "lambda" not in plan(review.line_hits(found))


def test_few_groups_leave_rows_where_they_are(spark, monkeypatch):
    """Few groups are sent to all tasks, so no row moves; many are joined as before, with the same rows."""
    rows = zone(spark.range(500).select("id", (F.col("id") % 40).alias("k")))
    groups = zone(rows.groupBy("k").agg(F.count("*").alias("n")))
    few = skew.join_groups(rows, groups, ["k"], "n", F.col("n") > 12)
    assert "Union" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(skew, "FEW", 1)
    many = skew.join_groups(rows, groups, ["k"], "n", F.col("n") > 12)
    assert "Union" in many._jdf.queryExecution().executedPlan().toString() and sorted(few.collect()) == sorted(many.collect())
