"""The ten screening rules over the journal. Each returns rule, entry_ref, line_no, username, amount, flag_reason."""

from __future__ import annotations

import datetime as dt
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.operators import skew
from ledgersift.plans.params import Params
from ledgersift.plans.zones import zone

RULES = ("manual_entries", "period_end", "round_amounts", "date_divergence", "entry_splitting", "balance_check", "unusual_users", "unusual_pairs", "reversals", "high_risk_system_pairs")
GATING = RULES[:9]
#: Entries that any of these rules flags are left out of the baseline of account pairs.
BASELINE_OUT = RULES[:7]
#: Pairs of accounts up to this number are sent to all tasks.
BROADCAST_PAIRS = 200_000
OUT = ("rule", "entry_ref", "line_no", "username", "amount", "flag_reason")


def row_conditions(p: Params) -> dict[str, tuple[Column, Column]]:
    """Condition and reason of the rules that look at one line alone."""
    end = F.lit(p.period_end)
    gap = F.abs(F.datediff("posting_date", "document_date"))
    late = F.col("entry_created_date") > end
    first, last = p.period_end - dt.timedelta(p.window_days), p.period_end + dt.timedelta(p.post_close_days)
    return {
        "manual_entries": (F.col("is_manual"), F.concat(F.lit("manual entry ("), "entry_type_source", F.lit(")"))),
        "period_end": (F.col("is_manual") & F.col("posting_date").between(first, last), F.when(F.col("posting_date") > end, "manual entry after period end").otherwise("manual entry near period end")),
        "round_amounts": ((F.abs("amount") >= p.round_min) & (F.round(F.abs("amount"), 0).cast("bigint") % p.round_multiple == 0), F.lit(f"round amount (multiple of {p.round_multiple})")),
        "date_divergence": ((gap > p.gap_days) | late, F.when(gap > p.gap_days, F.concat(F.lit("document and posting date "), gap.cast("string"), F.lit(" days apart"))).otherwise("created after period end")),
    }


def line_rules(journal: DataFrame, p: Params) -> DataFrame:
    """The four row-local rules in one scan; rules that do not hold are nulls, left out after the explode (array_compact would run uncompiled)."""
    made = F.array(*[F.when(ok, F.struct(F.lit(rule).alias("rule"), why.alias("flag_reason"))) for rule, (ok, why) in row_conditions(p).items()])
    hits = journal.select("entry_ref", "line_no", "username", "amount", F.explode(made).alias("h")).filter("h IS NOT NULL")
    return hits.select(F.col("h.rule").alias("rule"), "entry_ref", "line_no", "username", "amount", F.col("h.flag_reason").alias("flag_reason"))


def line_rule(rule: str):
    def run(journal: DataFrame, p: Params) -> DataFrame:
        ok, why = row_conditions(p)[rule]
        return journal.filter(ok).select(F.lit(rule).alias("rule"), "entry_ref", "line_no", "username", "amount", why.alias("flag_reason"))

    return run


def _flag(df: DataFrame, rule: str, why: Column, line: str | Column = "line_no", user: str | Column = "username", amount: str | Column = "amount") -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(F.lit(rule).alias("rule"), "entry_ref", col(line).alias("line_no"), col(user).alias("username"), col(amount).cast("decimal(18,2)").alias("amount"), why.alias("flag_reason"))


def entry_splitting(journal: DataFrame, p: Params) -> DataFrame:
    """Several manual lines just under the threshold on one account within a window of days. Lines are counted before they meet their group."""
    size = F.abs("amount")
    low = journal.filter(F.col("is_manual") & F.col("account").isNotNull() & (size >= p.split_threshold * p.split_ratio) & (size < p.split_threshold))
    low = low.withColumn("_bucket", F.expr(f"datediff(posting_date, DATE'2000-01-01') div {p.split_days}")).filter("_bucket IS NOT NULL")
    low = low.select("entry_ref", "line_no", "username", "amount", "account", "_bucket")
    groups = zone(low.groupBy("account", "_bucket").agg(F.count("*").alias("_n"), F.sum(size).alias("_sum")))
    rows = skew.join_groups(low, groups, ["account", "_bucket"], "_n", (F.col("_n") >= p.split_count) & (F.col("_sum") > p.split_threshold))
    return _flag(rows, "entry_splitting", F.concat(F.col("_n").cast("string"), F.lit(" amounts under the threshold on account "), "account"))


def balance_check(journal: DataFrame, p: Params) -> DataFrame:
    by = journal.groupBy("entry_ref").agg(F.sum("amount").alias("net"), F.count("*").alias("n"), F.min("line_no").alias("line_no"), F.min("username").alias("username"))
    return _flag(by.filter(F.abs("net") > p.balance_tolerance), "balance_check", F.concat(F.lit("document nets to "), F.col("net").cast("decimal(18,2)").cast("string"), F.lit(" over "), F.col("n").cast("string"), F.lit(" lines")), amount="net")


def unusual_users(journal: DataFrame, p: Params) -> DataFrame:
    """Rare manual users, and configured users; one who is both gives two rows a line. Lines of frequent users do not move."""
    manual = journal.filter("is_manual AND username IS NOT NULL").select("entry_ref", "line_no", "username", "amount")
    counts = zone(manual.groupBy("username").agg(F.count("*").alias("_n")))
    rare = skew.join_groups(manual, counts, ["username"], "_n", F.col("_n") <= p.rare_threshold).withColumn("why", F.lit("rare manual user"))
    listed = manual.filter(F.col("username").isin(*p.high_risk_users)).withColumn("why", F.lit("high-risk user"))
    return _flag(rare.drop("_n").unionByName(listed), "unusual_users", F.concat("why", F.lit(": "), "username"))


def document_pairs(journal: DataFrame) -> DataFrame:
    """entry_ref, debit, credit, line_no, username: account pairs of opposite sign within a document; line and user are the lower line's.

    Lines meet the document's accounts of the other side, not its lines: a line is the lower one of some pair if it stands before
    the last line on that account and side.
    """
    rows = journal.select("entry_ref", "line_no", "username", "account", F.signum("amount").cast("int").alias("side")).filter("side <> 0")
    # dealt by document first: the grouping by account, the join and the pairs all stay there
    sides = rows.repartition("entry_ref").groupBy("entry_ref", F.col("account").alias("other"), (-F.col("side")).alias("meets")).agg(F.max("line_no").alias("last"))
    both = rows.join(sides, "entry_ref").filter("side + meets = 2 * side AND line_no < last")  # side = meets would become a second key, and move all rows again
    debit, credit = F.when(F.col("side") > 0, F.col("account")).otherwise(F.col("other")), F.when(F.col("side") > 0, F.col("other")).otherwise(F.col("account"))
    return both.groupBy("entry_ref", debit.alias("debit"), credit.alias("credit")).agg(F.min("line_no").alias("line_no"), F.min("username").alias("username"))


def unusual_pairs(journal: DataFrame, p: Params, flagged: DataFrame | None = None) -> DataFrame:
    """Account pairs that too few other unflagged documents with a system line have; ``flagged`` holds the entries to leave out of the baseline.

    Pairs are made once, marked by whether their document is in the baseline, and written; a document has a pair once.
    """
    base = journal.filter("NOT is_manual").select("entry_ref").distinct()
    if p.exclude_flagged and flagged is not None:
        base = base.join(flagged.select("entry_ref").distinct(), "entry_ref", "left_anti")
    pairs = zone(document_pairs(journal).join(base.withColumn("own", F.lit(1)), "entry_ref", "left"))
    freq = zone(pairs.filter("own = 1 AND debit IS NOT NULL AND credit IS NOT NULL").groupBy("debit", "credit").agg(F.count("*").alias("freq")))
    rows = pairs.join(F.broadcast(freq) if freq.count() <= BROADCAST_PAIRS else freq, ["debit", "credit"], "left")
    rows = rows.withColumn("own", F.when(F.col("debit").isNotNull() & F.col("credit").isNotNull(), F.col("own")))
    other = F.coalesce("freq", F.lit(0)) - F.coalesce("own", F.lit(0))
    return _flag(rows.filter(other < p.min_baseline), "unusual_pairs", F.concat(F.lit("unusual pair "), "debit", F.lit("/"), "credit"), amount=F.lit(None))


def reversal_matches(journal: DataFrame, end: dt.date, days: int, tolerance: float) -> DataFrame:
    """Lines up to ``end`` beside the lines (r_...) of the same user and account that undo them within so many days after it.

    The opposite amount is found by buckets as wide as the tolerance, so the join stays an equi-join; hot keys are dealt over many tasks.
    The few late lines ask for three buckets each, the early ones stand in one.
    """
    width = float(max(tolerance, 0.01))
    rows = journal.select("entry_ref", "line_no", "username", "account", "amount", "posting_date").filter("username IS NOT NULL AND account IS NOT NULL")
    late = rows.filter((F.col("posting_date") > end) & (F.col("posting_date") <= end + dt.timedelta(days))).withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("amount") / width) + i)))
    early = rows.filter(F.col("posting_date") <= end).withColumn("_b", F.floor(-F.col("amount") / width))
    keys = ["account", "username", "_b"]
    hot = skew.hot_keys(early.select(*keys).unionByName(late.select(*keys)), keys)
    late = late.withColumnsRenamed({c: f"r_{c}" for c in ("entry_ref", "line_no", "amount", "posting_date")})
    met = skew.join_salted(early, late, keys, ["entry_ref", "line_no"], hot)
    return met.filter(F.abs(F.col("r_amount") + F.col("amount")) <= tolerance)


def reversals(journal: DataFrame, p: Params) -> DataFrame:
    """Lines up to the period end that are undone within the window after it; each match, and the undoing line once."""
    match = zone(reversal_matches(journal, p.period_end, p.match_days, p.reversal_tolerance))
    first = _flag(match, "reversals", F.concat(F.lit("reversed "), F.datediff("r_posting_date", F.lit(p.period_end)).cast("string"), F.lit(" days after period end by "), "username"))
    undone = match.select(F.col("r_entry_ref").alias("entry_ref"), F.col("r_line_no").alias("line_no"), "username", F.col("r_amount").alias("amount")).distinct()
    return first.unionByName(_flag(undone.join(first.select("entry_ref", "line_no"), ["entry_ref", "line_no"], "left_anti"), "reversals", F.lit("reverses an entry of the period")))


def high_risk_system_pairs(journal: DataFrame, p: Params) -> DataFrame:
    """System lines of configured users on accounts that make up little of their postings."""
    rows = journal.filter(~F.col("is_manual") & F.col("username").isin(*p.high_risk_users))
    # counted by user and account first, so no task holds all lines of one user
    counts = rows.groupBy("username", "account").agg(F.count("*").alias("n"))
    rare = counts.join(counts.groupBy("username").agg(F.sum("n").alias("of")), "username").filter(F.col("n") / F.col("of") < p.account_share)
    rare = rare.select(F.col("username").alias("_user"), F.col("account").alias("_account"))
    hits = rows.join(rare, (F.col("username") == F.col("_user")) & F.col("account").eqNullSafe(F.col("_account")), "left_semi")
    return _flag(hits, "high_risk_system_pairs", F.concat(F.lit("rare account "), F.coalesce("account", F.lit("(none)")), F.lit(" for "), "username"))


EMPTY = "rule string, entry_ref string, line_no int, username string, amount decimal(18,2), flag_reason string"
_MAKERS = {
    "entry_splitting": entry_splitting, "balance_check": balance_check, "unusual_users": unusual_users, "reversals": reversals,
    "high_risk_system_pairs": high_risk_system_pairs,
}


def parts(journal: DataFrame, p: Params, rules: tuple[str, ...] = RULES) -> list[DataFrame]:
    """Flags of the chosen rules but for unusual_pairs, the row-local ones in one frame; unknown names are an error."""
    if unknown := set(rules) - set(RULES):
        raise ValueError("unknown rules: " + ", ".join(sorted(unknown)))
    local = [line_rules(journal, p).filter(F.col("rule").isin(*rules))] if set(rules) & set(RULES[:4]) else []
    return local + [make(journal, p) for name, make in _MAKERS.items() if name in rules]


def _union(frames: list[DataFrame], journal: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else journal.sparkSession.createDataFrame([], EMPTY)


def flags(journal: DataFrame, p: Params, rules: tuple[str, ...] = RULES, baseline: tuple[str, ...] = BASELINE_OUT) -> DataFrame:
    """All flags of the chosen rules. Entries with flags of ``baseline`` are left out of the pair baseline.

    For the pair rule the others are written first, and the baseline's entries are read from there.
    """
    if "unusual_pairs" not in rules or set(rules) - set(RULES):
        return _union(parts(journal, p, rules), journal)
    made = zone(_union(parts(journal, p, tuple(r for r in RULES if r in rules or r in baseline)), journal))
    out = made.filter(F.col("rule").isin(*baseline)).select("entry_ref").distinct()
    return made.filter(F.col("rule").isin(*rules)).unionByName(unusual_pairs(journal, p, out))


def run(journal: DataFrame, p: Params, rules: tuple[str, ...] = RULES, write=None, makers: dict | None = None, workers: int = 1, seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Flags of all rules that work, and a row for each rule (rule, position, outcome, note).

    With ``write`` each rule's flags are written by themselves, so one that fails loses no other; its message becomes the note, and the
    pair rule leaves out the entries of those that worked. ``workers`` rules run at a time, each as a job group of its own; one that takes
    longer than ``seconds`` is cancelled alone. Unknown names are an error.
    """
    if unknown := set(rules) - set(RULES):
        raise ValueError("unknown rules: " + ", ".join(sorted(unknown)))
    known = {r: line_rule(r) for r in RULES[:4]} | _MAKERS | (makers or {})
    done, notes, context, name_of_run = {}, {}, journal.sparkSession.sparkContext, uuid.uuid4().hex

    def one(name: str) -> DataFrame:
        context.setJobGroup(f"{name_of_run}-{name}", f"rule {name}", interruptOnCancel=True)
        if name == "unusual_pairs" and name not in (makers or {}):
            out = [done[r].select("entry_ref") for r in BASELINE_OUT if r in done]
            made = unusual_pairs(journal, p, reduce(DataFrame.unionByName, out).distinct() if out else None)
        else:
            made = known[name](journal, p)
        return write(made) if write else made

    # the pair rule reads what the others found
    for batch in ([r for r in RULES if r in rules and r != "unusual_pairs"], [r for r in RULES if r in rules and r == "unusual_pairs"]):
        with ThreadPoolExecutor(max(workers, 1)) as pool:
            for name, job in [(name, pool.submit(inheritable_thread_target(journal.sparkSession)(one), name)) for name in batch]:
                try:
                    done[name] = job.result(seconds)
                    notes[name] = ("ok", None)
                except TimeoutError:
                    job.cancel()
                    context.cancelJobGroup(f"{name_of_run}-{name}")
                    notes[name] = ("cancelled", f"longer than {seconds} seconds")
                except Exception as problem:  # noqa: BLE001 - whatever a rule raises, the others go on
                    notes[name] = ("failed", str(problem).split("\n")[0][:200])
    rows = [(name, RULES.index(name), *notes[name]) for name in RULES if name in notes]
    return _union([done[r] for r in RULES if r in done], journal), journal.sparkSession.createDataFrame(rows, "rule string, position int, outcome string, note string")


def summary(found: DataFrame) -> DataFrame:
    """Flags of every rule, zeros kept."""
    names = found.sparkSession.createDataFrame([(r, i) for i, r in enumerate(RULES)], "rule string, position int")
    return names.join(found.groupBy("rule").agg(F.count("*").alias("flagged")), "rule", "left").select("rule", "position", F.coalesce("flagged", F.lit(0)).alias("flagged"))
