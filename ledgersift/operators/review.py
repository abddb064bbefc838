"""Cross-reference, review universe, statistics and sampling."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.operators.rules import GATING
from ledgersift.plans.params import Params
from ledgersift.plans.zones import zone


def document_amounts(journal: DataFrame) -> DataFrame:
    return journal.groupBy("entry_ref").agg(F.max(F.abs("amount")).alias("abs_amount"), F.max("amount").alias("amount"))


def line_hits(found: DataFrame) -> DataFrame:
    """Distinct gating rules and joined reasons of each flagged line; dealt by document, as the cross-reference goes on."""
    gating = found.filter(F.col("rule").isin(*GATING)).select("entry_ref", "line_no", "rule", "flag_reason").repartition("entry_ref")
    place = reduce(lambda c, x: c.when(F.col("rule") == x[1], 1 << x[0]), enumerate(GATING), F)
    return gating.groupBy("entry_ref", "line_no").agg(F.bit_count(F.bit_or(place)).cast("long").alias("rules_hit"), F.array_join(F.sort_array(F.collect_set("flag_reason")), " | ").alias("flag_reasons"))


def cross_reference(found: DataFrame, journal: DataFrame) -> DataFrame:
    return line_hits(found).join(document_amounts(journal), "entry_ref", "left").select("entry_ref", "line_no", "rules_hit", "abs_amount", "amount", "flag_reasons", F.lit("targeted").alias("selection_basis"))


def ranked(xref: DataFrame) -> DataFrame:
    return xref.orderBy(F.desc("rules_hit"), F.desc("abs_amount"), "entry_ref", "line_no")


def top_flags(found: DataFrame, k: int = 20) -> DataFrame:
    """The k largest flags of each rule."""
    w = Window.partitionBy("rule").orderBy(F.desc(F.abs("amount")), "entry_ref", "line_no", "flag_reason")
    return found.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def entry_rollup(xref: DataFrame, journal: DataFrame) -> DataFrame:
    money = journal.groupBy("entry_ref").agg(F.min("currency").alias("currency"))
    by = xref.groupBy("entry_ref").agg(F.max("rules_hit").alias("rules_hit"), F.max("abs_amount").cast("double").alias("abs_amount"), F.min("selection_basis").alias("selection_basis"))
    return by.join(money, "entry_ref", "left")


def rates(spark, p: Params) -> DataFrame:
    return spark.createDataFrame([(c.upper(), float(r)) for c, r in p.fx] + [(p.base_currency.upper(), 1.0)], "ccy string, rate double")


def fx_missing(entries: DataFrame, p: Params) -> DataFrame:
    """Currencies of the entries that have no rate."""
    present = entries.select(F.upper(F.coalesce("currency", F.lit(p.base_currency))).alias("ccy")).distinct()
    return present.join(F.broadcast(rates(entries.sparkSession, p)), "ccy", "left_anti")


def base_amounts(entries: DataFrame, p: Params) -> DataFrame:
    ccy = entries.withColumn("ccy", F.upper(F.coalesce("currency", F.lit(p.base_currency))))
    return ccy.join(F.broadcast(rates(entries.sparkSession, p)), "ccy", "left").withColumn("base_amount", F.col("abs_amount") * F.coalesce("rate", F.lit(1.0))).drop("rate")


def material(entries: DataFrame, p: Params) -> DataFrame:
    """Entries at or above materiality in the base currency; representative ones stay whatever their amount."""
    return base_amounts(entries, p).filter((F.col("base_amount") >= p.materiality) | (F.col("selection_basis") == "representative"))


def capped(entries: DataFrame, p: Params) -> DataFrame:
    """The first entries by hits and amount, up to the cap; under the policy ``pause`` more than that is an error."""
    if p.overflow == "pause" and (n := entries.count()) > p.universe_cap:
        raise ValueError(f"{n} entries exceed the cap of {p.universe_cap}")
    return entries.orderBy(F.desc("rules_hit"), F.desc("base_amount"), "entry_ref").limit(p.universe_cap)


def allocation(entries: DataFrame, p: Params) -> DataFrame:
    """Places for each currency: minimums first, then up to top_n, both greedily in order of volume with forced currencies first.

    The windows without a partition run over one row a currency.
    """
    by = entries.groupBy(F.upper(F.coalesce("currency", F.lit(p.base_currency))).alias("ccy")).agg(F.count("*").alias("n"), F.sum("abs_amount").alias("volume"))
    order = Window.orderBy(F.when(F.col("ccy").isin(*p.forced), 0).otherwise(1), F.desc("volume"), "ccy")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    take = lambda want, room: F.greatest(F.lit(0), F.least(F.col(want), room - F.coalesce(F.sum(want).over(before), F.lit(0))))
    first = by.withColumn("want", F.least(F.lit(p.minimum_per_currency), "n")).withColumn("floor", take("want", F.lit(p.universe_cap)))
    left = F.lit(p.universe_cap) - F.sum("floor").over(Window.partitionBy())
    second = first.withColumn("more", F.least(F.lit(p.top_n), "n") - F.col("floor")).withColumn("left", left)
    return second.withColumn("extra", take("more", F.col("left"))).select("ccy", "n", F.round("volume", 2).alias("volume"), (F.col("floor") + F.col("extra")).cast("long").alias("alloc"))


def _placed(entries: DataFrame, p: Params, most: int) -> DataFrame:
    """The first ``most`` entries of each currency; the limit on the place is applied before rows move."""
    w = Window.partitionBy("ccy").orderBy(F.desc("abs_amount"), "entry_ref")
    rows = entries.withColumn("ccy", F.upper(F.coalesce("currency", F.lit(p.base_currency))))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def stratified(entries: DataFrame, p: Params) -> DataFrame:
    """The chosen entries with their place within the currency; no currency gets more than top_n or its minimum."""
    most = max(p.top_n, p.minimum_per_currency)
    return _placed(entries, p, most).join(F.broadcast(allocation(entries, p).select("ccy", "alloc")), "ccy").filter(F.col("place") <= F.col("alloc"))


def excluded_currencies(entries: DataFrame, p: Params) -> DataFrame:
    """Currencies with entries left out: how many, the currency's share of all volume, the largest one left out."""
    alloc = allocation(entries, p)
    largest = _placed(entries, p, max(p.top_n, p.minimum_per_currency) + 1).join(F.broadcast(alloc.select("ccy", "alloc")), "ccy")
    largest = largest.filter(F.col("place") == F.col("alloc") + 1).select("ccy", F.round("abs_amount", 2).alias("largest"))
    volume = entries.groupBy(F.upper(F.coalesce("currency", F.lit(p.base_currency))).alias("ccy")).agg(F.sum("abs_amount").alias("volume"))
    share = F.round(F.col("volume") / F.sum("volume").over(Window.partitionBy()), 6)  # one row a currency
    return alloc.drop("volume").join(volume.withColumn("volume_share", share), "ccy").join(largest, "ccy").select("ccy", (F.col("n") - F.col("alloc")).alias("entries"), "volume_share", "largest")


def universe(entries: DataFrame, p: Params) -> DataFrame:
    """Material entries up to the cap if all currencies have rates, else an allocation by currency."""
    if fx_missing(entries, p).isEmpty():
        return capped(material(entries, p), p).select("entry_ref", "rules_hit", "abs_amount", "currency", "selection_basis")
    return stratified(entries, p).select("entry_ref", "rules_hit", "abs_amount", "currency", "selection_basis")


def selection_notes(entries: DataFrame, p: Params) -> DataFrame:
    """What the selection did: (note_id, note); the fallback by currency, honoured forced currencies, representative entries, the cap."""
    spark = entries.sparkSession
    missing = fx_missing(entries, p)
    fallback = missing.agg(F.array_join(F.array_sort(F.collect_list("ccy")), ", ").alias("c")).filter("c <> ''")
    rows = [fallback.select(F.lit("currency_stratified_fallback").alias("note_id"), F.concat(F.lit("no rates for "), "c", F.lit("; first entries by currency taken, capped in all")).alias("note"))]
    present = entries.select(F.upper(F.coalesce("currency", F.lit(p.base_currency))).alias("ccy")).distinct()
    forced = present.filter(F.col("ccy").isin(*p.forced)).agg(F.array_join(F.array_sort(F.collect_list("ccy")), ", ").alias("c")).filter("c <> ''")
    rows.append(forced.select(F.lit("forced_currencies").alias("note_id"), F.concat(F.lit("forced currencies present: "), "c").alias("note")))
    basis = entries.filter("selection_basis = 'representative'").agg(F.count("*").alias("n")).filter("n > 0")
    rows.append(basis.select(F.lit("representative").alias("note_id"), F.concat(F.col("n").cast("string"), F.lit(" sampled entries past the materiality filter")).alias("note")))
    above = material(entries, p).agg(F.count("*").alias("n")).filter(F.col("n") > p.universe_cap)
    rows.append(above.select(F.lit("cap").alias("note_id"), F.concat(F.col("n").cast("string"), F.lit(f" material entries, the first {p.universe_cap} taken")).alias("note")))
    return reduce(DataFrame.unionByName, rows, spark.createDataFrame([], "note_id string, note string"))


def active_limitations(entries: DataFrame, p: Params, warnings: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Ids of the limitations to accept: the fallback by currency, each currency with entries left out by it, critical warnings not acknowledged."""
    missing = fx_missing(entries, p).agg((F.count("*") > 0).alias("fallback"))
    fallback = missing.filter("fallback").select(F.lit("currency_stratified_fallback").alias("id"))
    left_out = excluded_currencies(entries, p).crossJoin(F.broadcast(missing)).filter("fallback").select(F.concat(F.lit("currency_excluded_"), "ccy").alias("id"))
    critical = warnings.filter("severity = 'critical'").join(acknowledged.select("warning_id"), "warning_id", "left_anti")
    return fallback.unionByName(left_out).unionByName(critical.select(F.concat(F.lit("dq_"), F.regexp_replace("warning_id", "^dq_", "")).alias("id")))


def _band(mad: Column, n: Column) -> Column:
    # fixed values: conformity bands of the mean absolute deviation of first digits
    return F.when(n < 100, "insufficient").when(mad < 0.004, "close").when(mad < 0.008, "acceptable").when(mad < 0.010, "marginal").otherwise("nonconforming")


def benford_digits(journal: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and shares of first digits, all nine for each group, with the expected share and its 95 % interval."""
    digit = F.substring(F.floor(F.abs("amount")).cast("string"), 1, 1).cast("int")
    counts = journal.filter(F.abs("amount") >= 1).groupBy(*keys, digit.alias("digit")).agg(F.count("*").alias("cnt"))
    spark = journal.sparkSession
    nine = spark.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    totals = counts.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    grid = totals.crossJoin(F.broadcast(nine))
    p = F.log10(1 + 1 / F.col("digit"))
    both = grid.join(counts, [*keys, "digit"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    half = 1.96 * F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) / F.col("n"))
    return both.select(*keys, "digit", "cnt", "n", F.round(F.col("cnt") / F.col("n"), 6).alias("share"), F.round(p, 6).alias("expected"), F.round(F.greatest(p - half, F.lit(0.0)), 6).alias("low"), F.round(p + half, 6).alias("high"), (F.abs(F.col("cnt") / F.col("n") - p)).alias("_gap"))


def benford(journal: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    by = benford_digits(journal, keys).groupBy(*keys).agg(F.max("n").alias("n"), (F.sum("_gap") / 9).alias("_mad"))
    return by.select(*keys, "n", F.round("_mad", 6).alias("mad"), _band(F.col("_mad"), F.col("n")).alias("band"))


def outliers(journal: DataFrame, z: float = 4.0, keys: tuple[str, ...] = ("account",), least: int = 30, most: int = 200) -> DataFrame:
    """The ``most`` lines furthest out: z-scores of log amounts within groups of ``least`` lines or more, from means and deviations rounded to 4 places."""
    rows = journal.filter((F.col("amount") != 0) & F.col("account").isNotNull()).withColumn("x", F.log10(F.abs("amount") + 1))
    by = rows.groupBy(*keys).agg(F.round(F.avg("x"), 4).alias("mean"), F.stddev_pop("x").alias("_std"), F.count("*").alias("n")).filter(F.col("n") >= least)
    std = F.round(F.when(F.col("_std") == 0, 1e-9).otherwise(F.col("_std")), 4)
    score = (F.col("x") - F.col("mean")) / F.when(std == 0, 1e-9).otherwise(std)
    far = rows.join(by, list(keys)).withColumn("_z", score).filter(F.abs("_z") >= z)
    return far.orderBy(F.desc(F.abs("_z")), "entry_ref", "line_no").limit(most).withColumn("z", F.round("_z", 3)).drop("_z")


#: Leading hexadecimal digits of a sampling key by which documents are counted before any are ordered.
KEY_DIGITS = 4


def sample(journal: DataFrame, p: Params, stratum: Column | None = None) -> DataFrame:
    """A seeded sample of documents by stratum (month by default); each stratum's share is rounded half to even, the last one takes the rest.

    The documents with the smallest keys are taken. Counts by the first digits of the keys, added up in the tasks, tell up to which digits a
    stratum's share reaches; only documents up to there are put in order.
    """
    s = F.date_format("posting_date", "yyyy-MM") if stratum is None else stratum
    key = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce("entry_ref", F.lit(""))).cast("binary"), 256)
    docs = zone(journal.groupBy("entry_ref").agg(F.min(s).alias("stratum")).withColumn("_key", key))
    by = docs.groupBy("stratum").agg(F.count("*").alias("n"))
    whole, order = Window.partitionBy(), Window.orderBy("stratum")
    total = F.sum("n").over(whole)
    target = F.least(F.lit(p.sample_size), total)
    last = F.row_number().over(Window.orderBy(F.desc("stratum"))) == 1
    share = by.withColumn("target", target).withColumn("want", F.greatest(F.lit(1), F.bround(F.col("n") / total * target, 0).cast("int"))).withColumn("last", last)
    ahead = F.coalesce(F.sum("want").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.col("target") - ahead)
    alloc = share.withColumn("alloc", F.least("n", F.when(F.col("last"), room).otherwise(F.least("want", room)))).select("stratum", "alloc")
    digits = F.left("_key", F.lit(KEY_DIGITS))
    counts = docs.groupBy("stratum", digits.alias("_digits")).agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("stratum").orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = counts.withColumn("_ahead", ahead).join(alloc, "stratum").filter(F.col("_ahead") < F.col("alloc")).groupBy("stratum").agg(F.max("_digits").alias("_reach"), F.max("alloc").alias("alloc"))
    near = docs.join(reach, "stratum").filter(digits <= F.col("_reach"))
    rows = near.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("_key", "entry_ref")))
    return rows.filter(F.col("place") <= F.col("alloc")).select("entry_ref", "stratum", F.lit("representative").alias("selection_basis"))


def with_sample(xref: DataFrame, chosen: DataFrame, journal: DataFrame) -> DataFrame:
    """The cross-reference and the sampled documents that it lacks, with no hits."""
    new = chosen.join(xref.select("entry_ref").distinct(), "entry_ref", "left_anti")
    by = journal.join(new.select("entry_ref"), "entry_ref", "left_semi").groupBy("entry_ref").agg(F.min("line_no").alias("line_no"), F.max(F.abs("amount")).alias("abs_amount"), F.max("amount").alias("amount"))
    return xref.unionByName(by.select("entry_ref", "line_no", F.lit(0).cast("long").alias("rules_hit"), "abs_amount", "amount", F.lit("representative sample").alias("flag_reasons"), F.lit("representative").alias("selection_basis")))


def population(journal: DataFrame) -> DataFrame:
    """Counts over the whole journal in one pass."""
    return journal.agg(
        F.min("posting_date").alias("first_date"), F.max("posting_date").alias("last_date"), F.count("*").alias("n"), F.count_if(F.col("amount") < 0).alias("negatives"), F.count_if(F.col("amount") > 0).alias("positives"),
        F.count_if(F.col("username").isNull()).alias("no_user"), F.count_if(F.coalesce("description", F.lit("")) == "").alias("no_description"),
        F.count_if(F.coalesce("currency", F.lit("")) == "").alias("no_currency"),
    )


#: Classes of data-quality warnings with their severity and whether they cannot be dismissed.
WARNINGS = {
    "dq_duplicate_line_keys": ("critical", False), "dq_sign_convention": ("warning", False), "dq_period_coverage": ("critical", False), "dq_missing_fields": ("info", False),
    "dq_unbalanced_docs": ("critical", False), "dq_duplicate_extract": ("critical", True), "dq_extract_shortfall_declared": ("critical", True), "dq_no_post_close_coverage": ("warning", False),
}


def _warning(name: str, count: Column, detail: Column) -> Column:
    level, fixed = WARNINGS[name]
    return F.struct(F.lit(name).alias("warning_id"), F.lit(level).alias("severity"), F.lit(fixed).alias("non_dismissible"), count.cast("long").alias("count"), detail.alias("detail"))


def warnings(journal: DataFrame, p: Params, typed_rows: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """Data-quality warnings that apply: id, severity, whether they cannot be dismissed, count, detail.

    ``typed_rows`` are those of the ingest (status), for keys that stood twice; ``copies`` (extract, earlier_run, earlier) are extracts
    loaded before, a warning each. Without a declared date no shortfall is found and the cover ends with the last posting. A journal
    without lines has no warnings but of cover.
    """
    s = population(journal).crossJoin(journal.groupBy("entry_ref").agg(F.sum("amount").alias("net")).agg(F.count_if(F.abs("net") > p.balance_tolerance).alias("unbalanced")))
    end, last, one = F.lit(p.period_end), F.col("last_date"), F.lit(1)
    declared = F.lit(p.declared_through).cast("date")
    covered = F.least(last, declared)
    lack = [F.when(F.col(f"no_{c}") > 0, F.concat(F.lit(f"{name} "), F.col(f"no_{c}").cast("string"), F.lit("/"), F.col("n").cast("string"))) for c, name in (("description", "description"), ("user", "username"), ("currency", "currency"))]
    fields = F.array_compact(F.array(*lack))
    made = F.array(
        F.when((F.col("negatives") == 0) & (F.col("positives") > 0), _warning("dq_sign_convention", one, F.concat(F.lit("no negative amounts in "), F.col("n").cast("string"), F.lit(" lines")))),
        F.when(last < F.trunc(end, "year"), _warning("dq_period_coverage", one, F.concat(F.lit("last posting "), last.cast("string"), F.lit(" before the year")))),
        F.when(F.col("first_date") > end, _warning("dq_period_coverage", one, F.concat(F.lit("first posting "), F.col("first_date").cast("string"), F.lit(" after the period")))),
        F.when(F.size(fields) > 0, _warning("dq_missing_fields", F.size(fields), F.array_join(fields, "; "))),
        F.when(last < declared, _warning("dq_extract_shortfall_declared", one, F.concat(F.lit("last posting "), last.cast("string"), F.lit(" before the declared "), declared.cast("string")))),
        F.when(
            covered < F.date_add(end, p.match_days),
            _warning("dq_no_post_close_coverage", F.greatest(F.datediff(covered, end), F.lit(0)), F.concat(F.lit("covered to "), covered.cast("string"), F.lit(", reversals need "), F.date_add(end, p.match_days).cast("string"))),
        ),
        F.when(F.col("unbalanced") > 0, _warning("dq_unbalanced_docs", F.col("unbalanced"), F.lit("documents do not balance"))),
    )
    found = s.select(F.inline(F.array_compact(made)))
    if typed_rows is not None:
        twice = typed_rows.agg(F.count_if(F.col("status") == "duplicate").alias("n")).filter("n > 0")
        found = found.unionByName(twice.select(_warning("dq_duplicate_line_keys", F.col("n"), F.lit("keys of entry and line stood before")).alias("w")).select("w.*"))
    if copies is not None:
        same = F.concat(F.col("extract"), F.lit(" has the lines of "), F.col("earlier"), F.lit(" of run "), F.col("earlier_run"))
        found = found.unionByName(copies.select(_warning("dq_duplicate_extract", one, same).alias("w")).select("w.*"))
    return found


def self_check(journal: DataFrame, p: Params, first: dt.date, last: dt.date) -> DataFrame:
    """For each entry: balanced, lines 1..n, one user, one kind of entry, one currency, all postings within the window."""
    by = journal.groupBy("entry_ref").agg(
        F.sum("amount").alias("net"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.count("*").alias("n"), F.countDistinct("line_no").alias("d"),
        F.countDistinct("username").alias("u"), F.countDistinct("is_manual").alias("k"), F.countDistinct("currency").alias("c"), F.min("posting_date").alias("a"), F.max("posting_date").alias("z"),
    )
    contiguous = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))
    return by.select(
        "entry_ref", (F.abs("net") <= p.balance_tolerance).alias("balanced"), contiguous.alias("contiguous"), (F.col("u") <= 1).alias("one_user"),
        (F.col("k") <= 1).alias("one_kind"), (F.col("c") <= 1).alias("one_currency"), ((F.col("a") >= F.lit(first)) & (F.col("z") <= F.lit(last))).alias("in_window"),
    )


def duplicate_extracts(new: DataFrame, known: DataFrame) -> DataFrame:
    """Warning rows dq_duplicate_extract for extracts (path, sha256) whose digest an earlier run (run_id, sha256) has."""
    both = new.join(known.withColumnRenamed("run_id", "earlier"), "sha256")
    return both.groupBy("path").agg(F.count("*").alias("count"), F.min("earlier").alias("first")).select(
        F.lit("dq_duplicate_extract").alias("warning_id"), F.lit("critical").alias("severity"), F.lit(True).alias("non_dismissible"), "count",
        F.concat(F.lit("same content as run "), F.col("first").cast("string"), F.lit(": "), "path").alias("detail"),
    )


#: Account groups are the first two characters; bands are powers of ten of the amount.
def account_band(account: Column, amount: Column) -> Column:
    """A stratum for sampling: account group and amount band."""
    size = F.when(amount == 0, -1).otherwise(F.floor(F.log10(F.abs(amount)))).cast("int")
    return F.concat_ws("/", F.coalesce(F.substring(account, 1, 2), F.lit("--")), size.cast("string"))
