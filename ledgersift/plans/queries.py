"""Journal, rules, cross-reference, universe, statistics, data quality and ingest as queries, each beside SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ledgersift.operators import review, rules
from ledgersift.plans.params import LEDGER as P
from ledgersift.plans.shared import FLAG_SQL, P_CAP, P_SAMPLE, RAW_MAP, Run, query, raw_lines
from ledgersift.plans.zones import shared_folder
from ledgersift.sources import ledger

query("journal", "SELECT * FROM J", "j")(lambda z: z.lines)
for _rule in rules.RULES:
    if _rule != "unusual_pairs":
        query(f"rule_{_rule}", FLAG_SQL[_rule], "jp")(lambda z, _rule=_rule: rules.flags(z.lines, P, (_rule,)))
query("rule_unusual_pairs", FLAG_SQL["unusual_pairs"], "jp")(lambda z: rules.flags(z.journal, P, ("unusual_pairs",)))
query("flags_all", "SELECT * FROM FL", "jpf")(lambda z: z.found)
query(
    "rule_set",
    """SELECT rule, 'ok' AS outcome, count(*) AS flagged FROM FL WHERE rule IN ('period_end', 'balance_check') GROUP BY rule
    UNION ALL SELECT 'reversals', 'failed', 0""",
    "jpf",
)(lambda z: _rule_set(z))


def _rule_set(z: Run):
    """A chosen set of rules, one of which is made to fail: the others keep their flags."""

    def broken(journal, p):
        raise RuntimeError("out of order")

    found, notes = rules.run(z.journal, P, ("reversals", "period_end", "balance_check"), makers={"reversals": broken})
    return notes.join(found.groupBy("rule").agg(F.count("*").alias("flagged")), "rule", "left").select("rule", "outcome", F.coalesce("flagged", F.lit(0)).alias("flagged"))


query(
    "rule_summary",
    """SELECT r AS rule, CAST(i AS INT) AS position, (SELECT count(*) FROM FL WHERE FL.rule = r) AS flagged
    FROM (SELECT unnest([""" + ",".join(f"'{r}'" for r in rules.RULES) + "]) AS r, unnest(range(10)) AS i)",
    "jpf",
)(lambda z: rules.summary(z.found))
query("line_hits", "SELECT * FROM LH", "jpfx")(lambda z: review.line_hits(z.found))
query("document_amounts", "SELECT entry_ref, max(abs(amount)) AS abs_amount, max(amount) AS amount FROM J GROUP BY entry_ref", "j")(lambda z: review.document_amounts(z.lines))
query("cross_reference", "SELECT * FROM XR", "jpfx")(lambda z: z.xref)
query("flagged_documents", "SELECT count(DISTINCT entry_ref) AS documents FROM XR", "jpfx")(lambda z: z.xref.agg(F.countDistinct("entry_ref").alias("documents")))
query("top_ranked", "SELECT * FROM XR ORDER BY rules_hit DESC, abs_amount DESC, entry_ref, line_no LIMIT 10", "jpfx")(lambda z: review.ranked(z.xref).limit(10))
TOP = """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rule ORDER BY abs(amount) DESC NULLS LAST, entry_ref, line_no, flag_reason) AS INT) AS position
    FROM FL) WHERE position <= """
query("top_flags_per_rule", TOP + "20", "jpf")(lambda z: review.top_flags(z.found))
query("top_volume_per_rule", TOP + "5", "jpf")(lambda z: review.top_flags(z.found, 5))
query("entry_rollup", "SELECT * FROM EN", "jpfxu")(lambda z: z.entries)
query("fx_missing", "SELECT DISTINCT ccy FROM BA WHERE ccy NOT IN (SELECT ccy FROM FX)", "jpfxu")(lambda z: review.fx_missing(z.entries, P))
query("base_amounts", "SELECT entry_ref, ccy, round(base_amount, 4) AS base_amount FROM BA", "jpfxu")(
    lambda z: review.base_amounts(z.entries, P).select("entry_ref", "ccy", F.round("base_amount", 4).alias("base_amount"))
)
query("material_entries", "SELECT entry_ref, round(base_amount, 4) AS base_amount FROM BA WHERE base_amount >= 100000", "jpfxu")(
    lambda z: review.material(z.entries, P).select("entry_ref", F.round("base_amount", 4).alias("base_amount"))
)
query("universe", "SELECT * FROM UN", "jpfxun")(lambda z: z.universe)
query("currency_allocation", "SELECT * FROM AL", "jpfxua")(lambda z: review.allocation(z.entries, P))
query("currency_top", "SELECT entry_ref, ccy, CAST(place AS INT) AS place FROM ST WHERE chosen", "jpfxua")(
    lambda z: review.stratified(z.entries, P).select("entry_ref", "ccy", "place")
)
query(
    "excluded_currencies",
    """SELECT ccy, entries, round(v / t, 6) AS volume_share, round(largest, 2) AS largest
    FROM (SELECT ccy, CAST(sum(CASE WHEN chosen THEN 0 ELSE 1 END) AS BIGINT) AS entries, sum(abs_amount) AS v,
    sum(sum(abs_amount)) OVER () AS t, max(CASE WHEN NOT chosen THEN abs_amount END) AS largest FROM ST GROUP BY ccy) WHERE entries > 0""",
    "jpfxua",
)(lambda z: review.excluded_currencies(z.entries, P))
query(
    "selection_notes",
    """SELECT 'forced_currencies' AS note_id, 'forced currencies present: ' || string_agg(DISTINCT ccy, ', ' ORDER BY ccy) AS note FROM BA WHERE ccy IN ('JPY') HAVING count(*) > 0
    UNION ALL SELECT 'cap', count(*) || ' material entries, the first 2000 taken' FROM BA WHERE base_amount >= 100000 HAVING count(*) > 2000
    UNION ALL SELECT 'currency_stratified_fallback', 'no rates for ' || string_agg(DISTINCT ccy, ', ' ORDER BY ccy) || '; first entries by currency taken, capped in all'
    FROM BA WHERE ccy NOT IN (SELECT ccy FROM FX) HAVING count(*) > 0""",
    "jpfxu",
)(lambda z: review.selection_notes(z.entries, P))

BEN = """WITH D AS (SELECT {k} CAST(left(CAST(CAST(floor(abs(amount)) AS BIGINT) AS VARCHAR), 1) AS INT) AS digit, count(*) AS cnt
    FROM J WHERE abs(amount) >= 1 GROUP BY ALL),
T AS (SELECT {k} CAST(sum(cnt) AS BIGINT) AS n FROM D
    GROUP BY ALL), N AS (SELECT CAST(unnest(range(1, 10)) AS INT) AS digit),
G AS (SELECT T.*, N.digit, coalesce(D.cnt, 0) AS cnt, log10(1 + 1 / N.digit) AS p FROM T CROSS JOIN N LEFT
    JOIN D ON D.digit = N.digit {on})"""
DIGITS = """SELECT {k} digit, cnt, n, round(cnt / n, 6) AS share, round(p, 6) AS expected, round(greatest(p - 1.96 * sqrt(greatest(p * (1 - p),
    1e-12) / n), 0.0), 6) AS low, round(p + 1.96 * sqrt(greatest(p * (1 - p), 1e-12) / n), 6) AS high
    FROM G"""
MAD = """SELECT {k} n, round(m, 6) AS mad, CASE WHEN n < 100 THEN 'insufficient' WHEN m < 0.004 THEN 'close' WHEN m < 0.008 THEN 'acceptable' WHEN m < 0.01 THEN 'marginal' ELSE 'nonconforming' END AS band
    FROM (SELECT {k} max(n) AS n, sum(abs(cnt / n - p)) / 9 AS m FROM G GROUP BY ALL{having})"""
query("benford_digits", BEN.format(k="", on="") + DIGITS.format(k=""), "j")(lambda z: review.benford_digits(z.lines).drop("_gap"))
query("benford", BEN.format(k="", on="") + MAD.format(k="", having=""), "j")(lambda z: review.benford(z.lines))
query("benford_by_account", BEN.format(k="account,", on="AND D.account = T.account") + MAD.format(k="account,", having=""), "j")(
    lambda z: review.benford(z.lines, ("account",))
)
OUT = """WITH R AS (SELECT *, log10(CAST(abs(amount) AS DOUBLE) + 1) AS x{w} FROM J WHERE amount <> 0 AND account IS NOT NULL),
B AS (SELECT {k}, round(avg(x), 4) AS mean, round(CASE WHEN stddev_pop(x) = 0 THEN 1e-9 ELSE stddev_pop(x) END, 4) AS sd FROM R GROUP BY {k} HAVING count(*) >= 30),
Z AS (SELECT entry_ref, line_no, {o}, (x - mean) / CASE WHEN sd = 0 THEN 1e-9 ELSE sd END AS z FROM R JOIN B USING ({k}))
SELECT entry_ref, line_no, {o}, round(z, 3) AS z FROM Z WHERE abs(z) >= {z} ORDER BY abs(Z.z) DESC, entry_ref, line_no LIMIT 200"""
query("outliers", OUT.format(w="", k="account", o="account", z=4), "j")(lambda z: review.outliers(z.lines).select("entry_ref", "line_no", "account", "z"))
WEEKDAY = OUT.format(w=", CAST(dayofweek(posting_date) + 1 AS INT) AS wd", k="account, wd", o="account, wd", z=3)
query("outliers_by_weekday", WEEKDAY, "j")(
    lambda z: review.outliers(z.lines.withColumn("wd", F.dayofweek("posting_date")), 3.0, ("account", "wd")).select("entry_ref", "line_no", "account", "wd", "z")
)
SAMPLE = """WITH DS AS (SELECT entry_ref, min(strftime(posting_date, '%Y-%m')) AS stratum FROM J GROUP BY entry_ref),
SH AS (SELECT stratum, n, target, last, greatest(1, CAST(round_even(n / tot * target, 0) AS INT)) AS want
    FROM (SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS tot, least(200, sum(count(*)) OVER ()) AS target,
    row_number() OVER (ORDER BY stratum DESC) = 1 AS last
    FROM DS GROUP BY stratum)),
SA AS (SELECT stratum, least(n, CASE WHEN last THEN room ELSE least(want, room) END) AS alloc
    FROM (SELECT *, greatest(0, target - coalesce(sum(want) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room
    FROM SH)),
SM AS (SELECT r.entry_ref, r.stratum, 'representative' AS selection_basis
    FROM (SELECT *, row_number() OVER (PARTITION BY stratum
    ORDER BY sha256('42:' || entry_ref), entry_ref) AS place FROM DS) r JOIN SA ON SA.stratum = r.stratum
    WHERE place <= alloc)"""
query("sample", SAMPLE + " SELECT * FROM SM", "j")(lambda z: review.sample(z.journal, P_SAMPLE))
query("sample_coverage", SAMPLE + " SELECT stratum, count(*) AS selected FROM SM GROUP BY stratum", "j")(
    lambda z: review.sample(z.journal, P_SAMPLE).groupBy("stratum").agg(F.count("*").alias("selected"))
)
BAND = "left(account, 2) || '/' || CASE WHEN amount = 0 THEN -1 ELSE CAST(floor(log10(CAST(abs(amount) AS DOUBLE))) AS INT) END"
query("sample_by_band", SAMPLE.replace("strftime(posting_date, '%Y-%m')", BAND) + " SELECT * FROM SM", "j")(
    lambda z: review.sample(z.journal, P_SAMPLE, review.account_band(F.col("account"), F.col("amount")))
)
query(
    "sample_joins_xref",
    SAMPLE + """ SELECT entry_ref, line_no, rules_hit, selection_basis FROM XR UNION ALL SELECT SM.entry_ref, min(J.line_no), 0, 'representative'
    FROM SM JOIN J ON J.entry_ref = SM.entry_ref WHERE SM.entry_ref NOT IN (SELECT entry_ref FROM XR) GROUP BY SM.entry_ref""",
    "jpfx",
)(lambda z: review.with_sample(z.xref, review.sample(z.journal, P_SAMPLE), z.journal).select("entry_ref", "line_no", "rules_hit", "selection_basis"))
query(
    "universe_basis",
    SAMPLE + """, SB AS (SELECT SM.entry_ref, 0 AS rules_hit, 'representative' AS selection_basis, max(abs(amount)) AS abs_amount, min(currency) AS currency
    FROM SM JOIN J ON J.entry_ref = SM.entry_ref WHERE SM.entry_ref NOT IN (SELECT entry_ref FROM XR) GROUP BY SM.entry_ref)
    SELECT entry_ref, rules_hit, selection_basis FROM BA WHERE base_amount >= 100000 UNION ALL SELECT entry_ref, rules_hit, selection_basis FROM SB""",
    "jpfxu",
)(lambda z: _with_sample(z).select("entry_ref", "rules_hit", "selection_basis"))


def _with_sample(z: Run):
    """Material entries and sampled ones, which keep their basis whatever their amount."""
    both = review.with_sample(z.xref, review.sample(z.journal, P_SAMPLE), z.journal)
    return review.material(review.entry_rollup(both, z.journal), P_CAP)


query(
    "account_group_bands",
    """SELECT left(account, 2) AS account_group, CAST(floor(log10(CAST(abs(amount) AS DOUBLE))) AS INT) AS amount_band, count(*) AS lines
    FROM J WHERE amount <> 0 GROUP BY ALL""",
    "j",
)(
    lambda z: z.lines.filter("amount <> 0").groupBy(F.substring("account", 1, 2).alias("account_group"), F.floor(F.log10(F.abs("amount"))).cast("int").alias("amount_band"))
    .agg(F.count("*").alias("lines"))
)

# data quality
query(
    "population",
    """SELECT min(posting_date) AS first_date, max(posting_date) AS last_date, count(*) AS n, count(*) FILTER (amount < 0) AS negatives, count(*) FILTER (amount > 0) AS positives,
    count(*) FILTER (username IS NULL) AS no_user, count(*) FILTER (description IS NULL OR description = '') AS no_description, count(*) FILTER (currency IS NULL OR currency = '') AS no_currency FROM J""",
    "j",
)(lambda z: review.population(z.lines))
query("currency_mix", "SELECT coalesce(currency, '(blank)') AS currency, count(*) AS lines FROM J GROUP BY 1", "j")(
    lambda z: z.lines.groupBy(F.coalesce("currency", F.lit("(blank)")).alias("currency")).agg(F.count("*").alias("lines"))
)
#: ``last`` and ``declared`` stand for dates in the SQL; the reference's rules, written apart from the operators.
def _dq_sql(end: str, declared: str | None, lines: str = "J") -> str:
    d = f"DATE '{declared}'" if declared else "CAST(NULL AS DATE)"
    return f"""S AS (SELECT min(posting_date) AS a, max(posting_date) AS z, count(*) AS n, count(*) FILTER (amount < 0) AS neg, count(*) FILTER (amount > 0) AS pos, count(*) FILTER (username IS NULL) AS nu,
    count(*) FILTER (description IS NULL OR description = '') AS nd, count(*) FILTER (currency IS NULL OR currency = '') AS nc, DATE '{end}' AS pe, {d} AS dt FROM {lines}),
 B AS (SELECT count(*) AS u FROM (SELECT entry_ref FROM {lines} GROUP BY entry_ref HAVING abs(sum(amount)) > 100000)),
 DQ AS (SELECT 'dq_sign_convention' AS warning_id, 'warning' AS severity, FALSE AS non_dismissible, 1 AS count, 'no negative amounts in ' || n || ' lines' AS detail FROM S WHERE neg = 0 AND pos > 0
 UNION ALL SELECT 'dq_period_coverage', 'critical', FALSE, 1, 'last posting ' || z || ' before the year' FROM S WHERE z < date_trunc('year', pe)
 UNION ALL SELECT 'dq_period_coverage', 'critical', FALSE, 1, 'first posting ' || a || ' after the period' FROM S WHERE a > pe
 UNION ALL SELECT 'dq_missing_fields', 'info', FALSE, CAST(nd > 0 AS INT) + CAST(nu > 0 AS INT) + CAST(nc > 0 AS INT), concat_ws('; ', CASE WHEN nd > 0 THEN 'description ' || nd || '/' || n END,
    CASE WHEN nu > 0 THEN 'username ' || nu || '/' || n END, CASE WHEN nc > 0 THEN 'currency ' || nc || '/' || n END) FROM S WHERE nu + nd + nc > 0
 UNION ALL SELECT 'dq_extract_shortfall_declared', 'critical', TRUE, 1, 'last posting ' || z || ' before the declared ' || dt FROM S WHERE z < dt
 UNION ALL SELECT 'dq_no_post_close_coverage', 'warning', FALSE, greatest(least(z, coalesce(dt, z)) - pe, 0), 'covered to ' || least(z, coalesce(dt, z)) || ', reversals need ' || (pe + 30)
    FROM S WHERE least(z, coalesce(dt, z)) < pe + 30
 UNION ALL SELECT 'dq_unbalanced_docs', 'critical', FALSE, u, 'documents do not balance' FROM B WHERE u > 0)"""


DQ_ROWS = " SELECT warning_id, severity, non_dismissible, CAST(count AS BIGINT) AS count, detail FROM DQ"
query("dq_warnings", "WITH " + _dq_sql("2000-12-31", "2002-01-31") + DQ_ROWS, "j")(lambda z: review.warnings(z.journal, P))
# the same checks where others apply: only debits, and a period that the postings miss
query("dq_warnings_of_debits", "WITH " + _dq_sql("1990-12-31", "2002-01-31", "(SELECT * FROM J WHERE amount > 0)") + DQ_ROWS, "j")(
    lambda z: review.warnings(z.journal.filter("amount > 0"), replace(P, period_end=dt.date(1990, 12, 31)))
)
# nothing declared, and blank texts among the missing ones
BLANKS = "(SELECT * REPLACE (CASE WHEN line_no = 2 THEN '' ELSE description END AS description, CASE WHEN line_no = 3 THEN '' ELSE currency END AS currency) FROM J)"
query("dq_warnings_undeclared", "WITH " + _dq_sql("2000-12-31", None, BLANKS) + DQ_ROWS, "j")(lambda z: review.warnings(_blanked(z), replace(P, declared_through=None)))
query("dq_warnings_mid_year", "WITH " + _dq_sql("1996-06-30", None, "(SELECT * FROM J WHERE posting_date <= DATE '1996-07-15')") + DQ_ROWS, "j")(
    lambda z: review.warnings(z.journal.filter("posting_date <= DATE'1996-07-15'"), replace(P, period_end=dt.date(1996, 6, 30), declared_through=None))
)


def _blanked(z: Run):
    blank = lambda c, n: F.when(F.col("line_no") == n, "").otherwise(F.col(c))
    return z.journal.withColumns({"description": blank("description", 2), "currency": blank("currency", 3)})


query(
    "self_check",
    """SELECT entry_ref, abs(sum(amount)) <= 100000 AS balanced, min(line_no) = 1 AND max(line_no) = count(*) AND count(DISTINCT line_no) = count(*) AS contiguous,
    count(DISTINCT username) <= 1 AS one_user, count(DISTINCT is_manual) <= 1 AS one_kind, count(DISTINCT currency) <= 1 AS one_currency,
    min(posting_date) >= DATE '1994-01-01' AND max(posting_date) <= DATE '2000-12-31' AS in_window FROM J GROUP BY entry_ref""",
    "j",
)(lambda z: review.self_check(z.lines, P, dt.date(1994, 1, 1), P.period_end))

# ingest of a text rendering of the order lines
RAW = """WITH R AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS staging_seq,
  CASE WHEN l_partkey % 83 <> 0 THEN 'JE' || l_orderkey END AS entry_ref, l_linenumber AS line_no,
    CASE WHEN l_partkey % 97 <> 0 THEN CAST(l_shipdate AS DATE) END AS posting_date,
  CASE WHEN l_partkey % 89 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount,
    CASE WHEN l_partkey % 11 <> 0 THEN CASE WHEN l_suppkey % 10 < 3 THEN 'SAP' ELSE 'U' END || l_suppkey END AS username,
  l_returnflag, l_suppkey, l_partkey AS k, l_shipdate AS d, l_extendedprice AS e, CASE WHEN l_partkey % 83 = 0 THEN 'missing entry_ref' WHEN l_partkey % 97 = 0 THEN 'unparseable posting_date: not a date' WHEN l_partkey % 89 = 0 THEN 'missing amount' END AS reason
    FROM lineitem),
 T AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'reject' WHEN row_number() OVER (PARTITION BY entry_ref, line_no, reason IS NULL
    ORDER BY staging_seq) > 1 THEN 'duplicate' ELSE 'canonical' END AS status FROM R)"""
query(
    "ingest_journal",
    RAW + """ SELECT staging_seq, entry_ref, line_no, posting_date, username,
    CASE l_returnflag WHEN 'N' THEN TRUE WHEN 'R' THEN FALSE ELSE username IS NOT NULL AND l_suppkey % 10 >= 3 END AS is_manual,
    CASE WHEN l_returnflag IN ('N', 'R') THEN 'source' ELSE 'derived' END AS entry_type_source, amount, entry_ref AS source_doc FROM T WHERE status = 'canonical'""",
)(lambda z: ledger.journal_of(z.ingested).select("staging_seq", "entry_ref", "line_no", "posting_date", "username", "is_manual", "entry_type_source", "amount", "source_doc"))
query("ingest_rejects", RAW + " SELECT staging_seq, reason FROM T WHERE status = 'reject'")(lambda z: z.ingested.filter("status = 'reject'").select("staging_seq", "reason"))
query(
    "ingest_reject_payload",
    RAW + """ SELECT T.staging_seq, reason, '{"belnr":' || coalesce('"' || entry_ref || '"', 'null') || ',"line":"' || line_no || '","budat":"' || CASE WHEN k % 97 = 0 THEN 'not a date'
    WHEN k % 5 = 0 THEN strftime(d, '%d.%m.%Y') WHEN k % 5 = 1 THEN strftime(d, '%Y%m%d') ELSE strftime(d, '%Y-%m-%d') END || '","dmbtr":'
    || CASE WHEN k % 89 = 0 THEN 'null' WHEN k % 7 = 0 THEN '"' || replace(printf('%.2f', e), '.', ',') || '"' ELSE '"' || printf('%.2f', e) || '"' END
    || ',"uname":' || coalesce('"' || username || '"', 'null') || ',"blart":' || CASE l_returnflag WHEN 'N' THEN '"Manual"' WHEN 'R' THEN '"system"' ELSE 'null' END || '}' AS raw_json
    FROM T WHERE status = 'reject'""",
)(lambda z: ledger.rejects_of(z.ingested))
query("ingest_duplicates", RAW + " SELECT 'dq_duplicate_line_keys' AS warning_id, count(*) AS count FROM T WHERE status = 'duplicate'")(
    lambda z: z.ingested.filter("status = 'duplicate'").agg(F.count("*").alias("count")).select(F.lit("dq_duplicate_line_keys").alias("warning_id"), "count")
)
query(
    "ingest_reconciliation",
    RAW + """ SELECT raw, canonical, rejects, duplicates, round(rejects / raw, 6) AS reject_rate, raw = canonical + rejects + duplicates AS reconciles, rejects / raw > 0.02 AS paused
    FROM (SELECT count(*) AS raw, count(*) FILTER (status = 'canonical') AS canonical, count(*) FILTER (status = 'reject') AS rejects,
    count(*) FILTER (status = 'duplicate') AS duplicates FROM T)""",
)(lambda z: ledger.reconcile(z.ingested, P))
query(
    "ingest_figures_written",
    RAW + """ SELECT raw, canonical, rejects, duplicates, round(rejects / raw, 6) AS reject_rate, raw = canonical + rejects + duplicates AS reconciles, rejects / raw > 0.02 AS paused, canonical AS journal, rejects AS kept
    FROM (SELECT count(*) AS raw, count(*) FILTER (status = 'canonical') AS canonical, count(*) FILTER (status = 'reject') AS rejects,
    count(*) FILTER (status = 'duplicate') AS duplicates FROM T)""",
)(lambda z: _loaded(z))


def _loaded(z: Run):
    """The figures gathered while the journal is written, beside the rows that its tables hold."""
    journal, rejects, figures = ledger.load(z.ingested, P, f"{shared_folder(z.spark)}/journal-{uuid.uuid4().hex}")
    return figures.crossJoin(journal.agg(F.count("*").alias("journal"))).crossJoin(rejects.agg(F.count("*").alias("kept")))


# blank line numbers are filled with the place of the row among the good ones of its document
NUMBERED = RAW.replace("l_linenumber AS line_no,", "CASE WHEN l_partkey % 6 <> 0 THEN l_linenumber END AS given,").replace(" T AS (SELECT *,", """ Q AS (SELECT *, coalesce(given,
    row_number() OVER (PARTITION BY entry_ref, reason IS NULL ORDER BY staging_seq)) AS line_no FROM R), T AS (SELECT *,""").replace("AS status FROM R)", "AS status FROM Q)")
query("ingest_line_numbers", NUMBERED + " SELECT staging_seq, CAST(line_no AS INT) AS line_no, status FROM T WHERE status <> 'reject'")(
    lambda z: ledger.typed(ledger.bind_columns(raw_lines(z.table("lineitem"), 6), RAW_MAP), P).filter("status <> 'reject'").select("staging_seq", "line_no", "status")
)


query(
    "csv_extract",
    RAW + " SELECT status, coalesce(reason, '') AS reason, count(*) AS \"rows\" FROM T GROUP BY ALL",
)(lambda z: _from_csv(z))


def _from_csv(z: Run):
    """The text rendering written as CSV in the shared folder and read as an extract."""
    path = f"{shared_folder(z.spark)}/extract-{uuid.uuid4().hex}"
    z.raw_text.drop("staging_seq").write.option("header", True).csv(path)
    rows = ledger.typed(ledger.bind_columns(ledger.read_extract(z.spark, path), RAW_MAP), P)
    return rows.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("rows"))


query("table_fingerprint")(lambda z: ledger.content_hash(z.table("lineitem")))
