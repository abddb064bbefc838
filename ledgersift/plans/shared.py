"""What the query modules share: the registry, the zones of a run, and the SQL that the compared queries have in common."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgersift.operators import evaluate, review, rules, worklog
from ledgersift.plans.params import LEDGER as P
from ledgersift.plans.zones import zone
from ledgersift.sources import ledger

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The universe of the given tables is larger than its cap, which is then a stated limitation.
P_CAP = replace(P, overflow="document_limitation")
P_SAMPLE = replace(P, sample_size=200)


class Run:
    """The given tables and the zones made from them; each zone is computed and written once for a query, when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """The journal as a view, for queries that read it once."""
        return ledger.tables_journal(self.spark, self.sf_dir)

    @cached_property
    def journal(self) -> DataFrame:
        return zone(self.lines)

    @cached_property
    def found(self) -> DataFrame:
        """The flags of all rules as a view."""
        return rules.flags(self.journal, P)

    @cached_property
    def flags(self) -> DataFrame:
        return zone(self.found)

    @cached_property
    def xref(self) -> DataFrame:
        return zone(review.cross_reference(self.__dict__.get("flags", self.found), self.journal))

    @cached_property
    def entries(self) -> DataFrame:
        return zone(review.entry_rollup(self.xref, self.journal))

    @cached_property
    def universe(self) -> DataFrame:
        chosen = review.capped(review.material(self.entries, P_CAP), P_CAP)
        return zone(chosen.select("entry_ref", "rules_hit", "abs_amount", "currency", "selection_basis"))

    @cached_property
    def assessments(self) -> DataFrame:
        """Assessments made by rule from the universe, so that every later step follows the data."""
        return worklog.rule_assessments(self.universe)

    @cached_property
    def decisions(self) -> DataFrame:
        return worklog.decide(self.universe, self.assessments, P)

    @cached_property
    def warnings(self) -> DataFrame:
        return zone(review.warnings(self.journal, P))

    @cached_property
    def labels(self) -> DataFrame:
        return evaluate.hash_labels(self.journal)

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def raw_text(self) -> DataFrame:
        return raw_lines(self.table("lineitem"))

    @cached_property
    def ingested(self) -> DataFrame:
        return ledger.typed(ledger.bind_columns(self.raw_text, RAW_MAP), P)


RAW_MAP = {"entry_ref": "belnr", "posting_date": "budat", "amount": "dmbtr", "username": "uname", "entry_type": "blart"}


def raw_lines(lineitem: DataFrame, unnumbered: int = 0) -> DataFrame:
    """A text rendering of the order lines, with faults at fixed places; ``unnumbered``: parts divisible by it have no line number."""
    k = F.col("l_partkey")
    iso, dotted, plain = (F.date_format("l_shipdate", f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "yyyyMMdd"))
    date = F.when(k % 97 == 0, "not a date").when(k % 5 == 0, dotted).when(k % 5 == 1, plain).otherwise(iso)
    cents = F.format_string("%.2f", F.col("l_extendedprice"))
    amount = F.when(k % 89 == 0, "").when(k % 7 == 0, F.replace(cents, F.lit("."), F.lit(","))).otherwise(cents)
    columns = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    lines = lineitem.withColumn("_n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*columns)))
    ref = F.when(k % 83 == 0, "  ").otherwise(F.concat(F.lit("JE"), F.col("l_orderkey").cast("string")))
    person = F.concat(F.when(F.col("l_suppkey") % 10 < 3, "SAP").otherwise("U"), F.col("l_suppkey").cast("string"))
    kind = F.when(F.col("l_returnflag") == "N", "Manual").when(F.col("l_returnflag") == "R", "system").otherwise(" ")
    number = F.col("l_linenumber").cast("string")
    if unnumbered:
        number = F.when(k % unnumbered == 0, " ").otherwise(number)
    return lines.select(
        (F.col("l_orderkey") * 1000 + F.col("_n")).alias("staging_seq"), ref.alias("BELNR"), number.alias("LINE"), date.alias("BUDAT"),
        amount.alias("DMBTR"), F.when(k % 11 == 0, " ").otherwise(person).alias("UNAME"), kind.alias("BLART"),
    )


#: The journal made from the order tables, as in sources.ledger.tables_journal.
J = """J AS (
 SELECT 'JE' || l_orderkey AS entry_ref,
  CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS INT) AS line_no,
  CAST(l_shipdate AS DATE) AS posting_date, CAST(o_orderdate AS DATE) AS document_date, CAST(l_shipdate AS DATE) + l_linenumber AS entry_created_date,
  CAST(1000 + l_partkey % 50 AS VARCHAR) AS account, CASE WHEN l_suppkey % 10 < 3 THEN 'SAP' ELSE 'U' END || l_suppkey AS username,
  CASE WHEN l_returnflag = 'N' THEN TRUE WHEN l_returnflag = 'R' THEN FALSE ELSE l_suppkey % 10 >= 3 END AS is_manual,
  CASE WHEN l_returnflag IN ('N', 'R') THEN 'source' ELSE 'derived' END AS entry_type_source,
  CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(18,2)) AS amount,
  CASE r_name WHEN 'AMERICA' THEN 'USD' WHEN 'EUROPE' THEN 'EUR' WHEN 'AFRICA' THEN 'MAD' WHEN 'ASIA' THEN 'JPY' WHEN 'MIDDLE EAST' THEN 'GBP' END AS currency,
  CASE WHEN l_partkey % 13 <> 0 THEN 'part ' || l_partkey END AS description, CAST(NULL AS VARCHAR) AS source_doc
 FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT
    JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

FLAG_SQL = {
    "manual_entries": """SELECT 'manual_entries' AS rule, entry_ref, line_no, username, amount, 'manual entry (' || entry_type_source || ')' AS flag_reason
    FROM J WHERE is_manual""",
    "period_end": """SELECT 'period_end' AS rule, entry_ref, line_no, username, amount,
    CASE WHEN posting_date > DATE '2000-12-31' THEN 'manual entry after period end' ELSE 'manual entry near period end' END AS flag_reason
    FROM J WHERE is_manual AND posting_date BETWEEN DATE '2000-12-26' AND DATE '2001-01-10'""",
    "round_amounts": """SELECT 'round_amounts' AS rule, entry_ref, line_no, username, amount, 'round amount (multiple of 100)' AS flag_reason
    FROM J WHERE abs(amount) >= 10000 AND CAST(abs(amount) AS BIGINT) % 100 = 0""",
    "date_divergence": """SELECT 'date_divergence' AS rule, entry_ref, line_no, username, amount,
    CASE WHEN abs(posting_date - document_date) > 1500 THEN 'document and posting date ' || abs(posting_date - document_date) || ' days apart' ELSE 'created after period end' END AS flag_reason
    FROM J WHERE abs(posting_date - document_date) > 1500 OR entry_created_date > DATE '2000-12-31'""",
    "entry_splitting": """SELECT 'entry_splitting' AS rule, entry_ref, line_no, username, amount, n || ' amounts under the threshold on account ' || account AS flag_reason
    FROM
 (SELECT *, count(*) OVER (PARTITION BY account, b) AS n, sum(abs(amount)) OVER (PARTITION BY account, b) AS s
    FROM
  (SELECT *, (posting_date - DATE '2000-01-01') // 30 AS b FROM J
    WHERE is_manual AND abs(amount) >= 35000 AND abs(amount) < 50000)) WHERE n >= 3 AND s > 50000""",
    "balance_check": """SELECT 'balance_check' AS rule, entry_ref, min(line_no) AS line_no, min(username) AS username,
    CAST(sum(amount) AS DECIMAL(18,2)) AS amount,
    'document nets to ' || CAST(sum(amount) AS DECIMAL(18,2)) || ' over ' || count(*) || ' lines' AS flag_reason
    FROM J GROUP BY entry_ref HAVING abs(sum(amount)) > 100000""",
    "unusual_users": """SELECT 'unusual_users' AS rule, entry_ref, line_no, J.username, amount, why || ': ' || J.username AS flag_reason
    FROM J JOIN
 (SELECT username, 'rare manual user' AS why FROM J WHERE is_manual GROUP BY username HAVING count(*) <= 270
    UNION ALL SELECT unnest(['U5', 'U7', 'SAP1', 'SAP2']), 'high-risk user') t ON t.username = J.username
    WHERE is_manual""",
    "unusual_pairs": """SELECT 'unusual_pairs' AS rule, p.entry_ref, p.line_no, p.username, CAST(NULL AS DECIMAL(18,2)) AS amount,
    'unusual pair ' || p.debit || '/' || p.credit AS flag_reason
 FROM DP p LEFT JOIN (SELECT debit, credit, count(*) AS freq FROM DB
    GROUP BY debit, credit) f ON f.debit = p.debit AND f.credit = p.credit
 LEFT JOIN DB b ON b.entry_ref = p.entry_ref AND b.debit = p.debit AND b.credit = p.credit
    WHERE coalesce(freq, 0) - CASE WHEN b.entry_ref IS NULL THEN 0 ELSE 1 END < 1""",
    "reversals": """SELECT 'reversals' AS rule, entry_ref, line_no, username, amount,
    'reversed ' || (rp - DATE '2000-12-31') || ' days after period end by ' || username AS flag_reason
    FROM RM
 UNION ALL SELECT 'reversals', r_entry, r_line, username, r_amount, 'reverses an entry of the period'
    FROM (SELECT DISTINCT r_entry, r_line, username, r_amount FROM RM) t WHERE NOT EXISTS (SELECT 1 FROM RM
    WHERE RM.entry_ref = t.r_entry AND RM.line_no = t.r_line)""",
    "high_risk_system_pairs": """SELECT 'high_risk_system_pairs' AS rule, entry_ref, line_no, username, amount, 'rare account ' || account || ' for ' || username AS flag_reason
    FROM
 (SELECT *, count(*) OVER (PARTITION BY username, account) * 1.0 / count(*) OVER (PARTITION BY username) AS share
    FROM J WHERE NOT is_manual AND username IN ('U5', 'U7', 'SAP1', 'SAP2')) WHERE share < 0.01""",
}
PAIRS = """DP AS (SELECT a.entry_ref, CASE WHEN a.amount > 0 THEN a.account ELSE b.account END AS debit,
    CASE WHEN a.amount > 0 THEN b.account ELSE a.account END AS credit, min(a.line_no) AS line_no, min(a.username) AS username
 FROM J a
    JOIN J b ON a.entry_ref = b.entry_ref AND a.line_no < b.line_no AND ((a.amount > 0 AND b.amount < 0) OR (a.amount < 0 AND b.amount > 0))
    GROUP BY ALL),
F7 AS (SELECT entry_ref FROM J WHERE is_manual
    UNION SELECT entry_ref FROM J WHERE is_manual AND posting_date BETWEEN DATE '2000-12-26' AND DATE '2001-01-10'
    UNION SELECT entry_ref FROM J WHERE abs(amount) >= 10000 AND CAST(abs(amount) AS BIGINT) % 100 = 0
    UNION SELECT entry_ref FROM J WHERE abs(posting_date - document_date) > 1500 OR entry_created_date > DATE '2000-12-31'
    UNION SELECT entry_ref FROM (SELECT entry_ref, count(*) OVER w AS n, sum(abs(amount)) OVER w AS s FROM J WHERE is_manual AND abs(amount) >= 35000 AND abs(amount) < 50000
      WINDOW w AS (PARTITION BY account, (posting_date - DATE '2000-01-01') // 30)) WHERE n >= 3 AND s > 50000
    UNION SELECT entry_ref FROM J GROUP BY entry_ref HAVING abs(sum(amount)) > 100000
    UNION SELECT entry_ref FROM J WHERE is_manual AND (username IN ('U5', 'U7', 'SAP1', 'SAP2') OR username IN (SELECT username FROM J WHERE is_manual GROUP BY username HAVING count(*) <= 270))),
DB AS (SELECT DISTINCT entry_ref, debit, credit FROM DP WHERE entry_ref IN (SELECT entry_ref FROM J WHERE NOT is_manual) AND entry_ref NOT IN (SELECT entry_ref FROM F7)),
RM AS (SELECT o.entry_ref, o.line_no, o.username, o.amount, r.entry_ref AS r_entry, r.line_no AS r_line, r.amount AS r_amount, r.posting_date AS rp
    FROM J o JOIN J r ON o.account = r.account AND o.username = r.username
 WHERE o.posting_date <= DATE '2000-12-31' AND r.posting_date > DATE '2000-12-31' AND r.posting_date <= DATE '2001-01-30' AND abs(r.amount + o.amount) <= 200)"""
F_ALL = "FL AS (" + " UNION ALL ".join(f"SELECT * FROM ({FLAG_SQL[r]})" for r in rules.RULES) + ")"
X = """LH AS (SELECT entry_ref, line_no, count(DISTINCT rule) AS rules_hit, string_agg(DISTINCT flag_reason, ' | '
    ORDER BY flag_reason) AS flag_reasons FROM FL WHERE rule <> 'high_risk_system_pairs'
    GROUP BY entry_ref, line_no),
DA AS (SELECT entry_ref, max(abs(amount)) AS abs_amount, max(amount) AS amount FROM J GROUP BY entry_ref),
XR AS (SELECT LH.entry_ref, line_no, rules_hit, abs_amount, amount, flag_reasons, 'targeted' AS selection_basis
    FROM LH LEFT JOIN DA ON LH.entry_ref = DA.entry_ref)"""
U = """EN AS (SELECT XR.entry_ref, max(rules_hit) AS rules_hit, CAST(max(abs_amount) AS DOUBLE) AS abs_amount,
    min(selection_basis) AS selection_basis, min(c.currency) AS currency
    FROM XR LEFT JOIN (SELECT entry_ref, min(currency) AS currency FROM J
    GROUP BY entry_ref) c ON c.entry_ref = XR.entry_ref GROUP BY XR.entry_ref),
FX AS (SELECT *
    FROM (VALUES ('EUR', 1.08), ('GBP', 1.27), ('JPY', 0.0091), ('MAD', 0.1), ('USD', 1.0)) t(ccy, rate)),
BA AS (SELECT EN.*, upper(coalesce(currency, 'USD')) AS ccy, abs_amount * CAST(coalesce(rate, 1.0) AS DOUBLE) AS base_amount
    FROM EN LEFT JOIN FX ON ccy = upper(coalesce(currency, 'USD')))"""
ALLOC = """AL AS (SELECT ccy, n, round(volume, 2) AS volume, CAST(fl + greatest(0, least(more, room - coalesce(sum(more) OVER (ORDER BY o,
    volume DESC, ccy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS alloc
    FROM
 (SELECT *, least(20, n) - fl AS more, 2000 - sum(fl) OVER () AS room FROM
  (SELECT *, greatest(0, least(want, 2000 - coalesce(sum(want) OVER (ORDER BY o, volume DESC,
    ccy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS fl
    FROM
   (SELECT *, least(1, n) AS want, CASE WHEN ccy = 'JPY' THEN 0 ELSE 1 END AS o
    FROM (SELECT ccy, count(*) AS n, sum(abs_amount) AS volume FROM BA GROUP BY ccy))))),
ST AS (SELECT r.*, alloc, place <= alloc AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY ccy
    ORDER BY abs_amount DESC, entry_ref) AS place FROM BA) r JOIN AL ON AL.ccy = r.ccy)"""


UN = """UN AS (SELECT entry_ref, rules_hit, abs_amount, currency, selection_basis FROM BA WHERE base_amount >= 100000
    ORDER BY rules_hit DESC, base_amount DESC, entry_ref LIMIT 2000)"""


A = """AS_ AS (SELECT entry_ref, rules_hit, abs_amount, currency, CASE CAST(substr(entry_ref,
    3) AS BIGINT) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS concern,
 CASE CAST(substr(entry_ref, 3) AS BIGINT) % 3 WHEN 0 THEN 'accept_flag' WHEN 1 THEN 'inspect' ELSE 'override' END AS action,
    CAST(1 + CAST(substr(entry_ref, 3) AS BIGINT) % 5 AS INT) AS priority
    FROM UN WHERE CAST(substr(entry_ref, 3) AS BIGINT) % 7 <> 0),
DC AS (SELECT entry_ref, CASE WHEN conf < 0.6 THEN 'inspect' ELSE d END AS decision, conf AS confidence
    FROM (SELECT UN.entry_ref, CASE WHEN concern IS NULL THEN 'inspect' WHEN concern = 'high' THEN 'inspect' WHEN action = 'accept_flag' THEN 'accept' WHEN action = 'override' THEN 'accept' ELSE 'inspect' END AS d,
 CASE WHEN concern IS NULL THEN 1.0 WHEN concern = 'high' THEN 0.95 WHEN action = 'accept_flag' AND concern IN ('none',
    'low') THEN 0.9 WHEN action = 'accept_flag' THEN 0.7 WHEN action = 'inspect' THEN 0.85 ELSE 0.8 END AS conf
    FROM UN LEFT JOIN AS_ ON AS_.entry_ref = UN.entry_ref))"""




def query(name: str, sql: str | None = None, parts: str = ""):
    """Register a query on a Run; ``parts`` names the shared subqueries that its SQL reads (j, p, f, x, u, a, n for the universe, d for decisions)."""

    def add(make):
        QUERIES[name] = lambda spark, sf_dir: make(Run(spark, sf_dir))
        if sql:
            known = (("j", J), ("p", PAIRS), ("f", F_ALL), ("x", X), ("u", U), ("a", ALLOC), ("n", UN), ("d", A))
            shared = [t for k, t in known if k in parts]
            own = sql.strip()
            if own.upper().startswith("WITH "):
                SQL[name] = "WITH " + ", ".join([*shared, own[5:]])
            else:
                SQL[name] = ("WITH " + ", ".join(shared) + " " if shared else "") + own
        return make

    return add
