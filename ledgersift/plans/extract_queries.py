"""Queries over many extracts of unlike layouts, written from the order lines and read back in one job, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.operators import review
from ledgersift.plans.params import LEDGER as P
from ledgersift.plans.shared import Run, query
from ledgersift.plans.zones import shared_folder, zone
from ledgersift.sources import extracts, ledger

#: Layouts by the row's number modulo 4: delimiter, and a header for each column of shared.raw_lines() that is written.
LAYOUTS = {
    "sap": (",", {"BELNR": "BELNR", "LINE": "LINE", "BUDAT": "BUDAT", "DMBTR": "DMBTR", "UNAME": "UNAME", "BLART": "BLART"}),
    "english": (";", {"UNAME": "User", "BELNR": "Document No", "LINE": "Line", "BUDAT": "Posting Date", "BLART": "Entry Type", "DMBTR": "Amount"}),
    "mixed": ("\t", {"BELNR": "Voucher", "BUDAT": "Book_Date_Local", "LINE": "line", "DMBTR": "Net Amount EUR", "UNAME": "Posted By User", "BLART": "Doc Type Name"}),
    "partial": ("|", {"BELNR": "BELNR", "LINE": "LINE", "BUDAT": "BUDAT", "UNAME": "UNAME"}),
}
#: Rows of all layouts for each file of one; the copy of the first one has a quarter of its files.
FILE_ROWS = 4_000_000
#: The folder of a file names its extract.
FOLDER = "([^/]+)/[^/]+$"


def _files(z: Run) -> str:
    """The layouts as CSV in the shared folder, each in rows' order in several files, and a copy of the first one in other files."""
    path = f"{shared_folder(z.spark)}/extracts-{uuid.uuid4().hex}"
    rows = zone(z.raw_text.withColumn("_layout", F.col("staging_seq") % 4))
    n = max(4, rows.count() // FILE_ROWS)
    for i, (name, (delimiter, heads)) in enumerate(LAYOUTS.items()):
        own = rows.filter(F.col("_layout") == i)
        for copy, n in [(name, n)] + ([] if i else [("sap_again", n // 4)]):
            dealt = own.repartitionByRange(n, "staging_seq").sortWithinPartitions("staging_seq").select(*[F.col(c).alias(h) for c, h in heads.items()])
            dealt.write.option("header", True).option("sep", delimiter).csv(f"{path}/{copy}")
    return path


def _typed(z: Run) -> DataFrame:
    return extracts.ingest(z.spark, _paths(z), P, FOLDER)


def _paths(z: Run) -> list[str]:
    path = _files(z)
    return [f"{path}/{name}" for name in (*LAYOUTS, "sap_again")]


def _maps(z: Run) -> DataFrame:
    """What is bound to what, with the lines of each extract."""
    lines = extracts.read_lines(z.spark, _paths(z), FOLDER)
    heads = zone(extracts.headers(lines, FOLDER))
    found = extracts.proposals(heads).withColumnRenamed("extract", "file").join(heads.select("file", "extract"), "file").drop("file").distinct()
    n = lines.drop("extract").join(heads.select("extract", "file", "first"), "file").filter(F.col("seq") != F.col("first")).groupBy("extract").agg(F.count("*").alias("lines"))
    return found.join(n, "extract").select("extract", "field", "header", "confidence", "system", "lines")


EXTRACTS = """WITH R AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS seq,
  CASE WHEN l_partkey % 83 <> 0 THEN 'JE' || l_orderkey END AS entry_ref, CAST(l_linenumber AS INT) AS line_no, CASE WHEN l_partkey % 97 <> 0 THEN CAST(l_shipdate AS DATE) END AS posting_date,
  CASE WHEN l_partkey % 89 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount, CASE WHEN l_partkey % 11 <> 0 THEN CASE WHEN l_suppkey % 10 < 3 THEN 'SAP' ELSE 'U' END || l_suppkey END AS username,
  l_returnflag, l_suppkey, CASE WHEN l_partkey % 83 = 0 THEN 'missing entry_ref' WHEN l_partkey % 97 = 0 THEN 'unparseable posting_date: not a date' WHEN l_partkey % 89 = 0 THEN 'missing amount' END AS why FROM lineitem),
L AS (SELECT e AS extract, i, nothing FROM (VALUES ('sap', 0, NULL), ('english', 1, NULL), ('mixed', 2, NULL), ('partial', 3, 'no column for amount'), ('sap_again', 0, NULL)) t(e, i, nothing)),
X AS (SELECT L.extract, R.* REPLACE (coalesce(nothing, why) AS why) FROM R JOIN L ON seq % 4 = i),
T AS (SELECT *, CASE WHEN why IS NOT NULL THEN 'reject' WHEN row_number() OVER (PARTITION BY extract, entry_ref, line_no, why IS NULL ORDER BY seq) > 1 THEN 'duplicate' ELSE 'canonical' END AS status FROM X)"""
query(
    "extracts_journal",
    EXTRACTS + """ SELECT extract, entry_ref, line_no, posting_date, amount, username, CASE l_returnflag WHEN 'N' THEN TRUE WHEN 'R' THEN FALSE ELSE username IS NOT NULL AND l_suppkey % 10 >= 3 END AS is_manual,
    entry_ref AS source_doc FROM T WHERE status = 'canonical'""",
)(lambda z: ledger.journal_of(_typed(z)).select("extract", "entry_ref", "line_no", "posting_date", "amount", "username", "is_manual", "source_doc"))
query("extracts_rejects", EXTRACTS + ' SELECT extract, why AS reason, count(*) AS "rows" FROM T WHERE status = \'reject\' GROUP BY ALL')(
    lambda z: _typed(z).filter("status = 'reject'").groupBy("extract", "reason").agg(F.count("*").alias("rows"))
)
query(
    "extracts_reconciliation",
    EXTRACTS + """ SELECT extract, raw, canonical, rejects, duplicates, round(rejects / raw, 6) AS reject_rate, raw = canonical + rejects + duplicates AS reconciles, rejects / raw > 0.02 AS paused
    FROM (SELECT extract, count(*) AS raw, count(*) FILTER (status = 'canonical') AS canonical, count(*) FILTER (status = 'reject') AS rejects, count(*) FILTER (status = 'duplicate') AS duplicates FROM T GROUP BY extract)""",
)(lambda z: extracts.reconcile(_typed(z), P))
query(
    "extracts_maps",
    EXTRACTS + """, M AS (SELECT * FROM (VALUES
    ('sap', 'source_doc', 'BELNR'), ('sap', 'entry_ref', 'BELNR'), ('sap', 'posting_date', 'BUDAT'), ('sap', 'amount', 'DMBTR'), ('sap', 'username', 'UNAME'), ('sap', 'entry_type', 'BLART'),
    ('sap_again', 'source_doc', 'BELNR'), ('sap_again', 'entry_ref', 'BELNR'), ('sap_again', 'posting_date', 'BUDAT'), ('sap_again', 'amount', 'DMBTR'), ('sap_again', 'username', 'UNAME'), ('sap_again', 'entry_type', 'BLART'),
    ('english', 'username', 'User'), ('english', 'source_doc', 'Document No'), ('english', 'entry_ref', 'Document No'), ('english', 'posting_date', 'Posting Date'), ('english', 'entry_type', 'Entry Type'), ('english', 'amount', 'Amount'),
    ('mixed', 'entry_ref', 'Voucher'), ('mixed', 'posting_date', 'Book_Date_Local'), ('mixed', 'amount', 'Net Amount EUR'), ('mixed', 'username', 'Posted By User'), ('mixed', 'entry_type', 'Doc Type Name'),
    ('partial', 'source_doc', 'BELNR'), ('partial', 'entry_ref', 'BELNR'), ('partial', 'posting_date', 'BUDAT'), ('partial', 'username', 'UNAME')) t(extract, field, header))
    SELECT extract, field, header, CASE extract WHEN 'partial' THEN 0.25 ELSE 0.417 END AS confidence, CASE extract WHEN 'english' THEN 'generic' WHEN 'mixed' THEN 'generic' ELSE 'sap' END AS system,
    (SELECT count(*) FROM X WHERE X.extract = M.extract) AS lines FROM M""",
)(lambda z: _maps(z))
query("extracts_copies", EXTRACTS + " SELECT DISTINCT 'sap_again' AS extract, 'run-2' AS earlier_run, 'sap' AS earlier FROM X")(lambda z: extracts.duplicates(extracts.digests(extracts.read_lines(z.spark, _paths(z), FOLDER), FOLDER), "run-2"))
query(
    "dq_warnings_of_extracts",
    EXTRACTS + """, C AS (SELECT * FROM T WHERE status = 'canonical'), S AS (SELECT count(*) AS n, count(*) FILTER (username IS NULL) AS nu, max(posting_date) AS z FROM C)
    SELECT 'dq_sign_convention' AS warning_id, 'warning' AS severity, FALSE AS non_dismissible, CAST(1 AS BIGINT) AS count FROM S UNION ALL SELECT 'dq_missing_fields', 'info', FALSE, 3 FROM S WHERE nu > 0
    UNION ALL SELECT 'dq_extract_shortfall_declared', 'critical', TRUE, 1 FROM S WHERE z < DATE '2002-01-31'
    UNION ALL SELECT 'dq_unbalanced_docs', 'critical', FALSE, count(*) FROM (SELECT entry_ref FROM C GROUP BY entry_ref HAVING abs(sum(amount)) > 100000) HAVING count(*) > 0
    UNION ALL SELECT 'dq_duplicate_line_keys', 'critical', FALSE, count(*) FROM T WHERE status = 'duplicate' HAVING count(*) > 0
    UNION ALL SELECT 'dq_duplicate_extract', 'critical', TRUE, 1 FROM X HAVING count(*) > 0""",
)(lambda z: _warnings(z))


def _warnings(z: Run) -> DataFrame:
    """Warnings of a job over all extracts, repeated keys and copied extracts among them."""
    paths = _paths(z)
    rows = zone(extracts.ingest(z.spark, paths, P, FOLDER))
    copies = extracts.duplicates(extracts.digests(extracts.read_lines(z.spark, paths, FOLDER), FOLDER), "run-2")
    return review.warnings(ledger.journal_of(rows), P, rows, copies).drop("detail")


query(
    "extracts_registry",
    EXTRACTS + """ SELECT extract, 'run-1' AS earlier_run, CASE extract WHEN 'sap_again' THEN 'sap' ELSE extract END AS earlier FROM (SELECT DISTINCT extract FROM X)""",
)(lambda z: _registry(z))


def _registry(z: Run) -> DataFrame:
    """The extracts loaded twice with a registry between: every one has been there before."""
    path = f"{shared_folder(z.spark)}/registry-{uuid.uuid4().hex}"
    found = zone(extracts.digests(extracts.read_lines(z.spark, _paths(z), FOLDER), FOLDER))
    extracts.register(found, path, "run-1")
    return extracts.duplicates(found, "run-2", extracts.registered(z.spark, path))
