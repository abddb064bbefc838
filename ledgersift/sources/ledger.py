"""Ledger extracts: reading, column binding, ingest with rejects, and the ledger made from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgersift.functions import cleanse
from ledgersift.plans.params import Params

MANDATORY = ("entry_ref", "posting_date", "amount")
FIELDS = ("entry_ref", "line_no", "posting_date", "document_date", "entry_created_date", "username", "entry_type", "account", "account_name", "amount", "currency", "description", "source_doc")
#: Header names by field, in order of preference; they are compared by their letters and digits.
ALIASES = {
    "amount": ("amount", "amt", "dmbtr", "werrs", "value", "gross", "fcy", "local_amount", "amount_lc", "credit_amount", "debit_amount", "base_amount"),
    "currency": ("currency", "ccy", "waers", "curr", "cur", "currency_code", "cukey"),
    "posting_date": ("posting_date", "postingdate", "bdate", "budat", "posted", "post_date", "date_posted", "fiscal_date", "pstng_date", "book_date"),
    "document_date": ("document_date", "docdate", "bldat", "doc_date", "invoice_date", "documentdate", "date_doc"),
    "account": ("account", "acct", "hkont", "account_number", "acct_no", "gl_account", "account_no", "glaccount", "code", "account_code", "g/l_account", "gl", "gl_acct", "gl account"),
    "username": ("username", "user", "uname", "usnam", "user_id", "posted_by", "created_by", "user_name", "maker", "userid", "auser"),
    "description": ("description", "descr", "sgtxt", "text", "narrative", "line_text", "memo", "remark", "remarks", "description_text", "item_text", "txt", "label"),
    "source_doc": ("source_doc", "srcdoc", "belnr", "doc_number", "document_no", "reference", "ref_doc", "source_document", "document_number", "docnum", "doc_no"),
    "entry_ref": ("entry_ref", "entryref", "key", "id", "entry_id", "uuid", "unique_id", "record_id", "voucher", "entry_key"),
    "entry_created_date": ("entry_created_date", "created", "cpudt", "entry_date", "create_date", "created_on", "creation_date", "created_at", "timestamp", "aedat"),
    "entry_type": ("entry_type", "entrytype", "blart", "type", "doc_type", "document_type", "posting_type", "entrycategory", "voucher_type"),
}
SAP_CODES = ("budat", "bldat", "hkont", "sgtxt", "uname", "belnr", "waers", "dmbtr", "blart", "cpudt", "usnam", "werrs")
#: Of so many fields the matched share is the confidence; one of them has no use but takes a header of its name.
PROPOSED_FIELDS, UNUSED = 12, "entry_ref2"


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, and staging_seq in file order."""
    return spark.read.csv(path, header=True, inferSchema=False).withColumn("staging_seq", F.monotonically_increasing_id())


def bind_columns(df: DataFrame, column_map: dict[str, str]) -> DataFrame:
    """Canonical names by case-insensitive header lookup; unmapped fields are null. entry_ref falls back to source_doc.

    Missing mandatory fields are an error that names them all. raw_json is the whole raw row with lower-case keys and blanks as null.
    """
    heads = {c.upper(): c for c in reversed(df.columns)}
    wanted = {"line_no": "LINE", "currency": "CURRENCY"} | column_map
    found = {f: heads[wanted[f].upper()] for f in FIELDS if f in wanted and wanted[f].upper() in heads}
    found.setdefault("entry_ref", found.get("source_doc"))
    if missing := [f for f in MANDATORY if not found.get(f)]:
        raise ValueError("no column for " + ", ".join(missing))
    cells = F.struct(*[cleanse.blank_to_null(F.col(f"`{c}`")).alias(c.lower()) for c in df.columns if c != "staging_seq"])
    fields = [(F.col(f"`{found[f]}`") if found.get(f) else F.lit(None).cast("string")).alias(f) for f in FIELDS]
    return df.select("staging_seq", *fields, F.to_json(cells, {"ignoreNullFields": "false"}).alias("raw_json"))


def propose_maps(headers: DataFrame) -> DataFrame:
    """(extract, field, header, confidence, system) for rows (extract, pos, header) of many extracts.

    Headers compare by their letters and digits. Each field first takes the header that equals the earliest of its aliases. Then the headers left,
    from left to right, go to the first field without one that has an alias of three letters or more in them. Without an own header entry_ref
    takes that of source_doc, which does not count for the confidence.
    """
    spark = headers.sparkSession
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    fields = (*ALIASES, UNUSED)
    rows = [(k, i, a) for k, f in enumerate(fields) for i, a in enumerate(ALIASES.get(f, (UNUSED,)))]
    names = F.broadcast(spark.createDataFrame(rows, "turn int, rank int, alias string").withColumn("alias", bare("alias")))
    # of headers that read alike the last one stands for all
    tidy = headers.filter(F.trim("header") != "").withColumn("h", bare("header")).groupBy("extract", "h").agg(F.max_by(F.struct("pos", "header"), "pos").alias("x")).select("extract", "h", "x.*")
    equal = tidy.join(names, F.col("h") == F.col("alias")).groupBy("extract", "turn").agg(F.min_by(F.struct("header", "h"), "rank").alias("x")).select("extract", "turn", "x.*")
    start = equal.groupBy("extract").agg(F.map_from_entries(F.collect_list(F.struct("turn", "header"))).alias("start"))
    free = tidy.join(equal.select("extract", "h"), ["extract", "h"], "left_anti")
    loose = free.join(names, (F.length("alias") >= 3) & F.col("h").contains(F.col("alias"))).groupBy("extract", "pos", "header").agg(F.array_sort(F.collect_set("turn")).alias("turns"))
    queue = loose.groupBy("extract").agg(F.array_sort(F.collect_list(F.struct("pos", "header", "turns"))).alias("queue"))

    def give(taken: Column, x: Column) -> Column:
        open_ = F.filter(x["turns"], lambda t: ~F.map_contains_key(taken, t))
        return F.when(F.size(open_) > 0, F.map_concat(taken, F.create_map(F.get(open_, F.lit(0)), x["header"]))).otherwise(taken)

    none, empty = F.create_map().cast("map<int,string>"), F.array().cast("array<struct<pos:int,header:string,turns:array<int>>>")
    both = tidy.select("extract").distinct().join(start, "extract", "left").join(queue, "extract", "left")
    done = both.select("extract", F.aggregate(F.coalesce("queue", empty), F.coalesce("start", none), give).alias("taken"))
    share = F.round(F.size("taken") / PROPOSED_FIELDS, 3)
    source, ref = fields.index("source_doc"), fields.index("entry_ref")
    inherits = F.map_contains_key("taken", F.lit(source)) & ~F.map_contains_key("taken", F.lit(ref))
    whole = F.when(inherits, F.map_concat("taken", F.create_map(F.lit(ref), F.col("taken")[F.lit(source)]))).otherwise(F.col("taken"))
    sap = tidy.groupBy("extract").agg(F.when(F.count_if(F.col("h").isin(*SAP_CODES)) >= 3, "sap").otherwise("generic").alias("system"))
    found = done.select("extract", share.alias("confidence"), F.explode(whole).alias("turn", "header"))
    name = F.element_at(F.array(*map(F.lit, fields)), F.col("turn") + 1)
    return found.filter(name != UNUSED).join(sap, "extract").select("extract", name.alias("field"), "header", "confidence", "system")


def typed(bound: DataFrame, p: Params, by: tuple[str, ...] = ()) -> DataFrame:
    """Cleansed and cast columns beside the raw date and amount texts, and status: canonical, duplicate or reject with its reason.

    ``by``: columns within whose values entries are numbered and keys compared.
    """
    text = {c: cleanse.blank_to_null(F.col(c)) for c in ("entry_ref", "username", "account", "currency", "source_doc")}
    out = bound.withColumns(text).withColumns({"description": F.trim("description"), "raw_date": cleanse.blank_to_null(F.col("posting_date")), "raw_amount": cleanse.blank_to_null(F.col("amount"))})
    out = out.withColumns({c: cleanse.to_date_any(F.col(c)) for c in ("posting_date", "document_date", "entry_created_date")} | {"amount": cleanse.to_amount(F.col("amount"))})
    out = out.withColumns({"is_manual": cleanse.is_manual(F.col("entry_type"), F.col("username"), p.manual_types, p.system_users), "entry_type_source": cleanse.type_source(F.col("entry_type")), "source_doc": F.coalesce("source_doc", "entry_ref")})
    reason = (
        F.when(F.col("entry_ref").isNull(), "missing entry_ref")
        .when(F.col("raw_date").isNull(), "missing posting_date")
        .when(F.col("posting_date").isNull(), F.concat(F.lit("unparseable posting_date: "), "raw_date"))
        .when(F.col("raw_amount").isNull(), "missing amount")
        .when(F.col("amount").isNull(), F.concat(F.lit("unparseable amount: "), "raw_amount"))
    )
    out = out.withColumn("reason", reason)
    good = F.col("reason").isNull()
    # only rejects carry their raw row on; each of them is a group of its own, so those without a reference are not numbered together
    out = out.withColumn("raw_json", F.when(~good, F.col("raw_json")))
    # the groups are columns, so that both numberings see that their rows lie together already
    out = out.withColumns({"_group": F.when(good, F.col("entry_ref")), "_single": F.when(~good, F.col("staging_seq"))})
    group = (*by, "_group", "_single")
    number = F.row_number().over(Window.partitionBy(*group).orderBy("staging_seq"))
    out = out.withColumn("line_no", F.coalesce(F.col("line_no").try_cast("int"), number)).withColumn("_line", F.when(good, F.col("line_no")))
    again = F.row_number().over(Window.partitionBy(*group, "_line").orderBy("staging_seq")) > 1
    return out.withColumn("status", F.when(~good, "reject").when(again, "duplicate").otherwise("canonical")).drop("_group", "_single", "_line")


def journal_of(typed_rows: DataFrame) -> DataFrame:
    return typed_rows.filter("status = 'canonical'").drop("reason", "status", "raw_date", "raw_amount", "entry_type", "raw_json")


def rejects_of(typed_rows: DataFrame) -> DataFrame:
    """staging_seq, reason and the whole raw row of each reject."""
    return typed_rows.filter("status = 'reject'").select("staging_seq", "reason", "raw_json")


def reconcile(typed_rows: DataFrame, p: Params, by: tuple[str, ...] = ()) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    one = typed_rows.groupBy(*by).agg(F.count("*").alias("raw"), n("canonical").alias("canonical"), n("reject").alias("rejects"), n("duplicate").alias("duplicates"))
    return _rated(one, p)


def _rated(counts: DataFrame, p: Params) -> DataFrame:
    """reject_rate, and whether the counts add up and the load is to pause."""
    rate = F.when(F.col("raw") > 0, F.col("rejects") / F.col("raw")).otherwise(0.0)
    whole = F.col("raw") == F.col("canonical") + F.col("rejects") + F.col("duplicates")
    return counts.withColumns({"reject_rate": F.round(rate, 6), "reconciles": whole, "paused": rate > p.reject_limit})


def load(typed_rows: DataFrame, p: Params, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write typed rows once, by status, and return (journal, rejects, figures): the figures of reconcile() are gathered while the rows are written.

    A load whose share of rejects is past the limit is written all the same; ``paused`` in its figures is the gate.
    """
    seen = Observation()
    n = lambda s: F.count_if(F.col("status") == s)
    counted = typed_rows.observe(seen, F.count(F.lit(1)).alias("raw"), n("canonical").alias("canonical"), n("reject").alias("rejects"), n("duplicate").alias("duplicates"))
    counted.withColumn("_status", F.col("status")).write.partitionBy("_status").parquet(path)
    spark = typed_rows.sparkSession
    rows = spark.read.schema(typed_rows.schema.add("_status", "string")).parquet(path)
    one = spark.createDataFrame([tuple(seen.get[c] for c in ("raw", "canonical", "rejects", "duplicates"))], "raw long, canonical long, rejects long, duplicates long")
    part = lambda s: rows.filter(F.col("_status") == s).drop("_status")
    return journal_of(part("canonical")), rejects_of(part("reject")), _rated(one, p)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file, to find extracts that were loaded before."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_assessments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each assessment of nested reports {pack, assessments: [{entry_ref, rationale_concern, concern_note, recommended_action, priority}]}."""
    return assessments_of(spark.read.schema(REPORT).option("multiLine", True).json(path))


def assessments_of(reports: DataFrame) -> DataFrame:
    """pack, position (from 0), entry_ref, concern, note, action, priority; a report without assessments gives no row."""
    rows = reports.select("pack", F.posexplode("assessments").alias("position", "a"))
    names = {"entry_ref": "entry_ref", "concern": "rationale_concern", "note": "concern_note", "action": "recommended_action", "priority": "priority"}
    return rows.select("pack", "position", *[F.col(f"a.{c}").alias(n) for n, c in names.items()])


REPORT = "pack string, assessments array<struct<entry_ref:string,rationale_concern:string,concern_note:string,recommended_action:string,priority:int>>"
NARRATIVE = "sections array<struct<heading:string,text:string>>, cited_fact_keys array<string>"


def read_narrative(spark: SparkSession, path: str) -> DataFrame:
    """position, heading, text of each section."""
    return spark.read.schema(NARRATIVE).option("multiLine", True).json(path).select(F.posexplode("sections").alias("position", "s")).select("position", "s.heading", "s.text")


def decisions_of(files: DataFrame, text: str = "value") -> DataFrame:
    """entry_ref, decision, reason from JSON objects {entry_ref: {decision, reason}}, one a row; unreadable ones give no rows."""
    return files.select(F.explode(F.from_json(F.col(text), "map<string,struct<decision:string,reason:string>>")).alias("entry_ref", "d")).select("entry_ref", "d.decision", "d.reason")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return decisions_of(spark.read.text(path, wholetext=True))


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and order-insensitive hash of a table."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def tables_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical journal made from the given order tables."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "customer", "nation", "region")}
    where = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    # fixed values: a currency for each region
    names = {"AMERICA": "USD", "EUROPE": "EUR", "AFRICA": "MAD", "ASIA": "JPY", "MIDDLE EAST": "GBP"}
    currency = reduce(lambda c, kv: c.when(F.col("r_name") == kv[0], kv[1]), names.items(), F)
    heads = where.select("o_orderkey", F.col("o_orderdate").cast("date").alias("document_date"), currency.alias("currency"))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    kind = F.when(F.col("l_returnflag") == "N", "manual").when(F.col("l_returnflag") == "R", "system")
    user = F.concat(F.when(F.col("l_suppkey") % 10 < 3, "SAP").otherwise("U"), F.col("l_suppkey").cast("string"))
    p = Params()
    lines = t["lineitem"].withColumn("line_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.concat(F.lit("JE"), F.col("l_orderkey").cast("string")).alias("entry_ref"),
        "line_no",
        F.col("l_shipdate").cast("date").alias("posting_date"),
        "document_date",
        F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber").cast("int")).alias("entry_created_date"),
        (F.lit(1000) + F.col("l_partkey") % 50).cast("string").alias("account"),
        user.alias("username"),
        cleanse.is_manual(kind, user, p.manual_types, p.system_users).alias("is_manual"),
        cleanse.type_source(kind).alias("entry_type_source"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice")).cast("decimal(18,2)").alias("amount"),
        "currency",
        F.when(F.col("l_partkey") % 13 != 0, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("description"),
        F.lit(None).cast("string").alias("source_doc"),
    )
