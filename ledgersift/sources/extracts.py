"""Many extracts of unlike layouts read, bound, typed and reconciled in one job, and a registry of their digests.

Files are read as lines. The first line of each file is its header; headers are one row a file, from which a binding of fields to
places is proposed. Lines meet the binding of their file in a join, so no header passes through the driver and a layout costs no job of its own.
A record is one line; quoted values may hold the delimiter, not a line feed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.functions import cleanse
from ledgersift.plans.params import Params
from ledgersift.plans.zones import zone
from ledgersift.sources import ledger

#: Delimiters that a header may use; the one that it holds most often counts, earlier ones first.
DELIMITERS = (",", ";", "\t", "|")
#: Bindings of up to so many files are sent to all tasks; beyond that they are joined, each repeated SALTS times.
BROADCAST_FILES, SALTS = 5_000, 32
#: Parts of an extract that have a digest of their own.
PARTS = 64


def read_lines(spark: SparkSession, paths: str | list[str], extract: str | None = None) -> DataFrame:
    """(extract, file, seq, line) of all non-blank lines; seq orders an extract's lines by file, block and place.

    ``extract``: a pattern whose first group, found in the path of a file, names its extract; without it each file is an extract.
    Later steps that can take the name from headers() do so, as it is matched there once a file and here once a line.
    """
    m = F.col("_metadata")
    rows = spark.read.text(paths).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    return rows.filter(F.trim("line") != "").select(_named(extract).alias("extract"), "file", F.struct("file", "block", "id").alias("seq"), "line")


def _named(extract: str | None) -> Column:
    return F.regexp_extract("file", extract, 1) if extract else F.col("file")


def _split(line: Column, delimiter: str) -> Column:
    """Values of a header, quotes off."""
    quoted = f'{"[|]" if delimiter == "|" else delimiter}(?=(?:[^"]*"[^"]*")*[^"]*$)'
    return F.transform(F.split(line, quoted), lambda x: F.replace(F.regexp_replace(F.trim(x), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))


def headers(lines: DataFrame, extract: str | None = None) -> DataFrame:
    """(extract, file, first, delimiter, names): seq and delimiter of each file's header, and its names; unnamed ones are column<place>, repeated ones get a number.

    ``extract`` is the pattern that read_lines() got. The least id of each block is found by numbers alone; only then a second scan fetches these lines.
    """
    blocks = lines.groupBy("file", F.col("seq.block").alias("block")).agg(F.min("seq.id").alias("id"))
    least = zone(blocks.groupBy("file").agg(F.min(F.struct("block", "id")).alias("x")).select("file", F.col("x.block").alias("_block"), F.col("x.id").alias("_id")))
    own = (lines.drop("extract") if extract else lines).withColumns({"_block": F.col("seq.block"), "_id": F.col("seq.id")})
    found = own.join(F.broadcast(least) if least.count() <= BROADCAST_FILES else least, ["file", "_block", "_id"])
    first = found.select(_named(extract).alias("extract") if extract else "extract", "file", F.col("seq").alias("first"), "line")
    line = F.regexp_replace("line", "^\ufeff", "")
    held = {d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS}
    most = F.greatest(*held.values())
    delimiter = reduce(lambda c, d: c.when(held[d] == most, d), DELIMITERS, F)
    names = reduce(lambda c, d: c.when(F.col("delimiter") == d, _split(line, d)), DELIMITERS, F)
    got = first.withColumn("delimiter", delimiter).withColumn("_n", F.transform(names, lambda x, i: F.when(x == "", F.concat(F.lit("column"), i.cast("string"))).otherwise(x)))

    def once(x: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice("_n", F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
        return F.when(before > 0, F.concat(x, F.lit("_"), before.cast("string"))).otherwise(x)

    return got.select("extract", "file", "first", "delimiter", F.transform("_n", once).alias("names"))


def proposals(heads: DataFrame) -> DataFrame:
    """(extract, field, header, confidence, system) by file, as ledger.propose_maps() gives them."""
    return ledger.propose_maps(heads.select(F.col("file").alias("extract"), F.posexplode("names").alias("pos", "header")))


def bindings(heads: DataFrame, proposed: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(extract, file, first, delimiter, names, places, missing): the place of each bound field, and the mandatory fields that have none.

    ``overrides`` (file, field, header) replace what was proposed; a null header unbinds the field. Headers compare without case.
    """
    chosen = proposed.select(F.col("extract").alias("file"), "field", "header")
    if overrides is not None:
        chosen = chosen.join(overrides.select("file", "field"), ["file", "field"], "left_anti").unionByName(overrides.select("file", "field", "header").filter("header IS NOT NULL"))
    by = chosen.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field", F.lower("header")))).alias("_m"))
    lower = F.transform("names", lambda x: F.lower(x))
    place = lambda name: F.nullif(F.array_position(lower, name).cast("int"), F.lit(0))
    # line numbers have a name of their own; currencies fall back to it
    named = {"line_no": F.lit("line"), "currency": F.coalesce(F.col("_m")["currency"], F.lit("currency")), "entry_ref": F.coalesce(F.col("_m")["entry_ref"], F.col("_m")["source_doc"])}
    places = {f: place(named.get(f, F.col("_m")[f])) for f in ledger.FIELDS}
    missing = F.array_compact(F.array(*[F.when(places[f].isNull(), F.lit(f)) for f in ledger.MANDATORY]))
    return heads.join(by, "file", "left").select("extract", "file", "first", "delimiter", "names", F.struct(*[c.alias(f) for f, c in places.items()]).alias("places"), F.array_join(missing, ", ").alias("missing"))


def bind(lines: DataFrame, bound: DataFrame) -> DataFrame:
    """Rows as ledger.bind_columns() gives them, with extract, file and missing; staging_seq is the line's seq. ``bound`` is written, one row a file.

    Values beyond the header are left out, missing ones are null.
    """
    lines = lines.drop("extract")
    files, width = bound.agg(F.count("*"), F.coalesce(F.max(F.size("names")), F.lit(1))).first()
    if files <= BROADCAST_FILES:
        rows = lines.join(F.broadcast(bound), "file")
    else:
        salted = bound.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = lines.withColumn("_salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int")).join(salted, ["file", "_salt"]).drop("_salt")
    schema = ", ".join(f"c{i} string" for i in range(max(width, 1)))
    read = lambda d: F.from_csv("line", schema, {"sep": d, "mode": "PERMISSIVE", "escape": '"'})
    cells = reduce(lambda c, d: c.when(F.col("delimiter") == d, read(d)), DELIMITERS, F)
    rows = rows.filter(F.col("seq") != F.col("first")).withColumn("_c", cells)
    rows = rows.withColumn("_c", F.array(*[F.col(f"_c.c{i}") for i in range(max(width, 1))]))
    fields = [F.get("_c", F.col(f"places.{f}") - 1).alias(f) for f in ledger.FIELDS]
    values = F.transform(F.slice("_c", F.lit(1), F.size("names")), lambda x: cleanse.blank_to_null(x))
    raw = F.to_json(F.map_from_arrays(F.transform("names", lambda x: F.lower(x)), values), {"ignoreNullFields": "false"})
    return rows.select("extract", "file", F.col("seq").alias("staging_seq"), *fields, raw.alias("raw_json"), "missing")


def typed(bound_rows: DataFrame, p: Params) -> DataFrame:
    """ledger.typed() within each extract; all rows of a file without a mandatory column are rejects that name it."""
    rows = ledger.typed(bound_rows, p, ("extract",))
    return rows.withColumn("reason", F.when(F.col("missing") != "", F.concat(F.lit("no column for "), "missing")).otherwise(F.col("reason"))).drop("missing")


def ingest(spark: SparkSession, paths: str | list[str], p: Params, extract: str | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Typed rows of all files, with their status; see ledger.journal_of() and ledger.rejects_of(). Headers and bindings are written first."""
    lines = read_lines(spark, paths, extract)
    heads = zone(headers(lines, extract))
    return typed(bind(lines, zone(bindings(heads, proposals(heads), overrides))), p)


def reconcile(typed_rows: DataFrame, p: Params) -> DataFrame:
    """Counts of each extract as ledger.reconcile() gives them for one."""
    return ledger.reconcile(typed_rows, p, ("extract",))


def digests(lines: DataFrame, extract: str | None = None) -> DataFrame:
    """(extract, part, n, digest): lines are dealt over PARTS by a hash of theirs; a digest depends on a part's lines, not on their order or files.

    Lines of a file's header belong to part -1. Sums of two hashes are built up in the tasks that read the lines. ``extract`` as for headers().
    """
    two = [F.sum(F.xxhash64("line", F.lit(s)).cast("decimal(38,0)")) for s in ("a", "b")]
    heads = zone(headers(lines, extract).select("extract", "file", F.col("first").alias("_first")))
    part = F.when(F.col("seq") == F.col("_first"), -1).otherwise(F.pmod(F.xxhash64("line"), F.lit(PARTS))).cast("int")
    by = lines.drop("extract").join(F.broadcast(heads) if heads.count() <= BROADCAST_FILES else heads, "file").select("extract", "line", part.alias("part")).groupBy("extract", "part").agg(F.count("*").alias("n"), two[0].alias("_a"), two[1].alias("_b"))
    # an extract in several files has its header several times
    n = F.when(F.col("part") < 0, 1).otherwise(F.col("n"))
    sums = F.when(F.col("part") < 0, F.concat_ws(":", F.col("_a") / F.col("n"), F.col("_b") / F.col("n"))).otherwise(F.concat_ws(":", "_a", "_b"))
    return by.select("extract", "part", n.cast("long").alias("n"), F.sha2(F.concat_ws(":", n.cast("string"), sums).cast("binary"), 256).alias("digest"))


def register(found: DataFrame, path: str, run_id: str) -> None:
    """Append the digests of a run to the registry."""
    found.select(F.lit(run_id).alias("run_id"), "extract", "part", "n", "digest").write.mode("append").parquet(path)


def registered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run_id string, extract string, part int, n long, digest string").parquet(path)


def overlaps(found: DataFrame, run_id: str, known: DataFrame | None = None) -> DataFrame:
    """(extract, earlier_run, earlier, parts, same): for each extract of a run the one that holds most of its parts already, and how many.

    Earlier are extracts of registered runs with a smaller id, and those of the run with a smaller name. Each part asks for its first
    holder only, so many copies of one extract give one row each, not pairs.
    """
    own = found.select(F.lit(run_id).alias("run_id"), "extract", "part", "digest")
    rows = own if known is None else own.unionByName(known.filter(F.col("run_id") < run_id).select("run_id", "extract", "part", "digest"))
    holder = rows.groupBy("part", "digest").agg(F.min(F.struct("run_id", "extract")).alias("first"))
    votes = own.join(holder, ["part", "digest"]).groupBy("extract", "first").agg(F.count("*").alias("same"))
    votes = votes.filter(F.col("first") != F.struct(F.lit(run_id).alias("run_id"), F.col("extract").alias("extract")))
    best = votes.groupBy("extract").agg(F.max(F.struct("same", "first")).alias("b"))
    parts = own.groupBy("extract").agg(F.count("*").alias("parts"))
    return best.join(parts, "extract").select("extract", F.col("b.first.run_id").alias("earlier_run"), F.col("b.first.extract").alias("earlier"), "parts", F.col("b.same").alias("same"))


def duplicates(found: DataFrame, run_id: str, known: DataFrame | None = None) -> DataFrame:
    """(extract, earlier_run, earlier): extracts of a run with the same lines as an earlier one; the first such one is named."""
    whole = lambda df: df.groupBy("run_id", "extract").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "digest"))), ",").cast("binary"), 256).alias("digest"))
    own = whole(found.withColumn("run_id", F.lit(run_id)))
    rows = own if known is None else own.unionByName(whole(known.filter(F.col("run_id") < run_id)))
    first = rows.groupBy("digest").agg(F.min(F.struct("run_id", "extract")).alias("first"))
    both = own.join(first, "digest").filter((F.col("first.run_id") != run_id) | (F.col("first.extract") != F.col("extract")))
    return both.select("extract", F.col("first.run_id").alias("earlier_run"), F.col("first.extract").alias("earlier"))
