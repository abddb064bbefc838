"""Run log, hash-chained decisions, packs, assessments, gates and report tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.operators.rules import RULES
from ledgersift.plans.params import Params

GENESIS = "0" * 64


def run_log(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("event_type") == kind).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("flagged"))


def run_list(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), (F.max("event_id") + 1).alias("next_seq"))


def canonical(*cols: str) -> Column:
    """JSON with keys in order and nulls kept."""
    return F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})


def conversation_log(conversations: DataFrame) -> DataFrame:
    """(chain, id, payload) of every turn; the text enters by its digest, so rows stay small."""
    rows = conversations.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return rows.select(F.col("conv_id").alias("chain"), F.col("turn").alias("id"), canonical("role", "turn", "text_sha256").alias("payload"))


def payload_digest(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("chain"), F.col("turn").alias("id"), F.sha2(canonical("role", "turn").cast("binary"), 256).alias("payload_sha256"))


def _link(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat(prev, F.char(F.lit(0)), payload).cast("binary"), 256)


def _append(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of rows that come sorted by chain and id; only the last hash of a chain is kept between rows. Stored rows come with theirs."""
    last, prev = None, GENESIS
    for batch in batches:
        out = []
        for chain_id, i, payload, stored in zip(batch["chain"], batch["id"], batch["payload"], batch["stored"], strict=True):
            if last is None or chain_id != last[0]:
                last, prev = (chain_id,), GENESIS
            if stored is not None:
                prev = stored
                continue
            prev = hashlib.sha256(f"{prev}\0{payload}".encode("utf-8", "surrogatepass")).hexdigest()
            out.append((chain_id, i, payload, prev))
        yield pd.DataFrame(out, columns=["chain", "id", "payload", "row_hash"])


def chain(log: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """row_hash of every row of log: the digest of the hash before it in its chain and its own payload.

    Chains go on from the last row of ``stored`` (chain, id, row_hash) that has a hash, else from GENESIS. Rows are sorted by chain and id
    and streamed, so a chain of any length takes little memory; one chain is sequential by nature and is one task's work. Rows without
    chain or id come first in their order, a null payload counts as "null".
    """
    rows = log.select(F.col("chain").cast("string").alias("_c"), F.col("id").cast("long").alias("id"), F.coalesce("payload", F.lit("null")).alias("payload"), F.lit(None).cast("string").alias("stored"), F.lit(1).alias("_new"))
    if stored is not None:
        before = stored.filter(F.col("row_hash").isNotNull()).groupBy(F.col("chain").cast("string").alias("_c")).agg(F.max_by("row_hash", "id").alias("stored"))
        rows = rows.unionByName(before.select("_c", F.lit(None).cast("long").alias("id"), F.lit("").alias("payload"), "stored", F.lit(0).alias("_new")))
    dealt = rows.repartition("_c").sortWithinPartitions("_c", "_new", "id", "payload").select(F.col("_c").alias("chain"), F.col("id").cast("string").alias("id"), "payload", "stored")
    made = dealt.mapInPandas(_append, "chain string, id string, payload string, row_hash string")
    return made.select(F.col("chain").cast(log.schema["chain"].dataType).alias("chain"), F.col("id").cast("long").alias("id"), "payload", "row_hash")


def verify(rows: DataFrame) -> DataFrame:
    """For each chain its length, whether it is intact and the first bad place (from 0). Each row is checked against the last stored hash before it; a missing hash is an error."""
    w = Window.partitionBy("chain").orderBy("id")
    prev = F.coalesce(F.last("row_hash", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(GENESIS))
    bad = F.col("row_hash").isNull() | (F.col("row_hash") != _link(prev, F.col("payload")))
    marked = rows.select("chain", (F.row_number().over(w) - 1).alias("place"), bad.alias("bad"))
    return marked.groupBy("chain").agg(F.count("*").alias("length"), (~F.bool_or("bad")).alias("intact"), F.min(F.when(F.col("bad"), F.col("place"))).alias("first_bad"))


def effective(decisions: DataFrame) -> DataFrame:
    """The latest decision of each run and entry."""
    return decisions.groupBy("run_id", "entry_ref").agg(F.max_by(F.struct("id", "decision", "reason"), "id").alias("d")).select("run_id", "entry_ref", "d.*")


def decision_problems(decisions: DataFrame) -> DataFrame:
    blank = F.coalesce(F.trim("reason"), F.lit("")) == ""
    problem = F.when(~F.coalesce(F.col("decision").isin("inspect", "accept", "override"), F.lit(False)), "unknown decision").when((F.col("decision") == "override") & blank, "override needs a reason")
    return decisions.withColumn("problem", problem).filter(F.col("problem").isNotNull())


#: What a reviewer can say of a suspected injection.
DISPOSITIONS = ("confirmed_suspicious", "false_positive", "not_relevant")


def acknowledgement_problems(acks: DataFrame, warnings: DataFrame) -> DataFrame:
    both = acks.join(warnings.select("warning_id", "non_dismissible"), "warning_id", "left")
    problem = F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "needs a reason").when(F.coalesce("non_dismissible", F.lit(False)), "cannot be dismissed")
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def disposition_problems(rows: DataFrame) -> DataFrame:
    """Dispositions of suspected injections (event_ref, disposition, reason) that are unknown or without reason."""
    known = F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False))
    problem = F.when(~known, "unknown disposition").when(F.coalesce(F.trim("reason"), F.lit("")) == "", "needs a reason")
    return rows.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def limitations(acks: DataFrame, warnings: DataFrame) -> DataFrame:
    """Acknowledged critical warnings become limitations."""
    critical = warnings.filter("severity = 'critical'").select("warning_id")
    return acks.join(critical, "warning_id").select("warning_id", F.concat(F.lit("limitation: "), "warning_id", F.coalesce(F.concat(F.lit(" ("), "scope", F.lit(")")), F.lit(""))).alias("limitation"))


def packs(universe: DataFrame, xref: DataFrame, p: Params) -> DataFrame:
    """Flagged lines of the universe, in its order, in packs of pack_size lines. The universe is capped, so one window over it is small."""
    lines = universe.select("entry_ref", "rules_hit", "abs_amount").join(xref.select("entry_ref", "line_no"), "entry_ref")
    n = F.row_number().over(Window.orderBy(F.desc("rules_hit"), F.desc("abs_amount"), "entry_ref", "line_no"))
    return lines.select(F.format_string("pack_%03d", F.floor((n - 1) / p.pack_size) + 1).alias("pack"), "entry_ref", "line_no")


def render_packs(packed: DataFrame, text: DataFrame) -> DataFrame:
    """One text block for each pack and document; ``text`` has entry_ref, line_no and a sanitised line."""
    rows = packed.join(text, ["entry_ref", "line_no"])
    by = rows.groupBy("pack", "entry_ref").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return by.select("pack", "entry_ref", F.concat(F.lit("DOCUMENT "), "entry_ref", F.lit("\n"), F.array_join(F.transform("ls", lambda x: F.concat(x["line_no"].cast("string"), F.lit(" "), x["line"])), "\n")).alias("block"))


def pack_problems(packed: DataFrame, assessed: DataFrame) -> DataFrame:
    """Entries of a pack without assessment, assessments of entries not in it, and repeated ones."""
    want = packed.select("pack", "entry_ref").distinct().withColumn("wanted", F.lit(True))
    got = assessed.groupBy("pack", "entry_ref").agg(F.count("*").alias("n"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return want.join(got, ["pack", "entry_ref"], "full_outer").withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("pack", "entry_ref", "problem")


def first_assessments(assessed: DataFrame) -> DataFrame:
    """The first assessment of each entry within a pack."""
    w = Window.partitionBy("pack", "entry_ref").orderBy("position")
    return assessed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def coverage(assessed: DataFrame, universe: DataFrame) -> DataFrame:
    """Entries of the universe, those that have an assessment, and their share (1 for an empty universe)."""
    both = universe.select("entry_ref").join(assessed.select("entry_ref").distinct().withColumn("_has", F.lit(True)), "entry_ref", "left")
    counts = both.agg(F.count("*").alias("entries"), F.count_if(F.col("_has")).alias("assessed"))
    return counts.withColumn("coverage", F.round(F.when(F.col("entries") == 0, 1.0).otherwise(F.col("assessed") / F.col("entries")), 4))


def inconsistent(assessed: DataFrame, xref: DataFrame, pairs: DataFrame, most: int = 10) -> DataFrame:
    """Bands of like entries that were given both low and high concern: same rules hit, same size of amount, same account pair.

    ``pairs`` are the account pairs of documents; an entry's is that of its lowest line.
    """
    size = xref.groupBy("entry_ref").agg(F.max("rules_hit").alias("hits"), F.floor(F.log10(F.max("abs_amount") + 1)).alias("band"))
    pair = pairs.groupBy("entry_ref").agg(F.min(F.struct("line_no", F.concat_ws("/", "debit", "credit").alias("pair"))).alias("p")).select("entry_ref", F.col("p.pair").alias("pair"))
    by = assessed.join(size, "entry_ref").join(pair, "entry_ref", "left").groupBy("hits", "band", F.coalesce("pair", F.lit("-")).alias("pair"))
    both = by.agg(F.count("*").alias("entries"), F.bool_or(F.col("concern") == "low").alias("_low"), F.bool_or(F.col("concern") == "high").alias("_high"))
    return both.filter("_low AND _high").orderBy("hits", "band", "pair").limit(most).drop("_low", "_high")


def rule_assessments(universe: DataFrame) -> DataFrame:
    """Assessments made by a rule on the document number; one entry of seven has none."""
    k = F.substring("entry_ref", 3, 20).cast("long")
    concern = F.element_at(F.array(*map(F.lit, ("none", "low", "medium", "high"))), (k % 4).cast("int") + 1)
    action = F.element_at(F.array(*map(F.lit, ("accept_flag", "inspect", "override"))), (k % 3).cast("int") + 1)
    return universe.filter(k % 7 != 0).select("entry_ref", concern.alias("concern"), action.alias("action"), (1 + k % 5).cast("int").alias("priority"))


def decide(universe: DataFrame, assessed: DataFrame, p: Params, default: str = "inspect") -> DataFrame:
    """A decision with its confidence for every entry; entries without assessment are inspected, and those under the least confidence get the default."""
    rows = universe.select("entry_ref").join(assessed, "entry_ref", "left")
    c, a = F.col("concern"), F.col("action")
    pick = lambda d, x: F.struct(F.lit(d).alias("d"), F.lit(float(x)).alias("x"))
    made = F.when(c.isNull(), pick("inspect", 1)).when(c == "high", pick("inspect", 0.95)).when((a == "accept_flag") & c.isin("none", "low"), pick("accept", 0.9)).when(a == "accept_flag", pick("accept", 0.7)).when(a == "inspect", pick("inspect", 0.85)).when(a == "override", pick("accept", 0.8)).otherwise(pick(default, 0.5))
    return rows.withColumn("m", made).select("entry_ref", F.when(F.col("m.x") < p.min_confidence, default).otherwise(F.col("m.d")).alias("decision"), F.col("m.x").alias("confidence"))


def bypassed(universe: DataFrame, assessed: DataFrame, p: Params) -> DataFrame:
    """Entries by what became of them: assessed, without assessment, and decided by default for want of confidence."""
    made = decide(universe, assessed, p).join(assessed.select("entry_ref", F.lit(True).alias("_has")).distinct(), "entry_ref", "left")
    return made.agg(F.count("*").alias("entries"), F.count_if(F.col("_has").isNull()).alias("unassessed"), F.count_if(F.col("confidence") < p.min_confidence).alias("bypassed"))


def pilot_decide(assessed: DataFrame) -> DataFrame:
    return assessed.select("entry_ref", F.when((F.col("concern") == "high") | (F.col("priority") >= 4), "inspect").otherwise("accept").alias("decision"))


def undecided(universe: DataFrame, decisions: DataFrame) -> DataFrame:
    return universe.select("entry_ref").join(decisions.select("entry_ref"), "entry_ref", "left_anti")


def with_decisions(universe: DataFrame, decisions: DataFrame) -> DataFrame:
    return universe.join(decisions.select("entry_ref", "decision"), "entry_ref", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def triage_list(assessed: DataFrame, most: int) -> DataFrame:
    top = assessed.orderBy(F.desc("priority"), "entry_ref").limit(most)
    return top.select("entry_ref", "priority", F.row_number().over(Window.orderBy(F.desc("priority"), "entry_ref")).alias("place"))


def funnel(xref: DataFrame, universe: DataFrame, decisions: DataFrame, excluded: DataFrame) -> DataFrame:
    one = xref.agg(F.countDistinct("entry_ref").alias("flagged")).crossJoin(universe.agg(F.count("*").alias("selected"))).crossJoin(decisions.agg(F.count("*").alias("decided")))
    return one.crossJoin(excluded.agg(F.count("*").alias("excluded_currencies"))).withColumn("pending", F.col("selected") - F.col("decided"))


def _facts(rows: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(fact_key, fact_value) of aggregates of one row each."""
    made = [df.agg(value.cast("string").alias("fact_value")).select(F.lit(key).alias("fact_key"), "fact_value") for key, df, value in rows]
    return reduce(DataFrame.unionByName, made)


def rule_facts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("v")).select(F.concat(F.lit("rule_"), "rule").alias("fact_key"), F.col("v").cast("string").alias("fact_value"))


def facts(run_id: str, p: Params, journal: DataFrame, found: DataFrame, xref: DataFrame, universe: DataFrame, material: DataFrame, decisions: DataFrame, followups: DataFrame, divergent: DataFrame, fallback: DataFrame) -> DataFrame:
    """The figures that a narrative may cite, as (fact_key, fact_value); ``fallback`` has rows if the universe was chosen by currency."""
    n = F.count("*")
    rows = [
        ("run_id", journal.limit(0), F.lit(run_id)), ("period_end", journal.limit(0), F.lit(p.period_end.isoformat())), ("population_lines", journal, n), ("flagged_documents", xref, F.countDistinct("entry_ref")),
        ("universe_size", universe, n), ("total_flagged_before_cap", material, n), ("selection_basis", fallback, F.when(n > 0, "currency-stratified fallback").otherwise("targeted")),
        *[(f"decisions_{d}", decisions, F.count_if(F.col("decision") == d)) for d in ("inspect", "accept", "override")],
        ("followups_recorded", followups, n), ("consistency_warnings", divergent, n),
    ]
    return _facts(rows).unionByName(rule_facts(found))


def executive_figures(journal: DataFrame, found: DataFrame, xref: DataFrame, universe: DataFrame, decisions: DataFrame, assessed: DataFrame) -> DataFrame:
    """One row of the figures that a summary opens with."""
    one = journal.agg(F.count("*").alias("population")).crossJoin(xref.agg(F.countDistinct("entry_ref").alias("flagged_documents"))).crossJoin(universe.agg(F.count("*").alias("universe")))
    by = decisions.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("inspect", "accept", "override")])
    return one.crossJoin(by).crossJoin(assessed.agg(F.count_if(F.col("concern") == "high").alias("high_concern"))).crossJoin(found.agg(F.count_if(F.col("rule") == "balance_check").alias("unbalanced")))


def metrics(known: DataFrame, digits: DataFrame) -> DataFrame:
    """(metric, value): the facts that count something, and the first-digit test."""
    counts = known.filter(F.col("fact_value").rlike("^[0-9]+$")).select(F.col("fact_key").alias("metric"), F.col("fact_value").try_cast("double").alias("value"))
    return counts.unionByName(digits.select(F.lit("benford_n").alias("metric"), F.col("n").cast("double").alias("value"))).unionByName(digits.select(F.lit("benford_mad").alias("metric"), F.col("mad").alias("value")))


def run_kpis(runs: DataFrame) -> DataFrame:
    """Over a run list: runs, those with errors, those without, all events."""
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col("errors") > 0).alias("with_errors"), F.count_if(F.col("errors") == 0).alias("clean"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))


def timeline(events: DataFrame) -> DataFrame:
    """Events of each run in order, with their place and the seconds since the one before."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    return events.select("user_id", "event_id", "event_type", F.row_number().over(w).alias("place"), F.round(gap / 1e6, 3).alias("seconds"))


def citation_problems(sections: DataFrame, known: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """Cited keys that are no facts, required keys that no section cites, and sections without citations."""
    keys = F.regexp_extract_all("text", F.lit(r"\[fact:([a-z0-9_]+)\]"), F.lit(1))
    cited = sections.select(F.explode(keys).alias("fact_key")).distinct()
    unknown = cited.join(known.select("fact_key"), "fact_key", "left_anti").select(F.lit("unknown key").alias("problem"), F.col("fact_key").alias("what"))
    wanted = sections.sparkSession.createDataFrame([(k,) for k in required], "fact_key string").join(cited, "fact_key", "left_anti").select(F.lit("not cited").alias("problem"), F.col("fact_key").alias("what"))
    bare = sections.filter(F.size(keys) == 0).select(F.lit("no citation").alias("problem"), F.col("heading").alias("what"))
    return unknown.unionByName(wanted).unionByName(bare)


def resolve_citations(sections: DataFrame, known: DataFrame) -> DataFrame:
    """Each citation replaced by key=value, unknown ones by key=?. Facts are a few dozen rows."""
    pattern = r"\[fact:([a-z0-9_]+)\]"
    values = known.agg(F.map_from_entries(F.collect_list(F.struct("fact_key", "fact_value"))).alias("m"))
    keys = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    parts = F.split("text", pattern, -1)
    text = F.concat(F.array_join(F.zip_with(F.slice(parts, 1, F.size(keys)), keys, lambda a, k: F.concat(a, k, F.lit("="), F.coalesce(F.try_element_at(F.col("m"), k), F.lit("?")))), ""), F.element_at(parts, -1))
    return sections.crossJoin(F.broadcast(values)).withColumn("text", text).drop("m")


def gates(universe: DataFrame, decisions: DataFrame, failed_rules: DataFrame, accepted: DataFrame, sections: DataFrame, problems: DataFrame, active: DataFrame) -> DataFrame:
    """Four rows (gate, passed, problems, example): review of all entries, failed rules accepted as gaps, citations, active limitations accepted.

    ``failed_rules``, ``accepted`` and ``active`` hold ids; the citation gate also fails without any section.
    """
    none = sections.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("no narrative").alias("what"))
    rows = [
        ("review", undecided(universe, decisions).select(F.col("entry_ref").alias("what"))),
        ("procedures", failed_rules.join(accepted, "id", "left_anti").select(F.col("id").alias("what"))),
        ("citations", problems.select(F.concat_ws(": ", "problem", "what").alias("what")).unionByName(none)),
        ("limitations", active.join(accepted, "id", "left_anti").select(F.col("id").alias("what"))),
    ]
    made = [df.agg((F.count("*") == 0).alias("passed"), F.count("*").alias("problems"), F.min("what").alias("example")).select(F.lit(name).alias("gate"), "*") for name, df in rows]
    return reduce(DataFrame.unionByName, made)


#: What the work does not cover, by topic; part of every workpaper.
SCOPE = {
    "benford": "First-digit tests inform inquiry only, as amounts of journals need not follow that law.",
    "follow_ups": "Suggested follow-ups are recorded, not carried out; acting on one takes a new run.",
    "identity": "Reviewers state who they are without proof; chained digests show later changes of decisions, not who made them.",
    "injection": "Texts given to a model are marked as untrusted and screened, which lowers the risk and does not remove it.",
    "model_outputs": "Answers of models are logged but need not repeat; only the rules and tables are reproducible.",
    "outliers": "Outliers and samples depend on seeds, which are kept with the run.",
    "personal_data": "Personal data are masked by patterns and given terms and may remain where a text follows neither.",
    "sample": "The sample adds cover beside the flags and allows no projection to the whole.",
    "system_pairs": "Account pairs of system entries are the yardstick of this period and are not screened themselves.",
    "vouching": "Entries to inspect are listed for testing against their documents; that testing is done elsewhere.",
}


def workpaper(known: DataFrame, resolved: DataFrame, limits: DataFrame, acks: DataFrame, chains: DataFrame) -> DataFrame:
    """All tables of a workpaper as rows (sheet, position, name, content): facts, narrative, scope, accepted limitations, acknowledgements, integrity of chains."""
    sheet = lambda df, name, key, content: df.select(F.lit(name).alias("sheet"), F.row_number().over(Window.orderBy(key)).cast("int").alias("position"), F.col(key).cast("string").alias("name"), content.cast("string").alias("content"))
    integrity = chains.agg(F.coalesce(F.bool_and("intact"), F.lit(True)).alias("intact"), F.count("*").alias("chains")).withColumn("key", F.lit("chain_integrity_verified"))
    scope = known.sparkSession.createDataFrame(sorted(SCOPE.items()), "topic string, text string")
    # a workpaper is small: facts, sections, limitations and acknowledgements of one run
    return (
        sheet(known, "summary", "fact_key", F.col("fact_value")).unionByName(sheet(resolved, "narrative", "heading", F.col("text"))).unionByName(sheet(limits, "limitations", "id", F.lit("accepted")))
        .unionByName(sheet(acks, "data quality", "warning_id", F.col("reason"))).unionByName(sheet(integrity, "governance", "key", F.col("intact")))
        .unionByName(sheet(scope, "scope", "topic", F.col("text")))
    )


def rule_matrix(found: DataFrame, journal: DataFrame) -> DataFrame:
    names = found.sparkSession.createDataFrame([(r,) for r in RULES], "rule string")
    by = names.join(found.groupBy("rule").agg(F.count("*").alias("flagged")), "rule", "left").withColumn("flagged", F.coalesce("flagged", F.lit(0)))
    outcome = F.when(F.col("flagged") == 0, "clean").when(F.col("flagged") <= 5000, "review driver").otherwise("ranked")
    return by.crossJoin(journal.agg(F.count("*").alias("_all"))).select("rule", "flagged", F.round(F.col("flagged") / F.col("_all"), 6).alias("share"), outcome.alias("outcome"))


def monthly(found: DataFrame, journal: DataFrame) -> DataFrame:
    lines = journal.select("entry_ref", "line_no", "posting_date", F.abs("amount").alias("size"))
    return found.select("rule", "entry_ref", "line_no").join(lines, ["entry_ref", "line_no"]).groupBy("rule", F.date_format("posting_date", "yyyy-MM").alias("month")).agg(F.sum("size").cast("double").alias("volume"))


def drill_down(found: DataFrame) -> DataFrame:
    return found.groupBy("entry_ref").agg(*[F.bool_or(F.col("rule") == r).alias(r) for r in RULES])


def export_rows(xref: DataFrame, journal: DataFrame) -> DataFrame:
    """Flagged lines with 13 columns of the journal and the cross-reference, and abs_amount, by which write_export() orders them."""
    lines = journal.select("entry_ref", "line_no", "posting_date", "username", "is_manual", "entry_type_source", "account", "amount", "currency", "description", F.coalesce("source_doc", "entry_ref").alias("source_doc"))
    return xref.select("entry_ref", "line_no", "rules_hit", "abs_amount", "flag_reasons", "selection_basis").join(lines, ["entry_ref", "line_no"])


def write_export(rows: DataFrame, path: str) -> None:
    rows.orderBy(F.desc("rules_hit"), F.desc("abs_amount"), "entry_ref", "line_no").write.mode("overwrite").csv(path, header=True)


def findings(found: DataFrame, decided_lines: DataFrame, bands: DataFrame) -> DataFrame:
    """Findings by severity: unbalanced documents, one user in three or more reviewed decisions, first digits out of line."""
    high = found.filter("rule = 'balance_check'").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("high").alias("severity"), F.concat("n", F.lit(" unbalanced documents")).alias("finding"))
    medium = decided_lines.groupBy("username").agg(F.countDistinct("entry_ref").alias("n")).filter("n >= 3").select(F.lit("medium").alias("severity"), F.concat("username", F.lit(" in "), "n", F.lit(" reviewed documents")).alias("finding"))
    low = bands.filter(F.col("band").isin("marginal", "nonconforming")).select(F.lit("low").alias("severity"), F.concat(F.lit("first digits "), "band").alias("finding"))
    return high.unionByName(medium).unionByName(low)
