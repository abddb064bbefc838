"""Run log, decision chains, packs, assessments, decisions, gates, report tables and scores as queries, each beside its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.functions import screen
from ledgersift.operators import evaluate, review, rules, sweep, worklog
from ledgersift.plans.params import LEDGER as P
from ledgersift.plans.shared import F_ALL, P_CAP, PAIRS, Run, query
from ledgersift.plans.zones import zone
from ledgersift.sources import ledger

# run log and chains
query("run_log", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS flagged FROM events WHERE event_type = 'error'")(lambda z: worklog.run_log(z.table("events"), "error"))
RUNS = "SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, max(event_id) + 1 AS next_seq FROM events GROUP BY user_id"
query("run_list", RUNS)(lambda z: worklog.run_list(z.table("events")))
query("run_kpis", f"SELECT count(*) AS runs, count(*) FILTER (errors > 0) AS with_errors, count(*) FILTER (errors = 0) AS clean, CAST(sum(events) AS BIGINT) AS events FROM ({RUNS})")(
    lambda z: worklog.run_kpis(worklog.run_list(z.table("events")))
)
query(
    "run_timeline",
    """SELECT user_id, event_id, event_type, CAST(row_number() OVER w AS INT) AS place, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 3) AS seconds
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)(lambda z: worklog.timeline(z.table("events")))
PAY = """'{"role":' || coalesce('"' || role || '"', 'null') || ',"text_sha256":"' || sha256(coalesce(text, '')) || '","turn":' || turn || '}'"""
query("canonical_json", f"SELECT conv_id AS chain, turn AS id, {PAY} AS payload FROM conversations")(lambda z: worklog.conversation_log(z.table("conversations")))
LINKED = f"""WITH RECURSIVE N AS (SELECT conv_id AS chain, turn AS id, {PAY} AS payload, row_number() OVER (PARTITION BY conv_id ORDER BY turn, {PAY}) AS i FROM conversations),
H AS (SELECT chain, id, payload, i, sha256(repeat('0', 64) || chr(0) || payload) AS row_hash FROM N WHERE i = 1
 UNION ALL SELECT N.chain, N.id, N.payload, N.i, sha256(H.row_hash || chr(0) || N.payload) FROM H JOIN N ON N.chain = H.chain AND N.i = H.i + 1)"""
query("decision_chain", LINKED + " SELECT chain, id, payload, row_hash FROM H")(lambda z: worklog.chain(worklog.conversation_log(z.table("conversations"))))
query("decision_chain_continued", LINKED + " SELECT chain, id, payload, row_hash FROM H WHERE id >= 2")(lambda z: _continued(z))


def _continued(z: Run) -> DataFrame:
    """The turns from 2 on, appended to chains that hold the earlier ones."""
    log = worklog.conversation_log(z.table("conversations"))
    return worklog.chain(log.filter("id >= 2"), worklog.chain(log.filter("id < 2")))


query(
    "chain_verified",
    """SELECT conv_id AS chain, count(*) AS length, NOT (conv_id % 3 = 0 AND count(*) FILTER (turn = 1) > 0) AS intact,
    CAST(CASE WHEN conv_id % 3 = 0 AND count(*) FILTER (turn = 1) > 0 THEN count(*) FILTER (turn < 1) END AS INT) AS first_bad FROM conversations GROUP BY conv_id""",
)(lambda z: _tampered(z))


def _tampered(z: Run) -> DataFrame:
    """Chains of which every third has its turn 1 changed after hashing."""
    rows = worklog.chain(worklog.conversation_log(z.table("conversations")))
    changed = F.when((F.col("chain") % 3 == 0) & (F.col("id") == 1), F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    return worklog.verify(rows.withColumn("payload", changed))


# packs and assessments
query(
    "packs",
    """SELECT printf('pack_%03d', (row_number() OVER (ORDER BY UN.rules_hit DESC, UN.abs_amount DESC, UN.entry_ref, XR.line_no) - 1) // 20 + 1) AS pack,
    UN.entry_ref, XR.line_no FROM UN JOIN XR ON XR.entry_ref = UN.entry_ref""",
    "jpfxun",
)(lambda z: worklog.packs(z.universe, z.xref, P))
PK = """WITH PK AS (SELECT printf('pack_%03d', (row_number() OVER (ORDER BY UN.rules_hit DESC, UN.abs_amount DESC, UN.entry_ref, XR.line_no) - 1) // 20 + 1) AS pack,
    UN.entry_ref, XR.line_no, flag_reasons, CAST(substr(UN.entry_ref, 3) AS BIGINT) AS k FROM UN JOIN XR ON XR.entry_ref = UN.entry_ref)"""
query(
    "rendered_packs",
    PK + """ SELECT pack, entry_ref, md5('DOCUMENT ' || entry_ref || chr(10) || string_agg(line_no || ' <untrusted_data>' || flag_reasons || '</untrusted_data>', chr(10) ORDER BY line_no)) AS block_md5
    FROM PK GROUP BY pack, entry_ref""",
    "jpfxun",
)(lambda z: _rendered(z))


def _rendered(z: Run) -> DataFrame:
    text = z.xref.select("entry_ref", "line_no", screen.sanitise(F.col("flag_reasons"), ()).alias("line"))
    return worklog.render_packs(worklog.packs(z.universe, z.xref, P), text).select("pack", "entry_ref", F.md5(F.col("block").cast("binary")).alias("block_md5"))


def _answers(z: Run) -> DataFrame:
    """Answers to packs with faults by document number: some left out, some given twice, some of unknown documents."""
    packed = worklog.packs(z.universe, z.xref, P).select("pack", "entry_ref").distinct()
    k = F.substring("entry_ref", 3, 20).cast("long")
    times = F.when(k % 5 == 0, 0).when(k % 7 == 0, 2).otherwise(1)
    given = packed.select("pack", "entry_ref", F.posexplode(F.sequence(F.lit(1), F.lit(2))).alias("position", "_i")).filter(F.col("_i") <= times).drop("_i")
    return given.unionByName(packed.filter(k % 11 == 0).select("pack", F.concat(F.lit("X"), "entry_ref").alias("entry_ref"), F.lit(0).alias("position")))


query(
    "pack_checks",
    PK + """, E AS (SELECT DISTINCT pack, entry_ref, k FROM PK) SELECT pack, entry_ref, 'missing' AS problem FROM E WHERE k % 5 = 0
    UNION ALL SELECT pack, entry_ref, 'duplicate' FROM E WHERE k % 7 = 0 AND k % 5 <> 0 UNION ALL SELECT pack, 'X' || entry_ref, 'unknown' FROM E WHERE k % 11 = 0""",
    "jpfxun",
)(lambda z: worklog.pack_problems(worklog.packs(z.universe, z.xref, P), _answers(z)))
query(
    "assessments_merged",
    PK + """ SELECT DISTINCT pack, entry_ref, 0 AS position FROM PK WHERE k % 5 <> 0 UNION ALL SELECT DISTINCT pack, 'X' || entry_ref, 0 FROM PK WHERE k % 11 = 0""",
    "jpfxun",
)(lambda z: worklog.first_assessments(_answers(z)).select("pack", "entry_ref", "position"))
query("assessment_coverage", "SELECT count(*) AS entries, count(a.entry_ref) AS assessed, round(count(a.entry_ref) / count(*), 4) AS coverage FROM UN LEFT JOIN AS_ a ON a.entry_ref = UN.entry_ref", "jpfxund")(
    lambda z: worklog.coverage(z.assessments, z.universe)
)
query("assessment_counts", "SELECT concern, action, count(*) AS assessments FROM AS_ GROUP BY ALL", "jpfxund")(
    lambda z: z.assessments.groupBy("concern", "action").agg(F.count("*").alias("assessments"))
)
query("assessment_reports", "SELECT entry_ref, concern, action, priority FROM AS_", "jpfxund")(lambda z: _reports(z).select("entry_ref", "concern", "action", "priority"))


def _reports(z: Run) -> DataFrame:
    """Assessments as nested JSON reports, one a pack, and read back."""
    item = F.struct("entry_ref", F.col("concern").alias("rationale_concern"), F.lit("").alias("concern_note"), F.col("action").alias("recommended_action"), "priority")
    by = z.assessments.groupBy((F.substring("entry_ref", 3, 20).cast("long") % 97).cast("string").alias("pack")).agg(F.sort_array(F.collect_list(item)).alias("assessments"))
    return ledger.assessments_of(by.select(F.from_json(F.to_json(F.struct("pack", "assessments")), ledger.REPORT).alias("r")).select("r.*"))


CONSISTENT = """SELECT hits, CAST(band AS BIGINT) AS band, pair, count(*) AS entries FROM (SELECT AS_.entry_ref, concern, hits, band, coalesce(pair, '-') AS pair FROM AS_
      JOIN (SELECT entry_ref, max(rules_hit) AS hits, floor(log10(CAST(max(abs_amount) + 1 AS DOUBLE))) AS band FROM XR GROUP BY entry_ref) s ON s.entry_ref = AS_.entry_ref
      LEFT JOIN (SELECT entry_ref, debit || '/' || credit AS pair FROM DP QUALIFY row_number() OVER (PARTITION BY entry_ref ORDER BY line_no, debit || '/' || credit) = 1) d ON d.entry_ref = AS_.entry_ref)
    GROUP BY hits, band, pair HAVING bool_or(concern = 'low') AND bool_or(concern = 'high') ORDER BY hits, band, pair LIMIT 10"""
query("consistency", CONSISTENT, "jpfxund")(lambda z: worklog.inconsistent(z.assessments, z.xref, rules.document_pairs(z.journal)))

# decisions
query("decisions", "SELECT entry_ref, decision, CAST(confidence AS DOUBLE) AS confidence FROM DC", "jpfxund")(lambda z: z.decisions)
query(
    "decision_bypass",
    """SELECT count(*) AS entries, count(*) FILTER (a.entry_ref IS NULL) AS unassessed, count(*) FILTER (confidence < 0.75) AS bypassed FROM DC LEFT JOIN AS_ a ON a.entry_ref = DC.entry_ref""",
    "jpfxund",
)(lambda z: worklog.bypassed(z.universe, z.assessments, replace(P, min_confidence=0.75)))
PILOT = "SELECT entry_ref, CASE WHEN concern = 'high' OR priority >= 4 THEN 'inspect' ELSE 'accept' END AS decision FROM AS_"
query("pilot_decisions", PILOT, "jpfxund")(lambda z: worklog.pilot_decide(z.assessments))
query("review_completeness", "SELECT UN.entry_ref FROM UN WHERE entry_ref NOT IN (SELECT entry_ref FROM AS_)", "jpfxund")(lambda z: worklog.undecided(z.universe, worklog.pilot_decide(z.assessments)))
query(
    "review_funnel",
    """SELECT (SELECT count(DISTINCT entry_ref) FROM XR) AS flagged, (SELECT count(*) FROM UN) AS selected, (SELECT count(*) FROM AS_) AS decided,
    (SELECT count(*) FROM UN) - (SELECT count(*) FROM AS_) AS pending, (SELECT count(DISTINCT ccy) FROM ST WHERE NOT chosen) AS excluded_currencies""",
    "jpfxuand",
)(lambda z: worklog.funnel(z.xref, z.universe, worklog.pilot_decide(z.assessments), review.excluded_currencies(z.entries, P)))
query(
    "universe_decisions",
    f"SELECT UN.entry_ref, rules_hit, coalesce(decision, 'pending') AS decision FROM UN LEFT JOIN ({PILOT}) p ON p.entry_ref = UN.entry_ref",
    "jpfxund",
)(lambda z: worklog.with_decisions(z.universe, worklog.pilot_decide(z.assessments)).select("entry_ref", "rules_hit", "decision"))
query("triage_list", "SELECT entry_ref, priority, CAST(row_number() OVER (ORDER BY priority DESC, entry_ref) AS INT) AS place FROM AS_ ORDER BY place LIMIT 50", "jpfxund")(
    lambda z: worklog.triage_list(z.assessments, 50)
)


def _log(z: Run) -> DataFrame:
    """A decision log by document number: one or two rounds, with unknown decisions and missing reasons among them."""
    k = F.substring("entry_ref", 3, 20).cast("long")
    pick = lambda n: F.element_at(F.array(*map(F.lit, ("inspect", "accept", "override", "maybe"))), (n % 4).cast("int") + 1)
    rounds = z.universe.select("entry_ref", k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("r")).filter("r = 0 OR k % 2 = 0")
    reason = F.when(F.col("k") % 3 == 0, " ").when(F.col("k") % 3 == 1, "checked")
    return rounds.select((F.col("k") * 2 + F.col("r")).alias("id"), F.lit("run").alias("run_id"), "entry_ref", pick(F.col("k") + F.col("r")).alias("decision"), reason.alias("reason"))


LOG = """WITH LG AS (SELECT k * 2 + r AS id, entry_ref, ['inspect', 'accept', 'override', 'maybe'][CAST((k + r) % 4 AS INT) + 1] AS decision,
    CASE k % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'checked' END AS reason FROM (SELECT entry_ref, CAST(substr(entry_ref, 3) AS BIGINT) AS k FROM UN) CROSS JOIN (SELECT unnest([0, 1]) AS r) WHERE r = 0 OR k % 2 = 0)"""
query("effective_decisions", LOG + " SELECT entry_ref, max(id) AS id, arg_max(decision, id) AS decision FROM LG GROUP BY entry_ref", "jpfxun")(
    lambda z: worklog.effective(_log(z)).select("entry_ref", "id", "decision")
)
query(
    "decision_checks",
    LOG + """ SELECT id, entry_ref, CASE WHEN decision = 'maybe' THEN 'unknown decision' ELSE 'override needs a reason' END AS problem FROM LG
    WHERE decision = 'maybe' OR (decision = 'override' AND trim(coalesce(reason, '')) = '')""",
    "jpfxun",
)(lambda z: worklog.decision_problems(_log(z)).select("id", "entry_ref", "problem"))
query("decisions_file", LOG + " SELECT entry_ref, arg_max(decision, id) AS decision FROM LG GROUP BY entry_ref", "jpfxun")(lambda z: _file(z))


def _file(z: Run) -> DataFrame:
    """Effective decisions as JSON objects by entry, one for each of some groups, and read back."""
    pair = F.struct("entry_ref", F.struct("decision", "reason").alias("d"))
    by = worklog.effective(_log(z)).groupBy(F.crc32("entry_ref") % 31).agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("value"))
    return ledger.decisions_of(by).select("entry_ref", "decision")


DQ_ALL = """W AS (SELECT * FROM (VALUES ('dq_extract_shortfall_declared', 'critical', TRUE), ('dq_missing_fields', 'info', FALSE), ('dq_unbalanced_docs', 'critical', FALSE)) t(warning_id, severity, fixed)
    WHERE (warning_id = 'dq_extract_shortfall_declared' AND (SELECT max(posting_date) FROM J) < DATE '2002-01-31')
    OR (warning_id = 'dq_missing_fields' AND (SELECT count(*) FROM J WHERE username IS NULL OR description IS NULL OR currency IS NULL) > 0)
    OR (warning_id = 'dq_unbalanced_docs' AND EXISTS (SELECT 1 FROM J GROUP BY entry_ref HAVING abs(sum(amount)) > 100000)))"""
ACK = ("dq_extract_shortfall_declared", "dq_missing_fields", "dq_unbalanced_docs")


def _acks(z: Run) -> DataFrame:
    """Acknowledgements of three kinds of warning that apply; one has no reason."""
    return z.warnings.filter(F.col("warning_id").isin(*ACK)).select("warning_id", F.when(F.col("warning_id") != "dq_unbalanced_docs", "known").alias("reason"), F.lit("year").alias("scope"))


query(
    "ack_checks",
    f"WITH {DQ_ALL} SELECT warning_id, CASE WHEN warning_id = 'dq_unbalanced_docs' THEN 'needs a reason' ELSE 'cannot be dismissed' END AS problem FROM W WHERE fixed OR warning_id = 'dq_unbalanced_docs'",
    "j",
)(lambda z: worklog.acknowledgement_problems(_acks(z), z.warnings).select("warning_id", "problem"))
query("ack_limitations", f"WITH {DQ_ALL} SELECT warning_id, 'limitation: ' || warning_id || ' (year)' AS limitation FROM W WHERE severity = 'critical'", "j")(
    lambda z: worklog.limitations(_acks(z), z.warnings)
)
query(
    "disposition_checks",
    """SELECT doc_id AS event_ref, CASE WHEN doc_id % 4 = 3 THEN 'unknown disposition' ELSE 'needs a reason' END AS problem FROM documents WHERE doc_id % 4 = 3 OR doc_id % 5 = 0""",
)(lambda z: worklog.disposition_problems(_dispositions(z)).select("event_ref", "problem"))


def _dispositions(z: Run) -> DataFrame:
    known = F.element_at(F.array(*map(F.lit, (*worklog.DISPOSITIONS, "unsure"))), (F.col("doc_id") % 4).cast("int") + 1)
    return z.documents.select(F.col("doc_id").alias("event_ref"), known.alias("disposition"), F.when(F.col("doc_id") % 5 != 0, "read").otherwise(" ").alias("reason"))


# facts, citations, gates
FACTS = f"""FA AS (SELECT 'run_id' AS fact_key, 'run-1' AS fact_value UNION ALL SELECT 'period_end', '2000-12-31'
    UNION ALL SELECT 'population_lines', CAST((SELECT count(*) FROM J) AS VARCHAR) UNION ALL SELECT 'flagged_documents', CAST((SELECT count(DISTINCT entry_ref) FROM XR) AS VARCHAR)
    UNION ALL SELECT 'universe_size', CAST((SELECT count(*) FROM UN) AS VARCHAR) UNION ALL SELECT 'total_flagged_before_cap', CAST((SELECT count(*) FROM BA WHERE base_amount >= 100000) AS VARCHAR)
    UNION ALL SELECT 'selection_basis', CASE WHEN EXISTS (SELECT 1 FROM BA WHERE ccy NOT IN (SELECT ccy FROM FX)) THEN 'currency-stratified fallback' ELSE 'targeted' END
    UNION ALL SELECT 'decisions_' || d, CAST((SELECT count(*) FROM DC WHERE decision = d) AS VARCHAR) FROM (SELECT unnest(['inspect', 'accept', 'override']) AS d)
    UNION ALL SELECT 'followups_recorded', CAST((SELECT count(*) FROM AS_ WHERE priority = 5) AS VARCHAR)
    UNION ALL SELECT 'consistency_warnings', CAST((SELECT count(*) FROM ({CONSISTENT})) AS VARCHAR)
    UNION ALL SELECT 'rule_' || rule, CAST(count(*) AS VARCHAR) FROM FL GROUP BY rule)"""


def _facts(z: Run) -> DataFrame:
    flags = z.flags  # first, so that the cross-reference reads it
    followups, divergent = z.assessments.filter("priority = 5"), worklog.inconsistent(z.assessments, z.xref, rules.document_pairs(z.journal))
    material = review.material(z.entries, P_CAP)
    return worklog.facts("run-1", P, z.journal, flags, z.xref, z.universe, material, z.decisions, followups, divergent, review.fx_missing(z.entries, P))


query("facts", f"WITH {FACTS} SELECT * FROM FA", "jpfxund")(_facts)
REQUIRED = ("population_lines", "flagged_documents", "universe_size", "decisions_inspect", "decisions_accept", "decisions_override")


def _sections(z: Run) -> DataFrame:
    """A section for each rule that cites its count, one that cites too little and one that cites nothing."""
    rows = [(r, f"There were [fact:rule_{r}] flags.") for r in rules.RULES] + [("scope", "[fact:population_lines] lines, [fact:flagged_documents] documents, [fact:lost] more"), ("end", "All is well.")]
    return z.spark.createDataFrame(rows, "heading string, text string")


query(
    "citation_checks",
    """SELECT 'unknown key' AS problem, 'lost' AS what UNION ALL SELECT 'unknown key', 'rule_' || r FROM (SELECT unnest(['manual_entries', 'period_end', 'round_amounts', 'date_divergence', 'entry_splitting',
    'balance_check', 'unusual_users', 'unusual_pairs', 'reversals', 'high_risk_system_pairs']) AS r) WHERE r NOT IN (SELECT rule FROM FL)
    UNION ALL SELECT 'not cited', unnest(['universe_size', 'decisions_inspect', 'decisions_accept', 'decisions_override']) UNION ALL SELECT 'no citation', 'end'""",
    "jpf",
)(lambda z: worklog.citation_problems(_sections(z), worklog.rule_facts(z.found).unionByName(_two_facts(z)), REQUIRED))


def _two_facts(z: Run) -> DataFrame:
    n = z.journal.agg(F.count("*").cast("string").alias("v"))
    return n.select(F.explode(F.array(F.lit("population_lines"), F.lit("flagged_documents"))).alias("fact_key"), F.col("v").alias("fact_value"))


query(
    "citations_resolved",
    """SELECT rule AS heading, 'There were rule_' || rule || '=' || count(*) || ' flags.' AS text FROM FL GROUP BY rule
    UNION ALL SELECT r, 'There were rule_' || r || '=? flags.' FROM (SELECT unnest(['manual_entries', 'period_end', 'round_amounts', 'date_divergence', 'entry_splitting', 'balance_check',
    'unusual_users', 'unusual_pairs', 'reversals', 'high_risk_system_pairs']) AS r) WHERE r NOT IN (SELECT rule FROM FL)
    UNION ALL SELECT 'scope', 'population_lines=? lines, flagged_documents=? documents, lost=? more' UNION ALL SELECT 'end', 'All is well.'""",
    "jpf",
)(lambda z: worklog.resolve_citations(_sections(z), worklog.rule_facts(z.found)))
query(
    "limitations_active",
    f"""WITH {DQ_ALL}, MISS AS (SELECT DISTINCT ccy FROM BA WHERE ccy NOT IN (SELECT ccy FROM FX)) SELECT replace(warning_id, 'dq_', 'dq_') AS id FROM W WHERE severity = 'critical'
    UNION ALL SELECT 'currency_stratified_fallback' FROM MISS HAVING count(*) > 0 UNION ALL SELECT DISTINCT 'currency_excluded_' || ccy FROM ST WHERE NOT chosen AND EXISTS (SELECT 1 FROM MISS)""",
    "jpfxua",
)(lambda z: review.active_limitations(z.entries, P, z.warnings, _nothing(z, "warning_id")))
# the same where a currency has no rate: the fallback and the currencies it cuts are limitations too
P_RATELESS = replace(P, fx=P.fx[:3])
query(
    "limitations_without_rates",
    f"""WITH {DQ_ALL} SELECT warning_id AS id FROM W WHERE severity = 'critical' UNION ALL SELECT 'currency_stratified_fallback' FROM BA WHERE ccy = 'MAD' HAVING count(*) > 0
    UNION ALL SELECT DISTINCT 'currency_excluded_' || ccy FROM ST WHERE NOT chosen AND EXISTS (SELECT 1 FROM BA WHERE ccy = 'MAD')""",
    "jpfxua",
)(lambda z: review.active_limitations(z.entries, P_RATELESS, z.warnings, _nothing(z, "warning_id")))


def _nothing(z: Run, column: str) -> DataFrame:
    return z.spark.createDataFrame([], f"{column} string")


query(
    "gate_report",
    f"""WITH {DQ_ALL} SELECT 'review' AS gate, count(*) = 0 AS passed, count(*) AS problems, min(entry_ref) AS example FROM UN WHERE entry_ref NOT IN (SELECT entry_ref FROM AS_)
    UNION ALL SELECT 'procedures', FALSE, 1, 'balance_check'
    UNION ALL SELECT 'citations', FALSE, 6 + (SELECT count(*) FROM (SELECT unnest(['manual_entries', 'period_end', 'round_amounts', 'date_divergence', 'entry_splitting',
    'balance_check', 'unusual_users', 'unusual_pairs', 'reversals', 'high_risk_system_pairs']) AS r) WHERE r NOT IN (SELECT rule FROM FL)), 'no citation: end'
    UNION ALL SELECT 'limitations', count(*) = 0, count(*), min(warning_id) FROM W WHERE severity = 'critical'""",
    "jpfxund",
)(lambda z: _gates(z))


def _gates(z: Run) -> DataFrame:
    """Gates of a run whose assessed entries are decided, of whose rules two are made to fail, and which accepts one of these gaps."""
    flags = z.flags
    _, outcomes = rules.run(z.journal, P, ("period_end", "balance_check", "reversals"), zone, {"balance_check": _out_of_order, "reversals": _out_of_order})
    failed = outcomes.filter("outcome = 'failed'").select(F.col("rule").alias("id"))
    accepted = z.spark.createDataFrame([("reversals",)], "id string")
    problems = worklog.citation_problems(_sections(z), worklog.rule_facts(flags).unionByName(_two_facts(z)), REQUIRED)
    active = review.active_limitations(z.entries, P, z.warnings, _nothing(z, "warning_id"))
    return worklog.gates(z.universe, worklog.pilot_decide(z.assessments), failed, accepted, _sections(z), problems, active)


def _out_of_order(journal: DataFrame, p) -> DataFrame:
    """Fails when its rows are asked for, not when it is put together."""
    return journal.select(F.raise_error(F.lit("out of order")).cast("string").alias("rule"), "entry_ref", "line_no", "username", "amount", F.lit("").alias("flag_reason"))


# report tables
query(
    "rule_matrix",
    """SELECT r AS rule, count(FL.rule) AS flagged, round(count(FL.rule) / (SELECT count(*) FROM J), 6) AS share,
    CASE WHEN count(FL.rule) = 0 THEN 'clean' WHEN count(FL.rule) <= 5000 THEN 'review driver' ELSE 'ranked' END AS outcome
    FROM (SELECT unnest(['manual_entries', 'period_end', 'round_amounts', 'date_divergence', 'entry_splitting', 'balance_check', 'unusual_users', 'unusual_pairs', 'reversals',
    'high_risk_system_pairs']) AS r) LEFT JOIN FL ON FL.rule = r GROUP BY r""",
    "jpf",
)(lambda z: worklog.rule_matrix(z.found, z.journal))
query(
    "monthly_profile",
    """SELECT rule, strftime(posting_date, '%Y-%m') AS month, CAST(sum(abs(J.amount)) AS DOUBLE) AS volume FROM FL JOIN J ON J.entry_ref = FL.entry_ref AND J.line_no = FL.line_no GROUP BY ALL""",
    "jpf",
)(lambda z: worklog.monthly(z.found, z.journal))
query("drill_down", "SELECT entry_ref, " + ", ".join(f"bool_or(rule = '{r}') AS {r}" for r in rules.RULES) + " FROM FL GROUP BY entry_ref", "jpf")(lambda z: worklog.drill_down(z.found))
query(
    "export",
    """SELECT XR.entry_ref, XR.line_no, rules_hit, abs_amount, flag_reasons, selection_basis, posting_date, username, is_manual, entry_type_source, account, J.amount, currency, description,
    coalesce(source_doc, J.entry_ref) AS source_doc FROM XR JOIN J ON J.entry_ref = XR.entry_ref AND J.line_no = XR.line_no""",
    "jpfx",
)(lambda z: worklog.export_rows(z.xref, z.journal))
query(
    "executive_figures",
    """SELECT (SELECT count(*) FROM J) AS population, (SELECT count(DISTINCT entry_ref) FROM XR) AS flagged_documents, (SELECT count(*) FROM UN) AS universe,
    (SELECT count(*) FROM DC WHERE decision = 'inspect') AS inspect, (SELECT count(*) FROM DC WHERE decision = 'accept') AS accept, (SELECT count(*) FROM DC WHERE decision = 'override') AS override,
    (SELECT count(*) FROM AS_ WHERE concern = 'high') AS high_concern, (SELECT count(*) FROM FL WHERE rule = 'balance_check') AS unbalanced""",
    "jpfxund",
)(lambda z: worklog.executive_figures(z.journal, z.flags, z.xref, z.universe, z.decisions, z.assessments))
query(
    "findings",
    """SELECT 'high' AS severity, count(*) || ' unbalanced documents' AS finding FROM FL WHERE rule = 'balance_check' HAVING count(*) > 0
    UNION ALL SELECT 'medium', username || ' in ' || count(DISTINCT J.entry_ref) || ' reviewed documents' FROM J JOIN AS_ ON AS_.entry_ref = J.entry_ref GROUP BY username HAVING count(DISTINCT J.entry_ref) >= 3
    UNION ALL SELECT 'low', 'first digits ' || band FROM (SELECT CASE WHEN n < 100 THEN 'insufficient' WHEN m < 0.004 THEN 'close' WHEN m < 0.008 THEN 'acceptable' WHEN m < 0.01 THEN 'marginal' ELSE 'nonconforming' END AS band
     FROM (SELECT sum(c) AS n, sum(abs(c / t - log10(1 + 1 / d))) / 9 AS m FROM (SELECT d, (SELECT count(*) FROM J WHERE abs(amount) >= 1 AND left(CAST(CAST(floor(abs(amount)) AS BIGINT) AS VARCHAR), 1) = CAST(d AS VARCHAR)) AS c,
      (SELECT count(*) FROM J WHERE abs(amount) >= 1) AS t FROM (SELECT unnest(range(1, 10)) AS d)))) WHERE band IN ('marginal', 'nonconforming')""",
    "jpfxund",
)(lambda z: worklog.findings(z.flags, z.journal.join(z.assessments.select("entry_ref"), "entry_ref"), review.benford(z.journal)))
BENF = """BF AS (SELECT CAST(sum(c) AS DOUBLE) AS n, round(sum(abs(c / t - log10(1 + 1 / d))) / 9, 6) AS mad FROM (SELECT d, (SELECT count(*) FROM J WHERE abs(amount) >= 1
    AND left(CAST(CAST(floor(abs(amount)) AS BIGINT) AS VARCHAR), 1) = CAST(d AS VARCHAR)) AS c, (SELECT count(*) FROM J WHERE abs(amount) >= 1) AS t FROM (SELECT unnest(range(1, 10)) AS d)))"""
query(
    "engagement_metrics",
    f"""WITH {FACTS}, {BENF} SELECT fact_key AS metric, CAST(fact_value AS DOUBLE) AS value FROM FA WHERE regexp_full_match(fact_value, '[0-9]+')
    UNION ALL SELECT 'benford_n', n FROM BF UNION ALL SELECT 'benford_mad', mad FROM BF""",
    "jpfxund",
)(lambda z: worklog.metrics(_facts(z), review.benford(z.journal)))
SCOPE_ROWS = ", ".join("(CAST({} AS INT), '{}', '{}')".format(i + 1, name, text.replace("'", "''")) for i, (name, text) in enumerate(sorted(worklog.SCOPE.items())))
query(
    "workpaper_tables",
    f"""WITH {DQ_ALL}, RF AS (SELECT 'rule_' || rule AS k, CAST(count(*) AS VARCHAR) AS v FROM FL GROUP BY rule)
    SELECT 'summary' AS sheet, CAST(row_number() OVER (ORDER BY k) AS INT) AS position, k AS name, v AS content FROM RF
    UNION ALL SELECT 'data quality', CAST(row_number() OVER (ORDER BY warning_id) AS INT), warning_id, CASE WHEN warning_id <> 'dq_unbalanced_docs' THEN 'known' END FROM W
    UNION ALL SELECT 'limitations', CAST(row_number() OVER (ORDER BY warning_id) AS INT), warning_id, 'accepted' FROM W WHERE severity = 'critical'
    UNION ALL SELECT 'narrative', CAST(row_number() OVER (ORDER BY heading) AS INT), heading, text FROM (SELECT r AS heading, 'There were rule_' || r || '=' || coalesce(v, '?') || ' flags.' AS text
      FROM (SELECT unnest(['manual_entries', 'period_end', 'round_amounts', 'date_divergence', 'entry_splitting', 'balance_check', 'unusual_users', 'unusual_pairs', 'reversals', 'high_risk_system_pairs']) AS r)
      LEFT JOIN RF ON k = 'rule_' || r UNION ALL SELECT 'scope', 'population_lines=? lines, flagged_documents=? documents, lost=? more' UNION ALL SELECT 'end', 'All is well.')
    UNION ALL SELECT 'scope', * FROM (VALUES {SCOPE_ROWS}) t(position, name, content)
    UNION ALL SELECT 'governance', 1, 'chain_integrity_verified', CASE WHEN count(*) FILTER (conv_id % 3 = 0 AND turn = 1) > 0 THEN 'false' ELSE 'true' END FROM conversations""",
    "jpf",
)(lambda z: _workpaper(z))


def _workpaper(z: Run) -> DataFrame:
    known = worklog.rule_facts(z.found)
    limits = worklog.limitations(_acks(z), z.warnings).select(F.col("warning_id").alias("id"))
    return worklog.workpaper(known, worklog.resolve_citations(_sections(z), known), limits, _acks(z), _tampered(z))


# scores
LAB = """WITH LB AS (SELECT entry_ref, CASE k WHEN 0 THEN 'period_end' WHEN 1 THEN 'round_amounts' WHEN 2 THEN 'date_divergence' WHEN 3 THEN 'entry_splitting' WHEN 4 THEN 'balance_check'
    WHEN 5 THEN 'unusual_users' WHEN 6 THEN 'unusual_pairs' WHEN 7 THEN 'reversals' WHEN 8 THEN 'high_risk_system_pairs' END AS rule
    FROM (SELECT entry_ref, CAST(substr(entry_ref, 3) AS BIGINT) % 30 AS k FROM (SELECT DISTINCT entry_ref FROM J)) WHERE k < 9)"""
SCORES = """, P_ AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS r FROM C)
    SELECT {k} tp, fp, fn, round(p, 4) AS "precision", round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 1.0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM P_"""
COUNTS = """count(*) FILTER (flagged AND labelled) AS tp, count(*) FILTER (flagged AND NOT known) AS fp, count(*) FILTER (labelled AND NOT flagged) AS fn"""
query(
    "evaluation",
    LAB + f""", E AS (SELECT coalesce(f.rule, l.rule) AS rule, f.entry_ref IS NOT NULL AS flagged, l.entry_ref IS NOT NULL AS labelled, o.entry_ref IS NOT NULL AS known
    FROM (SELECT DISTINCT rule, entry_ref FROM FL WHERE rule <> 'manual_entries') f FULL JOIN LB l ON l.rule = f.rule AND l.entry_ref = f.entry_ref LEFT JOIN LB o ON o.entry_ref = f.entry_ref),
    C AS (SELECT n.rule, {COUNTS} FROM (SELECT unnest(['period_end', 'round_amounts', 'date_divergence', 'entry_splitting', 'balance_check', 'unusual_users', 'unusual_pairs', 'reversals',
    'high_risk_system_pairs']) AS rule) n LEFT JOIN E ON E.rule = n.rule GROUP BY n.rule)""" + SCORES.format(k="rule,"),
    "jpf",
)(lambda z: evaluate.by_rule(z.found, z.labels, evaluate.SCORED))
query(
    "evaluation_total",
    LAB + """, A9 AS (SELECT DISTINCT entry_ref FROM FL WHERE rule <> 'manual_entries'), C AS (SELECT (SELECT count(*) FROM LB WHERE entry_ref IN (SELECT entry_ref FROM A9)) AS tp,
    (SELECT count(*) FROM A9 WHERE entry_ref NOT IN (SELECT entry_ref FROM LB)) AS fp, (SELECT count(*) FROM LB WHERE entry_ref NOT IN (SELECT entry_ref FROM A9)) AS fn)""" + SCORES.format(k=""),
    "jpf",
)(lambda z: evaluate.total(z.found, z.labels))
query(
    "universe_recall",
    LAB + """ SELECT count(*) AS eligible, count(UN.entry_ref) AS selected, round(CASE WHEN count(*) = 0 THEN 1.0 ELSE count(UN.entry_ref) / count(*) END, 4) AS recall
    FROM LB JOIN DA ON DA.entry_ref = LB.entry_ref AND DA.abs_amount >= 100000 LEFT JOIN UN ON UN.entry_ref = LB.entry_ref""",
    "jpfxun",
)(lambda z: evaluate.universe_recall(z.labels, z.journal, z.universe, P))
query(
    "assessment_agreement",
    LAB + """, G AS (SELECT count(*) AS assessed, count(LB.entry_ref) AS labelled, count(*) FILTER (LB.entry_ref IS NOT NULL AND action = 'inspect') AS labelled_inspect, count(*) FILTER (action = 'inspect') AS inspected,
    count(*) FILTER (LB.entry_ref IS NULL) AS clean, count(*) FILTER (LB.entry_ref IS NULL AND action = 'accept_flag') AS clean_accepted FROM AS_ LEFT JOIN LB ON LB.entry_ref = AS_.entry_ref)
    SELECT *, round(CASE WHEN labelled = 0 THEN 1.0 ELSE labelled_inspect / labelled END, 4) AS inspect_recall, round(CASE WHEN inspected = 0 THEN 1.0 ELSE labelled_inspect / inspected END, 4) AS inspect_precision FROM G""",
    "jpfxund",
)(lambda z: evaluate.agreement(z.assessments, z.labels))
query("parameter_sweep", "SELECT v AS variant, count(*) AS flagged FROM J, (SELECT unnest([100, 500, 1000]) AS v) WHERE abs(amount) >= 10000 AND CAST(abs(amount) AS BIGINT) % v = 0 GROUP BY v", "j")(
    lambda z: evaluate.round_sweep(z.lines, (100, 500, 1000), P)
)
VARIANTS = {"given": P, "narrow": replace(P, window_days=1, post_close_days=3), "coarse": replace(P, round_multiple=500, gap_days=1000)}
query(
    "parameter_scores",
    LAB + f""", V AS (SELECT * FROM (VALUES ('given', 5, 10, 100, 1500), ('narrow', 1, 3, 100, 1500), ('coarse', 5, 10, 500, 1000)) t(variant, before, after, multiple, gap)),
    FV AS (SELECT DISTINCT variant, 'period_end' AS rule, entry_ref FROM J, V WHERE is_manual AND posting_date BETWEEN DATE '2000-12-31' - before AND DATE '2000-12-31' + after
     UNION SELECT DISTINCT variant, 'round_amounts', entry_ref FROM J, V WHERE abs(amount) >= 10000 AND CAST(abs(amount) AS BIGINT) % multiple = 0
     UNION SELECT DISTINCT variant, 'date_divergence', entry_ref FROM J, V WHERE abs(posting_date - document_date) > gap OR entry_created_date > DATE '2000-12-31'),
    L3 AS (SELECT variant, LB.rule, entry_ref FROM LB, V WHERE LB.rule IN ('period_end', 'round_amounts', 'date_divergence')),
    E AS (SELECT coalesce(f.variant, l.variant) AS variant, coalesce(f.rule, l.rule) AS rule, f.entry_ref IS NOT NULL AS flagged, l.entry_ref IS NOT NULL AS labelled, o.entry_ref IS NOT NULL AS known
    FROM FV f FULL JOIN L3 l ON l.variant = f.variant AND l.rule = f.rule AND l.entry_ref = f.entry_ref LEFT JOIN LB o ON o.entry_ref = f.entry_ref),
    C AS (SELECT n.variant, n.rule, {COUNTS} FROM (SELECT variant, rule FROM V, (SELECT unnest(['period_end', 'round_amounts', 'date_divergence']) AS rule)) n LEFT JOIN E ON E.variant = n.variant AND E.rule = n.rule
    GROUP BY n.variant, n.rule)""" + SCORES.format(k="variant, rule,"),
    "j",
)(lambda z: evaluate.sweep(z.journal, z.labels, VARIANTS))
SWEPT = {
    "given": P,
    "strict": replace(P, window_days=2, round_multiple=500, gap_days=2000, split_count=5, balance_tolerance=150000, rare_threshold=250, reversal_tolerance=50, account_share=0.005),
    "loose": replace(P, post_close_days=20, round_min=5000, gap_days=1000, split_ratio=0.5, split_days=60, balance_tolerance=50000, rare_threshold=290, min_baseline=2, account_share=0.03),
    "whole_baseline": replace(P, exclude_flagged=False, match_days=15, high_risk_users=("U5", "SAP1")),
}
#: The limits of each set as they stand in the SQL of the rules, and what takes their place.
SWEPT_SQL = {
    "given": {},
    "strict": {
        "2000-12-26": "2000-12-29", "% 100 = 0": "% 500 = 0", "> 1500": "> 2000", "n >= 3 AND s": "n >= 5 AND s", "abs(sum(amount)) > 100000": "abs(sum(amount)) > 150000", "<= 270": "<= 250", "<= 200": "<= 50",
        "share < 0.01": "share < 0.005",
    },
    "loose": {
        "2001-01-10": "2001-01-20", "abs(amount) >= 10000 AND": "abs(amount) >= 5000 AND", "> 1500": "> 1000", ">= 35000": ">= 25000", "// 30": "// 60", "abs(sum(amount)) > 100000": "abs(sum(amount)) > 50000",
        "<= 270": "<= 290", "THEN 0 ELSE 1 END < 1": "THEN 0 ELSE 1 END < 2", "share < 0.01": "share < 0.03",
    },
    "whole_baseline": {" AND entry_ref NOT IN (SELECT entry_ref FROM F7)": "", "2001-01-30": "2001-01-15", "'U5', 'U7', 'SAP1', 'SAP2'": "'U5', 'SAP1'"},
}


def _swept_sql(select: str) -> str:
    """The select over the flags FL of each set, each in a subquery of its own."""
    parts = []
    for name, changes in SWEPT_SQL.items():
        text = f"{PAIRS}, {F_ALL}"
        for a, b in changes.items():
            assert a in text, a
            text = text.replace(a, b)
        parts.append(f"SELECT '{name}' AS variant, x.* FROM (WITH {text} {select}) x")
    return " UNION ALL ".join(parts)


NINE = "(SELECT unnest(['period_end', 'round_amounts', 'date_divergence', 'entry_splitting', 'balance_check', 'unusual_users', 'unusual_pairs', 'reversals', 'high_risk_system_pairs']) AS rule)"
SWEEP_COUNTS = f"""SELECT n.rule, {COUNTS} FROM {NINE} n LEFT JOIN (SELECT coalesce(f.rule, l.rule) AS rule, f.entry_ref IS NOT NULL AS flagged, l.entry_ref IS NOT NULL AS labelled, o.entry_ref IS NOT NULL AS known
    FROM (SELECT DISTINCT rule, entry_ref FROM FL WHERE rule <> 'manual_entries') f FULL JOIN LB l ON l.rule = f.rule AND l.entry_ref = f.entry_ref LEFT JOIN LB o ON o.entry_ref = f.entry_ref) E ON E.rule = n.rule GROUP BY n.rule
    UNION ALL SELECT 'all rules', count(*) FILTER (a.entry_ref IS NOT NULL AND LB.entry_ref IS NOT NULL), count(*) FILTER (LB.entry_ref IS NULL), count(*) FILTER (a.entry_ref IS NULL)
    FROM (SELECT DISTINCT entry_ref FROM FL WHERE rule <> 'manual_entries') a FULL JOIN LB ON LB.entry_ref = a.entry_ref"""
query("sweep_scores", LAB + f", C AS ({_swept_sql(SWEEP_COUNTS)})" + SCORES.format(k="variant, rule,"), "j")(lambda z: sweep.scores(sweep.marks(z.journal, SWEPT), z.labels, list(SWEPT)))
query("sweep_documents", _swept_sql("SELECT rule, count(DISTINCT entry_ref) AS documents FROM FL GROUP BY rule"), "j")(lambda z: sweep.flagged(sweep.marks(z.journal, SWEPT), list(SWEPT)).filter("documents > 0"))
query("reproducibility", "SELECT count(*) AS n, TRUE AS same FROM FL", "jpf")(lambda z: _twice(z))


def _twice(z: Run) -> DataFrame:
    """The flags of the journal and of the same journal dealt otherwise, by lines in place of documents, compared by count and hash."""
    other = zone(z.journal.repartition("account", "posting_date", "username"))
    first, second = ledger.content_hash(z.found), ledger.content_hash(rules.flags(other, P))
    return first.crossJoin(second.toDF("n2", "hash2")).select("n", ((F.col("n") == F.col("n2")) & (F.col("hash") == F.col("hash2"))).alias("same"))


DIG = r"""X AS (SELECT left(md5(entry_ref), 2) AS part, md5(concat_ws(chr(31), coalesce(CAST(amount AS VARCHAR), chr(0)), coalesce(entry_ref, chr(0)), coalesce(flag_reason, chr(0)),
    coalesce(CAST(line_no AS VARCHAR), chr(0)), coalesce(rule, chr(0)), coalesce(username, chr(0)))) AS d FROM FL),
PARTS AS (SELECT part, count(*) AS n, CAST(sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS VARCHAR) AS a, CAST(sum(CAST('0x' || substr(d, 16, 15) AS BIGINT)) AS VARCHAR) AS b FROM X GROUP BY part)"""
query("flag_digests", f"WITH {DIG} SELECT * FROM PARTS", "jpf")(lambda z: evaluate.digests(z.flags, "entry_ref").withColumns({c: F.col(c).cast("string") for c in ("a", "b")}))
query(
    "reproducibility_placed",
    """WITH C AS (SELECT min(entry_ref) AS e FROM FL), M AS (SELECT FL.* FROM FL JOIN C ON entry_ref = e) SELECT rule, entry_ref, line_no, flag_reason, side FROM M, (SELECT unnest([1, 2]) AS side)""",
    "jpf",
)(lambda z: _placed(z))


def _placed(z: Run) -> DataFrame:
    """A planted change of one document's flags, found by the digests kept beside both tables: only the parts that differ are read."""
    one = z.flags.agg(F.min("entry_ref").alias("_e"))
    other = zone(z.flags.join(F.broadcast(one)).withColumn("flag_reason", F.when(F.col("entry_ref") == F.col("_e"), F.concat("flag_reason", F.lit("!"))).otherwise(F.col("flag_reason"))).drop("_e"))
    trees = [zone(evaluate.digest_tree(evaluate.digests(t, "entry_ref"))) for t in (z.flags, other)]
    found = evaluate.changed_rows(z.flags, other, "entry_ref", evaluate.differing(*trees))
    return found.select("rule", "entry_ref", "line_no", F.regexp_replace("flag_reason", "!$", "").alias("flag_reason"), "side")
