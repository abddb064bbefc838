"""Many extracts in one job, the registry of their digests, proposals of columns, and data-quality warnings."""

import datetime as dt
from decimal import Decimal

import pytest

from ledgersift.operators import review, worklog
from ledgersift.plans.params import Params
from ledgersift.sources import extracts, ledger

P = Params(period_end=dt.date(2026, 6, 30))
JOURNAL = "entry_ref string, line_no int, posting_date date, username string, amount decimal(18,2), currency string, description string"


@pytest.fixture
def files(tmp_path):
    def write(**texts):
        for name, text in texts.items():
            (tmp_path / f"{name}.csv").write_bytes(text.encode())
        return str(tmp_path)

    return write


NAME = r"([^/]+)\.csv$"


def test_layouts_meet_in_one_journal(spark, files, monkeypatch):
    path = files(
        a='﻿BELNR,LINE,BUDAT,DMBTR,SGTXT,DMBTR\r\nE1,1,2026-04-05,"1.234,50","said ""no"", twice",9\r\n\r\nE1,1,2026-04-05,5\r\n',
        b="Voucher;Post Date;Net Amount\nE1;05.04.2026;12,5\nE2;never;1;extra;more\n",
        c="BELNR|BUDAT\nE9|2026-01-01\n",
        d="Reference\tUser\tPosting_Date\tAmount\tAmount Local\n\tSAPX\t2026-01-02\t7\t8\n",
        e="\n",
    )
    for limit in (extracts.BROADCAST_FILES, 0):
        monkeypatch.setattr(extracts, "BROADCAST_FILES", limit)
        rows = extracts.ingest(spark, path, P, NAME).collect()
        got = {(r.extract, r.entry_ref, r.line_no, r.status, r.reason, r.amount) for r in rows}
        assert got == {
            ("a", "E1", 1, "canonical", None, Decimal("1234.50")), ("a", "E1", 1, "duplicate", None, Decimal("5.00")), ("b", "E1", 1, "canonical", None, Decimal("12.50")),
            ("b", "E2", 1, "reject", "unparseable posting_date: never", Decimal("1.00")), ("c", "E9", 1, "reject", "no column for amount", None), ("d", None, 1, "reject", "missing entry_ref", Decimal("7.00")),
        }
        assert [r.description for r in rows if r.extract == "a" and r.status == "canonical"] == ['said "no", twice']
        raw = {r.extract: r.raw_json for r in rows if r.status == "reject"}
        assert raw["c"] == '{"belnr":"E9","budat":"2026-01-01"}' and raw["d"].startswith('{"reference":null,"user":"SAPX"')
    counts = {r.extract: (r.raw, r.canonical, r.rejects, r.duplicates, r.reconciles) for r in extracts.reconcile(extracts.ingest(spark, path, P, NAME), P).collect()}
    assert counts == {"a": (2, 1, 0, 1, True), "b": (2, 1, 1, 0, True), "c": (1, 0, 1, 0, True), "d": (1, 0, 1, 0, True)}


def test_overrides_replace_what_was_proposed(spark, files):
    path = files(x="BELNR,BUDAT,Amount,Other\nE1,2026-04-05,1,2\n")
    lines = extracts.read_lines(spark, path)
    heads = extracts.headers(lines)
    assert heads.first().names == ["BELNR", "BUDAT", "Amount", "Other"]
    own = heads.first().file
    other = spark.createDataFrame([(own, "amount", "OTHER"), (own, "source_doc", None)], "file string, field string, header string")
    row = extracts.typed(extracts.bind(lines, extracts.bindings(heads, extracts.proposals(heads), other)), P).first()
    assert row.amount == 2 and row.entry_ref == "E1" and row.staging_seq.file == own


def test_headers_without_names_and_repeated_ones(spark, files):
    path = files(x='a,,"q,1",A,a\n1,2,3,4,5\n')
    assert extracts.headers(extracts.read_lines(spark, path)).first().names == ["a", "column1", "q,1", "A_1", "a_2"]


def test_proposals_give_each_header_to_one_field(spark):
    """A header whose first choice is taken goes to the next field that it may mean."""
    heads = {"x": ["Text", "Doc Type Text", "Local Amount", "Amount", "id", "Code"], "y": ["usnam", "werrs", "budat"], "z": ["nothing", ""], "w": ["entry_ref2"]}
    rows = [(x, i, h) for x, hs in heads.items() for i, h in enumerate(hs)]
    got = ledger.propose_maps(spark.createDataFrame(rows, "extract string, pos int, header string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.extract, {})[r.field] = r.header
    assert by["x"] == {"description": "Text", "entry_type": "Doc Type Text", "amount": "Amount", "entry_ref": "id", "account": "Code"}
    assert {(r.confidence, r.system) for r in got if r.extract == "x"} == {(0.417, "generic")} and {r.system for r in got if r.extract == "y"} == {"sap"}
    assert set(by) == {"x", "y"}


def test_registry_finds_copies_and_overlaps(spark, files, tmp_path):
    body = [f"E{i},2026-01-01,{i}" for i in range(300)]
    text = lambda rows: "\n".join(["BELNR,BUDAT,DMBTR", *rows]) + "\n"
    path = files(a=text(body), b=text(body[::-1]), c=text([*body[:-1], "E1,2026-01-01,9"]), d=text(["X,2026-01-01,1"]))
    found = extracts.digests(extracts.read_lines(spark, path, NAME))
    assert [tuple(r) for r in extracts.duplicates(found, "r1").collect()] == [("b", "r1", "a")]
    near = {r.extract: (r.earlier, r.parts, r.same) for r in extracts.overlaps(found, "r1").collect()}
    assert near["b"][0] == "a" and near["b"][1] == near["b"][2] and near["c"][0] == "a" and near["c"][1] - 2 <= near["c"][2] < near["c"][1]
    registry = str(tmp_path / "registry")
    extracts.register(found, registry, "r1")
    known = extracts.registered(spark, registry)
    assert sorted(tuple(r) for r in extracts.duplicates(found, "r2", known).collect()) == [(x, "r1", "a" if x == "b" else x) for x in "abcd"]
    assert sorted(r.extract for r in extracts.duplicates(found, "r1", known).collect()) == ["b"]
    warned = review.warnings(spark.createDataFrame([], JOURNAL), P, None, extracts.duplicates(found, "r2", known)).collect()
    assert len(warned) == 4 and all(r.warning_id == "dq_duplicate_extract" and r.severity == "critical" and r.non_dismissible for r in warned)


def journal(spark, rows):
    return spark.createDataFrame([(f"E{i}", 1, dt.date.fromisoformat(d), u, Decimal(a), c, t) for i, (d, u, a, c, t) in enumerate(rows)], JOURNAL)


def test_warnings_without_a_declared_date(spark):
    """No shortfall without a declaration; the cover ends with the last posting; blank texts are missing ones."""
    ids = lambda rows, p: {r.warning_id: (r["count"], r.detail) for r in review.warnings(journal(spark, rows), p).collect() if r.warning_id != "dq_unbalanced_docs"}
    full = ("u", "-1", "USD", "x")
    early = ("2026-01-05", *full)
    assert ids([early, ("2026-07-25", *full)], P) == {}
    short = ids([("2026-06-20", *full)], P)
    assert set(short) == {"dq_no_post_close_coverage"} and short["dq_no_post_close_coverage"][0] == 0
    declared = Params(period_end=P.period_end, declared_through=dt.date(2026, 7, 31))
    assert set(ids([early, ("2026-07-25", *full)], declared)) == {"dq_extract_shortfall_declared"}
    blanks = ids([("2026-07-25", None, "-1", "", ""), ("2026-07-25", "u", "-1", None, None), early], P)
    assert blanks == {"dq_missing_fields": (3, "description 2/3; username 1/3; currency 2/3")}
    assert set(ids([("2025-12-31", "u", "1", "USD", "x")], P)) == {"dq_sign_convention", "dq_period_coverage", "dq_no_post_close_coverage"}
    assert ids([], P) == {}


def test_packs_beyond_999_keep_their_numbers(spark):
    n = 1005 * 20
    universe = spark.range(n).selectExpr("concat('E', lpad(id, 6, '0')) AS entry_ref", "1L AS rules_hit", "1.0D AS abs_amount")
    xref = universe.selectExpr("entry_ref", "1 AS line_no")
    got = worklog.packs(universe, xref, P).groupBy("pack").count()
    assert got.count() == 1005 and got.filter("count <> 20").count() == 0 and got.filter("pack = 'pack_1000'").count() == 1


def test_names_are_matched_once_a_file_and_rows_move_once(spark, files):
    """No pattern runs over the paths of all lines, numbering and repeated keys share one shuffle, and dates of all formats are read as before."""
    text = "Voucher;Posting Date;Amount\nJE1;5.3.2024;12,50\nJE1;2024-3-5;1.00\nJE2;3/25/2024;2.00\nJE3;-;2\nJE4;20240305;2\n"
    rows = extracts.ingest(spark, files(one=text, two=text), P, NAME)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract(" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = sorted((r.extract, r.entry_ref, r.line_no, str(r.posting_date), r.status) for r in rows.collect())
    one = [("JE1", 1, "2024-03-05", "canonical"), ("JE1", 2, "2024-03-05", "canonical"), ("JE2", 1, "2024-03-25", "canonical"), ("JE3", 1, "None", "reject"), ("JE4", 1, "2024-03-05", "canonical")]
    assert got == [(n, *x) for n in ("one", "two") for x in one]
