"""Gaps, risks, actions, decisions and the merge gate."""

import pytest
from pyspark.sql import functions as F

from attestra.functions.ids import decision_key
from attestra.operators import findings as fi
from attestra.operators import gate
from attestra.plans import queries
from tests.conftest import aggregated_scans, list_of, rows_of

GAP = "item_id string, item_type string, reason string, target_id string, severity string, ord bigint"
RISK = ("risk_id string, claim_id string, description string, severity string, target_id string, suggested_action string, "
        "business_impact string, confidence string, type string, ord bigint")
DECISION = "action string, targetId string"
AC_GAP = ("A1", "ac", "no test", "A1", "must", 1)


def risk(severity, *, id_="R1", claim=None, text="late", target="X", action="do", impact="cost", confidence=None, kind=None):
    return (id_, claim, text, severity, target, action, impact, confidence, kind, 1)


# name -> gaps, risks, decisions, related (None: no changed set), status, expected decision, blocking, failing, noted
GATES = {
    "nothing": ([], [], [], None, "active", "pass", 0, 0, 0),
    "criterion gap": ([AC_GAP], [], [], None, "active", "blocked", 1, 0, 0),
    "other gap": ([("R1", "requirement", "", "R1", "must", 1)], [], [], None, "active", "fail", 0, 1, 0),
    "must risk": ([], [risk("must")], [], None, "active", "blocked", 1, 0, 0),
    "must risk without action": ([], [risk("must", action="")], [], None, "active", "blocked", 2, 0, 0),
    "should risk": ([], [risk("should")], [], None, "active", "fail", 0, 1, 0),
    "speculative must risk": ([], [risk("must", confidence="low_confidence")], [], None, "active", "blocked", 1, 1, 0),
    "suggestion": ([], [risk(None, kind="suggestion")], [], None, "active", "fail", 0, 1, 0),
    "self-referential": ([], [risk("could", text="only self-referential")], [], None, "active", "blocked", 1, 1, 0),
    "draft": ([AC_GAP], [risk("must")], [], None, "draft", "draft_approved", 0, 0, 0),
    "gap completed": ([AC_GAP], [], [("mark_complete", "A1")], None, "active", "pass", 0, 0, 1),
    "wrong action": ([AC_GAP], [], [("accept_risk", "A1")], None, "active", "blocked", 1, 0, 0),
    "wrong target": ([AC_GAP], [], [("mark_complete", "A9")], None, "active", "blocked", 1, 0, 0),
    "risk accepted": ([], [risk("must")], [("accept_risk", "X")], None, "active", "pass", 0, 0, 1),
    "should risk accepted, noted twice": ([], [risk("should")], [("accept_risk", "X")], None, "active", "pass", 0, 0, 2),
    "empty target never matches": ([("A1", "ac", "", "", "must", 1)], [], [("mark_complete", "")], None, "active", "blocked", 1, 0, 0),
    "gap in the change": ([AC_GAP], [], [], ["A1"], "active", "blocked", 1, 0, 0),
    "gap before the change": ([AC_GAP], [], [], ["A2"], "active", "pass", 0, 0, 1),
    "risk before the change": ([], [risk("must", claim="C1")], [], ["C2"], "active", "pass", 0, 0, 1),
    "risk of a changed claim": ([], [risk("must", claim="C1")], [], ["C1"], "active", "blocked", 1, 0, 0),
    "file without claim": ([("a.py", "missing_claim", "", "a.py", "must", 1)], [], [], ["A2"], "active", "blocked", 1, 0, 0),
    "uncovered through claims": ([("A1", "ac_not_covered", "", "A1", "must", 1)], [], [], None, "active", "blocked", 1, 0, 0),
}


@pytest.fixture(scope="module")
def gates(spark):
    """All cases as projects of one run."""

    def rows(schema, position):
        data = [(n, *(r if isinstance(r, tuple) else (r,))) for n, c in GATES.items() for r in (c[position] or [])]
        return spark.createDataFrame(data, f"project_id string, {schema}")

    affected = rows("item_id string", 3)
    changed = spark.createDataFrame([(n, "f") for n, c in GATES.items() if c[3] is not None], "project_id string, path string")
    decision = rows(DECISION, 2)
    found = gate.gap_findings(rows(GAP, 0), decision, affected, changed).unionByName(
        gate.risk_findings(rows(RISK, 1), decision, affected, changed))
    project = spark.createDataFrame([(n, c[4]) for n, c in GATES.items()], "project_id string, status string")
    result = gate.gate_result(project, found, decision)
    reasons = gate.gate_reasons(result, found)
    return {r.project_id: r for r in result.collect()}, reasons.collect()


@pytest.mark.parametrize("name", GATES)
def test_gate(gates, name):
    row = gates[0][name]
    assert (row.gate_decision, row.n_blocking, row.n_failing, row.n_noted) == GATES[name][5:]


def test_reasons(gates):
    by_project = {}
    for r in sorted(gates[1], key=lambda r: r.seq):
        by_project.setdefault(r.project_id, []).append(r.reason)
    assert by_project["nothing"] == [gate.ALL_PASSED]
    assert by_project["draft"] == [gate.DRAFT]
    assert by_project["gap completed"] == ["[completed by a person] Acceptance criterion without test evidence (A1): no test"]
    assert by_project["gap before the change"][0].startswith("[pre-existing] ")
    assert by_project["gap in the change"][0].startswith("[current] ")
    assert by_project["speculative must risk"] == ["High or self-referential risk (R1): late", "Low, medium or speculative risk (R1): late"]
    assert set(by_project) == set(GATES)
    assert gates[0]["risk accepted"].human_decisions_applied == 1


def test_rule_and_coverage_findings(table):
    violation = table("rule_id string, message string, ord bigint", [("G1", "bad", 1)])
    unclear = table("rule_id string, reason string, ord bigint", [("G2", "why", 1)])
    status = table("rule_id string, status string, severity string, ord bigint",
                   [("G1", "violated", "must", 1), ("G3", "violated", "must", 1), ("G4", "violated", "should", 1), ("G2", "unclear", "must", 1)])
    found = gate.rule_findings(violation, unclear, status)
    assert list_of(found, "code", "item_id", "effect") == [
        ("must_rule_violation", "G1", "block"), ("rule_status_unclear", "G2", "fail"), ("rule_status_violated", "G3", "block"), ("unclear_rule", "G2", "fail")]
    # With a changed set, rules never block; coverage always does.
    later = gate.rule_findings(violation, unclear, status, table("path string", ["a"]))
    assert rows_of(later, "effect", "change_scope") == {("note", "pre_existing")}
    low = gate.coverage_findings(table("path string, percent_covered double, ord bigint", [("a.py", 70.0, 1)]))
    assert rows_of(low, "effect") == {("block",)}


def test_gap_merge_keeps_the_first(table):
    first = table(GAP, [("A1", "ac", "first", "A1", "must", 2)])
    second = table(GAP, [("A1", "ac", "second", "A1", "must", 1), ("A1", "claim", "other", "A1", "must", 1)])
    assert rows_of(fi.merge_gaps([first, second]), "item_type", "reason") == {("ac", "first"), ("claim", "other")}


def test_risks_continue_numbering(table):
    existing = table("risk_id string", ["RISK-P-041", "RISK-Q-900", "odd"])
    gaps = table(GAP, [("R1", "requirement", "", "R1", "must", 1), ("A1", "ac", "", "A1", "must", 2), ("T1", "task", "", "T1", "should", 3), ("C1", "claim", "", "C1", "must", 4)])
    unclear = table("rule_id string, reason string, ord bigint", [("G1", "why", 1)])
    violation = table("rule_id string, message string, evidence_id string, ord bigint", [("G2", "second", "E2", 2), ("G2", "first", "E1", 1)])
    out = fi.number_risks([fi.gap_risks(gaps), fi.violation_risks(violation), fi.unclear_rule_risks(unclear)], existing=existing)
    assert list_of(out, "risk_id", "severity", "evidence_id", "target_id") == [
        ("RISK-P-042", "must", "EVIDENCE-P-999", "R1"), ("RISK-P-043", "must", "EVIDENCE-P-999", "A1"),
        ("RISK-P-044", "should", "EVIDENCE-P-999", "T1"), ("RISK-P-045", "must", "E1", "G2"), ("RISK-P-046", "should", "EVIDENCE-P-999", "G1")]
    assert fi.number_risks([fi.gap_risks(gaps)]).filter("risk_id = 'RISK-P-001'").count() == 1


def test_advice(table):
    risk_rows = table("risk_category string, business_impact string", [("no_test_coverage", None), ("stale_file", "given"), (None, None)])
    out = fi.enrich_claim_risks(risk_rows)
    assert rows_of(out, "risk_category", "business_impact", "confidence") == {
        ("no_test_coverage", fi.RISK_ADVICE["no_test_coverage"][0], None), ("stale_file", "given", "low_confidence"), (None, fi.DEFAULT_ADVICE[0], None)}


def test_urgency_and_actions(table):
    gap = table(GAP, [("A1", "ac", "r1", "A1", "must", 1), ("A2", "ac", "r2", "A2", "must", 2), ("A3", "ac", "r3", "A3", "must", 3), ("A4", "ac", "", "A4", "should", 4)])
    affected, cover = table("item_id string", ["A1", "C1"]), table("item_id string", ["A1", "A2", "C2"])
    gaps = fi.gap_urgency(gap, affected, cover)
    assert rows_of(gaps, "item_id", "urgency") == {("A1", 85), ("A2", 60), ("A3", 30), ("A4", 30)}
    risks = table("risk_id string, claim_id string, description string, severity string, stale boolean, ord bigint",
                  [("R1", "C1", "x", "must", False, 1), ("R2", "C2", "x", "must", True, 2), ("R3", "C3", "x", "should", True, 3), ("R4", None, "self-referential", "could", False, 4)])
    risks = fi.risk_urgency(risks, affected, cover)
    assert rows_of(risks, "risk_id", "urgency") == {("R1", 85), ("R2", 60), ("R3", 25), ("R4", 30)}
    violation = table("rule_id string, message string, ord bigint", [("G1", "m", 1)])
    status = table("rule_id string, status string, severity string, ord bigint", [("G1", "violated", "must", 1), ("G2", "violated", "must", 2)])
    actions = fi.gap_actions(gaps).unionByName(fi.risk_actions(risks)).unionByName(fi.violation_actions(violation, status))
    ranked = fi.rank_actions(actions)
    assert [r.item_id for r in ranked.orderBy("position").collect()] == ["G1", "G2", "A1", "R1", "A2", "R2", "R2", "A3", "R4", "R3"]
    assert rows_of(fi.action_counts(actions), "n_high", "n_low", "n_current", "n_pre_existing") == {(8, 2, 4, 6)}
    result = table("gate_decision string", ["blocked"])
    reason = table("seq bigint, reason string", [(1, "x" * 100)])
    assert fi.reason_actions(result, reason, actions).count() == 0
    (fallback,) = fi.reason_actions(result, reason, actions.filter("priority = 'LOW'")).collect()
    assert (fallback.urgency, fallback.detail) == (80, "x" * 80)


def test_worst_coverage(table):
    files = table("path string, percent_covered double", [(f"f{i}", float(10 * i)) for i in range(10)])
    assert list_of(fi.worst_coverage(files), "position", "path") == [(i + 1, f"f{i}") for i in range(5)]


def test_pending_decisions(table):
    gap = table("item_id string, item_type string, reason string, stale boolean", [("A1", "ac", "", False), ("A2", "ac", "", False), ("A3", "ac", "", True), ("R1", "requirement", "", False)])
    risks = table("claim_id string, description string, severity string, stale boolean", [("C1", "d", None, True), (None, "d", "must", True), ("C3", "d", "must", False)])
    rules = table("rule_id string, stale_acceptance boolean", [("G1", True), ("G2", False)])
    for compat in (True, False):
        log = table("a string", ["x"]).select("project_id", decision_key(F.lit("uncovered_ac"), F.lit("A2"), compat=compat).alias("decision_key"))
        out = fi.pending_decisions(gap.filter("item_id <> 'A1' or not %s" % compat), risks, rules, log, compat=compat)
        want = {("stale_debt", "C1", "should"), ("stale_debt", "", "must"), ("accepted_rule", "G1", "should")}
        assert rows_of(out, "category", "target_id", "severity") == want | (set() if compat else {("uncovered_ac", "A1", "must")})


def test_related_files_and_titles(table):
    link = table("task_id string, ac_id string", [("T1", "A1"), ("T2", "A1"), ("T1", "A2")])
    claim = table("claim_id string, related_task string, ord bigint", [("C1", "T2", 1), ("C2", "T1", 2), ("C3", "T1", 3)])
    refs = table("claim_id string, ref string, pos int", [("C1", "z.py", 0), ("C2", "b.py#L1", 0), ("C2", "c.py", 1), ("C3", "d.py", 0), ("C3", "#x", 1)])
    out = fi.related_files(link, claim, refs, n=3)
    assert list_of(out, "ac_id", "position", "path") == [
        ("A1", 1, "z.py"), ("A1", 2, "b.py"), ("A1", 3, "c.py"), ("A2", 1, "b.py"), ("A2", 2, "c.py"), ("A2", 3, "d.py")]
    titled = fi.with_titles(link, table("ac_id string, title string, ord bigint", [("A1", "one", 1), ("A1", "two", 2)]), key="ac_id", name="t")
    assert rows_of(titled, "ac_id", "t") == {("A1", "one"), ("A2", "")}


def test_run_flags(table):
    result = table("gate_decision string", ["blocked"])
    gap = table("item_type string", ["claim"] * 6)
    risks = table("severity string, confidence string", [("must", None), ("should", "low_confidence")])
    none = table("x string", [])
    (row,) = fi.run_flags(result, gap, risks, none, none, table("path string", ["a"])).collect()
    assert {k for k, v in row.asDict().items() if v is True} == {
        "gate_blocked", "has_must_risks", "high_gap_risk_count", "has_low_confidence", "has_uncovered_evolution_scope"}


def test_run_flags_in_one_join(spark, table):
    """A join for each kind of rows sorted both of its sides, in the same task. Projects without rows and rows without a project."""
    kinds = "project_id string, item_type string, severity string, confidence string"
    result = spark.createDataFrame([("p", "fail"), ("q", "pass"), (None, "pass")], "project_id string, gate_decision string")
    gap = spark.createDataFrame([("p", "ac", None, None), (None, "ac", None, None)], kinds)
    risk = spark.createDataFrame([("p", None, "should", None)] * 11 + [("q", None, None, None)], kinds)
    none = table("x string", [])
    out = fi.run_flags(result, gap, risk, none, none, none)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    flags = {r.project_id: {k for k, v in r.asDict().items() if v is True} for r in out.collect()}
    assert flags == {"p": {"gate_fail", "high_gap_risk_count", "has_coverage_gaps"}, "q": set(), None: set()}


def test_scans_of_the_account_gate_are_dealt_before_they_are_aggregated(spark, tmp_path):
    """Decisions and evidence were aggregated within a scan's share, which is a row group at least."""
    def write(name, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    held = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes")
    before = {name: spark.conf.get(name, None) for name in held}
    write("customer", "c_custkey bigint, c_nationkey int, c_acctbal double", [(1, 1, 5.0), (2, 1, -800.0), (3, 1, 5.0)])
    write("orders", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
          [(10, 1, "F", 5.0, "1-URGENT"), (20, 2, "F", 5.0, "1-URGENT"), (30, 3, "F", 5.0, "5-LOW"), (40, 3, "F", 5.0, "5-LOW")])
    write("lineitem", "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string",
          [(30, 1, 1, 1, "A", "F"), (30, 2, 1, 1, "A", "F")])
    write("events", "event_id bigint, user_id bigint, event_type string, props string",
          [(1, 1, "signup", '{"k": "10"}'), (2, 1, "signup", '{"k": "10"}'), (3, 3, "purchase", '{"k": "7"}')])
    try:
        out = queries.REGISTRY["gate_by_account"](spark, str(tmp_path))
        for column, times in (("event_type", 3), ("l_returnflag", 2)):
            assert aggregated_scans(out, column) == [False] * times
        columns = ("project_id", "gate_decision", "n_blocking", "n_failing", "n_noted", "n_resolved", "human_decisions_applied")
        assert rows_of(out, *columns) == {(1, "pass", 0, 0, 1, 1, 1), (2, "draft_approved", 0, 0, 0, 0, 0), (3, "pass", 0, 0, 0, 0, 1)}
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
