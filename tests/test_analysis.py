"""The whole analysis over a small portfolio; properties of order, partitioning and isolation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attestra.functions.hashing import with_content_hash
from attestra.plans import analysis
from attestra.schemas import TABLES
from tests.conftest import rows_of

NO = None
PROJECTS = ("good", "untested", "selfish", "draft")


def build(spark):
    """Four projects around one requirement, one criterion, one task and one claim each."""

    def frame(name, rows, ddl=None):
        return spark.createDataFrame(rows, ddl or TABLES[name])

    tests = {"good": "covered", "untested": "violated", "selfish": "covered", "draft": "violated"}
    t = {
        "project": frame("project", [(p, "draft" if p == "draft" else "active", "P") for p in PROJECTS]),
        "requirement": frame("requirement", [(p, "REQ-P-1", "Login", "must", "functional", 1) for p in PROJECTS]),
        "criterion": frame("criterion", [(p, "REQ-P-1", "AC-P-1-1", "works", True, 1) for p in PROJECTS]),
        "task": frame("task", [(p, "TASK-P-1", "t", "PHASE-P-1", "must", "done", "dev", "o", ["REQ-P-1"], ["AC-P-1-1"], ["MOD-P-2"], [], [], 0) for p in PROJECTS]),
        "claim": with_content_hash(frame("claim", [
            (p, "CLAIM-P-1", "TASK-P-1", "covered", ["CLAIM-P-1"] if p == "selfish" else ["tests/a.py"], dt.datetime(2024, 1, 1), ["src/app/gate.py"], ["tests/a.py"], NO, NO, 0)
            for p in PROJECTS])),
        "tool_evidence": frame("", [(p, "test", "tests/a.py", ["AC-P-1-1"], tests[p], "tests/a.py", "test", None, None, 0) for p in PROJECTS]
                               + [(p, "tool", "src/app/gate.py", [], "compliant", None, "coverage", 90.0, 10, 1) for p in PROJECTS],
                               "project_id string, source_type string, source_path string, covers array<string>, status string, nodeid string, tool_category string, percent_covered double, num_statements int, ord bigint"),
        "rule": frame("rule", [("untested", "security_rules", "SEC-1", "s", "", "must", "machine", NO, NO, NO, NO, NO, NO, 1),
                               ("good", "security_rules", "SEC-2", "s", "", "must", "manual", "lead", dt.datetime(2024, 1, 1), NO, NO, NO, NO, 2)]),
        "module_boundary": frame("module_boundary", [(p, "MOD-P-2", "gate", "", ["gate.py"], [], [], [], 1) for p in PROJECTS]),
        "import_edge": frame("import_edge", [("untested", "src/app/gate.py", "sqlite3", 3), ("good", "src/app/gate.py", "os", 1)]),
        "html_artifact": frame("html_artifact", [(p, "dashboard.html", "<p>x</p>") for p in PROJECTS]),
        "manifest": frame("", [(p, k, f"docs/{k}", "ok", "h") for p in PROJECTS for k in ("prd", "architecture_constraints", "task_list")],
                          "project_id string, file_key string, path string, status string, sha256 string"),
        "changed_file": frame("changed_file", []),
        "scope_pattern": frame("scope_pattern", []),
        "decision": frame("decision", []),
        "old_evidence": frame("", [("good", "test", "tests/old.py", [], "covered", None, 7), ("good", "test", "tests/a.py", [], "covered", None, 8)],
                              "project_id string, source_type string, source_path string, covers array<string>, status string, tool_category string, ord bigint"),
    }
    t["head_claim"] = t["claim"].filter("false")
    return t


AS_OF = "2024-03-01"


def run(tables):
    return analysis.run(tables, as_of=F.lit(AS_OF).cast("timestamp"), package="app")


@pytest.fixture(scope="module")
def tables(spark):
    return build(spark)


@pytest.fixture(scope="module")
def report(tables):
    return run(tables)


def test_decisions(report):
    assert rows_of(report["gate"], "project_id", "gate_decision") == {
        ("good", "pass"), ("untested", "blocked"), ("selfish", "blocked"), ("draft", "draft_approved")}


def test_reasons_name_the_causes(report):
    codes = {}
    for r in report["reasons"].collect():
        codes.setdefault(r.project_id, set()).add(r.code)
    assert codes["good"] == {"all_passed"} and codes["draft"] == {"draft"}
    assert {"ac_missing_evidence", "high_risk", "must_rule_violation", "unclear_rule", "ac_not_covered"} <= codes["untested"]
    assert "high_risk" in codes["selfish"] and "ac_missing_evidence" not in codes["selfish"]


def test_index(report):
    good = report["evidence"].filter("project_id = 'good'").orderBy("ord").collect()
    assert [(e.evidence_id, e.source_type, e.carried_over) for e in good] == [
        ("EVIDENCE-P-001", "task", False), ("EVIDENCE-P-002", "claim", False), ("EVIDENCE-P-003", "code", False),
        ("EVIDENCE-P-004", "test", False), ("EVIDENCE-P-005", "tool", False), ("EVIDENCE-P-006", "test", True)]
    assert good[1].covers == good[2].covers == ["AC-P-1-1", "REQ-P-1"]


def test_sections(report):
    assert rows_of(report["claim_verdicts"], "project_id", "status") == {("good", "covered"), ("untested", "violated"), ("selfish", "blocked"), ("draft", "violated")}
    assert rows_of(report["accepted_rules"], "rule_id", "stale_acceptance") == {("SEC-2", True)}
    assert rows_of(report["pending"].filter("project_id = 'good'"), "category", "target_id") == {("accepted_rule", "SEC-2")}
    assert rows_of(report["coverage_summary"].filter("project_id = 'good'"), "aggregate_percent", "file_count") == {(90.0, 1)}
    status = rows_of(report["rule_status"].filter("project_id = 'untested'"), "rule_id", "status")
    assert {("STORE-P-001", "violated"), ("GATE-P-006", "violated"), ("SEC-1", "unclear"), ("DEP-P-002", "compliant"), ("MOD-P-2", "compliant")} <= status
    violation = rows_of(report["violations"].filter("rule_id = 'STORE-P-001'"), "project_id", "evidence_id")
    assert violation == {("untested", "EVIDENCE-P-003")}
    ids = [r.risk_id for r in report["risks"].filter("project_id = 'untested'").orderBy("risk_id").collect()]
    assert ids == [f"RISK-P-{i:03d}" for i in range(1, len(ids) + 1)] and len(ids) > 3
    assert report["actions"].filter("project_id = 'untested' and position = 1").first().urgency == 90
    assert rows_of(report["flags"].filter("project_id = 'good'"), "gate_blocked", "has_coverage_gaps") == {(False, False)}


COMPARED = ("gate", "reasons", "evidence", "risks", "gaps", "actions", "rule_status")


def collected(report):
    """Sections as sorted texts with their project; positions inside the source tables left out."""
    out = {}
    for name in COMPARED:
        columns = sorted(c for c in report[name].columns if c != "ord")
        out[name] = sorted((r.project_id, *(str(r[c]) for c in columns)) for r in report[name].collect())
    return out


@pytest.fixture(scope="module")
def sections(report):
    return collected(report)


def test_row_order_and_partitioning_do_not_matter(tables, sections):
    assert collected(run({name: df.repartition(3, F.rand(3)) for name, df in tables.items()})) == sections


def test_each_project_alone_equals_the_joint_run(tables, sections):
    alone = collected(run({name: df.filter("project_id = 'untested'") for name, df in tables.items()}))
    assert alone == {name: [r for r in rows if r[0] == "untested"] for name, rows in sections.items()}


def test_a_change_moves_old_findings_out_of_the_gate(spark, tables):
    changed = spark.createDataFrame([("untested", "docs/readme.md"), ("selfish", "src/app/gate.py")], TABLES["changed_file"])
    scope = spark.createDataFrame([("untested", "exclude", "docs/**")], TABLES["scope_pattern"])
    no_must = tables["task"].withColumn("priority", F.lit("should"))
    report = run({**tables, "changed_file": changed, "scope_pattern": scope, "task": no_must, "head_claim": tables["claim"]})
    decisions = rows_of(report["gate"], "project_id", "gate_decision")
    assert ("untested", "pass") in decisions  # nothing it finds belongs to the change
    assert rows_of(report["gaps"].filter("project_id = 'untested'"), "stale") == {(True,)}
    assert rows_of(report["affected"], "item_id") == {("CLAIM-P-1",), ("TASK-P-1",), ("REQ-P-1",), ("AC-P-1-1",)}


def test_empty_portfolio(tables):
    empty = {name: df.filter("false") for name, df in tables.items()}
    report = run(empty)
    assert all(report[name].count() == 0 for name in ("gate", "reasons", "evidence", "risks", "actions"))


def test_integrity_gates(spark, tables):
    changed = spark.createDataFrame([("good", "src/app/gate.py"), ("good", "src/new.py"), ("good", "docs/task_list.json")], TABLES["changed_file"])
    hashed = with_content_hash(tables["task"], exclude=("ord",))
    gates = analysis.integrity_gates({
        **tables, "changed_file": changed, "task": hashed, "head_task": hashed.filter("project_id <> 'good'"),
        "document": spark.createDataFrame([("good", "d", "AC-P-7-7")], TABLES["document"])})
    assert rows_of(gates["ghost_files"], "path") == {("src/new.py",)}
    assert gates["reverse_coverage"].count() == 0
    assert rows_of(gates["criterion_freshness"], "project_id", "ac_id", "reason") == {("good", "AC-P-1-1", "criterion_not_in_document")}
    assert rows_of(gates["mapping"], "finding") == {("must_uncovered",)}


def test_unchanged_ledgers_are_reused_and_claim_tests_reported(spark, tables):
    old = spark.createDataFrame(
        [(p, "task", "docs/task_list.json", ["AC-P-1-1"], "partial", "TASK-OLD", 1) for p in ("good", "selfish")]
        + [("good", "claim", "claims/current.json", [], "covered", None, 2)],
        "project_id string, source_type string, source_path string, covers array<string>, status string, task_id string, ord bigint",
    ).withColumn("tool_category", F.lit(None).cast("string"))
    before, after = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 2)
    snapshot = spark.createDataFrame(
        [("good", "docs/task_list.json", before), ("good", "claims/current.json", after), ("selfish", "docs/task_list.json", after), ("good", "tests/a.py", before)],
        "project_id string, path string, modified_at timestamp")
    scan = spark.createDataFrame([(p, dt.datetime(2024, 2, 1)) for p in PROJECTS], "project_id string, scan_time timestamp")
    runs = spark.createDataFrame([("good", "tests/a.py", 0, "3 passed", False)], "project_id string, path string, exit_code int, stdout string, timed_out boolean")
    more = {**tables, "old_evidence": old, "file_snapshot": snapshot, "last_scan": scan, "test_run": runs}
    index = analysis.build_index(more)
    assert rows_of(index.filter("source_type = 'task'"), "project_id", "task_id") == {
        ("good", "TASK-OLD"), *((p, "TASK-P-1") for p in PROJECTS if p != "good")}
    assert index.filter("source_type = 'claim' and claim_id = 'CLAIM-P-1'").count() == len(PROJECTS)
    results = analysis.run(more, as_of=F.lit(AS_OF).cast("timestamp"), package="app")["claim_tests"]
    assert rows_of(results, "project_id", "status", "n_passed") == {("good", "passed", 3), *((p, "file_not_found", 0) for p in PROJECTS if p != "good")}
