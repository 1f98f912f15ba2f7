"""Architecture rules and constraint checks."""

import datetime as dt

from pyspark.sql import functions as F

from attestra.operators import compliance as co
from attestra.operators import constraints as cs
from tests.conftest import list_of, rows_of

MODULE = "module_id string, name string, owned_files array<string>, allowed_to_call array<string>, forbidden_to_call array<string>, ord bigint"
MODULES = [
    ("M1", "adapter", ["adapter.py"], None, [], 1), ("M2", "parser", ["parser.py", "shared.py"], [], ["M1"], 2),
    ("M3", "gate", ["gate.py", "shared.py"], ["M2"], None, 3), ("M6", "trace", [], None, [], 4)]
EDGES = [
    ("src/app/parser.py", "app.adapter", 1), ("src/app/parser.py", "app.shared", 2), ("src/app/gate.py", "app.parser", 3),
    ("src/app/gate.py", "app.adapter", 4), ("src/app/core/gate.py", "app.adapter", 5), ("src/app/gate.py", "app.core.parser", 6),
    ("src/app/trace/x.py", "app.trace.y", 7), ("src/app/other.py", "app.adapter", 8), ("src/app/gate.py", "os.path", 9),
    ("src/app/gate.py", "app", 10), ("src/app/adapter.py", "hermes.client", 11), ("src/app/gate.py", "my_hermes_x", 12), ("src/app/gate.py", "sqlalchemy.orm", 13)]


def edges(table):
    raw = table("file_path string, imported_module string, lineno int", EDGES)
    return co.edge_modules(raw, table(MODULE, MODULES), package="app", folders={"trace": "M6"})


def test_edges_get_modules(table):
    got = {(r.lineno): (r.from_module, r.to_module) for r in edges(table).collect()}
    assert got == {1: ("M2", "M1"), 2: ("M2", "M2"), 3: ("M3", "M2"), 4: ("M3", "M1"), 5: (None, "M1"), 6: ("M3", None), 7: ("M6", "M6"),
                   8: (None, "M1"), 9: ("M3", None), 10: ("M3", None), 11: ("M1", None), 12: ("M3", None), 13: ("M3", None)}


def test_boundaries(table):
    broken = co.boundary_violations(edges(table), table(MODULE, MODULES))
    assert list_of(broken, "lineno", "violation") == [(1, "forbidden"), (1, "not_allowed"), (4, "not_allowed")]
    assert rows_of(co.module_status(table(MODULE, MODULES), broken), "rule_id", "status") == {
        ("M1", "compliant"), ("M2", "violated"), ("M3", "violated"), ("M6", "compliant")}


def test_banned_imports(table):
    found = co.runtime_imports(edges(table), adapter_module="M1")
    assert rows_of(found, "lineno", "violation") == {(1, "adapter"), (4, "adapter"), (5, "adapter"), (8, "adapter"), (12, "runtime")}
    assert rows_of(co.banned_packages(edges(table)), "lineno") == {(13,)}


def test_external_resources(table):
    html = '<a HREF = "https://x.y/z"><img src=\'//cdn/a.png\'><link href="/local.css"><script src="a.js">'
    found = co.external_resources(table("path string, html string", [("d.html", html)]))
    assert found.first().urls == ['HREF = "https://x.y/z"', "src='//cdn/a.png'"]
    project = found.select("project_id").unionByName(table("x string", ["1"], project="none").select("project_id"))
    assert rows_of(co.artifact_status(project, found, rule=F.lit("D2")), "project_id", "status") == {("p", "violated"), ("none", "unclear")}


def test_missing_inputs(table):
    manifest = table("file_key string, status string", [("prd", "ok"), ("task_list", "missing"), ("architecture_constraints", "parse_error")])
    assert rows_of(co.missing_inputs(table("x string", ["1"]), manifest), "file_key") == {("task_list",)}


def test_evidence_for_paths(table):
    ev = table("source_path string, evidence_id string, ord bigint", [("b.py", "E2", 2), ("src/b.py", "E3", 3), ("x/src/a.py", "E4", 4), ("", "E0", 0), ("y\\src\\a.py", "E5", 1)])
    paths = table("path string", ["src/b.py", "/src/a.py", "lib.py", "c.txt"])
    assert rows_of(co.evidence_for_paths(paths, ev), "path", "evidence_id") == {
        ("src/b.py", "E2"), ("/src/a.py", "E5"), ("lib.py", "E2"), ("c.txt", "EVIDENCE-P-999")}


def test_rule_classes(table):
    schema = "section string, rule_id string, title string, severity string, verification_method string, accepted_by string, accepted_at timestamp, ord bigint"
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 20)
    rules = table(schema, [
        ("security_rules", "r1", "", "must", "manual", "lead", old, 1), ("security_rules", "r2", "", "must", "manual", "lead", new, 2),
        ("security_rules", "r3", "", "must", "manual", None, None, 3), ("security_rules", "r4", "", None, None, None, None, 4),
        ("security_rules", "r5", "", "should", "machine", None, None, 5), ("security_rules", "r6", "", "must", "machine", None, None, 6),
        ("elsewhere", "r7", "", "must", "machine", None, None, 7)])
    out = co.classify_rules(rules, table("rule_id string", ["r6"]), as_of=F.lit("2024-03-01").cast("timestamp"))
    assert rows_of(out, "rule_id", "classification", "stale_acceptance") == {
        ("r1", "accepted", True), ("r2", "accepted", False), ("r3", "unclear", False), ("r4", "unclear_blocking", False)}
    assert rows_of(co.unclear_rules(out), "rule_id") == {("r4",)}
    assert rows_of(co.classified_status(out), "rule_id") == {("r3",), ("r4",)}


def test_rollup(spark):
    status = spark.createDataFrame([("a", "violated", "must"), ("b", "unclear", "must"), ("b", "violated", "should")], "project_id string, status string, severity string")
    project = spark.createDataFrame([("a", "P"), ("b", "Q"), ("c", "P")], "project_id string, id_prefix string")
    out = co.must_rollup(project, status, prefix=F.col("id_prefix"))
    assert rows_of(out.filter("status <> 'compliant'"), "project_id", "rule_id", "status") == {("a", "GATE-P-006", "violated"), ("b", "GATE-Q-007", "unclear")}
    assert out.count() == 9


TASK = ("task_id string, title string, phase_id string, priority string, status string, related_requirements array<string>, "
        "related_acceptance_criteria array<string>, related_modules array<string>, definition_of_done array<struct<dod_id: string, description: string>>, ord bigint")


def test_constraints_report_every_violation_with_its_path(table):
    tasks = table(TASK, [
        ("TASK-P-1", "t", "PHASE-P-1", "must", "done", ["REQ-P-1", "Q-2"], ["AC-P-1-1"], ["MOD-P-1"], [("DOD-P-1-1", "d")], 0),
        ("T1", "", None, "high", "open", ["REQ-P-1", "bad"], ["AC-P-1"], [], [("DOD-P-1-1", None)], 1)])
    out = cs.check_rows(tasks, cs.task_checks("P"), table="tasks", key="task_id")
    assert rows_of(out, "key", "field_path", "rule") == {
        ("T1", "tasks[1].task_id", "pattern"), ("T1", "tasks[1].title", "min_length"), ("T1", "tasks[1].phase_id", "required"),
        ("T1", "tasks[1].priority", "enum"), ("T1", "tasks[1].status", "enum"), ("T1", "tasks[1].related_requirements[1]", "item_pattern"),
        ("T1", "tasks[1].related_acceptance_criteria[0]", "item_pattern"), ("T1", "tasks[1].definition_of_done[0].description", "item_required")}
    assert all(r.hint for r in out.collect())


def test_every_kind_of_constraint(table):
    rows = table("k string, n string, v int, raw string, items array<string>, ord bigint", [("a", "x1", 11, '{"k": 1, "zz": 2}', [], 0), ("b", "7", 5, '{"k": 1}', ["q"], 1)])
    checks = [cs.Check("n", "type", "int"), cs.Check("v", "maximum", 10), cs.Check("v", "minimum", 6), cs.Check("n", "max_length", 1),
              cs.Check("raw", "additional", ("k", "v")), cs.Check("items", "min_items", 1), cs.Check("items", "item_enum", ("z",))]
    out = cs.check_rows(rows, checks, table="t", key="k")
    assert rows_of(out, "field_path", "rule") == {
        ("t[0].n", "type"), ("t[0].v", "maximum"), ("t[1].v", "minimum"), ("t[0].n", "max_length"), ("t[0].zz", "additional"), ("t[0].items", "min_items"), ("t[1].items[0]", "item_enum")}
    claims = table("claim_id string, related_task string, claimed_status string, ord bigint", [("CLAIM-P-1", None, "finished", 0)])
    assert rows_of(cs.check_rows(claims, cs.claim_checks("P"), table="", key="claim_id"), "field_path", "rule") == {("[0].related_task", "required"), ("[0].claimed_status", "enum")}


def test_business_rules(table):
    tasks = table(TASK, [
        ("TASK-P-1", "", "", "", "todo", ["R"], [], ["M"], [], 0), ("TASK-P-2", "", "", "", "todo", [], [], [], [], 1),
        ("X", "", "", "", "done", None, ["A"], None, [], 2), ("TASK-P-9999", "", "", "", "todo", [], [], [], [], 3)])
    lax = cs.task_problems(tasks, prefix="P")
    assert rows_of(lax, "item_id", "problem") == {("TASK-P-2", "isolated"), ("TASK-P-2", "orphan"), ("X", "invalid_id")}
    strict = cs.task_problems(tasks, prefix="P", strict_links=True)
    assert rows_of(strict.filter("problem = 'isolated'"), "item_id") == {("TASK-P-1",), ("TASK-P-2",), ("X",)}
    assert rows_of(cs.row_validity(tasks, lax, key="task_id"), "task_id", "is_valid") == {("TASK-P-1", True), ("TASK-P-2", False), ("X", False), ("TASK-P-9999", True)}
    claims = table("claim_id string, related_task string, claimed_status string, evidence_refs array<string>",
                   [("CLAIM-P-1", "TASK-P-1", "covered", ["CLAIM-P-1"]), ("CLAIM-P-2", "job", "compliant", ["E"]), ("c", "TASK-P-1", "partial", None), ("CLAIM-P-3", "TASK-P-1", "covered", None)])
    assert rows_of(cs.claim_problems(claims, prefix="P"), "item_id", "problem") == {
        ("CLAIM-P-1", "no_external_evidence"), ("CLAIM-P-2", "invalid_task_id"), ("c", "invalid_id"), ("CLAIM-P-3", "no_external_evidence")}
