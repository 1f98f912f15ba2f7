"""References, duplicates, mappings, changed files, health checks."""

from pyspark.sql import functions as F

from attestra.functions import scope as sc
from attestra.operators import health, integrity
from tests.conftest import list_of, rows_of


def test_dangling_scalar_and_array(table):
    parent = table("req_id string", ["R1"])
    child = table("task_id string, reqs array<string>", [("T1", ["R1", "R2"]), ("T2", []), ("T3", None)])
    assert rows_of(integrity.dangling_refs(child, parent, ref="reqs", key="req_id"), "task_id", "reqs") == {("T1", "R2")}
    claim = table("claim_id string, related_task string", [("C1", "R1"), ("C2", "R9"), ("C3", None)])
    assert rows_of(integrity.dangling_refs(claim, parent, ref="related_task", key="req_id"), "claim_id") == {("C2",)}


def test_four_task_links_in_one_check(table):
    task = table("task_id string, a array<string>, b array<string>", [("T1", ["x", "y"], ["x"])])
    out = integrity.task_reference_problems(task, {"a": (table("k string", ["x"]), "k"), "b": (table("k string", ["y"]), "k")})
    assert rows_of(out, "link", "target") == {("a", "y"), ("b", "x")}


def test_missing_parent(table):
    task = table("task_id string, related_requirements array<string>, related_acceptance_criteria array<string>",
                 [("T1", ["REQ-P-1"], ["AC-P-1-1", "AC-P-2-1", "AC-P-3-1"])])
    ac = table("ac_id string", ["AC-P-1-1", "AC-P-2-1"])
    assert rows_of(integrity.missing_parents(task, ac), "ac_id", "parent_req_id") == {("AC-P-2-1", "REQ-P-2")}


def test_duplicates(table):
    assert rows_of(integrity.duplicate_keys(table("k string", ["a", "a", "b"]), ["k"]), "k", "n") == {("a", 2)}


def test_mapping_both_ways(table):
    req = table("req_id string, priority string, ord bigint", [("R1", "must", 1), ("R2", "must", 2), ("R3", "should", 3), ("R4", "unclear", 4)])
    link = table("req_id string, top_level boolean", [("R1", True), ("R2", False), ("R9", False)])
    assert rows_of(integrity.requirement_rule_mapping(req, link), "finding", "req_id") == {
        ("dead_link", "R9"), ("must_uncovered", "R2"), ("should_uncovered", "R3")}
    nothing = table("req_id string, priority string, ord bigint", [])
    assert integrity.requirement_rule_mapping(nothing, link).count() == 0


def test_nested_links_from_documents(table):
    text = ('{"rules": [{"rule_id": "r", "related_requirements": ["R1"], "deep": {"related_requirements": ["R2"]}}], '
            '"scope": {"related_requirements": ["R3"]}}')
    out = integrity.nested_requirement_links(table("text string", [text]))
    assert rows_of(out, "req_id", "top_level") == {("R1", True), ("R2", False), ("R3", False)}


def test_nested_links_of_odd_documents(table):
    texts = [
        '{"r": [{"related_requirements": ["R]1", "R\\"2"]}]}', '{"r": [{"related_requirements": ["B1"]', '[{"related_requirements": ["L1"]}]',
        '{"related_requirements": ["T1"], "a": {"b": [{"c": [[{"related_requirements": ["D1"]}]]}]}, "n": null}', '{"r": [{"related_requirements": []}]}',
    ]
    out = integrity.nested_requirement_links(table("text string", texts))
    assert rows_of(out, "req_id", "top_level") == {("R]1", True), ('R"2', True), ("L1", False), ("T1", False), ("D1", False)}


def test_unclaimed_and_ghost_files(table):
    changed = table("path string", ["a.py", "b.py", "docs/task_list.json", "output/x"])
    refs = table("ref string", ["a.py", "b.py#L1"])
    assert rows_of(integrity.unclaimed_files(changed, refs), "path") == {("b.py",), ("docs/task_list.json",), ("output/x",)}
    assert rows_of(integrity.ghost_files(changed, refs), "path") == {("b.py",)}
    assert integrity.ghost_files(changed, refs, strip_fragments=True).count() == 0
    assert integrity.unclaimed_files(changed.filter("false"), refs).count() == 0


def test_reverse_coverage(table):
    changed = table("path string", ["a.py", "b.py", "c.py", "d.py"])
    claim = table("claim_id string, related_task string", [("C1", "T1"), ("C2", "T2"), ("C3", "T3"), ("C4", "T9")])
    code = table("claim_id string, ref string", [("C1", "a.py#L1"), ("C2", "b.py"), ("C3", "c.py"), ("C4", "d.py"), ("C1", "z.py")])
    task = table("task_id string, status string, ord bigint", [("T1", "todo", 1), ("T2", "todo", 2), ("T3", "done", 3)])
    modified = table("task_id string", ["T2"])
    out = integrity.reverse_task_coverage(changed, claim, code, task, modified)
    assert rows_of(out, "path", "task_id", "effect") == {("a.py", "T1", "warn"), ("d.py", "T9", "block")}


def test_criterion_freshness(table):
    new = table("task_id string, ac_id string", [("T1", "AC-P-1-1"), ("T1", "AC-P-1-2")])
    doc = table("doc_id string, text string", [("d", "see AC-P-1-1 here")])
    out = integrity.criterion_freshness(new, integrity.document_criteria(doc), doc)
    assert rows_of(out, "ac_id", "reason") == {("AC-P-1-2", "criterion_not_in_document")}
    none = doc.filter("false")
    out = integrity.criterion_freshness(new, integrity.document_criteria(none), none)
    assert rows_of(out, "reason") == {("document_not_staged",)} and out.count() == 2


def test_scope_globs(table):
    path = F.col("path")
    files = table("path string", ["src/a.py", "x/src/a.py", "vendor/b.js", "lib/vendor/b.js", "a.py", "src/x\nb.py"])
    inside = files.filter(sc.in_scope(path, ["src/**"], []))
    assert rows_of(inside, "path") == {("src/a.py",), ("x/src/a.py",), ("src/x\nb.py",)}
    outside = files.filter(~sc.in_scope(path, [], ["vendor/**"]))
    assert rows_of(outside, "path") == {("vendor/b.js",), ("lib/vendor/b.js",)}
    assert files.filter(sc.in_scope(path)).count() == 6


def test_globs_agree_with_the_standard_library(spark, table):
    import fnmatch

    patterns = ["*.py", "src/?.py", "[ab]*", "[!ab]*", "a.b", "a[", "x]y", "[]]z", "a+b(c)", "**/t_*.py", "[^a]b", "[a-c]?", "[\\]q"]
    paths = ["a.py", "src/a.py", "b/c", "cab", "a.b", "axb", "a[", "x]y", "]z", "a+b(c)", "d/t_1.py", "^b", "ab", "zb", "bz", "\\q"]
    files = table("path string", paths)
    for pattern in patterns:
        want = {(p,) for p in paths if fnmatch.fnmatchcase(p, pattern) or fnmatch.fnmatchcase(p, f"*/{pattern}")}
        assert rows_of(files.filter(sc.matches_any(F.col("path"), [pattern])), "path") == want, pattern
        rule = table("kind string, pattern string", [("include", pattern)])
        assert rows_of(sc.with_scope_flag(files, rule).filter("in_scope"), "path") == want, pattern


def test_scope_by_project(spark, table):
    files = table("path string", ["src/a.py"]).unionByName(table("path string", ["src/a.py"], project="q"))
    pattern = table("kind string, pattern string", [("exclude", "src/*")])
    out = sc.with_scope_flag(files, pattern)
    assert rows_of(out, "project_id", "in_scope") == {("p", False), ("q", True)}
    assert rows_of(sc.scope_counts(out), "project_id", "n_in_scope", "n_out_of_scope") == {("p", 0, 1), ("q", 1, 0)}


def test_health_checks(table):
    evidence, files = table("evidence_id string", ["E1"]), table("path string", ["a.py", "report.json"])
    refs = table("claim_id string, ref string", [("C1", "E1"), ("C1", "report.json"), ("C1", "E9")])
    file_refs = table("claim_id string, ref string", [("C1", "a.py#L1"), ("C1", "b.py"), ("C1", "#L1")])
    link = table("task_id string, req_id string", [("T1", "R1"), ("T1", "R9")])
    rule = table(
        "section string, rule_id string, verification_method string, related_modules array<string>, checker string, verification_command string",
        [("security_rules", "r1", "machine", ["M1"], None, None), ("security_rules", "r2", "machine", ["M9"], None, None),
         ("security_rules", "r3", "machine", [], "x", None), ("security_rules", "r4", "manual", [], None, None),
         ("security_rules", "r5", "machine", None, "", "")])
    issues = [
        health.evidence_ref_issues(refs, evidence, files), health.file_ref_issues(file_refs, files),
        health.link_issues(link, table("req_id string", ["R1"]), check="requirement_mapping", ref="req_id"),
        health.unchecked_rule_issues(rule, table("module_id string", ["M1"])),
    ]
    report = health.health_report(issues)
    assert rows_of(report, "check", "n_issues") == {
        ("evidence_refs_integrity", 1), ("file_refs_integrity", 1), ("requirement_mapping", 1), ("machine_rule_coverage", 2), (None, 5)}
    assert list_of(issues[3], "item_id") == [("r2",), ("r5",)]


def test_uncovered_files(table):
    affected = table("path string", ["a.py", "b.py"])
    assert rows_of(integrity.uncovered_files(affected, table("ref string", ["a.py#L3"])), "path") == {("b.py",)}
