"""Documents, ledgers, tool reports, outputs, the decision stream."""

import json

import pytest
from pyspark.sql import functions as F

from attestra.sources import documents as do
from attestra.sources import ledgers as le
from attestra.sources import reports as re_
from attestra.sources import sinks
from attestra.streaming import decisions as stream
from tests.conftest import list_of, rows_of

GOOD = """---
# comment
project_name: "Shop: online"
status: draft
project_abbreviation: 'P'
---
# Title

### REQ-P-1：Login ：

#### 优先级

Must

more text

#### 类别

functional

##### AC-P-1-1: works

- 说明
- 是否必须有测试：是

##### AC-P-1-2 fails

是否必须有测试: 否

### Q-2 Speed

#### 优先级
should
#### 类别
quality_evolution

### Other section

- 是否必须有测试：否

## End
"""
BAD = """## REQ-P-1 wrong level
### REQ-P-2 two
#### 优先级
urgent
##### AC-P-1-1 wrong parent
- 是否必须有测试：maybe
#### AC-P-2-1 wrong level
### REQ-P-2 again
### Q-9 slow
#### 优先级
could
#### 类别
functional
##### AC-P-9-1 orphan
"""


@pytest.fixture(scope="module")
def parsed(spark):
    docs = spark.createDataFrame([("p", "good", GOOD), ("p", "bad", BAD), ("p", "empty", "")], "project_id string, doc_id string, text string")
    lines = do.document_lines(docs, prefix="P")
    return docs, lines, do.parse_requirements(lines), do.parse_criteria(lines)


def test_requirements(parsed):
    _, _, requirement, _ = parsed
    good = requirement.filter("doc_id = 'good'")
    assert list_of(good, "req_id", "title", "priority", "category") == [
        ("Q-2", "Speed", "should", "quality_evolution"), ("REQ-P-1", "Login", "must", "functional")]


def test_criteria(parsed):
    _, _, _, criterion = parsed
    assert list_of(criterion.filter("doc_id = 'good'"), "ac_id", "req_id", "title", "is_testing_required", "flag_state") == [
        ("AC-P-1-1", "REQ-P-1", "works", True, "ok"), ("AC-P-1-2", "REQ-P-1", "fails", False, "ok")]


def test_document_problems(parsed):
    _, lines, requirement, criterion = parsed
    problems = do.document_problems(lines, requirement, criterion)
    assert problems.filter("doc_id <> 'bad'").count() == 0
    assert rows_of(problems, "problem", "item_id") == {
        ("requirement_heading_level", "REQ-P-1 wrong level"), ("criterion_heading_level", "AC-P-2-1 wrong level"),
        ("criterion_under_wrong_requirement", "AC-P-1-1"), ("criterion_under_wrong_requirement", "AC-P-9-1"),
        ("parent_requirement_missing", "AC-P-1-1"), ("parent_requirement_missing", "AC-P-9-1"),
        ("test_flag_invalid", "AC-P-1-1"), ("test_flag_missing", "AC-P-9-1"), ("priority_invalid", "REQ-P-2"),
        ("category_missing", "REQ-P-2"), ("quality_category_expected", "Q-9"), ("duplicate_requirement", "REQ-P-2")}


def test_front_matter(parsed):
    docs = parsed[0]
    assert rows_of(do.front_matter(docs), "key", "value") == {("project_name", "Shop: online"), ("status", "draft"), ("project_abbreviation", "P")}
    assert rows_of(do.project_documents(docs), "doc_id", "status", "project_name") == {
        ("good", "draft", "Shop: online"), ("bad", "active", None), ("empty", "active", None)}


def test_manifest(spark, tmp_path, table):
    root = tmp_path / "proj"
    (root / "docs").mkdir(parents=True)
    (root / "docs" / "prd.md").write_bytes(b"# x")
    (root / "docs" / "bad.json").write_text("{")
    (root / "docs" / "ok.json").write_text("[1]")
    (root / "docs" / "binary.md").write_bytes(b"\xff\xfe\x00")
    files = le.read_files(spark, str(root), project="p", root=str(root))
    expected = table("file_key string, path string, is_required boolean", [
        ("prd", "docs/prd.md", True), ("bad", "docs/bad.json", False), ("ok", "docs/ok.json", False),
        ("binary", "docs/binary.md", False), ("gone", "docs/gone.md", False), ("needed", "docs/needed.md", True)])
    manifest = le.input_manifest(expected, files)
    assert rows_of(manifest, "file_key", "status", "error_code") == {
        ("prd", "ok", None), ("bad", "parse_error", "invalid_input"), ("ok", "ok", None), ("binary", "read_error", "invalid_input"),
        ("gone", "missing", None), ("needed", "missing", "missing_input")}
    assert rows_of(le.manifest_errors(manifest), "n_errors", "has_required_errors") == {(3, True)}
    import hashlib
    assert manifest.filter("file_key = 'prd'").first().sha256 == hashlib.sha256(b"# x").hexdigest()


def test_task_and_claim_documents(table):
    tasks = json.dumps({"tasks": [{"task_id": "TASK-P-1", "status": "done", "related_requirements": ["R"], "definition_of_done": [{"dod_id": "D", "description": "x"}]},
                                  {"task_id": "TASK-P-9999"}, {"task_id": "TASK-P-2"}]})
    out = le.tasks_from(table("text string", [tasks, "broken", "{}"]))
    assert list_of(out, "task_id", "ord") == [("TASK-P-1", 0), ("TASK-P-2", 2)]
    claims = json.dumps([{"claim_id": "CLAIM-P-1", "related_task": "TASK-P-1", "timestamp": "2024-01-01T00:00:00Z", "code_refs": ["a"]}, {"claim_id": "CLAIM-P-9999"}])
    (row,) = le.claims_from(table("text string", [claims, "nope"])).collect()
    assert (row.claim_id, row.code_refs, row.test_refs, row.claimed_ts.year) == ("CLAIM-P-1", ["a"], [], 2024)


def test_rule_documents(table):
    doc = json.dumps({
        "security_rules": [{"rule_id": "S1", "accepted_at": "2024-01-01T00:00:00Z"}], "quality_gates": [{"gate_id": "G1", "severity": "should"}, {"title": "no id"}],
        "module_boundaries": [{"module_id": "M1", "owned_files": ["a.py"], "allowed_to_call": []}, {"module_id": "M2"}],
        "governance_boundary": {"included_patterns": ["src/**"], "excluded_patterns": ["x"]}})
    docs = table("text string", [doc, "{}", "bad"])
    assert list_of(le.rules_from(docs), "section", "rule_id", "severity", "verification_method") == [
        ("quality_gates", "G1", "should", "machine"), ("quality_gates", None, "must", "machine"), ("security_rules", "S1", "must", "machine")]
    assert {(m.module_id, None if m.allowed_to_call is None else tuple(m.allowed_to_call)) for m in le.modules_from(docs).collect()} == {("M1", ()), ("M2", None)}
    assert rows_of(le.scope_patterns_from(docs), "kind", "pattern") == {("include", "src/**"), ("exclude", "x")}


def test_decision_documents(table):
    entry = {"decision_id": 1, "category": "c", "targetId": "t", "action": "accept_risk", "reason": "r", "decidedBy": "d", "timestamp": "2024-01-01T00:00:00Z"}
    docs = table("text string", [json.dumps({"decisions": [entry]}), json.dumps([entry]), "[", "{}"])
    log = le.decisions_from(docs)
    assert rows_of(log, "decision_id", "targetId") == {(1, "t")} and log.count() == 2
    request = log.withColumn("decision_id", F.lit(None).cast("bigint")).unionByName(log.withColumn("action", F.lit(None).cast("string")))
    assert sorted(r.decision_id for r in le.new_decisions(request, log).collect()) == [2, 3]
    assert rows_of(le.new_decisions(request.limit(1), log.filter("false")), "decision_id") == {(1,)}
    assert {tuple(r.missing_fields) for r in le.invalid_decisions(request).collect()} == {("action",)}


def test_changed_files_and_snapshots(table):
    assert rows_of(le.changed_files(table("text string", ["a.py\n\n b.py \r\na.py"])), "path") == {("a.py",), ("b.py",)}
    both = table("snapshot string, x int", [("head", 1), ("staged", 2)])
    assert rows_of(le.snapshot(both, "staged"), "x") == {(2,)}


RUN = "path string, tool_category string, exit_code int, stdout string, stderr string, report string, ord bigint"
TESTS = json.dumps({"tests": [
    {"nodeid": "t.py::a", "outcome": "passed", "docstring": "covers AC-P-1-1"}, {"nodeid": "t.py::b", "outcome": "error", "metadata": {"docstring": "covers: REQ-P-2"}},
    {"nodeid": "t.py::c", "outcome": "skipped"}, {"outcome": "failed"}]})


def test_test_reports(table):
    runs = table(RUN, [("t.py", "test", 1, "", "", TESTS, 0), ("u.py", "test", 0, TESTS, "", "{", 1), ("v.py", "test", 0, "text", "", None, 2),
                       ("w.py", "test", 1, None, "", None, 3), ("x.py", "test", 5, TESTS, "", None, 4), ("y.py", "test", 3, "", "", None, 5)])
    out = re_.test_evidence(runs, prefix="P")
    assert {(r.source_path, r.status, tuple(r.covers)) for r in out.filter("ord = 0").collect()} == {
        ("t.py::a", "covered", ("AC-P-1-1",)), ("t.py::b", "violated", ("REQ-P-2",)), ("t.py::c", "unclear", ()), ("t.py", "violated", ())}
    assert list_of(out.filter("ord > 0"), "ord", "source_type", "status")[-2:] == [(2, "test", "covered"), (3, "test", "violated")]
    assert out.filter("ord = 1").count() == 4
    assert list_of(re_.run_evidence(runs).filter("error_code is not null"), "source_path", "status", "error_code") == [
        ("x.py", "skipped", "tool_no_tests_collected"), ("y.py", "blocked", "tool_execution_failed")]


def test_other_tool_reports(table):
    two = '[{"code": "E1"}, {"code": "E2"}]'
    runs = table(RUN, [
        ("a", "lint", 1, two, "", None, 0), ("b", "lint", 1, f'{{"violations": {two}}}', "", None, 1), ("c", "lint", 0, "not json", "", None, 2), ("d", "lint", 2, two, "", None, 3),
        ("a", "type_check", 1, "x: error: y\nz\nq: error: w", "", None, 4), ("b", "type_check", 0, "x: error: y", "", None, 5), ("c", "type_check", 1, "", "", '{"summary": {"error_count": 7}}', 6),
        ("a", "security", 1, "", "", '{"results": [{"a": 1}]}', 7), ("b", "security", 0, '{"results": []}', "", None, 8), ("c", "security", 1, two, "", None, 9)])
    out = re_.tool_evidence(runs, prefix="P")
    assert {r.ord: (r.status, r.n_findings) for r in out.collect()} == {
        0: ("violated", 2), 1: ("violated", 2), 2: ("compliant", 0), 3: ("blocked", None), 4: ("violated", 2), 5: ("compliant", 0), 6: ("violated", 7),
        7: ("violated", 1), 8: ("compliant", 0), 9: ("violated", 2)}
    assert rows_of(re_.evidence_run_summary(out), "n_executed", "n_blocked", "n_skipped") == {(10, 1, 0)}


def test_coverage_reports(table):
    text = json.dumps({"files": {"a": {"percent_covered": 100, "num_statements": 3}, "b": {"percent_covered": 70}, "c": {"percent_covered": 80}, "d": {"num_statements": 1}, "e": None}})
    out = re_.coverage_evidence(table("text string, ord bigint", [(text, 1), ("{", 2)]))
    assert rows_of(out, "source_path", "status", "num_statements") == {("a", "compliant", 3), ("b", "violated", 0), ("c", "compliant", 0)}


def test_work_lists(table):
    refs = table("kind string, ref string", [("code", "a.py#L1"), ("test", "a.py"), ("code", "b.py"), ("code", "c.md"), ("code", "gone.py"), ("evidence", "z.py"), ("code", "Makefile")])
    files, changed = table("path string", ["a.py", "b.py", "c.md", "z.py"]), table("path string", ["b.py", "x.rs", "y.rs"])
    assert rows_of(re_.work_list(refs, files, changed), "path", "path_type") == {("b.py", "source")}
    every = re_.work_list(refs, files, changed.filter("false"))
    assert rows_of(every, "path", "path_type") == {("a.py", "test"), ("b.py", "source")}
    assert rows_of(re_.skipped_refs(refs), "source_path", "status") == {("c.md", "skipped")}
    assert rows_of(re_.unknown_extensions(changed), "extension") == {(".rs",)}
    expected = re_.expected_reports(every, ["test", "lint"])
    assert rows_of(expected, "path", "tool_category") == {("a.py", "test"), ("b.py", "lint")}
    assert rows_of(re_.missing_reports(expected, table("path string, tool_category string", [("a.py", "test")])), "path") == {("b.py",)}


def test_claim_test_results(table):
    refs = table("ref string", ["a.py#L1", "b.py", "c.py", "d.py", "e.py", "a.py"])
    runs = table("path string, exit_code int, stdout string, timed_out boolean", [("a.py", 0, "3 passed in 1s", False), ("b.py", 1, "1 failed, 2 passed, 1 error", None), ("c.py", 1, "", True)])
    out = re_.claim_test_results(refs, runs, table("path string", ["a.py", "b.py", "c.py", "d.py"]))
    assert rows_of(out, "path", "status", "num_tests") == {("a.py", "passed", 3), ("b.py", "failed", 4), ("c.py", "timeout", 0), ("d.py", "not_run", 0), ("e.py", "file_not_found", 0)}


def test_index_and_report_sinks(spark, tmp_path, table):
    ev = table("evidence_id string, source_type string, source_path string, covers array<string>, status string, ord bigint", [("EVIDENCE-P-001", "test", "a", ["x"], "covered", 1)])
    path = str(tmp_path / "index")
    sinks.write_evidence_index(ev, path, run_id="R1", prefix="P")
    sinks.write_evidence_index(ev, path, run_id="R2", prefix="P")
    assert rows_of(spark.read.parquet(path), "run_id", "evidence_id") == {("R1", "EVIDENCE-P-001"), ("R2", "EVIDENCE-P-001")}
    with pytest.raises(sinks.InvalidIndex, match=r"evidences\[1\]\.status"):
        sinks.write_evidence_index(ev.withColumn("status", F.lit("fine")), path, run_id="R3", prefix="P")

    gate = table("gate_decision string", ["blocked"])
    reasons = table("seq bigint, reason string", [(2, "b"), (1, "a")])
    manifest = table("file_key string, path string, status string", [("prd", "docs/prd.md", "ok")])
    when = F.lit("2024-01-01").cast("timestamp")
    (meta,) = sinks.run_metadata(gate, reasons, manifest, run_id="R1", scan_time=when).collect()
    assert (meta.exit_code, meta.n_reasons, meta.input_files, meta.scan_time) == (2, 2, {"prd": "docs/prd.md"}, "2024-01-01T00:00:00.000000Z")
    assert rows_of(sinks.run_reasons(reasons, run_id="R1"), "run_id", "seq", "reason") == {("R1", 1, "a"), ("R1", 2, "b")}

    sinks.write_report({"gate": gate, "reasons": reasons}, str(tmp_path / "report"), run_id="R1")
    assert spark.read.parquet(str(tmp_path / "report" / "reasons")).count() == 2
    (doc,) = sinks.report_documents({"reasons": reasons, "gaps": table("item_id string", [])}).collect()
    assert (doc.section, doc.part, doc.n_parts) == ("reasons", 0, 1) and [r["reason"] for r in json.loads(doc.document)] == ["a", "b"]


def test_large_reports_are_complete(spark):
    reasons = spark.range(20_000).select(F.lit("p").alias("project_id"), F.col("id").alias("seq"), F.concat(F.lit("r"), "id").alias("reason"))
    parts = sinks.report_documents({"reasons": reasons}).collect()
    assert {p.n_parts for p in parts} == {20} and len(parts) == 20
    rows = [r["reason"] for p in parts for r in json.loads(p.document)]
    assert sorted(rows) == sorted(f"r{i}" for i in range(20_000))
    gate = spark.createDataFrame([("p", "blocked")], "project_id string, gate_decision string")
    manifest = spark.createDataFrame([], "project_id string, file_key string, path string, status string")
    (meta,) = sinks.run_metadata(gate, reasons, manifest, run_id="R1", scan_time=F.lit("2024-01-01").cast("timestamp")).collect()
    assert meta.n_reasons == 20_000 and sinks.run_reasons(reasons, run_id="R1").count() == 20_000


def test_claim_archive_and_upsert(spark, tmp_path, table):
    claims = table("claim_id string", ["C1", "C2"]).unionByName(table("claim_id string", ["C3"], project="q"))
    commit = table("commit_id string", ["abc"])
    archive, after = str(tmp_path / "archive"), str(tmp_path / "next")
    for _ in range(2):  # running again changes nothing
        sinks.archive_claims(claims, commit, archive, after, as_of=F.lit("2024-01-02").cast("timestamp"))
    assert rows_of(spark.read.parquet(archive), "project_id", "commit_id", "claim_id") == {("p", "commit-abc", "C1"), ("p", "commit-abc", "C2")}
    assert rows_of(spark.read.parquet(after), "project_id", "claim_id") == {("q", "C3")}
    unnamed = sinks.archived_claims(claims, table("commit_id string", [None]), as_of=F.lit("2024-01-02").cast("timestamp"))
    assert rows_of(unnamed, "commit_id") == {("commit-20240102000000",)}
    new = sinks.upsert(claims.withColumn("v", F.lit(1)), table("claim_id string, v int", [("C9", 2)]))
    assert rows_of(new, "project_id", "claim_id", "v") == {("p", "C9", 2), ("q", "C3", 1)}


def test_decision_stream(spark, tmp_path):
    requests, log, rejected, check = (str(tmp_path / n) for n in ("in", "log", "rejected", "check"))
    (tmp_path / "in").mkdir()

    def send(name, **fields):
        entry = {"project_id": "p", "category": "c", "targetId": "t", "action": "accept_risk", "reason": "r", "decidedBy": "d", "timestamp": "2024-01-01T00:00:00Z"}
        (tmp_path / "in" / name).write_text(json.dumps({**entry, **fields}))

    send("a.json")
    send("b.json", action=None)
    stream.start(spark, requests, log, rejected, check).awaitTermination(120)
    send("c.json", targetId="u")
    stream.start(spark, requests, log, rejected, check).awaitTermination(120)
    assert list_of(spark.read.parquet(log), "decision_id", "targetId") == [(1, "t"), (2, "u")]
    assert spark.read.parquet(rejected).count() == 1


def test_repeated_requests_are_logged_once(spark, tmp_path):
    requests, log, rejected, check = (str(tmp_path / n) for n in ("in", "log", "rejected", "check"))
    (tmp_path / "in").mkdir()

    def send(name, *targets):
        entry = {"project_id": "p", "category": "c", "action": "accept_risk", "reason": "r", "decidedBy": "d", "timestamp": "2001-01-01T00:00:00Z"}
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({**entry, "targetId": t}) for t in targets))

    def run():
        query = stream.start(spark, requests, log, rejected, check)
        query.awaitTermination(120)
        return stream.repeats(query)

    send("a.json", "t", "t", "u")
    assert run() == {"repeated": 1, "late": 0, "held": 2}
    send("b.json", "u", "v")  # a new query: its state comes from the checkpoint
    assert run() == {"repeated": 1, "late": 0, "held": 3}
    assert list_of(spark.read.parquet(log), "decision_id", "targetId") == [(1, "t"), (2, "u"), (3, "v")]
