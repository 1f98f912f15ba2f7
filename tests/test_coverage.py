"""Coverage of requirements, criteria and tasks."""

from attestra.operators import coverage as cov
from tests.conftest import aggregated_scans, list_of, rows_of

REQ = "req_id string, title string, priority string, ord bigint"
COVER = "item_id string, evidence_id string, source_type string, status string"


def requirement(table, priority):
    return table(REQ, [("REQ-P-1", "Login", priority, 1)])


def test_requirement_truth_table(spark):
    cases = [
        ("must", ["covered", "covered"], "covered", False),
        ("must", ["covered", "partial"], "partial", False),
        ("must", ["missing"], "partial", False),  # a task that is only planned still covers in part
        ("must", ["covered", "unclear"], "unclear", False),
        ("unclear", ["covered"], "unclear", False),
        ("unclear", [], "missing", False),
        ("must", [], "missing", True),
        ("should", [], "missing", False),
    ]
    req = spark.createDataFrame([(i, "R1", "t", c[0], 1) for i, c in enumerate(cases)], f"project_id int, {REQ}")
    cover = spark.createDataFrame(
        [(i, "R1", f"E{n}", "task", s) for i, c in enumerate(cases) for n, s in enumerate(c[1])], f"project_id int, {COVER}"
    )
    out = cov.requirement_coverage(req, cover)
    assert rows_of(out, "project_id", "status", "n_evidence", "is_gap") == {
        (i, status, len(tasks), gap) for i, (_, tasks, status, gap) in enumerate(cases)
    }


def test_requirement_ignores_other_evidence(table):
    cover = table(COVER, [("REQ-P-1", "E1", "test", "covered"), ("REQ-P-2", "E2", "task", "covered")])
    assert rows_of(cov.requirement_coverage(requirement(table, "must"), cover), "status") == {("missing",)}


def test_requirement_evidence_and_gap_rows(table):
    cover = table(COVER, [("REQ-P-1", "E2", "task", "covered"), ("REQ-P-1", "E1", "task", "covered")])
    req = requirement(table, "must")
    links = cov.item_evidence(req, cover, key="req_id", source_type="task")
    assert list_of(links, "evidence_id") == [("E1",), ("E2",)]
    gaps = cov.requirement_gaps(cov.requirement_coverage(req, cover.filter("false")))
    (row,) = gaps.collect()
    assert (row.item_id, row.item_type, row.target_id, row.severity) == ("REQ-P-1", "requirement", "REQ-P-1", "must")
    assert "Login" in row.reason


def test_criterion_truth_table(spark):
    cases = [
        ("must", True, [("test", "covered")], "covered", False),
        ("must", True, [("test", "violated")], "missing", True),
        ("must", True, [("test", "violated"), ("test", "covered")], "covered", False),
        ("must", True, [("task", "covered")], "missing", True),
        ("must", True, [], "missing", True),
        ("must", False, [], "missing", False),
        ("should", True, [], "missing", False),
        (None, True, [], "missing", False),
    ]
    ac = spark.createDataFrame(
        [(i, "A1", c[0], c[1], 1) for i, c in enumerate(cases)],
        "project_id int, ac_id string, priority string, is_testing_required boolean, ord bigint",
    )
    cover = spark.createDataFrame(
        [(i, "A1", f"E{n}", t, s) for i, c in enumerate(cases) for n, (t, s) in enumerate(c[2])], f"project_id int, {COVER}"
    )
    out = cov.criterion_coverage(ac, cover)
    assert rows_of(out, "project_id", "status", "is_gap") == {(i, c[3], c[4]) for i, c in enumerate(cases)}


TASK = "task_id string, priority string, related_acceptance_criteria array<string>"


CLAIM_CASES = [
    ([], [], [], "no_claim_for_task"),
    (["C1"], [], [], "no_tests_declared"),
    (["C1"], [], [("other.py", "covered", 1)], "no_tests_declared"),
    (["C1"], [("C1", "t.py")], [], None),  # no result is known: declared tests count
    (["C1"], [("C1", "t.py")], [("t.py", "violated", 1)], "test_failed"),
    (["C1"], [("C1", "t.py")], [("x.py", "covered", 1)], "test_failed"),
    (["C1"], [("C1", "t.py")], [("t.py", "covered", 1)], None),
    (["C1"], [("C1", "t.py")], [("t.py", "covered", 1), ("t.py", "violated", 2)], "test_failed"),  # last counts
    (["C1", "C2"], [("C2", "t.py")], [("t.py", "covered", 1)], None),
]


def test_task_claim_coverage(spark):
    def rows(schema, of):
        data = [(i, *row) for i, case in enumerate(CLAIM_CASES) for row in of(case)]
        return spark.createDataFrame(data, f"project_id int, {schema}")

    out = cov.task_claim_coverage(
        rows(TASK, lambda c: [("T1", "must", ["A1", "A2"]), ("T2", "should", ["A3"])]),
        rows("claim_id string, related_task string", lambda c: [(k, "T1") for k in c[0]]),
        rows("claim_id string, ref string", lambda c: c[1]),
        rows("path string, status string, ord bigint", lambda c: c[2]),
    )
    expected = {(i, "T1", c[3]) for i, c in enumerate(CLAIM_CASES) if c[3]}
    assert rows_of(out, "project_id", "task_id", "reason") == expected
    assert cov.uncovered_task_criteria(out).count() == 2 * len(expected)


def test_task_claim_coverage_without_projects(table):
    """Without a project column, whether results are known is a property of the whole input."""
    for results, expected in (([], set()), ([("x.py", "covered", 1)], {("T1", "test_failed")})):
        out = cov.task_claim_coverage(
            table(TASK, [("T1", "must", ["A1"])]), table("claim_id string, related_task string", [("C1", "T1")]),
            table("claim_id string, ref string", [("C1", "t.py")]), table("path string, status string, ord bigint", results),
            scope=(),
        )
        assert rows_of(out, "task_id", "reason") == expected


def test_inherit_covers(table):
    claim = table("claim_id string, related_task string", [("C1", "T1"), ("C2", "T9")])
    task = table("related_task string, covers array<string>", [("T1", ["A1"])])
    out = cov.inherit_covers(claim, task)
    assert {(r.claim_id, tuple(r.covers)) for r in out.collect()} == {("C1", ("A1",)), ("C2", ())}


def test_coverage_summary_and_violations(table):
    files = table("path string, percent_covered double, num_statements int", [("a", 100.0, 10), ("b", 70.0, 10), ("c", 80.0, 5)])
    (row,) = cov.coverage_summary(files).collect()
    assert (row.aggregate_percent, row.total_statements, row.total_covered, row.file_count) == (84.0, 25, 21, 3)
    assert rows_of(cov.coverage_violations(files), "path") == {("b",)}


def test_half_even_rounding_and_no_statements(table):
    files = table("path string, percent_covered double, num_statements int", [("a", 2.25, 100)])
    assert cov.coverage_summary(files).first().aggregate_percent == 2.2
    empty = table("path string, percent_covered double, num_statements int", [("a", 50.0, 0)])
    assert cov.coverage_summary(empty).first().aggregate_percent == 0.0


def test_explode_covers_counts_an_item_once(table):
    ev = table("evidence_id string, covers array<string>", [("E1", ["A", "A", "B"]), ("E2", [])])
    assert list_of(cov.explode_covers(ev), "evidence_id", "item_id") == [("E1", "A"), ("E1", "B")]


def test_evidence_of_a_scan_is_dealt_before_it_is_counted(table, tmp_path):
    """A scan's aggregate held all items of its share, which is a row group at least."""
    path = str(tmp_path / "evidence.parquet")
    statuses = ["covered", "covered", "unclear"]
    rows = [(f"R{i % 40}", f"E{i}", kind, statuses[i % 3]) for i in range(300) for kind in ("task", "test")]
    table(COVER, rows).coalesce(1).write.parquet(path)
    cover = table(COVER, []).sparkSession.read.parquet(path)
    req = table(REQ, [(f"R{i}", "t", "must", i) for i in range(41)])
    out = cov.requirement_coverage(req, cover)
    assert aggregated_scans(out, "source_type") == [False]
    assert {r.req_id: r.n_evidence for r in out.collect()} == {f"R{i}": len(range(i, 300, 40)) if i < 40 else 0 for i in range(41)}
    criterion = req.select("project_id", req.req_id.alias("ac_id"), "priority", "ord").selectExpr("*", "true AS is_testing_required")
    out = cov.criterion_coverage(criterion, cover)
    assert aggregated_scans(out, "source_type") == [False]
    assert {r.ac_id for r in out.collect() if r.is_gap} == {"R40"}
