"""Claims against evidence: findings, verdicts, invalid hashes."""

import pytest

from attestra.operators import claims as cl
from attestra.operators import coverage as cov
from tests.conftest import list_of, rows_of

CLAIM = (
    "claim_id string, related_task string, claimed_status string, evidence_refs array<string>, "
    "code_refs array<string>, test_refs array<string>, ord bigint"
)
EVIDENCE = (
    "evidence_id string, source_type string, source_path string, nodeid string, task_id string, status string, "
    "covers array<string>, ord bigint"
)
TASK_OK = ("ET", "task", "tasks.json", None, "T1", "covered", ["REQ-P-1", "AC-P-1-1"], 1)
TEST_OK = ("E1", "test", "tests/a.py::t", "tests/a.py::t", None, "covered", ["AC-P-1-1"], 2)


def analyse(table, claim, evidence):
    claims, ev = table(CLAIM, [claim]), table(EVIDENCE, evidence)
    refs = cl.explode_refs(claims)
    found = cl.claim_findings(
        claims, refs.filter("kind = 'evidence'"), refs.filter("kind = 'test'"), ev, cov.explode_covers(ev), ac_prefix="AC-P-"
    )
    verdict = cl.claim_verdict(claims, found).first()
    return verdict.status, list_of(found, "category", "occurrences"), found


def claim(refs, status="covered", task="T1", tests=()):
    return ("C1", task, status, list(refs), [], list(tests), 1)


CASES = {
    "all good": (claim(["E1"]), [TASK_OK, TEST_OK], "covered", []),
    "by path": (claim(["tests/a.py::t"]), [TASK_OK, TEST_OK], "covered", []),
    "only itself": (claim(["C1"]), [TASK_OK, TEST_OK], "blocked", [("self_referential_claim", 1)]),
    "nothing": (claim([]), [TASK_OK, TEST_OK], "blocked", [("self_referential_claim", 1)]),
    "unknown id": (claim(["E9"]), [TASK_OK, TEST_OK], "low_confidence", [("non_existent_evidence", 1)]),
    "violated": (
        claim(["E2"]), [TASK_OK, TEST_OK, ("E2", "tool", "x.py", None, None, "violated", [], 3)], "violated",
        [("violated_evidence", 1)]),
    "unclear": (
        claim(["E2"]), [TASK_OK, TEST_OK, ("E2", "tool", "x.py", None, None, "skipped", [], 3)], "low_confidence",
        [("unclear_evidence_status", 1)]),
    "task open": (
        claim(["E1"]), [(*TASK_OK[:5], "partial", *TASK_OK[6:]), TEST_OK], "low_confidence", [("task_not_completed", 1)]),
    "no task": (claim(["E1"], task="T9"), [TASK_OK, TEST_OK], "low_confidence", [("non_existent_task", 1)]),
    "criterion untested": (
        claim(["E1"]), [TASK_OK, (*TEST_OK[:6], [], 2)], "low_confidence", [("no_test_coverage", 1)]),
    "criterion failing twice": (
        claim(["E1"]),
        [TASK_OK, TEST_OK, ("E2", "test", "b.py", "b", None, "violated", ["AC-P-1-1"], 3),
         ("E3", "test", "c.py", "c", None, "unclear", ["AC-P-1-1"], 4)],
        "violated", [("failed_tests", 2)]),
    "names another test": (
        claim(["E1"], tests=["tests/z.py"]), [TASK_OK, TEST_OK], "low_confidence", [("test_covers_mismatch", 1)]),
    "names the test": (claim(["E1"], tests=["tests/a.py#L1"]), [TASK_OK, TEST_OK], "covered", []),
    "names no test": (claim(["E1"], tests=[]), [TASK_OK, TEST_OK], "covered", []),
    "several causes, violated wins": (
        claim(["C1"], task="T1"), [TASK_OK, (*TEST_OK[:5], "violated", ["AC-P-1-1"], 2)], "violated",
        [("failed_tests", 1), ("self_referential_claim", 1)]),
    "not completed is not checked": (claim([], status="partial", task="T9"), [TASK_OK], "partial", []),
    "conflict": (
        claim(["x.py"]),
        [TASK_OK, TEST_OK, ("E2", "tool", "x.py", None, None, "covered", [], 3), ("E3", "tool", "x.py", None, None, "compliant", [], 4)],
        "covered", [("conflicting_statuses", 1)]),
    "conflict with violation": (
        claim(["x.py"]),
        [TASK_OK, TEST_OK, ("E2", "tool", "x.py", None, None, "covered", [], 3), ("E3", "tool", "x.py", None, None, "violated", [], 4)],
        "violated", [("conflicting_statuses", 1), ("violated_evidence", 1)]),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    """All cases as projects of one run."""

    def rows(schema, per_case):
        data = [(name, *row) for name, case in CASES.items() for row in per_case(case)]
        return spark.createDataFrame(data, f"project_id string, {schema}")

    claims = rows(CLAIM, lambda case: [case[0]])
    ev = rows(EVIDENCE, lambda case: case[1])
    refs = cl.explode_refs(claims)
    found = cl.claim_findings(
        claims, refs.filter("kind = 'evidence'"), refs.filter("kind = 'test'"), ev, cov.explode_covers(ev), ac_prefix="AC-P-"
    ).collect()
    found_df = spark.createDataFrame(found, schema=FOUND)
    status = {r.project_id: r.status for r in cl.claim_verdict(claims, found_df).collect()}
    return {
        name: (status[name], sorted(((f.category, f.occurrences) for f in found if f.project_id == name), key=repr))
        for name in CASES
    }


FOUND = (
    "project_id string, claim_id string, ord bigint, category string, ref string, detail string, step int, "
    "pos bigint, occurrences bigint"
)


@pytest.mark.parametrize("name", CASES)
def test_verdict(verdicts, name):
    _, _, status, findings = CASES[name]
    assert verdicts[name] == (status, sorted(findings, key=repr))


def test_last_unclear_status_is_quoted(table):
    evidence = [TASK_OK, TEST_OK, ("E2", "tool", "x.py", None, None, "skipped", [], 3), ("E3", "tool", "x.py", None, None, "partial", [], 4)]
    _, _, found = analyse(table, claim(["x.py"]), evidence)
    assert rows_of(found.filter("category = 'unclear_evidence_status'"), "detail") == {("partial",)}
    assert rows_of(found.filter("category = 'conflicting_statuses'"), "detail") == {("partial, skipped",)}


def test_last_task_row_counts(table):
    later = ("ET2", "task", "tasks.json", None, "T1", "blocked", [], 9)
    status, found, _ = analyse(table, claim(["E1"]), [TASK_OK, TEST_OK, later])
    assert (status, found) == ("low_confidence", [("task_not_completed", 1)])


def test_messages_gaps_and_risks(table):
    _, _, found = analyse(table, claim(["C1"]), [TASK_OK, TEST_OK])
    (gap,) = cl.claim_gaps(found).collect()
    assert gap.item_type == "claim" and gap.reason == "Claim C1 is done on self-referential evidence alone."
    (risk,) = cl.claim_risks(found).collect()
    assert (risk.severity, risk.risk_category, risk.claim_id) == ("must", "self_referential_claim", "C1")


def test_support_is_kept_per_reference(table):
    claims = table(CLAIM, [claim(["E1", "E1", "C1", "tests/a.py::t"])])
    ev = table(EVIDENCE, [TASK_OK, TEST_OK])
    refs = cl.explode_refs(claims).filter("kind = 'evidence'")
    assert rows_of(cl.supporting_keys(claims, refs, ev), "ref", "n_supporting") == {("E1", 1), ("tests/a.py::t", 1)}
    assert ("E1", "E1") in rows_of(cl.reference_evidence(ev), "ref", "evidence_id")


def test_invalidation(table):
    refs = table("claim_id string, ref string", [("C1", f"{f}.py#L1-L3") for f in ("same", "other", "gone", "new", "twice")])
    now = table("path string, sha256 string", [("same.py", "h1"), ("other.py", "h2"), ("new.py", "h1"), ("twice.py", "h2")])
    recorded = table(
        "source_path string, file_hash string, ord bigint",
        [("same.py", "h1", 1), ("other.py", "h1", 1), ("gone.py", "h1", 1), ("twice.py::t", "h1", 1), ("twice.py#L1", "h2", 2)],
    )
    out = cl.reference_invalidation(refs, now, recorded)
    assert rows_of(out, "path", "change") == {("other.py", "changed"), ("gone.py", "deleted"), ("new.py", "no_record")}
    (row,) = cl.claims_to_reverify(out).collect()
    assert (row.status, row.n_files, row.n_deleted) == ("needs_reverification", 3, 1)


def test_projects_do_not_mix(spark, table):
    ev = table(EVIDENCE, [TASK_OK, TEST_OK]).unionByName(table(EVIDENCE, [], project="q"))
    claims = table(CLAIM, [claim(["E1"])]).unionByName(table(CLAIM, [claim(["E1"])], project="q"))
    refs = cl.explode_refs(claims)
    found = cl.claim_findings(
        claims, refs.filter("kind = 'evidence'"), refs.filter("kind = 'test'"), ev, cov.explode_covers(ev), ac_prefix="AC-P-"
    )
    assert rows_of(cl.claim_verdict(claims, found), "project_id", "status") == {("p", "covered"), ("q", "low_confidence")}
