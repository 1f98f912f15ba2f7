"""One key that holds a third of all rows: same results as brute force, and no task gets it whole."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from attestra.operators import claims as cl
from attestra.operators import compliance as co
from attestra.operators import coverage as cov
from attestra.operators import findings as fi
from attestra.operators import integrity
from tests.conftest import rows_of

N = 3000
RNG = random.Random(11)


def hot(i: int, name: str, n: int) -> str:
    return f"{name}-hot" if i % 3 == 0 else f"{name}{RNG.randrange(n)}"


@pytest.fixture(scope="module")
def cover_rows():
    statuses = ["covered", "partial", "unclear", "violated"]
    return [("p", hot(i, "R", 200), f"E{i}", RNG.choice(["task", "test"]), RNG.choice(statuses)) for i in range(N)]


COVER = "project_id string, item_id string, evidence_id string, source_type string, status string"


def test_requirement_coverage(spark, cover_rows):
    cover = spark.createDataFrame(cover_rows, COVER).repartition(6)
    req = spark.createDataFrame([("p", k, "t", "must", 1) for k in ["R-hot", *(f"R{i}" for i in range(210))]],
                                "project_id string, req_id string, title string, priority string, ord bigint")
    want = {}
    by_item = defaultdict(list)
    for _, item, _, kind, status in cover_rows:
        if kind == "task":
            by_item[item].append(status)
    for key in ["R-hot", *(f"R{i}" for i in range(210))]:
        got = by_item[key]
        want[key] = ("missing" if not got else "unclear" if "unclear" in got else "covered" if set(got) == {"covered"} else "partial", len(got))
    out = cov.requirement_coverage(req, cover)
    assert {r.req_id: (r.status, r.n_evidence) for r in out.collect()} == want


@pytest.fixture(scope="module")
def claim_tables(spark):
    """A third of all claims cite one path, a third of all evidence has that path, a third of all
    references belong to one claim."""
    status = ["covered", "covered", "partial", "violated"]
    evidence = [("p", f"E{i}", "tool", hot(i, "path", 100), None, None, RNG.choice(status), i) for i in range(N)]
    claims = [("p", f"C{i}", "T1", RNG.choice(["covered", "partial"]), i) for i in range(300)] + [("p", "C-hot", "T1", "covered", 300)]
    refs = [("p", hot(i, "C", 300), hot(i + i // 3, "path", 120), i) for i in range(N)]
    make = spark.createDataFrame
    return (evidence, claims, refs), (
        make(evidence, "project_id string, evidence_id string, source_type string, source_path string, nodeid string, task_id string, status string, ord bigint"),
        make(claims, "project_id string, claim_id string, related_task string, claimed_status string, ord bigint"),
        make(refs, "project_id string, claim_id string, ref string, pos int").repartition(6),
    )


def brute_force(evidence, claims, refs):
    at = defaultdict(list)
    for _, id_, _, path, _, _, status, ord_ in evidence:
        at[id_].append(status)
        at[path].append(status)
    done = {c[1] for c in claims if c[3] == "covered"}
    want, named = Counter(), set()
    for _, claim, ref, _ in refs:
        if claim not in done:
            continue
        named.add(claim)
        found = at.get(ref)
        if found is None:
            want[(claim, "non_existent_evidence", ref)] += 1
            continue
        if len(set(found)) > 1:
            want[(claim, "conflicting_statuses", ref)] += 1
        if "violated" in found:
            want[(claim, "violated_evidence", ref)] += 1
        elif "partial" in found:
            want[(claim, "unclear_evidence_status", ref)] += 1
    for claim in done - named:
        want[(claim, "self_referential_claim", None)] += 1
    return want


def test_reference_findings(claim_tables):
    raw, (evidence, claims, refs) = claim_tables
    out = cl.reference_findings(claims, refs, evidence)
    assert Counter((r.claim_id, r.category, r.ref) for r in out.collect()) == brute_force(*raw)


def test_hot_partitions_are_split(spark, claim_tables):
    """With thresholds fit for the test data, the adaptive planner splits the hot side of the joins."""
    raw, (evidence, claims, refs) = claim_tables
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB", "spark.sql.shuffle.partitions": "12",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        out = cl.reference_findings(claims, refs, evidence)
        got = Counter((r.claim_id, r.category, r.ref) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert got == brute_force(*raw)
    assert "skew=true" in plan


def test_dangling_and_mapping(spark, cover_rows):
    child = spark.createDataFrame([(r[0], r[1], r[2]) for r in cover_rows], "project_id string, ref string, id string")
    parent = spark.createDataFrame([("p", f"R{i}") for i in range(100)], "project_id string, req_id string")
    out = integrity.dangling_refs(child, parent, ref="ref", key="req_id")
    known = {f"R{i}" for i in range(100)}
    assert rows_of(out, "id") == {(r[2],) for r in cover_rows if r[1] not in known}


def test_first_violation_and_related_files(spark):
    violations = [("p", hot(i, "G", 50), f"m{i:05d}", f"E{i}", RNG.randrange(500)) for i in range(N)]
    df = spark.createDataFrame(violations, "project_id string, rule_id string, message string, evidence_id string, ord bigint").repartition(6)
    want = {}
    for _, rule, message, evidence, ord_ in violations:
        want[rule] = min(want.get(rule, (10**9, "", "")), (ord_, message, evidence))
    out = fi.violation_risks(df)
    assert {r.target_id: (r.ord, r.evidence_id) for r in out.collect()} == {k: (v[0], v[2]) for k, v in want.items()}

    claims = [("p", f"C{i}", hot(i, "T", 40), i) for i in range(600)]
    refs = [("p", hot(i, "C", 600), f"f{i}.py", i) for i in range(N)]
    links = [("p", f"T{i}", f"A{i % 7}") for i in range(40)] + [("p", "T-hot", f"A{i}") for i in range(7)]
    order = {c[1]: (c[3], c[2]) for c in claims}
    best = defaultdict(list)
    for _, claim, ref, pos in refs:
        if claim in order:
            for _, task, ac in links:
                if task == order[claim][1]:
                    best[ac].append((order[claim][0], claim, pos, ref))
    out = fi.related_files(
        spark.createDataFrame(links, "project_id string, task_id string, ac_id string"),
        spark.createDataFrame(claims, "project_id string, claim_id string, related_task string, ord bigint"),
        spark.createDataFrame(refs, "project_id string, claim_id string, ref string, pos int"), n=3)
    got = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r.position):
        got[r.ac_id].append(r.path)
    assert got == {ac: [x[3] for x in sorted(rows)[:3]] for ac, rows in best.items()}


def test_evidence_for_paths_by_brute_force(spark):
    names = ["a.py", "b.py", "__init__.py"]
    paths = [f"src/{RNG.choice('xyz')}/{RNG.choice(names)}" for _ in range(60)] + ["__init__.py", "y.py", "/lead/src/x/a.py"]
    known = [(f"{RNG.choice(['', 'src/', 'root/src/'])}{RNG.choice('xyz')}/{RNG.choice(names)}", f"E{i}", i) for i in range(200)] + [("py", "E900", 900)]
    out = co.evidence_for_paths(
        spark.createDataFrame([("p", p) for p in paths], "project_id string, path string"),
        spark.createDataFrame([("p", *k) for k in known], "project_id string, source_path string, evidence_id string, ord bigint"))
    def first(path):
        path = path.strip("/")
        for ev, id_, _ in known:
            if path == ev or path.endswith(ev) or ev.endswith(path):
                return id_
        return "EVIDENCE-P-999"
    assert {(r.path, r.evidence_id) for r in out.collect()} == {(p, first(p)) for p in paths}
    assert out.filter(F.col("evidence_id").isNull()).count() == 0
