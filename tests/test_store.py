"""Ledgers in buckets, roll-ups kept by change sets, and commits."""

from __future__ import annotations

import random
import subprocess
import sys
import textwrap

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra.operators import coverage, rollup
from attestra.sources import commits, sinks
from attestra.sources.rollups import RollupStore
from attestra.sources.store import LedgerStore
from tests.conftest import rows_of

COVER = "project_id string, evidence_id string, item_id string, source_type string, status string"
STATUSES = ["covered", "partial", "unclear"]


@pytest.fixture
def planned(spark):
    """Plans as written: no broadcasts, no adaptive execution."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v)


def test_bucketed_ledgers_are_joined_without_exchange(spark, planned):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"p{i % 4}", f"E{i}", f"R{rng.randrange(40)}", "task", rng.choice(STATUSES)) for i in range(600)]
    cover = spark.createDataFrame(rows, COVER)
    items = sorted({(r[0], r[2]) for r in rows} | {("p1", "R-none")})
    requirement = spark.createDataFrame([(p, r, "t", "must", 1) for p, r in items], "project_id string, req_id string, title string, priority string, ord bigint")
    store = LedgerStore(spark, buckets=5)
    stored = store.put("requirement", requirement, ["project_id", "req_id"])
    counts = store.put("cover", rollup.status_counts(cover), ["project_id", "item_id"])
    out = coverage.requirement_coverage(stored, counts, weight=rollup.COUNT)
    assert "Exchange" not in planned(out)
    plain = coverage.requirement_coverage(requirement, cover)
    assert "Exchange" in planned(plain)
    columns = ["project_id", "req_id", "status", "n_evidence", "is_gap"]
    assert rows_of(out, *columns) == rows_of(plain, *columns)
    # a project with a third of all rows lies in all buckets
    files = stored.filter("project_id = 'hot'").select(F.input_file_name().alias("f")).distinct().count()
    assert files == 5
    store.put("cover", rollup.status_counts(cover.limit(0)), ["project_id", "item_id"])
    assert rows_of(coverage.requirement_coverage(stored, store.table("cover"), weight=rollup.COUNT), "status") == {("missing",)}
    store.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(store.prefix)]


def test_gate_over_the_store_has_few_exchanges(spark, planned):
    import os

    from attestra.plans import queries
    from attestra.plans.bindings import Bound

    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf_dir):
        pytest.skip("sample tables are not here")
    b = Bound(spark, sf_dir)
    store = queries._stored_ledgers(b, buckets=3)
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(k, v)
    assert planned(queries.gate_of_store(b, store)).count("Exchange") <= 8


ROW = st.tuples(st.sampled_from(["p", "q"]), st.sampled_from(["E1", "E2", "E3", "E4"]), st.sampled_from(["R1", "R2", "R3"]),
                st.sampled_from(["task", "test"]), st.sampled_from(STATUSES))


@settings(max_examples=4, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, max_size=12), st.lists(ROW, max_size=12))
def test_change_sets_equal_counting_anew(spark, before, after):
    old, new = (spark.createDataFrame(rows, COVER) for rows in (before, after))
    counted = rollup.status_counts(old)
    fields = ["project_id", "item_id", "source_type", "status", "n"]
    want = rows_of(rollup.status_counts(new), *fields)
    assert rows_of(rollup.merged(counted, rollup.changed_rows(old, new, ["evidence_id"])), *fields) == want
    assert rows_of(rollup.merged(counted, rollup.changes(new, old)), *fields) == want


def test_stored_rollups_read_only_changed_parts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"p{i % 3}", f"E{i}", f"R{rng.randrange(200)}", rng.choice(["task", "test"]), rng.choice(STATUSES)) for i in range(900)]
    store = RollupStore(spark, str(tmp_path), parts=12)
    store.create(spark.createDataFrame(rows, COVER), run_id="R1")
    before = commits.current(spark, str(tmp_path))
    changed = [(*r[:4], "covered" if r[4] != "covered" else "partial") if r[2] == "R7" else r for r in rows if r[2] != "R8"] + [("new", "E", "R7", "task", "covered")]
    delta = rollup.changed_rows(*(spark.createDataFrame(x, COVER) for x in (rows, changed)), ["evidence_id"])
    touched = store.apply(delta, run_id="R2")
    after = commits.current(spark, str(tmp_path))
    assert 0 < len(touched) < 12
    assert {n for n in after if after[n] != before.get(n)} == {f"part-{p}" for p in touched}
    read = store.counts(touched).inputFiles()
    assert all("/part=" in f and int(f.split("/part=")[1].split("/")[0]) in touched for f in read)
    fields = ["project_id", "item_id", "source_type", "status", "n"]
    assert rows_of(store.counts(), *fields) == rows_of(rollup.status_counts(spark.createDataFrame(changed, COVER)), *fields)
    assert rollup.inconsistencies(store.counts()).count() == 0
    assert store.apply(delta.limit(0), run_id="R3") == [] and commits.last_commit(spark, str(tmp_path)) == 2
    # everything of a part may go, and what was never there shows
    gone = rollup.changes(spark.createDataFrame([], COVER), spark.createDataFrame(changed, COVER))
    store.apply(gone, run_id="R4")
    assert store.counts() is None or store.counts().count() == 0
    store.apply(gone.limit(1), run_id="R5")
    assert rollup.inconsistencies(store.counts()).count() == 1


def test_commits(spark, tmp_path, table):
    path = str(tmp_path)
    assert commits.last_commit(spark, path) == 0 and commits.current(spark, path) == {}
    with pytest.raises(KeyError):
        commits.table(spark, path, "a")
    places = []
    for n, run in enumerate(["R1", "R2", "R2"]):
        place = commits.attempt(path, "a")
        table("v int", [n]).write.parquet(place)
        places.append(place)
        assert commits.publish(spark, path, {"a": place}, run_id=run) == n + 1
    assert rows_of(commits.table(spark, path, "a"), "v") == {(2,)} and rows_of(commits.table(spark, path, "a", 1), "v") == {(0,)}
    assert commits.commit_of_run(spark, path, "R2") == 3 and commits.commit_of_run(spark, path, "R9") == 0
    commits.publish(spark, path, {"b": places[0]}, run_id="R3", keep=True)
    assert set(commits.current(spark, path)) == {"a", "b"}


def test_killed_run_leaves_the_former_one_readable(spark, tmp_path, table):
    """A process writes two sections and is killed in the second; its run is not there, and a new attempt of it is."""
    path = str(tmp_path)
    sinks.write_report({"gate": table("gate_decision string", ["pass"]), "gaps": table("item_id string", ["A"])}, path, run_id="R1")
    program = textwrap.dedent(f"""
        import os, signal, sys
        sys.path.insert(0, {str(sys.path[0])!r})
        sys.path.insert(0, {__file__.rsplit('/tests/', 1)[0]!r})
        from attestra.session import local_session
        from attestra.sources import sinks
        spark = local_session("killed", cores="2", shuffle_partitions=2)
        gate = spark.createDataFrame([("p", "blocked"), ("gone", "blocked")], "project_id string, gate_decision string")
        gaps = spark.createDataFrame([("p", "B")], "project_id string, item_id string")
        original, calls = sinks.write_section, []
        def write(rows, place, **options):
            calls.append(place)
            if len(calls) == 2:
                os.kill(os.getpid(), signal.SIGKILL)
            original(rows, place, **options)
        sinks.write_section = write
        sinks.write_report({{"gate": gate, "gaps": gaps}}, {path!r}, run_id="R2")
    """)
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, timeout=240)
    assert done.returncode == -9
    assert rows_of(spark.read.parquet(f"{path}/gate"), "run_id") == {("R1",), ("R2",)}  # its first section was written
    assert rows_of(sinks.read_report(spark, path, "gate"), "run_id", "gate_decision") == {("R1", "pass")}
    with pytest.raises(KeyError):
        sinks.read_report(spark, path, "gate", run_id="R2")
    sinks.write_report({"gate": table("gate_decision string", ["fail"]), "gaps": table("item_id string", ["B"])}, path, run_id="R2")
    assert rows_of(sinks.read_report(spark, path, "gate"), "project_id", "gate_decision") == {("p", "fail")}
    assert rows_of(sinks.read_report(spark, path, "gaps", run_id="R1"), "item_id") == {("A",)}


def test_equal_rows_are_dealt_over_report_parts(spark):
    rows = spark.range(10_000).select(F.lit("p").alias("project_id"), F.lit("same").alias("reason"))
    parts = sinks.report_documents({"reasons": rows}).collect()
    sizes = [p.document.count("same") for p in parts]
    assert sum(sizes) == 10_000 and len(parts) == 10 and max(sizes) == 1000


def test_small_projects_get_one_file(spark, tmp_path):
    claims = spark.range(4000).select(F.concat(F.lit("p"), (F.col("id") % 5).cast("string")).alias("project_id"), F.col("id").cast("string").alias("claim_id")).repartition(8)
    commit = claims.select("project_id", F.lit("c").alias("commit_id")).distinct().filter("project_id <> 'p0'")
    sinks.archive_claims(claims, commit, f"{tmp_path}/archive", f"{tmp_path}/next", as_of=F.lit("2024-01-02").cast("timestamp"))
    assert len(spark.read.parquet(f"{tmp_path}/archive").inputFiles()) == 4
    assert len(spark.read.parquet(f"{tmp_path}/next").inputFiles()) == 1
