"""Hash trees: what differs is found, what does not is not read."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, Phase, example, given, settings
from hypothesis import strategies as st

from attestra.operators import delta, digests
from attestra.sources.snapshots import SnapshotStore
from tests.conftest import rows_of

SCHEMA = "project_id string, claim_id string, content_hash string, ord int"
CONTENT = {"ledger": "claim", "key": "claim_id", "content": ["content_hash"]}


def table_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def tree(spark, rows, **options):
    return digests.leaf_digests(table_of(spark, rows), **CONTENT, **options)


def test_order_does_not_matter_and_repeats_do(spark):
    rows = [("p", f"C{i}", f"h{i}", i) for i in range(50)]
    shuffled = random.Random(1).sample(rows, len(rows))
    assert digests.differing(tree(spark, rows), tree(spark, shuffled)).count() == 0
    for more in ([rows[3]], [rows[3]] * 2, [rows[3]] * 4):  # an exclusive or would lose two and four of a kind
        assert digests.differing(tree(spark, rows), tree(spark, rows + more)).count() == 1
    swapped = [("p", "C0", "h1", 0), ("p", "C1", "h0", 1), *rows[2:]]
    assert digests.differing(tree(spark, rows), tree(spark, swapped)).count() in (1, 2)


def test_only_differing_leaves_are_opened(spark):
    rows = [(f"p{i % 40}", f"C{i}", f"h{i}", i) for i in range(800)]
    changed = [(*r[:2], "other", r[3]) if r[1] in ("C7", "C13") else r for r in rows if r[1] != "C20"] + [("new", "C1", "h", 1)]
    found = rows_of(digests.differing(tree(spark, rows), tree(spark, changed)), "project_id")
    assert found == {("p7",), ("p13",), ("p20",), ("new",)}
    assert digests.differing(tree(spark, rows, scope=()), tree(spark, changed, scope=()), scope=()).count() <= 4


ROW = st.tuples(st.sampled_from(["p", "q"]), st.sampled_from(["C1", "C2", "C3", None]), st.sampled_from(["a", "b", None]), st.integers(0, 3))


@settings(max_examples=3, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@example([], [])
@given(st.lists(ROW, max_size=8), st.lists(ROW, max_size=8))
def test_deltas_equal_those_of_whole_ledgers(spark, tmp_path_factory, old, new):
    # the content hash holds the key; rows of one key have different positions
    old, new = ([(p, c, f"{c}{h}" if h else None, 10 * o + i) for i, (p, c, h, o) in enumerate(rows)] for rows in (old, new))
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("snapshots")), groups=3, leaves=2)
    head, staged = table_of(spark, old), table_of(spark, new)
    store.put("old", "claim", head, key="claim_id")
    store.put("new", "claim", staged, key="claim_id")
    columns = ["project_id", "claim_id", "change"]
    want = rows_of(delta.keyed_delta(staged, head, key="claim_id"), *columns)
    assert rows_of(store.keyed_delta("old", "new", "claim", key="claim_id"), *columns) == want
    known = lambda df: df.filter("content_hash is not null")
    columns = ["project_id", "claim_id", "content_hash", "ord"]
    want = rows_of(known(delta.active_claims(staged, head)), *columns)
    assert rows_of(known(store.active_claims("old", "new")), *columns) == want


def test_only_differing_folders_are_read(spark, tmp_path):
    rows = [(f"p{i % 60}", f"C{i}", f"h{i}", i) for i in range(1200)]
    changed = [(*r[:2], "other", r[3]) if r[1] == "C7" else r for r in rows]
    store = SnapshotStore(spark, str(tmp_path), groups=8, leaves=4)
    store.put("old", "claim", table_of(spark, rows), key="claim_id")
    store.put("new", "claim", table_of(spark, changed), key="claim_id")
    out = store.keyed_delta("old", "new", "claim", key="claim_id")
    assert rows_of(out, "project_id", "claim_id", "change") == {("p7", "C7", "modified")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_leaf" in plan
    head, staged = store._opened("old", "new", "claim", "last")
    assert {r.project_id for r in head.collect()} == {"p7"} and staged.count() < 20
    same = store.keyed_delta("old", "old", "claim", key="claim_id")
    assert same.count() == 0
    with pytest.raises(KeyError):
        store.rows("old", "task")


def test_tree_is_written_by_several_tasks(spark, tmp_path):
    """A tree grows with the projects: all its digests were computed by the one task that wrote its file."""
    names = {f"spark.sql.adaptive.{name}": "2k" for name in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize")}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        store = SnapshotStore(spark, str(tmp_path), groups=1, leaves=1)
        store.put("head", "claim", table_of(spark, [(f"p{i}", "C", f"h{i}", i) for i in range(400)]), key="claim_id")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert store.tree("head", "claim").count() == 400
    assert len(store.tree("head", "claim").inputFiles()) > 1
