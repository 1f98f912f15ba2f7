"""Numbering, first-wins and worst-N, also on one project that holds nearly all rows."""

import random

from pyspark.sql import functions as F

from attestra.operators import sequence as seq
from attestra.session import cut_lineage
from tests.conftest import rows_of


def test_numbering_equals_a_plain_sort_whatever_the_blocks(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.9 else f"p{rng.randrange(5)}", rng.randrange(3), rng.randrange(-50, 400), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "project_id string, rank int, ord bigint, tie int").repartition(7)
    want = {}
    for project in {r[0] for r in rows}:
        for n, row in enumerate(sorted(r for r in rows if r[0] == project), 1):
            want[row] = n
    for block in (1, 37, 100_000):
        out = seq.number_rows(df, rank="rank", ties=["tie"], block=block)
        assert {tuple(r)[:4]: r.seq for r in out.select("project_id", "rank", "ord", "tie", "seq").collect()} == want
    out = seq.number_by_range(df, order=["rank", "ord", "tie"], partitions=6)
    assert {tuple(r)[:4]: r.seq for r in out.select("project_id", "rank", "ord", "tie", "seq").collect()} == want


def test_ranges_split_one_hot_project_of_texts(spark):
    rows = [("hot", f"src/same/prefix/{i:05d}.py") for i in range(4000)]
    df = spark.createDataFrame(rows, "project_id string, path string")
    parts = []
    out = seq.number_by_range(df, order=["path"], partitions=8, materialise=lambda d: parts.append(cut_lineage(d)) or parts[0])
    assert [r.seq for r in out.orderBy("path").collect()] == list(range(1, 4001))
    sizes = [r["count"] for r in parts[0].groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_ranges_are_as_many_as_shuffles_start_with(spark):
    """Ranges were as few as the session's shuffle partitions, so each grew with the input."""
    names = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "40", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    }
    before = {name: spark.conf.get(name, None) for name in names}
    df = spark.range(4000).select(F.lit("hot").alias("project_id"), F.xxhash64("id").cast("string").alias("path"))
    parts = []
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        out = seq.number_by_range(df, order=["path"], materialise=lambda d: parts.append(cut_lineage(d)) or parts[0])
        assert [r.seq for r in out.orderBy("path").collect()] == list(range(1, 4001))
        assert parts[0].select("_range").distinct().count() > 10
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_first_and_last_per_key(table):
    df = table("k string, ord int, v string", [("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")])
    assert rows_of(seq.first_per_key(df, ["project_id", "k"], ["ord"]), "k", "v") == {("a", "y"), ("b", "z")}
    assert rows_of(seq.last_per_key(df, ["project_id", "k"], ["ord"]), "k", "v") == {("a", "x"), ("b", "z")}


def test_top_per_scope_limits_before_the_shuffle(table):
    df = table("v int", list(range(20)))
    top = seq.top_per_scope(df, 3, [F.col("v").desc()])
    assert rows_of(top, "position", "v") == {(1, 19), (2, 18), (3, 17)}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
