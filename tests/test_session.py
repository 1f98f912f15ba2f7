"""Sizes of tasks under the session's settings."""

from pyspark.sql import functions as F

from attestra.plans.bindings import Bound
from attestra.session import dealt, prepare


def test_keys_that_compress_well_are_dealt_over_tasks(spark):
    """Ten megabytes of shuffled keys, which take many times that in sorts and aggregates, were one task's."""
    names = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in names}
    prepare(spark)
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(1_500_000).select(F.xxhash64("id").alias("key")).groupBy("key").count()
        assert rows.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_governance_shuffles_are_not_held_to_few_partitions(spark, tmp_path):
    """With two partitions for all shuffles, a task had half of the input, however large."""
    held = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    names = {
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    }
    before = {name: spark.conf.get(name) for name in names}
    try:
        Bound(spark, str(tmp_path))
        for name, value in names.items():
            spark.conf.set(name, value)
        Bound(spark, str(tmp_path))
        rows = spark.range(4_000_000).select(F.xxhash64("id").alias("key")).groupBy("key").count()
        assert rows.groupBy(F.spark_partition_id()).count().count() > 2
        spark.conf.set("spark.sql.shuffle.partitions", "1000")
        Bound(spark, str(tmp_path))
        assert spark.conf.get(held) == "1000"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
        spark.conf.unset(held)


def test_governance_scans_are_read_in_small_shares(spark, tmp_path):
    """A scan's aggregate keeps the keys of its share, which Spark lets grow to 128 MB with the input."""
    held = "spark.sql.files.maxPartitionBytes"
    before = {name: spark.conf.get(name, None) for name in (held, "spark.sql.files.minPartitionNum")}
    spark.range(2_500_000).select(F.xxhash64("id").alias("key")).coalesce(1).write.parquet(str(tmp_path / "keys.parquet"))
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.unset(held)
        assert Bound(spark, str(tmp_path)).table("keys").rdd.getNumPartitions() > 2
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_governance_shuffles_are_written_row_by_row(spark, tmp_path):
    """With more partitions a task kept all rows of its scan's share, one row group at least, before it wrote them."""
    held = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        Bound(spark, str(tmp_path))
        most = spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200")
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) < int(spark.conf.get(held)) <= int(most)
    finally:
        spark.conf.unset(held)


def test_dealt_rows_split_a_hot_key(spark):
    """Rows stay as they are, equal keys meet unless there are many, and no task gets a hot key whole."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {name: spark.conf.get(name) for name in small}
    rows = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 > 0, F.col("id") % 700).alias("key"), F.xxhash64("id").alias("value"))
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        out = dealt(rows, "key")
        assert out.columns == rows.columns
        assert out.exceptAll(rows).isEmpty() and rows.exceptAll(out).isEmpty()
        parts = out.select("key", F.spark_partition_id().alias("part")).groupBy("key", "part").count().groupBy("key").count()
        spread = {r["key"]: r["count"] for r in parts.collect()}
        assert spread[None] > 1 and len(spread) > 600
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
