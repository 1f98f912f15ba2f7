"""Session settings the plans are written for, lineage cutting and stored intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Shuffled keys and flags compress well: a task's share is some tens of times as large in memory, once per sort and aggregate.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Row-emitting joins stream the side that can be hot on the left against unique keys on the
    # right, so the adaptive planner can split a hot partition of the left side.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Of a key that an object repeats, the last value counts, as where documents are loaded otherwise.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Recursive queries go as deep as documents are nested.
    "spark.sql.cteRecursionLevelLimit": "-1",
    "spark.sql.cteRecursionRowLimit": "-1",
    # Python workers hold a few batches at a time, and there are as many workers as cores.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

#: Partitions that the governance queries' shuffles start with: of 10 GB, some 50 MB each. With more than
#: ``spark.shuffle.sort.bypassMergeThreshold`` of them a task keeps all it writes in memory, a whole row group of a scan.
FINE = 200
#: Bytes of a file that a task of theirs reads at most: keys of a scan are often all different, and its aggregate holds each of them.
FINE_READ = 8 << 20
#: Values of the hash that rows are dealt by, many for each partition.
SHARES = 1 << 16


def local_session(app: str = "attestra", cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster sets partitions and memory itself."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a session that someone else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def prepare(spark: SparkSession) -> None:
    """``configure``, and let Python workers import this package from where the driver has it.

    Local workers then need no setting of their own. A job on a cluster sends the package along with --py-files.
    """
    configure(spark)
    environment = spark.sparkContext.environment
    # What a worker frees goes back to the system: batches come as large blocks, and workers live on.
    environment.update({"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(1 << 20)})
    parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if parent not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, parent])


def split_finely(spark: SparkSession) -> None:
    """Shuffles start with at least FINE partitions, whatever their number elsewhere; adaptive execution joins small ones.

    A task's share of a shuffle cannot be smaller than a partition, so with a fixed few of them it would grow with the input.
    So it would in a scan, whose share Spark lets grow to 128 MB; it is FINE_READ bytes, or a row group where these are larger.
    """
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(FINE, own)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(FINE_READ))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over tasks by a hash of ``keys``, in even shares; adaptive execution splits a hot key's.

    For aggregates of a scan with many keys: they hold every key of their share, and a scan's is one row group at least, however
    large its writer made it. The hash itself is no key, so what is split is still aggregated before it meets.
    """
    share = "_share"
    return df.withColumn(share, F.pmod(F.xxhash64(*keys), F.lit(SHARES)).cast("int")).hint("rebalance", F.col(share)).drop(share)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local session that names none
    gets a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="attestra-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Smaller than a checkpoint and read by column, for tables that are large or read in part.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
