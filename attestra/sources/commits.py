"""Several tables published together: readers see all of a commit or the one before it.

A writer puts every table under a place of its own and publishes last: one small manifest, which appears whole, names the places. Until
then nothing a reader resolves has changed, whatever the writer left behind when it was stopped. Commits of a path are
numbered; a path has one writer at a time, and of two that try the same number one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, location string, run_id string"


def attempt(path: str, name: str) -> str:
    """A new place for a table under ``path``; no two attempts share one."""
    return f"{path}/data/{name}/attempt-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, entries: Mapping[str, str], *, run_id: str, keep: bool = False) -> int:
    """Make the named places the current ones and return the commit's number. With ``keep``, names not given stay as they are."""
    number = last_commit(spark, path) + 1
    held = dict(_entries(spark, path, number - 1)) if keep and number > 1 else {}
    held.update({name: (location, run_id) for name, location in entries.items()})
    rows = [(name, location, run) for name, (location, run) in sorted(held.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/commit={number}")
    return number


def last_commit(spark: SparkSession, path: str) -> int:
    """Number of the newest commit; 0 if there is none."""
    try:
        manifests = spark.read.schema(f"{MANIFEST}, commit int").parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return manifests.agg(F.coalesce(F.max("commit"), F.lit(0)).alias("n")).collect()[0]["n"]


def _entries(spark: SparkSession, path: str, number: int) -> dict[str, tuple[str, str]]:
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/commits/commit={number}").collect()
    return {r["name"]: (r["location"], r["run_id"]) for r in rows}


def current(spark: SparkSession, path: str, number: int | None = None) -> dict[str, str]:
    """Name -> place in a commit, by default the newest."""
    number = last_commit(spark, path) if number is None else number
    return {name: location for name, (location, _) in _entries(spark, path, number).items()} if number else {}


def commit_of_run(spark: SparkSession, path: str, run_id: str) -> int:
    """Number of the newest commit of a run; 0 if the run published nothing."""
    if not last_commit(spark, path):
        return 0
    manifests = spark.read.schema(f"{MANIFEST}, commit int").parquet(f"{path}/commits")
    return manifests.filter(F.col("run_id") == run_id).agg(F.coalesce(F.max("commit"), F.lit(0)).alias("n")).collect()[0]["n"]


def table(spark: SparkSession, path: str, name: str, number: int | None = None) -> DataFrame:
    """A published table as of a commit, by default the newest."""
    found = current(spark, path, number)
    if name not in found:
        raise KeyError(f"{path} has no published {name}")
    return spark.read.parquet(found[name])
