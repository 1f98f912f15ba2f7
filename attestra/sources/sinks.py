"""Outputs: evidence index, report tables, run metadata, claim archive, stored configuration."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.text import iso_timestamp
from attestra.operators.constraints import check_rows, evidence_checks
from attestra.operators.sequence import SCOPE
from attestra.session import cut_lineage
from attestra.sources import commits


class InvalidIndex(ValueError):
    """The evidence to be written breaks the index contract."""


def run_header(project: DataFrame, *, run_id: str, scan_time: Column, scope: Sequence[str] = SCOPE) -> DataFrame:
    return project.select(*scope, F.lit(run_id).alias("run_id"), iso_timestamp(scan_time).alias("scan_time"))


def write_evidence_index(evidence: DataFrame, path: str, *, run_id: str, prefix: str) -> None:
    """Validate, then write the index partitioned by project and run.

    The evidence is materialised, as it is read twice. Only whether a violation exists reaches the driver.
    """
    evidence = cut_lineage(evidence)
    broken = check_rows(evidence, evidence_checks(prefix), table="evidences", key="evidence_id")
    first = broken.limit(1).collect()
    if first:
        raise InvalidIndex(f"{first[0]['field_path']}: {first[0]['hint']}")
    write_section(evidence.withColumn("run_id", F.lit(run_id)), path)


def write_section(rows: DataFrame, path: str, *, by: Sequence[str] = ("project_id", "run_id")) -> None:
    """One report table, partitioned by project and run; partitions of other projects and runs are kept.

    Rows are rebalanced on the partition columns: a small project is one file, a large one is split.
    """
    (
        rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    )


REPORT_SECTIONS = (
    "gate", "reasons", "requirement_coverage", "gaps", "risks", "rule_status", "violations", "unclear_rules",
    "accepted_rules", "coverage_summary",
)


def write_report(sections: Mapping[str, DataFrame], path: str, *, run_id: str) -> int:
    """The report: one table per section, all rows of all projects, published together; returns the commit's number.

    Every attempt of a run has partitions of its own. One that is stopped before its last section has been written has published
    nothing, and ``read_report`` goes on showing the run before it.
    """
    attempt, names, spark = uuid.uuid4().hex, [n for n in REPORT_SECTIONS if n in sections], None
    for name in names:
        rows = sections[name].withColumn("run_id", F.lit(run_id)).withColumn("attempt", F.lit(attempt))
        write_section(rows, f"{path}/{name}", by=("project_id", "run_id", "attempt"))
        spark = rows.sparkSession
    return commits.publish(spark, path, dict.fromkeys(names, attempt), run_id=run_id) if names else 0


def read_report(spark: SparkSession, path: str, name: str, *, run_id: str | None = None) -> DataFrame:
    """A section as last published, or as last published by a run."""
    number = None if run_id is None else commits.commit_of_run(spark, path, run_id)
    found = commits.current(spark, path, number)
    if name not in found:
        raise KeyError(f"{path} has no published {name}" + (f" of {run_id}" if run_id else ""))
    return spark.read.parquet(f"{path}/{name}").filter(F.col("attempt") == found[name]).drop("attempt")


#: About so many rows of a section go into one part of a report document.
PART_ROWS = 1_000


def report_documents(sections: Mapping[str, DataFrame], *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Sections as JSON lists in numbered parts: scope, section, part, n_parts, document.

    Every row is in exactly one part, so the parts of a section together are the section, and no task
    holds a section that is large. Rows fall into parts by their hash, and equal rows are dealt one by one; inside a part they are
    in order.
    """
    keys, out = list(scope), None
    for name, rows in sections.items():
        fields = [c for c in rows.columns if c not in keys]
        order = [c for c in ("ord", "seq") if c in fields]
        n_parts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("n_parts"))
        entry = F.struct(*order, *[c for c in fields if c not in order]).alias("_entry")
        # Equal rows are counted, and their copies dealt out from the part their hash names.
        dealt = rows.groupBy(*keys, *fields).agg(F.count(F.lit(1)).alias("_copies")) if fields else rows.withColumn("_copies", F.lit(1))
        copies = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        parts = (
            copies.select(*keys, (F.xxhash64(F.to_json(F.struct(*fields))).bitwiseAND(F.lit((1 << 62) - 1)) + F.col("_copy")).alias("_hash"), entry)
            .join(n_parts, keys)
            .groupBy(*keys, "n_parts", F.pmod("_hash", "n_parts").cast("int").alias("part"))
            .agg(F.to_json(F.array_sort(F.collect_list("_entry"))).alias("document"))
            .select(*keys, F.lit(name).alias("section"), "part", "n_parts", "document")
        )
        out = parts if out is None else out.unionByName(parts)
    return out


def run_metadata(
    gate: DataFrame, reasons: DataFrame, manifest: DataFrame, *, run_id: str, scan_time: Column, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """One row per run: inputs, decision, exit code and the number of reasons; see ``run_reasons``.

    ``input_files`` is a map, as there are only as many input files as file keys in the configuration.
    """
    keys = list(scope)
    counts = reasons.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reasons"))
    inputs = manifest.filter(F.col("status") == "ok").groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("file_key", "path")))).alias("input_files")
    )
    return (
        gate.select(*keys, "gate_decision")
        .join(counts, keys, "left").join(inputs, keys, "left")
        .select(
            *keys, F.lit(run_id).alias("run_id"), iso_timestamp(scan_time).alias("scan_time"), "gate_decision",
            F.when(F.col("gate_decision") == "blocked", 2).otherwise(0).alias("exit_code"),
            F.coalesce("n_reasons", F.lit(0)).alias("n_reasons"), "input_files",
        )
    )


def run_reasons(reasons: DataFrame, *, run_id: str, scope: Sequence[str] = SCOPE) -> DataFrame:
    """The reasons of a run, all of them, in order: scope, run_id, seq, reason."""
    return reasons.select(*scope, F.lit(run_id).alias("run_id"), "seq", "reason")


def archived_claims(claim: DataFrame, commit: DataFrame, *, as_of: Column, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Current claims of the projects in ``commit`` under their commit name.

    ``commit``: scope, commit_id; a null id gives a time stamp name.
    """
    name = F.concat(F.lit("commit-"), F.coalesce("commit_id", F.date_format(as_of, "yyyyMMddHHmmss")))
    return claim.join(commit, list(scope)).withColumn("commit_id", name)


def remaining_claims(claim: DataFrame, commit: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Claims of the projects that were not archived; the archived projects have none left."""
    return claim.join(commit.select(*scope).distinct(), list(scope), "left_anti")


def archive_claims(
    claim: DataFrame, commit: DataFrame, archive_path: str, next_path: str, *, as_of: Column,
    scope: Sequence[str] = SCOPE,
) -> None:
    """Write the archive, then the emptied ledger as a new version at ``next_path``.

    The ledger that is being read is never overwritten: a failure at any point loses nothing, and
    running again gives the same archive partitions. Rows are rebalanced on the partition columns: a small project is one
    file, a large one is split.
    """
    archived_claims(claim, commit, as_of=as_of, scope=scope).hint("rebalance", *scope, "commit_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*scope, "commit_id").parquet(archive_path)
    left = remaining_claims(claim, commit, scope=scope).hint("rebalance", *scope)
    left.write.mode("overwrite").partitionBy(*scope).parquet(next_path)


def upsert(stored: DataFrame, changed: DataFrame, *, key: Sequence[str] = SCOPE) -> DataFrame:
    """``stored`` with the rows of ``changed`` in place of those with the same key."""
    return stored.join(changed.select(*key).distinct(), list(key), "left_anti").unionByName(
        changed, allowMissingColumns=True
    )
