"""What a change touches, and which findings it does not."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.operators.joins import left_join_known
from attestra.operators.sequence import SCOPE


def affected_items(
    changed: DataFrame, claim: DataFrame, file_ref: DataFrame, task_link: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Changed files -> claims -> tasks -> requirements and criteria: scope, item_type, item_id.

    Each hop is a semi-join that keeps one row per item, so no hop multiplies rows.
    ``task_link``: scope, task_id, item_type (``requirement`` or ``ac``), item_id.
    """
    files = changed.select(*scope, "path").distinct()
    claims = (
        file_ref.select(*scope, "claim_id", tx.without_fragment(F.col("ref")).alias("path"))
        .join(files, [*scope, "path"], "left_semi")
        .select(*scope, "claim_id")
        .distinct()
    )
    tasks = (
        claim.select(*scope, "claim_id", F.col("related_task").alias("task_id"))
        .join(claims, [*scope, "claim_id"], "left_semi")
        .select(*scope, "task_id")
        .filter(F.col("task_id").isNotNull())
        .distinct()
    )
    linked = (
        task_link.select(*scope, "task_id", "item_type", F.col("item_id").cast("string").alias("item_id"))
        .join(tasks, [*scope, "task_id"], "left_semi")
        .select(*scope, "item_type", "item_id")
        .distinct()
    )

    def as_items(rows: DataFrame, kind: str, key: str) -> DataFrame:
        return rows.select(*scope, F.lit(kind).alias("item_type"), F.col(key).cast("string").alias("item_id"))

    return reduce(
        DataFrame.unionByName, [as_items(claims, "claim", "claim_id"), as_items(tasks, "task", "task_id"), linked]
    )


def _with_membership(rows: DataFrame, members: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """``flag``: whether ``members`` has the row's key; the last column of ``on`` may be null."""
    marked = members.select(*on).distinct().withColumn(flag, F.lit(True))
    return left_join_known(rows, marked, on, on[-1]).withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_change_mode(rows: DataFrame, changed: DataFrame, name: str, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """``name``: whether the row's project has changed files; without any, everything is analysed."""
    if not scope:
        return rows.withColumn(name, changed.agg((F.count(F.lit(1)) > 0).alias("any")).scalar())
    return _with_membership(rows, changed, scope, name)


def mark_stale_gaps(
    gap: DataFrame, affected: DataFrame, changed: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Gaps of claims, requirements and criteria the change does not touch are ``stale``."""
    rows = _with_membership(gap.drop("stale"), affected, [*scope, "item_type", "item_id"], "_hit")
    tracked = F.col("item_type").isin("claim", "requirement", "ac")
    return (
        with_change_mode(rows, changed, "_changes", scope=scope)
        .withColumn("stale", F.col("_changes") & tracked & ~F.col("_hit"))
        .drop("_hit", "_changes")
    )


def mark_stale_risks(
    risk: DataFrame, affected: DataFrame, changed: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Risks of claims the change does not touch are ``stale``; risks without a claim never are."""
    claims = affected.filter(F.col("item_type") == "claim").select(*scope, F.col("item_id").alias("claim_id"))
    rows = _with_membership(risk.drop("stale"), claims, [*scope, "claim_id"], "_hit")
    return (
        with_change_mode(rows, changed, "_changes", scope=scope)
        .withColumn("stale", F.col("_changes") & F.col("claim_id").isNotNull() & ~F.col("_hit"))
        .drop("_hit", "_changes")
    )


def stale_counts(rows: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    return rows.groupBy(*scope).agg(
        F.count_if(F.coalesce("stale", F.lit(False))).alias("n_stale"), F.count(F.lit(1)).alias("n_total")
    )


def active(rows: DataFrame) -> DataFrame:
    """Stale rows stay in the report but leave the gate."""
    return rows.filter(~F.coalesce("stale", F.lit(False)))


def tag_current(
    rows: DataFrame, affected: DataFrame | None, related: Sequence[str], *, changed: DataFrame | None = None,
    scope: Sequence[str] = SCOPE, name: str = "change_scope",
) -> DataFrame:
    """``all`` (no changed set), ``current`` (some related id was touched) or ``pre_existing``.

    ``affected``: scope, item_id, or None when no project has a changed set. ``changed`` names the
    projects that have one; without it all have. A row whose related ids are all null is pre-existing.
    """
    if affected is None:
        return rows.withColumn(name, F.lit("all"))
    ids = affected.select(*scope, "item_id").distinct()
    out, flags = rows, []
    for i, column in enumerate(related):
        flag = f"_hit{i}"
        keyed = ids.withColumnRenamed("item_id", column)
        out = _with_membership(out, keyed, [*scope, column], flag)
        flags.append(flag)
    hit: Column = reduce(lambda a, b: a | b, [F.col(f) for f in flags], F.lit(False))
    tag = F.when(hit, "current").otherwise("pre_existing")
    if changed is not None:
        out = with_change_mode(out, changed, "_changes", scope=scope)
        tag = F.when(F.col("_changes"), tag).otherwise("all")
    return out.withColumn(name, tag).drop(*flags, "_changes")
