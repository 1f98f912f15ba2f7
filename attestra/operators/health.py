"""Health checks over a project's tables: five checks, one issue row each, and the report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.operators.sequence import SCOPE
from attestra.schemas import RULE_SECTIONS


def _issue(rows: DataFrame, check: str, item: str, target: str, scope: Sequence[str]) -> DataFrame:
    return rows.select(
        *scope, F.lit(check).alias("check"), F.col(item).cast("string").alias("item_id"),
        F.col(target).cast("string").alias("target"),
    )


def evidence_ref_issues(
    evidence_ref: DataFrame, evidence: DataFrame, file_snapshot: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Evidence references that are neither an evidence id nor an existing file."""
    known = (
        evidence.select(*scope, F.col("evidence_id").alias("ref"))
        .unionByName(file_snapshot.select(*scope, F.col("path").alias("ref")))
        .distinct()
    )
    lost = evidence_ref.join(known, [*scope, "ref"], "left_anti")
    return _issue(lost, "evidence_refs_integrity", "claim_id", "ref", scope)


def file_ref_issues(file_ref: DataFrame, file_snapshot: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Code and test references to files that do not exist."""
    present = file_snapshot.select(*scope, "path").distinct()
    lost = (
        file_ref.withColumn("path", tx.without_fragment(F.col("ref")))
        .filter(F.col("path") != "")
        .join(present, [*scope, "path"], "left_anti")
    )
    return _issue(lost, "file_refs_integrity", "claim_id", "ref", scope)


def link_issues(link: DataFrame, parent: DataFrame, *, check: str, ref: str, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Task links (scope, task_id, ``ref``) without a parent row of the same ``ref``."""
    lost = link.join(parent.select(*scope, ref).distinct(), [*scope, ref], "left_anti")
    return _issue(lost, check, "task_id", ref, scope)


def unchecked_rule_issues(rule: DataFrame, module_boundary: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Machine-verified rules without checker, command, or a relation to a known module."""
    machine = rule.filter(
        (F.col("verification_method") == "machine")
        & F.col("section").isin(*RULE_SECTIONS, "module_boundaries")
        & (F.coalesce("checker", F.lit("")) == "")
        & (F.coalesce("verification_command", F.lit("")) == "")
    )
    supported = (
        machine.select(*scope, "rule_id", F.explode("related_modules").alias("module_id"))
        .join(module_boundary.select(*scope, "module_id").distinct(), [*scope, "module_id"], "left_semi")
        .select(*scope, "rule_id")
        .distinct()
    )
    return _issue(
        machine.join(supported, [*scope, "rule_id"], "left_anti"), "machine_rule_coverage", "rule_id", "section", scope
    )


def health_report(issues: Sequence[DataFrame], *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Issues per check and, in the rows without a check, per project."""
    rows = reduce(DataFrame.unionByName, issues)
    sets = [[*scope, "check"], list(scope)]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *scope, "check").agg(
        F.count(F.lit(1)).alias("n_issues")
    )
