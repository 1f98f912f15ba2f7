"""Coverage of requirements, criteria, tasks and files by evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import status as st
from attestra.operators.sequence import SCOPE, last_per_key
from attestra.schemas import COVERAGE_THRESHOLD
from attestra.session import dealt


def explode_covers(evidence: DataFrame) -> DataFrame:
    """Evidence rows -> one row per covered item (``item_id``); the array is dropped."""
    return evidence.withColumn("item_id", F.explode(F.array_distinct("covers"))).drop("covers")


def _rows_where(condition: Column | None, weight: str | None) -> Column:
    """How many rows hold; rows may stand for several."""
    n = F.lit(1) if weight is None else F.col(weight)
    return F.coalesce(F.sum(n if condition is None else F.when(condition, n)), F.lit(0)).cast("bigint")


def _dealt_by_item(cover: DataFrame, weight: str | None, scope: Sequence[str]) -> DataFrame:
    """Evidence is as long as its ledger; rows with a weight are few per item already."""
    return dealt(cover, *scope, "item_id") if weight is None else cover


def requirement_coverage(
    requirement: DataFrame, cover: DataFrame, *, weight: str | None = None, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Status of every requirement from the tasks that cover it.

    No task: missing. Unclear priority or an unclear task: unclear. All tasks covered: covered. Else
    partial. Evidence is reduced to one row per item before it meets the requirements.

    ``cover``: scope, item_id, source_type, status; with ``weight``, the column that tells how many rows one stands for.
    """
    tasks = (
        _dealt_by_item(cover.filter(F.col("source_type") == "task"), weight, scope)
        .groupBy(*scope, F.col("item_id").alias("req_id"))
        .agg(
            _rows_where(None, weight).alias("n_evidence"),
            _rows_where(F.col("status") == "unclear", weight).alias("_unclear"),
            _rows_where(F.col("status") == "covered", weight).alias("_covered"),
        )
    )
    n = F.coalesce("n_evidence", F.lit(0))
    status = (
        F.when(n == 0, "missing")
        .when((F.col("priority") == "unclear") | (F.col("_unclear") > 0), "unclear")
        .when(F.col("_covered") == n, "covered")
        .otherwise("partial")
    )
    return (
        requirement.join(tasks, [*scope, "req_id"], "left")
        .withColumn("status", status)
        .withColumn("n_evidence", n)
        .withColumn("is_gap", (F.col("status") == "missing") & F.coalesce(F.col("priority") == "must", F.lit(False)))
        .drop("_unclear", "_covered")
    )


def criterion_coverage(
    criterion: DataFrame, cover: DataFrame, *, weight: str | None = None, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Covered if any passing test covers the criterion, else missing; ``criterion`` carries its
    requirement's ``priority``. A gap needs a must requirement and required testing."""
    passing = (
        _dealt_by_item(cover.filter((F.col("source_type") == "test") & (F.col("status") == "covered")), weight, scope)
        .groupBy(*scope, F.col("item_id").alias("ac_id"))
        .agg(_rows_where(None, weight).alias("n_evidence"))
    )
    required = (F.col("priority") == "must") & F.col("is_testing_required")
    return (
        criterion.join(passing, [*scope, "ac_id"], "left")
        .withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
        .withColumn("status", F.when(F.col("n_evidence") > 0, "covered").otherwise("missing"))
        .withColumn("is_gap", (F.col("status") == "missing") & F.coalesce(required, F.lit(False)))
    )


def item_evidence(
    item: DataFrame, cover: DataFrame, *, key: str, source_type: str, status: str | None = None,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """The evidence behind a coverage status, one row per (item, evidence id)."""
    rows = cover.filter(F.col("source_type") == source_type)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    rows = rows.select(*scope, F.col("item_id").alias(key), "evidence_id")
    return rows.join(item.select(*scope, key).distinct(), [*scope, key], "left_semi")


def requirement_gaps(coverage: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Must requirements without a task, as gap rows."""
    return coverage.filter("is_gap").select(
        *scope,
        F.col("req_id").cast("string").alias("item_id"),
        F.lit("requirement").alias("item_type"),
        F.format_string("No task works on must requirement %s (%s).", F.col("req_id"), F.col("title")).alias(
            "reason"
        ),
        F.col("req_id").cast("string").alias("target_id"),
        F.lit("must").alias("severity"),
        "ord",
    )


def criterion_gaps(coverage: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Must criteria that need a test and have no passing one, as gap rows."""
    return coverage.filter("is_gap").select(
        *scope,
        F.col("ac_id").cast("string").alias("item_id"),
        F.lit("ac").alias("item_type"),
        F.format_string("No passing test covers must criterion %s.", F.col("ac_id")).alias(
            "reason"
        ),
        F.col("ac_id").cast("string").alias("target_id"),
        F.lit("must").alias("severity"),
        "ord",
    )


def task_claim_coverage(
    task: DataFrame, claim: DataFrame, test_ref: DataFrame, test_result: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Must tasks whose criteria are not covered through claims, with the reason.

    ``no_claim_for_task``; ``no_tests_declared`` (claims without test references, or no test result is
    known for the project at all); ``test_failed``. The reason does not depend on the criterion, so it
    is found per task; :func:`uncovered_task_criteria` spreads it over the task's criteria.

    ``test_ref``: scope, claim_id, ref. ``test_result``: scope, path, status, ord (last one counts).
    """
    result = last_per_key(test_result.select(*scope, F.col("path").alias("ref"), "status", "ord"),
                          [*scope, "ref"], ["ord", "status"])
    per_claim = (
        test_ref.select(*scope, "claim_id", "ref")
        .join(result, [*scope, "ref"], "left")
        .groupBy(*scope, "claim_id")
        .agg(F.bool_or(F.coalesce(F.col("status") == "covered", F.lit(False))).alias("_passing"))
    )
    per_task = (
        claim.select(*scope, "claim_id", F.col("related_task").alias("task_id"))
        .join(per_claim, [*scope, "claim_id"], "left")
        .groupBy(*scope, "task_id")
        .agg(
            F.bool_or(F.col("_passing").isNotNull()).alias("_has_tests"),
            F.bool_or(F.coalesce("_passing", F.lit(False))).alias("_passing"),
        )
    )
    must = task.filter(F.col("priority") == "must").join(per_task, [*scope, "task_id"], "left")
    if scope:
        known = test_result.select(*scope).distinct().withColumn("_known", F.lit(True))
        must = must.join(known, list(scope), "left")
    else:
        must = must.withColumn("_known", test_result.agg((F.count(F.lit(1)) > 0).alias("known")).scalar())
    known_results = F.coalesce("_known", F.lit(False))
    reason = (
        F.when(F.col("_has_tests").isNull(), "no_claim_for_task")
        .when(F.when(known_results, F.col("_passing")).otherwise(F.col("_has_tests")), F.lit(None))
        .when(F.col("_has_tests") & known_results, "test_failed")
        .otherwise("no_tests_declared")
    )
    return (
        must.withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .drop("_has_tests", "_passing", "_known")
    )


def uncovered_task_criteria(uncovered: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """One row per criterion of the tasks found by :func:`task_claim_coverage`."""
    return uncovered.select(
        *scope, "task_id", F.explode("related_acceptance_criteria").alias("ac_id"), "reason"
    )


def inherit_covers(row: DataFrame, task_cover: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """``row`` with the ``covers`` of its ``related_task``, empty if the task is unknown.

    ``task_cover``: scope, related_task, covers - one row per task.
    """
    return row.join(task_cover, [*scope, "related_task"], "left").withColumn(
        "covers", F.coalesce("covers", F.array().cast("array<string>"))
    )


def coverage_summary(coverage_file: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Statement-weighted coverage per project, rounded half-even to one digit.

    ``coverage_file``: scope, percent_covered, num_statements.
    """
    covered = F.sum(F.col("num_statements") * F.col("percent_covered") / 100)
    total = F.sum("num_statements")
    return coverage_file.groupBy(*scope).agg(
        F.when(total > 0, F.bround(covered / total * 100, 1)).otherwise(F.lit(0.0)).alias("aggregate_percent"),
        total.alias("total_statements"),
        # Rounded first, so the order in which doubles are added cannot move the floor.
        F.floor(F.round(covered, 6)).alias("total_covered"),
        F.count(F.lit(1)).alias("file_count"),
    )


def coverage_violations(
    coverage_file: DataFrame, *, threshold: float = COVERAGE_THRESHOLD, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Files below the threshold."""
    return coverage_file.filter(st.coverage_status(F.col("percent_covered"), threshold) == "violated").select(
        *scope, "path", "percent_covered"
    )
