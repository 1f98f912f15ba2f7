"""Claims checked against independent evidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.functions.ids import as_column
from attestra.functions.status import is_ok
from attestra.operators.sequence import SCOPE, last_per_key

# Finding category -> (severity, effect on the verdict, message). Categories, severities and effects are fixed values.
FINDINGS = {
    "self_referential_claim": (
        "must", "self", "Claim {claim} is done on self-referential evidence alone."),
    "conflicting_statuses": (
        "should", "none", "Evidence {ref} of claim {claim} disagrees with itself: {detail}."),
    "violated_evidence": (
        "must", "failed", "Evidence {ref} of claim {claim} is '{detail}'."),
    "unclear_evidence_status": (
        "must", "other", "Evidence {ref} of claim {claim} is '{detail}'."),
    "non_existent_evidence": (
        "must", "other", "Evidence {ref} of claim {claim} cannot be found."),
    "task_not_completed": (
        "must", "other",
        "Claim {claim} is done while its task {ref} is still '{detail}'."),
    "no_test_coverage": (
        "must", "other", "Claim {claim} is done, yet no test covers criterion {ref}."),
    "failed_tests": (
        "must", "failed", "Claim {claim} is done, yet tests of criterion {ref} fail."),
    "test_covers_mismatch": (
        "must", "other", "The tests that claim {claim} cites do not cover criterion {ref}."),
    "non_existent_task": (
        "must", "other", "Task {ref} of claim {claim} cannot be found."),
}


def explode_refs(claim: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Reference arrays of claims -> link rows: scope, claim_id, kind, ref, pos."""

    def of(kind: str) -> DataFrame:
        return claim.select(
            *scope, "claim_id", F.lit(kind).alias("kind"), F.posexplode(f"{kind}_refs").alias("pos", "ref")
        )

    return reduce(DataFrame.unionByName, [of("evidence"), of("code"), of("test")])


def reference_keys(evidence: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """One row per text a claim may cite: evidence id, source path, or node id of a test.

    All evidence a key stands for is reduced to its distinct statuses (a closed list), the number of
    supporting rows, and the last status that is neither ok nor violated.
    """
    keys = F.array_distinct(
        F.array_compact(
            F.array(
                F.col("evidence_id"),
                F.when(F.col("source_path") != "", F.col("source_path")),
                F.when((F.col("source_type") == "test") & (F.col("nodeid") != ""), F.col("nodeid")),
            )
        )
    )
    other = ~is_ok(F.col("status")) & ~F.coalesce(F.col("status") == "violated", F.lit(False))
    return (
        evidence.select(*scope, F.explode(keys).alias("ref"), "status", "ord")
        .groupBy(*scope, "ref")
        .agg(
            F.collect_set("status").alias("_statuses"),
            F.count_if(is_ok(F.col("status"))).alias("n_supporting"),
            F.bool_or(F.col("status") == "violated").alias("_violated"),
            F.max_by(F.when(other, F.col("status")), F.when(other, F.col("ord"))).alias("_other"),
        )
    )


def _finding(
    rows: DataFrame, scope: Sequence[str], category: str | Column, step: int, *, ref: Column | None = None,
    detail: Column | None = None, pos: Column | None = None, occurrences: Column | None = None,
) -> DataFrame:
    def given(column: Column | None, default) -> Column:
        return F.lit(default) if column is None else column

    return rows.select(
        *scope, "claim_id", "ord",
        given(None, category).alias("category") if isinstance(category, str) else category.alias("category"),
        given(ref, None).cast("string").alias("ref"), given(detail, None).cast("string").alias("detail"),
        F.lit(step).alias("step"), F.coalesce(given(pos, 0), F.lit(0)).cast("bigint").alias("pos"),
        given(occurrences, 1).cast("bigint").alias("occurrences"),
    )


def completed_claims(claim: DataFrame) -> DataFrame:
    """Only claims that claim completion are checked; all others pass through unchecked."""
    return claim.filter(is_ok(F.col("claimed_status")))


def reference_findings(
    claim: DataFrame, evidence_ref: DataFrame, evidence: DataFrame, *, evidence_scope: Sequence[str] | None = None,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """What is wrong with the evidence a completed claim cites (itself excluded).

    ``evidence_ref``: scope, claim_id, ref, pos. ``evidence_scope`` are the scope columns the evidence has, if it has fewer:
    evidence that several projects share.
    """
    shared = scope if evidence_scope is None else evidence_scope
    claims = completed_claims(claim).select(*scope, "claim_id", "ord")
    external = evidence_ref.filter(F.col("ref") != F.col("claim_id")).select(*scope, "claim_id", "ref", "pos")
    # The references stream on the left of both joins, so a hot claim and a hot path can both be split.
    alone = claims.join(external.select(*scope, "claim_id").distinct(), [*scope, "claim_id"], "left_anti")
    seen = external.join(claims, [*scope, "claim_id"]).join(
        reference_keys(evidence, scope=shared), [*shared, "ref"], "left"
    )

    def found(category: str, detail: Column | None = None) -> Column:
        text = F.lit(None).cast("string") if detail is None else detail
        return F.struct(F.lit(category).alias("category"), text.alias("detail"))

    statuses = F.array_join(F.array_sort("_statuses"), ", ")
    conflict = F.when(F.size("_statuses") > 1, found("conflicting_statuses", statuses))
    worst = (
        F.when(F.col("_statuses").isNull(), found("non_existent_evidence"))
        .when(F.col("_violated"), found("violated_evidence", F.lit("violated")))
        .when(F.col("_other").isNotNull(), found("unclear_evidence_status", F.col("_other")))
    )
    rows = seen.withColumn("_f", F.explode(F.array_compact(F.array(conflict, worst))))
    return _finding(alone, scope, "self_referential_claim", 1).unionByName(
        _finding(rows, scope, F.col("_f.category"), 1, ref=F.col("ref"), detail=F.col("_f.detail"), pos=F.col("pos"))
    )


def task_findings(
    claim: DataFrame, test_ref: DataFrame, evidence: DataFrame, cover: DataFrame, *,
    ac_prefix: str | Column = "AC-", scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """What is wrong with the task of a completed claim and the tests of the task's criteria.

    Tests are reduced to one row per criterion and one per (criterion, file) first, so a claim only
    ever expands by its task's own criteria and its own test references. ``occurrences`` counts the
    failing tests behind a ``failed_tests`` row.

    ``cover``: scope, item_id, evidence_id, source_type, source_path, status.
    """
    claims = completed_claims(claim).select(*scope, "claim_id", "related_task", "ord")
    task = last_per_key(
        evidence.filter((F.col("source_type") == "task") & F.col("task_id").isNotNull()).select(
            *scope, F.col("task_id").alias("related_task"), "evidence_id", F.col("status").alias("_task_status"),
            F.col("ord").alias("_task_ord"),
        ),
        [*scope, "related_task"], ["_task_ord", "evidence_id"],
    )
    open_task = claims.join(task, [*scope, "related_task"], "left").withColumn(
        "_category",
        F.when(F.col("evidence_id").isNull(), "non_existent_task").when(
            ~F.col("_task_status").eqNullSafe("covered"), "task_not_completed"
        ),
    ).filter(F.col("_category").isNotNull())

    # Criteria of each task, with what their tests say.
    test_cover = cover.filter(F.col("source_type") == "test")
    tests = test_cover.groupBy(*scope, F.col("item_id").alias("ac_id")).agg(
        F.count(F.lit(1)).alias("_n_tests"),
        F.count_if(~F.col("status").eqNullSafe("covered")).alias("_n_failed"),
    )
    task_ac = (
        cover.filter(
            (F.col("source_type") == "task") & F.startswith(F.col("item_id").cast("string"), as_column(ac_prefix))
        )
        .select(*scope, "evidence_id", F.col("item_id").alias("ac_id"))
        .join(task.select(*scope, "related_task", "evidence_id"), [*scope, "evidence_id"])
        .join(tests, [*scope, "ac_id"], "left")
        .select(*scope, "related_task", "ac_id", "_n_tests", "_n_failed")
    )
    unproven = claims.join(
        task_ac.filter(F.col("_n_tests").isNull() | (F.col("_n_failed") > 0)), [*scope, "related_task"]
    ).withColumn("_category", F.when(F.col("_n_tests").isNull(), "no_test_coverage").otherwise("failed_tests"))

    # Criteria with tests, none of which the claim names although it names tests.
    # A reference given twice counts twice here, which does not change whether the count is zero.
    named = test_ref.select(*scope, "claim_id", tx.file_of(F.col("ref")).alias("path"))
    covering = test_cover.select(
        *scope, F.col("item_id").alias("ac_id"), tx.file_of(F.col("source_path")).alias("path"), F.lit(True).alias("_hit")
    ).distinct()
    missed = (
        claims.join(task_ac.filter(F.col("_n_tests") > 0).select(*scope, "related_task", "ac_id"), [*scope, "related_task"])
        .join(named, [*scope, "claim_id"])
        .join(covering, [*scope, "ac_id", "path"], "left")
        .groupBy(*scope, "claim_id", "ac_id", "ord")
        .agg(F.count("_hit").alias("_named"))
        .filter(F.col("_named") == 0)
    )

    return reduce(
        DataFrame.unionByName,
        [
            _finding(open_task, scope, F.col("_category"), 2, ref=F.col("related_task"), detail=F.col("_task_status")),
            _finding(unproven, scope, F.col("_category"), 3, ref=F.col("ac_id"), occurrences=F.coalesce("_n_failed", F.lit(1))),
            _finding(missed, scope, "test_covers_mismatch", 4, ref=F.col("ac_id")),
        ],
    )


def claim_findings(
    claim: DataFrame, evidence_ref: DataFrame, test_ref: DataFrame, evidence: DataFrame, cover: DataFrame, *,
    ac_prefix: str | Column = "AC-", scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """All findings on completed claims: scope, claim_id, ord, category, ref, detail, step, pos, occurrences."""
    return reference_findings(claim, evidence_ref, evidence, scope=scope).unionByName(
        task_findings(claim, test_ref, evidence, cover, ac_prefix=ac_prefix, scope=scope)
    )


def _by_category(position: int) -> Column:
    out = None
    for category, entry in FINDINGS.items():
        hit = F.col("category") == category
        out = F.when(hit, entry[position]) if out is None else out.when(hit, entry[position])
    return out


def claim_verdict(claim: DataFrame, findings: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Final status per claim: violated, else blocked (self-referential), else low_confidence, else as claimed."""
    effect = _by_category(1)
    per_claim = findings.groupBy(*scope, "claim_id").agg(
        F.bool_or(effect == "failed").alias("_failed"),
        F.bool_or(effect == "self").alias("_self"),
        F.bool_or(effect == "other").alias("_other"),
        F.sum("occurrences").alias("n_mismatches"),
    )
    status = (
        F.when(F.col("_failed"), "violated")
        .when(F.col("_self"), "blocked")
        .when(F.col("_other"), "low_confidence")
        .otherwise(F.col("claimed_status"))
    )
    return (
        claim.join(per_claim, [*scope, "claim_id"], "left")
        .withColumn("status", status)
        .withColumn("n_mismatches", F.coalesce("n_mismatches", F.lit(0)))
        .drop("_failed", "_self", "_other")
    )


def claim_gaps(findings: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Completed claims without external evidence, as gap rows."""
    return findings.filter(F.col("category") == "self_referential_claim").select(
        *scope,
        F.col("claim_id").cast("string").alias("item_id"),
        F.lit("claim").alias("item_type"),
        _message().alias("reason"),
        F.col("claim_id").cast("string").alias("target_id"),
        F.lit("must").alias("severity"),
        "ord",
    )


def _message() -> Column:
    return tx.fill(_by_category(2), claim=F.col("claim_id"), ref=F.col("ref"), detail=F.col("detail"))


def claim_risks(findings: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Findings as risk rows, not yet numbered (``ord``, ``step``, ``pos``, ``ref`` keep their order)."""
    return findings.select(
        *scope,
        F.col("claim_id").cast("string").alias("claim_id"),
        _message().alias("description"),
        _by_category(0).alias("severity"),
        F.col("category").alias("risk_category"),
        F.col("claim_id").cast("string").alias("target_id"),
        "occurrences", "ord", "step", "pos", "ref",
    )


def supporting_keys(
    claim: DataFrame, evidence_ref: DataFrame, evidence: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """References of completed claims that some ok evidence supports, with how many rows do.

    The ids behind a reference are the rows of :func:`reference_evidence` for it. The two are kept
    apart because a path many claims cite and many evidence rows share would multiply.
    """
    keys = reference_keys(evidence, scope=scope).filter(F.col("n_supporting") > 0)
    return (
        evidence_ref.filter(F.col("ref") != F.col("claim_id")).select(*scope, "claim_id", "ref").distinct()
        .join(completed_claims(claim).select(*scope, "claim_id"), [*scope, "claim_id"], "left_semi")
        .join(keys.select(*scope, "ref", "n_supporting"), [*scope, "ref"])
    )


def reference_evidence(evidence: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Ok evidence ids behind every key a claim may cite."""
    keys = F.array_distinct(
        F.array_compact(F.array("evidence_id", "source_path", F.when(F.col("source_type") == "test", F.col("nodeid"))))
    )
    return evidence.filter(is_ok(F.col("status"))).select(*scope, F.explode(keys).alias("ref"), "evidence_id")


def reference_invalidation(
    file_ref: DataFrame, file_snapshot: DataFrame, recorded: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Code and test references whose file is gone, was never hashed, or has another hash now.

    ``file_snapshot``: scope, path, sha256 (one per path). ``recorded``: scope, source_path, file_hash,
    ord; the last recorded hash of a file counts.
    """
    known = last_per_key(
        recorded.filter(F.col("file_hash").isNotNull() & (F.col("source_path") != "")).select(
            *scope, tx.file_of(F.col("source_path")).alias("path"), "file_hash", "ord"
        ),
        [*scope, "path"], ["ord", "file_hash"],
    ).select(*scope, "path", F.col("file_hash").alias("old_hash"))
    now = file_snapshot.select(*scope, "path", F.col("sha256").alias("new_hash"))
    state = now.join(known, [*scope, "path"], "left")
    change = (
        F.when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash").isNull(), "no_record")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
    )
    return (
        file_ref.withColumn("path", tx.file_of(F.col("ref")))
        .join(state, [*scope, "path"], "left")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
    )


def claims_to_reverify(invalid: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """One row per claim with an invalid reference."""
    return invalid.groupBy(*scope, "claim_id").agg(
        F.lit("needs_reverification").alias("status"),
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("change") == "deleted").alias("n_deleted"),
        F.count_if(F.col("change") == "no_record").alias("n_no_record"),
        F.count_if(F.col("change") == "changed").alias("n_changed"),
    )
