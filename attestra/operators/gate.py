"""The merge decision: findings with an effect, one decision per project, ordered reasons.

A finding is a row with an ``effect`` (``block``, ``fail`` or ``note``). Decisions aggregate effects;
texts are only built for the reasons.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import fill
from attestra.operators.findings import decisions_applied, is_self_referential, lookup, with_decision_flag
from attestra.operators.impact import tag_current, with_change_mode
from attestra.operators.sequence import SCOPE, number_by_range
from attestra.session import cut_lineage

# Finding code -> (position in the report, text).
REASONS = {
    "missing_claim": (1, "Changed file {item} is named by no claim."),
    "ac_not_covered": (2, "Must criterion {item} is not covered by tests: {detail}"),
    "ac_missing_evidence": (3, "Acceptance criterion without test evidence ({item}): {detail}"),
    "high_risk": (4, "High or self-referential risk ({item}): {detail}"),
    "high_risk_missing_action": (5, "High risk ({item}) has no suggested action or business impact"),
    "must_rule_violation": (6, "Must rule violated ({item}): {detail}"),
    "rule_status_violated": (7, "Must rule has status violated ({item})"),
    "unclear_rule": (8, "Unclear rule ({item}): {detail}"),
    "rule_status_unclear": (9, "Rule has status unclear ({item})"),
    "non_blocking_gap": (10, "Non-blocking gap ({item}): {detail}"),
    "low_risk": (11, "Low, medium or speculative risk ({item}): {detail}"),
    "coverage_violation": (12, "Coverage below threshold: {item} ({detail}%)"),
}
ALL_PASSED = "All gates passed; nothing blocks and no risk is open."
DRAFT = "The project is a draft; blocking gates are not applied."
ALWAYS_BLOCKING = ("missing_claim", "ac_not_covered")


def _rows(rows: DataFrame, scope, code: str | Column, item: str, detail: Column, effect: Column, resolved: Column) -> DataFrame:
    return rows.select(
        *scope, (F.lit(code) if isinstance(code, str) else code).alias("code"),
        F.col(item).cast("string").alias("item_id"), detail.cast("string").alias("detail"),
        effect.alias("effect"), resolved.alias("human_resolved"), "change_scope", F.col("ord").cast("bigint").alias("ord"),
    )


def _open(effect: str, resolved: Column) -> Column:
    """The effect where the finding concerns the change (or no change is given) and nobody resolved it."""
    return F.when(resolved | (F.col("change_scope") == "pre_existing"), "note").otherwise(effect)


def gap_findings(
    gap: DataFrame, decision: DataFrame, affected: DataFrame | None = None, changed: DataFrame | None = None, *,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Criterion gaps block, other gaps fail. Files without claim and criteria uncovered through
    claims block whatever the change. Completed gaps are noted."""
    rows = with_decision_flag(gap, decision, action="mark_complete", flag="_done", scope=scope)
    rows = tag_current(rows, affected, ["item_id"], changed=changed, scope=scope)
    always = F.col("item_type").isin(*ALWAYS_BLOCKING)
    code = (
        F.when(always, F.col("item_type"))
        .when(F.col("item_type") == "ac", "ac_missing_evidence")
        .otherwise("non_blocking_gap")
    )
    effect = (
        F.when(always, "block")
        .when(F.col("item_type") == "ac", _open("block", F.col("_done")))
        .otherwise(_open("fail", F.col("_done")))
    )
    return _rows(rows, scope, code, "item_id", F.col("reason"), effect, F.col("_done"))


def risk_findings(
    risk: DataFrame, decision: DataFrame, direct: DataFrame | None = None, changed: DataFrame | None = None, *,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Must and self-referential risks block, should, could and speculative ones fail.

    ``direct``: items whose own definition changed; risks are judged by these, not by what a change
    reaches. A must risk of low confidence both blocks and fails. Accepted risks are noted.
    """
    rows = with_decision_flag(risk, decision, action="accept_risk", flag="_accepted", scope=scope)
    rows = tag_current(rows, direct, ["risk_id", "claim_id"], changed=changed, scope=scope)
    accepted = F.col("_accepted")

    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in risk.columns else F.lit("")

    must = F.coalesce(F.col("severity") == "must", F.lit(False)) & ~accepted
    high = must | is_self_referential(risk) | accepted
    blocks = high & ~accepted & (F.col("change_scope") != "pre_existing")
    unadvised = blocks & must & ((given("suggested_action") == "") | (given("business_impact") == ""))
    low = (
        F.coalesce(F.col("severity").isin("should", "could"), F.lit(False))
        | (given("confidence") == "low_confidence")
        | (given("type") == "suggestion")
    )
    fields = "struct<code: string, effect: string>"
    found = F.array_compact(
        F.array(
            F.when(high, F.struct(F.lit("high_risk"), _open("block", accepted)).cast(fields)),
            F.when(unadvised, F.struct(F.lit("high_risk_missing_action"), F.lit("block")).cast(fields)),
            F.when(low, F.struct(F.lit("low_risk"), _open("fail", accepted)).cast(fields)),
        )
    )
    return _rows(
        rows.withColumn("_f", F.explode(found)), scope, F.col("_f.code"), "risk_id", F.col("description"),
        F.col("_f.effect"), accepted,
    )


def _whole_project(rows: DataFrame, changed: DataFrame | None, scope: Sequence[str]) -> DataFrame:
    """Rule findings relate to no item: ``all`` without a changed set, else ``pre_existing``."""
    if changed is None:
        return rows.withColumn("change_scope", F.lit("all"))
    return with_change_mode(rows, changed, "_changes", scope=scope).withColumn(
        "change_scope", F.when(F.col("_changes"), "pre_existing").otherwise("all")
    ).drop("_changes")


def rule_findings(
    violation: DataFrame, unclear: DataFrame, rule_status: DataFrame, changed: DataFrame | None = None, *,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Violated must rules block and unclear rules fail, both only where no changed set is given."""
    no = F.lit(False)
    v = _whole_project(violation, changed, scope)
    u = _whole_project(unclear, changed, scope)
    s = _whole_project(rule_status, changed, scope)
    named = violation.select(*scope, "rule_id").distinct()
    bare = s.filter((F.col("status") == "violated") & (F.col("severity") == "must")).join(
        named, [*scope, "rule_id"], "left_anti"
    )
    return reduce(
        DataFrame.unionByName,
        [
            _rows(v, scope, "must_rule_violation", "rule_id", F.col("message"), _open("block", no), no),
            _rows(bare, scope, "rule_status_violated", "rule_id", F.lit(None), _open("block", no), no),
            _rows(u, scope, "unclear_rule", "rule_id", F.col("reason"), _open("fail", no), no),
            _rows(s.filter(F.col("status") == "unclear"), scope, "rule_status_unclear", "rule_id", F.lit(None),
                  _open("fail", no), no),
        ],
    )


def coverage_findings(violation: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Files below the coverage threshold always block; ``violation``: scope, path, percent_covered, ord."""
    rows = violation.withColumn("change_scope", F.lit("current"))
    return _rows(rows, scope, "coverage_violation", "path", F.col("percent_covered"), F.lit("block"), F.lit(False))


def gate_result(
    project: DataFrame, findings: DataFrame, decision: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """One decision per project. ``project``: scope, status; drafts are approved unchecked."""
    totals = findings.groupBy(*scope).agg(
        F.count_if(F.col("effect") == "block").alias("n_blocking"),
        F.count_if(F.col("effect") == "fail").alias("n_failing"),
        F.count_if(F.col("effect") == "note").alias("n_noted"),
        F.count_if("human_resolved").alias("n_resolved"),
    )
    draft = F.coalesce(F.col("status") == "draft", F.lit(False))
    counts = ["n_blocking", "n_failing", "n_noted", "n_resolved"]
    out = project.join(totals, list(scope), "left").join(
        decisions_applied(decision, scope=scope).select(*scope, "human_decisions_applied"), list(scope), "left"
    )
    for name in counts:
        out = out.withColumn(name, F.when(draft, 0).otherwise(F.coalesce(name, F.lit(0))))
    decided = (
        F.when(draft, "draft_approved")
        .when(F.col("n_blocking") > 0, "blocked")
        .when(F.col("n_failing") > 0, "fail")
        .otherwise("pass")
    )
    return out.select(
        *scope, decided.alias("gate_decision"), *counts,
        F.coalesce("human_decisions_applied", F.lit(0)).alias("human_decisions_applied"),
    )


def gate_reasons(
    gate: DataFrame, findings: DataFrame, *, materialise: Callable[[DataFrame], DataFrame] = cut_lineage, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """The reasons of every decision in report order: scope, seq, reason, effect, item_id.

    They are numbered by ranges of the whole order, as many findings of a project may share one ``ord``;
    ranges are sampled, so they are materialised.

    A resolved finding and one outside the change are marked in the text. A pass without findings
    and a draft get one line each.
    """
    text = fill(lookup(F.col("code"), REASONS, 1), item=F.col("item_id"), detail=F.col("detail"))
    prefix = F.concat(
        F.when(F.col("change_scope") == "current", "[current] ")
        .when(F.col("change_scope") == "pre_existing", "[pre-existing] ")
        .otherwise(""),
        F.when(F.col("human_resolved") & (F.col("code").isin("high_risk", "low_risk")), "[risk accepted] ")
        .when(F.col("human_resolved"), "[completed by a person] ")
        .otherwise(""),
    )
    drafts = gate.filter(F.col("gate_decision") == "draft_approved").select(*scope)
    ranked = findings.join(drafts, list(scope), "left_anti").withColumn("_rank", lookup(F.col("code"), REASONS, 0))
    numbered = number_by_range(ranked, scope=scope, order=["_rank", "ord", "item_id", "detail"], materialise=materialise)
    listed = numbered.select(*scope, "seq", F.concat(prefix, text).alias("reason"), "effect", "item_id", "code")
    quiet = (F.col("gate_decision") == "pass") & (F.col("n_noted") == 0)
    single = gate.filter(quiet | (F.col("gate_decision") == "draft_approved")).select(
        *scope, F.lit(1).cast("bigint").alias("seq"),
        F.when(F.col("gate_decision") == "pass", ALL_PASSED).otherwise(DRAFT).alias("reason"),
        F.lit("note").alias("effect"), F.lit(None).cast("string").alias("item_id"),
        F.when(F.col("gate_decision") == "pass", "all_passed").otherwise("draft").alias("code"),
    )
    return listed.unionByName(single)


def blocked_items(reasons: DataFrame) -> DataFrame:
    """The reasons that block."""
    return reasons.filter(F.col("effect") == "block")
