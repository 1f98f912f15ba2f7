"""Gaps, risks and the actions and decisions they lead to."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.functions.ids import decision_key, id_number, numbered_id, sentinel_evidence
from attestra.operators.joins import left_join_known
from attestra.operators.sequence import SCOPE, first_per_key, number_rows, top_per_scope

# What a risk category means and what to do about it.
RISK_ADVICE = {
    "self_referential_claim": (
        "An agent must not vouch for itself; unreviewed work may be hidden.",
        "Provide independent evidence for the task and cite its id in `evidence_refs`."),
    "non_existent_evidence": (
        "The chain of evidence is broken, so the claimed status cannot be checked.",
        "Make sure the cited evidence was produced and is in the evidence index."),
    "stale_file": (
        "Files changed after the claim was issued; the claimed coverage no longer holds.",
        "Verify the task again and issue a claim with a current time stamp."),
    "non_existent_task": (
        "The claim belongs to no task; the id may be wrong or the task list out of date.",
        "Check that `related_task` is an id of the task list."),
    "no_test_coverage": (
        "The criterion has no passing test, so its fulfilment is unproven.",
        "Add a test and declare `covers: <ac_id>` in its docstring."),
    "failed_tests": (
        "Tests of the criterion fail, so its fulfilment is disproved.",
        "Run and repair the failing tests of the criterion."),
    "violated_evidence": (
        "Tests of the criterion fail, so its fulfilment is disproved.",
        "Run and repair the failing tests of the criterion."),
}
DEFAULT_ADVICE = (
    "Development status and evidence may contradict each other and affect the gate.",
    "Compare the claim with the external evidence and correct the fields that disagree.",
)
# Gap type -> (severity, description, impact, action) of the risk it causes.
GAP_RISKS = {
    "requirement": (
        "must", "Requirement {id} has no related task.",
        "The requirement may be left out or built astray.",
        "Plan a task for requirement `{id}` in the task list."),
    "ac": (
        "must", "Acceptance criterion {id} has no passing test evidence.",
        "Nothing proves that the criterion is fulfilled.",
        "Add a test for criterion `{id}` and declare `covers: {id}` in its docstring."),
    "task": (
        "should", "Task {id} has no claim or an incomplete one.",
        "The task is planned, but nobody has stated its status.",
        "Issue a claim with status and evidence for task `{id}`."),
}


def lookup(key: Column, table: dict, position: int) -> Column:
    out = None
    for name, entry in table.items():
        hit = key == name
        out = F.when(hit, entry[position]) if out is None else out.when(hit, entry[position])
    return out


def merge_gaps(sources: Sequence[DataFrame], *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Gaps of several sources, the first one per (item, type) in source order, then ``ord``."""
    ranked = [rows.withColumn("source_rank", F.lit(i)) for i, rows in enumerate(sources, 1)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    ties = [c for c in ("reason",) if c in union.columns]
    return first_per_key(union, [*scope, "item_id", "item_type"], ["source_rank", "ord", *ties])


def enrich_claim_risks(risk: DataFrame) -> DataFrame:
    """Impact and action by category, keeping values a risk already has."""
    category = F.coalesce("risk_category", F.lit(""))
    stale = category == "stale_file"

    def own(name: str) -> Column:
        return F.col(name) if name in risk.columns else F.lit(None).cast("string")

    def advice(position: int) -> Column:
        return F.coalesce(lookup(category, RISK_ADVICE, position), F.lit(DEFAULT_ADVICE[position]))

    return (
        risk.withColumn("business_impact", F.coalesce(own("business_impact"), advice(0)))
        .withColumn("suggested_action", F.coalesce(own("suggested_action"), advice(1)))
        .withColumn("confidence", F.when(stale, "low_confidence").otherwise(own("confidence")))
        .withColumn("type", F.when(stale, "suggestion").otherwise(own("type")))
    )


def gap_risks(gap: DataFrame, *, prefix: str | Column = "P", scope: Sequence[str] = SCOPE) -> DataFrame:
    """A risk for every requirement, criterion and task gap; other gap types cause none."""
    kind = F.col("item_type")

    def filled(position: int) -> Column:
        return tx.fill(lookup(kind, GAP_RISKS, position), id=F.col("item_id"))

    return gap.filter(kind.isin(*GAP_RISKS)).select(
        *scope, filled(1).alias("description"), lookup(kind, GAP_RISKS, 0).alias("severity"),
        filled(2).alias("business_impact"), filled(3).alias("suggested_action"),
        sentinel_evidence(prefix).alias("evidence_id"), F.col("item_id").alias("target_id"), "ord",
        *([F.col("source_rank").alias("step")] if "source_rank" in gap.columns else []),
    )


def violation_risks(violation: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """One must-risk per violated rule, with its first message.

    ``violation``: scope, rule_id, message, evidence_id, ord.
    """
    first = first_per_key(
        violation.select(*scope, "rule_id", "message", "evidence_id", "ord"), [*scope, "rule_id"], ["ord", "message"]
    )
    return first.select(
        *scope,
        F.format_string("Architecture rule %s is violated: %s", "rule_id", "message").alias("description"),
        F.lit("must").alias("severity"),
        F.lit("Breaks the agreed architecture and the isolation of modules.").alias("business_impact"),
        F.format_string("Change the files to comply with rule `%s`.", "rule_id").alias("suggested_action"),
        "evidence_id", F.col("rule_id").alias("target_id"), "ord",
    )


def unclear_rule_risks(unclear: DataFrame, *, prefix: str | Column = "P", scope: Sequence[str] = SCOPE) -> DataFrame:
    """A speculative should-risk per rule nobody can check; ``unclear``: scope, rule_id, reason, ord."""
    return unclear.select(
        *scope,
        F.format_string("Architecture rule %s is unclear: %s", "rule_id", "reason").alias("description"),
        F.lit("should").alias("severity"),
        F.lit("The rule cannot be checked by machine and may need a manual audit.").alias("business_impact"),
        F.format_string("Have rule `%s` reviewed and confirmed by a person.", "rule_id").alias("suggested_action"),
        sentinel_evidence(prefix).alias("evidence_id"), F.col("rule_id").alias("target_id"),
        F.lit("low_confidence").alias("confidence"), F.lit("suggestion").alias("type"), "ord",
    )


RISK_ORDER = ("step", "pos", "ref", "risk_category", "description")


def number_risks(
    sources: Sequence[DataFrame], *, existing: DataFrame | None = None, prefix: str | Column = "P",
    materialise: Callable[[DataFrame], DataFrame] | None = None, scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Risks of several sources in source order with consecutive ids after the highest existing one.

    ``existing``: scope, risk_id. Ids of other forms do not count.
    """
    ranked = [rows.withColumn("source_rank", F.lit(i)) for i, rows in enumerate(sources, 1)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    ties = [c for c in RISK_ORDER if c in union.columns]
    rows = number_rows(union, scope=scope, rank="source_rank", ties=ties, name="_seq", materialise=materialise)
    start = F.lit(0)
    if existing is not None:
        last = existing.groupBy(*scope).agg(F.max(id_number(F.col("risk_id"), "RISK", prefix)).alias("_last"))
        rows = rows.join(last, list(scope), "left")
        start = F.coalesce("_last", F.lit(0))
    return rows.withColumn("risk_id", numbered_id("RISK", prefix, start + F.col("_seq"))).drop("_seq", "_last")


def with_decision_flag(
    rows: DataFrame, decision: DataFrame, *, action: str, target: str = "target_id", flag: str,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """``flag``: a human decision with this action names the row's target. Empty targets never match."""
    targets = (
        decision.filter((F.col("action") == action) & (F.col("targetId").cast("string") != ""))
        .select(*scope, F.col("targetId").alias(target))
        .distinct()
        .withColumn(flag, F.lit(True))
    )
    return left_join_known(rows, targets, [*scope, target], target).withColumn(flag, F.coalesce(flag, F.lit(False)))


def decisions_applied(decision: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Distinct accepted plus distinct completed targets per project, matched by a finding or not."""
    named = (
        decision.filter(F.col("action").isin("accept_risk", "mark_complete") & (F.col("targetId").cast("string") != ""))
        .select(*scope, "action", "targetId")
        .distinct()
    )
    return named.groupBy(*scope).agg(
        F.count_if(F.col("action") == "accept_risk").alias("n_accepted"),
        F.count_if(F.col("action") == "mark_complete").alias("n_completed"),
        F.count(F.lit(1)).alias("human_decisions_applied"),
    )


def pending_decisions(
    gap: DataFrame, risk: DataFrame, accepted_rule: DataFrame, decision: DataFrame, *, compat: bool = False,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Items that wait for a human decision and have none yet.

    Uncovered criteria (not stale, not accepted), stale risks (not deferred), expired acceptances.
    ``decision``: scope, decision_key.
    """

    def flag(df: DataFrame, name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)

    open_gap = (F.col("item_type") == "ac") & ~flag(gap, "stale") & ~flag(gap, "human_accepted")
    gaps = gap.filter(open_gap).select(
        *scope, F.lit("uncovered_ac").alias("category"), F.col("item_id").cast("string").alias("target_id"),
        F.col("reason"), F.lit("must").alias("severity"), F.col("item_id").cast("string").alias("_key"),
    )
    risks = risk.filter(flag(risk, "stale") & ~flag(risk, "deferred")).select(
        *scope, F.lit("stale_debt").alias("category"), F.coalesce(F.col("claim_id").cast("string"), F.lit("")).alias("target_id"),
        F.col("description").alias("reason"), F.coalesce("severity", F.lit("should")).alias("severity"),
        F.coalesce(F.col("claim_id").cast("string"), F.lit("unknown")).alias("_key"),
    )
    rules = accepted_rule.filter("stale_acceptance").select(
        *scope, F.lit("accepted_rule").alias("category"), F.col("rule_id").cast("string").alias("target_id"),
        F.lit("Acceptance has expired and needs re-confirmation").alias("reason"), F.lit("should").alias("severity"),
        F.col("rule_id").cast("string").alias("_key"),
    )
    return (
        gaps.unionByName(risks)
        .unionByName(rules)
        .withColumn("decision_key", decision_key(F.col("category"), F.col("_key"), compat=compat))
        .drop("_key")
        .join(decision.select(*scope, "decision_key").distinct(), [*scope, "decision_key"], "left_anti")
    )


def _base_urgency(rows: DataFrame, affected: DataFrame, cover: DataFrame, column: str, scope: Sequence[str]) -> DataFrame:
    """``_urgency``: 85 for items the change touches, 60 for those that some evidence covers; one join for both."""
    items = affected.select(*scope, F.col("item_id").alias(column), F.lit(85).alias("_urgency")).unionByName(
        cover.select(*scope, F.col("item_id").alias(column), F.lit(60).alias("_urgency"))
    )
    known = items.groupBy(*scope, column).agg(F.max("_urgency").alias("_urgency"))
    return left_join_known(rows, known, [*scope, column], column)


def gap_urgency(gap: DataFrame, affected: DataFrame, cover: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """85 if the change touches the item, 60 if some evidence covers it, else 30."""
    rows = _base_urgency(gap, affected, cover, "item_id", scope)
    return rows.withColumn("urgency", F.coalesce("_urgency", F.lit(30))).drop("_urgency")


def risk_urgency(risk: DataFrame, affected: DataFrame, cover: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """85 if the change touches the claim, 60 if evidence covers it, 25 if stale, else 30."""
    rows = _base_urgency(risk, affected, cover, "claim_id", scope)
    stale = F.coalesce("stale", F.lit(False)) if "stale" in risk.columns else F.lit(False)
    return rows.withColumn("urgency", F.coalesce("_urgency", F.when(stale, 25).otherwise(30))).drop("_urgency")


def _action(rows: DataFrame, scope, priority, kind, item: str, detail: Column, urgency: Column, rank: int) -> DataFrame:
    return rows.select(
        *scope, F.lit(priority).alias("priority"), F.lit(kind).alias("type"),
        F.col(item).cast("string").alias("item_id"), detail.cast("string").alias("detail"),
        urgency.cast("int").alias("urgency"), F.lit(rank).alias("source_rank"), "ord",
    )


def gap_actions(gap: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Cover every must gap nobody has accepted; ``gap`` carries ``urgency``."""
    accepted = F.coalesce("human_accepted", F.lit(False)) if "human_accepted" in gap.columns else F.lit(False)
    rows = gap.filter((F.col("severity") == "must") & ~accepted)
    return _action(rows, scope, "HIGH", "cover_gap", "item_id", F.col("reason"), F.col("urgency"), 1)


def is_self_referential(risk: DataFrame) -> Column:
    """By its category where a risk has one; risks from elsewhere by their description."""
    said = F.contains(F.col("description"), F.lit("self-referential"))
    by_category = F.col("risk_category") == "self_referential_claim" if "risk_category" in risk.columns else F.lit(None)
    return F.coalesce(by_category, said, F.lit(False))


def risk_actions(risk: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Must and self-referential risks; stale risks that are not deferred, as low-priority debt."""
    high = risk.filter(F.coalesce(F.col("severity") == "must", F.lit(False)) | is_self_referential(risk))
    deferred = F.coalesce("deferred", F.lit(False)) if "deferred" in risk.columns else F.lit(False)
    debt = risk.filter(F.coalesce("stale", F.lit(False)) & ~deferred)
    return _action(high, scope, "HIGH", "high_risk", "risk_id", F.col("description"), F.col("urgency"), 2).unionByName(
        _action(debt, scope, "LOW", "stale_debt", "risk_id", F.col("description"), F.col("urgency"), 3)
    )


def violation_actions(violation: DataFrame, rule_status: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Every violation, and violated must rules that no violation names."""
    named = violation.select(*scope, "rule_id").distinct()
    bare = rule_status.filter((F.col("status") == "violated") & (F.col("severity") == "must")).join(
        named, [*scope, "rule_id"], "left_anti"
    )
    return _action(violation, scope, "HIGH", "fix_violation", "rule_id", F.col("message"), F.lit(90), 4).unionByName(
        _action(bare, scope, "HIGH", "arch_status_violation", "rule_id", F.lit(None), F.lit(90), 5)
    )


def reason_actions(
    gate: DataFrame, reason: DataFrame, action: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Fallback: the gate's reasons, where a blocked or failed project has no HIGH action.

    ``reason``: scope, seq, reason.
    """
    needy = gate.filter(F.col("gate_decision").isin("blocked", "fail")).select(*scope)
    covered = action.filter(F.col("priority") == "HIGH").select(*scope).distinct()
    rows = reason.join(needy.join(covered, list(scope), "left_anti"), list(scope), "left_semi").select(
        *scope, F.lit(None).cast("string").alias("item_id"), "reason", F.col("seq").alias("ord")
    )
    return _action(rows, scope, "HIGH", "gate_blocked", "item_id", tx.clip(F.col("reason")), F.lit(80), 6)


def rank_actions(
    action: DataFrame, *, materialise: Callable[[DataFrame], DataFrame] | None = None, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Position of every action in its project: most urgent first, then source order."""
    ranked = action.withColumn("_rank", (100 - F.col("urgency")) * 10 + F.col("source_rank"))
    return number_rows(
        ranked, scope=scope, rank="_rank", ties=["item_id", "detail"], name="position", materialise=materialise
    ).drop("_rank")


def action_counts(action: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Actions by priority and urgency band."""
    pending = F.coalesce("pending_human_decision", F.lit(False)) if "pending_human_decision" in action.columns else F.lit(False)
    return action.groupBy(*scope).agg(
        F.count_if(F.col("priority") == "HIGH").alias("n_high"),
        F.count_if(F.col("priority") == "MEDIUM").alias("n_medium"),
        F.count_if(F.col("priority") == "LOW").alias("n_low"),
        F.count_if(F.col("urgency") >= 80).alias("n_current"),
        F.count_if(F.col("urgency").between(20, 79)).alias("n_pre_existing"),
        F.count_if(pending).alias("n_pending_human"),
    )


def worst_coverage(
    coverage_file: DataFrame, *, n: int = 5, threshold: float = 80.0, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """The ``n`` least covered files below the threshold per project."""
    low = coverage_file.filter(F.col("percent_covered") < threshold)
    return top_per_scope(low, n, [F.col("percent_covered"), F.col("path")], scope=scope)


def related_files(
    task_criterion: DataFrame, claim: DataFrame, file_ref: DataFrame, *, n: int, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """First ``n`` files per criterion, through its tasks' claims, in claim order.

    Cut to ``n`` per task before tasks meet criteria, so a task with many claims adds ``n`` rows per
    criterion. ``task_criterion``: scope, task_id, ac_id. ``file_ref``: scope, claim_id, ref, pos.
    """
    refs = (
        file_ref.select(*scope, "claim_id", "pos", tx.without_fragment(F.col("ref")).alias("path"))
        .filter(F.col("path") != "")
        .join(claim.select(*scope, "claim_id", F.col("related_task").alias("task_id"), "ord"), [*scope, "claim_id"])
    )
    order = [F.col("ord"), F.col("claim_id"), F.col("pos"), F.col("path")]
    per_task = top_per_scope(refs, n, order, scope=[*scope, "task_id"]).drop("position")
    spread = task_criterion.select(*scope, "task_id", "ac_id").distinct().join(per_task, [*scope, "task_id"])
    return top_per_scope(spread, n, order, scope=[*scope, "ac_id"]).select(
        *scope, "ac_id", "position", "path", "claim_id", "task_id"
    )


def with_titles(rows: DataFrame, titled: DataFrame, *, key: str, name: str, scope: Sequence[str] = SCOPE) -> DataFrame:
    """``rows`` with the title of the criterion or requirement in ``key``, empty if unknown."""
    titles = titled.groupBy(*scope, key).agg(F.min_by("title", "ord").alias(name))
    return rows.join(titles, [*scope, key], "left").withColumn(name, F.coalesce(name, F.lit("")))


def run_flags(
    gate: DataFrame, gap: DataFrame, risk: DataFrame, unclear: DataFrame, violation: DataFrame, uncovered: DataFrame, *,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Nine named conditions over a run's totals, one row per project."""
    # One aggregate and one join for all five kinds of rows: each join would sort both of its sides.
    kinds = {
        "_gaps": (gap, {"_coverage": F.col("item_type").isin("ac", "requirement")}),
        "_risks": (risk, {"_must": F.col("severity") == "must", "_low": F.col("confidence") == "low_confidence"}),
        "_unclear": (unclear, {}), "_violations": (violation, {}), "_files": (uncovered, {}),
    }
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [of.select(*scope, F.lit(True).alias(name), *[hit.alias(flag) for flag, hit in hits.items()]) for name, (of, hits) in kinds.items()],
    )
    totals = rows.groupBy(*scope).agg(*[F.count_if(c).alias(c) for c in rows.columns if c not in scope])
    out = gate.select(*scope, "gate_decision").join(totals, list(scope), "left")

    def some(name: str, more_than: int = 0) -> Column:
        return F.coalesce(F.col(name) > more_than, F.lit(False))

    return out.select(
        *scope,
        (F.col("gate_decision") == "blocked").alias("gate_blocked"),
        (F.col("gate_decision") == "fail").alias("gate_fail"),
        some("_must").alias("has_must_risks"),
        (some("_gaps", 5) | some("_risks", 10)).alias("high_gap_risk_count"),
        some("_low").alias("has_low_confidence"),
        some("_coverage").alias("has_coverage_gaps"),
        some("_unclear").alias("has_unclear_constraints"),
        some("_violations").alias("has_violations"),
        some("_files").alias("has_uncovered_evolution_scope"),
    )
