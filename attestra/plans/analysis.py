"""The whole analysis as one plan: tables in, report tables out, for any number of projects."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import scope as sc
from attestra.functions.ids import numbered_id
from attestra.functions.status import task_evidence_status
from attestra.operators import claims, compliance, coverage, delta, findings, gate, impact, integrity
from attestra.operators.sequence import SCOPE, number_by_range, number_rows
from attestra.session import cut_lineage
from attestra.sources import reports

Tables = Mapping[str, DataFrame]

# Columns of the flat evidence index.
INDEX_COLUMNS: dict[str, str] = {
    "source_type": "string", "source_path": "string", "covers": "array<string>", "status": "string",
    "error_code": "string", "task_id": "string", "claim_id": "string", "related_task": "string", "nodeid": "string",
    "tool_category": "string", "percent_covered": "double", "num_statements": "int", "file_hash": "string",
    "carried_over": "boolean",
}


def _index_rows(rows: DataFrame, rank: int) -> DataFrame:
    """``rows`` with all index columns, absent ones null."""
    missing = [F.lit(None).cast(t).alias(c) for c, t in INDEX_COLUMNS.items() if c not in rows.columns]
    present = [F.col(c).cast(t).alias(c) for c, t in INDEX_COLUMNS.items() if c in rows.columns]
    sub = F.col("sub_ord").cast("bigint") if "sub_ord" in rows.columns else F.lit(0).cast("bigint")
    return rows.select(*SCOPE, *present, *missing, F.lit(rank).alias("source_rank"), F.col("ord").cast("bigint").alias("ord"),
                       sub.alias("sub_ord"))


def fresh_evidence(
    task: DataFrame, claim: DataFrame, tool_evidence: DataFrame, *, task_path: str, claim_path: str
) -> DataFrame:
    """Evidence of this run, not yet numbered: tasks, claims with their code references, tool rows."""
    none = F.array().cast("array<string>")
    covers = F.array_sort(
        F.array_distinct(
            F.concat(F.coalesce("related_requirements", none), F.coalesce("related_acceptance_criteria", none))
        )
    )
    tasks = task.select(
        *SCOPE, "task_id", covers.alias("covers"), task_evidence_status(F.col("status")).alias("status"),
        F.lit("task").alias("source_type"), F.lit(task_path).alias("source_path"), "ord",
    )
    task_cover = tasks.groupBy(*SCOPE, F.col("task_id").alias("related_task")).agg(
        F.max_by("covers", "ord").alias("covers")
    )
    inherited = coverage.inherit_covers(claim.drop("covers"), task_cover)
    claimed = inherited.select(
        *SCOPE, "claim_id", "related_task", "covers", F.coalesce("claimed_status", F.lit("unclear")).alias("status"),
        F.lit("claim").alias("source_type"), F.lit(claim_path).alias("source_path"), "ord", F.lit(0).alias("sub_ord"),
    )
    code = inherited.select(
        *SCOPE, "claim_id", "related_task", "covers", F.lit("compliant").alias("status"), F.lit("code").alias("source_type"),
        F.posexplode("code_refs").alias("_pos", "source_path"), "ord",
    ).withColumn("sub_ord", F.col("_pos") + 1)
    return reduce(
        DataFrame.unionByName,
        [_index_rows(tasks, 1), _index_rows(claimed, 2), _index_rows(code, 2), _index_rows(tool_evidence, 3)],
    ).withColumn("carried_over", F.lit(False))


def build_index(
    tables: Tables, *, task_path: str = "docs/task_list.json", claim_path: str = "claims/current.json",
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """The evidence index: fresh rows, test and coverage rows carried over, consecutive ids per project.

    With file_snapshot and last_scan beside old_evidence, the task and claim rows of a ledger file that has not
    changed since the last scan are taken from the old index.
    """
    rows = fresh_evidence(
        tables["task"], tables["claim"], tables["tool_evidence"], task_path=task_path, claim_path=claim_path
    )
    if {"old_evidence", "file_snapshot", "last_scan"} <= tables.keys():
        rows = _with_reuse(rows, tables)
    # Read three times below: for the carried-over keys, the block counts and the rows themselves.
    rows = materialise(rows)
    if "old_evidence" in tables:
        rows = rows.unionByName(_index_rows(delta.carry_over(tables["old_evidence"], rows), 4))
    numbered = number_rows(
        rows, rank="source_rank", ties=["sub_ord", "source_type", "source_path", "tool_category"], name="_seq"
    )
    return (
        _with_prefix(numbered, tables)
        .withColumn("evidence_id", numbered_id("EVIDENCE", F.col("id_prefix"), F.col("_seq")))
        .withColumn("ord", F.col("_seq"))
        .drop("_seq", "source_rank", "sub_ord", "id_prefix")
    )


def _with_reuse(rows: DataFrame, tables: Tables) -> DataFrame:
    """``rows`` with the old task and claim rows in place of those from unchanged ledger files."""
    from_ledger = F.col("source_type").isin("task", "claim")
    rank = F.when(F.col("source_type") == "task", 1).otherwise(2)
    old = _index_rows(tables["old_evidence"].filter(from_ledger), 0).withColumn("source_rank", rank)
    old = old.withColumn("carried_over", F.coalesce("carried_over", F.lit(False)))
    ledger = delta.reuse_or_regenerate(rows.filter(from_ledger), old, tables["file_snapshot"], tables["last_scan"])
    return ledger.unionByName(rows.filter(~from_ledger))


def _with_prefix(rows: DataFrame, tables: Tables) -> DataFrame:
    return rows.join(tables["project"].select(*SCOPE, "id_prefix"), list(SCOPE))


def check_compliance(
    tables: Tables, *, as_of: Column, package: str, adapter_number: str = "001", folders: Mapping[str, str] | None = None,
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> dict[str, DataFrame]:
    """Rule statuses, violations, unclear and accepted rules of all projects.

    Edges with their modules, statuses and classified rules are read several times, so each is computed once.
    """
    project, prefix = tables["project"], F.col("id_prefix")
    rule, module = tables["rule"], tables["module_boundary"]
    edge = materialise(
        _with_prefix(compliance.edge_modules(tables["import_edge"], module, package=package, folders=folders), tables)
    )

    broken = compliance.boundary_violations(edge, module)
    adapter = compliance.rule_id("MOD", prefix, adapter_number)
    runtime = compliance.runtime_imports(edge, adapter_module=adapter)
    stored = compliance.banned_packages(edge)
    external = compliance.external_resources(tables["html_artifact"])
    missing = compliance.missing_inputs(project, tables["manifest"])

    checked = materialise(reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [
            compliance.module_status(module, broken),
            compliance.presence_status(project, runtime, rule=compliance.rule_id("DEP", prefix, "001")),
            compliance.artifact_status(project, external, rule=compliance.rule_id("DEP", prefix, "002")),
            compliance.presence_status(project, stored, rule=compliance.rule_id("STORE", prefix, "001")),
            compliance.presence_status(project, missing, rule=compliance.rule_id("GATE", prefix, "001")),
        ],
    ))
    rollup = compliance.must_rollup(project, checked, prefix=prefix)
    drift = tables.get("drift")
    if drift is not None:
        ids = project.select(*SCOPE, compliance.rule_id("GATE", prefix, "014").alias("rule_id"))
        rollup = rollup.unionByName(compliance.drift_status(drift, rule, rule_ids=ids))
    status = materialise(checked.unionByName(rollup, allowMissingColumns=True))
    classified = materialise(compliance.classify_rules(rule, status, as_of=as_of))

    def found(rows: DataFrame, rule_id: Column, path: Column, message: Column, rank: int, ord: Column) -> DataFrame:
        return rows.select(
            *SCOPE, rule_id.alias("rule_id"), path.alias("path"), message.alias("message"), F.lit(rank).alias("rank"),
            ord.cast("bigint").alias("ord"),
        )

    line = F.col("lineno")
    none = F.lit(None).cast("string")
    gate_rule = F.col("rule_id") == compliance.rule_id("GATE", prefix, "006")
    rolled = _with_prefix(status.filter(F.col("status") == "violated"), tables).filter(gate_rule)
    violation = reduce(
        DataFrame.unionByName,
        [
            found(broken, F.col("from_module"), F.col("file_path"),
                  F.format_string("%s import of module %s at line %d in %s", "violation", "to_module", "lineno", "file_path"), 1, line),
            found(runtime, compliance.rule_id("DEP", prefix, "001"), F.col("file_path"),
                  F.format_string("Prohibited %s import '%s' at line %d in %s", "violation", "imported_module", "lineno", "file_path"), 2, line),
            found(_with_prefix(external.filter("n_urls > 0"), tables), compliance.rule_id("DEP", prefix, "002"), F.col("path"),
                  F.concat(F.lit("External resources: "), F.array_join("urls", ", ")), 3, F.lit(0)),
            found(stored, compliance.rule_id("STORE", prefix, "001"), F.col("file_path"),
                  F.format_string("Prohibited import of '%s' at line %d in %s", "imported_module", "lineno", "file_path"), 4, line),
            found(_with_prefix(missing, tables), compliance.rule_id("GATE", prefix, "001"), none,
                  F.concat(F.lit("Required input is missing: "), F.col("file_key")), 5, F.lit(0)),
            found(rolled, F.col("rule_id"), none, F.lit("One or more must-level rules are violated."), 6, F.lit(0)),
        ],
    )
    unclear = compliance.unclear_rules(classified).unionByName(
        status.filter((F.col("status") == "unclear") & (F.col("severity") == "must")).select(
            *SCOPE, "rule_id", F.lit("The rule cannot be checked on the present inputs.").alias("reason"),
            F.lit(0).cast("bigint").alias("ord"),
        )
    )
    return {
        "rule_status": status.unionByName(compliance.classified_status(classified), allowMissingColumns=True),
        "violations": violation,
        "unclear_rules": unclear,
        "accepted_rules": classified.filter(F.col("classification") == "accepted"),
    }


def run(
    tables: Tables, *, as_of: Column, package: str = "src", materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> dict[str, DataFrame]:
    """All report tables.

    ``tables``: project (id_prefix, status), requirement, criterion, task, claim, tool_evidence, rule,
    module_boundary, import_edge, html_artifact, manifest, changed_file, scope_pattern, decision; and
    where a project has them old_evidence, head_claim, drift, file_snapshot, last_scan, test_run. Every table that
    several branches read (the evidence index, the affected items, findings, gaps, risks, rule statuses) is materialised once.
    ``claim_tests``, the results of the test files that claims cite, is there with test_run and file_snapshot.
    """
    project, decision, changed = tables["project"], tables["decision"], tables["changed_file"]
    evidence = materialise(build_index(tables, materialise=materialise))
    cover = coverage.explode_covers(evidence)
    refs = claims.explode_refs(tables["claim"])
    file_ref = refs.filter(F.col("kind") != "evidence")
    of_kind = {kind: refs.filter(F.col("kind") == kind).drop("kind") for kind in ("evidence", "code", "test")}

    requirement = coverage.requirement_coverage(tables["requirement"], cover)
    priority = tables["requirement"].groupBy(*SCOPE, "req_id").agg(F.max_by("priority", "ord").alias("priority"))
    criterion = coverage.criterion_coverage(
        tables["criterion"].join(priority, [*SCOPE, "req_id"], "left"), cover
    )
    claim_finding = materialise(
        claims.claim_findings(
            tables["claim"], of_kind["evidence"], of_kind["test"], evidence, _with_prefix(cover, tables),
            ac_prefix=F.concat(F.lit("AC-"), F.col("id_prefix"), F.lit("-")),
        )
    )
    verdict = claims.claim_verdict(tables["claim"], claim_finding)

    # What the change touches.
    task_link = tables["task"].select(
        *SCOPE, "task_id", F.lit("requirement").alias("item_type"), F.explode("related_requirements").alias("item_id")
    ).unionByName(
        tables["task"].select(
            *SCOPE, "task_id", F.lit("ac").alias("item_type"), F.explode("related_acceptance_criteria").alias("item_id")
        )
    )
    affected = materialise(impact.affected_items(changed, tables["claim"], file_ref, task_link))
    direct = affected.limit(0)
    if "head_claim" in tables:
        modified = delta.keyed_delta(tables["claim"], tables["head_claim"], key="claim_id")
        direct = modified.select(*SCOPE, F.col("claim_id").alias("item_id"))

    # Rules.
    rules = check_compliance(tables, as_of=as_of, package=package, materialise=materialise)
    violation = number_by_range(
        rules["violations"], order=["rank", "rule_id", "path", "ord", "message"], name="_n", materialise=materialise
    )
    violation = violation.withColumn("ord", F.col("_n")).drop("_n", "rank")
    prefixed = _with_prefix(violation, tables)
    violation = materialise(compliance.evidence_for_paths(prefixed, evidence, prefix=F.col("id_prefix")).drop("id_prefix"))

    # Gaps and risks.
    gap_sources = [
        coverage.requirement_gaps(requirement), coverage.criterion_gaps(criterion), claims.claim_gaps(claim_finding),
    ]
    if "drift" in tables:
        gap_sources.append(delta.drift_gaps(tables["drift"]))
    gaps = materialise(impact.mark_stale_gaps(findings.merge_gaps(gap_sources), affected, changed))
    prefix = F.col("id_prefix")
    risk_sources = [
        findings.enrich_claim_risks(claims.claim_risks(claim_finding)),
        findings.gap_risks(_with_prefix(gaps, tables), prefix=prefix),
        findings.violation_risks(violation),
        findings.unclear_rule_risks(_with_prefix(rules["unclear_rules"], tables), prefix=prefix),
    ]
    if "drift" in tables:
        risk_sources.append(delta.drift_risks(tables["drift"]))
    sources = [_with_prefix(rows.drop("id_prefix"), tables) for rows in risk_sources]
    numbered = findings.number_risks(sources, prefix=prefix, materialise=materialise).drop("id_prefix")
    risks = materialise(impact.mark_stale_risks(numbered, affected, changed))

    # Gaps only the gate sees: changed files without claim, must criteria uncovered through claims.
    scoped = sc.with_scope_flag(changed, tables["scope_pattern"]).filter("in_scope")
    unclaimed = integrity.unclaimed_files(scoped, file_ref)
    tests = evidence.filter(F.col("source_type") == "test").withColumn("path", F.col("source_path"))
    through_claims = coverage.uncovered_task_criteria(
        coverage.task_claim_coverage(tables["task"], tables["claim"], of_kind["test"], tests)
    )

    def gate_gap(rows: DataFrame, kind: str, item: str, reason: Column) -> DataFrame:
        return rows.select(
            *SCOPE, F.col(item).alias("item_id"), F.lit(kind).alias("item_type"), reason.alias("reason"),
            F.col(item).alias("target_id"), F.lit("must").alias("severity"), F.lit(0).cast("bigint").alias("ord"),
        )

    gate_gaps = impact.active(gaps).unionByName(
        gate_gap(unclaimed, "missing_claim", "path", F.lit("named by no claim")), allowMissingColumns=True
    ).unionByName(
        gate_gap(through_claims, "ac_not_covered", "ac_id", F.concat(F.col("task_id"), F.lit(": "), F.col("reason"))),
        allowMissingColumns=True,
    )
    low = evidence.filter((F.col("tool_category") == "coverage") & (F.col("status") == "violated")).select(
        *SCOPE, F.col("source_path").alias("path"), "percent_covered", "ord"
    )
    gate_rows = materialise(
        gate.gap_findings(gate_gaps, decision, affected, changed)
        .unionByName(gate.risk_findings(impact.active(risks), decision, direct, changed))
        .unionByName(gate.rule_findings(violation, rules["unclear_rules"], rules["rule_status"].withColumn(
            "ord", F.coalesce("ord", F.lit(0))), changed))
        .unionByName(gate.coverage_findings(low))
    )
    result = materialise(gate.gate_result(project, gate_rows, decision))
    reasons = gate.gate_reasons(result, gate_rows, materialise=materialise)

    # Actions and flags.
    with_urgency = findings.gap_urgency(gaps, affected, cover)
    actions = findings.gap_actions(with_urgency).unionByName(
        findings.risk_actions(findings.risk_urgency(risks, affected, cover))
    ).unionByName(findings.violation_actions(violation, rules["rule_status"].withColumn("ord", F.coalesce("ord", F.lit(0)))))
    actions = materialise(actions.unionByName(findings.reason_actions(result, reasons, actions)))
    uncovered = integrity.uncovered_files(
        changed, of_kind["code"].join(tables["claim"].select(*SCOPE, "claim_id", "related_task"), [*SCOPE, "claim_id"])
    )
    accepted = rules["accepted_rules"]
    pending = findings.pending_decisions(
        gaps, risks, accepted, decision.withColumn("decision_key", F.col("decision_id").cast("string"))
    )
    files = evidence.filter(F.col("tool_category") == "coverage").select(
        *SCOPE, F.col("source_path").alias("path"), "percent_covered", "num_statements"
    )
    claim_tests = {}
    if {"test_run", "file_snapshot"} <= tables.keys():
        claim_tests["claim_tests"] = reports.claim_test_results(of_kind["test"], tables["test_run"], tables["file_snapshot"])
    return claim_tests | {
        "evidence": evidence,
        "requirement_coverage": requirement.select(*SCOPE, "req_id", "status", "n_evidence", "ord"),
        "criterion_coverage": criterion.select(*SCOPE, "ac_id", "status", "n_evidence", "ord"),
        "claim_verdicts": verdict.select(*SCOPE, "claim_id", "status", "n_mismatches", "ord"),
        "claim_support": claims.supporting_keys(tables["claim"], of_kind["evidence"], evidence),
        "gaps": gaps, "risks": risks, "affected": affected,
        "rule_status": rules["rule_status"], "violations": violation, "unclear_rules": rules["unclear_rules"],
        "accepted_rules": accepted, "gate": result, "reasons": reasons, "actions": findings.rank_actions(actions),
        "action_counts": findings.action_counts(actions), "pending": pending,
        "coverage_summary": coverage.coverage_summary(files), "worst_coverage": findings.worst_coverage(files),
        "flags": findings.run_flags(result, gaps, risks, rules["unclear_rules"], violation, uncovered),
    }


def integrity_gates(tables: Tables, *, ghost_allowed: Column | None = None) -> dict[str, DataFrame]:
    """The checks before the analysis: baseline drift, mapping, and - for changed files - claims of this
    revision, tasks behind them, and criteria of new tasks. Needs head_claim, head_task and document."""
    changed = sc.with_scope_flag(tables["changed_file"], tables["scope_pattern"]).filter("in_scope")
    staged, head = tables["claim"], tables["head_claim"]
    active = delta.active_claims(staged, head)
    active_ref = active.select(*SCOPE, F.explode("code_refs").alias("ref"))
    code_ref = staged.select(*SCOPE, "claim_id", F.explode("code_refs").alias("ref"))
    modified = delta.keyed_delta(tables["task"], tables["head_task"], key="task_id")
    new_task = tables["task"].join(modified.filter(F.col("change") == "new"), [*SCOPE, "task_id"], "left_semi").select(
        *SCOPE, "task_id", F.explode("related_acceptance_criteria").alias("ac_id")
    )
    return {
        "mapping": integrity.requirement_rule_mapping(
            tables["requirement"], integrity.rule_requirement_links(tables["rule"], tables["module_boundary"])
        ),
        "ghost_files": integrity.ghost_files(changed, active_ref, allowed=ghost_allowed),
        "reverse_coverage": integrity.reverse_task_coverage(changed, staged, code_ref, tables["task"], modified),
        "criterion_freshness": integrity.criterion_freshness(
            new_task, integrity.document_criteria(tables["document"]), tables["document"]
        ),
    }
