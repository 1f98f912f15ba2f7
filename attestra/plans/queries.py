"""Registered queries: every operator over the sample tables, whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import ids, scope as sc, text as tx
from attestra.functions.hashing import file_hash, with_content_hash
from attestra.functions.status import coverage_status, task_evidence_status
from attestra.operators import claims, compliance, constraints, coverage, delta, findings, gate, health, impact, integrity, rollup
from attestra.operators.sequence import number_rows
from attestra.plans import analysis
from attestra.plans.bindings import Bound, module_file, priority_of, text_id
from attestra.schemas import TABLES
from attestra.session import cut_lineage, dealt, shared_folder
from attestra.sources import documents, ledgers, reports, sinks
from attestra.sources.rollups import RollupStore
from attestra.sources.snapshots import SnapshotStore
from attestra.sources.store import LedgerStore
from attestra.streaming import decisions

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SINGLE: tuple[str, ...] = ()
AS_OF = "2001-02-15 12:00:00"


def query(build: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
    REGISTRY[build.__name__] = lambda spark, sf_dir: build(Bound(spark, sf_dir))
    return build


# --- coverage -------------------------------------------------------------------------------------


@query
def requirement_coverage_after_changes(b: Bound) -> DataFrame:
    """Roll-ups from stored counts after a change set: lines of late orders returned, those of small ones taken back."""
    cover = b.task_cover.withColumn("line", F.col("evidence_id"))
    returned = cover.filter(F.col("item_id") % 5 == 0).withColumn("status", F.lit("unclear"))
    gone = cover.filter(F.col("item_id") % 7 == 0)
    touched = cover.filter((F.col("item_id") % 5 == 0) | (F.col("item_id") % 7 == 0))
    store = RollupStore(b.spark, _written(b), parts=16, scope=SINGLE)
    store.create(cover, run_id="RUN-1")
    after = returned.join(gone.select("line"), "line", "left_anti")
    store.apply(rollup.changed_rows(touched, after, ["line"], scope=SINGLE), run_id="RUN-2")
    out = coverage.requirement_coverage(b.requirement, store.counts(), weight=rollup.COUNT, scope=SINGLE)
    return out.select("project_id", "req_id", "status", "n_evidence", "is_gap")


@query
def requirement_coverage(b: Bound) -> DataFrame:
    out = coverage.requirement_coverage(b.requirement, b.task_cover, scope=SINGLE)
    return out.select("project_id", "req_id", "priority", "status", "n_evidence", "is_gap")


@query
def requirement_evidence(b: Bound) -> DataFrame:
    must = b.table("orders").filter(F.substring("o_orderpriority", 1, 1) == "1").select(F.col("o_orderkey").alias("req_id"))
    return coverage.item_evidence(must, b.task_cover, key="req_id", source_type="task", scope=SINGLE)


@query
def ac_coverage(b: Bound) -> DataFrame:
    out = coverage.criterion_coverage(b.criterion, b.test_cover, scope=SINGLE)
    return out.select("project_id", "ac_id", "status", "n_evidence", "is_gap")


@query
def task_claim_coverage(b: Bound) -> DataFrame:
    task = b.table("customer").select(
        F.col("c_nationkey").alias("project_id"), text_id("K", "c_custkey").alias("task_id"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "must").otherwise("should").alias("priority"),
    )
    # Claims of earlier years belong to tasks that have been closed.
    recent = F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")
    claim = b.claim.withColumn("related_task", F.when(recent, F.col("related_task")).otherwise(F.concat(F.lit("closed-"), "related_task")))
    refs = b.test_ref.withColumn("ref", tx.without_fragment(F.col("ref")))
    results = b.part_evidence.filter(F.col("source_type") == "test").withColumnRenamed("source_path", "path")
    return coverage.task_claim_coverage(task, claim, refs, results, scope=SINGLE).select("project_id", "task_id", "reason")


def _coverage_file(b: Bound) -> DataFrame:
    return b.table("part").select(
        F.col("p_brand").alias("project_id"), module_file("p_partkey").alias("path"),
        (F.col("p_size") * 2.0).alias("percent_covered"), F.col("p_retailprice").cast("int").alias("num_statements"),
        F.col("p_partkey").alias("ord"),
    )


@query
def coverage_summary(b: Bound) -> DataFrame:
    return coverage.coverage_summary(_coverage_file(b))


@query
def coverage_violations(b: Bound) -> DataFrame:
    return coverage.coverage_violations(_coverage_file(b))


@query
def worst_coverage(b: Bound) -> DataFrame:
    return findings.worst_coverage(_coverage_file(b)).select("project_id", "position", "path", "percent_covered")


# --- claims ---------------------------------------------------------------------------------------


def _claim_findings(b: Bound) -> DataFrame:
    return claims.claim_findings(
        b.claim, b.evidence_ref, b.test_ref, b.claim_evidence, b.claim_cover, ac_prefix="AC-", scope=SINGLE
    )


@query
def claim_findings(b: Bound) -> DataFrame:
    return _claim_findings(b).select("claim_id", "category", "ref", "detail", "occurrences")


@query
def claim_verdict(b: Bound) -> DataFrame:
    out = claims.claim_verdict(b.claim, _claim_findings(b), scope=SINGLE)
    return out.select("claim_id", "claimed_status", "status", "n_mismatches")


@query
def conflicting_references(b: Bound) -> DataFrame:
    keys = claims.reference_keys(b.part_evidence, scope=SINGLE)
    return keys.filter(F.size("_statuses") > 1).select(
        "ref", F.array_join(F.array_sort("_statuses"), ",").alias("statuses"), "n_supporting"
    )


@query
def claim_support(b: Bound) -> DataFrame:
    return claims.supporting_keys(b.claim, b.evidence_ref, b.claim_evidence, scope=SINGLE)


@query
def hash_invalidation(b: Bound) -> DataFrame:
    document = b.table("documents")
    snapshot = document.filter(F.col("lang") != "fr").select(
        text_id("doc/", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256")
    )
    recorded = document.join(b.table("labels"), "doc_id").select(
        F.concat(text_id("doc/", "doc_id"), F.lit("::node")).alias("source_path"),
        F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.upper("text")), 256).alias("file_hash"),
        F.col("doc_id").alias("ord"),
    )
    refs = document.select(F.col("source").alias("claim_id"), F.concat(text_id("doc/", "doc_id"), F.lit("#L1")).alias("ref"))
    out = claims.reference_invalidation(refs, snapshot, recorded, scope=SINGLE)
    return out.select("claim_id", "path", "change")


@query
def claims_to_reverify(b: Bound) -> DataFrame:
    document = b.table("documents").select("doc_id", "lang", "source")
    snapshot = document.filter(F.col("lang") != "fr").select(
        text_id("doc/", "doc_id").alias("path"), F.col("lang").alias("sha256")
    )
    recorded = document.join(b.table("labels"), "doc_id").select(
        text_id("doc/", "doc_id").alias("source_path"), F.lit("en").alias("file_hash"), F.col("doc_id").alias("ord")
    )
    refs = document.select(F.col("source").alias("claim_id"), text_id("doc/", "doc_id").alias("ref"))
    return claims.claims_to_reverify(
        claims.reference_invalidation(refs, snapshot, recorded, scope=SINGLE), scope=SINGLE
    )


# --- integrity ------------------------------------------------------------------------------------


@query
def dangling_refs(b: Bound) -> DataFrame:
    small = b.table("part").filter(F.col("p_size") <= 25)
    child = b.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return integrity.dangling_refs(child, small, ref="l_partkey", key="p_partkey", scope=SINGLE)


@query
def claim_task_integrity(b: Bound) -> DataFrame:
    out = integrity.dangling_refs(b.claim, b.task_evidence, ref="related_task", key="task_id", scope=SINGLE)
    return out.select("claim_id", "related_task")


@query
def task_reference_problems(b: Bound) -> DataFrame:
    task = b.table("orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.array(text_id("K", "o_custkey")).alias("related_modules"),
        F.array(text_id("D", F.dayofmonth("o_orderdate")), text_id("D", F.month("o_orderdate"))).alias("related_requirements"),
    )
    sizes = b.table("part").filter(F.col("p_size") <= 25).select(text_id("D", "p_size").alias("req_id"))
    return integrity.task_reference_problems(
        task, {"related_modules": (b.task_evidence, "task_id"), "related_requirements": (sizes, "req_id")}, scope=SINGLE
    )


@query
def missing_parents(b: Bound) -> DataFrame:
    ac = F.concat_ws("-", F.lit("AC-P"), "c_nationkey", "c_custkey")
    task = b.table("customer").select(
        text_id("K", "c_custkey").alias("task_id"),
        F.array(F.when(F.col("c_acctbal") > 3000, text_id("REQ-P-", "c_nationkey")).otherwise("REQ-P-0")).alias("related_requirements"),
        F.array(ac).alias("related_acceptance_criteria"),
    )
    criterion = b.table("customer").filter(F.col("c_mktsegment") != "BUILDING").select(ac.alias("ac_id"))
    return integrity.missing_parents(task, criterion, scope=SINGLE)


@query
def duplicate_keys(b: Bound) -> DataFrame:
    return integrity.duplicate_keys(b.table("lineitem"), ["l_orderkey", "l_linenumber"], scope=SINGLE)


@query
def mapping_both_ways(b: Bound) -> DataFrame:
    size = F.col("p_size")
    requirement = b.table("part").filter(size > 5).select(
        F.col("p_partkey").alias("req_id"), F.col("p_partkey").alias("ord"),
        F.when(size <= 20, "must").when(size <= 40, "should").otherwise("unclear").alias("priority"),
    )
    top = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08)
    link = b.table("lineitem").select(F.col("l_partkey").alias("req_id"), top.alias("top_level"))
    return integrity.requirement_rule_mapping(requirement, link, scope=SINGLE)


INCLUDE = ("src/1*", "src/??.py", "[2-4]*5.py")
EXCLUDE = ("*/1[!0-4]*", "src/*7.p?")


@query
def scope_partition(b: Bound) -> DataFrame:
    files = b.table("part").select(F.col("p_brand").alias("project_id"), module_file("p_partkey").alias("path"))
    return sc.scope_counts(files.withColumn("in_scope", sc.in_scope(F.col("path"), INCLUDE, EXCLUDE)))


@query
def scope_by_project(b: Bound) -> DataFrame:
    files = b.table("part").select(F.col("p_brand").alias("project_id"), module_file("p_partkey").alias("path"))
    brand = F.substring_index("project_id", "#", -1)
    brands = files.select("project_id").distinct()
    pattern = brands.select("project_id", F.lit("include").alias("kind"), F.concat(F.lit("src/"), brand, F.lit("*")).alias("pattern"))
    pattern = pattern.unionByName(
        brands.select("project_id", F.lit("exclude").alias("kind"), F.lit("[!0-4]*9.py").alias("pattern"))
    )
    return sc.with_scope_flag(files, pattern).select("project_id", "path", "in_scope")


def _former_place(ref: str, here: Column) -> Column:
    """References that are not ``here`` name the file's former place, where nothing has changed."""
    return F.when(here, F.col(ref)).otherwise(F.concat(F.lit("old/"), F.col(ref)))


@query
def unclaimed_files(b: Bound) -> DataFrame:
    changed = b.changed_file.withColumn("in_scope", sc.in_scope(F.col("path"), INCLUDE, EXCLUDE)).filter("in_scope")
    recent = b.claim.select("claim_id", (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).alias("recent"))
    refs = b.file_ref.join(recent, "claim_id").withColumn("ref", _former_place("ref", F.col("recent")))
    return integrity.unclaimed_files(changed, refs, scope=SINGLE)


@query
def ghost_files(b: Bound) -> DataFrame:
    head, staged = b.orders_snapshots
    exclude = ("ord", "o_orderdate")
    active = delta.active_claims(
        with_content_hash(staged, exclude=exclude), with_content_hash(head, exclude=exclude), scope=SINGLE
    )
    keys = active.select(text_id("C", "claim_id").alias("claim_id"), (F.col("o_totalprice") > 480000).alias("large"))
    refs = b.file_ref.filter(F.col("kind") == "code").join(keys, "claim_id").withColumn("ref", _former_place("ref", F.col("large")))
    allowed = sc.is_allowed(F.col("path"), paths=("src/11.py",), prefixes=("src/5",))
    return integrity.ghost_files(b.changed_file, refs, allowed=allowed, scope=SINGLE)


@query
def reverse_coverage(b: Bound) -> DataFrame:
    task = b.task_evidence.select("task_id", "ord", F.when(F.col("status") == "covered", "done").otherwise("todo").alias("status"))
    modified = b.table("customer").filter(F.col("c_acctbal") < -500).select(text_id("K", "c_custkey").alias("task_id"))
    return integrity.reverse_task_coverage(
        b.changed_file, b.claim, b.file_ref.filter(F.col("kind") == "code"), task, modified, scope=SINGLE
    )


@query
def fresh_refs(b: Bound) -> DataFrame:
    new_task = b.order_project.select(
        "project_id", F.col("o_orderkey").alias("task_id"), F.substring("o_orderpriority", 1, 1).alias("ac_id")
    )
    # Only even sizes are projects with a staged document; in half of these the criteria have other ids.
    size = F.col("p_size")
    first = F.substring(F.col("p_partkey").cast("string"), 1, 1)
    staged_ac = b.table("part").select(
        F.when(size % 2 == 0, size).otherwise(-size).alias("project_id"), F.when(size % 4 == 0, first).otherwise(F.concat(F.lit("X"), first)).alias("ac_id")
    )
    return integrity.criterion_freshness(new_task, staged_ac, staged_ac.select("project_id"))


@query
def uncovered_files(b: Bound) -> DataFrame:
    refs = b.file_ref.withColumn("ref", _former_place("ref", F.col("pos") == 3))
    return integrity.uncovered_files(b.table("part").select(module_file("p_partkey").alias("path")), refs, scope=SINGLE)


# --- impact ---------------------------------------------------------------------------------------


def _affected(b: Bound) -> DataFrame:
    changed = b.table("part").filter((F.col("p_brand") == "Brand#7") & (F.col("p_size") < 20)).select(
        module_file("p_partkey").alias("path")
    )
    tasks = b.table("customer")
    link = tasks.select(
        text_id("K", "c_custkey").alias("task_id"),
        F.explode(
            F.array(
                F.struct(F.lit("requirement").alias("item_type"), text_id("REQ-", "c_nationkey").alias("item_id")),
                F.struct(F.lit("ac").alias("item_type"), text_id("AC-", F.floor(F.col("c_acctbal"))).alias("item_id")),
            )
        ).alias("_l"),
    ).select("task_id", "_l.*")
    return impact.affected_items(changed, b.claim, b.file_ref, link, scope=SINGLE)


@query
def affected_items(b: Bound) -> DataFrame:
    return _affected(b)


def _impact_gaps(b: Bound) -> DataFrame:
    open_orders = b.table("orders").filter(F.col("o_orderstatus") == "F").select(
        F.lit("claim").alias("item_type"), text_id("C", "o_orderkey").alias("item_id")
    )
    criteria = b.table("customer").select(
        F.lit("ac").alias("item_type"), text_id("AC-", F.floor(F.col("c_acctbal"))).alias("item_id")
    )
    other = b.table("customer").filter(F.col("c_acctbal") < 0).select(
        F.lit("task").alias("item_type"), text_id("K", "c_custkey").alias("item_id")
    )
    return open_orders.unionByName(criteria).unionByName(other)


@query
def stale_gaps(b: Bound) -> DataFrame:
    marked = impact.mark_stale_gaps(_impact_gaps(b), _affected(b), b.changed_file, scope=SINGLE)
    return marked.groupBy("item_type", "stale").agg(F.count(F.lit(1)).alias("n"))


@query
def stale_risks(b: Bound) -> DataFrame:
    risk = b.order_project.select("project_id", F.when(F.col("o_orderstatus") == "P", text_id("C", "o_orderkey")).alias("claim_id"))
    affected = b.order_project.select(
        "project_id", F.when(F.col("o_totalprice") > 400000, "claim").otherwise("task").alias("item_type"), text_id("C", "o_orderkey").alias("item_id")
    )
    changed = b.table("nation").filter(F.col("n_regionkey") <= 2).select(F.col("n_nationkey").alias("project_id"))
    return impact.stale_counts(impact.mark_stale_risks(risk, affected, changed))


@query
def current_findings(b: Bound) -> DataFrame:
    affected = _affected(b).select("item_id")
    rows = _impact_gaps(b).filter(F.col("item_type") == "claim").select(F.col("item_id").alias("claim_id"))
    rows = rows.withColumn("risk_id", F.lit(None).cast("string"))
    return impact.tag_current(rows, affected, ["risk_id", "claim_id"], scope=SINGLE).select("claim_id", "change_scope")


# --- deltas ---------------------------------------------------------------------------------------


@query
def claim_delta(b: Bound) -> DataFrame:
    head, staged = b.orders_snapshots
    out = delta.active_claims(
        with_content_hash(staged, exclude=("ord",)), with_content_hash(head, exclude=("ord",)), scope=SINGLE
    )
    return out.select("claim_id", "o_orderstatus")


@query
def keyed_delta(b: Bound) -> DataFrame:
    head, staged = b.orders_snapshots
    return delta.keyed_delta(
        with_content_hash(staged, exclude=("ord",)), with_content_hash(head, exclude=("ord",)), key="claim_id", scope=SINGLE
    )


def _stored_snapshots(b: Bound) -> SnapshotStore:
    """The two revisions, a project per customer, stored with their hash trees."""
    store = SnapshotStore(b.spark, _written(b), scope=("o_custkey",))
    for revision, claim in zip(("head", "staged"), b.orders_snapshots, strict=True):
        store.put(revision, "claim", with_content_hash(claim, exclude=("ord",)), key="claim_id")
    return store


@query
def claim_delta_of_snapshots(b: Bound) -> DataFrame:
    return _stored_snapshots(b).active_claims("head", "staged").select("claim_id", "o_orderstatus")


@query
def keyed_delta_of_snapshots(b: Bound) -> DataFrame:
    return _stored_snapshots(b).keyed_delta("head", "staged", "claim", key="claim_id").select("claim_id", "change")


@query
def rule_diff(b: Bound) -> DataFrame:
    part = b.table("part").select(
        F.col("p_brand").alias("section"), F.col("p_partkey").alias("rule_id"), "p_type", "p_size", "p_retailprice"
    )
    base = part.filter(F.col("p_size") <= 40).withColumn("body_hash", F.sha2(F.to_json(F.struct("p_type", "p_size")), 256))
    current = (
        part.filter(F.col("p_size") >= 10)
        .withColumn("p_type", F.when(F.col("p_retailprice") > 980, "LUXURY").otherwise(F.col("p_type")))
        .withColumn("body_hash", F.sha2(F.to_json(F.struct("p_type", "p_size")), 256))
    )
    return delta.rule_diff(base, current, scope=SINGLE).select("section", "rule_id", "action", "path")


@query
def document_diff(b: Bound) -> DataFrame:
    """JSON documents built per customer: its orders' keys do not matter, its own fields do."""
    customer = b.table("customer")

    def doc(segment, balance):
        return F.to_json(
            F.struct(
                F.struct(segment.alias("segment"), F.col("c_nationkey").alias("nation")).alias("project"),
                F.array(
                    F.struct(F.lit("R1").alias("rule_id"), balance.alias("limit")),
                    F.struct(F.when(F.col("c_acctbal") < 0, "R3").otherwise("R2").alias("rule_id"), F.lit(1).alias("limit")),
                ).alias("rules"),
            )
        )

    base = customer.select("c_custkey", doc(F.col("c_mktsegment"), F.floor(F.col("c_acctbal"))).alias("text"))
    current = customer.select(
        "c_custkey",
        F.replace(
            doc(F.when(F.col("c_nationkey") < 5, "MOVED").otherwise(F.col("c_mktsegment")),
                F.floor(F.when(F.col("c_acctbal") > 9000, 9000).otherwise(F.col("c_acctbal")))),
            F.lit("R3"), F.lit("R4"),
        ).alias("text"),
    )
    return delta.document_diff(base, current, scope=["c_custkey"])


@query
def baseline_drift(b: Bound) -> DataFrame:
    customer = b.table("customer").withColumn("project_id", F.col("c_custkey"))
    config = customer.select(
        "project_id", F.when(F.col("c_acctbal") > -500, F.col("c_mktsegment")).alias("architecture_constraints_hash"),
        F.lit("MACHINERY").alias("prd_hash"),
        F.when(F.col("c_nationkey") != 3, "commit").alias("finalize_git_commit"), F.lit("rules.json").alias("finalize_constraints_path"),
    )
    manifest = customer.select(
        "project_id",
        F.explode(
            F.array(
                F.struct(F.lit("architecture_constraints").alias("file_key"),
                         F.when(F.col("c_acctbal") > 5000, "NEW").otherwise(F.col("c_mktsegment")).alias("sha256")),
                F.struct(F.lit("prd").alias("file_key"), F.col("c_mktsegment").alias("sha256")),
            )
        ).alias("_m"),
    ).select("project_id", "_m.*")
    diff = b.table("orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("project_id"))
    baseline = customer.filter(F.col("c_nationkey") != 4)
    return delta.baseline_drift(config, manifest, diff, baseline)


@query
def accepted_rules(b: Bound) -> DataFrame:
    request = b.table("lineitem").select(
        text_id("RULE-", "l_partkey").alias("rule_id"), text_id("S", "l_suppkey").alias("accepted_by"),
        F.col("l_shipdate").alias("accepted_at"),
    )
    out = delta.accept_rules(b.rule.filter(F.col("severity") == "must"), request, scope=SINGLE)
    return out.select("rule_id", "accepted_by", "accepted_at")


@query
def unknown_acceptances(b: Bound) -> DataFrame:
    request = b.table("lineitem").select("l_orderkey", text_id("RULE-", "l_partkey").alias("rule_id"))
    return delta.unknown_acceptances(b.rule.filter(F.col("severity") == "must"), request, scope=SINGLE)


# --- evidence index -------------------------------------------------------------------------------


def _index_rows(b: Bound) -> DataFrame:
    project = F.col("c_nationkey").alias("project_id")
    customer = b.table("customer")
    covers = F.array_sort(F.array_distinct(F.array(text_id("N", "c_nationkey"), text_id("S", "c_mktsegment"))))
    has_task = customer.filter(F.col("c_mktsegment") != "MACHINERY")
    tasks = has_task.select(
        project, F.lit("task").alias("source_type"), F.lit("docs/task_list.json").alias("source_path"),
        covers.alias("covers"),
        task_evidence_status(
            F.when(F.col("c_acctbal") < 0, "todo").when(F.col("c_acctbal") < 3000, "in_progress")
            .when(F.col("c_acctbal") < 9000, "done").otherwise("cancelled")
        ).alias("status"),
        F.lit(1).alias("source_rank"), F.col("c_custkey").alias("ord"),
    )
    task_cover = has_task.select(text_id("K", "c_custkey").alias("related_task"), covers.alias("covers"))
    claim = b.order_project.select(
        "project_id", F.lit("claim").alias("source_type"), F.lit("claims/current.json").alias("source_path"),
        text_id("K", "o_custkey").alias("related_task"), F.col("o_orderstatus").alias("status"),
        F.lit(2).alias("source_rank"), F.col("o_orderkey").alias("ord"),
    )
    claimed = coverage.inherit_covers(claim, task_cover, scope=SINGLE).drop("related_task")
    tools = b.table("part").select(
        F.col("p_size").alias("project_id"), F.when(F.col("p_type") == "ECONOMY", "test").otherwise("tool").alias("source_type"),
        module_file("p_partkey").alias("source_path"), F.array().cast("array<string>").alias("covers"),
        coverage_status(F.col("p_size") * 3.0).alias("status"), F.lit(3).alias("source_rank"), F.col("p_partkey").alias("ord"),
    )
    return tasks.unionByName(claimed).unionByName(tools).withColumn("carried_over", F.lit(False))


@query
def evidence_index(b: Bound) -> DataFrame:
    fresh = _index_rows(b)
    user = b.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("project_id"))
    kind = F.col("event_type")
    old = b.table("events").join(user, "user_id").select(
        "project_id", F.when(kind == "error", "test").when(kind == "view", "tool").otherwise("claim").alias("source_type"),
        module_file(F.get_json_object("props", "$.k")).alias("source_path"), F.array().cast("array<string>").alias("covers"),
        F.lit("covered").alias("status"), F.lit(4).alias("source_rank"), F.col("event_id").alias("ord"),
        F.when(F.col("value") > 10, "coverage").alias("tool_category"),
    )
    carried = delta.carry_over(old, fresh, scope=SINGLE).drop("tool_category")
    rows = number_rows(fresh.unionByName(carried), rank="source_rank", name="seq", materialise=cut_lineage)
    return rows.select(
        "project_id", ids.numbered_id("EVIDENCE", F.col("project_id").cast("string"), F.col("seq")).alias("evidence_id"),
        "source_type", "source_path", F.array_join("covers", ",").alias("covers"), "status", "carried_over",
    )


@query
def incremental_reuse(b: Bound) -> DataFrame:
    part = b.table("part")
    columns = ["project_id", "source_path", "source_type"]
    new = part.filter(F.col("p_size") > 10).select(
        F.col("p_brand").alias("project_id"), module_file("p_partkey").alias("source_path"), F.lit("new").alias("source_type")
    )
    old = part.filter(F.col("p_size") < 30).select(
        F.col("p_brand").alias("project_id"), F.concat(module_file("p_partkey"), F.lit("#L1")).alias("source_path"),
        F.lit("old").alias("source_type"),
    )
    snapshot = part.select(
        F.col("p_brand").alias("project_id"), module_file("p_partkey").alias("path"),
        F.expr("timestamp'2001-01-01 00:00:00' + make_interval(0,0,0,p_size)").alias("modified_at"),
    )
    scan = part.select(F.col("p_brand").alias("project_id")).distinct().withColumn(
        "scan_time", F.lit("2001-01-21 00:00:00").cast("timestamp")
    )
    return delta.reuse_or_regenerate(new.select(columns), old.select(columns), snapshot, scan)


# --- findings -------------------------------------------------------------------------------------


@query
def gap_dedup(b: Bound) -> DataFrame:
    def gaps(status: str) -> DataFrame:
        return b.table("orders").filter(F.col("o_orderstatus") == status).select(
            F.col("o_custkey").alias("item_id"), F.lit("task").alias("item_type"), F.col("o_orderkey").alias("ord")
        )

    return findings.merge_gaps([gaps("F"), gaps("O")], scope=SINGLE)


@query
def risk_ids(b: Bound) -> DataFrame:
    existing = b.table("supplier").select(
        F.col("s_nationkey").alias("project_id"),
        F.when(F.col("s_acctbal") < 0, "RISK-OTHER-9999").otherwise(F.format_string("RISK-P-%03d", "s_suppkey")).alias("risk_id"),
    )
    claim_risk = b.order_project.select(
        "project_id", text_id("C", "o_orderkey").alias("target_id"), F.col("o_orderkey").alias("ord")
    )
    task_risk = b.table("customer").select(
        F.col("c_nationkey").alias("project_id"), text_id("K", "c_custkey").alias("target_id"), F.col("c_custkey").alias("ord")
    )
    return findings.number_risks([claim_risk, task_risk], existing=existing, prefix="P").select(
        "project_id", "risk_id", "target_id"
    )


@query
def rule_first_violation(b: Bound) -> DataFrame:
    violation = b.table("lineitem").filter(F.col("l_returnflag") == "R").select(
        text_id("RULE-", "l_suppkey").alias("rule_id"),
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("message"),
        F.col("l_partkey").cast("string").alias("evidence_id"), F.col("l_orderkey").alias("ord"),
    )
    return findings.violation_risks(violation, scope=SINGLE).select("target_id", "description", "severity")


def _gaps(b: Bound) -> DataFrame:
    """Requirement, criterion and task gaps of all projects."""
    requirement = coverage.requirement_gaps(coverage.requirement_coverage(b.requirement, b.task_cover, scope=SINGLE))
    criterion = coverage.criterion_gaps(coverage.criterion_coverage(b.criterion, b.test_cover, scope=SINGLE))
    return findings.merge_gaps([requirement, criterion, _task_gaps(b)])


def _task_gaps(b: Bound) -> DataFrame:
    return b.table("customer").filter(F.col("c_acctbal") < 0).select(
        F.col("c_nationkey").alias("project_id"), F.col("c_custkey").cast("string").alias("item_id"),
        F.lit("task").alias("item_type"), F.lit("no claim").alias("reason"),
        F.col("c_custkey").cast("string").alias("target_id"), F.lit("should").alias("severity"), F.col("c_custkey").alias("ord"),
    )


@query
def risks_from_gaps(b: Bound) -> DataFrame:
    out = findings.number_risks([findings.gap_risks(_gaps(b), prefix="P")], prefix="P", materialise=cut_lineage)
    return out.select("project_id", "risk_id", "description", "severity", "evidence_id")


@query
def enriched_risks(b: Bound) -> DataFrame:
    risk = claims.claim_risks(claims.reference_findings(b.claim, b.evidence_ref, b.claim_evidence, scope=SINGLE), scope=SINGLE)
    out = findings.enrich_claim_risks(risk)
    return out.groupBy("risk_category", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("business_impact") > 0).alias("has_impact"),
        F.max(F.col("description")).alias("last_description"),
    )


def _affected_orders(b: Bound) -> DataFrame:
    return b.order_project.filter(F.col("o_totalprice") > 450000).select(
        "project_id", F.col("o_orderkey").cast("string").alias("item_id")
    )


def _cover_keys(b: Bound) -> DataFrame:
    """Orders some returned line covers."""
    returned = b.table("lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    lines = dealt(returned, "o_orderkey").distinct()
    return b.order_project.join(lines, "o_orderkey", "left_semi").select(
        "project_id", F.col("o_orderkey").cast("string").alias("item_id")
    )


def _actions(b: Bound) -> DataFrame:
    gap = findings.gap_urgency(_gaps(b), _affected_orders(b), _cover_keys(b))
    risk = b.order_project.filter(F.col("o_orderstatus") == "P").select(
        "project_id", text_id("R", "o_orderkey").alias("risk_id"), F.col("o_orderkey").cast("string").alias("claim_id"),
        F.when(F.col("o_orderpriority").startswith("1"), "must").otherwise("should").alias("severity"),
        F.lit("late").alias("description"), (F.col("o_totalprice") < 20000).alias("stale"), F.col("o_orderkey").alias("ord"),
    )
    risk = findings.risk_urgency(risk, _affected_orders(b), _cover_keys(b))
    return findings.gap_actions(gap).unionByName(findings.risk_actions(risk))


@query
def urgent_actions(b: Bound) -> DataFrame:
    return findings.rank_actions(_actions(b), materialise=cut_lineage).select("project_id", "position", "priority", "type", "item_id", "urgency")


@query
def action_counts(b: Bound) -> DataFrame:
    return findings.action_counts(_actions(b))


def _project_decision(b: Bound) -> DataFrame:
    user = b.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("project_id"))
    return b.decision.join(user, "user_id").drop("user_id")


@query
def decisions_applied(b: Bound) -> DataFrame:
    return findings.decisions_applied(_project_decision(b))


@query
def pending_decisions(b: Bound) -> DataFrame:
    gap = coverage.criterion_gaps(coverage.criterion_coverage(b.criterion, b.test_cover, scope=SINGLE))
    risk = b.order_project.filter(F.col("o_orderstatus") == "P").select(
        "project_id", text_id("C", "o_orderkey").alias("claim_id"), F.lit("late").alias("description"),
        F.lit("should").alias("severity"), (F.col("o_totalprice") < 100000).alias("stale"),
    )
    rule = b.table("customer").select(
        F.col("c_nationkey").alias("project_id"), text_id("K", "c_custkey").alias("rule_id"),
        (F.col("c_acctbal") < 0).alias("stale_acceptance"),
    )
    decided = _project_decision(b).select(
        "project_id", ids.decision_key(F.lit("uncovered_ac"), F.col("targetId")).alias("decision_key")
    )
    return findings.pending_decisions(gap, risk, rule, decided).select("project_id", "category", "target_id", "severity")


@query
def decision_keys_compat(b: Bound) -> DataFrame:
    """Four-digit decision ids and how many targets share each."""
    keys = b.table("customer").select(
        ids.decision_key(F.lit("uncovered_ac"), text_id("AC-P-", "c_custkey"), compat=True).alias("decision_key")
    )
    return keys.groupBy("decision_key").agg(F.count(F.lit(1)).alias("n_targets"))


@query
def related_code(b: Bound) -> DataFrame:
    link = b.table("customer").select(text_id("K", "c_custkey").alias("task_id"), text_id("AC-", "c_nationkey").alias("ac_id"))
    refs = b.table("lineitem").filter(F.col("l_returnflag") != "R").select(
        text_id("C", "l_orderkey").alias("claim_id"), module_file("l_partkey").alias("ref"), F.col("l_linenumber").alias("pos")
    )
    return findings.related_files(link, b.claim, refs, n=3, scope=SINGLE).select("ac_id", "position", "path", "claim_id")


@query
def titled_gaps(b: Bound) -> DataFrame:
    titled = b.table("part").filter(F.col("p_size") > 10).select(
        F.col("p_partkey").alias("ac_id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord")
    )
    rows = b.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("ac_id"))
    return findings.with_titles(rows, titled, key="ac_id", name="ac_title", scope=SINGLE)


# --- gate -----------------------------------------------------------------------------------------


def _gate_parts(b: Bound) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One project per customer: a few orders each, so that decisions differ."""
    orders = b.table("orders").withColumn("project_id", F.col("o_custkey"))
    criterion = orders.select(
        "project_id", F.col("o_orderkey").alias("ac_id"), priority_of("o_orderpriority").alias("priority"),
        (F.col("o_totalprice") >= 450000).alias("is_testing_required"), F.col("o_orderkey").alias("ord"),
    )
    gaps = coverage.criterion_gaps(coverage.criterion_coverage(criterion, b.test_cover, scope=SINGLE))
    requirement = orders.select(
        "project_id", F.col("o_orderkey").alias("req_id"), F.col("o_orderstatus").alias("title"),
        priority_of("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("ord"),
    )
    req_gaps = coverage.requirement_gaps(coverage.requirement_coverage(requirement, b.task_cover, scope=SINGLE))
    gap = findings.merge_gaps([req_gaps, gaps])
    late = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 490000)
    risk = orders.select(
        "project_id", text_id("R", "o_orderkey").alias("risk_id"), F.lit(None).cast("string").alias("claim_id"),
        F.when(~late, "unclear").when(F.col("o_orderpriority").startswith("1"), "must").otherwise("could").alias("severity"),
        F.lit("late order").alias("description"), F.col("o_orderkey").cast("string").alias("target_id"),
        F.lit("act").alias("suggested_action"), F.lit("cost").alias("business_impact"), F.col("o_orderkey").alias("ord"),
    )
    decision = dealt(b.decision.withColumn("project_id", F.col("user_id")), "project_id", "targetId")
    rows = gate.gap_findings(gap, decision).unionByName(gate.risk_findings(risk, decision))
    project = b.table("customer").select(
        F.col("c_custkey").alias("project_id"), F.when(F.col("c_acctbal") < -700, "draft").otherwise("active").alias("status")
    )
    return project, rows, decision


@query
def gate_by_account(b: Bound) -> DataFrame:
    project, rows, decision = _gate_parts(b)
    return gate.gate_result(project, rows, decision)


def _gate_with_reasons(b: Bound) -> tuple[DataFrame, DataFrame]:
    """Decisions and reasons; findings and decisions are read several times, so each is computed once."""
    project, rows, decision = _gate_parts(b)
    rows = cut_lineage(rows)
    result = cut_lineage(gate.gate_result(project, rows, decision))
    return result, gate.gate_reasons(result, rows)


@query
def gate_reasons(b: Bound) -> DataFrame:
    return _gate_with_reasons(b)[1].select("project_id", "seq", "code", "item_id", "effect")


@query
def gate_by_project(b: Bound) -> DataFrame:
    """Flagship: which projects may merge, and how many findings stand against it."""
    decision = _project_decision(b)
    risk = claims.claim_risks(claims.reference_findings(b.claim, b.evidence_ref, b.claim_evidence, scope=SINGLE), scope=SINGLE)
    # A claim's risks need its project: claims are the unique side.
    project_of = b.order_project.select(text_id("C", "o_orderkey").alias("claim_id"), "project_id")
    advised = findings.enrich_claim_risks(risk).join(project_of, "claim_id").withColumn("risk_id", F.lit(None).cast("string"))
    rows = gate.gap_findings(_gaps(b), decision).unionByName(gate.risk_findings(advised, decision))
    project = b.table("nation").select(F.col("n_nationkey").alias("project_id"), F.lit("active").alias("status"))
    return gate.gate_result(project, rows, decision)


def _stored_ledgers(b: Bound, buckets: int = 16) -> LedgerStore:
    """The ledgers the gate reads, bucketed by project and item; evidence as counts per status."""
    store = LedgerStore(b.spark, buckets=buckets)
    project_of = b.order_project.select(F.col("o_orderkey").alias("item_id"), "project_id")

    def counts(cover: DataFrame) -> DataFrame:
        # Counted before the project is looked up: an item belongs to one project.
        counted = rollup.status_counts(cover, scope=SINGLE).join(project_of, "item_id")
        return counted.withColumn("item_id", F.col("item_id").cast("string"))

    def keyed(rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn(key, F.col(key).cast("string"))

    in_project = b.order_project.select(text_id("C", "o_orderkey").alias("claim_id"), "project_id")
    store.put("requirement", keyed(b.requirement, "req_id"), ["project_id", "req_id"])
    store.put("criterion", keyed(b.criterion, "ac_id"), ["project_id", "ac_id"])
    store.put("task_cover", counts(b.task_cover), ["project_id", "item_id"])
    store.put("test_cover", counts(b.test_cover), ["project_id", "item_id"])
    store.put("claim", b.claim.join(in_project, "claim_id").select("project_id", "claim_id", "claimed_status", "ord"), ["project_id", "claim_id"])
    store.put("evidence_ref", b.evidence_ref.join(in_project, "claim_id"), ["project_id", "claim_id"])
    store.put("decision", _project_decision(b), ["project_id", "targetId"])
    return store


def gate_of_store(b: Bound, store: LedgerStore) -> DataFrame:
    requirement = coverage.requirement_coverage(store.table("requirement"), store.table("task_cover"), weight=rollup.COUNT)
    criterion = coverage.criterion_coverage(store.table("criterion"), store.table("test_cover"), weight=rollup.COUNT)
    gap = findings.merge_gaps([coverage.requirement_gaps(requirement), coverage.criterion_gaps(criterion), _task_gaps(b)])
    decision = store.table("decision")
    found = claims.reference_findings(store.table("claim"), store.table("evidence_ref"), b.claim_evidence, evidence_scope=SINGLE)
    risk = findings.enrich_claim_risks(claims.claim_risks(found)).withColumn("risk_id", F.lit(None).cast("string"))
    rows = gate.gap_findings(gap, decision).unionByName(gate.risk_findings(risk, decision))
    project = b.table("nation").select(F.col("n_nationkey").alias("project_id"), F.lit("active").alias("status"))
    return gate.gate_result(project, rows, decision)


@query
def gate_from_store(b: Bound) -> DataFrame:
    """The flagship over ledgers kept in buckets: stored once, then joined without exchanges."""
    return gate_of_store(b, _stored_ledgers(b))


@query
def run_flags(b: Bound) -> DataFrame:
    project, rows, decision = _gate_parts(b)
    result = gate.gate_result(project, rows, decision)
    orders = b.table("orders").withColumn("project_id", F.col("o_custkey"))
    gap = orders.select(
        _own_or_other("o_custkey", F.col("o_orderstatus") == "F"), F.when(F.col("o_totalprice") > 300000, "ac").otherwise("claim").alias("item_type")
    )
    risk = orders.select(
        "project_id", F.when(F.col("o_orderpriority").startswith("1"), "must").otherwise("should").alias("severity"),
        F.when(F.col("o_totalprice") < 5000, "low_confidence").alias("confidence"),
    )
    unclear, violation, uncovered = (
        orders.select(_own_or_other("o_custkey", said))
        for said in (F.col("o_totalprice") > 495000, F.col("o_totalprice") < 2000, F.col("o_orderpriority").startswith("5"))
    )
    return findings.run_flags(result, gap, risk, unclear, violation, uncovered)


# --- compliance -----------------------------------------------------------------------------------


@query
def boundary_violations(b: Bound) -> DataFrame:
    out = compliance.boundary_violations(b.nation_edge, b.nation_module, scope=SINGLE)
    return out.select("from_module", "to_module", "violation", "n_lines")


@query
def module_status(b: Bound) -> DataFrame:
    # Thin edges count as edges inside their module.
    edge = b.nation_edge.withColumn("to_module", F.when(F.col("n_lines") > 100, F.col("to_module")).otherwise(F.col("from_module")))
    broken = compliance.boundary_violations(edge, b.nation_module, scope=SINGLE).filter(F.col("violation") == "forbidden")
    return compliance.module_status(b.nation_module, broken, scope=SINGLE).select("rule_id", "status")


def _part_edge(b: Bound) -> DataFrame:
    part = b.table("part").select(
        F.col("p_partkey").alias("l_partkey"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("imported_module"),
        F.col("p_brand").alias("to_module"),
    )
    return b.table("lineitem").select(
        F.col("l_orderkey").alias("file_path"), "l_partkey", F.col("l_linenumber").alias("lineno"),
        F.col("l_returnflag").alias("from_module"),
    ).join(part, "l_partkey")


@query
def banned_dependencies(b: Bound) -> DataFrame:
    edge = _part_edge(b).withColumn("from_module", F.when(F.col("from_module") == "A", "Brand#1").otherwise(F.col("from_module")))
    out = compliance.runtime_imports(edge, adapter_module="Brand#1", tokens=("widget", "ring"))
    return out.groupBy("violation", "from_module", "imported_module").agg(F.count(F.lit(1)).alias("n"))


@query
def banned_packages(b: Bound) -> DataFrame:
    out = compliance.banned_packages(_part_edge(b), ("red", "hot"))
    return out.select("file_path", "lineno", "l_partkey", "root_package")


@query
def external_resources(b: Bound) -> DataFrame:
    relative = r"""(?i)((?:href|src)\s*=\s*["']/[^"'/][^"']*["'])"""
    out = compliance.external_resources(b.table("pages"), pattern=relative)
    return out.select("page_id", F.col("n_urls").cast("bigint").alias("n_urls"), F.array_join("urls", " ").alias("urls"))


@query
def missing_inputs(b: Bound) -> DataFrame:
    project = b.table("customer").select(F.col("c_custkey").alias("project_id"))
    key = F.col("o_orderstatus")
    manifest = b.table("orders").select(
        F.col("o_custkey").alias("project_id"),
        F.when(key == "F", "prd").when(key == "O", "architecture_constraints").otherwise("task_list").alias("file_key"),
        F.when(F.col("o_totalprice") > 100000, "ok").otherwise("missing").alias("status"),
    )
    return compliance.missing_inputs(project, manifest)


@query
def evidence_for_paths(b: Bound) -> DataFrame:
    path = b.table("customer").select(F.concat(F.lit("/repo/src/"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"))
    evidence = b.table("part").select(
        F.when(F.col("p_size") <= 10, module_file("p_partkey"))
        .when(F.col("p_size") > 20, F.concat(F.lit("lib/"), F.col("p_partkey").cast("string"), F.lit(".pyi")))
        .otherwise(F.concat(F.lit("other/repo/src/"), F.col("p_partkey").cast("string"), F.lit(".py"))).alias("source_path"),
        text_id("E", "p_partkey").alias("evidence_id"), F.col("p_partkey").alias("ord"),
    )
    return compliance.evidence_for_paths(path, evidence, prefix="P", scope=SINGLE).select("path", "evidence_id")


def _classified(b: Bound) -> DataFrame:
    checks = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.1)
    checked = b.table("lineitem").select(F.when(checks, text_id("RULE-", "l_partkey")).otherwise(text_id("LINE-", "l_orderkey")).alias("rule_id"))
    return compliance.classify_rules(b.rule, checked, as_of=F.lit(AS_OF).cast("timestamp"), scope=SINGLE)


@query
def rule_status(b: Bound) -> DataFrame:
    return _classified(b).select("project_id", "rule_id", "section", "classification", "stale_acceptance")


@query
def must_rollup(b: Bound) -> DataFrame:
    status = b.table("part").select(
        F.col("p_brand").alias("project_id"),
        F.when((F.col("p_type") == "PROMO") & (F.col("p_size") == 7), "violated")
        .when((F.col("p_type") == "SMALL") & (F.col("p_size") == 9), "unclear").otherwise("compliant").alias("status"),
        F.when(F.col("p_retailprice") < 980, "must").otherwise("should").alias("severity"),
    )
    return compliance.must_rollup(status.select("project_id").distinct(), status, prefix="P")


@query
def import_edges(b: Bound) -> DataFrame:
    """Sources built per customer: every form of import, and imports that are none."""
    source = b.table("customer").select(
        F.concat(
            F.lit("import os, pkg."), F.col("c_mktsegment"), F.lit(" as m\n  from pkg.n"), F.col("c_nationkey").cast("string"),
            F.lit(" import x\nfrom . import y\nfrom .sub import z\n# import no\nvalue = 1\n"),
            F.lit('''def f():\n    """Docs.\n    import no\n    """\n    import late, \\\n        more.'''), F.col("c_nationkey").cast("string"),
            F.lit(" as k\ntext = 'it\\'s \\\nimport no'; import after\nfrom lists import (a,  # 'import no\n    b)\n"),
            F.lit("again = '''\nimport no\n'''\nif value: import last; from x . y import z\n"),
        ).alias("text"),
        text_id("f", "c_custkey").alias("path"),
    )
    return compliance.import_edges(source, scope=SINGLE)


# --- constraints, ids, texts ----------------------------------------------------------------------


@query
def id_checks(b: Bound) -> DataFrame:
    segment = F.col("c_mktsegment")
    key = F.col("c_custkey").cast("string")
    id_ = (
        F.when(segment == "BUILDING", F.concat(F.lit("AC-P-"), F.col("c_nationkey").cast("string"), F.lit("-"), key))
        .when(segment == "AUTOMOBILE", F.concat(F.lit("TASK-P-"), key))
        .when(segment == "FURNITURE", F.concat(F.lit("REQ-X-"), key))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("DOC-"), key))
        .otherwise(F.lit(" "))
    )
    return b.table("customer").select(
        "c_custkey", ids.id_type(id_, "P").alias("id_type"), ids.id_problem(id_, "P").alias("problem"),
        ids.parent_requirement(id_).alias("parent"),
    )


@query
def covers_from_text(b: Bound) -> DataFrame:
    text = F.concat(
        F.lit("Checks an order.\nCovers: ac-p-"), F.col("o_custkey").cast("string"), F.lit("-1, REQ-P-"),
        F.col("o_orderkey").cast("string"), F.lit(" and AC-P-"), F.col("o_custkey").cast("string"),
        F.lit("-1\nAC-P-9-9 is named elsewhere\nxAC-P-1-1 covers nothing"),
    )
    return b.table("orders").select("o_orderkey", F.array_join(tx.covered_ids(text, "P"), ",").alias("covers"))


@query
def constraint_checks(b: Bound) -> DataFrame:
    rows = b.table("orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"), F.split("o_orderpriority", "-").alias("parts"),
        F.col("o_orderkey").alias("ord"),
    )
    checks = [
        constraints.Check("status", "required"),
        constraints.Check("priority", "enum", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")),
        constraints.Check("priority", "pattern", r"^\d-[A-Z]+$"),
        constraints.Check("priority", "max_length", 10),
        constraints.Check("price", "minimum", 5000),
        constraints.Check("parts", "item_pattern", "^([12345]|[A-Z]{3,6})$"),
    ]
    out = constraints.check_rows(rows, checks, table="orders", key="o_orderkey", scope=SINGLE)
    return out.select("key", "field_path", "rule", "value")


@query
def claim_problems(b: Bound) -> DataFrame:
    rows = b.table("orders").select(
        F.concat(F.when(F.col("o_orderstatus") == "P", "CLAIM-Q-").otherwise("CLAIM-P-"), F.col("o_orderkey").cast("string")).alias("claim_id"),
        F.concat(F.when(F.col("o_orderpriority").startswith("5"), "JOB-").otherwise("TASK-P-"), F.col("o_custkey").cast("string")).alias("related_task"),
        F.when(F.col("o_totalprice") > 250000, "covered").otherwise("partial").alias("claimed_status"),
        F.array(
            F.concat(F.when(F.col("o_orderpriority").startswith("1"), "CLAIM-P-").otherwise("EVIDENCE-P-"), F.col("o_orderkey").cast("string"))
        ).alias("evidence_refs"),
    )
    return constraints.claim_problems(rows, prefix="P", scope=SINGLE)


@query
def task_problems(b: Bound) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = b.table("customer").select(
        text_id("TASK-P-", "c_custkey").alias("task_id"),
        F.when(F.col("c_acctbal") < 0, none).otherwise(F.array(F.lit("REQ-P-1"))).alias("related_requirements"),
        F.when(F.col("c_nationkey") < 12, none).otherwise(F.array(F.lit("AC-P-1-1"))).alias("related_acceptance_criteria"),
        F.when(F.col("c_mktsegment") == "BUILDING", none).otherwise(F.array(F.lit("MOD-P-1"))).alias("related_modules"),
        F.when(F.col("c_acctbal") > 5000, "done").otherwise("todo").alias("status"),
    )
    return constraints.task_problems(rows, prefix="P", strict_links=True, scope=SINGLE)


@query
def test_scenarios(b: Bound) -> DataFrame:
    title = F.concat(F.lit("order is "), F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "an error").otherwise("new"),
                     F.when(F.col("o_totalprice") < 50000, " and empty").otherwise(""))
    rows = b.table("orders").select(F.explode(tx.test_scenarios(title)).alias("scenario"))
    return rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))


@query
def health_report(b: Bound) -> DataFrame:
    evidence = b.part_evidence.select("evidence_id")
    snapshot = b.table("part").select(
        F.when(F.col("p_size") <= 45, module_file("p_partkey")).otherwise(F.concat(F.lit("gone/"), module_file("p_partkey"))).alias("path"))
    task_link = b.table("orders").select(
        F.col("o_orderkey").alias("task_id"), text_id("K", "o_custkey").alias("req_id"),
        F.substring("o_orderpriority", 3, 20).alias("ac_id"),
    )
    criteria = b.table("orders").select(F.when(F.col("o_totalprice") > 499000, F.substring("o_orderpriority", 3, 20)).otherwise("none").alias("ac_id"))
    modules = b.table("part").select(F.when(F.col("p_size") <= 30, text_id("MOD-", "p_size")).otherwise("MOD-none").alias("module_id"))
    issues = [
        health.evidence_ref_issues(b.evidence_ref, evidence, snapshot, scope=SINGLE),
        health.file_ref_issues(b.file_ref, snapshot, scope=SINGLE),
        health.link_issues(task_link, b.task_evidence.withColumnRenamed("task_id", "req_id"), check="requirement_mapping", ref="req_id", scope=SINGLE),
        health.link_issues(task_link, criteria, check="ac_mapping", ref="ac_id", scope=SINGLE),
        health.unchecked_rule_issues(b.rule, modules, scope=SINGLE),
    ]
    return health.health_report(issues, scope=SINGLE)


# --- sources --------------------------------------------------------------------------------------


def _customer_document(b: Bound) -> DataFrame:
    """A requirements document per customer, built from its row."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    req = F.concat(F.lit("REQ-P-"), nation)
    priority = F.when(F.col("c_acctbal") < 0, "Could").when(F.col("c_mktsegment") == "MACHINERY", "urgent").otherwise("must")
    category = F.when(F.col("c_mktsegment") == "BUILDING", "quality_evolution").otherwise("functional")
    flag = F.when(F.col("c_acctbal") > 2000, "是").otherwise("否")
    text = F.concat(
        F.lit("---\nstatus: "), F.when(F.col("c_acctbal") < -500, '"draft"').otherwise("active"),
        F.lit("\n# note: no\nproject_name: '"), F.col("c_name"), F.lit("'\nproject_prefix: P\n---\n# Title\n\n### "),
        req, F.lit("： "), F.col("c_name"), F.lit("\n\n#### 优先级\n\n"), priority, F.lit("\n\n#### 类别\n\n"), category,
        F.lit("\n\n##### AC-P-"), nation, F.lit("-"), key, F.lit(": works\n\n- 说明\n- 是否必须有测试："), flag,
        F.lit("\n\n## Rest\n\n- 是否必须有测试：是\n"),
    )
    return b.table("customer").select(F.lit(1).alias("project_id"), F.col("c_custkey").alias("doc_id"), text.alias("text"))


@query
def sections_from_documents(b: Bound) -> DataFrame:
    lines = cut_lineage(documents.document_lines(_customer_document(b), prefix="P"))
    requirement = documents.parse_requirements(lines).select("doc_id", "req_id", "title", "priority", "category")
    criterion = documents.parse_criteria(lines).select("doc_id", "req_id", "ac_id", "is_testing_required")
    return requirement.join(criterion, ["doc_id", "req_id"])


@query
def front_matter(b: Bound) -> DataFrame:
    return documents.project_documents(_customer_document(b)).select("doc_id", "status", "project_name", "id_prefix")


def _order_runs(b: Bound, category: str) -> DataFrame:
    """A tool run per order, its report built from the order."""
    price = F.col("o_totalprice")
    outcome = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    report = F.concat(
        F.lit('{"tests": [{"nodeid": "t.py::test_'), F.col("o_orderkey").cast("string"), F.lit('", "outcome": "'), outcome,
        F.lit('", "metadata": {"docstring": "covers REQ-P-'), F.col("o_custkey").cast("string"),
        F.lit('"}}, {"nodeid": "", "outcome": "error"}]}'),
    )
    stdout = {
        "test": F.lit("no json"),
        "lint": F.when(F.col("o_orderstatus") == "F", "[]").when(F.col("o_orderstatus") == "O", '[{"code": "E1"}, {"code": "E2"}]')
        .otherwise('{"issues": [{"code": "E3"}]}'),
        "type_check": F.when(F.col("o_orderstatus") == "F", "a.py:1: error: x\nb.py:2: error: y\nnote").otherwise("fine"),
        "security": F.when(F.col("o_orderstatus") == "F", '{"results": [{"issue_text": "x"}]}').otherwise('{"results": []}'),
    }[category]
    return b.table("orders").select(
        F.lit(1).alias("project_id"), text_id("f", "o_orderkey").alias("path"), F.lit(category).alias("tool_category"),
        F.when(price < 100000, 0).when(price < 450000, 1).when(price < 480000, 2).otherwise(3).alias("exit_code"),
        stdout.alias("stdout"), F.lit("").alias("stderr"),
        F.when(F.col("o_orderpriority").startswith("1"), F.lit(None)).otherwise(report).alias("report")
        if category == "test" else F.lit(None).cast("string").alias("report"),
        F.col("o_orderkey").alias("ord"),
    )


@query
def test_report_scan(b: Bound) -> DataFrame:
    out = reports.test_evidence(_order_runs(b, "test"), prefix="P")
    return out.select("ord", "source_path", "status", "outcome", F.array_join("covers", ",").alias("covers"))


@query
def tool_report_scan(b: Bound) -> DataFrame:
    runs = _order_runs(b, "lint").unionByName(_order_runs(b, "type_check")).unionByName(_order_runs(b, "security"))
    out = reports.tool_evidence(runs, prefix="P")
    return out.select("ord", "tool_category", "source_path", "status", "error_code", "n_findings")


@query
def evidence_run_summary(b: Bound) -> DataFrame:
    runs = _order_runs(b, "lint").unionByName(_order_runs(b, "type_check")).unionByName(_order_runs(b, "test"))
    return reports.evidence_run_summary(reports.tool_evidence(runs, prefix="P"))


@query
def coverage_report_scan(b: Bound) -> DataFrame:
    text = F.concat(
        F.lit('{"files": {"src/'), F.col("c_custkey").cast("string"), F.lit('.py": {"percent_covered": '),
        F.col("c_nationkey").cast("string"), F.lit('.5, "num_statements": 10}, "src/b.py": {"num_statements": 3}, "src/c.py": {"percent_covered": 80}}}'),
    )
    rows = b.table("customer").select(F.lit(1).alias("project_id"), text.alias("text"), F.col("c_custkey").alias("ord"))
    out = reports.coverage_evidence(rows, threshold=15.0)
    return out.select("ord", "source_path", "status", "percent_covered", F.col("num_statements").cast("bigint").alias("num_statements"))


@query
def tool_work_list(b: Bound) -> DataFrame:
    refs = b.file_ref
    present = b.table("part").filter(F.col("p_size") <= 45).select(module_file("p_partkey").alias("path"))
    return reports.work_list(refs, present, b.changed_file, scope=SINGLE).select("path", "path_type")


@query
def missing_reports(b: Bound) -> DataFrame:
    files = b.table("part").select(
        module_file("p_partkey").alias("path"),
        F.when(F.col("p_type") == "ECONOMY", "test").when(F.col("p_type") == "PROMO", "other").otherwise("source").alias("path_type"),
    )
    expected = reports.expected_reports(files, ["test", "lint", "security"], scope=SINGLE)
    runs = b.table("lineitem").select(
        module_file("l_partkey").alias("path"),
        F.when(F.col("l_discount") < 0.09, "type_check").when(F.col("l_linestatus") == "F", "test").when(F.col("l_returnflag") == "A", "lint").otherwise("security").alias("tool_category"),
    )
    return reports.missing_reports(expected, runs, scope=SINGLE)


@query
def claim_test_results(b: Bound) -> DataFrame:
    refs = b.test_ref
    run = b.table("part").filter(F.col("p_type") == "ECONOMY").groupBy("p_size").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_brand") == "Brand#1").alias("bad")
    ).select(
        text_id("S", "p_size").alias("path"), F.when(F.col("bad") > 0, 1).otherwise(0).alias("exit_code"),
        F.concat(F.lit("== "), (F.col("n") - F.col("bad")).cast("string"), F.lit(" passed, "), F.col("bad").cast("string"), F.lit(" failed in 1s")).alias("stdout"),
        (F.col("p_size") == 13).alias("timed_out"),
    )
    present = b.table("part").filter(F.col("p_size") <= 40).select(text_id("S", "p_size").alias("path"))
    return reports.claim_test_results(refs, run, present, scope=SINGLE)


@query
def unknown_extensions(b: Bound) -> DataFrame:
    host_path = b.table("pages").select(F.col("page_id"), F.substring_index(F.substring_index("url", "?", 1), "#", 1).alias("path"))
    return reports.unknown_extensions(host_path, scope=SINGLE)


@query
def normalised_refs(b: Bound) -> DataFrame:
    url = F.col("url")
    return b.table("pages").select(
        "page_id", tx.without_fragment(url).alias("without_fragment"), tx.base_name(tx.without_fragment(url)).alias("base_name"),
        tx.relative_path(url, F.lit("https://m.ththth.example.net/")).alias("relative"), tx.clip(F.col("html")).alias("clipped"),
        tx.clean_title(F.concat(F.lit(" ：: "), url, F.lit(" :： "))).alias("title"),
    )


@query
def input_manifest(b: Bound) -> DataFrame:
    """Documents as files: every labelled or short document is expected, some under another name."""
    document = b.table("documents").withColumn("project_id", F.col("source"))
    file = document.select(
        "project_id", text_id("doc/", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"), F.sha2("text", 256).alias("sha256")
    )
    name = F.when(F.col("lang") == "de", text_id("doc/x", "doc_id")).when(F.col("lang") == "es", text_id("doc/", "doc_id"))
    expected = document.select(
        "project_id", F.col("doc_id").cast("string").alias("file_key"),
        F.coalesce(name, text_id("doc/", "doc_id")).alias("path"), (F.col("n_chars") < 1000).alias("is_required"),
    )
    return ledgers.input_manifest(expected, file).select("project_id", "file_key", "status", "error_code", "sha256")


@query
def manifest_errors(b: Bound) -> DataFrame:
    status = F.when(F.col("lang") == "de", "missing").when(F.col("lang") == "es", "parse_error").otherwise("ok")
    rows = b.table("documents").select(F.col("source").alias("project_id"), status.alias("status"), (F.col("n_chars") < 1000).alias("is_required"))
    return ledgers.manifest_errors(rows)


def _quoted(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query
def tasks_from_documents(b: Bound) -> DataFrame:
    """A task list per customer, built from its row; the negative balances hold broken JSON."""
    key = F.col("c_custkey")
    text = F.when(F.col("c_acctbal") < 0, "{").otherwise(
        _quoted('{"tasks": [{"task_id": "TASK-P-', key, '", "status": "done", "related_requirements": ["REQ-P-', F.col("c_nationkey"),
                '", "REQ-P-99"]}, {"task_id": "TASK-P-9999"}, {"task_id": "TASK-P-', key, '1", "title": "', F.col("c_name"), '"}]}')
    )
    rows = ledgers.tasks_from(b.table("customer").select(F.col("c_nationkey").alias("project_id"), text.alias("text")))
    return rows.select("project_id", "task_id", "title", "status", F.array_join("related_requirements", ",").alias("requirements"), "ord")


@query
def claims_from_documents(b: Bound) -> DataFrame:
    key = F.col("o_orderkey")
    text = _quoted('[{"claim_id": "CLAIM-P-', key, '", "related_task": "TASK-P-', F.col("o_custkey"), '", "timestamp": "',
                   F.date_format("o_orderdate", "yyyy-MM-dd"), 'T02:00:00+02:00", "code_refs": ["a.py", "b.py#L', key, '"]}, {"claim_id": "CLAIM-P-9999"}]')
    rows = ledgers.claims_from(b.table("orders").select(F.lit(1).alias("project_id"), text.alias("text")))
    return rows.select("claim_id", "related_task", "claimed_ts", F.array_join("code_refs", ",").alias("code_refs"), F.size("test_refs").alias("n_tests"), "ord")


def _rule_document(b: Bound) -> DataFrame:
    key = F.col("c_custkey")
    text = _quoted(
        '{"security_rules": [{"rule_id": "S-', key, '", "severity": "must", "related_requirements": ["REQ-P-', F.col("c_nationkey"),
        '"]}], "quality_gates": [{"gate_id": "G-', key, '", "verification_method": "manual", "note": {"related_requirements": ["REQ-P-77"]}}], ',
        '"module_boundaries": [{"module_id": "M-', key, '", "owned_files": ["f.py"], "allowed_to_call": []}], ',
        '"governance_boundary": {"included_patterns": ["src/', F.col("c_mktsegment"), '/**"], "excluded_patterns": []}}')
    return b.table("customer").select(key.alias("project_id"), text.alias("text"))


@query
def rules_from_documents(b: Bound) -> DataFrame:
    return ledgers.rules_from(_rule_document(b)).select("project_id", "section", "rule_id", "severity", "verification_method")


@query
def modules_from_documents(b: Bound) -> DataFrame:
    return ledgers.modules_from(_rule_document(b)).select(
        "project_id", "module_id", F.array_join("owned_files", ",").alias("files"), F.size("allowed_to_call").alias("n_allowed"),
        F.col("forbidden_to_call").isNull().alias("no_forbidden_list"),
    )


@query
def scope_patterns(b: Bound) -> DataFrame:
    return ledgers.scope_patterns_from(_rule_document(b))


@query
def nested_requirement_links(b: Bound) -> DataFrame:
    return integrity.nested_requirement_links(_rule_document(b))


@query
def decisions_from_documents(b: Bound) -> DataFrame:
    """One log per event, wrapped or bare by its type; error events hold broken JSON."""
    kind = F.col("event_type")
    entry = _quoted('{"decision_id": ', F.col("event_id"), ', "action": "', kind, '", "targetId": "', F.get_json_object("props", "$.k"), '", "timestamp": "2024-01-01T00:00:00Z"}')
    text = F.when(kind == "error", F.concat(F.lit("["), entry)).when(kind == "view", _quoted("[", entry, "]")).otherwise(_quoted('{"decisions": [', entry, "]}"))
    rows = ledgers.decisions_from(b.table("events").select(F.col("user_id").alias("project_id"), text.alias("text")))
    return rows.select("project_id", "decision_id", "action", "targetId", "timestamp")


@query
def new_decision_ids(b: Bound) -> DataFrame:
    """Purchases are requests, sign-ups the existing log of each user."""
    request = b.table("events").filter(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("project_id"), F.lit("c").alias("category"), F.col("event_id").cast("string").alias("targetId"),
        F.when(F.col("value") < 50, "accept_risk").alias("action"), F.lit("r").alias("reason"), F.lit("d").alias("decidedBy"),
        F.col("ts").alias("timestamp"),
    )
    log = b.table("events").filter(F.col("event_type") == "signup").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("decision_id"))
    return ledgers.new_decisions(request, log).select("project_id", "decision_id", "targetId")


@query
def changed_files_from_listings(b: Bound) -> DataFrame:
    listing = b.table("pages").select(F.col("page_id").alias("project_id"), F.concat(F.lit(" "), F.col("url"), F.lit(" \n\nb.py\r\nb.py")).alias("text"))
    return ledgers.changed_files(listing)


@query
def drift_findings(b: Bound) -> DataFrame:
    # Read by three kinds of findings, whose joins would all run in one task of the union otherwise.
    drift = cut_lineage(baseline_drift(b))
    risks = delta.drift_risks(drift).select("project_id", F.lit("risk").alias("kind"), "severity")
    gaps = delta.drift_gaps(drift).select("project_id", F.lit("gap").alias("kind"), "severity")
    logged = b.table("orders").select(
        F.col("o_custkey").alias("project_id"),
        F.when(F.col("o_totalprice") > 490000, "docs/architecture_change_log.md").otherwise("docs/other.md").alias("path"),
    )
    late = delta.undocumented_changes(drift, logged).select("project_id", F.lit("undocumented").alias("kind"), F.lit("must").alias("severity"))
    return risks.unionByName(gaps).unionByName(late)


def _own_or_other(key: str, own: Column) -> Column:
    """The project of a row, or one that does not exist where the row says nothing about its own."""
    return F.when(own, F.col(key)).otherwise(-F.col(key) - 1).alias("project_id")


@query
def lock_baseline(b: Bound) -> DataFrame:
    customer = b.table("customer").withColumn("project_id", F.col("c_custkey"))
    config = customer.filter(F.col("c_nationkey") > 5).select(
        "project_id", F.when(F.col("c_mktsegment") == "BUILDING", "js").otherwise("py").alias("language"),
        F.array(F.lit("test"), F.lit("lint")).alias("validation_tools"),
        F.when(F.col("c_acctbal") > 2000, "h").otherwise("old").alias("architecture_constraints_hash"), F.lit("p").alias("prd_hash"),
    )
    proposal = customer.select(
        "project_id", F.when(F.col("c_mktsegment") == "FURNITURE", "go").otherwise("py").alias("language"),
        F.array(F.lit("py"), F.lit("js")).alias("tool_languages"), F.array(F.lit("lint"), F.lit("test")).alias("tools"),
        F.lit("h").alias("rules_hash"), F.when(F.col("c_acctbal") > 9000, "new").otherwise("p").alias("prd_hash"),
    )
    late = b.table("orders").select(_own_or_other("o_custkey", F.col("o_totalprice") > 400000))
    out = delta.lock_baseline(config, proposal, late)
    return out.select("project_id", "outcome", "language", "architecture_constraints_hash", "prd_hash")


@query
def edge_modules(b: Bound) -> DataFrame:
    """Orders import the file of their customer's nation; each nation owns one file, nation 3 is a folder."""
    nation = F.col("project_id").cast("string")
    edge = b.order_project.select(
        F.concat(F.lit("src/app/"), F.when(F.col("o_orderstatus") == "F", "core/").otherwise(""), F.lit("f"), F.substring("o_orderpriority", 1, 1), F.lit(".py")).alias("file_path"),
        F.when(F.col("project_id") == 3, F.concat(F.lit("app.sub.f"), nation)).when(F.col("project_id") == 4, F.concat(F.lit("lib.f"), nation))
        .otherwise(F.concat(F.lit("app.f"), nation)).alias("imported_module"),
        F.col("o_orderkey").alias("lineno"),
    )
    module = b.table("nation").filter(F.col("n_nationkey") < 20).select(
        text_id("M", "n_nationkey").alias("module_id"), F.col("n_name").alias("name"),
        F.array(F.concat(text_id("f", "n_nationkey"), F.lit(".py"))).alias("owned_files"), F.col("n_nationkey").alias("ord"),
    )
    out = compliance.edge_modules(edge, module, package="app", folders={"sub": "MSUB"}, scope=SINGLE)
    return out.groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("n"))


@query
def rule_gate(b: Bound) -> DataFrame:
    """Gate of rule and coverage findings; projects are brands, three of them have a changed set."""
    part = b.table("part").withColumn("project_id", F.col("p_brand")).withColumn("ord", F.col("p_partkey"))
    rule = text_id("RULE-", "p_partkey").alias("rule_id")
    violation = part.filter(F.col("p_type") == "PROMO").select("project_id", rule, F.lit("bad").alias("message"), "ord")
    unclear = part.filter(F.col("p_type") == "SMALL").select("project_id", rule, F.lit("why").alias("reason"), "ord")
    status = part.select(
        "project_id", rule, "ord", F.lit("must").alias("severity"),
        F.when(F.col("p_size") % 5 == 2, "violated").when(F.col("p_size") % 5 == 4, "unclear").otherwise("compliant").alias("status"),
    )
    changed = part.filter(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select("project_id")
    low = part.filter(F.col("p_type") == "LARGE").select("project_id", module_file("p_partkey").alias("path"), (F.col("p_size") * 1.0).alias("percent_covered"), "ord")
    found = gate.rule_findings(violation, unclear, status, changed).unionByName(gate.coverage_findings(low))
    return found.groupBy("project_id", "code", "effect", "change_scope").agg(F.count(F.lit(1)).alias("n"))


@query
def run_metadata(b: Bound) -> DataFrame:
    result, reasons = _gate_with_reasons(b)
    reasons = cut_lineage(reasons.select("project_id", "seq", F.col("code").alias("reason")))
    manifest = result.select("project_id", F.lit("prd").alias("file_key"), F.lit("docs/prd.md").alias("path"), F.lit("ok").alias("status"))
    out = sinks.run_metadata(result, reasons, manifest, run_id="RUN-1", scan_time=F.lit(AS_OF).cast("timestamp"))
    return out.select("project_id", "run_id", "scan_time", "gate_decision", "exit_code", "n_reasons")


@query
def run_reasons(b: Bound) -> DataFrame:
    _, reasons = _gate_with_reasons(b)
    return sinks.run_reasons(reasons.select("project_id", "seq", F.col("code").alias("reason")), run_id="RUN-1")


@query
def fallback_actions(b: Bound) -> DataFrame:
    result, reasons = _gate_with_reasons(b)
    reasons = reasons.withColumn("reason", F.col("code"))
    high = b.table("orders").select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_totalprice") > 400000, "HIGH").otherwise("LOW").alias("priority"))
    return findings.reason_actions(result, reasons, high).select("project_id", "type", "detail", "urgency", "ord")


@query
def reusable_results(b: Bound) -> DataFrame:
    document = b.table("documents")
    previous = document.join(b.table("labels"), "doc_id").select(
        text_id("doc/", "doc_id").alias("path"), F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise("x"), 256).alias("file_hash"), "toxic"
    )
    snapshot = document.select(text_id("doc/", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return reports.reusable_results(previous, snapshot, scope=SINGLE)


# --- operators that the queries above do not reach ------------------------------------------------


@query
def skipped_refs(b: Bound) -> DataFrame:
    """References of brands to documents, sources and files without an extension."""
    size = F.col("p_size")
    end = F.when(size % 3 == 0, ".md").when(size % 3 == 1, ".py").otherwise("")
    refs = b.table("part").select(F.col("p_brand").alias("project_id"), F.concat(F.lit("doc/f"), (F.col("p_partkey") % 40).cast("string"), end, F.lit("#L3")).alias("ref"))
    return reports.skipped_refs(refs).select("project_id", "source_path", "status", "skip_reason")


@query
def active_gaps(b: Bound) -> DataFrame:
    late = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority").startswith("1"))
    return impact.active(b.order_project.withColumn("stale", late)).select("project_id", F.col("o_orderkey").alias("item_id"))


@query
def file_hashes(b: Bound) -> DataFrame:
    return b.table("documents").select("doc_id", file_hash(F.col("text")).alias("sha256"))


@query
def sentences_and_hints(b: Bound) -> DataFrame:
    text = F.concat(F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.col("p_name")), F.lit("。"), F.col("p_type"), F.lit("。"))
    hints = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("level1"), F.col("p_name"), F.lit("level2"), F.col("p_type"))).otherwise(
        F.create_map(F.lit("level3"), F.col("p_brand")))
    level = F.concat(F.lit("level"), (F.col("p_size") % 4).cast("string"))
    return b.table("part").select("p_partkey", tx.first_sentence(text).alias("sentence"), tx.hint_level(hints, level).alias("hint"))


@query
def presence_status(b: Bound) -> DataFrame:
    project = b.table("customer").select(F.col("c_custkey").alias("project_id"))
    violation = b.table("orders").select(F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).otherwise(-F.col("o_custkey")).alias("project_id"))
    return compliance.presence_status(project, violation, rule=F.concat(F.lit("DEP-"), F.col("project_id").cast("string")))


@query
def artifact_status(b: Bound) -> DataFrame:
    """Pages by language as a project's artefacts, with links of the operator's own kind planted in some."""
    project = b.table("nation").select(F.col("n_nationkey").cast("bigint").alias("project_id"))
    link = F.when(F.col("page_id") % 11 == 0, F.lit('<script SRC = "//cdn.example/x.js"></script>')).otherwise(F.lit(""))
    artifact = b.table("pages").select((F.col("page_id") % 20).alias("project_id"), F.concat(F.regexp_replace("html", "//", ""), link).alias("html"))
    found = compliance.external_resources(artifact)
    return compliance.artifact_status(project, found, rule=F.lit("DEP-002")).select("project_id", "rule_id", "status")


@query
def external_links(b: Bound) -> DataFrame:
    """The operator's own pattern over whole pages, an absolute link added to every other one."""
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<a HREF='https://e.example/"), F.col("page_id").cast("string"), F.lit("'>x</a>"))).otherwise(F.lit(""))
    out = compliance.external_resources(b.table("pages").withColumn("html", F.concat("html", link)))
    return out.select("page_id", F.col("n_urls").cast("bigint").alias("n_urls"), F.array_join("urls", " ").alias("urls"))


@query
def drift_status(b: Bound) -> DataFrame:
    customer = b.table("customer")
    drift = customer.select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_acctbal") < 0, "changed").otherwise("none").alias("drift"))
    ids = customer.select(F.col("c_custkey").alias("project_id"), F.concat(F.lit("GATE-"), F.col("c_nationkey").cast("string")).alias("rule_id"))
    rule = b.table("orders").select(F.col("o_custkey").alias("project_id"), F.concat(F.lit("GATE-"), (F.col("o_orderkey") % 25).cast("string")).alias("rule_id"))
    return compliance.drift_status(drift, rule, rule_ids=ids)


@query
def unclear_rules(b: Bound) -> DataFrame:
    return compliance.unclear_rules(_classified(b)).select("project_id", "rule_id", "ord")


@query
def classified_status(b: Bound) -> DataFrame:
    return compliance.classified_status(_classified(b)).select("project_id", "rule_id", "status", "severity", "title")


@query
def unclear_rule_risks(b: Bound) -> DataFrame:
    out = findings.unclear_rule_risks(compliance.unclear_rules(_classified(b)), prefix="P")
    return out.select("project_id", "target_id", "severity", "evidence_id", "confidence", "type")


@query
def violation_actions(b: Bound) -> DataFrame:
    """Violations of a supplier's rules per nation; rules that are violated without one."""
    rule = text_id("RULE-", "s_suppkey").alias("rule_id")
    supplier = b.table("supplier")
    broken = supplier.select(
        F.when(F.col("s_acctbal") < 4000, F.col("s_nationkey")).otherwise(-F.col("s_nationkey") - 1).alias("project_id"), rule,
        F.col("s_name").alias("message"), F.col("s_suppkey").alias("ord"))
    status = supplier.select(
        F.col("s_nationkey").alias("project_id"), rule, F.when(F.col("s_suppkey") % 2 == 0, "violated").otherwise("compliant").alias("status"),
        F.when(F.col("s_suppkey") % 3 == 0, "should").otherwise("must").alias("severity"), F.col("s_suppkey").alias("ord"))
    return findings.violation_actions(broken, status).select("project_id", "type", "item_id", "detail", "urgency")


@query
def uncovered_task_criteria(b: Bound) -> DataFrame:
    """Tasks, claims, tests and results that share their keys between nations."""
    nation = F.col("c_nationkey").alias("project_id")
    number = (F.col("c_custkey") % 50).cast("string")
    task = b.table("customer").select(
        nation, F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("task_id"), F.when(F.col("c_acctbal") > 0, "must").otherwise("could").alias("priority"),
        F.array(F.concat(F.lit("AC-"), number), F.lit("AC-0")).alias("related_acceptance_criteria"))
    claim = b.order_project.select("project_id", F.concat(F.lit("C"), (F.col("o_orderkey") % 500).cast("string"), F.lit("/"), F.col("o_custkey").cast("string")).alias("claim_id"),
                                   F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("related_task"))
    tests = b.order_project.select("project_id", F.concat(F.lit("C"), (F.col("o_orderkey") % 500).cast("string"), F.lit("/"), F.col("o_custkey").cast("string")).alias("claim_id"),
                                   F.concat(F.lit("t"), (F.col("o_orderkey") % 100).cast("string")).alias("ref"))
    results = b.table("supplier").select(
        F.col("s_nationkey").alias("project_id"), F.concat(F.lit("t"), (F.col("s_suppkey") % 100).cast("string")).alias("path"),
        F.when(F.col("s_acctbal") < 3000, "covered").otherwise("violated").alias("status"), F.col("s_suppkey").alias("ord"))
    found = coverage.task_claim_coverage(task, claim, tests, results)
    return coverage.uncovered_task_criteria(found).select("project_id", "task_id", "ac_id", "reason")


@query
def row_validity(b: Bound) -> DataFrame:
    customer = b.table("customer").select(F.col("c_nationkey").alias("project_id"), F.concat(F.lit("T"), (F.col("c_custkey") % 200).cast("string")).alias("task_id"), "c_custkey")
    problems = b.order_project.select("project_id", F.concat(F.lit("T"), (F.col("o_orderkey") % 400).cast("string")).alias("item_id"))
    return constraints.row_validity(customer, problems, key="task_id").select("project_id", "task_id", "c_custkey", "n_problems", "is_valid")


@query
def head_snapshot(b: Bound) -> DataFrame:
    """The last revision's side of a table that holds both."""
    table = b.order_project.withColumn("snapshot", F.when(F.col("o_orderkey") % 3 == 0, "head").otherwise("staged"))
    return ledgers.snapshot(table, "head").select("project_id", "o_orderkey", "o_orderstatus")


def _written(b: Bound) -> str:
    return f"{shared_folder(b.spark)}/written-{uuid.uuid4().hex}"


@query
def written_index(b: Bound) -> DataFrame:
    """Evidence of all customers, written by project and run and read back."""
    evidence = b.table("customer").select(
        F.col("c_nationkey").alias("project_id"), F.concat(F.lit("EVIDENCE-P-"), F.col("c_custkey").cast("string")).alias("evidence_id"),
        F.lit("task").alias("source_type"), F.lit("docs/task_list.json").alias("source_path"), F.array("c_mktsegment").alias("covers"),
        F.when(F.col("c_acctbal") < 0, "missing").otherwise("covered").alias("status"), F.col("c_custkey").alias("ord"))
    path = _written(b)
    sinks.write_evidence_index(evidence, path, run_id="RUN-7", prefix="P")
    return b.spark.read.parquet(path).select("project_id", "run_id", "evidence_id", "status", F.array_join("covers", ",").alias("covers"))


@query
def decision_log(b: Bound) -> DataFrame:
    """Events as decision requests, streamed to the log in two batches; the second sends all of the first one's purchases again."""
    folder = _written(b)
    request = b.table("events").select(
        (F.col("user_id") % 20).cast("string").alias("project_id"), F.col("event_type").alias("category"),
        F.col("event_id").cast("string").alias("targetId"), F.when(F.col("event_type") != "error", "accept_risk").alias("action"),
        F.lit("seen").alias("reason"), F.col("user_id").cast("string").alias("decidedBy"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
    )
    first = F.col("category") == "purchase"
    for batch in (first, F.lit(True)):
        request.filter(batch).write.mode("append").json(f"{folder}/requests")
        decisions.start(b.spark, f"{folder}/requests", f"{folder}/log", f"{folder}/rejected", f"{folder}/state").awaitTermination()
    rejected = b.spark.read.parquet(f"{folder}/rejected").select("project_id", F.lit(None).cast("bigint").alias("decision_id"), "targetId")
    return b.spark.read.parquet(f"{folder}/log").select("project_id", "decision_id", "targetId").unionByName(rejected)


@query
def published_report(b: Bound) -> DataFrame:
    """Gate decisions of three runs in one report: the second is published twice, the third breaks off before its last section."""
    path = _written(b)
    project = b.table("nation").select(F.col("n_nationkey").alias("project_id"))
    gap = b.table("customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("item_id"))

    def sections(limit: int) -> dict[str, DataFrame]:
        low = gap.join(b.table("customer").select(F.col("c_custkey").alias("item_id"), "c_acctbal"), "item_id").filter(F.col("c_acctbal") < limit)
        counted = project.join(low.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")), "project_id", "left")
        return {"gate": counted.withColumn("gate_decision", F.when(F.coalesce("n", F.lit(0)) > 2, "blocked").otherwise("pass")).drop("n"), "gaps": low.drop("c_acctbal")}

    sinks.write_report(sections(0), path, run_id="RUN-1")
    sinks.write_report(sections(500), path, run_id="RUN-2")
    sinks.write_report(sections(2000), path, run_id="RUN-2")
    broken = sections(9000)
    sinks.write_section(broken["gate"].withColumn("run_id", F.lit("RUN-3")).withColumn("attempt", F.lit("broken")), f"{path}/gate", by=("project_id", "run_id", "attempt"))

    def decisions(run: str | None) -> DataFrame:
        gate_rows = sinks.read_report(b.spark, path, "gate", run_id=run)
        gaps = sinks.read_report(b.spark, path, "gaps", run_id=run).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_gaps"))
        return gate_rows.join(gaps, "project_id", "left").select(
            F.lit(run or "last").alias("asked"), "run_id", "project_id", "gate_decision", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"))

    return decisions("RUN-1").unionByName(decisions(None))


@query
def report_parts(b: Bound) -> DataFrame:
    """Orders as a section of each nation's report: every row is in one part."""
    rows = b.order_project.select("project_id", F.col("o_orderkey").alias("ord"), "o_orderstatus")
    parts = sinks.report_documents({"orders": rows, "empty": rows.filter("false")})
    rows_in = F.explode(F.from_json("document", "array<struct<ord: bigint, o_orderstatus: string>>"))
    return parts.select("project_id", "section", rows_in.alias("r")).select("project_id", "section", "r.ord", "r.o_orderstatus")


@query
def claim_archive(b: Bound) -> DataFrame:
    """Claims of even nations archived under their commit, the others left in the ledger; both read back."""
    claim = b.order_project.select("project_id", F.col("o_orderkey").alias("claim_id"))
    commit = b.table("nation").filter("n_nationkey % 2 = 0").select(
        F.col("n_nationkey").alias("project_id"), F.when(F.col("n_nationkey") != 4, F.concat(F.lit("c"), F.col("n_nationkey").cast("string"))).alias("commit_id"))
    archive, rest = _written(b), _written(b)
    sinks.archive_claims(claim, commit, archive, rest, as_of=F.lit(AS_OF).cast("timestamp"))
    left = b.spark.read.parquet(rest).select("project_id", "claim_id", F.lit(None).cast("string").alias("commit_id"))
    return b.spark.read.parquet(archive).select("project_id", "claim_id", "commit_id").unionByName(left)


@query
def structural_differences(b: Bound) -> DataFrame:
    """Per customer one of the odd pairs of documents, with its own key in them."""
    key = F.col("c_custkey").cast("string")
    pairs = [
        ('{"a":"$"}', '{"a":$}'), ('{"s":"{\\"k\\":$}"}', '{"s":{"k":$}}'), ('{"a.b":$}', '{"a":{"b":$}}'), ('{"rules":[]}', '{"rules":[{"rule_id":"R$"}]}'),
        ('{"n":{"p":$}}', '{"n":{}}'), ('{}', '{"t":{"u":{"v":$},"w":[$]}}'), ('{"r":[{"rule_id":"A","x":1},{"rule_id":"A","x":$}]}', '{"r":[{"x":$,"rule_id":"A"}]}'),
        ('{"r":[{"rule_id":"R$"}]}', '{"r":[{"gate_id":"R$"}]}'), ('{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":$}}}}}}}}', '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":-$}}}}}}}}'),
        ('{"l":[{"rule_id":"a"},$]}', '{ "l" : [ {"rule_id":"a"} , $ ] }'),
    ]

    def side(n: int) -> DataFrame:
        kind = F.col("c_custkey") % len(pairs)
        text = F.lit(None).cast("string")
        for i, pair in enumerate(pairs):
            text = F.when(kind == i, F.replace(F.lit(pair[n]), F.lit("$"), key)).otherwise(text)
        return b.table("customer").select(F.col("c_custkey").alias("project_id"), text.alias("text"))

    return delta.document_diff(side(0), side(1))


@query
def document_problems(b: Bound) -> DataFrame:
    """A requirements document per customer, each seventh with the same kind of mistake."""
    kind = F.col("c_custkey") % 7
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")

    def unless(number: int, text: str, instead: str = "") -> Column:
        return F.when(kind == number, instead).otherwise(text)

    again = F.when(kind == 6, F.concat(F.lit("\n### REQ-P-"), nation, F.lit(": again\n\n#### 优先级\n\nmust\n\n#### 类别\n\nfunctional\n"))).otherwise("")
    text = F.concat(
        F.lit("# Title\n\n### REQ-P-"), nation, F.lit(": "), F.col("c_name"), F.lit("\n\n"), unless(5, "#### 优先级\n\nmust\n\n"),
        F.lit("#### 类别\n\n"), unless(3, "functional", "other"), F.lit("\n\n##### AC-P-"), F.when(kind == 4, "99").otherwise(nation), F.lit("-"), key,
        F.lit(": works\n\n"), F.when(kind == 1, "").when(kind == 2, "- 是否必须有测试：maybe\n").otherwise("- 是否必须有测试：是\n"), again,
    )
    document = b.table("customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("doc_id"), text.alias("text"))
    lines = cut_lineage(documents.document_lines(document, prefix="P"))
    requirement, criterion = cut_lineage(documents.parse_requirements(lines)), cut_lineage(documents.parse_criteria(lines))
    return documents.document_problems(lines, requirement, criterion).select("project_id", "doc_id", "problem", "item_id")


def _portfolio(b: Bound) -> dict[str, DataFrame]:
    """A small project per customer. By the customer's key: all is well; the test fails and rules are broken;
    the claim cites only itself; a draft. Every other four projects have a changed file."""
    kind = F.col("c_custkey") % 4
    good, untested, selfish, draft = (kind == i for i in range(4))
    project = F.col("c_custkey").cast("string").alias("project_id")
    customer = b.table("customer")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("bigint").alias("ord")

    def words(*texts: str) -> Column:
        return F.array(*[F.lit(t) for t in texts])

    def null(name: str, of: str = "string") -> Column:
        return F.lit(None).cast(of).alias(name)

    claim = customer.select(
        project, F.lit("CLAIM-P-1").alias("claim_id"), F.lit("TASK-P-1").alias("related_task"), F.lit("covered").alias("claimed_status"),
        F.when(selfish, words("CLAIM-P-1")).otherwise(words("tests/a.py")).alias("evidence_refs"), F.lit(AS_OF).cast("timestamp").alias("claimed_ts"),
        words("src/app/gate.py").alias("code_refs"), words("tests/a.py").alias("test_refs"), null("notes"), null("content_hash"), zero)
    claim = with_content_hash(claim)
    tests = customer.select(
        project, F.lit("test").alias("source_type"), F.lit("tests/a.py").alias("source_path"), words("AC-P-1-1").alias("covers"),
        F.when(untested | draft, "violated").otherwise("covered").alias("status"), F.lit("tests/a.py").alias("nodeid"), F.lit("test").alias("tool_category"),
        null("percent_covered", "double"), null("num_statements", "int"), zero)
    tool = customer.select(
        project, F.lit("tool").alias("source_type"), F.lit("src/app/gate.py").alias("source_path"), none.alias("covers"), F.lit("compliant").alias("status"),
        null("nodeid"), F.lit("coverage").alias("tool_category"), F.lit(90.0).alias("percent_covered"), F.lit(10).alias("num_statements"),
        F.lit(1).cast("bigint").alias("ord"))
    manifest = customer.select(project, F.explode(words("prd", "architecture_constraints", "task_list")).alias("file_key")).select(
        "project_id", "file_key", F.concat(F.lit("docs/"), "file_key").alias("path"), F.lit("ok").alias("status"), F.lit("h").alias("sha256"))
    return {
        "project": customer.select(project, F.when(draft, "draft").otherwise("active").alias("status"), F.lit("P").alias("id_prefix")),
        "requirement": customer.select(project, F.lit("REQ-P-1").alias("req_id"), F.lit("Login").alias("title"), F.lit("must").alias("priority"), F.lit("functional").alias("category"), zero),
        "criterion": customer.select(project, F.lit("REQ-P-1").alias("req_id"), F.lit("AC-P-1-1").alias("ac_id"), F.lit("works").alias("title"), F.lit(True).alias("is_testing_required"), zero),
        "task": customer.select(
            project, F.lit("TASK-P-1").alias("task_id"), F.lit("t").alias("title"), F.lit("must").alias("priority"), F.lit("done").alias("status"),
            words("REQ-P-1").alias("related_requirements"), words("AC-P-1-1").alias("related_acceptance_criteria"), zero),
        "claim": claim, "head_claim": claim.filter("false"), "tool_evidence": tests.unionByName(tool),
        "rule": customer.filter(good | untested).select(
            project, F.lit("security_rules").alias("section"), F.when(good, "SEC-2").otherwise("SEC-1").alias("rule_id"), F.lit("s").alias("title"),
            F.lit("").alias("description"), F.lit("must").alias("severity"), F.when(good, "manual").otherwise("machine").alias("verification_method"),
            F.when(good, "lead").alias("accepted_by"), F.when(good, F.lit(AS_OF).cast("timestamp")).alias("accepted_at"), zero),
        "module_boundary": customer.select(
            project, F.lit("MOD-P-2").alias("module_id"), F.lit("gate").alias("name"), words("gate.py").alias("owned_files"), none.alias("allowed_to_call"),
            none.alias("forbidden_to_call"), none.alias("related_requirements"), zero),
        "import_edge": customer.select(project, F.lit("src/app/gate.py").alias("file_path"), F.when(untested, "sqlite3").otherwise("os").alias("imported_module"), F.lit(3).alias("lineno")),
        "html_artifact": customer.select(project, F.lit("dashboard.html").alias("path"), F.lit("<p>x</p>").alias("html")),
        "manifest": manifest,
        "changed_file": customer.filter(F.col("c_custkey") % 8 >= 4).select(project, F.lit("src/app/gate.py").alias("path")),
        "scope_pattern": customer.filter("false").select(project, F.lit("include").alias("kind"), F.lit("*").alias("pattern")),
        "decision": b.spark.createDataFrame([], TABLES["decision"]),
    }


@query
def analysis_gate(b: Bound) -> DataFrame:
    """The whole analysis, end to end: the decision on every project."""
    report = analysis.run(_portfolio(b), as_of=F.lit(AS_OF).cast("timestamp"), package="app")
    return report["gate"].select("project_id", "gate_decision")


# --- projects that share their keys ---------------------------------------------------------------


@query
def affected_by_project(b: Bound) -> DataFrame:
    """What changes touch, where every nation has claims, tasks, files and requirements of the same names."""
    key = F.col("o_orderkey")
    claim_id, task_id = F.concat(F.lit("C"), (key % 211).cast("string")), F.concat(F.lit("K"), (F.col("o_custkey") % 53).cast("string"))
    orders = b.order_project
    changed = orders.select("project_id", F.concat(F.when(key % 5 == 0, "f").otherwise("g"), (key % 97).cast("string")).alias("path"))
    claim = orders.select("project_id", claim_id.alias("claim_id"), task_id.alias("related_task"))
    file_ref = orders.select("project_id", claim_id.alias("claim_id"), F.concat(F.lit("f"), (key % 101).cast("string"), F.lit("#L2")).alias("ref"))
    link = orders.select("project_id", task_id.alias("task_id"), F.when(key % 2 == 0, "requirement").otherwise("ac").alias("item_type"), F.concat(F.lit("R"), (key % 307).cast("string")).alias("item_id"))
    return impact.affected_items(changed, claim, file_ref, link)


@query
def reference_findings_by_project(b: Bound) -> DataFrame:
    """Claims cite evidence by names that other nations use too, with other statuses or not at all."""
    orders = b.order_project
    claim_id = text_id("C", "o_orderkey").alias("claim_id")
    claim = orders.select("project_id", claim_id, F.when(F.col("o_orderstatus") == "O", "partial").otherwise("covered").alias("claimed_status"), F.col("o_orderkey").alias("ord"))
    lines = b.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    refs = lines.select("project_id", claim_id, F.when(F.col("l_discount") < 0.05, F.concat(F.lit("E"), (F.col("l_partkey") % 60).cast("string"))).otherwise(text_id("C", "o_orderkey")).alias("ref"), F.col("l_linenumber").alias("pos"))
    evidence = b.table("part").select(
        (F.col("p_size") % 25).alias("project_id"), F.concat(F.lit("E"), (F.col("p_partkey") % 50).cast("string")).alias("evidence_id"), F.lit("").alias("source_path"),
        F.lit("tool").alias("source_type"), F.lit(None).cast("string").alias("nodeid"),
        F.when(F.col("p_partkey") % 7 == 0, "violated").when(F.col("p_partkey") % 11 == 0, "unclear").otherwise("compliant").alias("status"), F.col("p_partkey").alias("ord"))
    return claims.reference_findings(claim, refs, evidence).select("project_id", "claim_id", "category", "ref", "pos")


@query
def dangling_by_project(b: Bound) -> DataFrame:
    """References of orders to names that exist in other nations, but not in their own."""
    child = b.order_project.select("project_id", "o_orderkey", F.concat(F.lit("M"), (F.col("o_orderkey") % 40).cast("string")).alias("module_id"))
    parent = b.table("supplier").select(F.col("s_nationkey").alias("project_id"), F.concat(F.lit("M"), (F.col("s_suppkey") % 40).cast("string")).alias("module_id"))
    return integrity.dangling_refs(child, parent, ref="module_id", key="module_id").select("project_id", "o_orderkey", "module_id")


@query
def more_constraint_checks(b: Bound) -> DataFrame:
    """The kinds of constraint that ``constraint_checks`` does not use."""
    size = F.col("p_size")
    part = F.struct(F.when(size % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("name"), size.alias("n"))
    rows = b.table("part").select(
        F.col("p_brand").alias("project_id"), "p_partkey", F.col("p_partkey").alias("ord"),
        F.when(size % 5 == 0, "many").otherwise(size.cast("string")).alias("count"), F.col("p_type").alias("title"), size.alias("size"),
        F.when(size % 2 == 0, F.array("p_type", "p_brand")).otherwise(F.array("p_type")).alias("words"),
        F.when(size % 7 == 0, '{"a": 1, "z": 2}').otherwise('{"a": 1}').alias("extra"), F.array(part).alias("parts"),
    )
    checks = [
        constraints.Check("count", "type", "int"), constraints.Check("title", "min_length", 6), constraints.Check("size", "maximum", 40),
        constraints.Check("words", "min_items", 2), constraints.Check("extra", "additional", ("a", "b")),
        constraints.Check("words", "item_enum", ("ECONOMY", "LARGE", "MEDIUM", "Brand#1")), constraints.Check("parts", "item_required", "name"),
    ]
    out = constraints.check_rows(rows, checks, table="parts", key="p_partkey")
    return out.select("project_id", "key", "field_path", "rule", F.when(F.col("rule") != "min_items", F.col("value")).alias("value"))


@query
def document_criteria(b: Bound) -> DataFrame:
    document = b.table("customer").select(
        (F.col("c_custkey") % 10).alias("project_id"), F.concat(F.lit("see AC-P-"), F.col("c_nationkey").cast("string"), F.lit("-1, AC-QX-2-"), (F.col("c_custkey") % 3).cast("string"), F.lit(" and AC-p-1-1")).alias("text"))
    return integrity.document_criteria(document)


@query
def rule_requirement_links(b: Bound) -> DataFrame:
    links = F.array(text_id("REQ-", "p_size"), text_id("REQ-", F.col("p_size") + 1)).alias("related_requirements")
    rule = b.table("part").select(F.col("p_brand").alias("project_id"), links)
    module = b.table("nation").select(F.lit("Brand#1").alias("project_id"), F.array(text_id("MREQ-", "n_nationkey")).alias("related_requirements"))
    return integrity.rule_requirement_links(rule, module).groupBy("project_id", "req_id", "top_level").agg(F.count(F.lit(1)).alias("n"))
