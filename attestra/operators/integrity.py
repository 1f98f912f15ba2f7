"""References that lead nowhere, keys that occur twice, changed files nobody answers for."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.functions.ids import parent_requirement
from attestra.functions.scope import is_allowed
from attestra.operators.sequence import SCOPE
from attestra.session import cut_lineage


def dangling_refs(
    child: DataFrame, parent: DataFrame, *, ref: str, key: str, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Rows of ``child`` whose ``ref`` (a column or an array, then exploded) is no ``key`` of ``parent``."""
    if child.schema[ref].dataType.typeName() == "array":
        child = child.withColumn(ref, F.explode(ref))
    keys = parent.select(*scope, F.col(key).alias(ref)).distinct()
    return child.filter(F.col(ref).isNotNull()).join(keys, [*scope, ref], "left_anti")


def task_reference_problems(
    task: DataFrame, parents: Mapping[str, tuple[DataFrame, str]], *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Dangling references of tasks, one row per (task, array column, missing target).

    ``parents`` maps an array column of ``task`` to (parent table, key). All links are unpivoted into
    one set and checked by one anti-join, whatever the number of columns.
    """

    def links_of(column: str) -> Column:
        return F.transform(column, lambda target: F.struct(F.lit(column).alias("link"), target.alias("target")))

    links = [links_of(column) for column in parents]
    exploded = task.select(*scope, "task_id", F.explode(F.flatten(F.array(*links))).alias("_l")).select(
        *scope, "task_id", "_l.link", "_l.target"
    )
    known = None
    for column, (parent, key) in parents.items():
        part = parent.select(*scope, F.lit(column).alias("link"), F.col(key).alias("target"))
        known = part if known is None else known.unionByName(part)
    return exploded.join(known.distinct(), [*scope, "link", "target"], "left_anti")


def missing_parents(task: DataFrame, criterion: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Known criteria of a task whose parent requirement the task does not list."""
    known = criterion.select(*scope, "ac_id").distinct()
    return (
        task.select(*scope, "task_id", "related_requirements", F.explode("related_acceptance_criteria").alias("ac_id"))
        .withColumn("parent_req_id", parent_requirement(F.col("ac_id")))
        .filter(
            F.col("parent_req_id").isNotNull() & ~F.array_contains("related_requirements", F.col("parent_req_id"))
        )
        .drop("related_requirements")
        .join(known, [*scope, "ac_id"], "left_semi")
    )


def duplicate_keys(df: DataFrame, key: Sequence[str], *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*scope, *key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def rule_requirement_links(
    rule: DataFrame, module_boundary: DataFrame | None = None, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Requirements that rules and modules relate to; ``top_level`` marks entries of a list section."""
    links = rule.select(*scope, F.explode("related_requirements").alias("req_id"), F.lit(True).alias("top_level"))
    if module_boundary is None:
        return links
    return links.unionByName(
        module_boundary.select(*scope, F.explode("related_requirements").alias("req_id"), F.lit(True).alias("top_level"))
    )


def nested_requirement_links(
    document: DataFrame, *, text: str = "text", scope: Sequence[str] = SCOPE,
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """The same from raw rule documents: every ``related_requirements`` list at any depth of the JSON.

    A list is top level where it belongs to an entry of a list directly under the document. A broken
    document has no links. Each level of nesting is one pass over the values that are open at it.
    """
    level = materialise(document.select(*scope, F.try_parse_json(F.col(text)).alias("_v")).filter(F.col("_v").isNotNull()))
    entries, items = (F.try_variant_get("_v", "$", kind) for kind in ("map<string,variant>", "array<variant>"))
    # Where a value stands: 0 the document, 1 a list under it, 2 an entry of such a list, -1 anywhere else.
    level, found = level.withColumn("_at", F.lit(0)), None
    while not level.isEmpty():
        ids = F.try_variant_get(F.element_at(entries, "related_requirements"), "$", "array<string>")
        links = level.select(*scope, F.explode(ids).alias("req_id"), (F.col("_at") == 2).alias("top_level"))
        found = links if found is None else found.unionByName(links)
        in_list = level.filter(items.isNotNull()).select(*scope, F.explode(items).alias("_v"), F.when(F.col("_at") == 1, 2).otherwise(-1).alias("_at"))
        in_object = level.filter(entries.isNotNull()).select(*scope, "_at", F.explode(F.map_values(entries)).alias("_v"))
        is_list = F.try_variant_get("_v", "$", "array<variant>").isNotNull()
        in_object = in_object.withColumn("_at", F.when((F.col("_at") == 0) & is_list, 1).otherwise(-1))
        below = in_list.unionByName(in_object)
        level = materialise(below.filter(entries.isNotNull() | items.isNotNull()))
    if found is None:
        found = level.select(*scope, F.lit(None).cast("string").alias("req_id"), F.lit(False).alias("top_level"))
    return found.filter(F.col("req_id").isNotNull()).groupBy(*scope, "req_id").agg(F.bool_or("top_level").alias("top_level"))


def requirement_rule_mapping(
    requirement: DataFrame, link: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Both directions of the requirement - rule mapping: scope, finding, req_id.

    ``dead_link``: cited but not defined (at any depth). ``must_uncovered`` and ``should_uncovered``:
    defined but cited by no top-level entry. Projects without requirements give no rows.
    Both sides are reduced to one row per requirement and joined once.
    """
    defined = requirement.groupBy(*scope, "req_id").agg(F.max_by("priority", "ord").alias("priority"))
    cited = link.groupBy(*scope, "req_id").agg(F.bool_or("top_level").alias("_top"))
    if scope:
        cited = cited.join(requirement.select(*scope).distinct(), list(scope), "left_semi")
    finding = (
        F.when(F.col("_defined").isNull(), "dead_link")
        .when(F.coalesce("_top", F.lit(False)), F.lit(None))
        .when(F.col("priority") == "must", "must_uncovered")
        .when(F.col("priority").isin("should", "could"), "should_uncovered")
    )
    return (
        defined.withColumn("_defined", F.lit(True))
        .join(cited, [*scope, "req_id"], "full_outer")
        .withColumn("finding", finding)
        .filter(F.col("finding").isNotNull())
        .select(*scope, "finding", "req_id")
    )


def unclaimed_files(changed: DataFrame, file_ref: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Changed in-scope files that no claim names among its code or test files.

    ``changed`` is already limited to the governance scope; ``file_ref``: scope, ref.
    """
    claimed = file_ref.select(*scope, F.col("ref").alias("path")).distinct()
    return changed.select(*scope, "path").distinct().join(claimed, [*scope, "path"], "left_anti")


def ghost_files(
    changed: DataFrame, active_ref: DataFrame, *, strip_fragments: bool = False,
    allowed: Column | None = None, scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Changed in-scope files without an *active* claim, one that is new or changed in this revision.

    ``active_ref``: scope, ref - code references of active claims. References count as written, so one
    with a line range covers no file unless ``strip_fragments`` is set.
    """
    ref = tx.without_fragment(F.col("ref")) if strip_fragments else F.col("ref")
    active = active_ref.select(*scope, ref.alias("path")).distinct()
    needs_claim = ~(is_allowed(F.col("path")) if allowed is None else allowed)
    return changed.select(*scope, "path").distinct().filter(needs_claim).join(active, [*scope, "path"], "left_anti")


def reverse_task_coverage(
    changed: DataFrame, claim: DataFrame, code_ref: DataFrame, task: DataFrame, modified_task: DataFrame, *,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Changed files against the tasks of the claims that name them.

    ``block``: the task does not exist. ``warn``: it exists, is not done and was not touched.
    """
    refs = code_ref.select(
        *scope, "claim_id", tx.without_fragment(F.col("ref")).alias("path")
    ).filter(F.col("path") != "")
    pairs = (
        refs.join(changed.select(*scope, "path").distinct(), [*scope, "path"], "left_semi")
        .join(claim.select(*scope, "claim_id", F.col("related_task").alias("task_id")), [*scope, "claim_id"])
        .filter(F.col("task_id").isNotNull())
        .select(*scope, "path", "task_id")
        .distinct()
    )
    tasks = task.groupBy(*scope, "task_id").agg(
        F.max_by("status", "ord").alias("_status"), F.lit(True).alias("_exists")
    )
    touched = modified_task.select(*scope, "task_id").distinct().withColumn("_touched", F.lit(True))
    effect = F.when(F.col("_exists").isNull(), "block").when(
        F.col("_touched").isNull() & ~F.col("_status").eqNullSafe("done"), "warn"
    )
    return (
        pairs.join(tasks.join(touched, [*scope, "task_id"], "left"), [*scope, "task_id"], "left")
        .withColumn("effect", effect)
        .filter(F.col("effect").isNotNull())
        .select(*scope, "path", "task_id", "effect")
    )


def document_criteria(document: DataFrame, *, scope: Sequence[str] = SCOPE, prefix: str = "[A-Z]+") -> DataFrame:
    """Criterion ids that occur anywhere in requirement documents."""
    ids = F.regexp_extract_all("text", F.lit(rf"(AC-{prefix}-\d+-\d+)"), F.lit(1))
    return document.select(*scope, F.explode(ids).alias("ac_id")).distinct()


def criterion_freshness(
    new_task: DataFrame, staged_ac: DataFrame, staged_document: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Criteria of new tasks that the staged requirements document does not hold.

    ``document_not_staged``: the project has no staged document. ``criterion_not_in_document``: it has.
    ``new_task``: scope, task_id, ac_id. ``staged_document``: scope.
    """
    staged = staged_document.select(*scope).distinct().withColumn("_staged", F.lit(True))
    return (
        new_task.select(*scope, "task_id", "ac_id").distinct()
        .join(staged_ac.select(*scope, "ac_id").distinct(), [*scope, "ac_id"], "left_anti")
        .join(staged, list(scope), "left")
        .withColumn(
            "reason", F.when(F.col("_staged"), "criterion_not_in_document").otherwise("document_not_staged")
        )
        .drop("_staged")
    )


def uncovered_files(affected: DataFrame, task_file_ref: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Affected files that no task names; ``task_file_ref``: scope, ref."""
    covered = task_file_ref.select(*scope, tx.without_fragment(F.col("ref")).alias("path")).distinct()
    return affected.select(*scope, "path").distinct().join(covered, [*scope, "path"], "left_anti")
