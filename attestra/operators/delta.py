"""Differences between two revisions, drift from a baseline, and upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.ids import is_template
from attestra.functions.text import without_fragment
from attestra.operators.sequence import SCOPE, first_per_key
from attestra.schemas import DIFF_ID_KEYS
from attestra.session import cut_lineage


def active_claims(staged: DataFrame, head: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Staged claims identical to no claim of the last revision (compared by ``content_hash``)."""
    return staged.filter(~is_template(F.col("claim_id").cast("string"))).join(
        head.select(*scope, "content_hash").distinct(), [*scope, "content_hash"], "left_anti"
    )


def keyed_delta(
    staged: DataFrame, head: DataFrame, *, key: str, hash: str = "content_hash", scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Keys that are new in, or differ in, ``staged``: scope, key, change. The last head row of a key counts."""
    old = head.groupBy(*scope, key).agg(
        F.max_by(hash, "ord").alias("_old"), F.lit(True).alias("_known")
    )
    change = F.when(F.col("_known").isNull(), "new").when(~F.col(hash).eqNullSafe(F.col("_old")), "modified")
    return (
        staged.filter(F.col(key).isNotNull())
        .join(old, [*scope, key], "left")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(*scope, key, "change")
        .distinct()
    )


def _action(in_base: Column, in_current: Column, differ: Column) -> Column:
    return F.when(~in_base, "add").when(~in_current, "delete").when(differ, "modify")


def rule_diff(
    base: DataFrame, current: DataFrame, *, body: str = "body_hash", ord: str = "ord", scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Rules added, modified or deleted between two rule sets: scope, section, rule_id, action, path.

    A repeated id counts once a side, by its last entry; without an ``ord`` column, by the greatest body.
    """
    keys = [*scope, "section", "rule_id"]

    def side(rules: DataFrame, name: str) -> DataFrame:
        last = F.max_by(body, ord) if ord in rules.columns else F.max(body)
        return rules.groupBy(*keys).agg(last.alias(name), F.lit(True).alias(f"{name}_in"))

    action = _action(F.col("_old_in").isNotNull(), F.col("_new_in").isNotNull(), ~F.col("_old").eqNullSafe(F.col("_new")))
    return (
        side(base, "_old").join(side(current, "_new"), keys, "full_outer")
        .withColumn("action", action)
        .filter(F.col("action").isNotNull())
        .withColumn("path", F.concat_ws(".", "section", "rule_id"))
        .select(*keys, "action", "path")
    )


def document_diff(
    base: DataFrame, current: DataFrame, *, text: str = "text", scope: Sequence[str] = SCOPE,
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Structural difference of two versions of a JSON document: scope, path, rule_id, action.

    The two versions are paired first and opened together, as far as both are objects: a key on one side
    only is one added or deleted entry, whatever is below it. Two lists whose entries, on both sides, are all
    objects with the same id key are compared by id, the last entry of an id counting. Anything else that
    differs, in type too, is modified. Order of keys and spacing do not count. A missing or broken
    document is an empty one.

    The levels of nesting are a recursive query over the pairs that still differ. Its result is materialised once, as three kinds of
    rows are read from it. A key that is repeated in an object counts with its last value (``session.SETTINGS``).
    """
    keys = [*scope, "_document"]

    def side(document: DataFrame, name: str) -> DataFrame:
        return document.select(*scope, F.lit(1).alias("_document"), F.try_parse_json(F.col(text)).alias(name))

    empty = F.parse_json(F.lit("{}"))
    pair = side(base, "_b").join(side(current, "_c"), keys, "full_outer").select(
        *scope, F.coalesce("_b", empty).alias("_b"), F.coalesce("_c", empty).alias("_c")
    )
    node = materialise(base.sparkSession.sql(_DIFFERENT_NODES.format(scope="".join(f"`{c}`, " for c in scope), pair="{pair}"), pair=pair))
    path, none = F.concat_ws(".", "_path").alias("path"), F.lit(None).cast("string").alias("rule_id")
    both = F.col("_in_b") & F.col("_in_c")
    objects, lists = (
        F.try_variant_get("_b", "$", kind).isNotNull() & F.try_variant_get("_c", "$", kind).isNotNull()
        for kind in ("map<string,variant>", "array<variant>")
    )
    whole = node.filter(~both | ~(objects | lists)).select(
        *scope, path, none, F.when(both, "modify").when(F.col("_in_b"), "delete").otherwise("add").alias("action")
    )
    opened = node.filter(both & lists).select(
        *scope, "_path", *[F.try_variant_get(v, "$", "array<variant>").alias(v) for v in ("_b", "_c")]
    )
    return whole.unionByName(_list_diff(opened, scope))


#: Every pair of values that differs, from the documents down through objects that both sides have.
_DIFFERENT_NODES = """
WITH RECURSIVE node AS (
  SELECT {scope}CAST(array() AS ARRAY<STRING>) AS _path, _b, _c, true AS _in_b, true AS _in_c
  FROM {pair} WHERE to_json(_b) <> to_json(_c)
  UNION ALL
  SELECT {scope}_path, _b, _c, _in_b, _in_c FROM (
    SELECT {scope}concat(_path, array(_key)) AS _path, element_at(_mb, _key) AS _b, element_at(_mc, _key) AS _c,
      map_contains_key(_mb, _key) AS _in_b, map_contains_key(_mc, _key) AS _in_c
    FROM (
      SELECT {scope}_path, _mb, _mc, explode(array_union(map_keys(_mb), map_keys(_mc))) AS _key FROM (
        SELECT {scope}_path, try_variant_get(_b, '$', 'map<string,variant>') AS _mb, try_variant_get(_c, '$', 'map<string,variant>') AS _mc
        FROM node WHERE _in_b AND _in_c)
      WHERE _mb IS NOT NULL AND _mc IS NOT NULL))
  WHERE NOT (_in_b AND _in_c AND to_json(_b) = to_json(_c))
)
SELECT * FROM node
"""


def _list_diff(lists: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Entries of two different lists by id, or the list as a whole where the entries have no common id key."""
    both = F.concat("_b", "_c")

    def has(item: Column, key: str) -> Column:
        return F.coalesce(F.map_contains_key(F.try_variant_get(item, "$", "map<string,variant>"), key), F.lit(False))

    def all_have(key: str) -> Column:
        return (F.size(both) > 0) & F.forall(both, lambda item: has(item, key))

    named = F.coalesce(*[F.when(all_have(key), F.lit(key)) for key in DIFF_ID_KEYS])
    keyed = lists.withColumn("_id_key", named)
    whole = keyed.filter(F.col("_id_key").isNull()).select(
        *scope, F.concat_ws(".", "_path").alias("path"), F.lit(None).cast("string").alias("rule_id"), F.lit("modify").alias("action")
    )

    def entries(side: str, name: str) -> DataFrame:
        items = keyed.filter(F.col("_id_key").isNotNull()).select(*scope, "_path", "_id_key", F.posexplode(side).alias("_pos", "_item"))
        value = F.element_at(F.try_variant_get("_item", "$", "map<string,variant>"), F.col("_id_key"))
        return items.select(
            *scope, "_path", F.to_json(value).alias("_id"), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)).alias("rule_id"),
            F.struct("_pos", F.to_json("_item").alias("body")).alias(name),
        )

    rows = entries("_b", "_old").unionByName(entries("_c", "_new"), allowMissingColumns=True)
    last = rows.groupBy(*scope, "_path", "_id", "rule_id").agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    action = _action(F.col("_old").isNotNull(), F.col("_new").isNotNull(), F.col("_old.body") != F.col("_new.body"))
    by_id = last.select(*scope, F.concat_ws(".", F.concat("_path", F.array("rule_id"))).alias("path"), "rule_id", action.alias("action"))
    return whole.unionByName(by_id.filter(F.col("action").isNotNull()))


def baseline_drift(
    run_config: DataFrame, manifest: DataFrame, diff: DataFrame | None = None, baseline: DataFrame | None = None, *,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """State of each project's locked baseline: scope, drift, n_changes, requirements_drift.

    ``none``; ``no_metadata`` (hash differs, lock record incomplete); ``no_baseline`` (locked version
    cannot be read); ``format_only`` (other bytes, same rules); ``changed``.
    ``manifest``: scope, file_key, sha256. ``diff``: scope, ... one row per difference, needed only
    for drifted projects. ``baseline``: scope - projects whose locked version can be read.
    """

    def hash_of(key: str, name: str) -> Column:
        return F.max(F.when(F.col("file_key") == key, F.col("sha256"))).alias(name)

    hashes = manifest.groupBy(*scope).agg(hash_of("architecture_constraints", "_rules"), hash_of("prd", "_requirements"))
    out = run_config.join(hashes, list(scope), "left")
    n = F.lit(0).cast("bigint")
    if diff is not None:
        out = out.join(diff.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")), list(scope), "left")
        n = F.coalesce("_n", n)
    readable: Column = F.lit(True)
    if baseline is not None:
        out = out.join(baseline.select(*scope).distinct().withColumn("_readable", F.lit(True)), list(scope), "left")
        readable = F.coalesce("_readable", F.lit(False))
    stored = F.col("architecture_constraints_hash")
    unset = (F.coalesce("finalize_git_commit", F.lit("")) == "") | (
        F.coalesce("finalize_constraints_path", F.lit("")) == ""
    )
    drift = (
        F.when((F.coalesce(stored, F.lit("")) == "") | F.col("_rules").isNull() | (stored == F.col("_rules")), "none")
        .when(unset, "no_metadata")
        .when(~readable, "no_baseline")
        .when(n == 0, "format_only")
        .otherwise("changed")
    )
    prd = F.coalesce(
        (F.coalesce("prd_hash", F.lit("")) != "") & (F.col("prd_hash") != F.col("_requirements")), F.lit(False)
    )
    return out.select(
        *scope, drift.alias("drift"), F.when(drift == "changed", n).otherwise(0).alias("n_changes"),
        prd.alias("requirements_drift"),
    )


# Drift state -> (risk description, business impact, action).
DRIFT_TEXT = {
    "no_metadata": (
        "The rule document changed but no baseline record exists.",
        "The baseline cannot be rebuilt, so the drift cannot be detailed.",
        "Lock the baseline.",
    ),
    "no_baseline": (
        "The locked version of the rule document cannot be read.",
        "Rules cannot be compared one by one.",
        "Lock the baseline.",
    ),
    "format_only": (
        "The rule document changed in format only.",
        "The stored hash differs from the file and disturbs later drift checks.",
        "Lock the baseline to update the check point.",
    ),
    "changed": (
        "The rule document changed since it was locked; review and record the change.",
        "Related tasks or code may need review to keep to the architecture.",
        "Record the reason in the change log, then lock the baseline.",
    ),
}


def drift_risks(drift: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """One should-risk per drifted project, not yet numbered."""

    def pick(position: int) -> Column:
        out = None
        for state, entry in DRIFT_TEXT.items():
            hit = F.col("drift") == state
            out = F.when(hit, entry[position]) if out is None else out.when(hit, entry[position])
        return out

    return drift.filter(F.col("drift") != "none").select(
        *scope, pick(0).alias("description"), F.lit("should").alias("severity"),
        pick(1).alias("business_impact"), pick(2).alias("suggested_action"), F.lit(1).cast("bigint").alias("ord"),
    )


def drift_gaps(drift: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """A gap for every project whose rules changed."""
    return drift.filter(F.col("drift") == "changed").select(
        *scope, F.lit("architecture_constraints.json").alias("item_id"),
        F.lit("architecture_constraints_changed").alias("item_type"),
        F.concat(F.col("n_changes").cast("string"), F.lit(" rule changes since the baseline was locked.")).alias("reason"),
        F.lit("architecture_constraints.json").alias("target_id"), F.lit("should").alias("severity"),
        F.lit(1).cast("bigint").alias("ord"),
    )


def undocumented_changes(
    drift: DataFrame, changed_file: DataFrame, *, change_log: str = "docs/architecture_change_log.md",
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Projects with changed rules (or an unreadable baseline) whose change log was not touched."""
    logged = changed_file.filter(F.col("path") == change_log).select(*scope).distinct()
    changed = drift.filter(F.col("drift") == "changed").join(logged, list(scope), "left_anti")
    return changed.unionByName(drift.filter(F.col("drift") == "no_baseline"))


def lock_baseline(
    run_config: DataFrame, proposal: DataFrame, undocumented: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Outcome of locking each project's baseline, with the row to store.

    ``proposal``: scope, language, tool_languages (array), tools (array), rules_hash, prd_hash.
    ``outcome``: ``language_missing``, ``language_unknown``, ``language_conflict``, ``undocumented_change``,
    ``unchanged`` or ``locked``; only ``locked`` rows differ from what is stored.
    """
    late = undocumented.select(*scope).distinct().withColumn("_late", F.lit(True))
    stored = run_config.select(
        *scope, F.col("language").alias("_language"), F.col("validation_tools").alias("_tools"),
        F.col("architecture_constraints_hash").alias("_rules"), F.col("prd_hash").alias("_prd"),
    )
    rows = proposal.join(stored, list(scope), "left").join(late, list(scope), "left")
    no_tools = F.array().cast("array<string>")
    first = F.coalesce("_language", F.lit("")) == ""
    rules_changed = ~F.col("_rules").eqNullSafe(F.col("rules_hash"))
    same_tools = F.array_sort(F.coalesce("_tools", no_tools)) == F.array_sort("tools")
    same_prd = F.coalesce("_prd", F.lit("")) == F.coalesce("prd_hash", F.lit(""))
    outcome = (
        F.when(F.coalesce("language", F.lit("")) == "", "language_missing")
        .when(~F.array_contains("tool_languages", F.col("language")), "language_unknown")
        .when(first, "locked")
        .when(F.col("_language") != F.col("language"), "language_conflict")
        .when(~rules_changed & same_tools & same_prd, "unchanged")
        .when(rules_changed & F.coalesce("_late", F.lit(False)), "undocumented_change")
        .otherwise("locked")
    )
    locked = F.col("outcome") == "locked"
    return (
        rows.withColumn("outcome", outcome)
        .withColumn("validation_tools", F.when(locked, F.col("tools")).otherwise(F.col("_tools")))
        .withColumn("architecture_constraints_hash", F.when(locked, F.col("rules_hash")).otherwise(F.col("_rules")))
        .withColumn("prd_hash", F.when(locked, F.col("prd_hash")).otherwise(F.col("_prd")))
        .withColumn("language", F.when(locked, F.col("language")).otherwise(F.col("_language")))
        .select(*scope, "outcome", "language", "validation_tools", "architecture_constraints_hash", "prd_hash")
    )


def accept_rules(rule: DataFrame, acceptance: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Rules with requested acceptances applied; an existing acceptance is kept.

    ``acceptance``: scope, rule_id, accepted_by, accepted_at; the earliest request per rule counts.
    """
    request = first_per_key(
        acceptance.select(*scope, "rule_id", F.col("accepted_by").alias("_by"), F.col("accepted_at").alias("_at")),
        [*scope, "rule_id"], ["_at", "_by"],
    )
    open_ = F.coalesce("accepted_by", F.lit("")) == ""
    joined = rule.join(request, [*scope, "rule_id"], "left")
    return (
        joined.withColumn("accepted_at", F.when(open_, F.col("_at")).otherwise(F.col("accepted_at")))
        .withColumn("accepted_by", F.when(open_, F.col("_by")).otherwise(F.col("accepted_by")))
        .select(*rule.columns)
    )


def unknown_acceptances(rule: DataFrame, acceptance: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Requested acceptances of rules that do not exist."""
    return acceptance.join(rule.select(*scope, "rule_id").distinct(), [*scope, "rule_id"], "left_anti")


def reuse_or_regenerate(
    new: DataFrame, old: DataFrame, file_snapshot: DataFrame, last_scan: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Per source file, its fresh evidence if the file changed since the last scan, else the old rows.

    A file is regenerated when it is not in the old index, no longer exists, or was modified at or
    after the last scan. ``new`` and ``old`` share their columns; ``last_scan``: scope, scan_time.
    """
    columns = new.columns
    path = without_fragment(F.col("source_path"))
    indexed = old.select(*scope, path.alias("_file")).distinct()
    unchanged = (
        indexed.join(last_scan, list(scope))
        .join(file_snapshot.select(*scope, F.col("path").alias("_file"), "modified_at"), [*scope, "_file"])
        .filter(F.col("modified_at") < F.col("scan_time"))
        .select(*scope, "_file")
    )
    fresh = new.withColumn("_file", path).join(unchanged, [*scope, "_file"], "left_anti")
    kept = old.withColumn("_file", path).join(unchanged, [*scope, "_file"], "left_semi")
    return fresh.select(*columns).unionByName(kept.select(*columns))


def carry_over(old: DataFrame, new: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Old test and coverage rows whose (path, type) the new index does not hold, flagged ``carried_over``."""
    is_coverage = (F.col("source_type") == "tool") & F.coalesce(F.col("tool_category") == "coverage", F.lit(False))
    return (
        old.filter((F.col("source_type") == "test") | is_coverage)
        .join(new.select(*scope, "source_path", "source_type").distinct(), [*scope, "source_path", "source_type"], "left_anti")
        .withColumn("carried_over", F.lit(True))
    )
