"""Architecture rules: module boundaries, banned dependencies, inputs, and rule classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import source_code
from attestra.functions import text as tx
from attestra.functions.ids import as_column, sentinel_evidence
from attestra.functions.status import is_stale_acceptance
from attestra.operators import affixes
from attestra.operators.joins import left_join_known
from attestra.operators.sequence import SCOPE, first_per_key
from attestra.schemas import ACCEPTANCE_DAYS, BANNED_PACKAGES, BANNED_RUNTIMES, RULE_SECTIONS


def import_edges(source: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Python sources (scope, path, text) -> one row per import: scope, file_path, imported_module, lineno."""
    return source.select(*scope, F.col("path").alias("file_path"), F.explode(source_code.import_lines(F.col("text"))).alias("_i")).select(
        *scope, "file_path", "_i.imported_module", "_i.lineno"
    )


def edge_modules(
    edge: DataFrame, module_boundary: DataFrame, *, package: str, exempt: str = "core",
    folders: Mapping[str, str] | None = None, scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Import edges with the module that owns the file and the one that owns the import, where known.

    A file belongs to the first module that lists its name, an import of ``package`` to the first one
    that lists its second part as a file. ``folders`` assigns whole sub-packages; anything below
    ``exempt`` has no module.
    """
    owned = module_boundary.select(*scope, F.explode("owned_files").alias("_file"), "module_id", "name", "ord")
    by_file = first_per_key(owned.select(*scope, "_file", "module_id", "ord"), [*scope, "_file"], ["ord", "module_id"])
    by_stem = first_per_key(
        owned.select(*scope, F.regexp_replace("_file", r"\.py$", "").alias("_stem"), "module_id", "ord"),
        [*scope, "_stem"], ["ord", "module_id"],
    )
    path_parts = F.split("file_path", "/")
    import_parts = F.split("imported_module", r"\.")
    own_import = F.startswith("imported_module", F.lit(package)) & (F.size(import_parts) > 1)

    def assigned(parts: Column) -> Column:
        out = F.lit(None).cast("string")
        for folder, module in (folders or {}).items():
            out = F.when(F.array_contains(parts, folder), module).otherwise(out)
        return out

    files = (
        edge.withColumn("_file", tx.base_name(F.col("file_path")))
        .withColumn("_stem", F.when(own_import, F.try_element_at(import_parts, F.lit(2))))
        .join(by_file.select(*scope, "_file", F.col("module_id").alias("_fm")), [*scope, "_file"], "left")
    )
    # Most imports are from elsewhere and have no stem.
    both = left_join_known(files, by_stem.select(*scope, "_stem", F.col("module_id").alias("_im")), [*scope, "_stem"], "_stem")
    return (
        both.withColumn(
            "from_module",
            F.when(~F.array_contains(path_parts, exempt), F.coalesce(assigned(path_parts), F.col("_fm"))),
        )
        .withColumn(
            "to_module",
            F.when(
                own_import & ~F.array_contains(import_parts, exempt),
                F.coalesce(assigned(F.array("_stem")), F.col("_im")),
            ),
        )
        .drop("_file", "_stem", "_fm", "_im")
    )


def boundary_violations(edge: DataFrame, module_boundary: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Edges between modules that break the calling module's rules, one row per broken rule.

    ``forbidden``: the target is on the forbidden list. ``not_allowed``: an allow-list exists (an empty
    one allows nothing, null means there is none) and the target is not on it.
    ``edge``: scope, from_module, to_module and any other columns.
    """
    boundary = module_boundary.select(
        *scope, F.col("module_id").alias("from_module"), "allowed_to_call", "forbidden_to_call"
    )
    target = F.col("to_module")
    forbidden = F.coalesce(F.array_contains("forbidden_to_call", target), F.lit(False))
    outside = F.col("allowed_to_call").isNotNull() & ~F.coalesce(
        F.array_contains("allowed_to_call", target), F.lit(False)
    )
    broken = F.array_compact(F.array(F.when(forbidden, F.lit("forbidden")), F.when(outside, F.lit("not_allowed"))))
    return (
        edge.filter(F.col("from_module").isNotNull() & target.isNotNull() & (F.col("from_module") != target))
        .join(boundary, [*scope, "from_module"])
        .withColumn("violation", F.explode(broken))
        .drop("allowed_to_call", "forbidden_to_call")
    )


def module_status(module_boundary: DataFrame, violation: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Rule status row per module: violated if any of its edges breaks a rule."""
    broken = violation.select(*scope, F.col("from_module").alias("module_id")).distinct().withColumn("_v", F.lit(True))
    return module_boundary.join(broken, [*scope, "module_id"], "left").select(
        *scope, F.col("module_id").alias("rule_id"),
        F.when(F.col("_v"), "violated").otherwise("compliant").alias("status"), F.lit("must").alias("severity"),
        F.concat(F.lit("Module boundary: "), F.coalesce("name", F.lit(""))).alias("title"), "ord",
    )


def runtime_imports(
    edge: DataFrame, *, adapter_module: str, tokens: Sequence[str] = BANNED_RUNTIMES
) -> DataFrame:
    """Imports of an agent runtime, and imports of the adapter module, from outside that module."""
    named = reduce(lambda a, b: a | b, [F.contains("imported_module", F.lit(t)) for t in tokens])
    adapter = F.coalesce(F.col("to_module") == adapter_module, F.lit(False))
    kinds = F.array_compact(F.array(F.when(named, F.lit("runtime")), F.when(adapter, F.lit("adapter"))))
    return edge.filter(~F.col("from_module").eqNullSafe(adapter_module)).withColumn("violation", F.explode(kinds))


def banned_packages(edge: DataFrame, packages: Sequence[str] = BANNED_PACKAGES) -> DataFrame:
    """Imports whose root package is banned."""
    return edge.withColumn("root_package", F.substring_index("imported_module", ".", 1)).filter(
        F.col("root_package").isin(*packages)
    )


EXTERNAL = r"""(?i)((?:href|src)\s*=\s*["'](?:https?:)?//[^"']+["'])"""


def external_resources(html_artifact: DataFrame, *, html: str = "html", pattern: str = EXTERNAL) -> DataFrame:
    """Artefacts with the external resources their HTML refers to: ``urls``, ``n_urls``."""
    urls = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return html_artifact.withColumn("urls", urls).withColumn("n_urls", F.size("urls"))


def artifact_status(
    project: DataFrame, artifact: DataFrame, *, rule: Column, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Rule status per project from its artefacts; a project without any is unclear."""
    found = artifact.groupBy(*scope).agg(F.bool_or(F.col("n_urls") > 0).alias("_external"))
    status = (
        F.when(F.col("_external").isNull(), "unclear").when(F.col("_external"), "violated").otherwise("compliant")
    )
    return project.join(found, list(scope), "left").select(
        *scope, rule.alias("rule_id"), status.alias("status"), F.lit("must").alias("severity")
    )


def missing_inputs(
    project: DataFrame, manifest: DataFrame, *, required: Sequence[str] = ("prd", "architecture_constraints", "task_list"),
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Required inputs a project does not have: scope, file_key."""
    expected = project.select(*scope, F.explode(F.array(*[F.lit(k) for k in required])).alias("file_key"))
    present = manifest.filter(F.col("status") != "missing").select(*scope, "file_key").distinct()
    return expected.join(present, [*scope, "file_key"], "left_anti")


def evidence_for_paths(
    path: DataFrame, evidence: DataFrame, *, prefix: str | Column = "P", scope: Sequence[str] = SCOPE
) -> DataFrame:
    """First evidence whose path equals, ends with, or is the end of each path; else the sentinel.

    Both sides are reduced to their distinct texts, which one sorted scan compares (:func:`affixes.first_by_suffix`).
    """
    def normal(text: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.col(text), r"\\", "/"), "^/+|/+$", "")

    known = evidence.select(*scope, normal("source_path").alias("_norm"), "ord", F.col("evidence_id").alias("id"))
    best = affixes.first_by_suffix(path.select(*scope, normal("path").alias("_norm")), known, text="_norm", scope=scope)
    return (
        path.withColumn("_norm", normal("path"))
        .join(best.select(*scope, "_norm", F.col("id").alias("evidence_id")), [*scope, "_norm"], "left")
        .withColumn("evidence_id", F.coalesce("evidence_id", sentinel_evidence(prefix)))
        .drop("_norm")
    )


def classify_rules(
    rule: DataFrame, checked: DataFrame, *, as_of: Column, days: int = ACCEPTANCE_DAYS, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Must rules no check has covered: ``accepted`` (manual, accepted by someone), ``unclear`` (manual),
    ``unclear_blocking`` (machine-verified without a check). ``checked``: scope, rule_id."""
    manual = F.coalesce("verification_method", F.lit("machine")) == "manual"
    accepted = F.coalesce("accepted_by", F.lit("")) != ""
    return (
        rule.filter(
            F.col("section").isin(*RULE_SECTIONS)
            & (F.coalesce("severity", F.lit("must")) == "must")
            & F.col("rule_id").isNotNull()
        )
        .join(checked.select(*scope, "rule_id").distinct(), [*scope, "rule_id"], "left_anti")
        .withColumn(
            "classification",
            F.when(manual & accepted, "accepted").when(manual, "unclear").otherwise("unclear_blocking"),
        )
        .withColumn(
            "stale_acceptance",
            (F.col("classification") == "accepted") & is_stale_acceptance(F.col("accepted_at"), as_of, days),
        )
    )


def unclear_rules(classified: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Machine-verified rules without a check, as rows the gate counts."""
    return classified.filter(F.col("classification") == "unclear_blocking").select(
        *scope, "rule_id",
        F.lit("No check covers this rule; someone has to review it.").alias("reason"), "ord",
    )


def classified_status(classified: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Status rows of classified rules; accepted ones have none."""
    return classified.filter(F.col("classification") != "accepted").select(
        *scope, "rule_id", F.lit("unclear").alias("status"), F.lit("must").alias("severity"), "title", "ord"
    )


def must_rollup(
    project: DataFrame, rule_status: DataFrame, *, prefix: str | Column = "P", scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Three roll-up rules per project: any violated must rule, any unclear must rule, and the constant
    one (nothing is passed over in silence). Computed over the checked rules only.

    ``prefix`` may be a column of ``project``.
    """
    must = F.col("severity") == "must"
    totals = rule_status.groupBy(*scope).agg(
        F.bool_or(must & (F.col("status") == "violated")).alias("_violated"),
        F.bool_or(must & (F.col("status") == "unclear")).alias("_unclear"),
    )

    def rule(kind: str, number: str, status: Column) -> Column:
        return F.struct(rule_id(kind, prefix, number).alias("rule_id"), status.alias("status"))

    rows = F.array(
        rule("GATE", "006", F.when(F.col("_violated"), "violated").otherwise("compliant")),
        rule("GATE", "007", F.when(F.col("_unclear"), "unclear").otherwise("compliant")),
        rule("FORBID", "007", F.lit("compliant")),
    )
    return (
        project.join(totals, list(scope), "left")
        .select(*scope, F.explode(rows).alias("_r"))
        .select(*scope, "_r.rule_id", "_r.status", F.lit("must").alias("severity"))
    )


def rule_id(kind: str, prefix: str | Column, number: str) -> Column:
    """Id of a built-in rule, for example ``GATE-P-001``."""
    return F.concat(F.lit(f"{kind}-"), as_column(prefix), F.lit(f"-{number}"))


def presence_status(
    project: DataFrame, violation: DataFrame, *, rule: Column, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Status of one built-in rule per project: violated where it has a violation row, else compliant."""
    broken = violation.select(*scope).distinct().withColumn("_v", F.lit(True))
    return project.join(broken, list(scope), "left").select(
        *scope, rule.alias("rule_id"), F.when(F.col("_v"), "violated").otherwise("compliant").alias("status"),
        F.lit("must").alias("severity"),
    )


def drift_status(drift: DataFrame, rule: DataFrame, *, rule_ids: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Status of the change-record rule, for projects that have it: unclear (should) on any drift.

    ``rule_ids``: scope, rule_id - the id of that rule in each project.
    """
    having = rule_ids.join(rule.select(*scope, "rule_id").distinct(), [*scope, "rule_id"], "left_semi")
    calm = F.col("drift") == "none"
    return drift.join(having, list(scope)).select(
        *scope, "rule_id", F.when(calm, "compliant").otherwise("unclear").alias("status"),
        F.when(calm, "must").otherwise("should").alias("severity"),
    )
