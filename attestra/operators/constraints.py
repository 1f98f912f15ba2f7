"""Constraint checks: every broken rule of every row, found in one pass over the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.ids import id_problem, is_template
from attestra.functions.status import is_ok
from attestra.operators.sequence import SCOPE
from attestra.schemas import COVERAGE_STATUSES, SEVERITIES, TASK_STATUSES

VIOLATION = "struct<field_path: string, rule: string, value: string, hint: string>"


@dataclass(frozen=True)
class Check:
    """One constraint. ``kind``: required, type, enum, pattern, min_length, max_length, minimum,
    maximum, min_items, additional (``value`` = allowed keys; ``field`` holds raw JSON), or one of
    item_enum, item_pattern, item_required for each entry of an array (``value`` of item_required is
    the field of the entry)."""

    field: str
    kind: str
    value: Any = None


# What to do about each kind of violation.
HINTS = {
    "required": "Set '{field}', which has no value.",
    "type": "Make '{field}' a value of type {value}.",
    "enum": "Use one of these for '{field}': {value}.",
    "pattern": "Write '{field}' in the form {value}.",
    "min_length": "Give '{field}' {value} characters or more.",
    "max_length": "Shorten '{field}' to {value} characters.",
    "minimum": "Raise '{field}' to {value} or more.",
    "maximum": "Lower '{field}' to {value} or less.",
    "min_items": "List {value} entries or more in '{field}'.",
    "additional": "Drop the unknown keys of '{field}'.",
    "item_enum": "Use only these in '{field}': {value}.",
    "item_pattern": "Write each entry of '{field}' in the form {value}.",
    "item_required": "Set '{value}' in each entry of '{field}'.",
}


def _hint(check: Check) -> str:
    value = ", ".join(map(str, check.value)) if isinstance(check.value, (tuple, list)) else check.value
    return HINTS[check.kind].format(field=check.field, value=value)


def _broken(check: Check, value: Column) -> Column:
    """Condition under which the single value breaks the check; null values only break ``required``."""
    text = value.cast("string")
    kind = check.kind.removeprefix("item_")
    if kind == "required":
        return value.isNull()
    if kind == "type":
        return text.try_cast(check.value).isNull() & value.isNotNull()
    if kind == "enum":
        return ~text.isin(*check.value)
    if kind == "pattern":
        return ~text.rlike(check.value)
    if kind == "min_length":
        return F.length(text) < check.value
    if kind == "max_length":
        return F.length(text) > check.value
    if kind == "minimum":
        return value < check.value
    if kind == "maximum":
        return value > check.value
    if kind == "min_items":
        return F.size(value) < check.value
    raise ValueError(f"unknown check {check.kind}")


def _violations(check: Check, row_path: Column) -> Column:
    """Array of violation structs of one check for the current row."""
    column = F.col(check.field)
    path = F.concat(row_path, F.lit(f".{check.field}"))
    hint = F.lit(_hint(check))

    def entry(at: Column, value: Column) -> Column:
        return F.struct(at, F.lit(check.kind), value.cast("string"), hint).cast(VIOLATION)

    if check.kind == "additional":
        extra = F.array_except(F.json_object_keys(column), F.array(*[F.lit(k) for k in check.value]))
        found = F.transform(extra, lambda key: entry(F.concat(row_path, F.lit("."), key), key))
    elif check.kind.startswith("item_"):
        def of(item: Column) -> Column:
            return item.getField(check.value) if check.kind == "item_required" else item

        suffix = f".{check.value}" if check.kind == "item_required" else ""
        found = F.filter(
            F.transform(
                column,
                lambda item, i: F.when(
                    _broken(check, of(item)),
                    entry(F.concat(path, F.lit("["), i.cast("string"), F.lit(f"]{suffix}")), of(item)),
                ),
            ),
            lambda v: v.isNotNull(),
        )
    else:
        shown = F.to_json(column) if check.kind == "min_items" else column
        found = F.array_compact(F.array(F.when(_broken(check, column), entry(path, shown))))
    return F.coalesce(found, F.array().cast(f"array<{VIOLATION}>"))


def check_rows(
    df: DataFrame, checks: Sequence[Check], *, table: str, key: str, ord: str = "ord", scope: Sequence[str] = SCOPE
) -> DataFrame:
    """All violations: scope, table, key, field_path (``tasks[0].task_id``), rule, value, hint."""
    row_path = F.format_string(f"{table}[%d]", F.col(ord))
    found = F.flatten(F.array(*[_violations(check, row_path) for check in checks]))
    return df.select(
        *scope, F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.explode(found).alias("_v")
    ).select(*scope, "table", "key", "_v.*")


def task_checks(prefix: str) -> list[Check]:
    """Contract of the task list."""
    id_ = {k: rf"^{k}-{prefix}-\d+$" for k in ("TASK", "PHASE", "REQ", "MOD")}
    required = ("task_id", "title", "phase_id", "priority", "status", "related_requirements", "related_acceptance_criteria")
    return [
        *[Check(field, "required") for field in required],
        Check("task_id", "pattern", id_["TASK"]),
        Check("phase_id", "pattern", id_["PHASE"]),
        Check("title", "min_length", 1),
        Check("priority", "enum", SEVERITIES),
        Check("status", "enum", TASK_STATUSES),
        Check("related_requirements", "item_pattern", rf"^(?:REQ-{prefix}-\d+|Q-\d+)$"),
        Check("related_acceptance_criteria", "item_pattern", rf"^AC-{prefix}-\d+-\d+$"),
        Check("related_modules", "item_pattern", id_["MOD"]),
        Check("definition_of_done", "item_required", "dod_id"),
        Check("definition_of_done", "item_required", "description"),
    ]


def claim_checks(prefix: str) -> list[Check]:
    """Contract of the claims ledger."""
    return [
        Check("claim_id", "required"),
        Check("related_task", "required"),
        Check("claim_id", "pattern", rf"^CLAIM-{prefix}-\d+$"),
        Check("related_task", "pattern", rf"^TASK-{prefix}-\d+$"),
        Check("claimed_status", "enum", COVERAGE_STATUSES),
    ]


def evidence_checks(prefix: str) -> list[Check]:
    """Contract of the evidence index."""
    return [
        *[Check(field, "required") for field in ("evidence_id", "source_type", "source_path", "covers", "status")],
        Check("evidence_id", "pattern", rf"^EVIDENCE-{prefix}-\d+$"),
        Check("source_type", "enum", ("task", "claim", "test", "tool", "code")),
        Check("status", "enum", COVERAGE_STATUSES),
    ]


def _problems(df: DataFrame, key: str, conditions: dict[str, Column], scope: Sequence[str]) -> DataFrame:
    named = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions.items()]))
    return df.filter(~is_template(F.col(key).cast("string"))).select(
        *scope, F.col(key).alias("item_id"), F.explode(named).alias("problem")
    )


def task_problems(
    task: DataFrame, *, prefix: str | Column, strict_links: bool = False, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Row rules of tasks: bad id, isolated task, architectural orphan. One row per problem.

    Isolated: neither requirements nor criteria; with ``strict_links`` one of the two missing suffices.
    """
    no_reqs = F.coalesce(F.size("related_requirements"), F.lit(0)) <= 0
    no_acs = F.coalesce(F.size("related_acceptance_criteria"), F.lit(0)) <= 0
    no_modules = F.coalesce(F.size("related_modules"), F.lit(0)) <= 0
    return _problems(
        task, "task_id",
        {
            "invalid_id": id_problem(F.col("task_id"), prefix).isNotNull(),
            "isolated": (no_reqs | no_acs) if strict_links else (no_reqs & no_acs),
            "orphan": no_modules & ~F.col("status").eqNullSafe("done"),
        },
        scope,
    )


def claim_problems(claim: DataFrame, *, prefix: str | Column, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Row rules of claims: bad id, bad task id, completion claimed without external evidence."""
    external = F.filter(F.coalesce("evidence_refs", F.array().cast("array<string>")), lambda r: r != F.col("claim_id"))
    return _problems(
        claim, "claim_id",
        {
            "invalid_id": id_problem(F.col("claim_id"), prefix).isNotNull(),
            "invalid_task_id": id_problem(F.col("related_task"), prefix).isNotNull(),
            "no_external_evidence": is_ok(F.col("claimed_status")) & (F.size(external) == 0),
        },
        scope,
    )


def row_validity(df: DataFrame, problems: DataFrame, *, key: str, scope: Sequence[str] = SCOPE) -> DataFrame:
    """``df`` with ``n_problems`` and ``is_valid``."""
    counts = problems.groupBy(*scope, F.col("item_id").alias(key)).agg(F.count(F.lit(1)).alias("n_problems"))
    return (
        df.join(counts, [*scope, key], "left")
        .withColumn("n_problems", F.coalesce("n_problems", F.lit(0)))
        .withColumn("is_valid", F.col("n_problems") == 0)
    )
