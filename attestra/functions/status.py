"""Status mappings and time rules shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.schemas import ACCEPTANCE_DAYS, COVERAGE_THRESHOLD, OK_STATUSES

# What a task's own status says as evidence, and a test's outcome.
TASK_EVIDENCE = {"todo": "missing", "in_progress": "partial", "blocked": "blocked", "done": "covered"}
TEST_OUTCOME = {"passed": "covered", "failed": "violated", "error": "violated"}
# Exit codes that mean "nothing to run here" per tool category, with their error code.
SKIP_EXITS = {
    "test": {5: ("no tests collected", "tool_no_tests_collected"), 2: ("usage error", "tool_usage_error")},
    "type_check": {2: ("usage error", "tool_usage_error")},
}


def mapped(value: Column, mapping: dict[str, str], default: str) -> Column:
    out = None
    for key, result in mapping.items():
        out = F.when(value == key, result) if out is None else out.when(value == key, result)
    return out.otherwise(default)


def task_evidence_status(status: Column) -> Column:
    return mapped(status, TASK_EVIDENCE, "unclear")


def outcome_status(outcome: Column) -> Column:
    return mapped(outcome, TEST_OUTCOME, "unclear")


def is_ok(status: Column) -> Column:
    return F.coalesce(status.isin(*OK_STATUSES), F.lit(False))


def coverage_status(percent: Column, threshold: float = COVERAGE_THRESHOLD) -> Column:
    return F.when(percent >= threshold, "compliant").otherwise("violated")


def exit_outcome(tool_category: Column, exit_code: Column) -> Column:
    """``struct<status, error_code, skip_reason>`` of a run whose report is not to be read, else null."""
    fields = "struct<status: string, error_code: string, skip_reason: string>"

    def outcome(status: str, code: str, reason: str | None) -> Column:
        return F.struct(F.lit(status), F.lit(code), F.lit(reason)).cast(fields)

    out = F.when(F.lit(False), outcome("skipped", "", None))
    for category, exits in SKIP_EXITS.items():
        for code, (reason, error_code) in exits.items():
            out = out.when(
                (tool_category == category) & (exit_code == code), outcome("skipped", error_code, reason)
            )
    return out.when(~exit_code.isin(0, 1), outcome("blocked", "tool_execution_failed", None))


def is_stale_acceptance(accepted_at: Column, as_of: Column, days: int = ACCEPTANCE_DAYS) -> Column:
    """Accepted more than ``days`` whole days before ``as_of``; unknown times are not stale."""
    elapsed = F.floor((F.unix_micros(as_of) - F.unix_micros(accepted_at)) / F.lit(86_400_000_000))
    return F.coalesce(elapsed > days, F.lit(False))
