"""Table schemas and the closed value lists of the data model.

All tables carry ``project_id``. ``ord`` is the position of a row in its source document; readers
set it (array position), and every operator that needs an order uses it.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------------------

COVERAGE_STATUSES = (
    "covered", "partial", "missing", "unclear", "low_confidence",
    "blocked", "compliant", "violated", "skipped", "needs_reverification",
)
OK_STATUSES = ("covered", "compliant")
SEVERITIES = ("must", "should", "could")
PRIORITIES = ("must", "should", "could", "unclear")
CATEGORIES = ("functional", "quality_evolution", "unclear")
TASK_STATUSES = ("todo", "in_progress", "blocked", "done", "cancelled")
GATE_DECISIONS = ("pass", "fail", "blocked", "draft_approved")
DECISION_ACTIONS = ("accept_risk", "mark_complete")
ERROR_CODES = (
    "missing_input", "invalid_input", "schema_violation", "invalid_id", "invalid_status",
    "tool_execution_failed", "missing_evidence", "self_attestation",
    "tool_no_tests_collected", "tool_usage_error",
)

# Sections whose rules are classified by the compliance check.
RULE_SECTIONS = (
    "architecture_principles", "dependency_rules", "data_flow_rules", "storage_rules",
    "error_handling_rules", "logging_rules", "security_rules", "technology_constraints",
    "forbidden_patterns", "quality_gates", "interface_contracts", "performance_constraints",
    "deployment_constraints", "test_constraints",
)
# Sections a task may cite as a logic constraint.
TASK_RULE_SECTIONS = RULE_SECTIONS[:10]
# A rule carries its id under one of these keys; the first one present counts.
RULE_ID_KEYS = ("rule_id", "principle_id", "constraint_id", "pattern_id", "gate_id", "contract_id")
# Keys by which two lists of a rule document are paired when they are compared.
DIFF_ID_KEYS = ("rule_id", "principle_id", "gate_id", "module_id", "pattern_id", "constraint_id")

# Ids with one number and ids with two numbers after the prefix.
SINGLE_ID_KINDS = (
    "REQ", "TASK", "MOD", "GATE", "FORBID", "PRINCIPLE", "PHASE", "EVIDENCE", "RISK", "CLAIM",
)
DOUBLE_ID_KINDS = ("AC", "DOD")
TEMPLATE_SUFFIX = "-9999"
SENTINEL_NUMBER = 999

# Changed files that never need a claim.
ALLOWED_PATHS = ("docs/task_list.json",)
ALLOWED_PREFIXES = (".git/", "output/")

BANNED_RUNTIMES = ("claude_code", "hermes", "deepseek_tui")
BANNED_PACKAGES = (
    "sqlite3", "sqlalchemy", "pymongo", "psycopg2", "redis", "neo4j", "tinydb", "peewee", "tortoise",
)

COVERAGE_THRESHOLD = 80.0
ACCEPTANCE_DAYS = 30

# --- tables -----------------------------------------------------------------------------------

_DETAILS = (
    "STRUCT<task_id: STRING, title: STRING, phase_id: STRING, priority: STRING, claim_id: STRING, "
    "related_task: STRING, nodeid: STRING, outcome: STRING, tool_category: STRING, "
    "percent_covered: DOUBLE, num_statements: INT, command: STRING, exit_code: INT, stderr: STRING, "
    "file_hash: STRING>"
)

TABLES: dict[str, str] = {
    "project": "project_id STRING, status STRING, id_prefix STRING",
    "document": "project_id STRING, doc_id STRING, text STRING",
    "requirement": "project_id STRING, req_id STRING, title STRING, priority STRING, category STRING, ord BIGINT",
    "criterion": (
        "project_id STRING, req_id STRING, ac_id STRING, title STRING, is_testing_required BOOLEAN, ord BIGINT"
    ),
    "task": (
        "project_id STRING, task_id STRING, title STRING, phase_id STRING, priority STRING, status STRING, "
        "owner_role STRING, objective STRING, related_requirements ARRAY<STRING>, "
        "related_acceptance_criteria ARRAY<STRING>, related_modules ARRAY<STRING>, "
        "related_architecture_constraints ARRAY<STRING>, "
        "definition_of_done ARRAY<STRUCT<dod_id: STRING, description: STRING>>, ord BIGINT"
    ),
    "claim": (
        "project_id STRING, claim_id STRING, related_task STRING, claimed_status STRING, "
        "evidence_refs ARRAY<STRING>, claimed_ts TIMESTAMP, code_refs ARRAY<STRING>, "
        "test_refs ARRAY<STRING>, notes STRING, content_hash STRING, ord BIGINT"
    ),
    "evidence": (
        "project_id STRING, evidence_id STRING, source_type STRING, source_path STRING, "
        f"covers ARRAY<STRING>, status STRING, error_code STRING, carried_over BOOLEAN, details {_DETAILS}, "
        "ord BIGINT"
    ),
    "rule": (
        "project_id STRING, section STRING, rule_id STRING, title STRING, description STRING, severity STRING, "
        "verification_method STRING, accepted_by STRING, accepted_at TIMESTAMP, "
        "related_requirements ARRAY<STRING>, related_modules ARRAY<STRING>, checker STRING, "
        "verification_command STRING, ord BIGINT"
    ),
    "module_boundary": (
        "project_id STRING, module_id STRING, name STRING, responsibility STRING, owned_files ARRAY<STRING>, "
        "allowed_to_call ARRAY<STRING>, forbidden_to_call ARRAY<STRING>, related_requirements ARRAY<STRING>, "
        "ord BIGINT"
    ),
    "import_edge": "project_id STRING, file_path STRING, imported_module STRING, lineno INT",
    "file_snapshot": "project_id STRING, path STRING, sha256 STRING, modified_at TIMESTAMP",
    "html_artifact": "project_id STRING, path STRING, html STRING",
    "tool_run": (
        "project_id STRING, path STRING, tool_category STRING, exit_code INT, stdout STRING, stderr STRING, "
        "report STRING, command STRING, ord BIGINT"
    ),
    "changed_file": "project_id STRING, path STRING",
    "scope_pattern": "project_id STRING, kind STRING, pattern STRING",
    "decision": (
        "project_id STRING, decision_id BIGINT, category STRING, targetId STRING, action STRING, "
        "reason STRING, decidedBy STRING, timestamp TIMESTAMP"
    ),
    "gap": (
        "project_id STRING, item_id STRING, item_type STRING, reason STRING, target_id STRING, "
        "severity STRING, stale BOOLEAN, ord BIGINT"
    ),
    "risk": (
        "project_id STRING, risk_id STRING, description STRING, severity STRING, risk_category STRING, "
        "claim_id STRING, target_id STRING, business_impact STRING, suggested_action STRING, "
        "confidence STRING, type STRING, evidence_id STRING, occurrences BIGINT, stale BOOLEAN, ord BIGINT"
    ),
    "run_config": (
        "project_id STRING, project_prefix STRING, project_name STRING, language STRING, "
        "validation_tools ARRAY<STRING>, architecture_constraints_hash STRING, prd_hash STRING, "
        "finalize_git_commit STRING, finalize_constraints_path STRING"
    ),
}
