"""Reports of external tools -> evidence rows.

``tool_run``: scope, path, tool_category, exit_code, stdout, stderr, report, ord - one row per tool and
path. ``report`` is the text of the report file, null where there is none; the tool's standard output
is read instead. The tools themselves are not run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.functions.status import coverage_status, exit_outcome, outcome_status
from attestra.operators.impact import with_change_mode
from attestra.operators.sequence import SCOPE
from attestra.schemas import COVERAGE_THRESHOLD

TEST_REPORT = (
    "tests array<struct<nodeid: string, outcome: string, docstring: string, "
    "metadata: struct<docstring: string>>>"
)


def _evidence(
    rows: DataFrame, scope: Sequence[str], *, source_type: Column, source_path: Column, status: Column,
    covers: Column | None = None, **details: Column,
) -> DataFrame:
    extra = {
        "error_code": F.lit(None).cast("string"), "nodeid": F.lit(None).cast("string"),
        "outcome": F.lit(None).cast("string"), "n_findings": F.lit(None).cast("int"),
        "skip_reason": F.lit(None).cast("string"), "percent_covered": F.lit(None).cast("double"),
        "num_statements": F.lit(None).cast("int"), "sub_ord": F.lit(0), **details,
    }
    return rows.select(
        *scope, source_type.alias("source_type"), source_path.alias("source_path"),
        (F.array().cast("array<string>") if covers is None else covers).alias("covers"), status.alias("status"),
        F.col("tool_category").alias("tool_category"), F.col("exit_code").cast("int").alias("exit_code"),
        *[value.alias(name) for name, value in extra.items()], F.col("ord"),
    )


ENTRY = (
    "source_type string, source_path string, covers array<string>, status string, error_code string, nodeid string, "
    "outcome string, n_findings int, skip_reason string, sub_ord int"
)


def _entry(**fields: Column) -> Column:
    """One evidence entry (ENTRY) of a run; fields that are not given are null or empty."""
    given = {"covers": F.array().cast("array<string>"), "sub_ord": F.lit(0), **fields}
    names = [field.split()[0] for field in ENTRY.split(", ")]
    kind = ", ".join(": ".join(field.split()) for field in ENTRY.split(", "))
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in names]).cast(f"struct<{kind}>")


def _is_json_object(text: Column) -> Column:
    # Null for anything but an object; keys are read without building the values.
    return F.json_object_keys(text).isNotNull()


def _test_entries(prefix: str | Column) -> Column:
    """One entry per test of a readable report, in the report file or the output; else one for the run."""
    text = F.when(_is_json_object(F.col("report")), F.col("report")).when(_is_json_object(F.col("stdout")), F.col("stdout"))

    def per_test(test: Column, number: Column) -> Column:
        nodeid, outcome = F.coalesce(test["nodeid"], F.lit("")), F.coalesce(test["outcome"], F.lit(""))
        docstring = F.coalesce(test["docstring"], test["metadata"]["docstring"])
        return F.when(test.isNotNull(), _entry(
            source_type=F.lit("test"), source_path=F.when(nodeid != "", nodeid).otherwise(F.col("path")),
            status=outcome_status(outcome), covers=tx.covered_ids(docstring, prefix), nodeid=nodeid, outcome=outcome, sub_ord=number,
        ))

    passed = F.col("exit_code") == 0
    per_run = _entry(
        source_type=F.lit("test"), source_path=F.col("path"), status=F.when(passed, "covered").otherwise("violated"),
        outcome=F.when(passed, "passed").otherwise("failed"),
    )
    return F.when(text.isNotNull(), F.array_compact(F.transform(F.from_json(text, TEST_REPORT)["tests"], per_test))).otherwise(F.array(per_run))


def _json_list_size(text: Column, keys: Sequence[str]) -> Column:
    """Length of a JSON list, or of the first list under one of ``keys`` of an object; null for neither."""
    def length(value: Column) -> Column:
        return F.when(F.ltrim(value).startswith("["), F.json_array_length(value))

    return F.coalesce(length(text), *[length(F.get_json_object(text, f"$.{k}")) for k in keys])


def _counted(count: Column) -> Column:
    n = F.coalesce(count, F.lit(0)).cast("int")
    return F.array(_entry(
        source_type=F.lit("tool"), source_path=F.col("path"), status=F.when(n == 0, "compliant").otherwise("violated"), n_findings=n
    ))


def _lint_count() -> Column:
    return _json_list_size(F.col("stdout"), ("violations", "results", "issues"))


def _type_check_count() -> Column:
    reported = F.get_json_object("report", "$.summary.error_count").try_cast("int")
    error_lines = F.size(F.filter(tx.lines(F.coalesce("stdout", F.lit(""))), lambda line: line.contains(": error:")))
    return F.when(F.coalesce(reported, F.lit(0)) != 0, reported).when(F.col("exit_code") == 1, error_lines).otherwise(0)


def _security_count() -> Column:
    from_report = F.json_array_length(F.get_json_object("report", "$.results"))
    return F.when(F.coalesce(from_report, F.lit(0)) > 0, from_report).otherwise(_json_list_size(F.col("stdout"), ("results",)))


def run_evidence(
    tool_run: DataFrame, *, prefix: str | Column = "P", unreadable: bool = True, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Evidence of tool runs, in one pass: each run's category picks how its output becomes entries.

    Tests: one row per test with the ids its docstring covers, or one per run without a readable report.
    Lint: violations of a JSON list or an object with one. Type checks: the report's error count, else the
    error lines of a failed run. Security: entries under ``results`` of the report file, else of the output.
    ``unreadable``: runs whose exit code says that there is no report, as skipped or blocked evidence.
    """
    category = F.col("tool_category")
    blocked = F.array(_entry(
        source_type=F.lit("tool"), source_path=F.col("path"), status=F.col("_o.status"), error_code=F.col("_o.error_code"),
        skip_reason=F.col("_o.skip_reason"),
    ))
    entries = (
        F.when(F.col("_o").isNotNull(), blocked if unreadable else F.lit(None))
        .when(category == "test", _test_entries(prefix))
        .when(category == "lint", _counted(_lint_count()))
        .when(category == "type_check", _counted(_type_check_count()))
        .when(category == "security", _counted(_security_count()))
    )
    rows = tool_run.withColumn("_o", exit_outcome(category, F.col("exit_code"))).withColumn("_e", F.explode(entries))
    fields = [field.split()[0] for field in ENTRY.split(", ")]
    return _evidence(rows, scope, **{name: F.col(f"_e.{name}") for name in fields})


def _of_category(tool_run: DataFrame, category: str, scope: Sequence[str], prefix: str | Column = "P") -> DataFrame:
    return run_evidence(tool_run.filter(F.col("tool_category") == category), prefix=prefix, unreadable=False, scope=scope)


def test_evidence(tool_run: DataFrame, *, prefix: str | Column, scope: Sequence[str] = SCOPE) -> DataFrame:
    """The readable test runs of ``run_evidence``."""
    return _of_category(tool_run, "test", scope, prefix)


def coverage_evidence(
    coverage_report: DataFrame, *, threshold: float = COVERAGE_THRESHOLD, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Coverage reports (scope, text, ord) -> one row per source file; entries without a percentage are skipped."""
    schema = "files map<string, struct<percent_covered: double, num_statements: int>>"
    rows = (
        coverage_report.select(*scope, "ord", F.explode(F.from_json("text", schema)["files"]).alias("path", "_f"))
        .filter(F.col("_f.percent_covered").isNotNull())
        .withColumn("tool_category", F.lit("coverage"))
        .withColumn("exit_code", F.lit(0))
    )
    percent = F.col("_f.percent_covered")
    return _evidence(
        rows, scope, source_type=F.lit("tool"), source_path=F.col("path"), status=coverage_status(percent, threshold),
        percent_covered=percent, num_statements=F.coalesce("_f.num_statements", F.lit(0)),
    )


def tool_evidence(
    tool_run: DataFrame, coverage_report: DataFrame | None = None, *, prefix: str | Column,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Evidence of all tool categories."""
    found = run_evidence(tool_run, prefix=prefix, scope=scope)
    return found if coverage_report is None else found.unionByName(coverage_evidence(coverage_report, scope=scope))


def evidence_run_summary(evidence: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Produced, blocked (with an error code) and skipped rows per project."""
    return evidence.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_executed"),
        F.count_if(F.col("error_code").isNotNull()).alias("n_blocked"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
    )


def work_list(
    file_ref: DataFrame, file_snapshot: DataFrame, changed: DataFrame, *, extensions: Sequence[str] = (".py",),
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Files tools should look at: scope, path, path_type (``test`` wins over ``source``).

    Only existing files with a known extension; in projects with changed files only those.
    ``file_ref``: scope, kind (code or test), ref.
    """
    path = tx.without_fragment(F.col("ref"))
    files = (
        file_ref.filter(F.col("kind").isin("code", "test"))
        .select(*scope, path.alias("path"), F.when(F.col("kind") == "test", "test").otherwise("source").alias("path_type"))
        .filter(tx.extension(F.col("path")).isin(*extensions))
        .groupBy(*scope, "path")
        .agg(F.max("path_type").alias("path_type"))
        .join(file_snapshot.select(*scope, "path").distinct(), [*scope, "path"], "left_semi")
    )
    touched = changed.select(*scope, "path").distinct().withColumn("_touched", F.lit(True))
    return (
        with_change_mode(files, changed, "_changes", scope=scope)
        .join(touched, [*scope, "path"], "left")
        .filter(~F.col("_changes") | F.col("_touched"))
        .drop("_changes", "_touched")
    )


def skipped_refs(file_ref: DataFrame, *, extensions: Sequence[str] = (".py",), scope: Sequence[str] = SCOPE) -> DataFrame:
    """References to files no tool applies to, as skipped evidence."""
    path = tx.without_fragment(F.col("ref"))
    suffix = tx.extension(F.col("path"))
    rows = (
        file_ref.select(*scope, path.alias("path"))
        .filter((suffix != "") & ~suffix.isin(*extensions))
        .distinct()
        .withColumn("tool_category", F.lit(None).cast("string"))
        .withColumn("exit_code", F.lit(0))
        # These rows have no source position; a hash spreads and orders them.
        .withColumn("ord", F.pmod(F.xxhash64("path"), F.lit(1 << 31)))
    )
    return _evidence(
        rows, scope, source_type=F.lit("tool"), source_path=F.col("path"), status=F.lit("skipped"),
        skip_reason=F.lit("no_tool_applies"),
    )


def unknown_extensions(
    changed: DataFrame, *, extensions: Sequence[str] = (".py",), scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Distinct extensions of changed files that no tool is configured for."""
    return (
        changed.select(*scope, tx.extension(F.col("path")).alias("extension"))
        .filter((F.col("extension") != "") & ~F.col("extension").isin(*extensions))
        .distinct()
    )


def expected_reports(files: DataFrame, categories: Sequence[str], *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Tool categories each file needs: tests only ``test``, sources all others, unknown types none."""
    wanted = F.when(F.col("path_type") == "test", F.array(*[F.lit(c) for c in categories if c == "test"])).when(
        F.col("path_type") == "source", F.array(*[F.lit(c) for c in categories if c != "test"])
    )
    return files.select(*scope, "path", F.explode(wanted).alias("tool_category"))


def missing_reports(expected: DataFrame, tool_run: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    keys = [*scope, "path", "tool_category"]
    return expected.join(tool_run.select(*keys).distinct(), keys, "left_anti")


def claim_test_results(
    test_ref: DataFrame, test_run: DataFrame, file_snapshot: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Result per referenced test file, counts read from the run's summary line.

    ``test_run``: scope, path, exit_code, stdout, timed_out. ``status``: passed, failed, timeout,
    file_not_found, or not_run.
    """
    def counted(word: str) -> Column:
        return F.coalesce(F.regexp_extract("stdout", rf"(\d+) {word}", 1).try_cast("int"), F.lit(0))

    refs = test_ref.select(*scope, tx.without_fragment(F.col("ref")).alias("path")).filter(F.col("path") != "").distinct()
    present = file_snapshot.select(*scope, "path").distinct().withColumn("_present", F.lit(True))
    status = (
        F.when(F.col("_present").isNull(), "file_not_found")
        .when(F.col("_ran").isNull(), "not_run")
        .when(F.coalesce("timed_out", F.lit(False)), "timeout")
        .when(F.col("exit_code") == 0, "passed")
        .otherwise("failed")
    )
    done = F.col("status").isin("passed", "failed")
    return (
        refs.join(present, [*scope, "path"], "left")
        .join(test_run.withColumn("_ran", F.lit(True)), [*scope, "path"], "left")
        .withColumn("status", status)
        .select(
            *scope, "path", "status",
            F.when(done, counted("passed")).otherwise(0).alias("n_passed"),
            F.when(done, counted("failed")).otherwise(0).alias("n_failed"),
            F.when(done, counted("error")).otherwise(0).alias("n_errors"),
        )
        .withColumn("num_tests", F.col("n_passed") + F.col("n_failed") + F.col("n_errors"))
    )


def reusable_results(previous: DataFrame, file_snapshot: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Earlier test results whose file still has the content it was tested with.

    ``previous``: scope, path, file_hash and the result's columns.
    """
    same = file_snapshot.select(*scope, "path", F.col("sha256").alias("file_hash")).distinct()
    return previous.join(same, [*scope, "path", "file_hash"], "left_semi")
