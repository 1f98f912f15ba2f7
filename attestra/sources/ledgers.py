"""Project documents read as tables: manifest, tasks, claims, rules, decisions, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.hashing import file_hash
from attestra.functions.ids import as_column, is_template
from attestra.functions.text import lines, parse_timestamp
from attestra.operators.sequence import SCOPE, number_rows
from attestra.schemas import RULE_ID_KEYS, RULE_SECTIONS, TABLES


def _fields(table: str, *leave_out: str) -> T.StructType:
    schema = T.DataType.fromDDL(TABLES[table])
    return T.StructType([f for f in schema.fields if f.name not in ("project_id", "ord", *leave_out)])


def read_files(spark: SparkSession, path: str, *, project: Column | str, root: str = "") -> DataFrame:
    """Files with bytes, hash and time: scope, path (below ``root``), content, sha256, modified_at."""
    full = F.regexp_replace(F.col("path"), "^file:/+", "/")
    below = F.when(F.startswith(full, F.lit(root.rstrip("/") + "/")), F.substr(full, F.lit(len(root.rstrip("/")) + 2)))
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .withColumn("path", F.coalesce(below, full) if root else full)
    )
    return files.select(
        as_column(project).alias("project_id"), "path", "content", file_hash(F.col("content")).alias("sha256"),
        F.col("modificationTime").alias("modified_at"),
    )


def input_manifest(expected: DataFrame, file: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """State of every expected input; never fails.

    ``expected``: scope, file_key, path, is_required. ``status``: ok, missing, read_error (not UTF-8) or
    parse_error (a ``.json`` file that is no JSON). The hash is of the raw bytes, for ok files only.
    """
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    status = (
        F.when(F.col("content").isNull(), "missing")
        .when(F.col("text").isNull(), "read_error")
        .when(F.lower("path").endswith(".json") & F.try_parse_json("text").isNull(), "parse_error")
        .otherwise("ok")
    )
    error = F.when(F.col("status").isin("read_error", "parse_error"), "invalid_input").when(
        (F.col("status") == "missing") & F.col("is_required"), "missing_input"
    )
    return (
        expected.join(file.select(*scope, "path", "content", "sha256"), [*scope, "path"], "left")
        .withColumn("text", text)
        .withColumn("status", status)
        .withColumn("error_code", error)
        .withColumn("sha256", F.when(F.col("status") == "ok", F.col("sha256")))
        .withColumn("text", F.when(F.col("status") == "ok", F.col("text")))
        .drop("content")
    )


def manifest_errors(manifest: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Errors per project; a missing optional file is none."""
    bad = (F.col("status") != "ok") & (F.col("is_required") | (F.col("status") != "missing"))
    return manifest.groupBy(*scope).agg(
        F.count_if(bad).alias("n_errors"),
        F.bool_or(F.col("is_required") & (F.col("status") != "ok")).alias("has_required_errors"),
    )


def tasks_from(document: DataFrame, *, text: str = "text", scope: Sequence[str] = SCOPE) -> DataFrame:
    """Task-list documents -> task rows in document order, template rows dropped. Broken documents give none."""
    schema = T.StructType([T.StructField("tasks", T.ArrayType(_fields("task")))])
    return (
        document.select(*scope, F.posexplode(F.from_json(text, schema)["tasks"]).alias("ord", "_t"))
        .select(*scope, "_t.*", F.col("ord").cast("bigint").alias("ord"))
        .filter(~is_template(F.col("task_id")))
    )


def claims_from(document: DataFrame, *, text: str = "text", scope: Sequence[str] = SCOPE) -> DataFrame:
    """Claims ledgers (a JSON array) -> claim rows, template rows dropped. Missing arrays are empty."""
    fields = T.StructType([*_fields("claim", "claimed_ts").fields, T.StructField("timestamp", T.StringType())])
    rows = (
        document.select(*scope, F.posexplode(F.from_json(text, T.ArrayType(fields))).alias("ord", "_c"))
        .select(*scope, "_c.*", F.col("ord").cast("bigint").alias("ord"))
        .filter(~is_template(F.col("claim_id")))
    )
    for name in ("evidence_refs", "code_refs", "test_refs"):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return rows.withColumn("claimed_ts", parse_timestamp(F.col("timestamp"))).drop("timestamp")


def read_json_documents(spark: SparkSession, path: str, *, project: Column | str) -> DataFrame:
    """JSON files, one document row each: scope, doc_id, text."""
    return spark.read.text(path, wholetext=True).select(
        as_column(project).alias("project_id"), F.input_file_name().alias("doc_id"), F.col("value").alias("text")
    )


def rules_from(document: DataFrame, *, text: str = "text", scope: Sequence[str] = SCOPE) -> DataFrame:
    """Rule documents -> rule rows; a rule's id is the first id key it carries."""
    body = T.StructType(
        [
            *[f for f in _fields("rule", "section", "rule_id", "accepted_at").fields],
            *[T.StructField(k, T.StringType()) for k in RULE_ID_KEYS],
            T.StructField("accepted_at", T.StringType()),
        ]
    )
    schema = T.StructType([T.StructField(s, T.ArrayType(body)) for s in RULE_SECTIONS])
    parsed = document.select(*scope, F.from_json(text, schema).alias("_d"))
    empty = F.array().cast(
        T.ArrayType(
            T.StructType(
                [
                    T.StructField("section", T.StringType()), T.StructField("rule", body),
                    T.StructField("ord", T.LongType()),
                ]
            )
        )
    )

    def entries(number: int, section: str) -> Column:
        """Rules of one section, in document order after those of the sections before it."""
        start = F.lit(0)
        for earlier in RULE_SECTIONS[:number]:
            start = start + F.coalesce(F.array_size(f"_d.{earlier}"), F.lit(0))
        rows = F.transform(
            F.col(f"_d.{section}"),
            lambda rule, i: F.struct(
                F.lit(section).alias("section"), rule.alias("rule"), (i + start).cast("bigint").alias("ord")
            ),
        )
        return F.coalesce(rows, empty)

    sections = F.flatten(F.array(*[entries(n, s) for n, s in enumerate(RULE_SECTIONS)]))
    rows = parsed.select(*scope, F.explode(sections).alias("_r")).select(*scope, "_r.section", "_r.rule.*", "_r.ord")
    ids = [F.when(F.col(k) != "", F.col(k)) for k in RULE_ID_KEYS]
    return rows.withColumn("_id", F.coalesce(*ids)).drop(*RULE_ID_KEYS).select(
        *scope, "section", F.col("_id").alias("rule_id"), "title", "description",
        F.coalesce("severity", F.lit("must")).alias("severity"),
        F.coalesce("verification_method", F.lit("machine")).alias("verification_method"), "accepted_by",
        parse_timestamp(F.col("accepted_at")).alias("accepted_at"), "related_requirements", "related_modules",
        "checker", "verification_command", "ord",
    )


def modules_from(document: DataFrame, *, text: str = "text", scope: Sequence[str] = SCOPE) -> DataFrame:
    """Rule documents -> module boundaries. A missing allow-list stays null, an empty one stays empty."""
    schema = T.StructType([T.StructField("module_boundaries", T.ArrayType(_fields("module_boundary")))])
    return document.select(
        *scope, F.posexplode(F.from_json(text, schema)["module_boundaries"]).alias("ord", "_m")
    ).select(*scope, "_m.*", F.col("ord").cast("bigint").alias("ord"))


def scope_patterns_from(document: DataFrame, *, text: str = "text", scope: Sequence[str] = SCOPE) -> DataFrame:
    """Governance boundary of rule documents: scope, kind, pattern. None means everything is in scope."""
    def patterns(kind: str, key: str) -> Column:
        found = F.from_json(F.get_json_object(text, f"$.governance_boundary.{key}"), "array<string>")
        return F.coalesce(
            F.transform(found, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern"))),
            F.array().cast("array<struct<kind: string, pattern: string>>"),
        )

    both = F.concat(patterns("include", "included_patterns"), patterns("exclude", "excluded_patterns"))
    return document.select(*scope, F.explode(both).alias("_p")).select(*scope, "_p.kind", "_p.pattern")


def decisions_from(document: DataFrame, *, text: str = "text", scope: Sequence[str] = SCOPE) -> DataFrame:
    """Decision logs, ``{"decisions": [...]}`` or a bare list; broken or missing logs give no rows."""
    fields = T.StructType([*_fields("decision", "timestamp").fields, T.StructField("timestamp", T.StringType())])
    items = F.coalesce(
        F.from_json(text, T.StructType([T.StructField("decisions", T.ArrayType(fields))]))["decisions"],
        F.when(F.ltrim(F.col(text)).startswith("["), F.from_json(text, T.ArrayType(fields))),
    )
    return document.select(*scope, F.explode(items).alias("_d")).select(*scope, "_d.*").withColumn(
        "timestamp", parse_timestamp(F.col("timestamp"))
    )


HOUR = 3_600_000_000  # microseconds
UNTIMED_BLOCKS = 4_096
DECISION_FIELDS = ("category", "targetId", "action", "reason", "decidedBy")


def invalid_decisions(request: DataFrame) -> DataFrame:
    """Requests that lack a required field, with the names of the missing ones."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in DECISION_FIELDS]))
    return request.withColumn("missing_fields", missing).filter(F.size("missing_fields") > 0)


def new_decisions(request: DataFrame, log: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Complete requests with ids continuing each project's log, in time order."""
    complete = request.filter(" and ".join(f"{f} is not null" for f in DECISION_FIELDS))
    last = log.groupBy(*scope).agg(F.max("decision_id").alias("_last"))
    # Requests without a time come first, spread over blocks by their fields.
    untimed = -F.pmod(F.xxhash64(*DECISION_FIELDS), F.lit(UNTIMED_BLOCKS)) * HOUR - 1
    timed = complete.withColumn("_at", F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), untimed))
    return (
        number_rows(timed, scope=scope, ord="_at", ties=DECISION_FIELDS, name="_n", block=HOUR)
        .join(last, list(scope), "left")
        .withColumn("decision_id", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("bigint"))
        .select(*scope, "decision_id", *DECISION_FIELDS, "timestamp")
    )


def append_decisions(decision: DataFrame, path: str) -> None:
    """Append to the log, partitioned by project: a small project gets one file, a large one several."""
    decision.hint("rebalance", "project_id").write.mode("append").partitionBy("project_id").json(path)


def changed_files(listing: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Listings of changed paths (scope, text; one path per line) -> distinct changed files."""
    paths = F.filter(F.transform(lines(F.col("text")), lambda line: F.trim(line)), lambda p: p != "")
    return listing.select(*scope, F.explode(paths).alias("path")).distinct()


def snapshot(table: DataFrame, which: str) -> DataFrame:
    """One side of a snapshot table (``snapshot`` = head or staged)."""
    return table.filter(F.col("snapshot") == which).drop("snapshot")
