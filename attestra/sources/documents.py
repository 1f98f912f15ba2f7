"""Requirement documents: Markdown texts to requirement and criterion rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.functions.ids import as_column, parent_requirement
from attestra.operators.sequence import SCOPE

# Section and field names of requirement documents.
PRIORITY_WORD = "优先级"
CATEGORY_WORD = "类别"
TEST_FLAG = "是否必须有测试"
TEST_YES = rf"{TEST_FLAG}[：:]\s*是"
TEST_NO = rf"{TEST_FLAG}[：:]\s*否"
PRIORITY_VALUES = ("must", "should", "could")
CATEGORY_VALUES = ("functional", "quality_evolution")


def read_documents(spark: SparkSession, path: str, *, project: Column | str) -> DataFrame:
    """Text files as document rows; ``doc_id`` is the file's path."""
    return spark.read.text(path, wholetext=True).select(
        as_column(project).alias("project_id"), F.input_file_name().alias("doc_id"), F.col("value").alias("text")
    )


_FENCED = r"(?s)^\s*---[ \t]*\r?\n(.*?\r?\n|)[ \t]*---[ \t]*(?:\r?\n|\z)"


def front_matter(document: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """``key: value`` lines between the leading fences: scope, doc_id, key, value. The last value of a key counts."""
    body = F.regexp_extract("text", _FENCED, 1)
    entries = F.transform(
        F.filter(
            F.transform(tx.lines(body), lambda line: F.trim(line)),
            lambda line: (line != "") & ~line.startswith("#") & line.contains(":"),
        ),
        lambda line: F.struct(
            F.trim(F.substring_index(line, ":", 1)).alias("key"),
            F.regexp_replace(
                F.trim(F.substr(line, F.instr(line, ":") + 1)), r"""^"(.*)"$|^'(.*)'$""", "$1$2"
            ).alias("value"),
        ),
    )
    return (
        document.select(*scope, "doc_id", F.posexplode(entries).alias("_pos", "_e"))
        .groupBy(*scope, "doc_id", F.col("_e.key").alias("key"))
        .agg(F.max_by("_e.value", "_pos").alias("value"))
    )


def project_documents(document: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Status, name and id of each document's project from its front matter, with defaults."""
    meta = front_matter(document, scope=scope)

    def value(key: str) -> Column:
        return F.max(F.when((F.col("key") == key) & (F.col("value") != ""), F.col("value")))

    found = meta.groupBy(*scope, "doc_id").agg(
        value("status").alias("_status"), value("project_name").alias("project_name"),
        F.coalesce(value("project_abbreviation"), value("project_prefix")).alias("_prefix"),
    )
    return document.select(*scope, "doc_id").join(found, [*scope, "doc_id"], "left").select(
        *scope, "doc_id", F.coalesce("_status", F.lit("active")).alias("status"), "project_name",
        F.coalesce("_prefix", F.lit("P")).alias("id_prefix"),
    )


def document_lines(document: DataFrame, *, prefix: str | Column, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Non-empty body lines with the section they are in.

    ``kind``: heading or text. ``req_id`` and ``ac_id`` are the open requirement and criterion,
    ``section`` is priority or category while its value is due. Section state is carried down the
    lines of one document, which is one row's text.
    """
    p = as_column(prefix)
    req_pattern = F.concat(F.lit("(REQ-"), p, F.lit(r"-\d+|Q-\d+)"))
    ac_pattern = F.concat(F.lit("(AC-"), p, F.lit(r"-\d+-\d+)"))
    body = F.regexp_replace("text", _FENCED, "")
    rows = (
        document.select(*scope, "doc_id", F.posexplode(tx.lines(body)).alias("line", "raw"))
        .withColumn("raw", F.trim("raw"))
        .filter(F.col("raw") != "")
        .withColumn("level", F.length(F.regexp_extract("raw", r"^(#{1,6})(?:\s|$)", 1)))
        .withColumn("content", F.when(F.col("level") > 0, F.regexp_replace("raw", r"^#+\s*|\s+#+\s*$", ""))
                    .otherwise(F.regexp_replace("raw", r"^(?:[-*+]|\d+[.)])\s+", "")))
        .withColumn("req_ids", F.when(F.col("level") > 0, F.regexp_extract_all("content", req_pattern, F.lit(1))))
        .withColumn("ac_ids", F.when(F.col("level") > 0, F.regexp_extract_all("content", ac_pattern, F.lit(1))))
    )
    level, first_req, first_ac = F.col("level"), F.try_element_at("req_ids", F.lit(1)), F.try_element_at("ac_ids", F.lit(1))
    # Markers: the empty string closes a section, null leaves it as it is.
    req_mark = (
        F.when((level == 3) & first_req.isNotNull(), first_req)
        .when(level.isin(1, 2), "")
        .when((level == 3) & first_ac.isNull(), "")
    )
    down = Window.partitionBy(*scope, "doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("req_id", F.nullif(F.last(req_mark, ignorenulls=True).over(down), F.lit("")))
    ac_mark = (
        F.when((level == 5) & first_ac.isNotNull(), first_ac)
        .when(level.isin(1, 2), "")
        .when((level == 3) & (first_req.isNotNull() | first_ac.isNull()), "")
        .when(
            (level == 4)
            & (
                (F.col("content").contains(PRIORITY_WORD) & F.col("req_id").isNotNull())
                | (F.col("content").contains(CATEGORY_WORD) & F.col("req_id").isNotNull())
                | (first_req.isNull() & first_ac.isNull())
            ),
            "",
        )
    )
    due_mark = F.when(
        level > 0,
        F.when((level == 4) & F.col("content").contains(PRIORITY_WORD) & F.col("req_id").isNotNull(), "priority")
        .when((level == 4) & F.col("content").contains(CATEGORY_WORD) & F.col("req_id").isNotNull(), "category")
        .otherwise(""),
    )
    return (
        rows.withColumn("ac_id", F.nullif(F.last(ac_mark, ignorenulls=True).over(down), F.lit("")))
        .withColumn("section", F.nullif(F.last(due_mark, ignorenulls=True).over(down), F.lit("")))
        .withColumn("_since_heading", F.last(F.when(level > 0, F.col("line")), ignorenulls=True).over(down))
        .withColumn("kind", F.when(level > 0, "heading").otherwise("text"))
    )


def parse_requirements(lines: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Requirements: scope, doc_id, req_id, title, priority, category, ord. Absent or invalid values are unclear."""
    heading = lines.filter((F.col("level") == 3) & (F.size("req_ids") > 0))
    opened = heading.select(
        *scope, "doc_id", "req_id", F.col("line").cast("bigint").alias("ord"),
        tx.clean_title(F.substr("content", F.instr("content", F.col("req_id")) + F.length("req_id"))).alias("title"),
    )
    values = (
        lines.filter((F.col("kind") == "text") & F.col("section").isNotNull())
        .groupBy(*scope, "doc_id", "req_id", "section", "_since_heading")
        .agg(F.min_by(F.lower("content"), "line").alias("value"))
        .groupBy(*scope, "doc_id", "req_id")
        .agg(
            F.max_by(F.when(F.col("section") == "priority", F.col("value")),
                     F.when(F.col("section") == "priority", F.col("_since_heading"))).alias("_priority"),
            F.max_by(F.when(F.col("section") == "category", F.col("value")),
                     F.when(F.col("section") == "category", F.col("_since_heading"))).alias("_category"),
        )
    )
    return opened.join(values, [*scope, "doc_id", "req_id"], "left").select(
        *scope, "doc_id", "req_id", "title",
        F.when(F.col("_priority").isin(*PRIORITY_VALUES), F.col("_priority")).otherwise("unclear").alias("priority"),
        F.when(F.col("_category").isin(*CATEGORY_VALUES), F.col("_category")).otherwise("unclear").alias("category"),
        "ord", F.col("_priority").alias("raw_priority"), F.col("_category").alias("raw_category"),
    )


def parse_criteria(lines: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Criteria: scope, doc_id, req_id (the open requirement), ac_id, title, is_testing_required, ord.

    The last line with the test flag counts; ``flag_state`` is missing, invalid or ok.
    """
    heading = lines.filter((F.col("level") == 5) & (F.size("ac_ids") > 0))
    opened = heading.select(
        *scope, "doc_id", "req_id", "ac_id", F.col("line").cast("bigint").alias("ord"),
        tx.clean_title(F.substr("content", F.instr("content", F.col("ac_id")) + F.length("ac_id"))).alias("title"),
    )
    flag = F.when(F.col("content").rlike(TEST_YES), "yes").when(F.col("content").rlike(TEST_NO), "no").otherwise("bad")
    flags = (
        lines.filter(
            (F.col("kind") == "text") & F.col("ac_id").isNotNull() & F.col("section").isNull()
            & F.col("content").contains(TEST_FLAG)
        )
        .groupBy(*scope, "doc_id", "ac_id")
        .agg(
            F.max_by(F.when(flag != "bad", flag), F.when(flag != "bad", F.col("line"))).alias("_flag"),
            F.bool_or(flag == "bad").alias("_bad"),
        )
    )
    return opened.join(flags, [*scope, "doc_id", "ac_id"], "left").select(
        *scope, "doc_id", "req_id", "ac_id", "title",
        F.coalesce(F.col("_flag") == "yes", F.lit(False)).alias("is_testing_required"), "ord",
        F.when(F.col("_bad"), "invalid").when(F.col("_bad").isNull(), "missing").otherwise("ok").alias("flag_state"),
    )


def document_problems(
    lines: DataFrame, requirement: DataFrame, criterion: DataFrame, *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Everything wrong with requirement documents: scope, doc_id, problem, item_id."""
    keys = [*scope, "doc_id"]

    def rows(df: DataFrame, problem: str, item: Column) -> DataFrame:
        return df.select(*keys, F.lit(problem).alias("problem"), item.alias("item_id"))

    def repeated(column: str, problem: str) -> DataFrame:
        seen = lines.filter(F.col("kind") == "heading").select(*keys, F.explode(column).alias("id"))
        return rows(seen.groupBy(*keys, "id").count().filter("count > 1"), problem, F.col("id"))

    req_off = lines.filter((F.size("req_ids") > 0) & (F.col("level") != 3))
    ac_off = lines.filter((F.size("ac_ids") > 0) & (F.col("level") != 5))
    misplaced = criterion.filter(~F.col("req_id").eqNullSafe(parent_requirement(F.col("ac_id"))))
    defined = requirement.select(*keys, F.col("req_id").alias("_parent")).distinct()
    orphans = (
        criterion.withColumn("_parent", parent_requirement(F.col("ac_id")))
        .join(defined, [*keys, "_parent"], "left_anti").select(*keys, "ac_id").distinct()
    )
    return reduce(
        DataFrame.unionByName,
        [
            rows(req_off, "requirement_heading_level", F.col("content")),
            rows(ac_off, "criterion_heading_level", F.col("content")),
            rows(misplaced, "criterion_under_wrong_requirement", F.col("ac_id")),
            rows(orphans, "parent_requirement_missing", F.col("ac_id")),
            rows(criterion.filter("flag_state = 'missing'"), "test_flag_missing", F.col("ac_id")),
            rows(criterion.filter("flag_state = 'invalid'"), "test_flag_invalid", F.col("ac_id")),
            rows(requirement.filter("raw_priority is null"), "priority_missing", F.col("req_id")),
            rows(requirement.filter(F.col("raw_priority").isNotNull() & ~F.col("raw_priority").isin(*PRIORITY_VALUES)),
                 "priority_invalid", F.col("req_id")),
            rows(requirement.filter("raw_category is null"), "category_missing", F.col("req_id")),
            rows(requirement.filter(F.col("raw_category").isNotNull() & ~F.col("raw_category").isin(*CATEGORY_VALUES)),
                 "category_invalid", F.col("req_id")),
            rows(requirement.filter(F.col("req_id").rlike(r"^Q-\d+") & (F.col("category") != "quality_evolution")),
                 "quality_category_expected", F.col("req_id")),
            repeated("req_ids", "duplicate_requirement"),
            repeated("ac_ids", "duplicate_criterion"),
        ],
    )
