"""Governance scope: path globs as regular expressions, allow-lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.schemas import ALLOWED_PATHS, ALLOWED_PREFIXES

# One glob token: a character class, or any single character. ``*`` crosses ``/``.
_TOKEN = r"\[!?\]?[^\]]*\]|."


def glob_regex(pattern: str) -> str:
    """Regex body of one glob, for literal patterns known when the plan is written."""

    def piece(token: str) -> str:
        if token == "*":
            return ".*"
        if token == "?":
            return "."
        if len(token) > 1:
            body = re.sub(r"([\\\[\]&^])", r"\\\1", token[1:-1])
            return f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]"
        return re.sub(r"([^\w/ ])", r"\\\1", token, flags=re.ASCII)

    return "".join(piece(token) for token in re.findall(_TOKEN, pattern, flags=re.DOTALL))


def glob_regex_column(pattern: Column) -> Column:
    """The same for patterns that are data, one set per project."""

    def piece(token: Column) -> Column:
        body = F.regexp_replace(F.substr(token, F.lit(2), F.length(token) - 2), r"([\\\[\]&^])", r"\\$1")
        return (
            F.when(token == "*", ".*")
            .when(token == "?", ".")
            .when(
                F.length(token) > 1,
                F.concat(
                    F.lit("["),
                    F.when(body.startswith("!"), F.concat(F.lit("^"), F.substr(body, F.lit(2)))).otherwise(body),
                    F.lit("]"),
                ),
            )
            .otherwise(F.regexp_replace(token, r"([^\w/ ])", r"\\$1"))
        )

    tokens = F.regexp_extract_all(pattern, F.lit(f"(?s)({_TOKEN})"), F.lit(1))
    return F.array_join(F.transform(tokens, piece), "")


def _anchored(body: str) -> str:
    # rlike searches; a glob has to match the whole path, as given or below any folder.
    return rf"(?s)^(?:.*/)?(?:{body})\z"


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return path.rlike(_anchored("|".join(glob_regex(p) for p in patterns)))


def in_scope(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Included by some pattern (or no patterns given) and excluded by none."""
    inside = matches_any(path, include) if include else F.lit(True)
    return inside & ~matches_any(path, exclude)


def scope_regexes(scope_pattern: DataFrame, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    """One row per project with one regex for its includes and one for its excludes, null for none.

    The patterns are a project's configuration, a short list inside one document.
    """

    def alternatives(kind: str) -> Column:
        bodies = F.array_sort(F.collect_set(F.when(F.col("kind") == kind, glob_regex_column(F.col("pattern")))))
        return F.when(
            F.size(bodies) > 0,
            F.concat(F.lit(r"(?s)^(?:.*/)?(?:"), F.array_join(bodies, "|"), F.lit(r")\z")),
        )

    return scope_pattern.groupBy(*scope).agg(
        alternatives("include").alias("include_regex"), alternatives("exclude").alias("exclude_regex")
    )


def with_scope_flag(
    files: DataFrame, scope_pattern: DataFrame, *, path: str = "path", scope: Sequence[str] = ("project_id",)
) -> DataFrame:
    """``files`` with ``in_scope`` by its own project's patterns; no patterns means in scope."""
    flagged = files.join(scope_regexes(scope_pattern, scope), list(scope), "left")
    included = F.col("include_regex").isNull() | F.rlike(F.col(path), F.col("include_regex"))
    excluded = F.coalesce(F.rlike(F.col(path), F.col("exclude_regex")), F.lit(False))
    return flagged.withColumn("in_scope", included & ~excluded).drop("include_regex", "exclude_regex")


def scope_counts(flagged: DataFrame, *, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    """Files in and out of scope per project."""
    return flagged.groupBy(*scope).agg(
        F.count_if("in_scope").alias("n_in_scope"), F.count_if(~F.col("in_scope")).alias("n_out_of_scope")
    )


def is_allowed(
    path: Column, paths: Sequence[str] = ALLOWED_PATHS, prefixes: Sequence[str] = ALLOWED_PREFIXES
) -> Column:
    """Paths that never need a claim: exact ones and everything below a prefix."""
    allowed = path.isin(*paths) if paths else F.lit(False)
    for prefix in prefixes:
        allowed = allowed | path.startswith(prefix)
    return allowed
