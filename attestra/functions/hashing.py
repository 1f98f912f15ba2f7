"""Content hashes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: Iterable[str], length: int = 16) -> Column:
    """Short hash of the named columns, independent of their order; null fields count as absent."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, length)


def with_content_hash(
    df: DataFrame, *, exclude: Iterable[str] = ("content_hash", "claimed_ts", "ord"), name: str = "content_hash"
) -> DataFrame:
    """``df`` with the hash of all other columns in ``name``, replacing a wrong or missing one."""
    dropped = {*exclude, name}
    return df.withColumn(name, row_hash(c for c in df.columns if c not in dropped))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spacing, so equal documents are equal texts; null if invalid."""
    return F.to_json(F.try_parse_json(text))
