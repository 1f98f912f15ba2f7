"""Roll-ups kept up to date: signed counts per item and status instead of the evidence itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators.sequence import SCOPE

COUNT = "n"


def status_counts(cover: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """``cover`` (scope, item_id, source_type, status) -> the same with ``n``, how many rows say so.

    Coverage operators take the counts in place of the rows with ``weight="n"``. A hot item is a few rows here.
    """
    return cover.groupBy(*scope, "item_id", "source_type", "status").agg(F.count(F.lit(1)).alias(COUNT))


def changes(added: DataFrame, removed: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Signed counts of a change set; a changed row is one removed and one added. Statuses that come and go leave nothing."""
    keys = [*scope, "item_id", "source_type", "status"]
    signed = added.select(*keys, F.lit(1).alias("_sign")).unionByName(removed.select(*keys, F.lit(-1).alias("_sign")))
    return signed.groupBy(*keys).agg(F.sum("_sign").cast("bigint").alias(COUNT)).filter(F.col(COUNT) != 0)


def changed_rows(before: DataFrame, after: DataFrame, key: Sequence[str], *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Signed counts between two states of an evidence ledger, from the rows whose key, item or status differ.

    Equal rows cancel out before anything is counted, however often they repeat.
    """
    fields = [*scope, *key, "item_id", "source_type", "status"]
    signed = before.select(*fields, F.lit(-1).alias("_sign")).unionByName(after.select(*fields, F.lit(1).alias("_sign")))
    kept = signed.groupBy(*fields).agg(F.sum("_sign").alias("_sign")).filter("_sign != 0")
    return (
        kept.groupBy(*scope, "item_id", "source_type", "status").agg(F.sum("_sign").cast("bigint").alias(COUNT))
        .filter(F.col(COUNT) != 0)
    )


def merged(counts: DataFrame, delta: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Counts after a change set. Statuses nothing has any more are gone; a count below zero stays, as it tells of a wrong change set."""
    keys = [*scope, "item_id", "source_type", "status"]
    both = counts.select(*keys, COUNT).unionByName(delta.select(*keys, COUNT))
    return both.groupBy(*keys).agg(F.sum(COUNT).alias(COUNT)).filter(F.col(COUNT) != 0)


def inconsistencies(counts: DataFrame) -> DataFrame:
    """Counts below zero: a change set took away what was never there."""
    return counts.filter(F.col(COUNT) < 0)
