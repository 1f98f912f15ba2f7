"""Order-dependent operators without whole-project windows: numbering, first-wins, worst-N."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.session import cut_lineage

SCOPE = ("project_id",)
BLOCK = 100_000


def number_rows(
    df: DataFrame,
    *,
    scope: Sequence[str] = SCOPE,
    rank: str | None = None,
    ord: str = "ord",
    ties: Sequence[str] = (),
    name: str = "seq",
    block: int = BLOCK,
    materialise: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """1-based position of each row in its scope, ordered by ``rank``, ``ord``, ``ties``.

    A project may hold a large part of all rows, so its rows are not sorted in one task. They are cut
    into blocks of consecutive ``ord`` values; a row's position is its position in its block plus the
    number of rows in earlier blocks. Only block counts are ordered project-wide. ``ord`` must be a
    whole number, and one ``ord`` value may only hold what one source row expands to.

    The input is read twice, for the counts and for the rows; ``materialise`` computes a costly one once.
    """
    if materialise is not None:
        df = materialise(df)
    groups = [*([rank] if rank else []), "_block"]
    blocked = df.withColumn("_block", F.expr(f"`{ord}` div {block}"))
    return _number_in_groups(blocked, scope, groups, [ord, *ties], name).drop("_block")


def number_by_range(
    df: DataFrame,
    *,
    scope: Sequence[str] = SCOPE,
    order: Sequence[str],
    name: str = "seq",
    partitions: int | None = None,
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """The same for any order columns, texts too, that are unique per scope.

    Rows are cut into ranges of about equal size, whatever their project, and each range is numbered
    on its own. The range a row fell into is sampled, so it is materialised with the row: a lost
    executor then cannot bring back other ranges.
    """
    # Without a number Spark cuts as many ranges as its shuffles start with, and adaptive execution joins small neighbours.
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *scope, *order).withColumn("_range", F.spark_partition_id())
    return _number_in_groups(materialise(ranged), scope, ["_range"], order, name).drop("_range")


def _number_in_groups(
    df: DataFrame, scope: Sequence[str], groups: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """Position in the row's group plus the rows of the scope's earlier groups."""
    keys = [*scope, *groups]
    earlier = Window.partitionBy(*scope).orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn("_local", local)
        .join(offsets, keys)
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_local", "_before")
    )


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order: an aggregate, combined before the shuffle."""
    return _edge_per_key(df, key, order, F.min_by)


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in the given order."""
    return _edge_per_key(df, key, order, F.max_by)


def _edge_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], edge) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    by: Column = F.struct(*order)
    return (
        df.groupBy(*key)
        .agg(edge(F.struct(*rest), by).alias("_row"))
        .select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def top_per_scope(
    df: DataFrame, n: int, order: Sequence[Column], *, scope: Sequence[str] = SCOPE, name: str = "position"
) -> DataFrame:
    """The first ``n`` rows per scope. Spark cuts each task's rows to ``n`` per scope before the shuffle."""
    window = Window.partitionBy(*scope).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
