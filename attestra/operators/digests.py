"""Hash trees over ledgers: equal projects and equal parts of a project are passed over before any row is compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.sequence import SCOPE

LEAVES = 16
_SUMS = ("n_rows", "digest_a", "digest_b")


def leaf_of(key: str, leaves: int = LEAVES) -> Column:
    """The leaf a key's rows belong to."""
    return F.pmod(F.xxhash64(key), F.lit(leaves)).cast("int")


def _sum_of(*columns: Column | str) -> list[Column]:
    """Two sums of row hashes. Their order does not matter, and a repeated row counts as often as it is there."""
    return [
        F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")).cast("decimal(38,0)").alias(name)
        for seed, name in enumerate(_SUMS[1:])
    ]


def leaf_digests(
    rows: DataFrame, *, ledger: str, key: str, content: Sequence[str], leaves: int = LEAVES, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Leaves of a ledger's tree: scope, ledger, leaf, n_rows and two digests of ``key`` and ``content``.

    An aggregate that is combined before the shuffle: a project is at most ``leaves`` rows of a task's output.
    """
    return rows.groupBy(*scope, F.lit(ledger).alias("ledger"), leaf_of(key, leaves).alias("leaf")).agg(
        F.count(F.lit(1)).alias("n_rows"), *_sum_of(key, *content)
    )


def folded(tree: DataFrame, *by: str, scope: Sequence[str] = SCOPE) -> DataFrame:
    """The level above: digests of digests per scope and ``by`` (``ledger``, or nothing for the project's root)."""
    rest = [c for c in ("ledger", "leaf") if c in tree.columns and c not in by]
    return tree.groupBy(*scope, *by).agg(F.sum("n_rows").alias("n_rows"), *_sum_of(*rest, *_SUMS))


def _unequal(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    def side(tree: DataFrame, name: str) -> DataFrame:
        return tree.select(*keys, F.struct(*_SUMS).alias(name))

    return side(old, "_old").join(side(new, "_new"), keys, "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys)


def differing(old: DataFrame, new: DataFrame, *, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Leaves in which two trees differ: scope, ledger, leaf. From the root down, only what differs is opened."""
    keys = list(scope)
    roots = _unequal(folded(old, scope=scope), folded(new, scope=scope), keys) if keys else None

    def below(tree: DataFrame, above: DataFrame | None, on: list[str]) -> DataFrame:
        return tree if above is None else tree.join(above, on, "left_semi")

    ledgers = _unequal(
        *(below(folded(tree, "ledger", scope=scope), roots, keys) for tree in (old, new)), [*keys, "ledger"]
    )
    return _unequal(*(below(tree, ledgers, [*keys, "ledger"]) for tree in (old, new)), [*keys, "ledger", "leaf"])


def in_leaves(
    rows: DataFrame, leaves: DataFrame, *, ledger: str, key: str, n_leaves: int = LEAVES, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Rows of a ledger that lie in the given leaves."""
    wanted = leaves.filter(F.col("ledger") == ledger).select(*scope, F.col("leaf").alias("_leaf"))
    return rows.withColumn("_leaf", leaf_of(key, n_leaves)).join(wanted, [*scope, "_leaf"], "left_semi").drop("_leaf")
