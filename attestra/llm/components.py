"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links``; ``root`` is the smallest node of its component.

    Links are rows of two whole numbers and are read as undirected; loops and nulls are no links and
    repeated links count once. Every round points each node's larger neighbours, then its smaller
    ones, at the smallest neighbour. All steps are aggregates and joins against one row per node, so
    a node with very many links costs no more than its rows, and adaptive execution may split them.
    The rounds grow with the logarithm of the longest path. Each round is materialised in the shared
    folder. An empty table gives an empty table.
    """
    x, y = F.col(a), F.col(b)
    edges = cut_lineage(
        links.filter((x != y))
        .select(F.greatest(x, y).alias("big"), F.least(x, y).alias("small"))
        .distinct()
    )
    seen = _digest(edges)
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct()
    return edges.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("small").alias("node"), F.col("big").alias("other")).unionByName(
        edges.select(F.col("big").alias("node"), F.col("small").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    return edges.join(least, edges["small"] == least["node"]).select(
        "big", F.least(F.col("small"), F.col("least")).alias("small")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("big").agg(F.min("small").alias("least"))
    inner = edges.join(least, "big").filter("small != least").select(F.col("small").alias("big"), F.col("least").alias("small"))
    return inner.unionByName(least.select("big", F.col("least").alias("small"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal tables. The sum is a decimal: one of whole numbers overflows from about 100,000 rows on."""
    h = F.xxhash64("big", "small")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(28,0)"))).collect()[0])
