"""Shards by a hierarchical weighted hash tree: region, rack, shard. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.rows import only, with_row
from attestra.session import cut_lineage

RACKS_PER_REGION = 2
SHARDS_PER_RACK = 2


@dataclass(frozen=True)
class Leaf:
    """A shard, its place in the tree and its weight."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def regular_tree(shards: int) -> list[Leaf]:
    """Shards of equal weight, filled rack by rack and region by region."""
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    return [Leaf(s, s // per_region, s % per_region // SHARDS_PER_RACK) for s in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own.

    Only the root's children change, so a row that moves wins the new region's draw and goes to the new
    shard: no row moves between old shards.
    """
    return [*tree, Leaf(max((x.shard for x in tree), default=-1) + 1, max((x.region for x in tree), default=-1) + 1, 0, weight)]


def reweigh(tree: list[Leaf], weights: dict[int, float]) -> list[Leaf]:
    """Other weights for some shards. Rows move only where a subtree whose weight changed is involved."""
    return [replace(x, weight=weights.get(x.shard, x.weight)) for x in tree]


def _draw(key: Column, node: str, weight: float) -> Column:
    """The node's draw for a key: exponential with the node's weight as its rate; the least draw wins.

    Draws of other nodes do not depend on it, so a changed weight changes one draw of its level.
    """
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(uniform) / F.lit(float(weight))


def _least(draws: list[tuple[int, Column]]) -> Column:
    """The number with the least draw; the smaller number on a tie."""
    if len(draws) == 1:
        return F.lit(draws[0][0])
    return F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(n).alias("n")) for n, d in draws])).getField("n")


def _choose(of: Column, branches: dict[int, Column]) -> Column:
    """The branch of the chosen number; the other branches are not evaluated."""
    chosen = None
    for number, branch in branches.items():
        chosen = F.when(of == number, branch) if chosen is None else chosen.when(of == number, branch)
    return chosen


def with_shard(df: DataFrame, key: Column, tree: list[Leaf], name: str = "shard") -> DataFrame:
    """Add the shard of ``key`` (a string; null counts as the text "null"): one draw per child on the way down."""
    tree = [x for x in tree if x.weight > 0]
    key = F.coalesce(key, F.lit("null"))
    regions: dict[int, dict[int, list[Leaf]]] = {}
    for leaf in tree:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    weight = {r: sum(x.weight for rack in racks.values() for x in rack) for r, racks in regions.items()}
    region, rack = f"_{name}_region", f"_{name}_rack"
    df = df.withColumn(region, _least([(r, _draw(key, f"r{r}", weight[r])) for r in regions]))
    df = df.withColumn(rack, _choose(F.col(region), {
        r: _least([(k, _draw(key, f"r{r}/k{k}", sum(x.weight for x in leaves))) for k, leaves in racks.items()])
        for r, racks in regions.items()
    }))
    df = df.withColumn(name, _choose(F.col(region), {
        r: _choose(F.col(rack), {
            k: _least([(x.shard, _draw(key, f"r{r}/k{k}/s{x.shard}", x.weight)) for x in leaves])
            for k, leaves in racks.items()
        })
        for r, racks in regions.items()
    }))
    return df.drop(region, rack)


def shards(
    docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: its id, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard``.

    The id alone decides (law ``key``), whatever the text: rows of one id, repeated rows and rows without
    an id (one key) share a shard. ``size`` is the UTF-8 length plus 1, null counting as 0 bytes; the
    checksum of a null text is that of the empty text. ``slot`` numbers a shard's rows from 0 without
    gaps, in the order of the id, nulls first and repeated ids in stored order. ``grown_shard`` is the
    shard under the tree ``grown``.

    Texts are read once and not shuffled. Slots come from ranges of (shard, id): each range is numbered on
    its own and only the counts of ranges are added up, so no task holds a shard. Repeated ids are ordered
    by their stored row, so a range may end between them.
    """
    key = F.col("id").cast("string")
    rows = only(docs, id_column, text).select(
        F.col(f"`{id_column}`").alias("id"),
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = with_shard(with_row(rows, "_row")[0], key, tree)
    rows = with_shard(rows, key, grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    order = ["shard", "id", "_row"]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    )
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("id", "_row"))
    return (
        ranged.withColumn("_local", local)
        .join(offsets, ["shard", "_range"])
        .select(
            F.col("id").alias(id_column), "size", "text_crc32", "shard",
            (F.col("_before") + F.col("_local") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
