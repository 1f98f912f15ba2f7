"""Near-duplicate vectors through a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.components import components
from attestra.llm.rows import only
from attestra.session import cut_lineage, stored

COSINE = 0.98
#: A vector is described by its nearest pivots; linked vectors are looked for among those that share enough of them.
NEAREST, SHARED = 8, 3
#: Pivots are fitted on a sample: about the root of the number of vectors, within these bounds.
MIN_PIVOTS, MAX_PIVOTS = 64, 1024
#: Pivots this close to an earlier one are left out, so that a large group of copies gives one pivot.
PIVOT_COSINE = 0.9
#: Longer posting lists are cut into blocks of so many entries, and the blocks are paired.
BLOCK = 512
#: The list of vectors that have no pivot of their length.
NO_PIVOT = -1


def _unit(raw: bytes | list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision, a row each."""
    x = np.array([np.frombuffer(r, kind) for r in raw], np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vectors: DataFrame, kind: str) -> DataFrame:
    """``(row, dim, raw)``: vectors as bytes; those that link with nothing have a null ``raw``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws: list[bytes | None] = []
            for vector, label in zip(batch.column(1), batch.column(2), strict=True):
                values = vector.values
                if label.as_py() is None or values is None or values.null_count or not len(values):
                    raws.append(None)
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(kind)
                raws.append((x + 0).tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(raws, pa.binary())], names=["row", "label", "id", "raw"]
            )

    schema = T.StructType([
        T.StructField("row", T.LongType()), vectors.schema["label"], vectors.schema["id"], T.StructField("raw", T.BinaryType())
    ])
    return vectors.select("row", "vector", "label", "id").mapInArrow(run, schema)


def fit_pivots(nodes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Reference points by vector length, from the sample of nodes with the smallest hashes."""
    size = int(np.clip(np.sqrt(nodes.count()), MIN_PIVOTS, MAX_PIVOTS))
    sample = nodes.select("raw").distinct().orderBy(F.xxhash64("raw"), "raw").limit(2 * size).collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in sample:
        by_dim.setdefault(len(r.raw), []).append(bytes(r.raw))
    pivots = {}
    for dim, raws in by_dim.items():
        x = _unit(raws, kind)
        close = x @ x.T >= PIVOT_COSINE
        kept: list[int] = []
        for i in range(len(x)):
            if not close[i, kept].any():
                kept.append(i)
        pivots[dim] = x[kept[:size]]
    return pivots


def describe(nodes: DataFrame, pivots: dict[int, np.ndarray], kind: str) -> DataFrame:
    """Add ``nearest``, the numbers of the nearest pivots, nearest first."""
    shipped = nodes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            nearest: list[list[int]] = [[NO_PIVOT]] * len(raws)
            for dim in {len(r) for r in raws} & known.keys():
                at = [i for i, r in enumerate(raws) if len(r) == dim]
                near = -(_unit([raws[i] for i in at], kind) @ known[dim].T)
                order = np.argsort(near, axis=1, kind="stable")[:, :NEAREST]
                for i, row in zip(at, order.tolist(), strict=True):
                    nearest[i] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest, pa.list_(pa.int32()))], names=[*batch.schema.names, "nearest"]
            )

    schema = T.StructType([*nodes.schema.fields, T.StructField("nearest", T.ArrayType(T.IntegerType()))])
    return nodes.mapInArrow(run, schema)


def postings(described: DataFrame) -> DataFrame:
    """``(label, dim, pivot, node)``: the inverted pivot lists.

    Vectors that share SHARED pivots share one of the first of them in the order of their numbers, so a
    vector is posted under those only.
    """
    few = F.least(F.lit(SHARED), F.size("nearest"))
    prefix = F.slice(F.array_sort("nearest"), F.lit(1), F.size("nearest") - few + 1)
    return described.select("label", F.length("raw").alias("dim"), F.explode(prefix).alias("pivot"), "node")


def _paired_blocks(lists: DataFrame) -> DataFrame:
    """Lists with their entries in blocks, each entry once per pair of blocks it is in."""
    key = ["label", "dim", "pivot"]
    lengths = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cut = lists.join(lengths, key).withColumn("_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    other = cut.select(*key, "node", "block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    return other.select(
        *key, "node", "block", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high")
    )


def links(described: DataFrame, kind: str, threshold: float = COSINE) -> DataFrame:
    """``(node, links, other)``: rows linked in one part of a list, and a neighbour in its part of the component.

    In each pair of blocks, the pivots that two vectors share are counted, pairs with fewer than SHARED go, and
    the cosine of the rest is computed in double precision. A pair is counted in the list of the smallest
    pivot it shares, so once. A part gives a row per vector, not per pair.
    """
    entries = _paired_blocks(postings(described)).join(described.select("node", "n_rows", "raw", "nearest"), "node")

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        low, high, pivot = (int(part[c].iloc[0]) for c in ("low", "high", "pivot"))
        x = _unit(list(part["raw"]), kind)
        near = np.array(part["nearest"].tolist())
        shared = np.zeros((len(x), len(x)), np.int16)
        smaller = np.zeros((len(x), len(x)), bool)
        for column in near.T:
            same = near[:, :, None] == column[None, None, :]
            shared += same.any(axis=1)
            smaller |= (same & (near < pivot)[:, :, None]).any(axis=1)
        linked = (shared >= min(SHARED, near.shape[1])) & ~smaller & (x @ x.T >= threshold)
        np.fill_diagonal(linked, False)
        if low != high:
            block = part["block"].to_numpy()
            linked &= block[:, None] != block[None, :]
        rows = np.flatnonzero(linked.any(axis=1))
        linked, nodes = linked[np.ix_(rows, rows)], part["node"].to_numpy()[rows]
        least = np.arange(len(rows))
        while len(rows):
            lower = np.minimum(least, np.where(linked, least[None, :], len(rows)).min(axis=1))
            if (lower == least).all():
                break
            least = lower
        return pd.DataFrame({"node": nodes, "links": linked @ part["n_rows"].to_numpy()[rows], "other": nodes[least]})

    key = ["label", "dim", "pivot", "low", "high"]
    return entries.groupBy(*key).applyInPandas(verify, "node long, links long, other long")


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = COSINE
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row: links at ``threshold`` and more within a label.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link
    with nothing; neither do vectors of different lengths. Equal vectors of a label are one node,
    however many rows have it, and each row counts the others. ``component_id`` is the smallest id
    reachable; a row without an id has the smallest of the others, or null. Repeated rows stay.

    The pivots are fitted on a bounded sample, every vector is indexed, and every pair of a list is looked
    at. A list that holds a large part of all vectors is cut into blocks, so no task holds it.
    """
    kind = "<f8" if only(vectors, vector).schema[0].dataType.elementType == T.DoubleType() else "<f4"
    rows = only(vectors, id_column, vector, label).toDF("id", "vector", "label").withColumn("row", F.monotonically_increasing_id())
    rows = stored(_valid(rows, kind), "vectors")
    valid = rows.filter("raw IS NOT NULL")
    nodes = cut_lineage(
        valid.groupBy("label", "raw").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("least_id"))
    )
    described = stored(describe(nodes, fit_pivots(nodes, kind), kind), "described")
    found = cut_lineage(links(described, kind, threshold))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    n_links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = cut_lineage(
        described.select("node", "label", "raw", "n_rows", "least_id").join(n_links, "node", "left").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = placed.join(least, "root").select("label", "raw", (F.coalesce("links", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"), "component_id")
    joined = rows.join(of, ["label", "raw"], "left")
    component = F.when(F.col("raw").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
