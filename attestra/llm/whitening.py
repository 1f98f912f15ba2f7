"""Whitening of embeddings through the covariance of distinct vectors, weighted by their multiplicity."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.rows import only
from attestra.session import stored

SCALE = 256
COMPONENTS = 4
#: A vector that holds this share of all rows is hot. There are no more of them than the share's inverse.
HOT_SHARE = 1000
#: Rows of a hot vector are dealt over so many keys.
SALTS = 64
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
LONG, DIGITS = 1 << 62, 10**38


class Whitening(NamedTuple):
    """What is fitted for the vectors of one length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: list[float | None]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as bytes of the smallest width that holds them, so equal vectors give equal bytes."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kind = next(k for k in WIDTHS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return x.astype(kind).tobytes()


def _unpacked(raws: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one length and width, a row each."""
    kind = next(k for k in WIDTHS if np.dtype(k).itemsize * dim == len(raws[0]))
    return np.frombuffer(b"".join(raws), kind).reshape(len(raws), dim).astype(np.int64)


def quantised(vectors: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``(id, dim, x)``: floor(scale * c) of every entry, packed.

    Vectors that are null, or hold null or non-finite entries, or entries that no long can hold, are gone.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            at = column.offsets.to_numpy()
            first = int(at[0]) if len(at) else 0
            entries = column.values.slice(first, int(at[-1]) - first if len(at) else 0)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * entries.cast(pa.float64()).to_numpy(zero_copy_only=False))
                bad = ~(np.abs(x) < 2.0**63)
            before = np.concatenate([[0], np.cumsum(bad)])
            x = np.where(bad, 0, x).astype(np.int64)
            at = at - first
            usable = (before[at[1:]] == before[at[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(usable)
            raws = [_packed(x[at[r] : at[r + 1]]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array((at[1:] - at[:-1])[rows], pa.int32()), pa.array(raws, pa.binary())],
                names=["id", "dim", "x"],
            )

    rows = only(vectors, id_column, vector).toDF("id", "vector")
    schema = T.StructType([rows.schema["id"], T.StructField("dim", T.IntegerType()), T.StructField("x", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """``(dim, rows, bytes)`` for the vectors of each length and width in a batch."""
    dims, raws = batch.column("dim").to_pylist(), batch.column("x").to_pylist()
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (dim, raw) in enumerate(zip(dims, raws, strict=True)):
        kinds.setdefault((dim, len(raw)), []).append(i)
    for (dim, size), rows in kinds.items():
        if size:
            yield dim, np.array(rows), [raws[i] for i in rows]


def _exact_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    if int(np.abs(x.astype(np.float64)).max()) * int(weight.sum()) >= LONG:
        x, weight = x.astype(object), weight.astype(object)
    return [int(v) for v in (x * weight[:, None]).sum(axis=0)]


def _totals(nodes: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """``dim -> (n, sums)``: the fit list's weight and exact sums per dimension."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for dim, rows, raws in _groups(batch):
                x, weight = _unpacked(raws, dim), weights[rows]
                new = [int(weight.sum()), *_exact_sums(x, weight)]
                held[dim] = [a + b for a, b in zip(held.get(dim, [0] * (dim + 1)), new, strict=True)]
        for dim, values in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * (dim + 1), pa.int32()), pa.array(range(dim + 1), pa.int32()),
                 pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], names=["dim", "at", "value"],
            )

    parts = nodes.select("dim", "x", "weight").mapInArrow(run, "dim int, at int, value decimal(38,0)")
    held: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("dim", "at").agg(F.sum("value").alias("value")).collect():
        held.setdefault(r.dim, {})[r["at"]] = int(r.value)
    return {dim: (at[0], [at[i] for i in range(1, dim + 1)]) for dim, at in held.items()}


Centred = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def _products(nodes: DataFrame, columns: list[str], centred: Centred) -> dict[int, np.ndarray]:
    """``dim -> matrix``: weighted products of centred rows, a matrix per task, summed row by row of the matrix."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, y, weight in centred(batch):
                product = y.T @ (y * weight[:, None])
                held[dim] = held[dim] + product if dim in held else product
        part = TaskContext.get().partitionId()
        for dim, matrix in held.items():
            size = len(matrix)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([part] * size, pa.int32()),
                 pa.array([row.tobytes() for row in matrix], pa.binary())], names=["dim", "at", "part", "raw"],
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = np.sum([np.frombuffer(r) for r in rows["raw"]], axis=0)
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "at": rows["at"].iloc[:1], "raw": [total.tobytes()]})

    parts = nodes.select(*columns).mapInArrow(run, "dim int, at int, part int, raw binary")
    held: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.groupBy("dim", "at").applyInPandas(add, "dim int, at int, raw binary").collect():
        held.setdefault(r.dim, {})[r["at"]] = np.frombuffer(r.raw)
    return {dim: np.array([at[i] for i in range(len(at))]) for dim, at in held.items()}


def fit(nodes: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Mean, leading axes and eigenvalues by vector length, from ``(dim, x, weight)``."""
    totals = _totals(nodes)
    means = {dim: np.array([s / n for s in sums]) for dim, (n, sums) in totals.items()}
    shipped = nodes.sparkSession.sparkContext.broadcast(means)

    def centred(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        weights = batch.column("weight").to_numpy()
        for dim, rows, raws in _groups(batch):
            yield dim, _unpacked(raws, dim) - shipped.value[dim], weights[rows].astype(np.float64)

    fitted = {}
    for dim, matrix in _products(nodes, ["dim", "x", "weight"], centred).items():
        n, sums = totals[dim]
        covariance = (matrix + matrix.T) / (2 * n)
        values, axes = np.linalg.eigh(covariance)
        values, axes, trace = values[::-1][:components], axes[:, ::-1][:, :components], float(np.trace(covariance))
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
        real = int((values > max(values.max(), 0) * dim * np.finfo(np.float64).eps).sum())
        explained = [max(float(v), 0.0) / trace if trace > 0 else None for v in values]
        fitted[dim] = Whitening(n, sums, means[dim], axes[:, :real], values[:real], explained)
    return fitted


def _deviations(x: np.ndarray, model: Whitening) -> list[Decimal | None]:
    """Sums of (n * x - S)^2, exact; null if over 38 digits."""
    bound = model.n * int(np.abs(x.astype(np.float64)).max()) + max(map(abs, model.sums))
    small = bound * bound * x.shape[1] < LONG
    y = model.n * x - np.array(model.sums, np.int64) if small else model.n * x.astype(object) - np.array(model.sums, object)
    return [Decimal(int(v)) if int(v) < DIGITS else None for v in (y * y).sum(axis=1)]


def whiten(nodes: DataFrame, fitted: dict[int, Whitening]) -> DataFrame:
    """Add ``deviation`` and ``z``, the whitened vector, to every distinct vector."""
    shipped = nodes.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation: list[Decimal | None] = [None] * batch.num_rows
            z: list[np.ndarray | None] = [None] * batch.num_rows
            for dim, rows, raws in _groups(batch):
                model, x = shipped.value[dim], _unpacked(raws, dim)
                out = (x - model.mean) @ model.axes / np.sqrt(model.values)
                for i, d, row in zip(rows, _deviations(x, model), out, strict=True):
                    deviation[i], z[i] = d, row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(deviation, pa.decimal128(38, 0)), pa.array(z, pa.list_(pa.float64()))],
                names=[*batch.schema.names, "deviation", "z"],
            )

    schema = T.StructType([
        *nodes.schema.fields, T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("z", T.ArrayType(T.DoubleType()))
    ])
    return nodes.mapInArrow(run, schema)


def identity_errors(whitened: DataFrame) -> dict[int, float | None]:
    """Largest absolute entry of the whitened vectors' covariance less the identity, by vector length."""
    weight = F.col("weight").cast("double")
    entries = whitened.select("dim", weight.alias("w"), F.posexplode("z").alias("at", "value"))
    means: dict[int, dict[int, float]] = {}
    n: dict[int, float] = {}
    for r in entries.groupBy("dim", "at").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"), F.sum("w").alias("n")).collect():
        means.setdefault(r.dim, {})[r["at"]] = r["mean"]
        n[r.dim] = r.n
    centre = {dim: np.array([at[i] for i in range(len(at))]) for dim, at in means.items()}
    shipped = whitened.sparkSession.sparkContext.broadcast(centre)

    def centred(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        dims, weights, z = batch.column("dim").to_numpy(), batch.column("weight").to_numpy(), batch.column("z").to_pylist()
        for dim in set(dims.tolist()) & shipped.value.keys():
            rows = np.flatnonzero(dims == dim)
            yield dim, np.array([z[i] for i in rows]) - shipped.value[dim], weights[rows].astype(np.float64)

    products = _products(whitened, ["dim", "z", "weight"], centred)
    return {dim: float(np.abs(m / n[dim] - np.eye(len(m))).max()) for dim, m in products.items()}


def whitened_rows(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", *, components: int = COMPONENTS,
    by_copies: bool = False, scale: int = SCALE,
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` per row and leading component.

    Vectors become whole numbers x = floor(scale * c). Rows of equal x are grouped; the group's fit weight is one, or with
    ``by_copies`` its number of rows. The covariance is centred before it is multiplied (a matrix product per
    batch, weighted), and each distinct x is whitened once and joined back to its rows. ``n`` is the fit list's weight.

    Rows whose vector is null, or holds null or non-finite entries or entries beyond a long, are left out; so are
    empty vectors, which have no component. Vectors of different lengths have nothing in common, so each length is fitted on
    its own. A component without variance has a null ``whitened``; ``explained`` is null if there is no variance at all.
    ``deviation`` is a decimal, null beyond 38 digits. Repeated rows and rows without an id stay. An empty table gives no rows.

    The driver gets one matrix per vector length. Rows of a vector that holds a thousandth of the table or more are dealt over
    many keys when they are joined back.
    """
    rows = stored(quantised(vectors, id_column, vector, scale), "quantised")
    copies = F.count(F.lit(1))
    nodes = stored(
        rows.groupBy("dim", "x").agg(copies.alias("copies")).withColumn("weight", F.col("copies") if by_copies else F.lit(1).cast("long")),
        "distinct-vectors",
    )
    fitted = fit(nodes, components)
    whitened = stored(whiten(nodes, fitted), "whitened-vectors")
    errors = identity_errors(whitened)
    spark = vectors.sparkSession
    models = spark.createDataFrame(
        [(dim, i + 1, m.n, e, errors.get(dim)) for dim, m in fitted.items() for i, e in enumerate(m.explained)],
        "dim int, component int, n long, explained double, identity_error double",
    )
    n_rows = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0))).collect()[0][0]
    hot = nodes.filter(F.col("copies") * HOT_SHARE >= n_rows).select("dim", "x", F.lit(True).alias("hot"))
    is_hot = F.coalesce("hot", F.lit(False))
    dealt = rows.join(F.broadcast(hot), ["dim", "x"], "left").withColumn(
        "salt", F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    answers = whitened.filter("dim > 0").select(
        "dim", "x", "deviation", "z",
        F.explode(F.when(F.col("copies") * HOT_SHARE >= n_rows, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"),
    )
    joined = dealt.join(answers, ["dim", "x", "salt"]).join(F.broadcast(models), "dim")
    return joined.select(
        F.col("id").alias(id_column), "component", "n", "deviation", F.get("z", F.col("component") - 1).alias("whitened"),
        "explained", "identity_error",
    )
