"""Texts that are the end of one another, found by one sorted scan."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.operators.sequence import SCOPE
from attestra.session import cut_lineage

Best = tuple | None


def first_by_suffix(
    wanted: DataFrame, known: DataFrame, *, text: str = "text", ranges: int | None = None, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """For every text of ``wanted``, the first entry of ``known`` whose text ends it or is ended by it.

    ``wanted``: scope, text. ``known``: scope, text, ord, id; the smallest (ord, id) wins. Returns scope, text, ord, id for the texts that have
    any. Empty and null texts match nothing.

    Reversed, a text that ends another one is its prefix, and in sorted order everything that begins with a text follows it without a gap.
    So the distinct texts of both sides, one row each, are sorted by ranges, and each range is gone through once with a stack of the
    texts that the present one begins with. What reaches over a border is a prefix of the range's first text: these few texts are
    looked up by equality and lie on the stack when their range begins. A text whose followers fill several ranges gets an answer from
    each, and the first of these counts. No text is expanded into its suffixes, and a scope with a large part of all texts is many
    ranges.
    """
    spark, keys = wanted.sparkSession, list(scope)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    entry = F.struct("ord", "id")
    both = known.select(*keys, F.reverse(text).alias("_text"), entry.alias("_entry"), F.lit(False).alias("_wanted")).unionByName(
        wanted.select(*keys, F.reverse(text).alias("_text"), F.lit(True).alias("_wanted")), allowMissingColumns=True
    )
    one = both.filter(F.col("_text") != "").groupBy(*keys, "_text").agg(F.min("_entry").alias("_entry"), F.bool_or("_wanted").alias("_wanted"))
    # Ranges are sampled, so they are materialised with the rows.
    texts = cut_lineage(one.repartitionByRange(ranges, *keys, "_text").withColumn("_range", F.spark_partition_id()))
    borders = _borders(texts, keys)
    shipped = spark.sparkContext.broadcast(borders)
    names = [*keys, "_text"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _Stack()
        place = None
        for batch in batches:
            rows = zip(*(batch.column(name).to_pylist() for name in [*keys, "_text", "_entry", "_wanted", "_range"]), strict=True)
            for *where, text_, entry_, asked, number in rows:
                here = tuple(where)
                if place is None or place != (number, here):
                    stack.close()
                    begun = shipped.value.get(number) if place is None or place[0] != number else None
                    place = (number, here)
                    stack.scope = here
                    if begun and begun[0] == here:
                        for held in begun[1]:
                            stack.push(*held)
                stack.meet(text_, _key(entry_), asked)
            yield stack.found(batch.schema, names)
        stack.close()
        if place is not None:
            yield stack.found(batch.schema, names)

    schema = T.StructType([*[one.schema[k] for k in names], one.schema["_entry"]])
    found = texts.sortWithinPartitions("_range", *keys, "_text").select(*keys, "_text", "_entry", "_wanted", "_range").mapInArrow(scan, schema)
    best = found.groupBy(*keys, "_text").agg(F.min("_entry").alias("_entry"))
    return best.select(*keys, F.reverse("_text").alias(text), "_entry.ord", "_entry.id")


def _key(entry: dict | None) -> Best:
    """An entry in the order in which Spark sorts it, nulls first."""
    return None if entry is None else tuple((v is not None, v) for v in entry.values())


def _less(a: Best, b: Best) -> Best:
    if a is None or b is None:
        return b if a is None else a
    for (known_a, x), (known_b, y) in zip(a, b, strict=True):
        if known_a != known_b:
            return b if known_a else a
        if known_a and x != y:
            return a if x < y else b
    return a


class _Stack:
    """The texts the present one begins with, each with the best entry up to it and the best one seen below it."""

    def __init__(self) -> None:
        self.scope: tuple = ()
        self.open: list[list[Any]] = []
        self.out: list[tuple] = []

    def push(self, text: str, entry: Best, wanted: bool) -> None:
        above = self.open[-1][1] if self.open else None
        self.open.append([text, _less(above, entry), entry, wanted])

    def pop(self) -> None:
        text, above, below, wanted = self.open.pop()
        if self.open:
            self.open[-1][2] = _less(self.open[-1][2], below)
        best = _less(above, below)
        if wanted and best is not None:
            self.out.append((*self.scope, text, best))

    def meet(self, text: str, entry: Best, wanted: bool) -> None:
        while self.open and not text.startswith(self.open[-1][0]):
            self.pop()
        self.push(text, entry, wanted)

    def close(self) -> None:
        while self.open:
            self.pop()

    def found(self, schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
        entry = schema.field("_entry").type
        fields = [entry.field(i).name for i in range(entry.num_fields)]
        rows = [(*row[:-1], {f: v for f, (_, v) in zip(fields, row[-1], strict=True)}) for row in self.out]
        self.out = []
        columns = zip(*rows, strict=True) if rows else [[]] * (len(names) + 1)
        kinds = [schema.field(name).type for name in [*names, "_entry"]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*names, "_entry"])


def _borders(texts: DataFrame, keys: list[str]) -> dict[int, tuple[tuple, list[tuple]]]:
    """Range -> its first text's scope, and the texts of earlier ranges that this text begins with, shortest first.

    There are no more than a range's first text has characters.
    """
    first = texts.groupBy("_range").agg(F.min(F.struct(*keys, "_text")).alias("_first")).select("_range", "_first.*")
    lengths = F.sequence(F.lit(1), F.length("_text"))
    starts = first.select(F.col("_range").alias("_into"), *keys, F.explode(F.transform(lengths, lambda n: F.substr("_text", F.lit(1), n))).alias("_text"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = starts.alias("a").join(texts.alias("b"), [F.col("a._text") == F.col("b._text"), *on]).filter("b._range < a._into")
    out: dict[int, tuple[tuple, list[tuple]]] = {}
    for row in sorted(met.select("a._into", *[f"b.{k}" for k in keys], "b._text", "b._entry", "b._wanted").collect(), key=lambda r: len(r["_text"])):
        scope = tuple(row[k] for k in keys)
        entry = None if row["_entry"] is None else _key(row["_entry"].asDict())
        out.setdefault(row["_into"], (scope, []))[1].append((row["_text"], entry, row["_wanted"]))
    return out
