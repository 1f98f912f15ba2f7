"""Roll-up counts in parts by item, of which a change set reads and writes only those it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import rollup
from attestra.operators.sequence import SCOPE
from attestra.session import cut_lineage
from attestra.sources import commits


class RollupStore:
    """Counts per item, source type and status under ``path``, in ``parts`` parts by the hash of scope and item.

    Every version of a part has a place of its own; a commit says which versions are current, so a reader sees all of a change set or
    nothing of it. Large projects lie in all parts. The number of parts is fixed for a path.
    """

    def __init__(self, spark: SparkSession, path: str, *, parts: int, scope: Sequence[str] = SCOPE):
        self.spark, self.path, self.parts, self.scope = spark, path, parts, tuple(scope)

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.scope, "item_id"), F.lit(self.parts)).cast("int")

    def _write(self, counts: DataFrame, touched: Sequence[int], run_id: str, keep: bool) -> None:
        place, counts = commits.attempt(self.path, "counts"), cut_lineage(counts)
        counts.withColumn("part", self.part()).hint("rebalance", "part").write.partitionBy("part").parquet(place)
        there = set(self._parts_of(counts))
        entries = {f"part-{p}": f"{place}/part={p}" if p in there else "" for p in touched}
        commits.publish(self.spark, self.path, entries, run_id=run_id, keep=keep)

    def create(self, cover: DataFrame, *, run_id: str) -> None:
        """Count all evidence anew."""
        self._write(rollup.status_counts(cover, scope=self.scope), range(self.parts), run_id, keep=False)

    def _parts_of(self, counts: DataFrame) -> list[int]:
        return sorted(r["p"] for r in counts.select(self.part().alias("p")).distinct().collect())

    def apply(self, delta: DataFrame, *, run_id: str) -> list[int]:
        """Apply signed counts (:func:`rollup.changes`) and return the parts that were read and written again."""
        delta = cut_lineage(delta)
        touched = self._parts_of(delta)
        if touched:
            before = self.counts(touched)
            self._write(rollup.merged(delta.limit(0) if before is None else before, delta, scope=self.scope), touched, run_id, keep=True)
        return touched

    def counts(self, parts: Sequence[int] | None = None) -> DataFrame | None:
        """Current counts, of all parts or of some; nothing where no row was ever stored in them."""
        wanted = None if parts is None else {f"part-{p}" for p in parts}
        places = [p for name, p in commits.current(self.spark, self.path).items() if p and (wanted is None or name in wanted)]
        return self.spark.read.parquet(*places) if places else None
