"""Revisions of ledgers, stored with their hash trees, of which a comparison reads only what differs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import delta, digests
from attestra.operators.sequence import SCOPE, last_per_key
from attestra.session import cut_lineage
from attestra.sources import commits


class SnapshotStore:
    """Revisions of ledgers under ``path``.

    Rows lie in ``groups`` groups of projects times ``leaves`` leaves of keys, a folder each: a change of a few projects opens a few
    folders, and a large project is split by its keys. A revision's rows and tree are published together.
    """

    def __init__(self, spark: SparkSession, path: str, *, groups: int = 32, leaves: int = digests.LEAVES, scope: Sequence[str] = SCOPE):
        self.spark, self.path, self.groups, self.leaves, self.scope = spark, path, groups, leaves, tuple(scope)

    def _placed(self, rows: DataFrame, key: str) -> DataFrame:
        group = F.pmod(F.xxhash64(*self.scope), F.lit(self.groups)).cast("int") if self.scope else F.lit(0)
        return rows.withColumn("_group", group).withColumn("_leaf", digests.leaf_of(key, self.leaves))

    def put(self, revision: str, ledger: str, rows: DataFrame, *, key: str, content: Sequence[str] = ("content_hash",)) -> None:
        """Store a revision of a ledger. Its tree is over the rows as they are, and over the last row of each key (by ``ord``)."""
        place, name = commits.attempt(self.path, ledger), f"{revision}/{ledger}"
        placed = self._placed(rows, key)
        placed.limit(0).coalesce(1).write.parquet(f"{place}/empty")  # tells the columns, also where there is no row
        placed.hint("rebalance", "_group", "_leaf").write.partitionBy("_group", "_leaf").parquet(f"{place}/rows")
        stored = self._read(place)
        options = {"key": key, "content": content, "leaves": self.leaves, "scope": self.scope}
        trees = digests.leaf_digests(stored, ledger="rows", **options)
        if "ord" in rows.columns:
            last = last_per_key(stored.select(*self.scope, key, *content, "ord"), [*self.scope, key], ["ord"])
            trees = trees.unionByName(digests.leaf_digests(last, ledger="last", **options))
        trees.hint("rebalance").write.parquet(f"{place}/tree")
        commits.publish(self.spark, self.path, {name: place}, run_id=revision, keep=True)

    def _read(self, place: str) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{place}/empty").schema).parquet(f"{place}/rows")

    def _place(self, revision: str, ledger: str) -> str:
        found = commits.current(self.spark, self.path).get(f"{revision}/{ledger}")
        if found is None:
            raise KeyError(f"{self.path} has no {ledger} of {revision}")
        return found

    def tree(self, revision: str, ledger: str, kind: str = "rows") -> DataFrame:
        """Leaves of a revision's tree: over all rows, or over the ``last`` row of each key."""
        return self.spark.read.parquet(f"{self._place(revision, ledger)}/tree").filter(F.col("ledger") == kind).withColumn("ledger", F.lit(ledger))

    def rows(self, revision: str, ledger: str, leaves: DataFrame | None = None) -> DataFrame:
        """A revision's rows; with ``leaves`` (scope, leaf), only those in them, from only their folders."""
        table = self._read(self._place(revision, ledger))
        if leaves is None:
            return table.drop("_group", "_leaf")
        wanted = self._placed(leaves.withColumnRenamed("leaf", "_wanted"), "_wanted").drop("_leaf").withColumnRenamed("_wanted", "_leaf")
        # No more than the store has folders.
        folders = wanted.select("_group", "_leaf").distinct().collect()
        by_leaf: dict[int, list[int]] = {}
        for f in folders:
            by_leaf.setdefault(f["_leaf"], []).append(f["_group"])
        there = F.lit(False)
        for leaf, groups in sorted(by_leaf.items()):
            there = there | ((F.col("_leaf") == leaf) & F.col("_group").isin(sorted(groups)))
        return table.filter(there).join(wanted.select(*self.scope, "_leaf").distinct(), [*self.scope, "_leaf"], "left_semi").drop("_group", "_leaf")

    def _opened(self, old: str, new: str, ledger: str, kind: str) -> tuple[DataFrame, DataFrame]:
        """Rows of two revisions in the leaves in which they differ."""
        leaves = cut_lineage(digests.differing(self.tree(old, ledger, kind), self.tree(new, ledger), scope=self.scope).select(*self.scope, "leaf"))
        return self.rows(old, ledger, leaves), self.rows(new, ledger, leaves)

    def active_claims(self, old: str, new: str, ledger: str = "claim") -> DataFrame:
        """Claims of the new revision that are identical to none of the old one. The ledger's key must be in the content hash."""
        head, staged = self._opened(old, new, ledger, "rows")
        return delta.active_claims(staged, head, scope=self.scope)

    def keyed_delta(self, old: str, new: str, ledger: str, *, key: str) -> DataFrame:
        """Keys that are new or differ from the last row the old revision has of them."""
        head, staged = self._opened(old, new, ledger, "last")
        return delta.keyed_delta(staged, head, key=key, scope=self.scope)
