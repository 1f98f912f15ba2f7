"""Ledgers kept in buckets, so that joins and groups on their keys need no exchange."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from attestra.session import shared_folder


class LedgerStore:
    """Tables of one analysis, bucketed by their keys with one number of buckets.

    Two tables bucketed by the same keys are joined bucket by bucket, and a group by these keys (or more) stays in its bucket:
    their rows are shuffled once, when they are stored, whatever is computed from them afterwards. Keys should name items, not
    projects alone, so that a large project lies in all buckets. Ledgers with many rows per key are
    reduced before they are stored (:func:`attestra.operators.rollup.status_counts`), so a hot item is no hot bucket.

    ``buckets`` should give files of some 100 MB. Every bucket is one file, written by one task. Keys of both sides must have
    the same types. The files lie in ``folder``, by default in the session's shared folder; their names are in the
    session's catalog under ``prefix``.
    """

    def __init__(self, spark: SparkSession, *, buckets: int, folder: str | None = None, prefix: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.prefix = prefix or f"ledger_{uuid.uuid4().hex}"
        self.folder = folder or f"{shared_folder(spark)}/{self.prefix}"

    def name(self, ledger: str) -> str:
        return f"{self.prefix}_{ledger}"

    def put(self, ledger: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Store a ledger, in place of an earlier one of that name, and return it as stored."""
        (
            rows.repartition(self.buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(self.buckets, *keys)
            .option("path", f"{self.folder}/{ledger}").saveAsTable(self.name(ledger))
        )
        return self.table(ledger)

    def table(self, ledger: str) -> DataFrame:
        return self.spark.table(self.name(ledger))

    def drop(self) -> None:
        """Forget the tables; their files stay."""
        for table in self.spark.catalog.listTables():
            if table.name.startswith(self.prefix.lower()):
                self.spark.sql(f"DROP TABLE `{table.name}`")
