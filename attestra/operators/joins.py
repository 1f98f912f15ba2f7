"""Joins on keys that many rows lack."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = 4_096


def left_join_known(rows: DataFrame, known: DataFrame, on: Sequence[str], key: str) -> DataFrame:
    """Left join in which rows without ``key`` match nothing and are spread over all tasks.

    All null keys would hash to one partition; they get a second join column from their other fields.
    """
    spread = "_spread"
    fields = [f.name for f in rows.schema if f.dataType.typeName() not in ("map", "variant")]
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*fields), F.lit(SPREAD))).otherwise(F.lit(0).cast("bigint"))
    return (
        rows.withColumn(spread, salt)
        .join(known.withColumn(spread, F.lit(0).cast("bigint")), [*on, spread], "left")
        .drop(spread)
    )
