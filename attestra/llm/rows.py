"""Helpers the operators share: row keys, and texts handed to Python as bytes."""

from __future__ import annotations

from collections.abc import Sequence
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"

#: The installed package that holds the public tokenizers' vocabulary files.
TOKENIZERS = "public_tokenizers"


def tokenizer_file(name: str) -> str:
    return import_module(TOKENIZERS).path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, so that extra columns of any name cannot clash with added ones."""
    return df.select(*[df[f"`{c}`"] for c in columns])


def with_row(df: DataFrame, name: str | None = None) -> tuple[DataFrame, str]:
    """A key per row, repeated rows too, and the key's name.

    It is the row's place in the partitions, so ``df`` must be a stored table: each scan of it then gives the
    same keys, whichever columns are read, and so does a task that is run again.
    """
    name = name or free_name(df.columns, ROW)
    return df.withColumn(name, F.monotonically_increasing_id()), name


def text_bytes(text: str = "text") -> Column:
    """A text as UTF-8 bytes; null as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores added until no column is called so (case does not matter)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
