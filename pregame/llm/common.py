"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.session import configure, settle, shared_folder

__all__ = ["DOCUMENTS", "pieces", "prepare", "row_key", "settle", "shared_folder", "table", "tidy"]

# The columns of the documents table.
DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
# `[\x20\x09-\x0D]`, the whitespace of every contract.
BLANKS = " \t\n\x0b\x0c\r"

PIECE_BYTES = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: small Arrow batches, so that long texts fit a worker."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, cast; missing ones are NULL. Any other column cannot clash."""
    have = {c.lower() for c in df.columns}
    return df.select(*[
        (F.col(f"`{n}`") if n.lower() in have else F.lit(None)).cast(t).alias(n) for n, t in columns.items()
    ])


def row_key(*columns: str | Column) -> list[Column]:
    """128 bits that name a row by its content, never NULL; equal rows have equal keys.

    `xxhash64` skips NULLs, so each value goes in with a flag.
    """
    parts: list[Column] = []
    for c in columns:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c, c.isNull()]
    return [F.xxhash64(*parts).alias("key_a"), F.xxhash64(F.lit(7919), *parts).alias("key_b")]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a piece take about a megabyte (one row at least)."""
    for batch in batches:
        n, start = batch.num_rows, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        total = 0
        for i in range(n):
            if total and total + lengths[i] > PIECE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += lengths[i]
        if start < n:
            yield batch.slice(start, n - start)
