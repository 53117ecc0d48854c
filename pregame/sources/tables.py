"""Reading and writing tables: typed CSV and Parquet, optional inputs, unions of many files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with header under a given schema, so the file is read once and only where needed."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_dated_csv(
    spark: SparkSession, path: str, schema: T.StructType, seasons: Sequence[int] | None = None, date: str = "date"
) -> DataFrame:
    """CSV whose `date` is yyyymmdd text: parsed as `game_date`, with `season`, kept for some seasons.

    The season test is a range on the raw text, which the scan can apply before parsing.
    """
    rows = spark.read.schema(schema).option("header", True).csv(path)
    text = F.col(date).cast("string")
    if seasons:
        rows = rows.filter((text >= f"{min(seasons)}0000") & (text <= f"{max(seasons)}9999"))
    day = F.try_to_date(text, "yyyyMMdd")
    rows = rows.withColumns({"game_date": day.cast("timestamp"), "season": F.year(day)})
    return rows.filter(F.col("season").isin(*seasons)) if seasons else rows


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ("season",)) -> None:
    """Overwrite a table, split by the given columns where the frame has them."""
    writer = df.write.mode("overwrite").format(fmt).partitionBy(*[c for c in by if c in df.columns])
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """The table at `path`, or an empty one when nothing is there."""
    try:
        found = spark.read.schema(schema).option("header", True).format(fmt).load(path)
        found.schema
        return found
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_first(spark: SparkSession, paths: Sequence[str], schema: T.StructType, fmt: str = "csv") -> DataFrame | None:
    """The first of several possible files that exists."""
    for path in paths:
        try:
            return spark.read.schema(schema).option("header", True).format(fmt).load(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return None


def read_feature_tables(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Union of feature tables by name, each row tagged with its file in `source_file`."""
    if not paths:
        raise ValueError("at least one feature table is required")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file")
    parts = [spark.read.format(fmt).option("header", True).load(p).select("*", name) for p in paths]
    return union_all(parts)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column absent on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
