"""Pick up newly landed snapshot files once, append them to a table, read the latest per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregame.operators.ordered import latest_per_key


def ingest(
    spark: SparkSession, landing: str, table: str, checkpoint: str, schema: T.StructType, fmt: str = "json", source: str = "landed"
) -> None:
    """Append every file not seen before, tagged with its path, landing time and source.

    The checkpoint remembers the files, so running it again adds nothing, and a run that is cut
    off goes on where it stopped.
    """
    rows = spark.readStream.schema(schema).format(fmt).load(landing).select(
        "*", F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_modification_time").alias("landed_at"), F.lit(source).alias("source"),
    )
    stream = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start(table).awaitTermination()


def latest_snapshots(spark: SparkSession, table: str, keys: Sequence[str], captured_at: str = "captured_at") -> DataFrame:
    """The newest landed row per key; a tie goes to the later landing, then to the greater path."""
    return latest_per_key(spark.read.parquet(table), keys, [captured_at, "landed_at", "source_path"])


def manifest(spark: SparkSession, table: str, key: str = "game_id") -> DataFrame:
    """(key, path, captured_at, source) of everything landed so far."""
    return spark.read.parquet(table).select(key, "source_path", "captured_at", "source").distinct()
