"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z in lower case. `LineRuns`
holds, for every key seen, in how many documents it was. Each batch of documents

1. counts its keys (one per document and key), summed in each task before the exchange,
2. is merge-anti-joined with the keys that the runs already know to be frequent: those need no more
   counting,
3. is written as a sorted run of level 0. A level that holds `fanout` runs is merged into one run of
   the next level, so a key lies in O(log batches) runs.

`frequent()` merges what is left over the levels. Cases: a NULL or empty text is one empty line; a key
without code points is never frequent; every row counts as a document, equal rows and rows with a NULL
or repeated doc_id too, and each gets its own result; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.llm.common import BLANKS, row_key, settle, shared_folder, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = {"doc_id": "bigint", "text": "string"}


def lower_ascii(text: Column) -> Column:
    """A-Z only. `lower` is the fast way where the text has nothing but ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    return F.transform(F.split(lower_ascii(text), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(F.col(key)).alias("h1"), F.xxhash64(F.lit(7919), F.col(key)).alias("h2")]


class LineRuns:
    """Counts of line keys by document, kept as levelled runs below the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []
        self.folder = f"{shared_folder(spark)}/line-runs/{uuid.uuid4().hex}"

    def _write(self, counts: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = f"{self.folder}/level-{level}/{uuid.uuid4().hex}"
        counts.sortWithinPartitions("h1", "h2").write.parquet(path)
        self.levels[level].append(path)

    def _merged(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*paths).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))

    def frequent(self) -> DataFrame | None:
        """(h1, h2) of the keys in at least `min_docs` documents so far."""
        paths = [p for level in self.levels for p in level]
        return self._merged(paths).filter(F.col("docs") >= self.min_docs).select("h1", "h2") if paths else None

    def add(self, documents: DataFrame) -> None:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        keys = F.array_distinct(F.filter(line_keys(text), lambda x: x != ""))
        counts = (
            documents.select(F.explode(keys).alias("key")).select(*_hashes("key"))
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
        )
        known = self.frequent()
        if known is not None:
            counts = counts.join(known.hint("merge"), ["h1", "h2"], "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            level += 1


def drop_frequent_lines(documents: DataFrame, frequent: DataFrame | None) -> DataFrame:
    """Every document without its frequent lines: doc_id, n_lines, n_dropped, kept.

    Lines meet the frequent keys in a sort-merge join on the hash, which AQE splits where a line is in
    very many documents; only the numbers of dropped lines travel back to the texts.
    """
    d = tidy(documents, COLUMNS).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.select("doc_id", "text", *row_key("doc_id", "text"))
    if frequent is None:
        frequent = d.sparkSession.createDataFrame([], "h1 bigint, h2 bigint")
    else:
        # Written, so that the join below has a plain exchange on both sides, which AQE can split.
        frequent = settle(frequent)
    lines = d.select("key_a", "key_b", F.posexplode(line_keys(F.col("text"))).alias("line", "key"))
    dropped = (
        lines.filter(F.col("key") != "").select("key_a", "key_b", "line", *_hashes("key"))
        .join(frequent.hint("merge"), ["h1", "h2"], "left_semi")
        .groupBy("key_a", "key_b").agg(F.collect_set("line").alias("dropped"))
    )
    lines = F.split("text", "\n", -1)
    return (
        d.join(dropped, ["key_a", "key_b"], "left")
        .withColumn("lines", lines)
        .select(
            "doc_id", F.size("lines").cast("long").alias("n_lines"),
            F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(
                F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped"),
                            lambda i: F.get("lines", i)), "\n")).alias("kept"),
        )
    )


def dedup_lines(batches: list[DataFrame], min_docs: int = 10, fanout: int = 4) -> DataFrame:
    """Take in all batches, then drop the lines of keys found in at least `min_docs` documents of any batch."""
    runs = LineRuns(batches[0].sparkSession, min_docs, fanout)
    whole = None
    for batch in batches:
        batch = tidy(batch, COLUMNS)
        runs.add(batch)
        whole = batch if whole is None else whole.unionByName(batch)
    return drop_frequent_lines(whole, runs.frequent())


def file_batches(df: DataFrame, batches: int) -> list[DataFrame]:
    """The rows of a Parquet table as `batches` arrivals: by files, each read in one of them, or, with fewer files than
    batches, by a hash of doc_id and text."""
    files = sorted(df.inputFiles())
    if len(files) >= batches:
        return [df.sparkSession.read.schema(df.schema).parquet(*files[i::batches]) for i in range(batches)]
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(batches))
    return [df.filter(part == i) for i in range(batches)]
