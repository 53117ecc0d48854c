"""From raw documents to shards, in five stages.

Each stage takes (spark, docs, folder) and works on every row that the stage before has kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.llm import decontamination, jaccard, mixing, sharding, toxicity
from pregame.llm.common import DOCUMENTS, prepare, settle, table, tidy


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a toxicity of 0.7 or more go. Learned from labels that are not held out."""
    prepare(spark)
    lexicon = toxicity.learn(docs, toxicity.train_labels(table(spark, folder, "labels")))
    scored = toxicity.score(docs, lexicon, keep=DOCUMENTS)
    return scored.filter(F.col("score") < 0.7).select(*DOCUMENTS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document stays of each group linked by a similarity of 0.8 over 5-word shingles."""
    prepare(spark)
    return jaccard.representatives(tidy(docs, DOCUMENTS), 5, 80).select(*DOCUMENTS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, up to 12% of edits, go."""
    prepare(spark)
    return decontamination.drop_contaminated(tidy(docs, DOCUMENTS), table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources by weights 1, 2, 3; a document has a row for each time that its words are taken."""
    prepare(spark)
    return mixing.mixed_texts(docs)


def shard(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """16 shards of nearly equal bytes."""
    prepare(spark)
    placed, _ = sharding.place(docs, 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Learned scores and pseudorandom draws have no SQL twin; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
