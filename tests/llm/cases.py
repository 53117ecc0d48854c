"""Rows that every operator must take: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def hard_rows(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "😀x", "Über", "B!"]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    shared = words(14)
    rows = [
        (1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \t\n ", None, None), (None, "lone text", None, "s1"), (None, None, None, None),
        (4, "one", "en", "s2"), (5, "one", "de", None), (5, "one", "de", None), (5, "two", "de", None),
        (6, " ".join(words(3000)), "en", "s1"), (7, "\n".join(["Same Line"] * 30 + ["other"]), "en", "s1"),
    ]
    for i in range(40):
        body = words(rng.randrange(1, 60))
        if i % 3 == 0:
            at = rng.randrange(len(body))
            body[at:at] = shared
        if i % 5 == 0:
            body = body[:20] + ["\n Same LINE \t\n"]
        rows.append((100 + i, " ".join(body), ("en", "de", None)[i % 3], f"s{i % 4}"))
    base = words(50)
    for i in range(12):
        copy = list(base)
        for _ in range(i % 3):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(4)}"
        rows.append((200 + i, " ".join(copy), "en", "s1"))
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def hard_documents(spark):
    """The rows, with columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)
    for name in ("key", "h1", "size", "row", "k1", "s", "score", "slot", "word", "grp", "cid", "label", "places", "copy", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def sort_rows(rows):
    return sorted(map(tuple, rows), key=repr)
