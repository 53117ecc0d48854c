import re
from collections import Counter

import pytest

from pregame.llm.line_dedup import LineRuns, dedup_lines, file_batches

from .cases import hard_documents, hard_rows, no_documents, sort_rows


def brute(rows, least):
    def keys(text):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r")) for line in (text or "").split("\n")]

    seen = Counter(k for _, text, *_ in rows for k in set(keys(text)) if k)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, keys(text)) if seen[k] < least or not k]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sort_rows(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_lines_of_many_documents_go(spark, batches):
    docs = hard_documents(spark)
    parts = docs.randomSplit([1.0] * batches, 3) if batches > 1 else [docs]
    got = dedup_lines(parts, min_docs=5, fanout=2)
    assert sort_rows(got.collect()) == brute(hard_rows(), 5)


def test_no_documents(spark):
    assert dedup_lines([no_documents(spark)]).collect() == []


def test_runs_are_merged_into_levels_and_know_frequent_keys(spark):
    runs = LineRuns(spark, min_docs=3, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(i, f"always\nonly {i}")], "doc_id long, text string"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.frequent().count() == 1
    # Once known as frequent, a key is not counted on.
    assert spark.read.parquet(*[p for level in runs.levels for p in level]).groupBy().max("docs").first()[0] <= 4


@pytest.mark.parametrize("files", [1, 3, 6])
def test_tables_of_any_number_of_files_come_in_all_batches(spark, tmp_path, files):
    path = str(tmp_path / "documents.parquet")
    hard_documents(spark).repartition(files).write.parquet(path)
    docs = spark.read.parquet(path)
    parts = file_batches(docs, 4)
    assert len(parts) == 4 and all(not p.isEmpty() for p in parts)
    rows = [r for p in parts for r in p.select("doc_id", "text").collect()]
    assert sort_rows(rows) == sort_rows((r[0], r[1]) for r in hard_rows())
    assert sort_rows(dedup_lines(parts, min_docs=5, fanout=2).collect()) == brute(hard_rows(), 5)
