"""Every registered query over its whole table: against its SQL twin, or against brute force."""

import hashlib
import os
import zlib
from collections import defaultdict

import pytest

import __spark_entry__
from pregame.llm.decontamination import normal
from pregame.llm.queries import QUERIES, SQL

from . import (
    test_jaccard, test_periodic_runs, test_pii, test_quality, test_sharding_mixing, test_substring_dedup, test_token_counts,
)
from .cases import SMALL, WORD, sort_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def rows(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(*columns).collect()]


def documents(spark):
    return rows(spark, "documents", "doc_id", "text", "lang", "source", "n_chars")


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, name):
    import duckdb

    engine = duckdb.connect()
    for table in ("documents", "pages"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    result = engine.execute(SQL[name])
    columns = [c[0] for c in result.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sort_rows(got.select(*columns).collect()) == sort_rows(result.fetchall())


def test_op2_pii(spark):
    got = QUERIES["op2_pii"](spark, SMALL).collect()
    docs = documents(spark)
    assert sort_rows(r[:6] for r in got) == test_pii.brute(docs)
    text = {d[0]: d[1] for d in docs}
    for r in got:
        spans = set(filter(None, r.spans.split(",")))
        assert {f"{k}:{s}:{e}" for k, found in test_pii.base(text[r.doc_id] or "").items() for s, e in found} <= spans


def test_op3_substring_dedup(spark):
    got = QUERIES["op3_substring_dedup"](spark, SMALL).collect()
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in test_substring_dedup.brute(documents(spark), 50)]
    assert sort_rows(got) == sort_rows(want)


def test_op4_toxicity(spark):
    got = QUERIES["op4_toxicity"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(d[0] for d in documents(spark))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_op5_decontamination(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, SMALL).collect()}
    items = [(i, normal(t)) for i, t in rows(spark, "benchmark", "item_id", "text")]
    exact = {(d[0], i) for d in documents(spark) for i, t in items if t and t in normal(d[1])}
    assert exact <= got and len(got) <= len(exact) + 5


def test_op6_quality_rules(spark):
    got = QUERIES["op6_quality_rules"](spark, SMALL).collect()
    want = [(d[0], *test_quality.brute(d[1])) for d in documents(spark)]
    assert sort_rows(r[:6] for r in got) == sort_rows(want)
    good = {i for i, q in rows(spark, "labels", "doc_id", "quality") if q}
    assert not [r for r in got if r.doc_id in good and not r.kept and not r.base_failed]


def test_op7_ngram_jaccard(spark):
    got = QUERIES["op7_ngram_jaccard"](spark, SMALL).select("doc_id", "n_shingles", "component_id").collect()
    assert sort_rows(got) == test_jaccard.brute(documents(spark), 4, 85)


def test_op8_mixing(spark):
    got = {r.doc_id: r for r in QUERIES["op8_mixing"](spark, SMALL).collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text, _, source, _ in documents(spark):
        assert got[i]["size"] == len(WORD.findall(text or "")) and got[i].taken <= 3 * got[i]["size"]
        sizes[source] += got[i]["size"]
        taken[source] += got[i].taken
    want = test_sharding_mixing.targets(sizes)
    for i, _, _, source, _ in documents(spark):
        assert got[i].source_size == sizes[source] and abs(got[i].target - want[source]) < 1e-6
        assert abs(taken[source] - want[source]) <= 256


def test_op9_sharding(spark):
    got = QUERIES["op9_sharding"](spark, SMALL).collect()
    want = [(d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in documents(spark)]
    assert sort_rows(r[:3] for r in got) == sort_rows(want)
    loads = defaultdict(int)
    for r in got:
        loads[r.shard] += r["size"]
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= max(r["size"] for r in got)
    for shard in loads:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_op11_token_counts(spark):
    got = QUERIES["op11_token_counts"](spark, SMALL).collect()
    want = test_token_counts.brute((d[0], d[1]) for d in documents(spark))
    assert sort_rows(r[:3] for r in got) == want and all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_op13_periodic_runs(spark):
    got = QUERIES["op13_periodic_runs"](spark, SMALL)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [(i, *test_periodic_runs.digest(test_periodic_runs.planted(i, text))) for i, text, *_ in documents(spark)]
    assert sort_rows(got.select(*columns).collect()) == sort_rows(want)
    assert sum(n > 0 for _, n, *_ in want) > len(want) // 20
