"""Each stage of the pipeline against brute force, on the input that the stages before leave it."""

import os

import pytest

import corpus_pipeline
from pregame.llm import toxicity
from pregame.llm.decontamination import contaminated, normal
from pregame.session import settle

from . import test_jaccard, test_sharding_mixing
from .cases import SMALL, WORD, hard_documents, no_documents, sort_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(settle(stage(spark, docs[-1], SMALL)))
    return docs


def test_all_but_the_last_return_documents(steps):
    for docs in steps[:-1]:
        assert docs.columns == COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "sharding"]


def test_toxic_documents_go(spark, steps):
    before, after = ({r.doc_id: r for r in d.collect()} for d in steps[:2])
    assert all(before[i] == r for i, r in after.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    lexicon = toxicity.learn(steps[0], toxicity.train_labels(spark.read.parquet(f"{SMALL}/labels.parquet")))
    scores = {r.doc_id: r.score for r in toxicity.score(steps[0], lexicon).collect()}
    assert {i for i in before if scores[i] < 0.7} == set(after)
    assert not [i for i in set(before) - set(after) if labels.get(i) == 0]


def test_one_document_of_each_group_stays(steps):
    before = [tuple(r) for r in steps[1].collect()]
    groups = test_jaccard.brute(before, 5, 80)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({c for _, _, c in groups})


def test_leaks_go_and_other_documents_stay_whole(spark, steps):
    before, after = ({r.doc_id: r for r in d.collect()} for d in steps[2:4])
    assert all(before[i] == r for i, r in after.items())
    items = [normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not [i for i, r in after.items() for t in items if t and t in normal(r.text)]
    bad = {r.doc_id for r in contaminated(steps[2], spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert set(before) - set(after) == bad


def test_the_mix_meets_its_targets(steps):
    before, after = ([r for r in d.collect()] for d in steps[3:5])
    sizes, taken, text = {}, {}, {r.doc_id: r.text for r in before}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text))
        assert all(part in text[r.doc_id] for part in r.text.split("\n"))
    want = test_sharding_mixing.targets(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) <= 256 for s in sizes)


def test_shards_hold_every_row_once(steps):
    assert sort_rows((r.doc_id, len(r.text.encode()) + 1) for r in steps[4].collect()) == sort_rows((r.doc_id, r["size"]) for r in steps[5].collect())
    for shard in range(16):
        places = sorted(r.slot for r in steps[5].collect() if r.shard == shard)
        assert places == list(range(len(places)))


def test_stages_take_hard_rows_and_empty_tables(spark):
    for make in (hard_documents, no_documents):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = settle(stage(spark, docs, SMALL))
            assert docs.columns == COLUMNS
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert last.count() == docs.count()
