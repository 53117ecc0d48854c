import random
import zlib

from pregame.llm import toxicity
from pregame.llm.toxicity import Lexicon, features, fold, hits

from .cases import hard_documents, hard_rows, no_documents, sort_rows


def test_folding_maps_look_alikes_and_signs():
    assert fold("You 1D10T!") == " you ldlot "
    assert fold("іdіоt") == " idiot "          # Cyrillic letters
    assert fold("lo$er stup!d, m0r0n. 2023!") == " loser stupid moron "
    assert fold("Straße, für mañana!") == " straße für mañana "
    assert fold(None) == fold(" ..") == "  "


def test_the_heaviest_pattern_counts_and_exceptions_spare():
    lexicon = Lexicon({" tras": 1.0, " trash ": 2.0, " clown ": 3.0}, [" trash can "])
    found = lexicon.automaton()
    assert hits(found, fold("a trash heap")) == [(2, 9, 2.0)]
    assert hits(found, fold("the trash can")) == []
    assert [h[2] for h in hits(found, fold("trash trashy clown"))] == [2.0, 1.0, 3.0]


def test_score_is_per_length():
    found = Lexicon({" bad ": 2.0}).automaton()
    assert features(found, "bad " + "x " * 10)[1] > features(found, "bad " + "x " * 1000)[1] > 0
    assert features(found, "") == features(found, None) == (0.0, 0.0)


def corpus(spark, n=900, seed=3):
    rng = random.Random(seed)
    plain, ugly = [f"word{i}" for i in range(200)], ["scoundrel", "vermin", "lout"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(1, 120))]
        toxic = int(i % 5 == 0)
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(ugly).replace("o", rng.choice("o0")))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(spark)
    lexicon = toxicity.learn(docs, toxicity.train_labels(labels))
    scored = toxicity.score(docs, lexicon).withColumn("held_out", toxicity.held_out()).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    held = [(r.score >= 0.7, r.doc_id % 5 == 0) for r in scored if r.held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in scored)


def test_sample_is_bounded(spark):
    docs, labels = corpus(spark, 300)
    assert toxicity.learn(docs, labels, sample=50).weights
    one_kind = toxicity.learn(docs, labels.filter("toxic = 0"))
    assert {round(r.score, 6) for r in toxicity.score(docs, one_kind).collect()} == {round(0.5 / 241, 6)}


def test_hard_rows(spark):
    docs, labels = corpus(spark, 300)
    lexicon = toxicity.learn(docs, labels)
    got = toxicity.score(hard_documents(spark), lexicon).collect()
    assert sort_rows((r.doc_id,) for r in got) == sort_rows((r[0],) for r in hard_rows())
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(no_documents(spark), lexicon).collect() == []
    nothing = toxicity.learn(no_documents(spark), labels)
    assert all(r.score == 0.5 for r in toxicity.score(docs, nothing).collect())
