import random
from collections import defaultdict

import numpy as np
import pytest

from pregame.llm import jaccard
from pregame.llm.components import components

from .cases import WORD, hard_documents, hard_rows, no_documents, sort_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, n, percent):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    names = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            names[find(k)].append(r[0])
    return sort_rows((r[0], len(sets[k]), (min(names[find(k)], default=None) if sets[k] else r[0])) for k, r in enumerate(rows))


@pytest.mark.parametrize("n,percent,tile", [(4, 85, 256), (2, 60, 2)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, n, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    got = jaccard.similar_sets(hard_documents(spark), n, percent).select("doc_id", "n_shingles", "component_id")
    assert sort_rows(got.collect()) == brute(hard_rows(), n, percent)


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j:j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_copies():
    """A group of copies with an edit each, at many distances from each other, one near copy of it, and odd rows."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words)] * 3
    for k in range(40):
        edited = list(words)
        for at in rng.sample(range(60), rng.randrange(1, 3)):
            edited[at] = f"x{k % 13}"
        texts.append(" ".join(edited))
    return [(i // 2 if i < 4 else i, t) for i, t in enumerate([*texts, None, "", "a b", "A b", "other " * 9, texts[5]])]


@pytest.mark.parametrize("n,percent,block", [(4, 85, 512), (4, 85, 5), (2, 60, 7)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COLUMNS", 50)
    for rows in (near_copies(), [(r[0], r[1]) for r in hard_rows()]):
        sets = {shingles(t, n) for _, t in rows} - {frozenset()}
        links = {a: sum(a != b and 100 * len(a & b) >= percent * len(a | b) for b in sets) for a in sets}
        want = sort_rows((i, links.get(shingles(t, n), 0)) for i, t in rows)
        got = jaccard.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).select("doc_id", "n_links").collect()
        assert sort_rows(got) == want


def test_no_documents(spark):
    assert jaccard.similar_sets(no_documents(spark)).collect() == []


def test_one_row_of_each_component_stays(spark):
    docs = hard_documents(spark)
    kept = jaccard.representatives(docs, 4, 85)
    assert kept.columns == docs.columns
    want = [(i, c) for i, n, c in brute(hard_rows(), 4, 85) if n]
    texts = [r for r in kept.select("doc_id", "text").collect() if WORD.search(r.text or "")]
    assert sort_rows([(r.doc_id,) for r in texts]) == sort_rows({(c,) for _, c in want})
    empty = [r for r in hard_rows() if not WORD.search(r[1] or "")]
    assert kept.count() == len(texts) + len(empty)


def test_prefix_size_never_misses():
    for percent in (60, 85, 100):
        for a in range(1, 60):
            prefix = lambda size: int(jaccard.prefix_size(np.array([size]), percent)[0])
            fits = [b for b in range(a, 100) if 100 * a >= percent * b]
            for b in fits:
                need = min(o for o in range(a + 1) if 100 * o >= percent * (a + b - o))
                if (a, b) != (need, need):
                    assert prefix(a) >= a - need + 1 and prefix(b) >= b - need + 1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 230)] + [(1, 2), (2, 1), (3, 3)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(100, 141)}) == 1 and len({got[x] for x in [7, *range(200, 230)]}) == 1
    assert len(set(got.values())) == 3 and 3 not in got
