import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pregame.llm.periodic_runs import collapse_runs, greatest, runs_of, scales, with_planted_period

from .cases import WORD, hard_documents, hard_rows, no_documents, sort_rows


def planted(doc_id, text):
    """The contract's edit, word by word."""
    words = WORD.findall(text or "")
    h, n = (1 if doc_id is None else zlib.crc32(str(doc_id).encode())), len(words)
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def all_runs(words, least=24):
    """Every period and every place."""
    x = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    out = []
    for q in range(1, len(words) // 3 + 1):
        edges = [-1, *np.flatnonzero(x[q:] != x[:-q]).tolist(), len(x) - q]
        for before, stop in zip(edges, edges[1:]):
            start, length = before + 1, stop + q - before - 1
            if length >= max(least, 3 * q) and smallest_period(x[start:start + length].tolist()) == q:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def digest(words):
    runs = all_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))


def found(texts, least=24):
    """The runs of word lists, all in one piece."""
    known = {}
    numbers = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    return runs_of(numbers, np.cumsum([0] + [len(t) for t in texts]), least)


def test_scales_cover_all_periods_and_windows_fit():
    low = 8
    for below, high, width in scales(100_000):
        assert below == low and width & (width - 1) == 0 and width >= 4
        assert all(width - 1 + q + high <= 3 * q for q in range(below + 1, high + 1))
        low = high
    assert low >= 100_000 // 3


def test_random_texts_of_few_words():
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        words = [rng.choice("ab" if rng.random() < 0.5 else "abcdef") for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(4)):
            block = [rng.choice("abc") for _ in range(rng.randrange(1, 40))]
            part = (block * 8)[: rng.randrange(1, 5 * len(block))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        texts.append(words)
    want = [all_runs(t) for t in texts]
    assert found(texts) == want and sum(map(len, want)) > 100


def test_every_period_at_the_shortest_length():
    rng = random.Random(4)
    texts, periods = [], [*range(1, 70), 100, 150, 151, 333, 500, 777, 1000]
    for q in periods:
        block = [f"w{rng.randrange(3 * q)}" for _ in range(q)]
        block[0] = "only"
        length = max(24, 3 * q)
        run = [block[i % q] for i in range(length)]
        texts += [["x1", *run, "x2", "x3"], [*run[:-1], "y"]]
    got = found(texts)
    assert [r[0] for r in got[::2]] == [(1, max(24, 3 * q), q) for q in periods]
    assert all(len(r) == 1 for r in got[::2])
    # One word less is no run, unless it is still 24 long.
    assert [bool(r) for r in got[1::2]] == [False] * len(periods)


@pytest.mark.parametrize("kind", ["thue", "fibonacci", "one", "two"])
def test_words_with_much_structure(kind):
    if kind == "thue":
        words = [str(bin(i).count("1") % 2) for i in range(2048)] * 4
    elif kind == "fibonacci":
        a, b = ["a"], ["a", "b"]
        while len(b) < 3000:
            a, b = b, b + a
        words = b
    else:
        words = (["a"] if kind == "one" else ["a", "b"]) * 1500 + ["c"] * 30
    assert found([words]) == [all_runs(words)]


def test_runs_of_one_text_do_not_reach_into_the_next():
    block = [f"w{i}" for i in range(10)]
    assert found([block * 2, block * 2, block * 3, [], block * 3]) == [[], [], [(0, 30, 10)], [], [(0, 30, 10)]]


def test_greatest_is_exact():
    big = 10**15
    assert greatest([(0, 3 * big, big), (5, 3 * big + 1, big), (9, 6 * big + 2, 2 * big)]) == (5, 3 * big + 1, big)
    assert greatest([]) is None


def test_hard_rows_and_clashing_columns(spark):
    docs = hard_documents(spark)
    got = collapse_runs(docs, 24).select("doc_id", "n_words", "runs", "collapsed").collect()
    want = []
    for doc_id, text, *_ in hard_rows():
        words = WORD.findall(text or "")
        runs = all_runs(words)
        want.append((doc_id, len(words), runs, collapsed(words, runs)))
    assert sort_rows((i, n, [tuple(r) for r in runs], text) for i, n, runs, text in got) == sort_rows(want)
    assert collapse_runs(no_documents(spark)).collect() == []


def test_planted_periods(spark):
    rows = hard_rows() + [(1000 + i, " ".join(f"v{j}" for j in range(i)), None, None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sort_rows((i, tuple(WORD.findall(t or ""))) for i, t in with_planted_period(docs).collect())
    assert got == sort_rows((r[0], tuple(planted(r[0], r[1]))) for r in rows)


def test_a_long_text_takes_no_quadratic_time():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 5000, 300_000)
    body[100_000:280_000] = np.tile(body[100_000:150_000], 4)[:180_000]
    start = time.perf_counter()
    assert runs_of(body, np.array([0, len(body)])) == [[(100_000, 180_000, 50_000)]]
    assert time.perf_counter() - start < 20
