import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pregame.llm import quality

from .cases import WORD, hard_documents, hard_rows, no_documents, sort_rows


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), dup, len(cover))


def test_counts_are_those_of_plain_python(spark):
    got = quality.judge(hard_documents(spark)).collect()
    want = [(r[0], *brute(r[1])) for r in hard_rows()]
    assert sort_rows((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sort_rows(want)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.outlier)


def test_counts_of_odd_texts():
    texts = ["a\na\n\na \n", "\n", "# $\n# $", "x " * 9, None, "é é é é é é", "*" * 50]
    found = quality.count_texts(pa.array(texts))
    for k, t in enumerate(texts):
        assert tuple(int(found[c][k]) for c in quality.COUNTS[:5]) == brute(t)


def documents(spark, n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = [rng.choice("abcdefghij") * rng.randrange(2, 9) for _ in range(rng.randrange(40, 400))]
        junk = i % 20 == 0
        text = " ".join(w + ("%%#" if junk else "") for w in words)
        rows.append((i, text, "en" if i % 2 else None, "hot" if i % 3 else "rare", len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_outliers_go_and_the_others_stay(spark):
    rows = quality.judge(documents(spark)).collect()
    assert all(r.outlier for r in rows if r.doc_id % 20 == 0)
    assert sum(r.outlier for r in rows if r.doc_id % 20) <= 2


def test_small_groups_are_judged_together_or_not_at_all(spark):
    few = quality.judge(documents(spark, 30)).collect()
    assert all(r.distance is None and not r.outlier for r in few)
    pooled = quality.judge(documents(spark, 150), min_rows=60).collect()
    assert any(r.distance is not None for r in pooled)


def test_chi_square_quantiles():
    assert abs(quality.chi_square(7, 0.975) - 16.01) < 0.05
    assert abs(quality._chi_square_cdf(7, 16.01) - 0.975) < 0.002


def test_no_documents(spark):
    assert quality.judge(no_documents(spark)).collect() == []


def test_fit_inverts_the_covariance():
    import pandas as pd

    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2)) @ np.array([[2.0, 0.3], [0.0, 1.0]])
    row = {"grp": 1, "n": 500, "centre": [1.0, 2.0], "sums": x.sum(0).tolist(), "products": [(x[:, 0] ** 2).sum(), (x[:, 0] * x[:, 1]).sum(), (x[:, 1] ** 2).sum()]}
    out = next(quality._fit(["a", "b"], [0.0, 0.0], 1.0)(iter([pd.DataFrame([row])]))).iloc[0]
    want = np.linalg.inv(np.cov(x.T, bias=True))
    assert np.allclose(out["inverse"], [want[0, 0], want[0, 1], want[1, 1]])
    assert np.allclose(out["mean"], x.mean(0) + [1.0, 2.0])
