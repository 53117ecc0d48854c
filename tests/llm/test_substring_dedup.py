import pytest

from pregame.llm.substring_dedup import level_lengths, remove_repeats

from .cases import WORD, hard_documents, hard_rows, no_documents, sort_rows


def brute(rows, length):
    rank = lambda i: 1 << 63 if i is None else i
    words = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - length + 1):
            key = tuple(w[j:j + length])
            first[key] = min(first.get(key, 1 << 64), rank(i))
    out = []
    for i, w in words:
        gone = {p for j in range(len(w) - length + 1) if first[tuple(w[j:j + length])] < rank(i) for p in range(j, j + length)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sort_rows(out)


@pytest.mark.parametrize("length,start", [(12, 6), (10, 3), (4, 4), (14, 2)])
def test_words_under_earlier_windows_go(spark, length, start):
    got = remove_repeats(hard_documents(spark), length, start)
    assert sort_rows(got.collect()) == brute(hard_rows(), length)


def test_lengths_double_up_to_the_window():
    assert level_lengths(50, 25) == [25, 50]
    assert level_lengths(50, 6) == [6, 12, 24, 48, 50]
    assert level_lengths(3, 9) == [3]


def test_no_documents(spark):
    assert remove_repeats(no_documents(spark)).collect() == []
