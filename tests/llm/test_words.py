"""Words, windows and hashes against plain Python."""

import re

import pyarrow as pa
import pytest

from pregame.llm.words import split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["a b  c", "", None, " \t\n", "x", "é 😀\x0bé", "end ", " start", "a b c", "A b C a B c"]


@pytest.mark.parametrize("lower", [False, True])
def test_words_are_those_of_the_pattern(lower):
    w = split_words(pa.array(TEXTS), lower=lower)
    raw = w.data.tobytes()
    for k, text in enumerate(TEXTS):
        own = range(w.bounds[k], w.bounds[k + 1])
        want = WORD.findall(text or "")
        if lower:
            want = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in want]
        assert [raw[w.starts[i]:w.ends[i]].decode() for i in own] == want


def test_equal_windows_have_equal_hashes_wherever_they_lie():
    w = split_words(pa.array(["p q a b c", "a  b\nc d", None, "a b", "ab c a b c"]).slice(1))
    first, hashes = w.windows(3, w.hashes())
    raw = w.data.tobytes()
    texts = [" ".join(raw[w.starts[i]:w.ends[i]].decode() for i in range(f, f + 3)) for f in first]
    assert texts == ["a b c", "b c d", "ab c a", "c a b", "a b c"]
    assert len({*zip(texts, hashes.tolist())}) == len(set(texts)) == len(set(hashes.tolist()))


def test_no_texts_and_empty_texts():
    for column in (pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        w = split_words(column)
        assert len(w.starts) == 0 and len(w.windows(2, w.hashes())[0]) == 0
