import random
import time

import pytest

from pregame.llm.token_counts import Merges, count_symbols, count_tokens, load_vocabulary, token_counter

from .cases import hard_documents, hard_rows, no_documents, sort_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def brute(rows):
    """By the library itself."""
    rows = list(rows)
    encoded = library().encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return sort_rows((i, len((t or "").encode()), len(e.ids)) for (i, t), e in zip(rows, encoded))


@pytest.fixture(scope="module")
def counter():
    return token_counter(*load_vocabulary(PATH))


def same(counter, texts):
    encoded = library().encode_batch(texts, add_special_tokens=False)
    assert [counter(t.encode()) for t in texts] == [len(e.ids) for e in encoded]


def test_hard_rows_and_clashing_columns(spark):
    docs = hard_documents(spark)
    assert sort_rows(count_tokens(docs, PATH).collect()) == brute(r[:2] for r in hard_rows())
    assert count_tokens(no_documents(spark), PATH).collect() == []


def test_special_strings_and_blanks(counter):
    mark = "<|endoftext|>"
    same(counter, [mark, f"a{mark}b", f" {mark} {mark}{mark}\n", "<|endoftext|", f"<{mark}>", f"it's {mark}'s", "\x00\x01 \x85\u2028 x\u3000 y",
                   "  two  blanks \n\n next\t", "don't DON'T we'll", "x" * 70, "e\u0301 \u0301 \u200b\u200d", "12 1234567 3.14", "😀😀 😀"])


def test_every_code_point_is_split_as_the_library_does(counter):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = []
    for start in range(0, len(points), 64):
        texts.append("".join(f"a{chr(c)}1 {chr(c)}\n" for c in points[start:start + 64]))
    same(counter, texts)


def test_random_letters_and_bytes(counter):
    rng = random.Random(5)
    kinds = ["abcdefgh iment", "aeiou '", "äöüß é", "日本語の文字列", "\n\t \r", "0123456789", "=-_#*/<|>", "ABab01 .\n"]
    same(counter, ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(1, 300))) for _ in range(3000)])


def test_bytes_that_are_no_text_are_read_as_replacements(spark):
    docs = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    row = count_tokens(docs, PATH).first()
    assert (row.n_bytes, row.n_tokens) == (3, len(library().encode("a\ufffdb", add_special_tokens=False).ids))


def test_a_very_long_run_takes_no_quadratic_time(counter):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000)) + "=" * 300_000
    start = time.perf_counter()
    found = counter(text.encode())
    assert time.perf_counter() - start < 20
    assert found == len(library().encode(text, add_special_tokens=False).ids)


def test_lowest_rank_first_then_leftmost():
    letters = [chr(b) for b in range(256)]
    merges = Merges.of([("b", "c"), ("a", "b"), ("a", "bc"), ("x", "x"), ("ab", "c")], letters)
    left = lambda text: count_symbols(list(text.encode()), merges)
    assert [left(t) for t in ("abc", "xxx", "xxxx", "ab", "ac", "")] == [1, 2, 2, 1, 2, 0]
    assert merges.made[2] == merges.made[4]  # two ways to the same symbol


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
