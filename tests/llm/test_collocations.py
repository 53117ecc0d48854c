import random
import re
from collections import Counter, defaultdict

import pytest

from pregame.llm import collocations as co
from pregame.llm.automata import Automaton, Union, summed

from .cases import hard_documents, hard_rows, no_documents, sort_rows


def brute(rows, longest, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        rows = []
        for p, a in found.items():
            if 100 * longer[p] < 100 * a:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), p, k))
        for rank, (score, a, _, p, k) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, " ".join(p), -a, count[p[:k]], count[p[k:]], n[lang], -score))
    return sort_rows(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least, top, shard", [(2, 2000, 10**6), (4, 15, 200), (10**6, 5, 50)])
def test_hard_rows_and_clashing_columns(spark, monkeypatch, least, top, shard):
    # Small shards, and ranges of a few phrases.
    monkeypatch.setattr(co, "SHARD_WORDS", shard)
    monkeypatch.setattr(co, "SAMPLED", 2)
    monkeypatch.setattr(co, "PER_RANGE", 40)
    got = co.collocations(hard_documents(spark), 5, least, top).select(*COLUMNS).collect()
    want = brute(hard_rows(), 5, least, top)
    assert sort_rows(got) == want and bool(want) == (least < 100)


def test_stops_control_characters_and_copies(spark):
    rng = random.Random(2)
    words = ["a", "B", "b", "c\x01", "d\x1f", "\x01", "é", "日本", "e-f", "'g"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", " ?! "]) for _ in range(80)), rng.choice(["x", "", None]))
            for i in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert sort_rows(co.collocations(docs, 4, 3, 500).select(*COLUMNS).collect()) == brute(rows, 4, 3, 500)


def test_no_documents(spark):
    assert co.collocations(no_documents(spark)).collect() == []


def test_a_long_text_is_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(co, "SHARD_WORDS", 10)
    text = "one two three. " * 20 + "four " * 35 + ", five six"
    shards = co.encode(spark.createDataFrame([(text,)], "text string")).collect()
    assert sum(s.n for s in shards) == 97 and len(shards) > 4 and max(s.n for s in shards) <= 50
    pieces = Counter(tuple(s.words.split(b"\n")[int(i) - 1] for i in part.split()) for s in shards
                     for part in " ".join(map(str, co.np.frombuffer(s.ids, co.np.int32).tolist())).replace(" 0 ", "|").removeprefix("0 ").split("|"))
    assert pieces == Counter({(b"one", b"two", b"three"): 20, (b"four",) * 35: 1, (b"five", b"six"): 1})


def numbered_shards(rng, n):
    """Shards of some 270 words out of 12 each, as `encode` writes them, and their words."""
    rows, texts = [], []
    for shard in range(n):
        words = [b"w%d" % i for i in rng.sample(range(16), 12)]
        ids = [0, *(rng.randrange(1, 13) if rng.random() < 0.9 else 0 for _ in range(300))]
        rows.append(("en", sum(i > 0 for i in ids), b"\n".join(words), co.np.array(ids, co.np.int32).tobytes(), shard))
        texts.append([words[i - 1] if i else None for i in ids])
    return rows, texts


def grams(text, n):
    return Counter(p for i in range(len(text) - n + 1) if None not in (p := tuple(text[i:i + n])))


@pytest.mark.parametrize("per_range", [100, 10**9])
def test_sift_keeps_what_is_frequent_over_all_shards(spark, monkeypatch, per_range):
    monkeypatch.setattr(co, "RANGE_WORDS", per_range)
    rows, texts = numbered_shards(random.Random(5), 12)
    shards = spark.createDataFrame(rows, "lang string, n long, words binary, ids binary, shard long")
    levels = [{r.shard: r.hashes for r in level.collect()} for level in co.candidates(shards, 3, 6)]
    for n, level in enumerate(levels, 1):
        each = [grams(t, n) for t in texts]
        total = sum(each, Counter())
        want = {i: k for i, e in enumerate(each) if (k := sum(total[p] >= 6 for p in e))}
        assert {i: len(set(h)) for i, h in level.items()} == want and len(want) > 3


def test_a_shard_sends_one_block_to_each_range():
    row = numbered_shards(random.Random(6), 1)[0][0]
    batch = co.pa.RecordBatch.from_pylist([dict(zip(["lang", "n", "words", "ids", "shard"], row))])
    for n, ranges in ((2, 1), (2, 7), (3, 7)):
        blocks = [r for b in co._counts_of(n, ranges)(iter([batch])) for r in b.to_pylist()]
        assert [r["part"] for r in blocks] == list(range(ranges))
        counts = [c for r in blocks for c in co._unpacked(r["counts"]).tolist()]
        hashes = [h for r in blocks for h in (co._first_hash(r["part"], ranges) + co.np.cumsum(co._unpacked(r["hashes"]))).tolist()]
        want = grams([row[2].split(b"\n")[i - 1] if i else None for i in co.np.frombuffer(row[3], co.np.int32).tolist()], n)
        assert sorted(counts) == sorted(want.values()) and hashes == sorted(set(hashes))
        assert all(h * ranges >> co.HASH_BITS == r["part"] for r in blocks for h in [co._first_hash(r["part"], ranges)])


def test_numbers_are_packed_in_the_bytes_they_need():
    for values in ([0], [0, 255], [256, 1, 0], [2**40 - 1, 3], [2**62, 0]):
        stored = co._packed(co.np.array(values, co.np.int64))
        assert co._unpacked(stored).tolist() == values and len(stored) == 1 + len(values) * max(1, (max(values).bit_length() + 7) // 8)


def some_phrases(rng, n):
    phrases = {tuple(rng.choice([b"a", b"b", b"ab", b"c"]) for _ in range(rng.randrange(1, 5))) for _ in range(n)}
    return sorted((p, rng.randrange(1, 4)) for p in phrases)


def test_automata_keep_phrases_and_share_states():
    rng = random.Random(1)
    phrases = some_phrases(rng, 200)
    built = Automaton.build(phrases)
    assert list(built.items()) == phrases == list(Automaton.from_bytes(built.to_bytes()).items())
    assert list(Automaton.build([]).items()) == [] == list(Automaton.from_bytes(Automaton.build([]).to_bytes()).items())
    # Equal ends are stored once: 1,000 phrases with a common end need two more states.
    ends = Automaton.build(sorted(((b"%d" % i, b"x", b"y"), 7) for i in range(1000)))
    assert len(ends.weights) == 4


def test_union_and_composition():
    rng = random.Random(3)
    many = [some_phrases(rng, 30) for _ in range(100)]
    union, total = Union(), Counter()
    for phrases in many:
        union.add(Automaton.build(phrases))
        total.update(dict(phrases))
    assert list(union.items()) == sorted(total.items()) == list(summed(many))
    asked = some_phrases(rng, 60) + [((b"zz",), 1)]
    counts = Automaton.build(sorted(total.items()))
    assert list(counts.compose(Automaton.build(asked))) == [(p, total[p]) for p, _ in asked if p in total]
