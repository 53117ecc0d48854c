import random

from pregame.llm.decontamination import contaminated, drop_contaminated, normal

from .cases import hard_documents, no_documents, sort_rows


def distance(item, text):
    """Fewest edits of `item` against any region of `text`."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        k = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[k] = rng.choice("qzx")
        elif kind == 1 and len(chars) > 1:
            del chars[k]
        else:
            chars.insert(k, rng.choice("qzx"))
    return "".join(chars)


def cases(seed=4):
    rng = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "né", "ut", "labore", "magna", "quis", "nostrud", "ex", "ea"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(2, 30))) for i in range(12)] + [(50, None), (51, ""), (52, "Short ONE"), (None, text(15))]
    docs = []
    for k in range(40):
        body = [text(rng.randrange(0, 50))]
        if k % 2:
            item = rng.choice(items[:12])[1]
            m = len(normal(item))
            body += [edited(rng, item, rng.choice([0, m // 20, m // 9, m // 6, m // 3])).upper() if k % 4 == 1 else edited(rng, item, m // 10)]
        docs.append((k, "\n".join([*body, text(rng.randrange(0, 40))])))
    docs += [(90, "a short  one here"), (91, "a shorter one"), (None, items[3][1]), (92, None), (93, ""), (94, docs[1][1]), (94, docs[1][1])]
    return items, docs


def test_every_region_within_the_budget_is_found_and_no_other(spark):
    items, docs = cases()
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                       min_chars=20, block_chars=400).collect()
    want, short = [], []
    for d, text in docs:
        for i, item in items:
            a, b = normal(item), normal(text)
            if not a or not b:
                continue
            if len(a) < 20:
                if f" {a} " in f" {b} ":
                    want.append((d, i, 0))
            elif (e := distance(a, b)) <= int(0.12 * len(a)):
                want.append((d, i, e))
    assert sort_rows((r.doc_id, r.item_id, r.edits) for r in got) == sort_rows(want)
    assert {w[2] > 0 for w in want} == {True, False}
    for r in got:
        item = next(normal(t) for i, t in items if i == r.item_id)
        region = [normal(t)[r.from_char:r.to_char] for d, t in docs if d == r.doc_id]
        assert any(distance(item, x) == r.edits for x in region)


def test_items_cut_at_the_edges_of_texts_belong_to_their_own_row(spark):
    """Texts of one batch lie side by side; an item that lost its first or last characters must not reach over."""
    item = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest"
    n = len(item) * 12 // 100
    docs = [(0, "nothing to see here")]
    for k in range(1, n + 1):
        docs += [(10 * k, item[k:] + " and more words follow"), (10 * k + 1, "a clean neighbour"),
                 (10 * k + 2, "some words before " + item[:-k]), (10 * k + 3, ""), (10 * k + 4, item[k:]), (10 * k + 5, None)]
    docs.append((5, "x" * (n // 2) + item[n // 2:]))
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = contaminated(frame, benchmark).collect()
    text = {d: normal(t) for d, t in docs}
    want = [(d, distance(item, t)) for d, t in text.items() if distance(item, t) <= n]
    assert sort_rows((r.doc_id, r.edits) for r in got) == sort_rows(want) and len(want) > 2 * n
    for r in got:
        assert 0 <= r.from_char < r.to_char <= len(text[r.doc_id])
        assert distance(item, text[r.doc_id][r.from_char:r.to_char]) == r.edits
    assert sort_rows((r.doc_id,) for r in drop_contaminated(frame, benchmark).collect()) == sort_rows({(d,) for d, _ in docs} - {(d,) for d, _ in want})


def test_dropping_keeps_the_other_rows_whole(spark):
    items, docs = cases()
    frame = spark.createDataFrame([(*d, "extra") for d in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    bad = {(r.doc_id) for r in contaminated(frame, benchmark).collect()}
    kept = drop_contaminated(frame, benchmark, block_chars=300)
    assert kept.columns == frame.columns
    assert sort_rows(kept.collect()) == sort_rows((*d, "extra") for d in docs if d[0] not in bad)


def test_nothing_on_either_side(spark):
    items, docs = cases()
    benchmark, none = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contaminated(no_documents(spark), benchmark).collect() == []
    assert contaminated(hard_documents(spark), none).collect() == []
    assert drop_contaminated(hard_documents(spark), none).count() == hard_documents(spark).count()
