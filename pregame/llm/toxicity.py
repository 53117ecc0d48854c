"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones, reads digits and signs inside
words as the letters they stand for, and turns everything else into single blanks. Accents stay: they
tell words apart.

The lexicon holds words (` word `) and beginnings of words (` wor`), so that inflected forms count.
Each is in the lexicon because at least `min_share` of its training documents are toxic, by more than chance
among so many patterns, and has a weight, a lower bound (1.5 standard errors) of its log-odds. A hit inside an
exception phrase does not count. The weights found in a text are summed and also divided by its length;
a logistic curve over both gives the score.

`learn` takes labelled documents: a bounded sample of `sample` of them (the smallest hashes of their id;
a parameter). One half gives a lexicon for fitting the curve and the exception phrases on the other half;
the final lexicon is counted on both. It never sees anything but the text. Cases: a NULL or empty text is scored like one without a hit; a text is scanned
whole, in one pass; equal rows get equal scores; NULL labels are left out; with labels of one kind only,
every score is that kind's smoothed share; an empty table gives an empty result; other columns are kept
out.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.llm.common import pieces, settle, tidy

# Cyrillic and Greek letters that look like Latin ones, and signs written for letters.
LOOK_ALIKES = dict(zip("аеорсухкмтнвіјѕԁɡαβεικνορτυχ", "aeopcyxkmthbijsdgabeiknoptux"))
SUBSTITUTES = dict(zip("0134578@$!", "oleastbasi"))

_table = {ord(a): b for a, b in LOOK_ALIKES.items()}
_signs = str.maketrans(SUBSTITUTES)
_not_letter = re.compile(r"[\W\d_]+")
# A run of letters and signs, up to its last letter or digit.
_run = re.compile(r"[\w@$!]*[^\W_]")
_signed = re.compile(r"[0-9@$!]")


def _as_letters(found: re.Match) -> str:
    run = found[0]
    return run.translate(_signs) if any(map(str.isalpha, run)) else run


def fold(text: str | None) -> str:
    """Folded words with one blank before, between and after them.

    A sign is read as a letter only in a token that has a letter too, and not at the token's end
    (where `!` is punctuation).
    """
    folded = (text or "").lower()
    if not folded.isascii():
        folded = unicodedata.normalize("NFKC", folded).translate(_table)
    if _signed.search(folded):
        folded = _run.sub(_as_letters, folded)
    return f" {_not_letter.sub(' ', folded).strip()} "


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-3.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (len(pattern), weight, False))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0, True))
        found.make_automaton()
        return found


def hits(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight): of the patterns that begin at one place the heaviest counts, and no hit
    that lies within an exception phrase."""
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight, exception) in automaton.iter(folded):
        start = end + 1 - length
        if exception:
            spared.append((start, end + 1))
        elif weight > best.get(start, (0, 0.0))[1]:
            best[start] = (end + 1, weight)
    found = [(s, e, w) for s, (e, w) in best.items()]
    if spared:
        spared.sort()
        reach, merged = -1, []
        for s, e in spared:
            if s > reach - 1:
                merged.append([s, e])
            else:
                merged[-1][1] = max(merged[-1][1], e)
            reach = merged[-1][1]
        starts = [m[0] for m in merged]
        from bisect import bisect_right

        found = [h for h in found if not ((i := bisect_right(starts, h[0]) - 1) >= 0 and merged[i][1] >= h[1])]
    return found


def features(automaton, text: str | None) -> tuple[float, float]:
    """Sum of weights, on a log scale, and the same per word (per square root of words).

    A hit that comes again counts less each time: n times give 1 + log n.
    """
    folded = fold(text)
    found = Counter((folded[s:e], w) for s, e, w in hits(automaton, folded)) if len(folded) > 2 else {}
    total = sum(w * (1 + math.log(n)) for (_, w), n in found.items())
    words = max(1, folded.count(" ") - 1)
    return math.log1p(total), total / math.sqrt(words)


def _curve(values: np.ndarray, labels: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton's steps, with a small ridge so that separable data has an answer."""
    x = np.column_stack([np.ones(len(values)), values])
    beta, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (labels - p) - pull * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def _patterns(folded: str, shortest: int, longest: int) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 1} | {
        f" {w[:n]}" for w in words for n in range(shortest, min(longest, len(w) - 1) + 1)}


def _count(shortest: int, longest: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toxic, every = Counter(), Counter()
            for text, label, half in zip(b.text, b.toxic, b.half):
                found = [(p, half) for p in _patterns(fold(text), shortest, longest)]
                every.update(found)
                if label:
                    toxic.update(found)
            if not every:
                continue
            yield pd.DataFrame({"pattern": [p for p, _ in every], "half": [h for _, h in every],
                                "docs": list(every.values()), "toxic": [toxic[k] for k in every]})

    return count


def _measure(lexicon: Lexicon):
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for b in batches:
            found = [features(automaton, t) for t in b.text]
            yield pd.DataFrame({"toxic": b.toxic, "a": [f[0] for f in found], "b": [f[1] for f in found]})

    return measure


def _phrases(lexicon: Lexicon):
    """Pairs of a hit's word with the word beside it, once per document."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for b in batches:
            toxic, every = Counter(), Counter()
            for text, label in zip(b.text, b.toxic):
                folded = fold(text)
                pairs = set()
                for start, _, _ in hits(automaton, folded):
                    end = folded.find(" ", start + 1)
                    after = folded.find(" ", end + 1)
                    before = folded.rfind(" ", 0, start)
                    if after > 0:
                        pairs.add(folded[start:after + 1])
                    if before >= 0:
                        pairs.add(folded[before:end + 1])
                every.update(pairs)
                if label:
                    toxic.update(pairs)
            if not every:
                continue
            yield pd.DataFrame({"phrase": list(every), "docs": list(every.values()), "toxic": [toxic[p] for p in every]})

    return collect


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000, min_docs: int = 4, min_weight: float = 1.0, min_share: float = 0.8,
          size: int = 5_000, shortest: int = 3, longest: int = 8) -> Lexicon:
    """Fit lexicon, exceptions and curve on at most `sample` documents with a label.

    The driver gets `size` patterns, as many phrases, and three numbers per sampled document of one half.
    """
    spread = F.xxhash64(F.lit(31), F.col("label_id"))
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna().groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(spread, "label_id").limit(sample)
    )
    # At most `sample` rows of two numbers.
    chosen = F.broadcast(chosen.withColumn("half", F.pmod(spread, F.lit(2))))
    rows = tidy(docs, {"doc_id": "bigint", "text": "string"}).join(chosen, F.col("doc_id") == F.col("label_id"))
    rows = rows.select("text", "toxic", "half")
    counts = settle(
        rows.mapInPandas(_count(shortest, longest), "pattern string, half long, docs long, toxic long")
        .groupBy("pattern").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"),
                                F.sum(F.when(F.col("half") == 0, F.col("docs")).otherwise(0)).alias("docs_0"),
                                F.sum(F.when(F.col("half") == 0, F.col("toxic")).otherwise(0)).alias("toxic_0"))
        .filter((F.col("docs") >= min_docs) & (F.col("toxic") > 0))
    )
    n = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    bad, good = sum(v for k, v in n.items() if k[1]), sum(v for k, v in n.items() if not k[1])
    if not bad or not good:
        p = (bad + 0.5) / (bad + good + 1)
        return Lexicon({" \x00": 0.0}, [], (math.log(p / (1 - p)), 0.0, 0.0))

    # What chance alone would give to one in so many patterns does not count (log likelihood ratio).
    chance = math.log(max(1, counts.count())) + 3.0

    def heaviest(docs: str, toxic: str, bad: int, good: int) -> dict[str, float]:
        hit, other = F.col(toxic) + 0.5, F.col(docs) - F.col(toxic) + 0.5
        rate = bad / max(1, bad + good)
        part = lambda n, p: F.when(n > 0, n * F.log(n / (F.col(docs) * p))).otherwise(0.0)
        surprise = part(F.col(toxic), rate) + part(F.col(docs) - F.col(toxic), 1 - rate)
        sure = F.col(toxic) >= min_share * F.col(docs)
        weight = F.log(hit / (bad + 1.0)) - F.log(other / (good + 1.0)) - F.sqrt(1 / hit + 1 / other) * 1.5
        best = (
            counts.filter((F.col(docs) >= min_docs) & sure & (surprise >= chance)).withColumn("weight", weight)
            .filter(F.col("weight") >= min_weight)
            .orderBy(F.col("weight").desc(), "pattern").limit(size).select("pattern", "weight").collect()
        )
        return {r.pattern: r.weight for r in best} or {" \x00": 0.0}

    lexicon = Lexicon(heaviest("docs_0", "toxic_0", n.get((0, 1), 0), n.get((0, 0), 0)))
    phrases = (
        rows.filter("half = 1").mapInPandas(_phrases(lexicon), "phrase string, docs long, toxic long")
        .groupBy("phrase").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
        .filter((F.col("docs") >= 2 * min_docs) & (F.col("toxic") * 20 <= F.col("docs")))
        .orderBy(F.col("docs").desc(), "phrase").limit(size).collect()
    )
    lexicon.exceptions = [r.phrase for r in phrases]
    got = rows.filter("half = 1").mapInPandas(_measure(lexicon), "toxic int, a double, b double").toPandas()
    if got.toxic.nunique() == 2:
        lexicon.curve = _curve(got[["a", "b"]].to_numpy(float), got.toxic.to_numpy(float))
    lexicon.weights = heaviest("docs", "toxic", bad, good)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, keep: dict[str, str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id, if not given) and `score`; no shuffle."""
    keep = keep or {"doc_id": "bigint"}
    b0, b1, b2 = lexicon.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in pieces(batches):
            found = [features(automaton, t) for t in b.column("text").to_pylist()]
            scores = [1 / (1 + math.exp(-max(-40.0, min(40.0, b0 + b1 * x + b2 * y)))) for x, y in found]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(scores, pa.float64())], names=[*keep, "score"])

    d = tidy(docs, {**keep, "text": "string"})
    return d.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in keep.items()) + ", score double")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out("doc_id"))
