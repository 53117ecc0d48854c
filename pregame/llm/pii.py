"""Personal data by candidate gradient boosting. DataFrame and SQL functions, and Spark ML's trees.

Base rules give the spans that always count (leftmost, non-overlapping, per kind):

* email  `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`
* ip     four runs of digits with dots, each at most 255
* card   digits with single blanks or hyphens between them, 16 to 19 of them, passing Luhn
* phone  `\\+[0-9][\\x20().0-9-]+[0-9]`, 8 to 15 digits

Beyond them, high-recall generators propose overlapping spans of each kind: addresses with spelled-out
signs, digit groups with any separators, dotted or spaced quads. Each candidate is described by its
format (digits, groups, separators, neighbours) and its context (words before it); an address with
spelled-out dots or bracketed signs is described as it reads with the signs put back. Boosted trees learn
from all candidates which of them are personal data, and what the base rules test (Luhn,
the plus sign, the value of a quad's parts) is not among the features. A candidate over a base span of its
kind is positive, one over a base span of another kind only is negative, and one that fails Luhn or has a
part above 255 is settled: it is neither learned from nor added. All others have no label, and being found
by no base rule does not make them negative. Which of them are is found in two steps (spies):

1. trees learn base spans against all others; unlabelled candidates that score below nearly all base
   spans of their kind which these trees have not seen (all but `spies` of them) are taken as negative;
2. trees learn base spans against negatives only. On the part of the candidates that they have not seen,
   Platt's curve calibrates their margin, and each kind gets the lowest threshold at which `precision`
   holds for what it adds: of the candidates above it that are not positive, so many are not negative.
   With no negatives on either part, the first trees and their limits decide.

Candidates above the threshold that touch no base span are added. What differs in format from all base
spans of its kind looks negative to step 1 and is not added.

Positions count code points; they come from the lengths of matches and of the text between them. Regular
expressions are possessive and start only where a run starts, so that they take linear time and constant
stack on any text. Parts are dealt by doc_id, text and place. Cases: a NULL text is empty; NULL and repeated doc_ids and equal rows each
keep their row; without base spans, or without other candidates, nothing is added; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pregame.llm.common import settle, tidy

KINDS = ["email", "ip", "card", "phone"]

# `\G` is the end of the match before: a rest of a run may start there.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts without these have no match.
NEEDED = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
GENERATORS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20){_LABEL}{{1,64}}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20){_LABEL}{{1,64}}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[.,:]\x20?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}+[0-9]){12,22}+(?![0-9])",
    "phone": r"(?<![0-9])[(0]?[0-9](?:[\x20()./-]{0,3}+[0-9]){6,15}+(?![0-9])",
}
GENERATOR_NEEDED = {"email": r"@|[\[(]at[\])]|\x20at\x20", "ip": r"[0-9][.,:]\x20?[0-9]", "card": r"[0-9]{2}|[0-9][\x20./_-]{1,2}[0-9]",
                    "phone": r"[0-9]{2}|[0-9][\x20()./-]{1,3}[0-9]"}
CONTEXT = {
    "w_phone": r"(?i)\b(tel|phone|call|fax|mobile|cell|ring|sms)", "w_mail": r"(?i)\b(mail|e-mail|email|contact|write|address)",
    "w_card": r"(?i)\b(card|visa|credit|debit|account|iban|pay)", "w_host": r"(?i)\b(ip|host|server|addr|login|from)",
    "w_secret": r"(?i)(token|key|password|secret|hash|version|page|isbn)",
}
# Signs of an address that are written out; ` at ` alone is not enough to take it for a sign.
WRITTEN, AT, DOT = r"[\[(](?:at|dot)[\])]|\x20dot\x20", r"\x20?[\[(]at[\])]\x20?|\x20at\x20", r"\x20?[\[(]dot[\])]\x20?|\x20dot\x20"
REACH = 24  # characters of context before a candidate
NEAR = 5  # matches that hold REACH characters together: each has five or more
FOLDED = 128  # values that one fold gathers
PART_ROWS = 20_000  # candidates of a partition that trees learn from
STEPS = 1024  # of probabilities, for thresholds
CUT = 1024  # code points of a piece of text that is cut by position
FEATURES = ["length", "digits", "letters", "blanks", "hyphens", "dots", "others", "groups", "longest", "even_groups", "distinct",
            "joined_before", "joined_after", "line_start", *CONTEXT]


def _bound(value: Column, use) -> Column:
    """`use(value)`, with `value` worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge) -> Column:
    """Running totals of an array of non-negative integers under `merge`, which takes 0 as its neutral value.

    A fold copies what it has gathered at every step. So blocks are folded apart and then their totals.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(
            part, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
            lambda acc, x: F.struct(merge(acc.at, x).alias("at"), F.concat(acc.out, F.array(merge(acc.at, x))).alias("out")),
            lambda acc: acc.out)

    def joined(blocks: Column) -> Column:
        totals = fold(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return _bound(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(
            b, lambda x: merge(F.coalesce(F.get(t, i - 1), F.lit(0)), x)))))

    def in_blocks(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(FOLDED)), lambda i: i <= F.size(v))
        return _bound(F.transform(starts, lambda i: fold(F.slice(v, i, F.lit(FOLDED)))), joined)

    return _bound(values, in_blocks)


def _pieces(text: Column, pattern: str) -> Column:
    """array<struct<gap, v>>: each match with the text before it; the last one is the rest of the text, without match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.split(text, pattern, -1), found, lambda gap, hit: F.struct(F.coalesce(gap, F.lit("")).alias("gap"), hit.alias("v")))


def matches(text: Column, pattern: str, needed: str) -> Column:
    """array<struct<s, e, v, before, after>>: code point ranges and texts of the matches, in order, with REACH characters
    before and two after. Positions and contexts come from the pieces, so that time is linear in text and matches."""
    whole = lambda x: F.concat(x.gap, F.coalesce(x.v, F.lit("")))

    def located(p: Column, ends: Column, tails: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            earlier = F.slice(tails, F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR)))
            return F.struct(
                (F.get(ends, i) - F.char_length(x.v)).alias("s"), F.get(ends, i).alias("e"), x.v.alias("v"),
                F.right(F.concat(F.array_join(earlier, ""), x.gap), F.lit(REACH)).alias("before"),
                F.left(whole(F.get(p, i + 1)), F.lit(2)).alias("after"))

        return F.transform(F.slice(p, F.lit(1), F.size(p) - 1), one)

    run = _bound(_pieces(text, pattern), lambda p: _bound(
        running(F.transform(p, lambda x: F.char_length(whole(x))), lambda a, b: a + b), lambda ends: _bound(
            F.transform(p, lambda x: F.right(whole(x), F.lit(REACH))), lambda tails: located(p, ends, tails))))
    empty = F.expr("cast(array() as array<struct<s:int,e:int,v:string,before:string,after:string>>)")
    return F.when(text.rlike(needed), run).otherwise(empty)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def valid(kind: str, v: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        part = lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255"))
        return F.forall(F.split(v, r"\."), part)
    n = F.length(_digits(v))
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", _digits(v))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def base_spans(kind: str, text: Column) -> Column:
    kept = F.filter(matches(text, PATTERNS[kind], NEEDED[kind]), lambda m: valid(kind, m.v))
    return F.transform(kept, lambda m: F.struct(m.s.alias("s"), m.e.alias("e")))


def _settled(kind: str, v: Column) -> Column:
    """Whether a candidate fails a check that every span of its kind passes."""
    if kind == "card":
        return ~F.call_function("luhn_check", _digits(v))
    if kind == "ip":
        return F.exists(F.split(v, "[^0-9]+"), lambda p: p.cast("int") > 255)
    return F.lit(False)


def _described(kind: str, m: Column) -> Column:
    v = F.when(m.v.rlike(WRITTEN), F.regexp_replace(F.regexp_replace(m.v, AT, "@"), DOT, ".")).otherwise(m.v) if kind == "email" else m.v
    count = lambda p: F.regexp_count(v, F.lit(p))
    before, after = m.before, m.after
    groups = F.transform(F.filter(F.split(v, "[^0-9]+"), lambda g: g != ""), lambda g: F.length(g))
    values = {
        "length": F.char_length(v), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "blanks": count(r"\x20"), "hyphens": count("-"),
        "dots": count(r"\."), "others": count(r"[^A-Za-z0-9\x20.-]"), "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(groups), F.lit(0)), "even_groups": (F.array_max(groups) == F.array_min(groups)).cast("int"),
        "distinct": F.size(F.array_distinct(F.split(_digits(v), ""))), "joined_before": before.rlike("[A-Za-z0-9_=\"]$").cast("int"),
        "joined_after": after.rlike("^[A-Za-z0-9_=\"]").cast("int"), "line_start": ((m.s == 0) | before.endswith("\n")).cast("int"),
        **{name: before.rlike(p).cast("int") for name, p in CONTEXT.items()},
    }
    return F.struct(F.lit(kind).alias("kind"), m.s.alias("s"), m.e.alias("e"), _settled(kind, m.v).alias("settled"),
                    *[F.coalesce(values[f].cast("float"), F.lit(0.0).cast("float")).alias(f) for f in FEATURES])


def _proposed(kind: str, text: Column) -> Column:
    return F.transform(matches(text, GENERATORS[kind], GENERATOR_NEEDED[kind]), lambda m: _described(kind, m))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, `candidates` with their features, and `mark`, a hash of doc_id and text; one pass over
    the texts, no shuffle."""
    d = tidy(docs, {"doc_id": "bigint", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    out = d.select("doc_id", "text", *[base_spans(k, F.col("text")).alias(k) for k in KINDS])
    proposed = [_proposed(k, F.col("text")) for k in KINDS]
    return out.select("doc_id", *KINDS, F.concat(*proposed).alias("candidates"), F.xxhash64("doc_id", "text").alias("mark"))


def candidates_of(spans: DataFrame) -> DataFrame:
    """One row per candidate, with its row's id, its label (it overlaps a base span of its kind), and whether it
    touches any base span. Spans and candidates of one text are swept in order of position."""
    base = None
    for k in KINDS:
        part = spans.select("row", F.explode(k).alias("b")).select("row", F.lit(k).alias("kind"), "b.s", "b.e")
        base = part if base is None else base.unionByName(part)
    base = base.withColumn("base", F.lit(True))
    c = spans.select("row", "mark", F.explode("candidates").alias("c")).select("row", "mark", "c.*").withColumn("base", F.lit(False))
    both = c.unionByName(base, allowMissingColumns=True)
    order = Window.partitionBy("row").orderBy("s", F.col("base").desc())
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    # What follows, from the far end: a frame that grows takes linear time, one that shrinks does not.
    after = Window.partitionBy("row").orderBy(F.col("s").desc(), F.col("base")).rowsBetween(Window.unboundedPreceding, -1)

    def meets(which: Column) -> Column:
        end = F.max(F.when(which, F.col("e"))).over(before)
        start = F.min(F.when(which, F.col("s"))).over(after)
        return F.coalesce(end > F.col("s"), F.lit(False)) | F.coalesce(start < F.col("e"), F.lit(False))

    own = {k: meets(F.col("base") & (F.col("kind") == k)) for k in KINDS}
    label = F.lit(False)
    for k in KINDS:
        label = F.when(F.col("kind") == k, F.col(f"own_{k}")).otherwise(label)
    return (
        both.select("*", *[w.alias(f"own_{k}") for k, w in own.items()]).filter(~F.col("base"))
        .withColumn("label", label.cast("double"))
        .withColumn("touched", F.col("own_email") | F.col("own_ip") | F.col("own_card") | F.col("own_phone"))
        .drop("base", *[f"own_{k}" for k in KINDS])
        .select("*", *[(F.col("kind") == k).cast("float").alias(f"is_{k}") for k in KINDS])
    )


INPUTS = [*FEATURES, *[f"is_{k}" for k in KINDS]]


def _bins(rows: int) -> int:
    """The least `maxBins` with which Spark's trees look for split values in all `rows`: from 10,000 rows on they sample
    the square of it. Each feature keeps only the bins that its values need."""
    return 32 if rows <= 10_000 else min(isqrt(rows - 1) + 1, 46_340)


def _learn(rows: DataFrame, rounds: int, depth: int, seed: int):
    """(trees, calibration) from the rows with a label: `part` 0 and 1 train, 2 calibrates. None where either lacks a label."""
    rows = rows.filter("label IS NOT NULL")
    counts = {(r.train, r.label): r["count"] for r in rows.groupBy((F.col("part") < 2).alias("train"), "label").count().collect()}
    if len(counts) < 4:
        return None
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed,
                          minInstancesPerNode=5, maxBins=_bins(counts[True, 0.0] + counts[True, 1.0])).fit(rows.filter("part < 2"))
    rest = _margins(trees, rows.filter("part = 2"))
    return trees, LogisticRegression(featuresCol="margin", labelCol="label", regParam=0.001).fit(_margin_vector(rest))


def fit(candidates: DataFrame, precision: float = 0.98, rounds: int = 12, depth: int = 3, seed: int = 11,
        spies: float = 0.02):
    """(trees, calibration, thresholds by kind), or None where there are no base spans or no other candidates.

    All candidates count: by hash, two thirds train the trees, the rest calibrates them and sets the thresholds.
    """
    candidates = candidates.filter((F.col("label") == 1) | ~F.col("settled"))
    total = candidates.count()
    if not total:
        return None
    spread = F.xxhash64(F.lit(seed), "mark", "kind", "s", "e")
    # Few rows a partition would only make the trees' many jobs longer.
    parts = max(4, total // PART_ROWS)
    dealt = settle(_vectors(candidates.withColumn("part", F.pmod(F.shiftright(spread, 32), F.lit(3)))).coalesce(parts))
    first = _learn(dealt, rounds, depth, seed)
    if first is None:
        return None

    scored = _margins(first[0], dealt).withColumn("q", _calibrated(first[1], "margin")).drop("margin")
    limits = {r.kind: r.q for r in scored.filter("label = 1 AND part = 2").groupBy("kind").agg(
        F.expr(f"percentile(q, {spies})").alias("q"), F.count(F.lit(1)).alias("n")).filter("n >= 5").collect()}
    if not limits:
        return None
    # Kinds without a limit keep all their unlabelled candidates out, as nothing tells which are negative.
    sure = (F.col("label") == 0) & (F.col("touched") | (F.col("q") < _by_kind(limits, -1.0)))
    dealt = settle(scored.withColumn("label", F.when(F.col("label") == 1, 1.0).when(sure, 0.0)).drop("q"))
    second = _learn(dealt, rounds, depth, seed)
    if second is None:
        return *first, limits

    scored = _margins(second[0], dealt.filter("part = 2")).select("kind", "label", _calibrated(second[1], "margin").alias("p"))
    found = _thresholds(scored, precision)
    return *second, {k: max(p, 0.5) for k, p in found.items() if k in limits}


def _thresholds(scored: DataFrame, precision: float) -> dict[str, float]:
    """For each kind the lowest `p` from which on, of what is not positive, `precision` is not negative; five rows at least.

    Sums run over the distinct `p` of a step and over the steps, so that no task holds a kind's rows.
    """
    label = F.coalesce("label", F.lit(-1.0))
    each = scored.groupBy("kind", "p").agg(
        F.count(F.lit(1)).alias("n"), F.sum((label == 0).cast("long")).alias("wrong"), F.sum((label != 1).cast("long")).alias("other"))
    each = settle(each.withColumn("step", F.floor(F.col("p") * STEPS)))
    sums = ["n", "wrong", "other"]
    higher = Window.partitionBy("kind").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = each.groupBy("kind", "step").agg(*[F.sum(c).alias(c) for c in sums]).select(
        "kind", "step", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_higher") for c in sums])
    above = Window.partitionBy("kind", "step").orderBy(F.desc("p"))
    good = each.join(steps, ["kind", "step"]).select("kind", "p", *[(F.sum(c).over(above) + F.col(f"{c}_higher")).alias(c) for c in sums])
    rows = good.filter((F.col("wrong") <= (1 - precision) * F.col("other")) & (F.col("n") >= 5)).groupBy("kind").agg(F.min("p").alias("p"))
    return {r.kind: r.p for r in rows.collect()}


def _by_kind(values: dict[str, float], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, x in values.items():
        out = F.when(F.col("kind") == k, x).otherwise(out)
    return out


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=INPUTS, outputCol="features").transform(df)


def _margins(trees, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")


def _margin_vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["margin"], outputCol="m").transform(df).drop("features").withColumnRenamed("margin", "raw").withColumnRenamed("m", "margin")


def _calibrated(curve, margin: str) -> Column:
    return 1 / (1 + F.exp(-(F.col(margin) * float(curve.coefficients[0]) + float(curve.intercept))))


def redactions(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the base spans by kind (arrays of s, e), and `added` (array of kind, s, e, p)."""
    # Written once: the texts are read in one pass, and row numbers stay what they are.
    spans = settle(find_spans(docs).withColumn("row", F.monotonically_increasing_id()))
    candidates = settle(candidates_of(spans))
    model = fit(candidates, **options)
    nothing = F.expr("cast(array() as array<struct<s:int,e:int,kind:string,p:double>>)")
    if model is None or not model[2]:
        return spans.select("doc_id", *KINDS, nothing.alias("added"))
    trees, curve, thresholds = model
    chosen = (
        _margins(trees, _vectors(candidates.filter(~F.col("touched") & ~F.col("settled")))).withColumn("p", _calibrated(curve, "margin"))
        .filter(F.col("p") >= _by_kind(thresholds, 2.0)).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e", "kind", "p"))).alias("added"))
    )
    return spans.join(chosen.hint("merge"), "row", "left").select("doc_id", *KINDS, F.coalesce("added", nothing).alias("added"))


def redact(text: Column, spans: Column, mask: str = "[PII]") -> Column:
    """`text` with every span (sorted array of s, e) replaced; overlapping spans give one mask."""
    def piece(parts: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / CUT).cast("int"), F.floor(end / CUT).cast("int")
        return F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), start % CUT + 1, end - start)

    def masked(parts: Column, found: Column, ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        kept = F.transform(found, lambda x, i: F.when(x.s < before(i), "").otherwise(F.concat(piece(parts, before(i), x.s), F.lit(mask))))
        return F.concat(F.array_join(kept, ""), piece(parts, before(F.size(found)), F.char_length(text)))

    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))
    return _bound(parts, lambda p: _bound(spans, lambda found: _bound(
        running(F.transform(found, lambda x: x.e), F.greatest), lambda ends: masked(p, found, ends))))


def digest(found: DataFrame) -> DataFrame:
    """The counts and span lists of the contract; counts are of base spans."""

    def lines(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x.s.cast("string"), x.e.cast("string")))

    def joined(kind: str) -> Column:
        added = F.filter("added", lambda a: a.kind == kind)
        both = F.sort_array(F.concat(F.col(kind), F.transform(added, lambda a: F.struct(a.s.alias("s"), a.e.alias("e")))))
        return lines(kind, both)

    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*[lines(k, F.col(k)) for k in KINDS]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[joined(k) for k in KINDS]), ",").alias("spans"))
