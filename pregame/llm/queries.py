"""One query per operator, over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.llm import (
    collocations, decontamination, jaccard, line_dedup, mixing, periodic_runs, pii, quality, sharding, substring_dedup,
    token_counts, toxicity, warc,
)
from pregame.llm.common import table
from pregame.llm.registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

# DuckDB: the six blanks, as a string.
BLANKS_SQL = "(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(sql=f"""
WITH lines AS (
  SELECT doc_id, i, line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {BLANKS_SQL}) AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
),
often AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN often o USING (key) GROUP BY doc_id
""")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines found in 10 documents or more are dropped everywhere; the table arrives in 4 batches."""
    batches = line_dedup.file_batches(table(spark, folder, "documents"), 4)
    kept = line_dedup.dedup_lines(batches, min_docs=10, fanout=2)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Base spans and what the trees add, over all documents."""
    return pii.digest(pii.redactions(table(spark, folder, "documents")))


@query()
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words under a 50-word window that starts in an earlier document go; levels of 25 and 50 words."""
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"), 50, 25)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A lexicon learned from labels that are not held out, applied to all documents."""
    docs = table(spark, folder, "documents")
    lexicon = toxicity.learn(docs, toxicity.train_labels(table(spark, folder, "labels")))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, up to 12% of edits."""
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and robust outliers per language and source."""
    return quality.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "distance", "outlier")


@query()
def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard.similar_sets(table(spark, folder, "documents"), 4, 85)


@query()
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed by weights 1, 2, 3, from blocks of 128 words, at most 3 times each."""
    out, _ = mixing.mix(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, through 4096 virtual slots."""
    placed, _ = sharding.place(table(spark, folder, "documents"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(sql="""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS sha FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS keeper FROM d),
letters AS (
  SELECT sha, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY i) AS payload_digest
  FROM (SELECT sha, i, list_sum(list_transform(range(5), lambda b: ((
          (instr('0123456789abcdef', substr(sha, ((5 * i + b) // 4 + 1)::INT, 1)) - 1) >> (3 - (5 * i + b) % 4)) & 1) << (4 - b)))::INT AS v
        FROM (SELECT DISTINCT sha FROM d), range(32) r(i))
  GROUP BY sha
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM k JOIN letters USING (sha)
""")
def op10_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC records and read back through the index."""
    pages = table(spark, folder, "pages")
    archive = warc.write_archive(pages)
    found = warc.look_up(archive, pages.select("url", "page_id"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of all documents under the public 50k byte-level vocabulary; more than 512 are over the limit."""
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query(sql="""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, size, list_aggregate(ws[i:i + size - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
        FROM w, (SELECT unnest(range(1, 6)) AS size) WHERE len(ws) >= size)
),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM f WHERE size > 1)
),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n::BIGINT AS n, k,
         ((1000::HUGEINT * c.a * t.n::HUGEINT) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
  JOIN totals t ON t.lang = c.lang
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, size - k + 2)) AS i
        FROM (SELECT *, string_split(phrase, ' ') AS words, unnest(range(2, size)) AS k FROM f WHERE size > 2))
  GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest l LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 100 * a
QUALIFY rank <= 2000
""")
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 phrases of 2 to 5 words of each language that occur 100 times or more."""
    return collocations.collocations(table(spark, folder, "documents"), 5, 100, 2000)


@query()
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which is made periodic first; runs cut to one period."""
    found = periodic_runs.collapse_runs(periodic_runs.with_planted_period(table(spark, folder, "documents")), 24)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        periodic_runs.runs_digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
