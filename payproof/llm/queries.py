"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html, importance, interactions, katz, langid, lines, mixing, phrases, pii, quality, simhash
from ._common import fold_of, table

Query = Callable[[SparkSession, str], DataFrame]


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: lines and characters removed, and a digest of what is left."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines_removed", "n_chars_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Katz score of every document, learned from those whose fold is not 1."""
    held_out = fold_of(F.col("doc_id")) == 1
    scored = katz.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of one more whose texts hold another template's control strings."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.read_chats(chat.format_chats(turns.unionByName(extra))))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that a 50-word window of a smaller document covers."""
    out = phrases.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, linked at 3 or fewer differing bits."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base check and verdict of the learned rules for every document."""
    rows, _ = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document for weights 5, 2, 1 over the sources and 150 % of all words."""
    return mixing.mix_by_source(table(spark, sf_dir, "documents"), weights=(5, 2, 1)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", F.col("items.item_id").alias("item_ids"), F.col("items.edits").alias("edits"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those whose fold is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold_of(F.col("doc_id")) != 0))
    return langid.identify(docs, model).select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their orders, per language."""
    return interactions.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight, noisy score and rank of every document, drawn towards the benchmark's words."""
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), importance.Features(1, 1, 10_000), percent=10, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document: counts and digest of what strict patterns find, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find_private(docs, pii.fit(docs))
    base = F.filter("found", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS etext, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS erole,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN same THEN length('<|next|>') ELSE length('<|role|>') + length(erole) + length('<|text|>') + length('<|end|>') + 1 END + length(etext))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (
  SELECT t, min(doc_id) AS least FROM d GROUP BY t
), failed AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e
  FROM d JOIN least USING (t)
), masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
  FROM failed
), counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY ALL
), grown(filter_order, seen) AS (
  SELECT '', 0
  UNION ALL SELECT filter_order || f, seen + bit FROM grown, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, bit) WHERE seen & bit = 0
), bits AS (
  SELECT filter_order, k AS step, (1 << (ascii(substr(filter_order, k, 1)) - 65))::INT AS bit,
    list_sum([CASE WHEN j < k THEN 1 << (ascii(substr(filter_order, j, 1)) - 65) ELSE 0 END FOR j IN range(1, 6)])::INT AS before
  FROM grown, range(1, 6) r(k) WHERE length(filter_order) = 5
), steps AS (
  SELECT part, filter_order, step::INT AS step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM counts, bits GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM steps
"""

#: CRC-32 of the distinct words alone, byte by byte from a table that SQL makes.
OP12_SQL = r"""
WITH RECURSIVE bitwise(b, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bitwise WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY b) AS t FROM bitwise WHERE k = 8
), texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, 0, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), counted AS (
  SELECT side, r, w, count(*) AS n FROM (SELECT side, r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts) GROUP BY ALL
), vocabulary AS (
  SELECT w, hex(w) AS h FROM (SELECT DISTINCT w FROM counted)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc
), sides AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counted JOIN hashed USING (w) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM sides
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain FROM sides, totals
), sums AS (
  SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM counted JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r
), weighed AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
    ('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT AS h
  FROM texts LEFT JOIN sums USING (r) WHERE side = 0
), scored AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM placed
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_line_dedup, op4_lm_scoring, op5_chat_formatting, op6_substring_dedup, op7_html_extraction, op8_simhash, op9_decontamination, op10_language_id, op11_filter_interactions, op12_importance_resampling, op13_personal_data)}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_formatting": OP5_SQL, "op11_filter_interactions": OP11_SQL, "op12_importance_resampling": OP12_SQL}
