"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, html_text, language, pieces, quality, urls
from .jaccard import jaccard_components
from .scoring import backoff_scores
from .substring import remove_repeats

WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    done = chat.format_chats(rows).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    said_in_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said_in_turns).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs, ~language.held_out())
    return language.identify(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "coverage")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(_table(spark, sf_dir, "documents"), decoded=True)
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "round_trip")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: the items that leak into it, and how many of those have changed slots."""
    docs = _table(spark, sf_dir, "documents")
    found = decontaminate.leaks(docs, _table(spark, sf_dir, "benchmark"))
    found = found.groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.sum(F.when(F.col("n_changed") > 0, 1).otherwise(0)).alias("n_reworded"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.col("items").isNotNull().alias("leaked"), F.size(items).cast("long").alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("items"), F.coalesce("n_reworded", F.lit(0)).cast("long").alias("n_reworded"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_language_id": op2_language_id,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_html_text": op7_html_text,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, coalesce(lag(role) OVER w, 'start') AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS last FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + length(role) + length(replace(replace(replace(text, '\', '\\'), '<turn ', '\o'), '</turn>', '\c'))) AS BIGINT) AS formatted_chars,
  bool_and(before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>tool', 'tool>assistant')) AND bool_or(last = 1 AND role = 'assistant') AS valid
FROM t GROUP BY conv_id""",
    "op3_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM rare JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id""",
    "op6_lm_scoring": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS x, unnest(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i > 1 THEN ws[i - 1] END)) AS h, unnest(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i > 2 THEN ws[i - 2] END)) AS g FROM w),
one AS (SELECT x, count(*) AS c FROM t GROUP BY x),
two AS (SELECT h, x, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY h, x),
three AS (SELECT g, h, x, count(*) AS c FROM t WHERE g IS NOT NULL GROUP BY g, h, x),
total AS (SELECT count(*) AS n FROM t)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, round(coalesce(s.log_score, 0), 4) AS log_score FROM w LEFT JOIN (
  SELECT t.doc_id, sum(
    CASE WHEN three.c IS NOT NULL THEN ln(three.c / history.c) ELSE CASE WHEN t.g IS NOT NULL THEN ln(0.4) ELSE 0 END +
    CASE WHEN two.c IS NOT NULL THEN ln(two.c / prev.c) ELSE CASE WHEN t.h IS NOT NULL THEN ln(0.4) ELSE 0 END + ln(one.c / total.n) END END) AS log_score
  FROM t JOIN one ON one.x = t.x LEFT JOIN one prev ON prev.x = t.h LEFT JOIN two ON two.h = t.h AND two.x = t.x
  LEFT JOIN two history ON history.h = t.g AND history.x = t.h LEFT JOIN three ON three.g = t.g AND three.h = t.h AND three.x = t.x CROSS JOIN total GROUP BY t.doc_id) s ON s.doc_id = w.doc_id""",
    "op10_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (
  SELECT doc_id, p, g, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS rn
  FROM (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) AS g FROM w WHERE len(ws) >= 20)
), gone AS (SELECT DISTINCT doc_id, p + o AS p FROM (SELECT doc_id, p, unnest(range(0, 20)) AS o FROM win WHERE rn > 1)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS t FROM w),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY word.p) AS k FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
}
