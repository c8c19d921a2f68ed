"""The ten operators as queries over the synthetic tables, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, byte_bpe, embedding_dedup, langid, line_dedup, packing, quality_fm, simhash, token_codes, toxicity, word_tokens
from tidemark.llm.common import crc_mod, scratch_path

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
END_ID = 1


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-codes")
    vocabulary = word_tokens.read_vocabulary(public_tokenizers.path(WORD_VOCABULARY))
    token_codes.write_token_codes(_read(spark, sf_dir, "documents"), path, vocabulary, END_ID)
    return token_codes.document_digests(spark, path)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path(BYTE_RANKS))
    return byte_bpe.round_trip_digests(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_fm.train(docs, _read(spark, sf_dir, "labels"), learn=quality_fm.learn_fold(5, 0))
    return _predicted(quality_fm.score(docs, model), crc_mod(F.col("doc_id"), 5) == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    grammar = toxicity.train(docs, _read(spark, sf_dir, "labels"), learn=toxicity.learn_fold(4, 2))
    return _predicted(toxicity.score(docs, grammar), crc_mod(F.col("doc_id"), 4) == 2)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    filters = langid.train(docs, learn=langid.learn_fold(4, 2))
    return langid.predict(docs, filters).withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2).select("doc_id", "held_out", "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = word_tokens.read_vocabulary(public_tokenizers.path(WORD_VOCABULARY))
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary, END_ID, window=2048, digests=True)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), limit=2, shingle=3, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_repeated_chunks(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "lines_kept", "lines_removed", F.md5("text").alias("text_md5"))


def _predicted(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


LINE_DEDUP_SQL = """
WITH l AS (
    SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), a AS (
    SELECT *, list_filter(range(0, len(lines)), lambda i: trim(lines[i + 1]) <> '') AS filled FROM l
), w AS (
    SELECT doc_id, k, lines[filled[k + 1] + 1] AS x, CASE WHEN k + 1 < len(filled) THEN lines[filled[k + 2] + 1] END AS y
    FROM (SELECT doc_id, lines, filled, unnest(range(0, len(filled))) AS k FROM a)
), u AS (
    SELECT doc_id, k, 2 AS n, x, y FROM w WHERE y IS NOT NULL
    UNION ALL
    SELECT doc_id, k, 1, x, NULL FROM w WHERE length(x) >= 120
), f AS (
    SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(k) OVER o AS first_k FROM u WINDOW o AS (PARTITION BY n, x, y ORDER BY doc_id, k)
), g AS (
    SELECT DISTINCT doc_id, k + i AS k
    FROM (SELECT doc_id, k, unnest(range(0, n)) AS i FROM f WHERE doc_id <> first_doc OR k - first_k >= n)
), p AS (
    SELECT doc_id, text, p, lines[p + 1] AS line, len(list_filter(filled, lambda q: q <= p)) - 1 AS k
    FROM (SELECT doc_id, text, lines, filled, unnest(range(0, len(lines))) AS p FROM a)
), o AS (
    SELECT p.doc_id, count(*) FILTER (WHERE g.k IS NULL) AS lines_kept, count(g.k) AS lines_removed,
        coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE g.k IS NULL), '') AS rest, any_value(text) AS text
    FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.k = g.k GROUP BY p.doc_id
)
SELECT doc_id, lines_kept, lines_removed, CASE WHEN text IS NULL THEN NULL ELSE md5(rest) END AS text_md5 FROM o
"""

QUERIES = {
    "op1_token_codes": op1_token_codes,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_ann": op3_ann,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE_SQL = {"op10_line_dedup": LINE_DEDUP_SQL}
