"""The corpus queries op1 to op10 and their SQL; each is its operator over a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_round_trip, read_ranks
from .common import Scratch
from .embedding_dedup import embedding_groups
from .exact_dedup import exact_dedup
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .simhash import simhash_groups
from .token_counts import split_vocabulary, token_counts
from .toxicity import fit_toxicity, score_toxicity
from .url_filters import judge_urls
from .warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy pieces of whole words by the multilingual byte vocabulary, whose space-led tokens begin words."""
    first, later = split_vocabulary(set(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))))
    return token_counts(table(spark, sf_dir, "documents"), first, later)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe_round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives go to the shared folder, with least_bytes 0: any equal payloads revisit."""
    return warc_round_trip(table(spark, sf_dir, "pages"), f"{Scratch(spark, 'warc-archives').root}/files")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_url_filters": op8_url_filters,
    "op9_embeddings": op9_embeddings,
    "op10_mixing": op10_mixing,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, html, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex,
                     max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INTEGER + 1, 1)
                   FOR k IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM h
    """,
    "op10_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   md5('mix:' || doc_id::VARCHAR) AS key
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS rank
            FROM d GROUP BY source),
        w AS (
            SELECT *, (CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s),
        h AS (
            SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s)
                       - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
            FROM w),
        l AS (SELECT share AS settled FROM h WHERE share * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
        b AS (
            SELECT source, source_size, least(cap, settled * weight) AS target, round(least(cap, settled * weight))::BIGINT AS budget
            FROM h, l),
        p AS (
            SELECT d.*, b.source_size, b.target, b.budget,
                   CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target,
               (epochs * size + greatest(0, least(budget - epochs * source_size - before, size)))::BIGINT AS taken
        FROM p
    """,
}
