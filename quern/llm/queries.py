"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import bpe, exact_dedup, gif, language, packing, paragraphs, secrets, simhash, suffixes, toxicity
from quern.llm.common import documents


def op9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir, "doc_id", "text"), lambda doc_id: F.pmod(F.xxhash64(doc_id), F.lit(2)) == 0)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir, "doc_id", "text"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secrets.scan_history(documents(spark, sf_dir, "doc_id", "text"))
    return secrets.report(findings)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.features(gif.store(documents(spark, sf_dir, "doc_id", "text")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.rate(documents(spark, sf_dir, "doc_id", "text"), labels, lambda doc_id: language.remainder(doc_id) == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir, "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_suffixes": op2_suffixes,
    "op3_secrets": op3_secrets,
    "op4_language": op4_language,
    "op5_gif": op5_gif,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_paragraphs": op9_paragraphs,
    "op10_exact_dedup": op10_exact_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op3_secrets": r"""
        WITH rules(k, kind, pattern, grp, least) AS (VALUES
            (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
            (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24)),
        hits AS (
            SELECT doc_id, k, kind, least, string_split_regex(coalesce(text, ''), pattern) AS gaps,
                   CASE k WHEN 0 THEN regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)
                          WHEN 1 THEN regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+', 0)
                          ELSE regexp_extract_all(coalesce(text, ''), '[0-9a-f]+', 0) END AS found,
                   CASE k WHEN 0 THEN regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE NULL END AS parts
            FROM documents, rules),
        one AS (
            SELECT doc_id, k, kind, least, i, found[i] AS hit, coalesce(parts[i], found[i]) AS part,
                   list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS start
            FROM hits, unnest(range(1, len(found) + 1)) AS u(i)
            WHERE length(coalesce(parts[i], found[i])) >= least),
        said AS (
            SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
                   string_agg(kind || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT, ',' ORDER BY start, k) AS spans
            FROM one GROUP BY doc_id)
        SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN said USING (doc_id)""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
