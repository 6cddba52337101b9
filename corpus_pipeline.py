"""The corpus pipeline: documents in, packed training sequences out. Each stage works on all that the one before it kept.

Defined results, stage by stage: a null or empty text has no language, so the first stage rejects it (later stages, by themselves, take it as empty); texts of
any length count whole; rows are told apart by id and text, so an id may have several texts; of rows equal in both one stays from the second stage on; ties
are broken by doc_id, as each stage says; an empty table gives an empty result; columns that documents has besides its five pass through every stage
but the last, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, language, packing, secrets, simhash
from quern.llm.common import materialize

#: A language guess that is less sure than this is a rejection, like a text without a letter.
SURE = 0.5


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names that docs doesn't have, however its own are called."""
    mark = uuid.uuid4().hex
    return [f"{n}_{mark}" for n in names]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; a missing lang is filled in."""
    pred, score = _unused(docs, "pred", "score")
    model = language.train(docs, language.remainder(F.col("doc_id")) != 0)
    told = language.annotate(docs, model, "text", pred, score)
    kept = told.where((F.col(pred) != language.UNDETERMINED) & (F.col(score) >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """docs without the rows in gone: (doc_id, key), where key is what tells the texts of an id apart. Always a merge join, so that the
    cost is in proportion at every size."""
    of_text, gone_id, gone_key = _unused(docs, "key", "gone_id", "gone_key")
    listed = materialize(gone.distinct(), "gone").toDF(gone_id, gone_key).hint("merge")
    kept = docs.withColumn(of_text, key).join(listed, (F.col("doc_id") == F.col(gone_id)) & (F.col(of_text) == F.col(gone_key)), "left_anti")
    return kept.select(*docs.columns)


def text_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; of rows that are equal in doc_id and text, one."""
    found = materialize(exact_dedup.dedup(docs, lambda doc_id: F.pmod(F.xxhash64(doc_id), F.lit(2)) == 0), "found")
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    repeated = materialize(found.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    if not repeated.take(1):
        return without(docs, found.where("not kept").select("doc_id", "text_sha256"), sha)
    alone = without(docs, found.where("not kept").select("doc_id", "text_sha256").unionByName(repeated), sha)
    again_id, again_sha, of_text = _unused(docs, "again_id", "again_sha", "sha")
    again = docs.withColumn(of_text, sha).join(repeated.toDF(again_id, again_sha).hint("merge"), (F.col("doc_id") == F.col(again_id)) & (F.col(of_text) == F.col(again_sha)), "left_semi")
    firsts = [F.first(c).alias(c) for c in docs.columns if c != "doc_id"]
    return alone.unionByName(again.groupBy("doc_id", of_text).agg(*firsts).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the ones with the smallest doc_id stay: one, unless an id has several texts."""
    return without(docs, simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id", "text_key"), text_key(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by [secret]; n_chars follows."""
    findings, _ = secrets.scan(docs)
    hit_id, hit_blob, hits, of_text, new = _unused(docs, "id", "blob", "hits", "sha", "new")
    found = materialize(secrets.hits(findings), "findings").toDF(hit_id, hit_blob, hits)
    sha = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))
    joined = docs.withColumn(of_text, sha).join(found.hint("merge"), (F.col("doc_id") == F.col(hit_id)) & (F.col(of_text) == F.col(hit_blob)), "left")
    redacted = joined.withColumn(new, secrets.redacted(F.col("text"), F.col(hits)))
    told = {"text": F.col(new), "n_chars": F.when(F.col(hits).isNotNull(), F.char_length(new).cast("long")).otherwise(F.col("n_chars"))}
    return redacted.select(*[told[c].alias(c) if c in told else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash", near_duplicates),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: Language identification and packing can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again for the next one."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = materialize(out, name)
    return out
