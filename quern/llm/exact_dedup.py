"""Exact deduplication of a batch against immutable snapshots.

A snapshot is a table of digest groups that never changes once written, with one static binary-fuse filter for
each shard of its digests. An incoming batch is grouped by itself; the filters screen its distinct digests; only
positives meet the snapshot's exact buckets, where the texts themselves are compared byte by byte.

Defined results: a null text counts as the empty text; empty texts equal one another; repeated rows count as
often as they occur, and all rows of the largest id stay; rows of one id may have different texts; an empty table gives an empty result; columns
other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import fuse
from quern.llm.common import join_skewed, materialize

#: Digests for one filter, on average: what one task builds or probes.
SHARD = 50_000


@dataclass
class Snapshot:
    """groups: (sha, n, keep), one row per distinct text; filters: one binary-fuse filter for each shard."""

    groups: DataFrame
    filters: DataFrame
    shards: int


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, sha): the SHA-256 of each whole text in UTF-8; and more columns, if asked for."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("sha"), *more)


def groups_of(hashed: DataFrame) -> DataFrame:
    """Counts are combined before the shuffle, so a hot text costs one row per task."""
    return hashed.groupBy("sha").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("sha"), F.lit(shards)).cast("int").alias("shard")


def _key():
    return F.xxhash64(F.lit("filter"), F.col("sha")).alias("key")


def snapshot(hashed: DataFrame) -> Snapshot:
    groups = materialize(groups_of(hashed), "groups")
    shards = max(1, groups.count() // SHARD)

    def construct(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"shard": pdf["shard"].iloc[0], **fuse.build(pdf["key"].to_numpy().view(np.uint64))}])

    filters = groups.select(_shard(shards), _key()).groupBy("shard").applyInPandas(construct, "shard int, seed long, length long, segments long, table binary")
    return Snapshot(groups, materialize(filters, "filters"), shards)


def screen(batch: DataFrame, base: Snapshot) -> DataFrame:
    """The batch's groups with maybe: False if the snapshot surely lacks the digest."""

    def probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        rows["maybe"] = fuse.contains(filters.iloc[0].to_dict(), rows["key"].to_numpy().view(np.uint64)) if len(filters) and len(rows) else False
        return rows[["sha", "n", "keep", "maybe"]]

    sharded = batch.select("sha", "n", "keep", _shard(base.shards), _key())
    return sharded.groupBy("shard").cogroup(base.filters.groupBy("shard")).applyInPandas(probe, "sha binary, n long, keep long, maybe boolean")


def same_bytes(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pairs: (sha, keep, base_keep). Adds same: whether the two documents' texts are the same bytes.
    One document stands for each group, so a group's size doesn't matter."""
    ids = materialize(pairs.select("sha", F.explode(F.array("keep", "base_keep")).alias("doc_id")), "buckets")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    # always a merge join: each text moves once at any size, where a broadcast would stop fitting at some size
    compared = texts.join(ids.hint("merge"), "doc_id").groupBy("sha").agg((F.min("body") == F.max("body")).alias("same"))
    return pairs.join(compared, "sha")


def dedup(docs: DataFrame, is_base, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate docs, of which the rows where is_base holds form the snapshot and the others the batch.

    Returns per row: doc_id, keep_id (the largest id of its equal texts), group_size, kept, text_sha256.
    """
    hashed = materialize(digests(docs, id_col, text_col).withColumn("base", F.coalesce(is_base(F.col("doc_id")), F.lit(False))), "digests")
    base = snapshot(hashed.where("base"))
    batch = materialize(screen(groups_of(hashed.where("not base")), base), "screened")
    buckets = batch.where("maybe").join(base.groups.select("sha", F.col("keep").alias("base_keep")), "sha").select("sha", "keep", "base_keep")
    # an id may have several texts, so a row is known by its id and its digest
    row = lambda i: F.struct(F.col(i).alias("id"), F.col("sha")).alias(i)
    known = digests(docs, id_col, text_col, F.col(text_col).alias("text")).select(row("doc_id"), "text")
    pairs = materialize(buckets.select("sha", row("keep"), row("base_keep")), "pairs")
    checked = materialize(same_bytes(pairs, known).select("sha", "same"), "checked")
    # a batch group whose digest meets other bytes in the snapshot stays a class of its own
    apart = batch.join(checked.where("not same").select("sha"), "sha", "left_semi").select("sha", "n", "keep").withColumn("apart", F.lit(True))
    joined = batch.join(checked.where("not same").select("sha"), "sha", "left_anti").select("sha", "n", "keep")
    classes = joined.unionByName(base.groups).groupBy("sha").agg(F.sum("n").alias("n"), F.max("keep").alias("keep")).withColumn("apart", F.lit(False)).unionByName(apart)
    classes = materialize(classes, "classes")
    total = hashed.count()
    clash = checked.where("not same").select("sha")  # digest collisions of SHA-256: none, as a rule
    rows = hashed.withColumn("apart", F.lit(False))
    if clash.take(1):
        rows = hashed.join(clash, "sha", "left_semi").withColumn("apart", ~F.col("base")).unionByName(hashed.join(clash, "sha", "left_anti").withColumn("apart", F.lit(False)))
    keyed = lambda df: df.withColumn("cls", F.struct("sha", "apart")).drop("sha", "apart")
    out = join_skewed(keyed(rows), keyed(classes), "cls", "n", total)
    return out.select(
        "doc_id",
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("doc_id") == F.col("keep")).alias("kept"),
        F.lower(F.hex("cls.sha")).alias("text_sha256"),
    )
