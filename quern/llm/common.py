"""What the operators of this subpackage share: shared storage, skew-safe joins, connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one for this application in local mode,
    whose executors are the driver itself; on a cluster a folder of this machine would lose data, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        atexit.register(shutil.rmtree, _own[app].removeprefix("file://"), ignore_errors=True)
    return _own[app]


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quern-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and reread it: this cuts the lineage, survives
    the loss of any executor, and gives the planner the table's true size."""
    spark = df.sparkSession
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quern_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read again, not even a retried task, and let Spark drop the shuffles behind them."""
    for t in tables:
        _delete(t.sparkSession, t.quern_path)
    drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished queries now: it does so once their plans are collected, which may take long by itself."""
    spark._jvm.System.gc()


def clean(spark: SparkSession) -> None:
    """Delete every table that this application has put into the shared folder: once all results are read."""
    _delete(spark, _home(spark))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to so many rows. Spark bounds a batch by its bytes; this bounds what Python makes of it at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


#: Shares that a hot key is dealt out to where its payload can't be broadcast.
SHARES = 64


def join_skewed(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, wide: bool = False) -> DataFrame:
    """Inner join on key, where right has one row per key and its column weight says how many rows of left
    have that key. Keys holding a thousandth of all rows or more (at most 1000, so with rows of a fixed size safe to
    broadcast) are joined without a shuffle; the rest go through an ordinary join. wide: right's rows have no bound in size, so of hot ones the keys alone are
    broadcast, and left's rows of such a key are dealt out to SHARES copies of its row. left is read from files, so that a retried task deals
    them out alike."""
    least = max(1000, total // 1000)
    hot = right.where(F.col(weight) >= least)
    cold = right.where(F.col(weight) < least)
    names = F.broadcast(hot.select(key))
    rest = left.join(names, key, "left_anti").join(cold, key)
    if not wide:
        return left.join(F.broadcast(hot), key).unionByName(rest)
    dealt = left.join(names, key, "left_semi").withColumn("_share", F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).cast("int"))
    copies = hot.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(copies.hint("merge"), [key, "_share"]).drop("_share").unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long). Returns (node, component): component is the least node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each is a min per node and a join, so
    no neighbourhood is gathered in one task. Each round is written to the shared folder. Nodes without an edge
    don't appear; self-loops are ignored; null ends are dropped. Ends when a round changes nothing."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, "edges")
    last = None
    for _ in range(max_rounds):
        before = e
        # large-star: every neighbour above a node is linked to the least of the node's neighbourhood
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: a node and its lower neighbours are linked to the least of them
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(low, "a")
        e = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(e, "edges")
        _delete(before.sparkSession, before.quern_path)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        last = state
    raise RuntimeError(f"components: no end after {max_rounds} rounds")


def renumbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(docs as (doc_id, text), names). Where every id occurs once, these are docs themselves and None. Else rows with one id and different texts are
    documents of their own, and rows that are equal in both are one: its number, in the order of ids and, within an id, of digests, stands as doc_id, and
    names is (doc_id, id, sha): the number, the id and the text's digest."""
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not whole.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").take(1):
        return whole, None
    keyed = whole.select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")
    ordered = keyed.select("id", "sha").distinct().repartitionByRange("id", "sha").sortWithinPartitions("id", "sha")
    names = materialize(ordered.select(F.monotonically_increasing_id().alias("doc_id"), "id", "sha"), "names")  # ranges ascend, so the numbers do
    texts = keyed.join(names, ["id", "sha"]).groupBy("doc_id").agg(F.first("text").alias("text"))
    return materialize(texts, "texts"), names
