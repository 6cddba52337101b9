"""Secret scanning with an incremental ledger, in DataFrame operations alone.

Every historical version of a text is content-addressed: a blob is the SHA-256 of its bytes, a path one place (a document) that holds it. The
ledger has a row for each blob and rule version that was ever scanned, with its spans. A scan looks only at pairs that the
ledger lacks, once for each blob, and joins all findings back to every path.

Defined results: a null text counts as empty, an empty text has no spans; a text of any length is scanned whole; equal texts have
equal spans; an empty table gives an empty result; an id may have several texts, and each row, repeated ones too, gets the spans of its own text. Offsets count code points, ends are exclusive. Letters are matched in
either case within ASCII only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import join_skewed, materialize


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans. pattern: matched leftmost and without overlap. group, least: a match counts if that group has so many characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: In the order in which spans with one start are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that have 24 or more
)

LEDGER = "blob binary, kind string, version int, spans array<struct<start:bigint,stop:bigint>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, stop) of a rule's matches: a match starts after all gaps and matches before it."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = found if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("hit"), sizes.alias("part"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        stop = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        span = F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))
        return F.struct(stop.cast("long").alias("at"), F.when(F.char_length(x["part"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return F.when(text.rlike(rule.pattern), F.aggregate(steps, zero, step, lambda acc: acc["out"])).otherwise(none)


def paths_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, blob): which content each path holds; and more columns, if asked for."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("blob"), *more)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks. Returns (findings, ledger): findings has doc_id, blob and, for each kind, an array column of
    spans; the new ledger is the old one and the pairs scanned now, for the next call. Of the ledger only the entries of these docs' blobs are joined
    and grouped, and only new entries are written."""
    spark = docs.sparkSession
    paths = materialize(paths_of(docs, id_col, text_col), "paths")
    blobs = materialize(paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "blobs")
    if ledger is None:
        ledger = spark.createDataFrame([], LEDGER)
    seen = materialize(ledger.join(blobs.select("blob"), "blob", "left_semi"), "seen")
    known = seen.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("known"))  # at most the rules there ever were
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    todo = blobs.join(known, "blob", "left").select("blob", "doc_id", F.array_except(wanted, F.coalesce("known", F.array().cast("array<struct<kind:string,version:int>>"))).alias("todo")).where(F.size("todo") > 0)
    # an id may have several texts, so a text is reached by its id and its blob
    texts = paths_of(docs, id_col, text_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(todo.hint("merge"), ["doc_id", "blob"])
    empty = F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")
    each = [F.when(F.array_contains(F.col("todo"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), spans_of(F.col("text"), r)).otherwise(empty).alias(r.kind) for r in rules]
    scanned = materialize(texts.select("blob", *each), "scanned")
    rows = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules])).alias("x")
    fresh = scanned.select("blob", rows).where("x.spans is not null").groupBy("blob", "x.kind", "x.version").agg(F.first("x.spans").alias("spans"))  # a repeated row was scanned as often
    fresh = materialize(fresh, "ledger")
    now = [F.max(F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.col("spans"))).alias(r.kind) for r in rules]
    by_blob = materialize(seen.unionByName(fresh).groupBy("blob").agg(*now).join(blobs.select("blob", "n"), "blob"), "found")
    return join_skewed(paths, by_blob, "blob", "n", paths.count(), wide=True).drop("n"), ledger.unionByName(fresh)


def scan_history(docs: DataFrame, increments: int = 2, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan docs as they come in so many increments: each scan gets the new docs and the ledger that the ones before wrote to the shared
    folder. Returns the findings of all docs and the last ledger."""
    findings = ledger = None
    for k in range(increments):
        came = docs.where(F.pmod(F.xxhash64(id_col), F.lit(increments)) == k)
        found, ledger = scan(came, ledger, rules, id_col, text_col)
        findings = found if findings is None else findings.unionByName(found)
    return findings, ledger


def report(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by kind, all spans as kind:start:end in order, and the SHA-256 of that list."""
    def told(k: int, r: Rule) -> Column:
        return F.transform(r.kind, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), F.concat_ws(":", F.lit(r.kind), s["start"].cast("string"), s["stop"].cast("string")).alias("said")))

    one = [told(k, r) for k, r in enumerate(rules)]
    spans = F.array_join(F.transform(F.array_sort(F.concat(*one)), lambda s: s["said"]), ",")
    out = findings.select("doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in rules], spans.alias("spans"))
    return out.withColumn("base_sha256", F.sha2("spans", 256))


def hits(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, hits) of the documents that have any, each once: the spans of all kinds, sorted."""
    every = F.array_sort(F.concat(*[F.coalesce(F.col(r.kind), F.array().cast("array<struct<start:bigint,stop:bigint>>")) for r in rules]))
    return findings.select("doc_id", "blob", every.alias("hits")).where(F.size("hits") > 0).groupBy("doc_id", "blob").agg(F.first("hits").alias("hits"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by a mark; unchanged where spans is null."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark))).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(spans.isNull(), text).otherwise(F.aggregate(spans, zero, step, rest))
