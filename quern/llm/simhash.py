"""Near-duplicates by SimHash: pigeonhole blocks, Hamming checks, connected components.

Fingerprints of 64 bits link where they differ in at most 3. Cut into six blocks, two such fingerprints agree in at least three of
them, so each of the 20 choices of three blocks (32 bits or so) gives a join key, and no link is lost. Equal fingerprints
count once. Rows of a key stream through a sorted partition; a large bucket is cut again by its other bits, by the same rule, and
gives the edges of a spanning forest, never all its pairs.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other; texts of any length
count whole; an id may have several texts, each with its own result; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import components, join_skewed, materialize, sliced

LINKED = 3
WIDTHS = (11, 11, 11, 11, 10, 10)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = (np.arange(8) * 256)[None, :]


def fingerprint(text: str, words: int = 3) -> int:
    """Bit by bit the majority of the XXH64 hashes (seed 42) of a text's shingles, repeats included."""
    found = text.encode().lower().split()  # ASCII letters and blanks only, as bytes know no others
    if not found:
        return 0
    shingles = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype=">u8")
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): text_key tells the texts of one id apart, fp is the fingerprint as a signed long."""

    def hashed(batches):
        for b in sliced(batches, 1000):
            fp = np.array([fingerprint(t) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "text_key", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(hashed, "doc_id long, text_key long, fp long")


def _masks() -> list[int]:
    blocks, low = [], 0
    for w in WIDTHS:
        blocks.append(((1 << w) - 1) << low)
        low += w
    return [sum(c) for c in combinations(blocks, len(WIDTHS) - LINKED)]


def _forest(x: np.ndarray, close: int) -> list[tuple[int, int]]:
    """Edges that join what is linked among few distinct fingerprints, one for each but the first of a component."""
    near, edges, left = np.bitwise_count(x[:, None] ^ x[None, :]) <= close, [], np.ones(len(x), bool)
    for root in range(len(x)):
        if left[root]:
            left[root], todo = False, [root]
            while todo:
                i = todo.pop()
                new = np.flatnonzero(near[i] & left)
                left[new] = False
                edges += [(x[i], x[j]) for j in new]
                todo += new.tolist()
    return edges


def bucket_edges(x: np.ndarray, free: list[int], close: int = LINKED, few: int = 512) -> list[tuple[int, int]]:
    """Edges that join what is linked within a bucket whose members agree in all bits but those of free."""
    if len(x) <= few or len(free) <= close:
        return _forest(x, close)
    edges = []
    for part in np.array_split(np.array(free), close + 1):  # in one of these the members of a linked pair agree
        mask = np.uint64(sum(1 << int(b) for b in part))
        order = np.argsort(x & mask, kind="stable")
        keys = (x & mask)[order]
        rest = [b for b in free if b not in set(part.tolist())]
        for sub in np.split(x[order], np.flatnonzero(keys[1:] != keys[:-1]) + 1):
            if len(sub) > 1:
                edges += bucket_edges(sub, rest, close, few)
    return edges


def links(distinct: DataFrame, close: int = LINKED) -> DataFrame:
    """Edges (a, b) between fingerprints, which join all that is linked."""
    masks = _masks()
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])).alias("k")
    dealt = distinct.select("fp", keys).select("fp", "k.t", "k.key").repartition("t", "key").sortWithinPartitions("t", "key", "fp")

    def edges(batches):
        held: list[np.ndarray] = []

        def close_group(x: np.ndarray, t: int):
            mask = masks[t]
            return bucket_edges(x.view(np.uint64), [i for i in range(64) if not mask >> i & 1], close)

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            fp, t, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], new])
            stops = np.concatenate([new, [len(fp)]])
            out = []
            for i, (s, e) in enumerate(zip(starts, stops, strict=True)):
                first, final = i == 0, i == len(starts) - 1
                if not first and not final and e - s < 2:
                    continue
                mine = (int(t[s]), int(key[s]))
                if first and held and last != mine:
                    x = np.concatenate(held)
                    out += close_group(x, last[0]) if len(x) > 1 else []
                    held = []
                if final or (first and held):
                    held.append(fp[s:e].copy())
                    last = mine
                    if not final:
                        x = np.concatenate(held)
                        out += close_group(x, last[0]) if len(x) > 1 else []
                        held = []
                elif e - s > 1:
                    out += close_group(fp[s:e].copy(), mine[0])
            if out:
                found = np.array(out, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
        x = np.concatenate(held) if held else np.zeros(0, np.int64)
        if len(x) > 1 and (out := close_group(x, last[0])):
            found = np.array(out, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return dealt.mapInArrow(edges, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns per row: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links lead to), text_key (XXH64 of
    the text, for ids with several texts)."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    joined = components(links(distinct.select("fp")))
    named = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = materialize(named.join(least, "component").select("fp", "n", "component_id"), "classes")
    out = join_skewed(rows, by_fp, "fp", "n", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key")
