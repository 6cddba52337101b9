"""Packing documents into training sequences: shortest-pack-first over the histogram of lengths (Krell et al., 2021).

A document's ids are cut into pieces of at most ``capacity``; the histogram of piece lengths, at most ``capacity`` numbers, goes to the
driver, which places lengths longest first, each into the emptiest pack that it fits, and counts how often each pattern of
lengths occurs. The patterns then meet the pieces again by the rank of a piece among those of its length.

Defined results: a null text counts as empty; a document of no ids still has its closing id; repeated rows
are packed as often as they occur; pieces that tie in length, id, place and checksum are alike, so their order doesn't matter; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import bpe
from quern.llm.common import materialize, sliced

#: Pieces of one length that are ranked in one group, on average.
RANKED = 2000


def pieces(docs: DataFrame, path: str, closing: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and the closing id, cut every ``capacity`` ids."""
    end = closing.to_bytes(4, "little")

    def cut(batches):
        words = bpe.chunks_of(path).words
        for b in sliced(batches, 500):
            out = [[], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = words.ids(text) + end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    for column, x in zip(out, (doc_id, s, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return whole.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (how many packs have it, [(length, times)] in order). Each length goes, longest first, to the packs with most room."""
    packs: dict[int, list] = {}  # room -> [(count, pattern)]
    rooms: list[int] = []  # heap of negated rooms, some of them gone
    done: list = []

    def put(room: int, count: int, pattern: tuple) -> None:
        if not room:
            done.append((count, pattern))
            return
        if room not in packs:
            packs[room] = []
            heapq.heappush(rooms, -room)
        packs[room].append((count, pattern))

    def with_length(pattern: tuple, length: int, times: int) -> tuple:
        if pattern and pattern[0][0] == length:
            return ((length, pattern[0][1] + times), pattern[1])
        return ((length, times), pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and -rooms[0] not in packs:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room >= length:
                count, pattern = packs[room].pop()
                if not packs[room]:
                    del packs[room]
                used = min(count, left)
                if used < count:
                    put(room, count - used, pattern)
                put(room - length, used, with_length(pattern, length, 1))
                left -= used
            else:  # a new pack is filled with this length before the next is opened
                times = capacity // length
                full, rest = divmod(left, times)
                if full:
                    put(capacity - times * length, full, ((length, times), ()))
                if rest:
                    put(capacity - rest * length, 1, ((length, rest), ()))
                left = 0
    out = []
    for count, pattern in [*done, *(x for group in packs.values() for x in group)]:
        lengths = []
        while pattern:
            lengths.append(pattern[0])
            pattern = pattern[1]
        out.append((count, lengths[::-1]))
    return out


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first_rank, n, sequence, offset): the pieces of that length with ranks from first_rank, n of them, stand at
    that offset in the sequences from ``sequence``, one in each."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length, times in lengths:
            for _ in range(times):
                first = ranks.get(length, 0)
                out.append((length, first, count, sequence, offset))
                ranks[length] = first + count
                offset += length
        sequence += count
    return out


def ranked(cut: DataFrame) -> DataFrame:
    """Adds rank, from 0 among the pieces of a length. A length that very many pieces have is ranked in groups by a hash of
    doc_id, and the groups' sizes are summed up: no task holds all of it."""
    groups = max(1, cut.count() // RANKED)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("length").orderBy("bucket")) - F.col("size")).drop("size")
    return within.join(before, ["length", "bucket"]).withColumn("rank", F.col("place") + F.col("before")).drop("bucket", "place", "before")


def pack(docs: DataFrame, capacity: int = 4096, closing: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document. Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path or bpe.vocabulary_path(), closing, capacity, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    placed = slots(shortest_pack_first(histogram, capacity))
    table = spark.createDataFrame(placed, "slot_length long, first_rank long, n long, sequence long, offset long")
    where = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    # the slots are bounded by the capacity, not by the data: some thousand patterns of a few lengths each
    return (
        ranked(cut)
        .join(F.broadcast(table), where)
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
    )
