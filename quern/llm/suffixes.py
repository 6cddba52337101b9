"""Substring deduplication by suffix sorting: remove each byte covered by a 100-byte string that starts earlier too.

A suffix sort of all positions at once would shuffle tens of times the input. Equal strings of 100 bytes hold the same content-defined anchor
(the least hash of 24 bytes among them), so the sort is dealt out by anchors without losing a pair:

1. Every document's anchors are found; an anchor owns a run of starts, and its stretch is what their strings cover. Stretches with equal
   bytes are decided by a hash of key and stretch (128 bits): all but the first are removed.
2. Where one anchor has several different stretches, only parts of them may be equal. The first of each goes on, cut into runs of starts that
   share 84 bytes around the anchor; runs that share these with no other are dropped.
3. Tasks sort the suffixes of what is left by the difference-cover algorithm (Kärkkäinen and Sanders, 2003): sort sampled triples, recurse on
   names, sort the remaining suffixes by one byte and a rank, merge; then compare adjacent prefixes of 100 bytes. Of each
   run of equal prefixes the first start in the corpus stays.

Defined results: a null text counts as empty; texts under 100 bytes lose nothing; matches never cross documents; a text of any length is
taken whole; of equal strings the one in the smaller doc_id, then at the earlier place, stays; rows of one id with different texts are documents of their own, in the
order of their digests; rows that occur twice are one document, and each gets its result; an empty table gives an empty result; columns other than the id and
the text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, renumbered, sliced

LENGTH, GRAM = 100, 24
WINDOW = LENGTH - GRAM + 1
#: Starts that one run of step 2 holds at most; the strings of a run share LENGTH - PART + 1 bytes.
PART = 17
U = np.uint64
_RNG = np.random.default_rng(2)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
_FACTORS = _RNG.integers(0, 1 << 63, 8, dtype=U) * U(2) + U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(32))


def _doubled(g: np.ndarray, size: int, level: int) -> np.ndarray:
    """Hashes of 2 * size bytes from those of size bytes."""
    return g[:-size] * _FACTORS[level] + g[size:]


def anchors(data: bytes) -> tuple[np.ndarray, ...]:
    """(key, stretch, first, last, place): for each anchor the hash of its 24 bytes, that of its stretch, the first and last start that it
    owns, and its place. Every start of a 100-byte string is owned by one anchor, chosen by the string's bytes alone."""
    g = _BYTE[np.frombuffer(data, np.uint8)]
    for level in range(3):
        g = _doubled(g, 1 << level, level)
    eight = g
    g = _doubled(g, 8, 3)
    key = _mix(g[: len(g) - 8] * _FACTORS[4] + eight[16:])
    g = _doubled(g, 16, 4)
    least = (key & U(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=U)
    for size in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-size], least[size:])
    least = np.minimum(least[: len(least) - (WINDOW - 64)], least[WINDOW - 64 :])
    place = (least & U(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    last = np.concatenate([first[1:], [len(place)]]) - 1
    place = place[first]
    g = _doubled(g, 32, 5)  # 64 bytes: three of them cover a stretch
    size = last - first + LENGTH
    parts = g[first] * _FACTORS[6] + g[first + (size - 64) // 2] * _FACTORS[7] + g[first + size - 64] + size.astype(U)
    return key[place], _mix(parts), first, last, place


def dealt(docs: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """Anchors as (key, stretch, doc_id, packed). What a task knows to be a later copy carries that mark and a key of its own, so the most
    common stretch gives one row per task and not one per document."""

    def packed_rows(parts: list):
        key, stretch, doc, pack = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((pack, doc, stretch, key))
        key, stretch, doc, pack = key[order], stretch[order], doc[order], pack[order]
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (stretch[1:] == stretch[:-1])])
        pack[again] |= 1
        key[again], stretch[again] = _mix(doc[again].astype(U)), 0
        order = np.lexsort((pack, doc))  # in the order of documents rows compress better
        key, stretch, doc, pack = key[order], stretch[order], doc[order], pack[order]
        for s in range(0, len(key), 100_000):
            e = s + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(key[s:e].view(np.int64)), pa.array(stretch[s:e].view(np.int64)), pa.array(doc[s:e]), pa.array(pack[s:e])], ["key", "stretch", "doc_id", "packed"])

    def found(batches):
        parts, held = [], 0
        for b in sliced(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = t.encode()
                if len(data) < LENGTH:
                    continue
                key, stretch, first, last, place = anchors(data)
                parts.append((key, stretch, np.full(len(key), i, np.int64), first << 24 | (last - first) << 16 | (place - first) << 8))
                held += len(key)
                if held >= flush:
                    yield from packed_rows(parts)
                    parts, held = [], 0
        if parts:
            yield from packed_rows(parts)

    return docs.mapInArrow(found, "key long, stretch long, doc_id long, packed long")


def decided(rows: DataFrame) -> DataFrame:
    """(doc_id, packed, removed): removed anchors' runs, and the first of each stretch where its anchor has several stretches."""

    def out(batches):
        key = stretch = None  # of the row before
        waiting = None  # the first row of a key, until another stretch comes
        for b in batches:
            if not b.num_rows:
                continue
            k, s, d, p = (b.column(i).to_numpy() for i in range(4))
            new_key = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            new = new_key | np.concatenate([[stretch is None or s[0] != stretch], s[1:] != s[:-1]])
            copy = (p & 1) == 1
            removed = ~new | copy
            other = new & ~new_key & ~copy  # a key's second stretch or a later one
            at = np.flatnonzero(other)
            heads = np.flatnonzero(new_key)
            head = heads[np.maximum(np.searchsorted(heads, at, "right") - 1, 0)] if len(heads) else np.zeros(len(at), np.int64)
            inside = at >= heads[0] if len(heads) else np.zeros(len(at), bool)
            told = [d[removed], d[at], d[np.unique(head[inside])] if len(at) else d[:0]]
            packs = [p[removed], p[at], p[np.unique(head[inside])] if len(at) else p[:0]]
            if len(at) and not inside.all() and waiting is not None:
                told.append(np.array([waiting[0]]))
                packs.append(np.array([waiting[1]]))
                waiting = None
            if len(heads):
                h = heads[-1]
                waiting = None if copy[h] or (len(at) and at[-1] > h) else (d[h], p[h])
            key, stretch = k[-1], s[-1]
            flags = np.concatenate([np.ones(len(told[0]), bool), np.zeros(sum(map(len, told[1:])), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(told)), pa.array(np.concatenate(packs)), pa.array(flags)], ["doc_id", "packed", "removed"])

    return rows.repartition("key").sortWithinPartitions("key", "stretch", "doc_id", "packed").mapInArrow(out, "doc_id long, packed long, removed boolean")


def runs(texts: DataFrame) -> DataFrame:
    """texts: (doc_id, text, open), open being packed anchors. Returns (core, doc_id, start, bytes): runs of at most PART starts, the
    bytes that their strings cover, and the hash of the bytes that all of them share."""

    def cut(batches):
        for b in sliced(batches):
            out: list[list] = [[], [], [], []]
            for i, t, packs in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data = t.encode()
                for pack in packs:
                    first = pack >> 24
                    last, place = first + (pack >> 16 & 0xFF), first + (pack >> 8 & 0xFF)
                    # runs are cut by the distance to the anchor, so that equal strings fall into equal runs
                    start = last
                    while start >= first:
                        nearest = (place - start) // PART * PART
                        low = max(first, place - nearest - PART + 1)
                        shared = data[place - nearest : place - nearest - PART + 1 + LENGTH]
                        body = data[low : start + LENGTH]
                        for column, x in zip(out, (int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=bytes([nearest])).digest(), "little", signed=True), i, low, body), strict=True):
                            column.append(x)
                        start = low - 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["core", "doc_id", "start", "body"])

    return texts.mapInArrow(cut, "core long, doc_id long, start long, body binary")


# the difference-cover suffix sort


def _ranks(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the tuples and their names: equal tuples have equal names, from 1."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) + 1
    return order, names


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions in the order of their suffixes. text: positive numbers."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # the sample: a difference cover of the residues modulo 3
    sample = np.concatenate([ones, twos])
    order, names = _ranks([t[sample], t[sample + 1], t[sample + 2]])
    if names.max() < len(sample):
        order = suffix_order(names)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.lexsort((rank[rest + 1], t[rest]))]
    # merge: for each remaining suffix, how many sampled ones come before it, by binary search
    low, high = np.zeros(len(rest), np.int64), np.full(len(rest), len(sorted_sample))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        s = sorted_sample[np.minimum(mid, len(sorted_sample) - 1)]
        one = s % 3 == 1
        less = np.where(
            one,
            (t[s] < t[rest]) | ((t[s] == t[rest]) & (rank[s + 1] < rank[rest + 1])),
            (t[s] < t[rest]) | ((t[s] == t[rest]) & ((t[s + 1] < t[rest + 1]) | ((t[s + 1] == t[rest + 1]) & (rank[s + 2] < rank[rest + 2])))),
        )
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    out = np.empty(len(rest) + len(sorted_sample), np.int64)
    at = low + np.arange(len(rest))
    taken = np.zeros(len(out), bool)
    taken[at] = True
    out[at], out[~taken] = rest, sorted_sample
    return out


def later(docs: np.ndarray, starts: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of all 100-byte strings in these runs that also start earlier in one of them."""
    # bytes become 2 to 257, and 1 ends a run, so no string of 100 crosses into the next
    sizes = np.array([len(x) for x in bodies])
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + 2
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text[begin + sizes] = 1
    order = suffix_order(text)
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)
    offset = np.arange(len(text)) - begin[owner]
    at = order[offset[order] + LENGTH <= sizes[owner[order]]]
    # adjacent prefixes
    same = np.zeros(len(at), bool)
    bytes_, step = (text - 2).astype(np.uint16), np.arange(LENGTH)
    for s in range(1, len(at), 50_000):
        e = min(len(at), s + 50_000)
        same[s:e] = (bytes_[at[s:e, None] + step] == bytes_[at[s - 1 : e - 1, None] + step]).all(1)
    group = np.cumsum(~same)
    d, p = docs[owner[at]], starts[owner[at]] + offset[at]
    by = np.lexsort((p, d, group))
    first = np.concatenate([[True], group[by][1:] != group[by][:-1]]) if len(by) else np.zeros(0, bool)
    return d[by][~first], p[by][~first]


def sorted_out(parts: DataFrame, most: int = 3_000_000) -> DataFrame:
    """parts: (core, doc_id, start, body), of cores that occur more than once. Returns (doc_id, packed) of removed runs of starts. Of runs
    with equal bytes all but the first are removed as they pass; a core with several different runs goes to the suffix sort."""

    def out(batches):
        gone: list[tuple[int, int]] = []  # removed runs of starts
        mine: list[tuple[int, int, bytes]] = []  # the different runs of the core at hand
        docs, starts, bodies, held, last = [], [], [], 0, None

        def told(d, p):
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int64())], ["doc_id", "packed"])

        for b in batches:
            for core, d, s, body in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if core != last:
                    if len(mine) > 1:  # a core's runs stay together
                        for column, x in zip((docs, starts, bodies), zip(*mine, strict=True), strict=True):
                            column += x
                        held += sum(len(x[2]) + 1 for x in mine)
                    if held >= most:
                        found, places = later(np.array(docs), np.array(starts), bodies)
                        yield told(found, places << 24)
                        docs, starts, bodies, held = [], [], [], 0
                    mine, last = [], core
                if mine and mine[-1][2] == body:
                    gone.append((d, s << 24 | (len(body) - LENGTH) << 16))
                else:
                    mine.append((d, s, body))
            if gone:
                yield told(*zip(*gone, strict=True))
                gone = []
        if len(mine) > 1:
            for column, x in zip((docs, starts, bodies), zip(*mine, strict=True), strict=True):
                column += x
        if bodies:
            found, places = later(np.array(docs), np.array(starts), bodies)
            yield told(found, places << 24)

    return parts.repartition("core").sortWithinPartitions("core", "body", "doc_id", "start").mapInArrow(out, "doc_id long, packed long")


def spans(packs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed byte ranges from packed runs of starts."""
    packs = np.sort(packs)
    low, high = packs >> 24, (packs >> 24) + (packs >> 16 & 0xFF) + LENGTH
    reach = np.maximum.accumulate(high)
    new = np.concatenate([[0], np.flatnonzero(low[1:] > reach[:-1]) + 1])
    return list(zip(low[new].tolist(), reach[np.concatenate([new[1:], [len(low)]]) - 1].tolist(), strict=True))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Returns per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the remaining bytes."""
    whole, names = renumbered(docs, id_col, text_col)
    out = _dedup(whole, keep_text)
    if names is None:
        return out
    told = materialize(out.join(names, "doc_id").drop("doc_id"), "told")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("sha"))
    return rows.join(told, ["id", "sha"]).select(F.col("id").alias("doc_id"), *out.columns[1:])


def _dedup(whole: DataFrame, keep_text: bool) -> DataFrame:
    found = materialize(decided(dealt(whole)), "anchors")
    open_ = found.where("not removed").groupBy("doc_id").agg(F.collect_list("packed").alias("open"))
    parts = materialize(runs(whole.join(open_.hint("merge"), "doc_id").select("doc_id", "text", "open")), "runs")
    common = parts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    more = materialize(sorted_out(parts.join(common.hint("merge"), "core").select("core", "doc_id", "start", "body")), "sorted")
    gone = found.where("removed").select("doc_id", "packed").unionByName(more).groupBy("doc_id").agg(F.collect_list("packed").alias("gone"))

    def kept(batches):
        for b in sliced(batches):
            rows = []
            for i, t, packs in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data = t.encode()
                cut = spans(np.array(packs, np.int64)) if packs else []
                ends = [0, *(x for span in cut for x in span), len(data)]
                left = b"".join([data[a:z] for a, z in zip(ends[::2], ends[1::2], strict=True)])
                rows.append((i, len(data), len(data) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return whole.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(kept, schema)
