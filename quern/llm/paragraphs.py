"""Substring deduplication by paragraphs: MinHash banding, exact Jaccard checks, removal by connected components.

Lines are compared with lines, and paragraphs, which are the lines between two blank ones as one text, with paragraphs, so that line breaks
within them don't matter. Words are lower-cased and split at white space; lines and paragraphs of LEAST words (one shingle) or more count. Equal ones, by a
digest of 128 bits, form one class at once; classes are banded by 64 minima over shingles of five words, 16 bands of 4, which finds a pair of similarity
0.8 with a probability of 0.9997. Classes that collide in a band are compared by the exact Jaccard similarity of their shingle sets (those of paragraphs
count repeats), links of 0.8 or more are closed to components, and of each component the first member (by document, then by place) stays. Paragraphs
are decided first; components of paragraphs of a single line each are left to the lines. Of a component of lines the first one outside
removed paragraphs stays, if there is one.

A passage may also hide inside longer paragraphs. So of each text, without regard to lines, the least hash of SEED words among any RUN - SEED + 1 in a row
is a seed: equal passages of RUN words or more share one. Around seeds that repeat every window of RUN words is compared, by a 128-bit digest
of its words; windows don't touch lines that are removed already. The first of equal windows stays, and the words
of the others are removed, so a passage reaches exactly as far as its copies agree.

Defined results: null and empty texts have no paragraph; shorter lines are removed only with their paragraph; texts of any length count whole; repeats inside
one document count like those across documents; ties go to the smaller doc_id, then the earlier place; rows of one id with different texts are documents
of their own, in the order of their digests; rows that occur twice are one document; an empty table gives an empty result; columns other than the id and the
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import components, drop_shuffles, join_skewed, materialize, release, renumbered, sliced

LEAST = 5
#: Words of a seed, and of a passage at least (a power of two).
SEED, RUN = 6, 16
SHINGLE, BANDS, ROWS, SIMILAR = 5, 16, 4, 0.8
U = np.uint64
_RNG = np.random.default_rng(9)


def _odd(*shape: int) -> np.ndarray:
    return _RNG.integers(1, 1 << 63, shape, dtype=U) * U(2) + U(1)


_FACTORS, _TURNS = _odd(SHINGLE), _odd(BANDS * ROWS)
#: For a seed's hash, and the two halves of a window's digest.
_FOR_SEEDS, _FOR_WINDOWS = _odd(SEED), _odd(2, RUN.bit_length() - 1)
#: What a character stands for, and the bases of the digests of words, and of lines and paragraphs.
_CHARACTERS, _SPREAD, _BASE, _HALVES = _odd(0x3001), U(0x9E3779B97F4A7C15), int(_odd(1)[0]), [int(x) for x in _odd(2)]
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * _SPREAD
    return h ^ (h >> U(29))


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers from 0 to n - 1, modulo 2^64."""
    if len(_tables.get(base, ())) < n:
        _tables[base] = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 256) * 2, base, U)]), dtype=U)
    return _tables[base]


def _rolled(values: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """One polynomial in base for each of the parts, one after another, that have those sizes (none is empty)."""
    if not len(sizes):
        return np.zeros(0, U)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(values)) - np.repeat(first, sizes)
    return np.add.reduceat(values * _powers(base, int(sizes.max()))[place], first)


def _characters(text: str) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return c, _SPACE[np.minimum(c, 0x3001)]


@dataclass
class Read:
    """The words of several texts, one after another. at, stop: a word's offsets among all characters; hashes: of its lower-case form; doc, line: which
    text and which line (counted through all texts) it is in. begin: where each text begins; first_line: its first line; breaks: where each line ends."""

    at: np.ndarray
    stop: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    begin: np.ndarray
    first_line: np.ndarray
    breaks: np.ndarray

    def line_start(self, lines: np.ndarray) -> np.ndarray:
        return np.where(lines > 0, self.breaks[np.maximum(lines, 1) - 1] + 1, 0)


def read(texts: list[str]) -> Read:
    joined = "\n".join(texts)
    c, blank = _characters(joined)
    begin = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])

    def ends(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
        return edge[::2], edge[1::2]

    at, stop = ends(blank)
    lower = joined.lower()
    low, low_blank = _characters(lower) if len(lower) != len(joined) or not lower.isascii() else (np.frombuffer(lower.encode(), np.uint8), blank)
    sizes = stop - at if len(low) == len(c) else np.subtract(*ends(low_blank)[::-1])
    kept = low[~low_blank]
    values = _CHARACTERS[kept] if low.dtype == np.uint8 else np.where(kept < 0x3001, _CHARACTERS[np.minimum(kept, 0x3000)], _mix(kept * _SPREAD))
    breaks = np.append(np.flatnonzero(c == 10), len(c))
    return Read(at, stop, _mix(_rolled(values, sizes, _BASE)), np.searchsorted(begin, at, "right") - 1, np.searchsorted(breaks, at), begin, np.searchsorted(breaks, begin), breaks)


def _grams(w: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hash of each so many words in a row as there are factors."""
    n = len(factors)
    if len(w) < n:
        return np.zeros(0, U)
    w = _mix(w + factors[0])
    return _mix(sum((w[k : len(w) - n + 1 + k] * factors[k] for k in range(1, n)), w[: len(w) - n + 1] * factors[0]))


def _windows(w: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hash of each 2^n words in a row, where there are n factors."""
    h, size = _mix(w + factors[0]), 1
    for f in factors:
        h = h[:-size] * f + h[size:]
        size *= 2
    return _mix(h)


def _shingles(r: Read) -> np.ndarray:
    h, n = r.hashes, len(r.hashes) - SHINGLE + 1
    return _mix(sum((h[j : n + j] * _FACTORS[j] for j in range(1, SHINGLE)), h[:n] * _FACTORS[0])) if n > 0 else np.zeros(0, U)


@dataclass
class Units:
    """Lines or paragraphs: the first word, the number of words, the first and the last line."""

    first: np.ndarray
    size: np.ndarray
    line: np.ndarray
    last: np.ndarray


def units(r: Read) -> tuple[Units, Units, np.ndarray]:
    """(lines that have words, paragraphs, the paragraph of each word)."""
    w = len(r.at)
    first = np.flatnonzero(np.diff(r.line, prepend=-1)) if w else np.zeros(0, np.int64)
    size = np.diff(np.append(first, w))
    line = r.line[first]
    lines = Units(first, size, line, line)
    new = np.append(True, (np.diff(line) > 1) | (np.diff(r.doc[first]) > 0))[: len(first)]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(first)) - 1
    whole = Units(first[head], np.diff(np.append(first[head], w)), line[head], line[tail] if len(head) else line[:0])
    return lines, whole, np.repeat(np.arange(len(head)), whole.size)


def band_keys(r: Read, paragraph: np.ndarray, n_lines: int, n_paragraphs: int, line_of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys of each line and of each paragraph that have a shingle; equal in a band only if four minima agree, else zeros."""
    of_lines, of_paragraphs = np.zeros((n_lines, BANDS), U), np.zeros((n_paragraphs, BANDS), U)
    at = np.flatnonzero(paragraph[: len(paragraph) - SHINGLE + 1] == paragraph[SHINGLE - 1 :]) if len(paragraph) >= SHINGLE else np.zeros(0, np.int64)
    if not len(at):
        return of_lines, of_paragraphs
    hashes = _shingles(r)[at]
    within = r.line[at] == r.line[at + SHINGLE - 1]  # a line's own shingles; the others cross lines
    mine = paragraph[at]
    cuts = np.append(0, np.flatnonzero((np.diff(mine) > 0) | np.diff(within)) + 1)
    wholes = np.append(0, np.flatnonzero(np.diff(mine[cuts])) + 1)
    own = within[cuts]
    line_at, paragraph_at = line_of_word[at[cuts[own]]], mine[cuts[wholes]]
    for band in range(BANDS):
        of_line, of_whole = np.zeros(int(own.sum()), U), np.zeros(len(wholes), U)
        for turn in _TURNS[band * ROWS : (band + 1) * ROWS]:
            least = np.minimum.reduceat(hashes * turn, cuts)
            of_line = _mix(of_line + least[own])
            of_whole = _mix(of_whole + np.minimum.reduceat(least, wholes))
        of_lines[line_at, band] = _mix(of_line + U(2 * band + 1))
        of_paragraphs[paragraph_at, band] = _mix(of_whole + U(2 * band + 2))
    return of_lines, of_paragraphs


def _binaries(columns: list[np.ndarray]) -> pa.Array:
    """16 bytes for each row, from two halves."""
    data = np.ascontiguousarray(np.stack(columns, 1))
    return pa.Array.from_buffers(pa.binary(16), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def _classes(r: Read, u: Units, level: int) -> list[np.ndarray]:
    """Two halves of a digest of each unit's words; those of lines and of paragraphs differ."""
    return [_mix(_rolled(_mix(r.hashes + U(base & 0xFFFF)), u.size, base) + U(level)) for base in _HALVES]


def occurrences(docs: DataFrame, least: int, most: int = 300_000) -> DataFrame:
    """docs: (doc_id, text). (doc_id, line, lines, start, length, n_words, level, class, bands): every line (level 0) and paragraph (1), its words' digest and its band keys.
    What a task has seen of late, up to ``most`` digests, comes without band keys, so the most common line gives its keys once for each task."""

    def found(batches):
        seen: set[bytes] = set()
        for b in sliced(batches, 500):
            ids, r = b.column(0).to_numpy(), read(b.column(1).to_pylist())
            lines, whole, paragraph = units(r)
            line_of_word = np.repeat(np.arange(len(lines.first)), lines.size)
            keys = band_keys(r, paragraph, len(lines.first), len(whole.first), line_of_word)
            for level, u in enumerate((lines, whole)):
                chosen = np.flatnonzero(u.size >= least)
                if not len(chosen):
                    continue
                doc, start = r.doc[u.first[chosen]], r.line_start(u.line[chosen])
                columns = [ids[doc], u.line[chosen] - r.first_line[doc], u.last[chosen] - u.line[chosen] + 1, start - r.begin[doc], r.breaks[u.last[chosen]] - start, u.size[chosen], np.full(len(chosen), level)]
                k = keys[level][chosen].view(np.int64)
                # sets of up to three shingles are similar only if they are equal, and then agree in every band
                sizes = np.where(u.size[chosen] - SHINGLE + 1 <= 3, 1, BANDS)
                digests = _binaries([x[chosen] for x in _classes(r, u, level)])
                if len(seen) > most:
                    seen.clear()
                for i, d in enumerate(digests.to_pylist()):
                    if d in seen:
                        sizes[i] = 0
                    seen.add(d)
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(k[np.arange(BANDS) < sizes[:, None]]))
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), digests, bands], ["doc_id", "line", "lines", "start", "length", "n_words", "level", "class", "bands"])

    return docs.mapInArrow(found, "doc_id long, line long, lines long, start long, length long, n_words long, level long, class binary, bands array<long>")


def numbered(hashes: np.ndarray) -> np.ndarray:
    """A set in which the second of equal hashes differs from the first, and so on."""
    x = np.sort(hashes)
    new = np.concatenate([[True], x[1:] != x[:-1]])
    again = np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.unique(np.where(again > 0, _mix(x + again.astype(U) * _FACTORS[2]), x))


def linked(ids: np.ndarray, sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple]:
    """Edges that join what is linked in a bucket: a search that compares each reached set with those not yet reached."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(ids[0], ids[1])] if shared >= similar * (sizes.sum() - shared) - 1e-9 else []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left, edges = np.ones(len(sets), bool), []
    while left.any():
        root = int(np.argmax(left))
        left[root], todo = False, [root]
        while todo and left.any():
            i = todo.pop()
            keep = left[owner]
            flat, owner = flat[keep], owner[keep]
            shared = np.bincount(owner[np.isin(flat, sets[i])], minlength=len(sets))
            new = np.flatnonzero(left & (shared >= similar * (sizes + sizes[i] - shared) - 1e-9))
            left[new] = False
            edges += [(ids[i], ids[j]) for j in new]
            todo += new.tolist()
    return edges


#: What travels to find keys that come with different others: band keys with short names of classes, seeds and windows with their places.
_BANDED = np.dtype([("key", "u8"), ("other", "i8"), ("counts", "u1"), ("mark", "u1")])
_SOWN = np.dtype([("key", "u8"), ("doc_id", "i8"), ("line", "i4"), ("at", "i4"), ("mark", "u1")])
_WINDOWED = np.dtype([("key", "u8"), ("half", "u8"), ("doc_id", "i8"), ("at", "i4"), ("mark", "u1")])
#: Rows that a task gathers before it sends them, and rows that a bucket holds on average.
FLUSH, BUCKET = 500_000, 1 << 17


def _many(key: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by key, and in it which rows are the first of their key, and which have a key that comes with different others (or, without others, twice)."""
    order = np.argsort(key)
    k = key[order]
    first = np.append(True, k[1:] != k[:-1])[: len(k)]
    head = np.flatnonzero(first)
    size = np.diff(np.append(head, len(k)))
    many = size > 1
    if other is not None and many.any():
        o = other[order]
        many = np.minimum.reduceat(o, head) != np.maximum.reduceat(o, head)
    return order, first, np.repeat(many, size)


def sent(rows: np.ndarray, n: int) -> pa.RecordBatch:
    """rows in n buckets by their keys, packed. Of a key that comes with different others already here, only the first row goes to its bucket, marked 1; the
    others, marked 2, are spread over all buckets, so that a hot key sends its bucket one row for each call and no more."""
    order, first, many = _many(rows["key"], rows["other"] if "other" in rows.dtype.names else None)
    if "counts" in rows.dtype.names:  # a key counts if one of its rows does
        head = np.flatnonzero(first)
        rows["counts"][order] = np.repeat(np.maximum.reduceat(rows["counts"][order], head), np.diff(np.append(head, len(rows))))
    mark = np.empty(len(rows), np.uint8)
    mark[order] = np.where(many, 2 - first, np.where(first, 0, 3))
    rows["mark"] = mark
    rows = rows[mark < 3]  # 3: the same key and other once more
    spread = rows["other"] if "other" in rows.dtype.names else rows["doc_id"] + rows["at"].astype(np.int64)
    route = np.where(rows["mark"] == 2, _mix((rows["key"] ^ spread.astype(U)) * _SPREAD), rows["key"])
    bucket = (route >> U(32)) * U(n) >> U(32)
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")  # rows of a bucket stay in the order of texts
    rows, bucket = rows[order], bucket[order].astype(np.int64)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    offsets = (np.append(cut, len(rows)) * rows.dtype.itemsize).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])], ["bucket", "rows"])


def gathered(parts: Iterable[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """All rows in calls of ``sent`` for FLUSH rows each or little more."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= FLUSH:
            yield sent(np.concatenate(held), n)
            held, size = [], 0
    if size:
        yield sent(np.concatenate(held), n)


def shared(packed: DataFrame, dtype: np.dtype, schema: str) -> DataFrame:
    """packed: (bucket, rows). The rows whose key comes with different others anywhere, some of them repeatedly."""
    names = [x for x in dtype.names if x not in ("mark", "half")]

    def column(out: np.ndarray, name: str) -> pa.Array:
        if name == "key" and "half" in dtype.names:
            return _binaries([out["key"], out["half"]])
        return pa.array(out[name].astype(bool if name == "counts" else np.int64))

    def told(blocks: list[bytes]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(blocks), dtype)
        own = rows[rows["mark"] < 2]
        order, _, many = _many(own["key"], own["other"] if "other" in names else None)
        known = np.isin(own["key"], own["key"][own["mark"] == 1])
        known[order] |= many
        out = np.concatenate([own[known], rows[rows["mark"] == 2]])
        return pa.RecordBatch.from_arrays([column(out, x) for x in names], schema.replace(",", "").split()[::2])

    def found(batches):
        blocks, last = [], None
        for b in batches:
            for bucket, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != last and blocks:
                    yield told(blocks)
                    blocks = []
                last = bucket
                blocks.append(block)
        if blocks:
            yield told(blocks)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(found, schema)


def links(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, text); rows: the occurrences. Returns edges (a, b) between classes, and the rows, as a new table, without their bands."""
    # candidates travel under a short name of their class: if two classes share one, more is compared, and nothing is lost
    short = F.xxhash64("class").alias("short")
    banded = rows.where(F.size("bands") > 0).select(short, ((F.col("level") == 0) | (F.col("lines") > 1)).alias("counts"), "bands")
    n = rows.count() * BANDS // BUCKET + 1

    def keyed(batches):
        for b in batches:
            keys, row = _lists(b.column(2))
            out = np.empty(len(keys), _BANDED)
            out["key"], out["other"], out["counts"] = keys.to_numpy(), b.column(0).to_numpy()[row], b.column(1).to_numpy(zero_copy_only=False)[row]
            yield out

    found = shared(banded.mapInArrow(lambda batches: gathered(keyed(batches), n), "bucket long, rows binary"), _BANDED, "key long, short long, counts boolean")
    colliding = materialize(found.groupBy("key", "short").agg(F.max("counts").alias("counts")), "colliding")
    lean = materialize(rows.withColumn("banded", F.size("bands") > 0).drop("bands"), "lean")
    release(rows)
    # of buckets with the same members one is compared
    same = [F.count("*"), F.min("short"), F.max("short"), F.bit_xor("short"), F.bit_xor(F.xxhash64("short")), F.sum(F.shiftright(F.xxhash64("short", F.lit(1)), 24))]
    alike = colliding.groupBy("key").agg(F.max("counts").alias("counts"), *[c.alias(f"same{k}") for k, c in enumerate(same)]).where("counts")
    once = alike.groupBy(*[f"same{k}" for k in range(len(same))]).agg(F.min("key").alias("key"))
    buckets = materialize(colliding.join(once.select("key"), "key").drop("counts"), "buckets")
    places = lean.where("banded").select(short, "class", F.struct("doc_id", "line", "level").alias("place")).join(buckets.select("short").distinct(), "short", "left_semi")
    wanted = places.groupBy("class").agg(F.min("place").alias("place")).groupBy("place.doc_id").agg(F.collect_list(F.struct("place.line", "place.level", "class")).alias("wanted"))
    texts = docs.join(wanted.hint("merge"), "doc_id").select("text", "wanted")

    def sets_of(batches):
        for b in sliced(batches, 500):
            r = read(b.column(0).to_pylist())
            lines, whole, paragraph = units(r)
            grams = _shingles(r)
            entries = b.column(1).flatten()
            doc = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            line, level = (entries.field(k).to_numpy() for k in (0, 1))
            at = r.first_line[doc] + line
            sets = []
            for one, lev in zip(at.tolist(), level.tolist(), strict=True):
                u = whole if lev else lines
                k = int(np.searchsorted(u.line, one))
                mine = grams[u.first[k] : u.first[k] + u.size[k] - SHINGLE + 1]
                sets.append((numbered(mine) if lev else np.unique(mine)).tobytes())
            yield pa.RecordBatch.from_arrays([entries.field(2), pa.array(sets, pa.binary())], ["class", "grams"])

    grams = materialize(texts.mapInArrow(sets_of, "class binary, grams binary"), "grams")
    drop_shuffles(docs.sparkSession)
    dealt = buckets.join(grams.withColumn("short", short), "short").repartition("key").sortWithinPartitions("key", "class").select("key", "class", "grams")

    def edges(batches):
        held: list[tuple[bytes, bytes]] = []
        last = None

        def close(out: list) -> None:
            if len(held) > 1:
                names = [h[0] for h in held]
                out += [(names[i], names[j]) for i, j in linked(np.arange(len(held)), [np.frombuffer(h[1], U) for h in held])]

        def told(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.binary()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            out: list[tuple] = []
            for key, cls, grams in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if last != key:
                    close(out)
                    held, last = [], key
                held.append((cls, grams))
            if out:
                yield told(out)
        out = []
        close(out)
        if out:
            yield told(out)

    found = materialize(dealt.mapInArrow(edges, "a binary, b binary"), "links")
    release(colliding, buckets, grams)
    return found, lean


def seeds(r: Read) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the seeds, and their hashes: any RUN words in a row have one, which depends on these words alone."""
    h = _grams(r.hashes, _FOR_SEEDS)
    inside = r.doc[: len(r.doc) - RUN + 1] == r.doc[RUN - 1 :] if len(r.doc) >= RUN else np.zeros(0, bool)
    if not inside.any():
        return np.zeros(0, np.int64), h
    least = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)  # of equal hashes the first
    for step in (1, 2, 4):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: len(inside)], least[RUN - SEED + 1 - 8 : RUN - SEED + 1 - 8 + len(inside)])
    at = (least & U(0xFFFFFFFF)).astype(np.int64)[inside]  # ascending, as windows move on: equal ones are neighbours
    at = at[np.append(True, at[1:] != at[:-1])]
    return at, h[at]


def runs(at: np.ndarray, n: np.ndarray, first_doc: np.ndarray, name: np.ndarray, doc: int, words: int) -> list[tuple]:
    """(first word, stop, first document, size, removed): a text's repeated windows joined to passages that are removed or stay. name: the same for equal windows."""
    by = np.lexsort((at, name))
    new = np.append(True, np.diff(name[by]) != 0)
    first_at = np.empty_like(at)
    first_at[by] = at[by][new][np.cumsum(new) - 1]  # the earliest equal window of this text
    stays = (first_doc == doc) & (first_at == at)
    # a window that overlaps its own first copy takes only what lies behind that
    begin = np.where((first_doc == doc) & ~stays, np.maximum(at, first_at + RUN), at)
    state = np.zeros(words + 1, np.int8)
    for kind, mine in ((1, stays), (2, ~stays)):
        change = np.zeros(words + 1, np.int64)
        np.add.at(change, begin[mine], 1)
        np.add.at(change, at[mine] + RUN, -1)
        state[np.cumsum(change) > 0] = kind
    edges = np.flatnonzero(np.diff(np.concatenate([[0], state])))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if state[a]:
            mine = (stays if state[a] == 1 else ~stays) & (begin < b) & (at + RUN > a)
            out.append((a, b, int(first_doc[mine].min()), int(n[mine].max()), bool(state[a] == 2)))
    return out


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A list column's values, and the row that each is in."""
    return column.flatten(), np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())


def passages(docs: DataFrame, lines: DataFrame, words: int) -> DataFrame:
    """docs: (doc_id, text), of about so many words. Passages that repeat, outside the removed lines given as (doc_id, line), each once: same columns as ``duplicates``. Lines that stay
    take part, so the copy that stays is chosen over lines and passages together."""

    def sown(batches):
        for b in sliced(batches, 500):
            ids, r = b.column(0).to_numpy(), read(b.column(1).to_pylist())
            at, hashes = seeds(r)
            if len(at):
                doc, out = r.doc[at], np.empty(len(at), _SOWN)
                out["key"], out["doc_id"] = hashes, ids[doc]
                out["line"], out["at"] = r.line[at] - r.first_line[doc], at - np.searchsorted(r.doc, np.arange(b.num_rows))[doc]
                yield out

    def repeated(rows: DataFrame, total: int, name: str, *more) -> tuple[DataFrame, DataFrame]:
        classes = materialize(rows.groupBy("class").agg(F.count("*").alias("n"), *more).where("n > 1"), name)
        return join_skewed(rows, classes, "class", "n", total), classes

    n = words // (RUN - SEED) * 2 // BUCKET + 1
    found = shared(docs.mapInArrow(lambda batches: gathered(sown(batches), n), "bucket long, rows binary"), _SOWN, "class long, doc_id long, line long, at long")
    again = materialize(found.join(lines.select("doc_id", "line").hint("merge"), ["doc_id", "line"], "left_anti"), "repeated-seeds")
    drop_shuffles(docs.sparkSession)
    more, classes = repeated(again, again.count(), "free-classes")
    wanted = more.groupBy("doc_id").agg(F.collect_list("at").alias("wanted"))
    gone = lines.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    listed = materialize(wanted.join(gone.hint("merge"), "doc_id", "left"), "wanted")
    release(again, classes)
    around = docs.join(listed.hint("merge"), "doc_id").select("doc_id", "text", "wanted", "gone")

    def compared(batches):
        for b in sliced(batches, 500):
            ids, r = b.column(0).to_numpy(), read(b.column(1).to_pylist())
            n = len(r.doc) - RUN + 1
            if n <= 0:
                continue
            first = np.searchsorted(r.doc, np.arange(b.num_rows))
            (at, row), (line, of) = _lists(b.column(2)), _lists(b.column(3))
            at = at.to_numpy() + first[row]
            removed = np.isin(r.line, r.first_line[of] + line.to_numpy())
            change = np.zeros(len(r.doc) + 1, np.int64)
            np.add.at(change, np.maximum(at - (RUN - SEED), first[row]), 1)
            np.add.at(change, at + 1, -1)
            touched = np.concatenate([[0], np.cumsum(removed)])
            near = (np.cumsum(change)[:n] > 0) & (r.doc[:n] == r.doc[RUN - 1 :]) & (touched[RUN:] == touched[:-RUN])
            chosen = np.flatnonzero(near)
            if len(chosen):
                doc, out = r.doc[chosen], np.empty(len(chosen), _WINDOWED)
                out["key"], out["half"] = (_windows(r.hashes, f)[chosen] for f in _FOR_WINDOWS)
                out["doc_id"], out["at"] = ids[doc], chosen - first[doc]
                yield out

    n = words // BUCKET + 1
    found = shared(around.mapInArrow(lambda batches: gathered(compared(batches), n), "bucket long, rows binary"), _WINDOWED, "class binary, doc_id long, at long")
    near = materialize(found, "windows")
    drop_shuffles(docs.sparkSession)
    more, classes = repeated(near, near.count(), "window-classes", F.min("doc_id").alias("first_doc"))
    equal = more.select("doc_id", F.struct("at", "n", "first_doc", F.xxhash64("class").alias("name")).alias("x"))
    held = materialize(equal.groupBy("doc_id").agg(F.collect_list("x").alias("found")), "equal-windows")
    release(near, classes)

    def joined(batches):
        for b in sliced(batches, 500):
            ids, r = b.column(0).to_numpy(), read(b.column(1).to_pylist())
            first = np.append(np.searchsorted(r.doc, np.arange(b.num_rows)), len(r.doc))
            entries, row = _lists(b.column(2))
            at, n, first_doc, name = (entries.field(k).to_numpy() for k in range(4))
            edges = np.searchsorted(row, np.arange(b.num_rows + 1))
            out: list[list] = [[] for _ in range(8)]
            for i in np.flatnonzero(np.diff(edges)).tolist():
                s = slice(edges[i], edges[i + 1])
                w = int(first[i])
                for a, z, doc, size, removed in runs(at[s], n[s], first_doc[s], name[s], int(ids[i]), int(first[i + 1]) - w):
                    start = int(r.at[w + a])
                    for column, x in zip(out, (int(ids[i]), int(r.line[w + a] - r.first_line[i]), start - int(r.begin[i]), int(r.stop[w + z - 1]) - start, z - a, doc, size, removed), strict=True):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.bool_())], ["doc_id", "line", "start", "length", "n_words", "class_doc_id", "class_size", "removed"])

    told = docs.join(held.hint("merge"), "doc_id").select("doc_id", "text", "found").mapInArrow(joined, "doc_id long, line long, start long, length long, n_words long, class_doc_id long, class_size long, removed boolean")
    return told.select("doc_id", "line", "start", "length", "n_words", "class_doc_id", F.lit(None).cast("long").alias("class_line"), "class_size", "removed")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Every line and paragraph that has a duplicate, with its class: doc_id, line (the first one), start, length (code points), n_words, class_doc_id and
    class_line (those of the one that stays), class_size (members of the class), removed, and kind (line or paragraph). Then the passages that repeat inside other
    paragraphs, as kind passage: their class_doc_id is the first document that has a part of them, their class_line null. Last the column text_sha256: null, but
    the digest of the text where an id has several."""
    whole, names = renumbered(docs, id_col, text_col)
    found = _duplicates(whole, least)
    if names is None:
        return found.withColumn("text_sha256", F.lit(None).cast("string"))
    ours, others = names.select("doc_id", F.col("id").alias("own"), "sha"), names.select(F.col("doc_id").alias("class_doc_id"), F.col("id").alias("other"))
    out = found.join(ours, "doc_id").join(others, "class_doc_id")
    return out.select(*[{"doc_id": F.col("own").alias("doc_id"), "class_doc_id": F.col("other").alias("class_doc_id")}.get(c, F.col(c)) for c in found.columns], F.col("sha").alias("text_sha256"))


def _duplicates(docs: DataFrame, least: int) -> DataFrame:
    rows = materialize(occurrences(docs, least), "paragraphs")
    words = rows.where("level = 0").agg(F.sum("n_words")).first()[0] or 0
    edges, rows = links(docs, rows)
    joined = components(edges).withColumnRenamed("node", "class")
    classes = rows.groupBy("class").agg(F.count("*").alias("n"), F.max("level").alias("level"), F.max("lines").alias("lines"))
    named = materialize(classes.join(joined, "class", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "class")), "named")
    release(edges)
    group = named.groupBy("component").agg(F.sum("n").alias("class_size"), F.max(F.greatest("lines", 2 - F.col("level"))).alias("several")).where("several > 1")
    members = materialize(named.join(group, "component").select("class", "n", "component", "class_size"), "members")
    out = materialize(join_skewed(rows.drop("banded"), members, "class", "n", rows.count()).drop("class", "n"), "out")
    release(rows, named, members)
    place = F.struct("doc_id", "line")
    whole_ones = out.where("level = 1")
    stays = materialize(whole_ones.groupBy("component").agg(F.min(place).alias("stays"), F.count("*").alias("m")), "stays")
    whole_ones = join_skewed(whole_ones, stays, "component", "m", out.count())
    whole_ones = materialize(whole_ones.withColumn("removed", place != F.col("stays")).withColumn("kind", F.lit("paragraph")), "wholes")
    gone = whole_ones.where("removed").select("doc_id", F.explode(F.sequence("line", F.col("line") + F.col("lines") - 1)).alias("line"), F.lit(True).alias("gone"))
    # never a broadcast: the planner can't tell how many lines the paragraphs have
    single = materialize(out.where("level = 0").join(gone.hint("merge"), ["doc_id", "line"], "left").withColumn("gone", F.coalesce("gone", F.lit(False))), "single")
    firsts = single.groupBy("component").agg(F.coalesce(F.min(F.when(~F.col("gone"), place)), F.min(place)).alias("stays"), F.count("*").alias("m"))
    firsts = materialize(firsts, "stays")
    single_out = join_skewed(single, firsts, "component", "m", single.count())
    single_out = single_out.withColumn("removed", F.col("gone") | (place != F.col("stays"))).withColumn("kind", F.lit("line"))
    columns = ["doc_id", "line", "start", "length", "n_words", F.col("stays.doc_id").alias("class_doc_id"), F.col("stays.line").alias("class_line"), "class_size", "removed", "kind"]
    lines = materialize(single_out.select(*columns).unionByName(whole_ones.select(*columns)), "lines")
    taken = materialize(lines.where("removed and kind = 'line'").select("doc_id", "line").unionByName(gone.select("doc_id", "line")).distinct(), "taken")
    release(out, single, whole_ones, stays, firsts)
    return lines.unionByName(passages(docs, taken, words).withColumn("kind", F.lit("passage")))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its spans (start, stop), and without the lines that they leave blank."""
    joined: list[list[int]] = []
    for start, stop in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(stop, joined[-1][1])
        else:
            joined.append([start, stop])
    out, at, k = [], 0, 0
    for line in text.split("\n"):
        end, done, left, j = at + len(line), at, [], k
        while j < len(joined) and joined[j][0] < max(end, at + 1):
            left.append(text[done : max(done, joined[j][0])])
            done = min(joined[j][1], end)
            while done < end and text[done].isspace():
                done += 1
            j += 1
        rest = "".join(left) + text[done:end]
        if j == k or rest.strip():
            out.append(rest)
        at = end + 1
        while k < len(joined) and joined[k][1] <= at:
            k += 1
    return "\n".join(out)


def removed_text(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the texts without their removed lines, paragraphs and passages. Where an id has several texts, each loses its own."""
    gone = found.where("removed").groupBy("doc_id", "text_sha256").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("stop"))).alias("gone")).toDF("gone_id", "sha", "gone")
    own = F.col("sha").isNull() | (F.col("sha") == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(gone.hint("merge"), (F.col("doc_id") == F.col("gone_id")) & own, "left").select("doc_id", "text", "gone")

    def cut(batches):
        for b in sliced(batches, 500):
            texts = [without(t, [(x["start"], x["stop"]) for x in g]) if g and t is not None else t for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return whole.mapInArrow(cut, whole.select("doc_id", "text").schema)
