"""Media columns for GIF: LZW code streams, palettes, disposal and transparency rules, timed frames with colour histograms.

``decode`` reads any GIF87a or GIF89a of the specification: global and local palettes, interlacing, all four disposal methods, transparent
indices, deferred clear codes. ``encode`` writes frames of 8-bit samples under a grey palette, so a sample is its own colour.

Defined results: a null text is stored as 64 zero bytes, like an empty one; equal texts give equal bytes and features; a stored form that
breaks off or isn't a GIF raises ValueError with the place; texts of any length are stored whole, in several frames; repeated rows each get their result; an
empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import sliced

WIDTH, ROWS = 64, 1024
DELAY = 10
_GREY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


def _widths(first: int, n: int) -> np.ndarray:
    """Bits of the codes after a clear code: as many as the next free code's number needs, 12 at most."""
    nexts = first + np.arange(n)
    return np.minimum(12, np.ceil(np.log2(nexts)).astype(np.int64))


_WRITE = _widths(258, 4096)


def lzw_encode(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples, with a clear code first and whenever the table is full."""
    codes = [256]
    if data:
        table: dict[int, int] = {}
        new, seen, current = codes.append, table.get, data[0]
        free = 258
        for b in data[1:]:
            key = current << 8 | b
            code = seen(key)
            if code:
                current = code
                continue
            new(current)
            current = b
            table[key] = free
            free += 1
            if free == 4096:
                new(256)
                table.clear()
                free = 258
        new(current)
    new = np.array([*codes, 257], dtype=np.uint16)
    at = np.arange(len(new))
    cleared = np.flatnonzero(new == 256)
    before = cleared[np.maximum(np.searchsorted(cleared, at) - 1, 0)]  # the last clear code before each
    widths = np.where(at == 0, 9, _WRITE[np.maximum(at - before - 1, 0)])
    bits = (new[:, None] >> np.arange(12, dtype=np.uint16)).astype(np.uint8) & 1
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """The samples of a code stream with that minimum code size; ``most``: samples that the frame has."""
    clear, first = 1 << least, (1 << least) + 2
    widths = _widths(first, 4096 + 8)
    ends = np.concatenate([[0], np.cumsum(widths)])
    data = np.frombuffer(stream + b"\0" * 4, np.uint8).astype(np.uint32)
    bit, total, out = 0, len(stream) * 8, bytearray()
    carried = 0  # codes since the last clear, where a full table is kept on
    starts: list[int] = []
    while len(out) < most:
        if carried:
            n = min(4096, (total - bit) // 12)
            at, wide = bit + 12 * np.arange(n), np.full(n, 12)
        else:
            n = int(np.searchsorted(ends, total - bit, "right")) - 1
            n = max(0, min(n, len(widths)))
            at, wide = bit + ends[:n], widths[:n]
        if n == 0:
            raise ValueError(f"GIF: the code stream ends at {len(out)} of {most} samples")
        byte = at >> 3
        word = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
        codes = word >> (at & 7).astype(np.uint32) & ((1 << wide) - 1).astype(np.uint32)
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(special[0]) if len(special) else n
        if not carried:
            starts = []
        pos, begin, put = len(out), starts.append, out.append
        try:
            for c in codes[:stop].tolist():
                begin(pos)  # starts past a full table are never asked for
                if c < clear:
                    put(c)
                    pos += 1
                    continue
                c -= first  # the code stands for what the code of that number gave, and one sample more
                s, e = starts[c], starts[c + 1] + 1
                out += out[s:e]
                if e > pos:
                    put(out[s])
                pos += e - s
        except IndexError:
            raise ValueError(f"GIF: the code at sample {pos} isn't in the table") from None
        if stop < n:
            if codes[stop] == clear + 1:
                break
            bit, carried = int(at[stop]) + int(wide[stop]), 0
        else:
            bit, carried = int(at[-1]) + int(wide[-1]), 1
    if len(out) < most:
        raise ValueError(f"GIF: {len(out)} of {most} samples before the end code")
    return bytes(out[:most])


@dataclass
class Frame:
    start_cs: int
    delay_cs: int
    box: tuple[int, int, int, int]
    canvas: np.ndarray  # height x width x RGBA, as it is shown


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError(f"GIF: breaks off at byte {at}")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, size: int) -> np.ndarray:
    out = np.zeros((256, 4), np.uint8)
    out[:size, :3] = np.frombuffer(data, np.uint8, size * 3, at).reshape(size, 3)
    out[:, 3] = 255
    return out


def decode(data: bytes) -> Gif:
    """All frames as they are shown, one after another."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("GIF: no header")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, common = 13, None
    if flags & 0x80:
        size = 2 << (flags & 7)
        common = _palette(data, at, size)
        at += 3 * size
    out, canvas, clock = Gif(width, height), np.zeros((height, width, 4), np.uint8), 0
    disposal, delay, hidden = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                hidden = body[3] if body[0] & 1 else None
            at = after
            continue
        if data[at] != 0x2C:
            raise ValueError(f"GIF: unknown block at byte {at}")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = common
        if flags & 0x80:
            size = 2 << (flags & 7)
            palette = _palette(data, at, size)
            at += 3 * size
        if palette is None:
            raise ValueError("GIF: a frame without a palette")
        least = data[at]
        stream, at = _blocks(data, at + 1)
        index = np.frombuffer(lzw_decode(stream, least, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            plain = np.empty_like(index)
            plain[order] = index
            index = plain
        kept = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        colours = palette[index][: part.shape[0], : part.shape[1]]
        if hidden is None:
            part[...] = colours
        else:
            shown = index[: part.shape[0], : part.shape[1]] != hidden
            part[shown] = colours[shown]
        out.frames.append(Frame(clock, delay, (left, top, w, h), canvas.copy()))
        clock += delay
        if disposal == 2:
            part[...] = 0
        elif kept is not None:
            canvas = kept
        disposal, delay, hidden = 0, 0, None
    return out


def encode(payload: bytes) -> bytes:
    """A GIF89a whose frames hold the payload, a positive multiple of 64 bytes, as grey samples in rows of 64."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        stream = lzw_encode(part)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0, 8))
        out += [bytes([len(b)]) + b for b in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        out.append(b"\0")
    return b"".join([*out, b";"])


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % 64 or (64 if not data else 0))


def samples(gif: Gif) -> list[np.ndarray]:
    """The shown red values inside each frame's box: the samples, under a grey palette."""
    return [f.canvas[f.box[1] : f.box[1] + f.box[3], f.box[0] : f.box[0] + f.box[2], 0] for f in gif.frames]


def histogram(frame: Frame, bins: int = 8) -> list[int]:
    """How many shown pixels of a frame's box have each of ``bins`` levels of red, then green, then blue."""
    left, top, w, h = frame.box
    shown = frame.canvas[top : top + h, left : left + w].reshape(-1, 4)
    shown = shown[shown[:, 3] > 0]
    out: list[int] = []
    for c in range(3):
        levels = np.bincount(shown[:, c], minlength=256)
        out += levels.reshape(bins, 256 // bins).sum(1).tolist()
    return out


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: id, frame, start_cs, delay_cs, width, height, histogram (8 levels each of red, green, blue), pixels (RGBA)."""

    def timed(batches):
        for b in sliced(batches):
            rows = []
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, f in enumerate(decode(data).frames if data is not None else []):
                    rows.append((i, k, f.start_cs, f.delay_cs, f.box[2], f.box[3], histogram(f), f.canvas.tobytes()))
                    if len(rows) == 64:
                        yield batch(rows)
                        rows = []
            yield batch(rows)

    types = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.binary()]
    names = ["doc_id", "frame", "start_cs", "delay_cs", "width", "height", "histogram", "pixels"]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
    return media.select(F.col(id_col).cast("long"), media_col).mapInArrow(timed, "doc_id long, frame long, start_cs long, delay_cs long, width long, height long, histogram array<long>, pixels binary")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, padded with zeros to a positive multiple of 64, as a GIF."""

    def stored(batches):
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            media = [encode(payload_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Read the stored GIFs back and digest them."""

    def read(batches):
        for b in sliced(batches):
            rows = []
            for i, n, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                gif = decode(data)
                payload = b"".join([s.tobytes() for s in samples(gif)])
                bars = np.sum([histogram(f) for f in gif.frames], axis=0)[:8]
                said = f"frames={len(gif.frames)};shown_cs={sum(f.delay_cs for f in gif.frames)};grey=" + "-".join(map(str, bars.tolist()))
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), said))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return media.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
