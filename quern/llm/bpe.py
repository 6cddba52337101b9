"""Encoding and decoding with a published word-level BPE vocabulary, exactly as the tokenizers library does.

The vocabulary (word_bpe_49k.json) drops white space, so nothing it does to a text reaches across a blank: the ids of a text
are those of its blank-separated words, one after another. ``Words`` keeps the encodings of words; ``Chunks`` cuts texts where a
rolling hash says so, encodes a chunk that documents near one another share once, and repairs the joins between chunks by encoding again
from the last blank before the cut to the first one after it: there the outcome must agree with the whole text's.

Defined results: a null text counts as empty; an empty text has no ids; a text of any length is encoded whole; special tokens
spelled out in a text become their ids, as in the library; repeated rows each get their result; an empty table gives an empty result; columns other than the
id and the text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm.common import sliced

VOCABULARY = "word_bpe_49k.json"

# The vocabulary's own splitting pattern, here for texts in lower case within Latin-1.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Words in which every character is its own NFC form and lowers by itself.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def _blanked(text: str) -> str:
    """With the blanks at which words are told apart as spaces; any rarer white space stays inside a word, where the library deals with it."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers. Remembers the words of late: at most twice ``most``."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.most, self.letters = self.tokenizer.model, most, _byte_letters()
        names = self.tokenizer.get_vocab()
        self.names = [b""] * (1 + max(names.values()))
        for name, i in names.items():
            self.names[i] = name.encode()
        self[""] = b""
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        out = self.older.get(word)
        if out is None:
            out = self._new(word)
        if len(word) <= 200:
            self[word] = out
        return out

    def _new(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        if low.isalpha():
            if low != word:
                return self[low]
            shown = low if low.isascii() else "".join([self.letters[b] for b in low.encode()])
            return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if low[-1] in ".," and low[:-1].isalpha():
            return self[low[:-1]] + self[low[-1]]
        found = _PIECES.findall(low)
        if len(found) > 1:
            return b"".join([self[p] for p in found])
        shown = low if low.isascii() else "".join([self.letters[b] for b in low.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, or of a part between blanks."""
        return b"".join(map(self.__getitem__, _blanked(text).split(" ")))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; this vocabulary has no decoder, so tokens are joined by blanks."""
        names = self.names
        return b" ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes, bits: int = 10) -> list[int]:
    """Where chunks of UTF-8 text end: where a hash of the last 16 bytes has ``bits`` leading zeros, never inside a character.
    The cuts around a passage depend on the passage alone, so documents that share it share its chunks."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 64:
        return [len(b)]
    h = _GEAR[b]
    for step in (1, 2, 4, 8):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    at = np.flatnonzero(h[15:-1] >> np.uint32(32 - bits) == 0) + 16
    at = at[b[at] & 0xC0 != 0x80]
    return [*at.tolist(), len(b)]


class Chunks(dict):
    """Chunk -> (text before its first blank, ids between, their text decoded, text after its last blank), or its text alone if it
    has no blank. Remembers at most ``most`` bytes of chunks."""

    def __init__(self, words: Words, most: int = 24_000_000):
        self.words, self.most, self.held, self.encoded = words, most, 0, 0

    def __missing__(self, chunk: bytes):
        self.encoded += 1
        head, blank, rest = _blanked(chunk.decode()).partition(" ")
        if not blank:
            out = (head,)
        else:
            inner, blank, tail = rest.rpartition(" ")
            ids = self.words.ids(inner)
            out = (head, ids, self.words.decode(ids), tail)
        if self.held >= self.most:
            self.clear()
            self.held = 0
        self.held += 5 * len(chunk) + 500
        self[chunk] = out
        return out

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a whole text, joined from its chunks, and the text they decode to in UTF-8."""
        data, parts, open_, start = text.encode(), [], "", 0
        for end in cuts(data):
            found = self[data[start:end]]
            start = end
            if len(found) == 1:
                open_ += found[0]
                continue
            # the join: what lies between the blanks on both sides of the cut is encoded anew
            mend = self.words[open_ + found[0]]
            parts += ((mend, self.words.decode(mend)), found[1:3])
            open_ = found[3]
        mend = self.words[open_]
        parts.append((mend, self.words.decode(mend)))
        return b"".join([i for i, _ in parts]), b" ".join([t for i, t in parts if i])


_chunks: dict[str, Chunks] = {}


def chunks_of(path: str) -> Chunks:
    """A worker's own store of words and chunks, which lasts from task to task."""
    if path not in _chunks:
        _chunks[path] = Chunks(Words(path))
    return _chunks[path]


def _bin(text: str) -> int:
    """A document's representative chunk, by the least checksum: similar documents mostly agree in it."""
    data, start, out = text.encode(), 0, 1 << 32
    for end in cuts(data):
        out = min(out, zlib.crc32(data[start:end]))
        start = end
    return out


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text. Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids and decoded.

    Documents are dealt out by their representative chunk (as in Extreme Binning; Bhagwat et al., 2009) and follow one another in its order, so documents
    that share chunks mostly meet in one task, which remembers the chunks of late (``Chunks``). A chunk that lies in documents of different tasks, or far
    apart in one, is encoded again there. Adaptive execution splits a bin that is too large.
    """
    path = path or vocabulary_path()

    def binned(batches):
        for b in sliced(batches, 500):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_bin(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "text", "bin"])

    def coded(batches):
        chunks = chunks_of(path)
        for b in sliced(batches, 500):
            rows = [chunks.encode(t) for t in b.column(1).to_pylist()]
            out = [b.column(0), pa.array([len(i) // 4 for i, _ in rows], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows]), pa.array([hashlib.sha256(t).hexdigest() for _, t in rows])]
            if keep_ids:
                out += [pa.array([np.frombuffer(i, "<u4").tolist() for i, _ in rows], pa.list_(pa.int64())), pa.array([t.decode() for _, t in rows])]
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = whole.mapInArrow(binned, "doc_id long, text string, bin long").hint("rebalance", "bin").sortWithinPartitions("bin").select("doc_id", "text")
    return dealt.mapInArrow(coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids)
