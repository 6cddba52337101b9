import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest_llm import by_id
from tokenizers import Tokenizer

from quern.llm import bpe, packing

TOKENIZER = Tokenizer.from_file(bpe.vocabulary_path())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_chunks_agree_with_the_library():
    rng = random.Random(1)
    signs = "aB éÉ'.\n\t <|endoftext|>s12ßΣ́ $#"
    chunks = bpe.Chunks(bpe.Words(bpe.vocabulary_path(), most=50), most=3000)
    for k in range(300):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 300))) * rng.choice([1, 1, 30])
        ids, decoded = chunks.encode(text)
        want = ids_of(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == TOKENIZER.decode(want, skip_special_tokens=False)
        assert chunks.words.ids(text) == ids


def test_shared_passages_share_chunks():
    passage = " ".join(f"word{i}" for i in range(3000))
    a, b = ("start " + passage).encode(), ("another beginning\n" + passage + " end").encode()
    pieces = [{data[s:e] for s, e in zip([0, *bpe.cuts(data)], bpe.cuts(data), strict=False)} for data in (a, b)]
    assert len(pieces[0] & pieces[1]) > 0.8 * len(pieces[0])
    chunks = bpe.Chunks(bpe.Words(bpe.vocabulary_path()))
    chunks.encode(a.decode())
    before = chunks.encoded
    chunks.encode(b.decode())
    assert chunks.encoded - before < 0.3 * before


def test_encode(docs, texts, empty):
    got = by_id(bpe.encode(docs, keep_ids=True), "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    for i, t in texts.items():
        ids = ids_of(t)
        said = TOKENIZER.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), ids, said)
    assert bpe.encode(empty).count() == 0


def test_pack(docs, texts, empty):
    capacity = 256
    rows = packing.pack(docs, capacity=capacity).collect()
    used = {}
    for i, t in texts.items():
        ids = [*ids_of(t), 2]
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            at += r["length"]
        assert at == len(ids)
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(used) == list(range(len(used)))
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_shortest_pack_first(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(0, 40))}
    patterns = packing.shortest_pack_first(histogram, 64)
    seen = {}
    for count, lengths in patterns:
        assert sum(a * b for a, b in lengths) <= 64
        for length, times in lengths:
            seen[length] = seen.get(length, 0) + count * times
    assert seen == histogram
    ranks = {}
    for length, first, n, _, _ in packing.slots(patterns):
        ranks.setdefault(length, []).extend(range(first, first + n))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}


def test_little_padding():
    rng = random.Random(7)
    lengths = [min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    packs = sum(c for c, _ in packing.shortest_pack_first(histogram, 4096))
    assert sum(lengths) / (packs * 4096) > 0.99


def test_encodings_over_several_tasks(spark):
    """Documents that share passages: how often chunks are encoded in all tasks together, against how many different ones there are."""
    rng = random.Random(8)
    shared = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 999)) for _ in range(600)) for _ in range(8)]
    rows = [(i, shared[i % 8] + f" end {i % 3}") for i in range(160)]
    encoded, reached = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    dealt = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bins = dealt.rdd.map(lambda r: (bpe._bin(r["text"]), r["text"])).groupByKey(4)

    def count(parts):
        chunks = bpe.Chunks(bpe.Words(bpe.vocabulary_path()))
        for _, texts in parts:
            for t in texts:
                chunks.encode(t)
                reached.add(len(bpe.cuts(t.encode())))
        encoded.add(chunks.encoded)

    bins.foreachPartition(count)
    different = {t.encode()[s:e] for _, t in rows for s, e in zip([0, *bpe.cuts(t.encode())], bpe.cuts(t.encode()), strict=False)}
    assert len(different) <= encoded.value <= 1.5 * len(different) < 0.2 * reached.value
