import hashlib
import random

import numpy as np
import xxhash
from conftest_llm import by_id, prose
from pyspark.sql import functions as F

from quern.llm import common, exact_dedup, fuse, paragraphs, simhash, suffixes


def closed(nodes, edges):
    """Components by brute force: node -> least node reachable."""
    out = {n: n for n in nodes}

    def find(n):
        while out[n] != n:
            n = out[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        out[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(500, 500), (39, 38)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == closed(nodes, [e for e in edges if e[0] != e[1]])


def test_skewed_join(spark):
    left = spark.range(6000).select((F.col("id") % 5000).alias("x"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("w"))
    assert common.join_skewed(left, right, "k", "w", 6000).groupBy("k").agg((F.max("w") == F.count("*")).alias("all")).where("not all").count() == 0
    assert common.join_skewed(left, right, "k", "w", 6000).count() == 6000


def test_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (1, 2, 10, 1000, 60_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        f = fuse.build(np.concatenate([keys, keys[:5]]))
        assert fuse.contains(f, keys).all()
        assert fuse.contains(f, rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).sum() < 20


def test_exact(docs, texts, empty):
    for share in (2, 1, 1000):  # half a snapshot, all of it, hardly any
        got = by_id(exact_dedup.dedup(docs, lambda i, share=share: i % share == 0), "keep_id", "group_size", "kept", "text_sha256")
        for i, t in texts.items():
            same = [j for j, u in texts.items() if (u or "") == (t or "")]
            assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256((t or "").encode()).hexdigest())
    assert exact_dedup.dedup(empty, lambda i: i % 2 == 0).count() == 0


def test_bytes_are_compared(spark, docs):
    pairs = spark.createDataFrame([(bytearray(b"1"), 14, 15), (bytearray(b"2"), 14, 16)], "sha binary, keep long, base_keep long")
    assert {bytes(r["sha"]): r["same"] for r in exact_dedup.same_bytes(pairs, docs).collect()} == {b"1": True, b"2": False}


def test_fingerprint_bit_by_bit():
    for t in ("", "One", "a b", "Ä B c d", "A b\x0bc　d e f " * 9):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t).replace("\t", " ").replace("\x0b", " ").split(" ") if w]
        s = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h) and h)


def test_simhash(docs, texts, empty):
    got = by_id(simhash.near_duplicates(docs), "fingerprint", "component_id")
    fp = {i: simhash.fingerprint(t or "") for i, t in texts.items()}
    want = closed(fp, [(i, j) for i in fp for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3])
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert got[14][1] == got[15][1] == 14
    assert simhash.near_duplicates(empty).count() == 0


def test_no_link_is_lost(spark):
    """Chains and dense groups, some larger than what a bucket compares at once."""
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(120):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
    for _ in range(900):
        fps.add(sum(1 << b for b in rng.sample(range(64), 2)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = common.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")))
    got = {r["node"]: r["component"] for r in found.collect()}
    a = np.array(signed)
    near = np.argwhere(np.bitwise_count(a.view(np.uint64)[:, None] ^ a.view(np.uint64)[None, :]) <= 3)
    want = closed(signed, [(int(a[i]), int(a[j])) for i, j in near if i < j])
    assert {n: got.get(n, n) for n in signed} == want


def test_large_buckets_are_cut_again():
    rng = random.Random(8)
    x = np.array(sorted({rng.getrandbits(14) for _ in range(3000)}), np.uint64)
    free = list(range(32))
    want = closed(x.tolist(), [(int(a), int(b)) for i, a in enumerate(x) for b in x[i + 1 :][np.bitwise_count(x[i + 1 :] ^ a) <= 3]])
    assert closed(x.tolist(), [(int(a), int(b)) for a, b in simhash.bucket_edges(x, free, few=64)]) == want


def test_paragraphs(spark, docs, empty):
    base = prose(20, 60).split()
    near = [*base[:30], "changed", *base[31:]]
    rows = [(1, prose(21, 40) + "\n" + " ".join(base)), (2, " ".join(near) + "\n" + prose(22, 40)), (3, "short line\n" * 5), (4, "short line"), (5, " ".join(base).upper()), (6, None), (7, prose(23, 5000)), (8, " ".join(base) + "\nx\n" + " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.duplicates(df)
    got = {(r["doc_id"], r["line"]): (r["class_doc_id"], r["class_line"], r["class_size"], r["removed"]) for r in found.where("kind = 'line'").collect()}
    assert got == {(1, 1): (1, 1, 5, False), (2, 0): (1, 1, 5, True), (5, 0): (1, 1, 5, True), (8, 0): (1, 1, 5, True), (8, 2): (1, 1, 5, True)}
    left = by_id(paragraphs.removed_text(df, found), "text")
    assert left[2] == rows[1][1].split("\n")[1] and left[8] == "x" and left[6] is None and left[3] == rows[2][1]
    assert paragraphs.duplicates(empty).count() == 0
    assert {r["doc_id"] for r in paragraphs.duplicates(docs).where("removed and kind = 'line'").collect()} == {15, 16, 18, 24}


def test_short_lines_and_wrapped_paragraphs(spark):
    short, near = "All rights are reserved by us", prose(71, 24).split()
    base = prose(72, 120).split()
    wrapped = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    changed = [*base[:60], "changed", *base[61:]]
    rows = [(1, f"{prose(73, 30)}\n{short}\n{' '.join(near)}"), (2, f"{short.upper()}\n{prose(74, 30)}\n{' '.join([*near[:23], 'changed'])}"), (3, f"{wrapped(base, 11)}\n\n{prose(75, 30)}"), (4, f"{prose(76, 30)}\n \n{wrapped(changed, 7)}"), (5, f"{prose(77, 30)}\n\n{' '.join(base)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.duplicates(df)
    got = {(r["doc_id"], r["line"], r["kind"]): (r["class_doc_id"], r["class_line"], r["removed"]) for r in found.where("kind <> 'passage'").collect()}
    assert got == {(1, 1, "line"): (1, 1, False), (2, 0, "line"): (1, 1, True), (1, 2, "line"): (1, 2, False), (2, 2, "line"): (1, 2, True), (3, 0, "paragraph"): (3, 0, False), (4, 2, "paragraph"): (3, 0, True), (5, 2, "paragraph"): (3, 0, True)}
    left = by_id(paragraphs.removed_text(df, found), "text")
    assert left[1] == rows[0][1] and left[3] == rows[2][1] and left[2] == prose(74, 30) and left[4].strip() == prose(76, 30) and left[5].strip() == prose(77, 30)


def test_hidden_passages(spark):
    """Excerpts of 50 words and more, put in the midst of other lines."""
    sources = {i: prose(500 + i, 300) for i in range(40)}
    hosts = {}
    for i in range(40):
        words, host = sources[i].split(), prose(900 + i, 200).split()
        at, k = 20 + 3 * i, 51 + i % 20
        hosts[100 + i] = " ".join([*host[:77], *words[at : at + k], *host[77:]])
    clean = {200 + i: prose(1300 + i, 250) for i in range(40)}
    df = spark.createDataFrame([*sources.items(), *hosts.items(), *clean.items()], "doc_id long, text string")
    found = paragraphs.duplicates(df).where("kind = 'passage'").collect()
    caught = {(r["doc_id"], r["class_doc_id"]) for r in found if r["removed"]}
    assert len(caught & {(100 + i, i) for i in range(40)}) >= 38 and not [r for r in found if r["doc_id"] >= 200]
    for r in found:
        text = (sources | hosts)[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(text.split()) == r["n_words"]


def test_passages_are_found_whole(spark):
    """Every passage of 16 words and more, and all of its words."""
    sources = {i: prose(2500 + i, 300) for i in range(60)}
    hosts, want = {}, set()
    for i in range(60):
        words, host = sources[i].split(), prose(2900 + i, 200).split()
        at, k = 20 + 3 * i, 16 + i
        hosts[100 + i] = " ".join([*host[:77], *words[at : at + k], *host[77:]])
        want.add((100 + i, i, len(" ".join(host[:77])) + 1, len(" ".join(words[at : at + k])), k))
    found = paragraphs.duplicates(spark.createDataFrame([*sources.items(), *hosts.items()], "doc_id long, text string")).where("kind = 'passage' and removed").collect()
    got = {(r["doc_id"], r["class_doc_id"], r["start"], r["length"], r["n_words"]) for r in found}
    # a word beside a passage may happen to agree
    assert len(got) == len(want) and all(any(g[:2] == w[:2] and g[2] <= w[2] and g[2] + g[3] >= w[2] + w[3] and g[4] <= w[4] + 4 for g in got) for w in want)


def test_removed_passages_leave_the_text(spark):
    words, host, other = prose(81, 300).split(), prose(82, 200).split(), prose(83, 100)
    line = prose(84, 40)
    rows = [(1, " ".join(words)), (2, " ".join([*host[:77], *words[50:130], *host[77:]])), (3, line), (4, "\n".join([other, line, " ".join(["näher", *words[200:260], "zum"]), "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = by_id(paragraphs.removed_text(df, paragraphs.duplicates(df)), "text")
    assert left == {1: rows[0][1], 2: " ".join(host), 3: line, 4: other + "\nnäher zum\nend"}


def test_one_copy_stays(spark):
    """Excerpts of different length, and a line that stays among lines but is part of an earlier document's longer line."""
    a, b, line = prose(91, 60), prose(92, 60), prose(93, 40)
    around = lambda k, inner: f"{prose(600 + k, 50)} {inner} {prose(650 + k, 50)}"
    rows = [(1, around(1, a)), (2, around(2, f"{a} {b}")), (3, around(3, f"{a} {b}")), (4, around(4, line)), (5, f"{prose(94, 30)}\n{line}"), (6, f"{line}\n{prose(95, 30)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = by_id(paragraphs.removed_text(df, paragraphs.duplicates(df)), "text")
    assert left == {1: rows[0][1], 2: around(2, b), 3: around(3, "").replace("  ", " "), 4: rows[3][1], 5: prose(94, 30), 6: prose(95, 30)}


def test_exact_jaccard():
    rng = random.Random(4)
    sets = [np.unique(np.array([rng.randint(0, 60) for _ in range(40)], np.uint64)) for _ in range(60)]
    sets += [np.unique(np.append(s[:-1], np.uint64(99))) for s in sets[:30]]
    ids = np.arange(len(sets))
    jaccard = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    want = closed(ids.tolist(), [(i, j) for i in ids.tolist() for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    assert closed(ids.tolist(), paragraphs.linked(ids, sets)) == want


def brute(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(left).hexdigest())
    return out


def test_suffix_order():
    rng = random.Random(5)
    for _ in range(200):
        t = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 70))])
        assert suffixes.suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i, t=t: t[i:].tolist())


def test_suffixes(spark, docs, texts, empty):
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_id(suffixes.dedup(docs), *columns) == brute(texts)
    assert suffixes.dedup(empty).count() == 0
    rng = random.Random(9)
    passages = [prose(100 + k, rng.randint(8, 60)) for k in range(12)]
    mixed = {i: "".join(rng.choice([*passages, prose(1000 + rng.randint(0, 10**6), 12), "é" * rng.randint(1, 130), "ab" * rng.randint(1, 90)]) + rng.choice(["", " ", "\n", "z"]) for _ in range(rng.randint(0, 9))) for i in range(120)}
    df = spark.createDataFrame(list(mixed.items()), "doc_id long, text string").repartition(5)
    assert by_id(suffixes.dedup(df), *columns) == brute(mixed)


def test_suffix_runs_across_batches(spark):
    """The stream's decisions don't depend on where its batches end."""
    shared = prose(50, 40)
    mixed = {i: shared + str(i) if i % 3 else f"{i} " + shared for i in range(200)}
    df = spark.createDataFrame(list(mixed.items()), "doc_id long, text string").repartition(2)
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert by_id(suffixes.dedup(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(mixed)


def test_exact_with_repeated_ids(spark):
    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "b"), (3, None), (3, ""), (4, "c"), (2, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (2, 1, 1000):
        got = sorted((r["doc_id"], r["text_sha256"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(df, lambda i, share=share: i % share == 0).collect())
        same = [[j for j, u in rows if (u or "") == (t or "")] for _, t in rows]
        assert got == sorted((i, hashlib.sha256((t or "").encode()).hexdigest(), max(m), len(m), i == max(m)) for (i, t), m in zip(rows, same, strict=True))


def test_recall_of_similar_lines(spark):
    """Against all pairs: of pairs at 0.8, 0.85 and 0.9, lines of 5 to 60 words, nearly all are linked."""
    rng = random.Random(12)
    rows, pairs = [], {0.8: [], 0.85: [], 0.9: []}
    for i in range(900):
        words = prose(5000 + i, rng.randint(5, 60)).split()
        rows.append((2 * i, " ".join(words)))
        k = rng.randint(0, max(0, (len(words) - 5) // 5))
        rows.append((2 * i + 1, " ".join([*words[: len(words) - k], *prose(9000 + i, rng.randint(0, 2)).split()])))
    shingled = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    found = paragraphs.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'line'")
    got = {r["doc_id"]: r["class_doc_id"] for r in found.collect()}
    for i in range(900):
        a, b = shingled[2 * i], shingled[2 * i + 1]
        j = len(a & b) / len(a | b)
        for s in pairs:
            if s <= j < s + 0.05 or (s == 0.9 and j >= s):
                pairs[s].append(got.get(2 * i) == got.get(2 * i + 1) == 2 * i)
        assert j >= 0.8 or 2 * i not in got  # what is under 0.8 isn't linked
    assert all(len(x) > 30 and sum(x) >= 0.98 * len(x) for x in pairs.values()), {s: (len(x), sum(x)) for s, x in pairs.items()}


def test_paragraphs_of_repeated_ids(spark):
    a, b = prose(301, 40), prose(302, 40)
    rows = [(1, a + "\n" + b), (1, prose(303, 40)), (2, b), (1, prose(303, 40)), (3, prose(303, 40).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.duplicates(df)
    assert sorted((r["doc_id"], r["line"], r["class_doc_id"], r["removed"]) for r in found.where("kind = 'line'").collect()) == [(1, 0, 1, False), (1, 1, 1, False), (2, 0, 1, True), (3, 0, 1, True)]
    left = sorted((r["doc_id"], r["text"]) for r in paragraphs.removed_text(df, found).collect())
    assert left == sorted([(1, a + "\n" + b), (1, rows[1][1]), (2, ""), (1, rows[1][1]), (3, "")])


def test_suffixes_of_repeated_ids(spark):
    a, b = prose(401, 30), prose(402, 30)
    rows = [(1, a), (1, a), (1, b + a), (2, b), (3, a), (1, b + a)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    order = sorted({(i, hashlib.sha256(t.encode()).hexdigest(), t) for i, t in rows})  # the different documents, in order
    want = brute({k: t for k, (_, _, t) in enumerate(order)})
    by_row = {(i, t): want[k] for k, (i, _, t) in enumerate(order)}
    assert got == sorted((i, by_row[i, t][0], by_row[i, t][1], by_row[i, t][3]) for i, t in rows)
    assert sum(g[2] for g in got) < sum(g[1] for g in got)


def test_one_passage_among_many_neighbours(spark):
    """A passage of 120 bytes in 3000 documents with different neighbours: each but the first loses exactly it."""
    passage = prose(403, 30)[:120]
    mixed = {i: f"{prose(20_000 + i, 3)} {passage} {prose(30_000 + i, 3)}" for i in range(3000)}
    df = spark.createDataFrame(list(mixed.items()), "doc_id long, text string").repartition(4)
    assert by_id(suffixes.dedup(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(mixed)


def test_packed_keys_are_found_wherever_they_meet(spark, monkeypatch):
    rng = np.random.default_rng(4)
    hot = rng.random(30_000) < 0.3
    keys = paragraphs._mix(np.where(hot, 50_000, rng.integers(1, 40_000, 30_000)).astype(np.uint64) * paragraphs._SPREAD)  # one key has a third of all rows
    rows = np.zeros(len(keys), paragraphs._BANDED)
    rows["key"], rows["other"], rows["counts"] = keys, rng.integers(0, np.where(hot, 5000, 3)), rng.random(len(keys)) < 0.1
    others, counts = {}, {}
    for k, o, c in zip(rows["key"].tolist(), rows["other"].tolist(), rows["counts"].tolist(), strict=True):
        others.setdefault(k, set()).add(o)
        counts[k] = counts.get(k, False) or bool(c)
    monkeypatch.setattr(paragraphs, "FLUSH", 1000)
    packed = [(b, r) for batch in paragraphs.gathered(np.array_split(rows, 100), 16) for b, r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    sizes = {}
    for b, r in packed:
        sizes[b] = sizes.get(b, 0) + len(r) // paragraphs._BANDED.itemsize
    assert max(sizes.values()) < 2 * sum(sizes.values()) / 16  # the hot key doesn't fill its bucket
    found = paragraphs.shared(spark.createDataFrame(packed, "bucket long, rows binary"), paragraphs._BANDED, "key long, short long, counts boolean").collect()
    assert {(r["key"], r["short"]) for r in found} == {(k - (1 << 64 if k >> 63 else 0), o) for k, os in others.items() if len(os) > 1 for o in os}
    assert {r["key"] for r in found if r["counts"]} == {k - (1 << 64 if k >> 63 else 0) for k, os in others.items() if len(os) > 1 and counts[k]}
