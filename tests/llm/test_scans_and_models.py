import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from conftest_llm import by_id
from pyspark.sql import functions as F

from quern.llm import gif, language, secrets, toxicity
from quern.llm.ftrl import Ftrl, loss, softmax, temperature

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TRICKY = ["token:token:abcdefgh", "TOKEN = 'abc' secret:\"s3cr3t-x\" é password:12345", "🎉🎉 api_key=ABCDEFGH AKIA" + "Z" * 16 + " akia", "AKIA" + "Q" * 15, "0" * 24 + "x" + "f" * 23 + " token=" + "a1" * 20, "passwdpasswd=\x20\x20=abc", None, "", "x" * 100_000 + "secret=abcdef"]


def spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, docs, texts, empty):
    mine = dict(enumerate([*TRICKY, TRICKY[1]])) | texts
    df = spark.createDataFrame(list(mine.items()), "doc_id long, text string")
    findings, ledger = secrets.scan(df)
    got = by_id(secrets.report(findings), "n_assign", "n_access", "n_hex", "spans", "base_sha256")
    for i, t in mine.items():
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in spans(t))
        assert got[i] == (*(sum(x[1] == k for x in spans(t)) for k in range(3)), said, hashlib.sha256(said.encode()).hexdigest())
    assert ledger.count() == 3 * len({t or "" for t in mine.values()})  # once for each blob and rule version
    assert secrets.report(secrets.scan(empty)[0]).count() == 0


def test_ledger_is_incremental(spark):
    first = spark.createDataFrame([(1, "token=abcdefgh"), (2, "clean")], "doc_id long, text string")
    _, ledger = secrets.scan(first)
    # what the ledger says of a known blob is believed: it isn't scanned again
    forged = ledger.withColumn("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    later = first.unionByName(spark.createDataFrame([(3, "secret: zyxwvuts"), (4, "token=abcdefgh")], "doc_id long, text string"))
    findings, grown = secrets.scan(later, forged)
    assert by_id(secrets.report(findings), "n_assign") == {1: 0, 2: 0, 3: 1, 4: 0}
    assert grown.count() == ledger.count() + 3
    newer = tuple(secrets.Rule(r.kind, r.pattern, r.group, r.least, 2) for r in secrets.RULES)
    assert by_id(secrets.report(secrets.scan(later, grown, newer)[0]), "n_assign") == {1: 1, 2: 0, 3: 1, 4: 1}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=" + "a1" * 20 + " end"), (2, "clean"), (3, None)], "doc_id long, text string")
    found = secrets.hits(secrets.scan(df)[0])
    assert by_id(df.join(found, "doc_id", "left").select("doc_id", secrets.redacted(F.col("text"), F.col("hits")).alias("text")), "text") == {1: "é [secret] end", 2: "clean", 3: None}


def test_gif_query(docs, texts, empty):
    got = by_id(gif.features(gif.store(docs)), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    for i, t in texts.items():
        data = (t or "").encode()
        payload = data + b"\0" * ((-len(data)) % 64 or 64 * (not data))
        assert got[i][:4] == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got[i][4:] == got[next(j for j, u in texts.items() if (u or "") == (t or ""))][4:]
    assert gif.features(gif.store(empty)).count() == 0
    frames = gif.frames(gif.store(docs).where("doc_id = 21")).collect()
    assert len(frames) > 1 and [f["start_cs"] for f in frames] == [10 * k for k in range(len(frames))] and sum(frames[0]["histogram"]) == 3 * 64 * 1024


def test_lzw_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 2, 5, 300, 5000, 70_000):
        for k in (1, 2, 256):
            data = bytes(rng.randrange(k) for _ in range(n))
            assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data


def packed(codes, least):
    """A code stream as a plain encoder would write it."""
    bits, size, free, acc, first = 0, least + 1, (1 << least) + 2, 0, True
    for c in codes:
        acc |= c << bits
        bits += size
        if c == 1 << least:
            size, free, first = least + 1, (1 << least) + 2, True
            continue
        if first:
            first = False
        elif free < 4096:
            free += 1
            if free == 1 << size and size < 12:
                size += 1
    return acc.to_bytes((bits + 7) // 8, "little")


def test_lzw_known_streams():
    assert gif.lzw_decode(packed([4, 1, 6, 6, 2, 5], 2), 2, 6) == bytes([1, 1, 1, 1, 1, 2])  # a code used before its entry is complete
    assert gif.lzw_decode(packed([256, *[7] * 4500, 257], 8), 8, 4500) == bytes([7] * 4500)  # a full table without a clear code
    with pytest.raises(ValueError):
        gif.lzw_decode(packed([4, 1, 7], 2), 2, 6)
    with pytest.raises(ValueError):
        gif.decode(b"not a gif")
    with pytest.raises(ValueError):
        gif.decode(gif.encode(b"x" * 640)[:-20])


def image(frames, width, height, palette=b"\x00\x00\x00\xff\x00\x00\x00\xff\x00\x00\x00\xff"):
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x81, 0, 0), palette]
    for left, top, w, h, index, disposal, hidden, delay, flags in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (hidden is not None), delay, hidden or 0, 0))
        stream = packed([4, *index, 5], 2) if len(index) < 3 else packed([x for i in index for x in (4, i)] + [5], 2)
        out.append(struct.pack("<BHHHHBB", 0x2C, left, top, w, h, flags, 2) + bytes([len(stream)]) + stream + b"\0")
    return b"".join([*out, b";"])


def test_disposal_and_transparency():
    red, green, clear = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 0, 0)
    frames = [(0, 0, 2, 2, [1, 1, 1, 1], 1, None, 5, 0), (0, 0, 1, 2, [2, 0], 3, 0, 7, 0), (1, 0, 1, 1, [2], 2, None, 9, 0), (0, 1, 1, 1, [3], 0, None, 1, 0)]
    shown = gif.decode(image(frames, 2, 2))
    canvases = [[tuple(p) for p in f.canvas.reshape(-1, 4).tolist()] for f in shown.frames]
    assert canvases[0] == [red] * 4
    assert canvases[1] == [green, red, red, red]  # index 0 lets the red through
    assert canvases[2] == [red, green, red, red]  # the second frame was undone
    assert canvases[3] == [red, clear, (0, 0, 255, 255), red]  # the third was cleared
    assert [f.start_cs for f in shown.frames] == [0, 5, 12, 21]
    rows = gif.decode(image([(0, 0, 1, 5, [0, 2, 1, 2, 3], 0, None, 0, 0x40)], 1, 5)).frames[0].canvas[:, 0].tolist()
    assert [tuple(r[:3]) for r in rows] == [(0, 0, 0), (0, 255, 0), (255, 0, 0), (0, 0, 255), (0, 255, 0)]  # interlaced


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 20))
    y = (x[:, 0] + 2 * x[:, 1] > 0).astype(int)
    learner = Ftrl(20, 2, l1=5.0)
    for i in range(600):
        learner.learn(np.arange(20), x[i], int(y[i]))
    w = learner.weights()
    assert (w[3:] == 0).mean() > 0.5 and ((x @ w).argmax(1) == y).mean() > 0.9
    assert temperature(np.array([[4.0, 0.0]] * 8 + [[0.0, 4.0]] * 2), np.array([0] * 10)) > 2
    assert np.allclose(softmax(np.zeros((2, 3))), 1 / 3)


def labelled(spark):
    """Two made-up languages; one document in four is toxic, some of them in disguise."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(["the", "ing", "tion", "and"] if i % 2 else ["eau", "oui", "ette", "çois"]) + rng.choice("abcdefgh") for _ in range(40)]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "scum", "s.c.u.m", "scuuuum", "$cum", "s-c-u-m"]))
        rows.append((i, " ".join(words), "en" if i % 2 else "fr", int(toxic)))
    return spark.createDataFrame(rows + [(900, None, "en", 0), (901, "", None, 0), (902, "123 !!", "fr", 0)], "doc_id long, text string, lang string, toxic int")


def test_language(spark, docs, empty):
    rows = labelled(spark)
    got = by_id(language.identify(rows), "held_out", "lang_pred", "score")
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in range(400) if got[i][0]] == held
    assert sum(got[i][1] == ("en" if i % 2 else "fr") for i in held) >= 0.95 * len(held)
    assert all(got[i][1:] == ("und", 0.0) for i in (900, 901, 902)) and all(0 <= g[2] <= 1 for g in got.values())
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert set(by_id(language.identify(docs), "lang_pred").values()) == {"en", "und"}


def test_toxicity(spark, docs, empty):
    rows = labelled(spark)
    held = lambda i: language.remainder(i) == 0
    got = by_id(toxicity.rate(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), held), "held_out", "score", "predicted")
    out = [i for i in range(400) if got[i][0]]
    assert sum(got[i][2] == (i % 4 == 0) for i in out) >= 0.9 * len(out)
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in got.values()) and got[900][2] == 0
    labels = rows.select("doc_id", "toxic")
    assert toxicity.rate(empty.select("doc_id", "text"), labels, held).count() == 0
    assert max(by_id(toxicity.rate(docs.select("doc_id", "text"), labels.where("false"), held), "score").values()) < 1e-6


def test_restoration():
    counts = np.zeros(28**3)
    for w in ["scum", "trash", "idiot", "the", "worthless"] * 50:
        counts += toxicity.trigrams(w)
    n = counts.reshape(28, 28, 28)
    pairs = n.sum(0) + 0.5
    read = toxicity.Restorer(np.log((n + 20 * (pairs / pairs.sum(1, keepdims=True))[None]) / (n.sum(2, keepdims=True) + 20)))
    for seen, want in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("tr@sh###", "trash"), ("scuuuum", "scum"), ("w0rthle55", "worthless"), ("the,", "the"), ("plain", "plain"), ("2024", "2024"), ("", "")):
        assert read.word(seen) == want, seen
    assert read.words("the s c u m, x") == ["the", "scum", "x"]


def test_restoration_of_long_and_heavy_disguises():
    counts = np.zeros(28**3)
    for w in ["scum", "trash", "idiot", "idiotic", "shit", "the", "worthless", "you are worthless trash you idiot"] * 50:
        counts += toxicity.trigrams(w)
    n = counts.reshape(28, 28, 28)
    pairs = n.sum(0) + 0.5
    read = toxicity.Restorer(np.log((n + 20 * (pairs / pairs.sum(1, keepdims=True))[None]) / (n.sum(2, keepdims=True) + 20)))
    for seen, want in (("idi" + "o" * 40 + "t", "idiot"), (".".join("idiot") + "...." + ".".join("worthless"), "idiot worthless"), ("5h17", "shit"), ("1d107", "idiot"), ("i" + "." * 30 + "diot", "idiot"), ("12.30", "12.30"), ("hello", "hello")):
        assert " ".join(read.words(seen)) == want, seen
    assert read.word("0000idiot") in ("idiot", "oidiot", "ooidiot")  # zeros may be letters
    assert read.words("so " + " ".join("youareworthlesstrashyouidiot") + ".") == ["so", "you", "are", "worthless", "trash", "you", "idiot"]
    assert read.words(" ".join("youidiot" * 40)) == ["you", "idiot"] * 40
    assert "idiot" * 10 + "$" not in toxicity.entries("idiot" * 10) and len(toxicity.entries("idiot" * 10)) == 6


def test_secrets_query_passes_its_ledger_on(spark, tmp_path, monkeypatch):
    from quern.llm import queries

    rows = [(i, f"text {i % 15} token={'k' * (6 + i % 5)}" if i % 7 else None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, scan = [], secrets.scan

    def watched(docs, ledger=None, *more):
        out = scan(docs, ledger, *more)
        seen.append((0 if ledger is None else ledger.count(), out[1].count()))
        return out

    monkeypatch.setattr(secrets, "scan", watched)
    got = sorted(map(tuple, queries.op3_secrets(spark, str(tmp_path)).collect()))
    findings, grown = scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == sorted(map(tuple, secrets.report(findings).collect()))
    assert len(seen) == 2 and seen[0][0] == 0 < seen[1][0] == seen[0][1] and seen[1][1] == grown.count()


def test_secrets_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh"), (1, "clean"), (2, "clean"), (1, "token=abcdefgh"), (3, "token=abcdefgh")], "doc_id long, text string")
    for rows, ledger in (secrets.scan(df), secrets.scan_history(df, 3)):
        got = sorted((r["doc_id"], r["spans"]) for r in secrets.report(rows).collect())
        assert got == [(1, ""), (1, "assign:0:14"), (1, "assign:0:14"), (2, ""), (3, "assign:0:14")]
        assert ledger.count() == 6


def test_languages_of_equal_texts(spark):
    """The same text in batches of any size, and beside any others."""
    rng = np.random.default_rng(5)
    model = language.Model(["a", "b", "c"], rng.random(1 << language.BITS), rng.normal(size=(1 << language.BITS, 3)), rng.normal(size=3), 0.7)
    texts = ["".join(rng.choice(list("abc é"), 300)) for _ in range(9)]
    rows = spark.createDataFrame([(i, texts[i % 9] if i % 4 else texts[0]) for i in range(700)], "doc_id long, text string").repartition(7)
    seen = {}
    for r in rows.join(language.predict(rows, model), "doc_id").collect():
        seen.setdefault(r["text"], set()).add((r["lang_pred"], r["score"]))
    assert all(len(x) == 1 for x in seen.values())


def test_tf_idf_and_one_step_by_hand():
    """Against plain loops: n-gram features, TF-IDF, and one step of follow-the-regularised-leader."""
    idf = np.linspace(0.5, 2, 1 << language.BITS)
    for text in ("a", "Ab ab", "é" * 5, "x y z " * 40):
        marks = [ord(c) for c in f" {text.lower()} "]
        seen = {}
        odd = [int(x) for x in language._ODD]
        for n in (1, 2, 3):
            for i in range(len(marks) - n + 1):
                h = marks[i] * odd[0] & 0xFFFFFFFF
                for k in range(1, n):
                    h = (h * odd[k] + marks[i + k] * odd[0]) & 0xFFFFFFFF
                h = (h ^ h >> 15) * odd[2] & 0xFFFFFFFF
                seen[h >> 32 - language.BITS] = seen.get(h >> 32 - language.BITS, 0) + 1
        at, x = language.vector(text, idf)
        raw = {f: np.log(1 + c) * idf[f] for f, c in seen.items()}
        length = np.sqrt(sum(v * v for v in raw.values()))
        assert at.tolist() == sorted(raw) and np.allclose(x, [raw[f] / length for f in sorted(raw)])
    learner = Ftrl(3, 2, alpha=0.5, beta=1.0, l1=0.01, l2=0.1)
    learner.learn(np.array([0, 2]), np.array([1.0, 2.0]), 1)
    for f, v in ((0, 1.0), (2, 2.0)):
        for c in (0, 1):
            g = v * (0.5 - (c == 1))  # all weights are zero, so both classes have a half
            assert np.isclose(learner.z[f, c], g) and np.isclose(learner.n[f, c], g * g)
            want = -(g - np.sign(g) * 0.01) / ((1 + abs(g)) / 0.5 + 0.1)
            assert np.isclose(learner.weights()[f, c], want)
    assert not learner.z[1].any()


def test_temperature_lies_inside_its_range():
    rng = np.random.default_rng(2)
    for scale in (1e-3, 1, 1e3):  # every example is told right, as good as surely
        y = rng.integers(0, 3, 400)
        logits = np.eye(3)[y] * scale * 5 + rng.normal(size=(400, 3)) * scale * 0.1
        heat = temperature(logits, y)
        assert all(loss(logits, y, heat) <= loss(logits, y, heat * f) + 1e-12 for f in (0.5, 0.99, 1.01, 2))
        assert 0.9 < softmax(logits / heat).max(1).mean() < 1 - 1e-4
    assert temperature(np.zeros((5, 3)), np.zeros(5, int)) == 1
