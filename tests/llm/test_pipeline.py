import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from conftest_llm import prose
from pyspark.sql import functions as F
from test_bpe_and_packing import ids_of
from test_dedup import closed
from test_scans_and_models import spans

from quern.llm import simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    french = lambda k: " ".join(rng.choice(["eau", "oui", "ette", "çois"]) + rng.choice("abcdefgh") for _ in range(k))
    texts = [prose(i, 60) for i in range(40)] + [french(60) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " more", None, "", "123 456", "token=abcdef123 " + texts[7], "AKIA" + "Q" * 20 + " " + texts[50]]
    rows = [(i, t, "en" if i % 80 < 40 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    rows[60] = (60, rows[60][1], None, "s", 1)
    out = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return out


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    inputs = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS
        docs = corpus_pipeline.materialize(out, "test")
        kept = {r["doc_id"]: r for r in docs.collect()}
        if name == "language_id":
            assert set(inputs) - set(kept) == {83, 84, 85} and kept[60]["lang"] == "fr"
        elif name == "exact_dedup":
            assert set(kept) == {max(j for j, s in inputs.items() if s["text"] == r["text"]) for r in inputs.values()}
        elif name == "simhash":
            fp = {i: simhash.fingerprint(r["text"]) for i, r in inputs.items()}
            assert set(kept) == set(closed(fp, [(i, j) for i in fp for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3]).values())
        else:
            assert set(kept) == set(inputs)
            for i, r in inputs.items():
                text, at = "", 0
                for a, _, z in spans(r["text"]):
                    if a >= at:
                        text += r["text"][at:a] + "[secret]"
                    at = max(at, z)
                assert kept[i]["text"] == text + r["text"][at:]
                assert kept[i]["n_chars"] == (len(kept[i]["text"]) if at else r["n_chars"])
        inputs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    for i, r in inputs.items():
        ids = [*ids_of(r["text"]), 2]
        assert [(p["length"], p["ids_crc32"]) for p in packed if p["doc_id"] == i] == [(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_repeated_rows(spark, folder, tmp_path):
    """Columns named like the stages' own, ids with several texts, rows that occur twice."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.where("doc_id in (3, 7, 86)").unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(86).cast("long")))
    names = ["lang_pred", "lang_score", "hits", "blob", "sha", "key", "at", "text_sha256", "component_id", "text_key", "kept", "n"]
    rows = docs.unionByName(twice).select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    out = corpus_pipeline.STAGES[0][1](spark, rows, folder)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, corpus_pipeline.materialize(out, "test"), folder)
    assert out.columns == rows.columns
    got = [(r["doc_id"], r["text"], r["hits"], r["n"]) for r in out.collect()]
    assert len(got) == len(set(got)) and all(g[2:] == (2, 11) for g in got)
    by_text = {t: i for i, t, *_ in got}
    plain = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert by_text[plain[9]] == 86 and by_text["[secret] " + plain[7]] == 86 and by_text[plain[7]] == 7  # the id 86 has two texts, and each is judged by itself
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, folder)
    assert packed.where("doc_id = 86 and start = 0").count() == 3
