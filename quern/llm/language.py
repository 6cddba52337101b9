"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, calibrated by temperature.

n-grams of one to three characters of the whole lower-case text are hashed into 2^14 features. Document frequencies count every training
row. The classifier is fitted on a bounded sample: at most about SAMPLE rows of each language, by a hash of doc_id; a fifth of them
serves for the temperature.

Defined results: `und` with score 0 for null texts and texts without a letter; texts of any length count whole; without labelled rows every text
is `und`; rows without a language aren't learned from; a tie goes to the language first in the alphabet; equal texts get equal results; repeated rows
count as often as they occur, and each gets its own result; an empty table gives an empty result; columns other than the id, the text and the language
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import materialize, release, sliced
from quern.llm.ftrl import Ftrl, softmax, temperature

BITS = 14
#: Rows of each language that the classifier is fitted on, about.
SAMPLE = 800
EPOCHS = 3
UNDETERMINED = "und"
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: zero means held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def lettered(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h, shift, out = c * _ODD[0], np.uint32(32 - BITS), np.zeros(1 << BITS, np.int64)
    for order in range(3):
        if order:
            h = h[:-1] * _ODD[order] + c[order:] * _ODD[0]
        if len(h):
            out += np.bincount((h ^ h >> np.uint32(15)) * _ODD[2] >> shift, minlength=1 << BITS)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        """Summed feature by feature in one order, so that equal texts get equal results in any batch."""
        at, x = vector(text, self.idf)
        return (x[:, None] * self.weights[at]).sum(0) + self.bias


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF with logarithmic term frequencies, of length one: the features that occur, and their values."""
    c = counts(text)
    at = np.flatnonzero(c)
    x = np.log1p(c[at]) * idf[at]
    return at, x / max(float(np.sqrt((x * x).sum())), 1e-9)


def fit(lang: list[str], at: list[np.ndarray], values: list[np.ndarray], languages: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, bias and temperature from examples in a fixed order."""
    bias = 1 << BITS
    examples = [(np.append(i, bias), np.append(x, 0.2), languages.index(y)) for i, x, y in zip(at, values, lang, strict=True)]
    order = np.random.default_rng(4)
    shuffled = [examples[i] for i in order.permutation(len(examples))]
    held = shuffled[: len(shuffled) // 5] if len(shuffled) >= 50 else shuffled
    learned = shuffled[len(held) :] if len(shuffled) >= 50 else shuffled
    learner = Ftrl(bias + 1, len(languages))
    for _ in range(EPOCHS):
        for i in order.permutation(len(learned)):
            learner.learn(*learned[i])
    w = learner.weights()
    heat = temperature(np.array([x @ w[i] for i, x, _ in held]), np.array([y for _, _, y in held]))
    return w[:-1], 0.2 * w[-1], heat


def train(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from the rows where training holds and the language isn't null. The sample is fitted in one executor task, so the driver
    holds the model alone."""
    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    languages, total = sorted(sizes), sum(sizes.values())

    def frequencies(batches):
        seen = np.zeros(1 << BITS, np.int64)
        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                seen += counts(t) > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["at", "n"])

    idf = np.full(1 << BITS, np.log(1.0 + total))
    for r in rows.select("text").mapInArrow(frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():  # at most 2^14 rows
        idf[r["at"]] = np.log((1.0 + total) / (1.0 + r["n"])) + 0.05
    if not languages:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)

    def sparse(batches):
        for b in sliced(batches):
            found = [vector(t, idf) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([at.astype(np.uint16).tobytes() for at, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())], ["doc_id", "lang", "at", "x"])

    def fitted(batches):
        held = [b for b in batches if b.num_rows]
        found = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("doc_id", "lang", "at", "x")])  # the order must not depend on the tasks
        at = [np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for x in found.column("at")]
        values = [np.frombuffer(x.as_py(), np.float32) for x in found.column("x")]
        w, bias, heat = fit(found.column("lang").to_pylist(), at, values, languages)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias.tobytes()], pa.binary()), pa.array([heat], pa.float64())], ["weights", "bias", "temperature"])

    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, sample / n))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    examples = materialize(chosen.mapInArrow(sparse, "doc_id long, lang string, at binary, x binary"), "examples")  # about `sample` rows of each language
    found = examples.repartition(1).mapInArrow(fitted, "weights binary, bias binary, temperature double").first() if examples.take(1) else None
    release(examples)
    if found is None:  # a small sample may have no row at all
        return Model(languages, idf, np.zeros((1 << BITS, len(languages))), np.zeros(len(languages)), 1.0)
    weights = np.frombuffer(found["weights"], np.float64).reshape(1 << BITS, len(languages))
    return Model(languages, idf, weights, np.frombuffer(found["bias"], np.float64), found["temperature"])


def annotate(docs: DataFrame, model: Model, text_col: str, pred: str, score: str) -> DataFrame:
    """All columns of docs, and the likeliest language and its calibrated probability as pred and score, which no column of docs may be named."""
    place = docs.columns.index(text_col)

    def guessed(batches):
        for b in sliced(batches):
            lang, sure = [], []
            for t in b.column(place).to_pylist():
                if not model.languages or not lettered(t):
                    lang.append(UNDETERMINED)
                    sure.append(0.0)
                    continue
                p = softmax(model.logits(t) / model.temperature)
                best = int(p.argmax())
                lang.append(model.languages[best])
                sure.append(min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(sure, pa.float64())], [*b.schema.names, pred, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(guessed, schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return annotate(rows, model, "text", "lang_pred", "score").drop("text")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out and predict all. Returns doc_id, held_out, lang_pred, score."""
    model = train(docs, remainder(F.col("doc_id")) != 0)
    return predict(docs, model).select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
