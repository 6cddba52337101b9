"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

A word that is disguised (it has a letter, or a sign that may stand for one, beside digits or symbols; stretched letters; single letters with blanks between
them) becomes a lattice, whatever its length; plain words and numbers are read as they stand. Spaced-out letters, and longer strings than a word, may hold several words. In the lattice is what each character may have been, and what the writer's habit costs. Viterbi search finds the likeliest reading under
a trigram language model over characters, counted over all documents.

The score: words and word beginnings whose rate per word differs between toxic and clean training rows form a lexicon; a logistic
regression on a text's weight in it and on its number of words gives a probability. Training uses at most about SAMPLE labelled rows; copies of
one text count once there, and near copies, told by a min-hash over word triples, too.

Defined results: null and empty texts are scored like any text without a lexicon word; texts of any length count whole; without
labelled rows of both classes every score is 0; equal texts get equal scores; a score of exactly 0.5 predicts 1; of readings that tie the one later in the alphabet wins; an id
that is labelled twice has the larger label; repeated rows each get their score; an empty table gives an empty result; columns other than these are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, sliced

#: Labelled rows that the classifier is fitted on, about.
SAMPLE = 20_000
#: Lexicon entries at most; documents and standard deviations that an entry needs.
ENTRIES, LEAST_DOCS, LEAST_Z = 2000, 6, 6.0
PREFIXES = (4, 5, 6, 7, 8)
#: Longer strings between blanks may be several words; so many letters of a word are its entry in the lexicon, and a checksum of the rest.
LONGEST = 24
#: Runs after which the search writes out what all its readings agree in.
WINDOW = 64
LETTERS = 28  # a to z, any other letter, and the edge of a word

# What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SUBSTITUTED, SKIPPED, STRETCHED = -1.0, -1.5, -0.5
_EDGES = re.compile(r"^[^\w@$!|+(€]+|[.,;:!?\"')\]}…]+$|([^\w\s])\1{2,}$")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)[^\W_](?: [^\W_]){2,}(?![^\s.,;:!?])")


def _letter(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 26


_SYMBOL = np.full(0x3000, 27, np.int32)
for _c in range(0x3000):
    if chr(_c).isalpha():
        _SYMBOL[_c] = _letter(chr(_c).lower()[0])


def trigrams(text: str) -> np.ndarray:
    """Counts of three symbols in a row; whatever isn't a letter is an edge."""
    c = np.frombuffer(f"  {text}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _SYMBOL[np.minimum(c, 0x2FFF)]
    return np.bincount((s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:], minlength=LETTERS**3)


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probability of a symbol after two others, from the counts over all texts."""

    def counted(batches):
        total = np.zeros(LETTERS**3, np.int64)
        for b in sliced(batches, 500):
            for t in b.column(0).to_pylist():
                total += trigrams(t)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])

    n = np.zeros(LETTERS**3)
    for r in docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 28^3 rows
        n[r["at"]] = r["n"]
    n = n.reshape(LETTERS, LETTERS, LETTERS)
    pairs = n.sum(0)  # the two last symbols
    lower = (pairs + 0.5) / (pairs + 0.5).sum(1, keepdims=True)
    return np.log((n + 20 * lower[None]) / (n.sum(2, keepdims=True) + 20))


class Restorer:
    """Reads words, disguised ones by Viterbi search over their lattice. Remembers at most ``most`` words."""

    def __init__(self, model: np.ndarray, most: int = 100_000):
        self.model, self.most, self.known = model.tolist(), most, {}

    def word(self, raw: str, spaced: bool = False) -> str:
        """spaced: its letters had blanks between them, so it may be several words."""
        out = self.known.get((raw, spaced))
        if out is None:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[raw, spaced] = out = self._read(raw, spaced)
        return out

    def _read(self, raw: str, spaced: bool) -> str:
        core = raw.lower()
        if not core.isalpha():
            while (cut := _EDGES.sub("", core)) != core:
                core = cut
        if core.isalpha():
            return self.viterbi(core, spaced) if spaced or _STRETCHED.search(core) else core
        if any(c.isalpha() or c in SIGNS and not c.isdigit() for c in core):
            return self.viterbi(core, spaced or len(core) > LONGEST)
        return core

    def viterbi(self, seen: str, several: bool = False) -> str:
        """The likeliest reading, of several words if so told. A state is the two last symbols; a stretch of one letter is read as one or two of it."""
        edge = LETTERS - 1
        states: dict[tuple[int, int], tuple[float, str]] = {(edge, edge): (0.0, "")}
        done = []
        for at, run in enumerate(re.findall(r"((.)\2*)", seen, re.DOTALL)):
            c, n = run[0][0], len(run[0])
            readings: list[tuple[str, float]] = []
            if c.isalpha():
                readings = [(c * min(n, 2), STRETCHED * (n > 2))] + ([(c, STRETCHED)] if n > 1 else [])
            else:
                readings = [(x * k, SUBSTITUTED * k) for x in SIGNS.get(c, "") for k in {1, min(n, 2)}]
                readings.append(("", SKIPPED * (4 * n if c in SIGNS else 1 if c in ".-_*'’·" else 2)))
            if several and at:
                readings += [(" " + text, cost) for text, cost in readings]
                readings += [(text[0] + " " + text[1:], cost) for text, cost in readings if len(text) == 2 and text[0] == text[1]]
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, said) in states.items():
                for text, cost in readings:
                    if b == edge and text[:1] == " ":
                        continue
                    x, y, s = a, b, score + cost
                    for ch in text:
                        k = edge if ch == " " else _letter(ch)
                        s += self.model[x][y][k]
                        x, y = y, k
                    if (x, y) not in after or after[x, y][0] < s:
                        after[x, y] = (s, said + text)
            states = after
            if at % WINDOW == WINDOW - 1:
                shared = commonprefix([said for _, said in states.values()])
                done.append(shared)
                states = {k: (s, said[len(shared) :]) for k, (s, said) in states.items()}
        done.append(max((s + self.model[a][b][edge], said) for (a, b), (s, said) in states.items())[1])
        return "".join(done).strip()

    def words(self, text: str) -> list[str]:
        """A whole text's words, restored."""
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: m[0].replace(" ", "‍"), text)
        out = []
        for raw in text.split():
            if "‍" in raw and _SPACED_JOINED.fullmatch(raw):
                word = self.word(raw.replace("‍", ""), True)
            else:
                word = self.word(raw)
            if " " in word:
                out += word.split()
            else:
                out.append(word)
        return out


_SPACED_JOINED = re.compile(r"\w(?:‍\w)+\W*")


def entries(word: str) -> list[str]:
    """What of a word can be in the lexicon: its beginnings, and the word with its end marked."""
    whole = word if len(word) <= LONGEST else f"{word[:LONGEST]}{zlib.crc32(word.encode('utf-8', 'surrogatepass')):08x}"
    return [word[:k] for k in PREFIXES if len(word) > k] + [whole + "$"] if len(word) > 2 else []


def family(words: list[str]) -> int:
    """Least hash over word triples: near copies mostly agree in it."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


@dataclass
class Model:
    language: np.ndarray
    lexicon: dict[str, float]
    logistic: np.ndarray

    def features(self, words: list[str], weight_of) -> tuple[float, int]:
        return sum(map(weight_of, words)), len(words)

    def probability(self, weight: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(weight, n) @ self.logistic, -30, 30)))


def _inputs(weight: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum(weight, 60) / 5, np.log1p(weight / (1 + n / 50)), np.log1p(n) / 5, np.ones(len(n))], 1)


class Weights(dict):
    """Raw word -> its weight in the lexicon: that of its longest entry."""

    def __init__(self, model: Model, most: int = 300_000):
        self.restorer, self.lexicon, self.most = Restorer(model.language), model.lexicon, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        out = 0.0
        for e in reversed(entries(word)):
            if e in self.lexicon:
                out = self.lexicon[e]
                break
        self[word] = out
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, training, sample: int = SAMPLE) -> Model:
    """docs: (doc_id, text); labels: (doc_id, toxic); training: a Column function of doc_id that says which rows may be learned from."""
    language = language_model(docs)
    usable = labels.where(training(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))  # about `sample` rows at most, so a broadcast fits
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def restored(batches):
        read = Restorer(language)
        for b in sliced(batches, 500):
            words = [read.words(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([family(w) for w in words], pa.int64()), pa.array(words, pa.list_(pa.string()))], ["doc_id", "toxic", "family", "words"])

    examples = materialize(rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(restored, "doc_id long, toxic int, family long, words array<string>"), "examples")
    once = materialize(examples.groupBy("toxic", "family").agg(F.min_by("words", "doc_id").alias("words")), "families")
    sizes = {r["toxic"]: (r["docs"], r["words"]) for r in once.groupBy("toxic").agg(F.count("*").alias("docs"), F.sum(F.size("words")).alias("words")).collect()}
    if 0 not in sizes or 1 not in sizes:
        return Model(language, {}, np.array([0, 0, 0, -30.0]))

    def listed(batches):
        for b in sliced(batches, 500):
            out: dict[tuple[str, int], list[int]] = {}
            for toxic, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine: dict[str, int] = {}
                for w in words:
                    for e in entries(w):
                        mine[e] = mine.get(e, 0) + 1
                for e, n in mine.items():
                    x = out.setdefault((e, toxic), [0, 0])
                    x[0] += 1
                    x[1] += n
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([out[k][0] for k in keys], pa.int64()), pa.array([out[k][1] for k in keys], pa.int64())], ["entry", "toxic", "docs", "uses"])

    sums = [F.sum(F.when(F.col("toxic") == y, F.col(c)).otherwise(0)).alias(f"{c}{y}") for y in (0, 1) for c in ("docs", "uses")]
    (d0, n0), (d1, n1) = sizes[0], sizes[1]
    base = d1 / (d0 + d1)
    both = F.col("docs0") + F.col("docs1")
    z = (F.col("docs1") - both * base) / F.sqrt(both * base * (1 - base))
    weight = F.log(((F.col("uses1") + 0.5) / n1) / ((F.col("uses0") + 0.5) / n0))
    found = once.select("toxic", "words").mapInArrow(listed, "entry string, toxic int, docs long, uses long").groupBy("entry").agg(*sums)
    best = found.withColumn("z", z).withColumn("weight", weight).where((F.col("z") >= LEAST_Z) & (both >= LEAST_DOCS) & (F.col("weight") > 1))
    lexicon = {r["entry"]: r["weight"] for r in best.orderBy(F.desc("z"), "entry").limit(ENTRIES).select("entry", "weight").collect()}  # the lexicon's size is a parameter
    model = Model(language, lexicon, np.zeros(4))

    def weighed(batches):
        weights = Weights(model)
        for b in sliced(batches, 500):
            rows = [model.features(w, weights.__getitem__) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], ["toxic", "weight", "n"])

    seen = once.select("toxic", "words").mapInArrow(weighed, "toxic int, weight double, n long").orderBy("toxic", "weight", "n").collect()  # about `sample` rows at most
    model.logistic = logistic(_inputs(np.array([r["weight"] for r in seen]), np.array([r["n"] for r in seen])), np.array([float(r["toxic"]) for r in seen]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""

    def scored(batches):
        weights = Weights(model)
        for b in sliced(batches, 500):
            rows = [model.features(weights.restorer.words(t), weights.__getitem__) for t in b.column(1).to_pylist()]
            p = model.probability(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scored, "doc_id long, score double")


def rate(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """Returns doc_id, held_out, score, predicted, where held_out is a Column function of doc_id."""

    scores = score(docs, train(docs, labels, lambda i: ~held_out(i)))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
