"""Language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, everything but letters becomes single spaces, and the n-grams of 1 to 3 characters are
hashed into ``BUCKETS`` features.  A feature's value is (1 + log count) x idf, texts are scaled to length 1.
Document frequencies are counted over all training rows.  The weights are fitted on a bounded sample of them,
``SAMPLE_ROWS`` in all and as many of each language, by follow-the-regularised-leader with an elastic-net penalty, so most
weights are zero; a quarter of the sample is set aside to calibrate the temperature of the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 15
#: Rows that the weights are fitted on (about so many, those with the smallest hashes of their ids; languages
#: share them evenly), and the most languages that can be learned.
SAMPLE_ROWS, LANGUAGES = 6000, 500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
UNDETERMINED = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features that occur and their counts; none without a letter."""
    a = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[a]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.where(letter, a, np.uint32(32))[keep]
    parts, h = [], np.zeros(len(a), np.uint32)
    for n in range(3):
        h = (h[: len(a) - n] + a[n:]) * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        parts.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(17))
    f = np.concatenate(parts)
    if len(f) < 3000:
        return np.unique(f, return_counts=True)
    counts = np.bincount(f, minlength=BUCKETS)
    at = counts.nonzero()[0]
    return at, counts[at]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = features(text)
    v = (1 + np.log(counts)) * idf[at]
    return at.astype(np.int32), (v / max(1e-12, float(np.sqrt(v @ v)))).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  #: float32 [bucket, language]
    bias: np.ndarray
    temperature: float
    letters: np.ndarray | None = None  #: code points of the training rows' letters, sorted; not hashed

    def known(self, text: str) -> float:
        """Share of the text's letters that occur in the training rows."""
        a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        a = a[_letters()[a]]
        return float(np.isin(a, self.letters).mean()) if len(a) else 0.0

    def predict(self, text: str | None, least_known: float = 0.0) -> tuple[str, float]:
        at, v = vector(text, self.idf)
        if not len(at) or not self.languages or least_known and self.known(text) < least_known:
            return UNDETERMINED, 0.0
        p = softmax((v.astype(np.float32) @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for softmax regression; the last row is the bias, which
    isn't penalised."""

    def __init__(self, buckets: int, classes: int) -> None:
        self.z = np.zeros((buckets + 1, classes))
        self.n = np.zeros((buckets + 1, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        penalty = np.where((np.arange(len(self.z))[at] == len(self.z) - 1)[:, None], 0.0, 1.0)
        return np.where(np.abs(z) <= L1 * penalty, 0.0, (np.sign(z) * L1 * penalty - z) / ((BETA + np.sqrt(n)) / ALPHA + L2 * penalty))

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        at, v = np.append(at, len(self.z) - 1), np.append(v, 1.0)
        w = self.weights(at)
        error = softmax(v @ w)
        error[label] -= 1
        g = v[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray) -> Model:
    """rows: features, values and language, in a fixed order."""
    languages = sorted({lang for *_, lang in rows})
    vectors = [(at, v, languages.index(lang)) for at, v, lang in rows if len(at)]
    aside, used = vectors[::4], [x for k, x in enumerate(vectors) if k % 4]
    ftrl = Ftrl(BUCKETS, len(languages))
    for _ in range(EPOCHS):
        for at, v, label in used:
            ftrl.learn(at, v, label)
    all_weights = ftrl.weights(slice(None))
    model = Model(languages, idf, all_weights[:-1].astype(np.float32), all_weights[-1].astype(np.float32), 1.0)
    logits = np.array([v @ model.weights[at] + model.bias for at, v, _ in aside]).reshape(-1, len(languages))
    labels = np.array([label for *_, label in aside], int)

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), labels])) if len(x) else 0.0

    lo, hi = np.log(0.05), np.log(20.0)
    for _ in range(60):  # the loss has one minimum
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    model.temperature = float(np.exp((lo + hi) / 2)) if len(logits) else 1.0
    return model


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows, seen = np.zeros(BUCKETS, np.int64), 0, np.zeros(0x110000, bool)
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            counts[features(text)[0]] += 1
            seen[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)] = True
            rows += 1
    at = counts.nonzero()[0]
    # letters come behind the features
    letters = (seen & _letters()).nonzero()[0]
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist(), *(BUCKETS + letters).tolist()], pa.int32()), pa.array([rows, *counts[at].tolist(), *[1] * len(letters)], pa.int64())], ["feature", "n"])


def _fit(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts go as soon as their features are there
        rows = [(*vector(text.as_py(), idf), lang) for b in batches for text, lang in zip(b.column(0), b.column(1).to_pylist())]
        if rows:
            m = fit(rows, idf)
            yield pa.RecordBatch.from_arrays([pa.array([m.languages], pa.list_(pa.string())), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias.tobytes()], pa.binary()), pa.array([m.temperature])], ["languages", "weights", "bias", "temperature"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows of ``docs`` that have an id, a text and a language.

    What comes to the driver is bounded by the number of features, their document frequencies and weights, and by the
    number of letters there are.
    More than ``LANGUAGES`` distinct values of the language are refused with a ValueError, before any is learned:
    the weights and the learner's state are dense, about half a megabyte in float64 for each value and array.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    counts = dict(rows.groupBy("lang").count().limit(LANGUAGES + 1).collect())
    if len(counts) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} distinct values, which is the most that can be learned; map rare or dirty tags to null first")
    df = {f: n for f, n in rows.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect()}
    letters = np.array(sorted(f - BUCKETS for f in df if f >= BUCKETS), np.uint32)
    df = {f: n for f, n in df.items() if f < BUCKETS}
    idf = np.full(BUCKETS, np.log1p(df.pop(-1, 0)) + 1)
    if df:
        at = np.fromiter(df, np.int64, len(df))
        idf[at] -= np.log1p(np.fromiter(df.values(), np.int64, len(df)))
    if not counts:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, letters)
    # the rows with the smallest hashes of a language: a share of its rows that gives about as many of each
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample_rows / len(counts) / n))))
    h = F.xxhash64(F.col("id").cast("string"), F.lit("sample"))
    sample = rows.where(F.pmod(h, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    sample = sample.orderBy(h, "id", "text").limit(2 * sample_rows).select("text", "lang")
    m = sample.coalesce(1).mapInArrow(_fit(idf), "languages array<string>, weights binary, bias binary, temperature double").first()
    return Model(list(m.languages), idf, np.frombuffer(m.weights, np.float32).reshape(BUCKETS, -1), np.frombuffer(m.bias, np.float32), m.temperature, letters)


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", least_known: float = 0.0) -> DataFrame:
    """``docs`` with the language and its calibrated probability, from the whole text alone; ``und`` and 0 for
    a null text, one without a letter and one of whose letters a smaller share than ``least_known`` was learned."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [known.value.predict(t.as_py(), least_known) for t in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*batch.schema.names, pred_col, score_col])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learned from the rows that aren't held out.  Rows with a null id, text or language aren't learned from,
    but get a prediction; more than ``LANGUAGES`` distinct languages are refused (see ``train``); without any row to learn from, all are ``und``.  Repeated rows are predicted alike,
    an empty table gives an empty result, other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.where(~held_out()), "doc_id", "text", "lang", sample_rows)
    return predict(rows.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
