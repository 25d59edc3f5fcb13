"""Language identification: sparse multinomial logistic regression on character n-grams.

Text is lower-cased, every run of non-letters is a blank, and n-grams of one to three
characters are hashed into a fixed number of buckets.  Document frequencies come from
every training row; the weights are fitted with follow-the-regularised-leader under
elastic-net penalties on a bounded sample, and one temperature, fitted on a part of the
sample that training did not see, turns scores into probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LangId:
    #: log2 of the number of n-gram buckets.
    bits: int = 15
    #: Labelled rows per language that the classifier is fitted on: the bound of the sample.
    per_label: int = 600
    epochs: int = 3
    #: Every so many-th sample row calibrates instead of training.
    calibrate_every: int = 5
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


_letters: list[np.ndarray] = []


def counts(text: str, bits: int) -> np.ndarray | None:
    """Occurrences by bucket; None for a text without a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters[0][c]
    if not is_letter.any():
        return None
    c = np.concatenate(([np.uint32(32)], np.where(is_letter, c, np.uint32(32)), [np.uint32(32)])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    a, b, d = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    one, two, three = c * a, c * b, c * d
    grams = np.concatenate((one[c != 32] ^ np.uint32(0x5BD1E995), (one[:-1] + two[1:]) ^ np.uint32(0x27D4EB2F), one[:-2] + two[1:-1] + three[2:] if len(c) > 2 else one[:0]))
    grams ^= grams >> np.uint32(15)
    return np.bincount((grams * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits), minlength=1 << bits)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def scores(self, n: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(n)
        x = values(at, n[at], self.idf)
        return x @ self.weights[at] + self.bias

    def predict(self, n: np.ndarray) -> tuple[str, float]:
        p = softmax(self.scores(n) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def values(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF values of a text with n occurrences in the buckets ``at``."""
    x = (1.0 + np.log(n)) * idf[at]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, p: LangId) -> Model:
    """``rows``: (label, buckets, occurrences) in a fixed order; only the buckets that a text has are held."""
    labels = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(labels)}
    shape = (len(idf) + 1, len(labels))  # the last row is the bias
    z, n = np.zeros(shape), np.zeros(shape)
    data = []
    for label, at, n_at in rows:
        data.append((number[label], np.append(at, len(idf)).astype(np.int32), np.append(values(at, n_at, idf), 1.0).astype(np.float32)))
    held, train, met = [], [], [0] * len(labels)
    for x in data:  # a label's first rows train, so none is only calibrated on
        met[x[0]] += 1
        (train if met[x[0]] % p.calibrate_every else held).append(x)
    held = held or data
    own = [[x for x in train if x[0] == y] for y in range(len(labels))]
    # A label of few rows sees them more often, so that no label drowns it.
    turns = [rows[k % len(rows)] for k in range(max(map(len, own))) for rows in own]

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - p.l1, 0) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for y, at, x in turns:
            w = weights(at)
            e = softmax(x @ w)
            e[y] -= 1
            g = x[:, None] * e
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / p.alpha * w
            n[at] = after
    w = weights(slice(None))
    model = Model(labels, w[:-1], w[-1], idf)
    scored = [(y, x[:-1] @ w[at[:-1]] + w[-1]) for y, at, x in held]

    def loss(log_t: float) -> float:
        return -sum(math.log(max(float(softmax(s / math.exp(log_t))[y]), 1e-300)) for y, s in scored)

    low, high, ratio = -4.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    model.temperature = math.exp((low + high) / 2)
    return model


def train(rows: DataFrame, p: LangId) -> Model | None:
    """A model from (key, text, lang) rows; None if none has a label and a letter."""
    rows = rows.where(F.col("lang").isNotNull()).select("key", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(1 << p.bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                n = counts(text.as_py() or "", p.bits)
                if n is not None:
                    total += n > 0
                    docs += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(total[at], docs), pa.int64())})

    seen = {r[0]: r[1] for r in rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()}  # one row a bucket
    docs = seen.pop(-1, 0)
    if not docs:
        return None
    df = np.zeros(1 << p.bits)
    df[list(seen)] = list(seen.values())
    idf = np.log((1 + docs) / (1 + df)) + 1

    # The rows of least hash per label, rows equal in key, label and text as one. A threshold
    # from the label's different rows leaves a few times per_label of them before any are
    # ranked, and the row of least hash at any rate.
    hashed = rows.withColumn("h", F.xxhash64("key", "lang", "text"))
    low = F.pmod("h", F.lit(1 << 30))
    share = F.least(F.lit(1.0), F.lit(4.0 * p.per_label) / F.count(F.lit(1)))
    under = hashed.select("lang", "h").distinct().groupBy("lang").agg(F.greatest(F.min(low), (share * F.lit(float(1 << 30))).cast("long")).alias("under"))  # one row a label
    near = hashed.join(F.broadcast(under), "lang").where(low <= F.col("under")).dropDuplicates(["key", "lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "key"))
    chosen = near.withColumn("r", rank).where(F.col("r") <= p.per_label)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = counts(text or "", p.bits)
                if n is not None:
                    at = np.flatnonzero(n)
                    out.append((h, lang, at.astype("<u4").tobytes(), n[at].astype("<u4").tobytes()))
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["h", "lang", "at", "n"])

    data = []
    for r in sorted(chosen.select("h", "lang", "text").mapInArrow(sample, "h long, lang string, at binary, n binary").collect(), key=lambda r: (r.h, r.lang, r.at, r.n)):
        data.append((r.lang, np.frombuffer(r.at, "<u4"), np.frombuffer(r.n, "<u4")))
    return fit(data, idf, p) if data else None


def identified(docs: DataFrame, p: LangId = LangId()) -> DataFrame:  # noqa: B008
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    A third of the ids is held out from training.  Null texts and texts without a letter
    are ``und`` with score 0, and so is everything if no training row has a label; a null
    id counts as the empty text.  Predictions use the text alone.
    """
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"), "lang")
    model = train(rows.where("not held_out").select(F.col("doc_id").alias("key"), "text", "lang"), p)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows, a column a label

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for text in batch.column(2):
                n = counts(text.as_py() or "", p.bits) if m else None
                out.append(("und", 0.0) if n is None else m.predict(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
