"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character runs of one to four (letters lower-cased, everything else one space) are hashed into 2 ** 17
columns; a document's vector is (1 + ln tf) * idf at unit length. The weights are trained by
follow-the-regularised-leader with per-coordinate steps and an elastic-net penalty (most stay zero), then one
temperature is fitted on rows kept apart, so that scores are probabilities.

The document frequencies behind the idf are counted over all training rows, summed by column in each task first. The
weights are fitted on at most `sample` different texts (a documented bound), each language's share of them chosen by
a hash of the text, so that copies of one text and rows without a letter take up no places and a rare language keeps
its own. Prediction reads every whole text in one scan without a shuffle.

Null texts and texts without a letter get `und` with score 0; without any usable training row all rows do. Ids are
never looked at in training, so null and repeated ids are rows like others. Of equal texts with several languages
each language counts. Very long texts are read in batches of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import crc_of_id, give_back, mixed, pick, small_batches, views

COLUMNS, ORDERS = 1 << 17, 4
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed columns and their frequencies; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters()[code]
    if not known.any():
        return None
    code = np.where(known, code, 32)
    code = code[known | np.append(True, known[:-1])].astype(np.uint64)  # a run of others is one space
    code = np.concatenate([[np.uint64(32)], code, [np.uint64(32)]])
    key, parts = np.zeros(len(code), np.uint64), []
    for n in range(1, ORDERS + 1):
        key = key[: len(code) - n + 1] * np.uint64(0x110000 + 1) + code[n - 1 :]
        parts.append(mixed(key + np.uint64(n)) % np.uint64(COLUMNS))
    flat = np.concatenate(parts).astype(np.int64)
    if len(flat) > COLUMNS // 8:
        n = np.bincount(flat, minlength=COLUMNS)
        at = np.flatnonzero(n)
        return at, n[at]
    return np.unique(flat, return_counts=True)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for softmax regression with an elastic net."""

    def __init__(self, columns: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z = np.zeros((columns, classes))
        self.n = np.zeros((columns, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        step = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / step)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        slope = softmax(x @ w)
        slope[label] -= 1
        g = x[:, None] * slope
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    def __init__(self, classes: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.classes, self.idf, self.weights, self.temperature = classes, idf, weights, temperature

    def logits(self, grams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, x = vector(self.idf, *grams)
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or (grams := gram_counts(text)) is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(grams) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], min(1.0, float(p[k]))


def vector(idf: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (1 + np.log(n)) * idf[at]
    return at, (x / max(1e-12, np.sqrt(x @ x))).astype(np.float32)


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 3, seed: int = 7) -> Model:
    """rows: language, columns, frequencies. Every fifth row is for the temperature alone."""
    classes = sorted({r[0] for r in rows})
    if not classes:
        return Model([], idf, np.zeros((COLUMNS, 0), np.float32), 1.0)
    data = [(classes.index(y), *vector(idf, at, n)) for y, at, n in rows]
    apart = data[::5] if len(data) >= 20 else data
    train = [d for i, d in enumerate(data) if i % 5] if len(data) >= 20 else data
    ftrl, order = Ftrl(COLUMNS, len(classes)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(train)):
            y, at, x = train[i]
            ftrl.learn(at, x, y)
    weights = ftrl.weights().astype(np.float32)
    logits = np.array([x @ weights[at] for _, at, x in apart], np.float64)
    label = np.array([y for y, _, _ in apart])
    # a set without errors would ask for certainty; one more error than seen is supposed instead
    target = np.full(logits.shape, 1 / (len(label) + 2) / max(1, len(classes) - 1))
    target[np.arange(len(label)), label] = 1 - 1 / (len(label) + 2)
    loss = lambda t: -(target * np.log(np.maximum(softmax(logits / t), 1e-12))).sum(1).mean()
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 200))
    return Model(classes, idf, weights, float(min(grid, key=loss)))


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of rows(text) each column occurs, and the number of texts with a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(COLUMNS + 1, np.int64)  # the last one counts the texts
        for batch in small_batches(batches, "text"):
            for x in batch.column(0).to_pylist():
                if grams := gram_counts(x):
                    df[grams[0]] += 1
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["at", "n"])

    got = rows.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # COLUMNS + 1 rows at most
    df = np.zeros(COLUMNS + 1)
    df[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return df[:-1], int(df[-1])


def train(docs: DataFrame, sample: int = 4000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits on at most `sample` rows of docs; the caller leaves out what must not be learnt from."""
    rows = pick(docs, text, lang).toDF("text", "lang").where("text is not null and lang is not null")
    mark = F.xxhash64(F.lit(11), "text").alias("mark")
    usable = rows.where(F.col("text").rlike(r"\p{L}"))
    counts = usable.select("lang", mark).distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()  # a language takes one place at least
    quota = share_out([r["count"] for r in counts], sample)
    # marks are spread evenly, so a share of their range has about that share of a language's texts
    limits = [(r.lang, q / r["count"] * 2.0**64 - 2.0**63) for r, q in zip(counts, quota, strict=True)]
    shares = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, most double"))  # `sample` rows at most

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in small_batches(batches, "text"):
            out = []
            for x, y, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (y, m) not in seen and (found := gram_counts(x)):
                    seen.add((y, m))
                    out.append((y, m, found[0].astype("<i4").tobytes(), found[1].astype("<i4").tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["lang", "mark", "at", "n"])

    # about `sample` rows come back, give or take the spread of hashes
    found = usable.select("text", "lang", mark).join(shares, "lang").where("mark <= most").select("text", "lang", "mark")
    got = found.mapInArrow(grams, "lang string, mark long, at binary, n binary").dropDuplicates(["lang", "mark"]).toArrow()
    order = sorted(range(got.num_rows), key=list(zip(got.column("mark").to_pylist(), got.column("lang").to_pylist(), strict=True)).__getitem__)[:sample]
    labels, at, n = got.column("lang").to_pylist(), views(got.column("at"), "<i4"), views(got.column("n"), "<i4")
    model = fit([(labels[i], at[i], n[i]) for i in order], inverse_frequency(*document_frequencies(rows)))
    del got, at, n
    give_back()
    return model


def share_out(counts: list[int], total: int) -> list[int]:
    """Places for languages with so many texts: equal shares, and what some don't need goes to the others."""
    out, places = [0] * len(counts), total
    for k, i in enumerate(sorted(range(len(counts)), key=counts.__getitem__)):
        out[i] = min(counts[i], places // (len(counts) - k))
        places -= out[i]
    return out


def predicted(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # COLUMNS x languages, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out = [shared.value.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(docs: DataFrame, doc_id: str = "doc_id"):
    return F.coalesce(crc_of_id(docs[doc_id]) % 3 == 1, F.lit(False))
