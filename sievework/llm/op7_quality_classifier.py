"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One score s = w . x is shared by all grades, and ordered thresholds t1 < t2 < ... cut it:
P(grade >= k) = sigmoid(s - t_k). This gives the expected grade and the tail probability that selects.

x is hashed text: each distinct word (lower-cased, without punctuation) counts 1 whatever the length, so that a
single bad word tells, and so do the first five letters of longer ones; word shapes (letters to one sign, digits to another, runs collapsed, punctuation kept)
and repeated neighbours and 5-word runs count by their share of the text. Weights are trained by
follow-the-regularised-leader with an elastic net, so words seen a few times keep no weight.

The classifier is fitted on `sample` labelled rows (a fixed number, chosen by a hash of the id), whose features are mapped
from the driver's disk; scoring reads every whole text in one scan without a shuffle. Null texts have null grades and are not kept; empty texts are
scored as texts without features. Repeated labels of an id count as its lowest grade. Without labels all
texts get the middle of the scale and are kept. Repeated rows and null ids are rows like others.
"""

from __future__ import annotations

import mmap
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Remembered, discard, give_back, pick, shingle_hashes, small_batches, written_in_batches

COLUMNS = 1 << 18
SHARE = 4.0
START = 5
#: Thresholds stay so far apart at least, so that no grade's probability vanishes.
GAP = 0.02
#: As many bytes of features come to the driver at a time, on average.
PIECE = 16 << 20
LETTERS = re.compile(r"[^\W\d_]+")
OTHERS = re.compile(r"([^\w])\1+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def column(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % COLUMNS


def word_columns(word: str) -> int:
    """The columns of a word's beginning, its shape and itself, in one number; 0 for a word without letters."""
    core = EDGES.sub("", word).lower()
    shape = re.sub(r"\d+", "0", LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word))
    shape = OTHERS.sub(r"\1\1", shape)[:12]
    start = column("start " + core[:START]) + 1 if len(core) > START else 0
    return start << 38 | column("shape " + shape) << 19 | (column("word " + core) + 1 if core else 0)


class Features:
    def __init__(self):
        self.words = Remembered(word_columns)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted columns and values."""
        self.words.trim()
        words = text.split()
        n = len(words)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.float32)
        code = np.fromiter(map(self.words.__getitem__, words), np.int64, n)
        present = np.unique(np.concatenate([code & 0x7FFFF, code >> 38]))
        present = present[present > 0] - 1
        shape, times = np.unique(code >> 19 & 0x7FFFF, return_counts=True)
        mark = code.astype(np.uint64)
        runs = np.unique(shingle_hashes(mark, 5))
        more = np.array([(mark[1:] == mark[:-1]).sum() / n, 1 - len(runs) / max(1, n - 4)], np.float32)
        at = np.concatenate([present, shape, [column("repeat word"), column("repeat run")]])
        x = np.concatenate([np.ones(len(present), np.float32), SHARE * times.astype(np.float32) / n, SHARE * more])
        at, back = np.unique(at, return_inverse=True)
        return at, np.bincount(back, x, len(at)).astype(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights, bias-free; thresholds[k - 1] is t_k."""

    def __init__(self, grades: int, weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def tails(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return sigmoid(x @ self.weights[at] - self.thresholds)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, epochs: int = 8, seed: int = 5, alpha: float = 0.6, l1: float = 3.0, l2: float = 0.05) -> Ordinal:
    z, n = np.zeros(COLUMNS), np.zeros(COLUMNS)
    thresholds, seen = np.linspace(-0.5, 0.5, grades - 1) if grades > 2 else np.zeros(grades - 1), np.full(grades - 1, 1.0)

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((1 + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            grade, at, x = rows[i]
            w = weights(at)
            tail = sigmoid(x @ w - thresholds)
            upper = np.append(1.0, tail)[grade]  # P(>= grade)
            lower = np.append(tail, 0.0)[grade]  # P(>= grade + 1)
            # d/ds of -log(upper - lower), and the same for the two thresholds next to the grade
            p = max(upper - lower, 1e-9)
            up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
            g = x * (down - up)
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
            for k, slope in ((grade - 1, up), (grade, -down)):
                if 0 <= k < grades - 1:
                    seen[k] += slope * slope
                    thresholds[k] -= 0.1 * slope / np.sqrt(seen[k])
            if (thresholds[1:] < thresholds[:-1] + GAP).any():  # only where the order would be lost
                thresholds = np.maximum.accumulate(thresholds - GAP * np.arange(grades - 1)) + GAP * np.arange(grades - 1)
    return Ordinal(grades, weights(slice(None)).astype(np.float32), thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for toxic, 1 for poor, 2 for good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


class Held:
    """Arrays by key in a temporary file that is mapped, so that a sample of long texts takes disk and no memory."""

    def __init__(self):
        self.file, self.places, self.size, self.map = tempfile.TemporaryFile(), {}, 0, None

    def put(self, key: int, at: bytes, x: bytes) -> None:
        """Columns and values; a key that is there has the same ones."""
        if key not in self.places:
            self.places[key] = self.size, len(at)
            self.size += self.file.write(at) + self.file.write(x)

    def get(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        start, n = self.places[key]
        if not n:
            return np.empty(0, "<i4"), np.empty(0, "<f4")
        if self.map is None:
            self.file.flush()
            self.map = mmap.mmap(self.file.fileno(), self.size, access=mmap.ACCESS_READ)
        return np.frombuffer(self.map, "<i4", n // 4, start), np.frombuffer(self.map, "<f4", n // 4, start + n)


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> Ordinal:
    """Fits on at most `sample` rows of ratings(doc_id, grade) and their texts."""
    mark = F.xxhash64(F.col("doc_id").cast("string"), F.lit(13))
    chosen = ratings.orderBy(mark, "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in small_batches(batches, "text"):
            found = [(at.astype("<i4").tobytes(), x.astype("<f4").tobytes()) for at, x in map(make.of, batch.column(0).to_pylist())]
            order = pa.array([xxhash.xxh3_64_intdigest(at + x) - (1 << 63) for at, x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), order, pa.array([at for at, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["grade", "order", "at", "x"])
        make.words.clear()
        give_back()

    rows = pick(docs, doc_id, text).toDF("doc_id", "text").where("text is not null")
    # `sample` ids and grades are broadcast at most
    made = rows.join(F.broadcast(chosen), "doc_id").select("text", "grade").mapInArrow(features, "grade int, order long, at binary, x binary")
    made = written_in_batches(made, "features")
    # the same order whatever task gave a row; the limit holds if ids are repeated in docs
    first = made.select("order", "grade").orderBy("order", "grade").limit(sample).toArrow()
    keys = sorted(zip(first.column("order").to_pylist(), first.column("grade").to_pylist(), strict=True))
    n, size = made.agg(F.count("*"), F.coalesce(F.sum(2 * F.length("at")), F.lit(0))).first()
    left = made.select("order", "at", "x")
    if n > sample:
        left = left.where(F.col("order") <= keys[-1][0]).dropDuplicates(["order"])
    # neither a task nor the driver's JVM has the features of all rows at once: they grow with the length of the texts
    held = Held()
    for order, at, x in left.repartition(-(-size // PIECE) or 1).toLocalIterator():
        held.put(order, at, x)
    discard(made)
    model = fit([(grade, *held.get(order)) for order, grade in keys], grades)
    del held
    give_back()
    return model


def scored(docs: DataFrame, model: Ordinal, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_at_least, kept): kept where the tail probability of the top grade is `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # COLUMNS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, m = Features(), shared.value
        for batch in small_batches(batches, "text"):
            tails = [None if x is None else m.tails(*make.of(x)) for x in batch.column(1).to_pylist()]
            grade = pa.array([None if t is None else float(t.sum()) for t in tails], pa.float64())
            p = pa.array([None if t is None else t.tolist() for t in tails], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), grade, p, pa.array([t is not None and bool(t[-1] >= least) for t in tails], pa.bool_())], ["doc_id", "expected_grade", "p_at_least", "kept"])

    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_at_least array<double>, kept boolean")


def selected(docs: DataFrame, model: Ordinal, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose verdict is kept. Whole rows pass through, so no key is needed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, m = Features(), shared.value
        for batch in small_batches(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([x is not None and bool(m.tails(*make.of(x))[-1] >= least) for x in texts], pa.bool_()))
        make.words.clear()
        give_back()

    return docs.mapInArrow(run, docs.schema)

