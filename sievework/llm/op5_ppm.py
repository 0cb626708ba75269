"""Language-model scoring by prediction by partial matching, beside a smoothed unigram base.

The model codes the bytes of the lower-cased words, one space between them and a newline as the end. Its trie
of byte contexts is pretrained on the training rows: all counts come from the runs of `order` + 1 bytes, summed
over the corpus. A byte is coded in the longest known context; an unseen byte escapes (method D: half a count of
each distinct byte goes to the escape) to the next shorter one, where the bytes of the longer context are excluded, down to
all 256 bytes. So each text has a proper probability. The order is the same for every corpus, and the trie is never
in one place. The runs lie in a table, dealt out by a hash of the DEEP bytes before the coded one, so that one part has all
longer contexts of its bytes as sorted arrays, at most 65,536 runs of any DEEP bytes. A byte that is not found there goes on,
with the set of bytes that it must not be, to parts dealt by the NEAR bytes before it, where the runs of DEEP bytes lie:
again at most 65,536 in a part, which is copied for as many shares of the questions as there are. The levels below are the
same for all parts (65,536 runs of two bytes at most). The values of the `runs` most frequent runs are broadcast. What a
document has besides is counted by run, valued in the parts and joined to it by a shuffle.

bits_per_byte is the code length by the coded bytes (the end is one), so that texts of different lengths compare.

Word counts of the whole corpus are joined to each document's words: the `head` most frequent words in the scan
(a fixed number of short words, and the few longer ones that are hot), all others by a shuffle join.

Null text counts as empty: the end token alone. Repeated rows and null ids each keep their row (a null id is
not held out). Without training rows the model is uniform over bytes and the base has no counts; the base of an
empty training set is log10(0.1 / 0.1) a token.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import common_words, crc_of_id, give_back, low_words, mixed, most_frequent, pick, small_batches, written

ORDER, RUNS, HEAD, FLUSH = 5, 2_000_000, 150_000, 200_000
SLOTS = 1 << 20
DEEP, NEAR = 4, 2  # bytes before the coded one that deal out the runs
#: Questions in a share of the second parts, and most of the shares.
SHARE, MOST_SHARES = 4_000_000, 4096


def coded(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def contexts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last order + 1 bytes at each byte of the texts as a number (newlines stand before a text), and the texts' sizes."""
    pad = b"\n" * order
    flat = np.frombuffer(b"".join([pad + t for t in texts]), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    key = flat.copy()
    for k in range(1, order + 1):
        key[k:] |= flat[:-k] << np.uint64(8 * k)
    own = np.ones(len(flat), bool)
    starts = np.cumsum(sizes + order) - sizes - order
    for k in range(order):
        own[starts + k] = False
    return key[own], sizes


def low(x: np.ndarray, bytes_: int) -> np.ndarray:
    return x & np.uint64((1 << 8 * bytes_) - 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if not len(x) or x.max() < 1 << 31 else x


class Level:
    """Pairs (context, byte) and contexts of one length, sorted."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, length: int):
        self.pairs, self.counts, self.length = pairs, narrow(counts), length
        context = pairs >> np.uint64(8)
        self.first = np.flatnonzero(np.diff(context, prepend=context[:1] ^ np.uint64(1)) != 0) if len(pairs) else np.empty(0, np.int64)
        self.contexts = context[self.first]
        self.total = narrow(np.add.reduceat(counts, self.first) if len(pairs) else counts)
        self.distinct = np.diff(np.append(self.first, len(pairs))).astype(np.int32)
        self.below = np.zeros(len(self.contexts), np.int32)  # what its bytes count in the next shorter context


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Values:
    """Values of runs; those met before come from a table of fixed size."""

    slot_keys = slot_values = None

    def values(self, key: np.ndarray) -> np.ndarray:
        if self.slot_keys is None:
            self.slot_keys, self.slot_values = np.zeros(SLOTS, np.uint64), np.full(SLOTS, np.nan)
        slot = (mixed(key) >> np.uint64(64 - 20)).astype(np.int64)
        value = np.where(self.slot_keys[slot] == key, self.slot_values[slot], np.nan)
        missed = np.flatnonzero(np.isnan(value))
        if len(missed):
            new, back = np.unique(key[missed], return_inverse=True)
            made = self.evaluate(new)
            value[missed] = made[back]
            at = (mixed(new) >> np.uint64(64 - 20)).astype(np.int64)
            self.slot_keys[at], self.slot_values[at] = new, made
        return value


class Head(Values):
    """Known values of some runs; nan for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.known = keys[order], values[order]

    def evaluate(self, keys: np.ndarray) -> np.ndarray:
        at, known = found(self.keys, keys)
        return np.where(known, self.known[at] if len(self.keys) else np.nan, np.nan)


class Ppm(Values):
    """The trie of some runs. With `base`, the trie of the shortest contexts of the whole corpus, the runs are all those
    that end in some contexts one byte longer than the base's, and only these contexts are asked for; with `least`
    instead, contexts below that length are left to others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, base: Ppm | None = None, least: int = 0):
        self.order = order
        self.levels: list[Level] = [None] * (order + 1)
        self.least = len(base.levels) if base else least
        for j in range(order, self.least - 1, -1):
            keys, counts = summed(low(keys, j + 1), counts)
            self.levels[j] = Level(keys, counts, j)
        if base:
            self.levels[: self.least] = base.levels
        for j in range(order, max(self.least if base else least + 1, 1) - 1, -1):
            up, down = self.levels[j], self.levels[j - 1]
            if len(up.pairs):
                up.below = narrow(np.add.reduceat(down.counts[np.searchsorted(down.pairs, low(up.pairs, j))].astype(np.int64), up.first))
        self.least = 0 if base else least

    def evaluate(self, keys: np.ndarray) -> np.ndarray:
        """log10 P(last byte | bytes before) for each key."""
        out, going, gone_n, gone_q = self.descend(keys)
        out[going] -= np.log10(256 - gone_q[going])
        return out

    def descend(self, keys: np.ndarray, known_bytes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the levels down to the least say of each key, which keys have no answer yet, and what is gone for them.

        known_bytes: for each key the bytes it can't be, 256 bits, from levels above these."""
        out = np.zeros(len(keys))
        gone_n, gone_q = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if known_bytes is not None:
            gone_n, gone_q = self.counted(keys, known_bytes), np.bitwise_count(known_bytes).sum(1).astype(np.int64)
        going = np.arange(len(keys))
        for j in range(self.order, self.least - 1, -1):
            level = self.levels[j]
            at, known = found(level.contexts, low(keys[going], j + 1) >> np.uint64(8))
            pair, seen = found(level.pairs, low(keys[going], j + 1))
            n = np.where(known, level.total[at] if len(level.contexts) else 0, 0).astype(np.int64) - gone_n[going]
            q = np.where(known, level.distinct[at] if len(level.contexts) else 0, 0) - gone_q[going]
            use = known & (q > 0)
            every = np.where(use, 2 * n, 1)
            top = np.where(seen, 2 * level.counts[pair].astype(np.int64) - 1 if len(level.pairs) else 0, q)
            out[going[use]] += np.log10(top[use] / every[use])
            gone_n[going] = np.where(known, level.below[at] if len(level.contexts) else 0, 0)
            gone_q[going] = np.where(known, level.distinct[at] if len(level.contexts) else 0, 0)
            going = going[~seen]
        return out, going, gone_n, gone_q

    def _entries(self, level: Level, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all pairs in each key's context, and whose they are."""
        bits = np.uint64(8)
        context = low(keys, level.length + 1) >> bits
        start, stop = np.searchsorted(level.pairs >> bits, context, "left"), np.searchsorted(level.pairs >> bits, context, "right")
        times = stop - start
        owner = np.repeat(np.arange(len(keys)), times)
        return np.repeat(start - np.cumsum(times) + times, times) + np.arange(len(owner)), owner

    def counted(self, keys: np.ndarray, known_bytes: np.ndarray) -> np.ndarray:
        """What the given bytes count in each key's longest context here."""
        level = self.levels[self.order]
        at, owner = self._entries(level, keys)
        byte = (level.pairs[at] & np.uint64(255)).astype(np.int64)
        inside = known_bytes[owner, byte >> 6] >> (byte & 63).astype(np.uint64) & np.uint64(1)
        return np.bincount(owner, level.counts[at] * inside.astype(np.int64), len(keys)).astype(np.int64)

    def bytes_seen(self, keys: np.ndarray) -> np.ndarray:
        """The bytes of each key's shortest context here, as four words of 64 bits."""
        level = self.levels[self.least]
        at, owner = self._entries(level, keys)
        byte = (level.pairs[at] & np.uint64(255)).astype(np.int64)
        out = np.zeros((len(keys), 4), np.uint64)
        np.bitwise_or.at(out, (owner, byte >> 6), np.uint64(1) << (byte & 63).astype(np.uint64))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 of each text's probability."""
        key, sizes = contexts(texts, self.order)
        ends = np.cumsum(sizes)
        return np.add.reduceat(self.values(key), ends - sizes) if len(sizes) else np.zeros(0)


def word_table(train: DataFrame) -> DataFrame:
    """(word, n) over train(text), without the end token."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in small_batches(batches, "text"):
            for x in batch.column(0).to_pylist():
                seen.update(low_words(x))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return train.mapInArrow(gather, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def run_table(train: DataFrame, order: int) -> DataFrame:
    """(key, n): how often each run of order + 1 coded bytes occurs."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], ["key", "n"])
        for batch in small_batches(batches, "text"):
            key, _ = contexts([coded(low_words(x)) for x in batch.column(0).to_pylist()], order)
            new, n = np.unique(key, return_counts=True)
            keys, counts, held = [*keys, new], [*counts, n.astype(np.int64)], held + len(new)
            if held > 4 * FLUSH:
                k, n = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [k], [n], len(k)
                if held > 3 * FLUSH:
                    yield out()
                    keys, counts, held = [], [], 0
        if keys:
            k, n = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts = [k], [n]
            yield out()

    return train.mapInArrow(gather, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _runs(got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()


def in_context(runs: DataFrame) -> DataFrame:
    """runs(key, n) with the count of each run's context, `total`; a context has 256 runs at most."""
    return runs.withColumn("total", F.sum("n").over(Window.partitionBy(F.shiftrightunsigned("key", 8))))


def top_values(table: DataFrame, runs: int) -> Head:
    """The values of the most frequent runs of table(key, n, total), at most `runs` of them."""
    got = most_frequent(table, "n", runs).toArrow()
    keys, n = _runs(got)
    head = Head(keys, np.log10((2 * n - 1) / (2 * got.column("total").to_numpy())))  # the longest context has them
    del got, keys, n
    give_back()
    return head


def _gathered(batches: Iterator[pa.RecordBatch], columns: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The runs of a part with their counts, and the columns of the questions (rows with n = 0)."""
    keys, counts, asked = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], {c: [] for c in columns}
    for batch in batches:
        key, n = _runs(pa.table(batch))
        keys.append(key[n > 0])
        counts.append(n[n > 0])
        for c in columns:
            asked[c].append(pa.table(batch).column(c).to_numpy()[n == 0])
    return np.concatenate(keys), np.concatenate(counts), {c: np.concatenate(x) if x else np.empty(0) for c, x in asked.items()}


def run_values(table: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """(key, value) for the runs asked(key), which are distinct, in the trie of table(key, n)."""
    spark, words = table.sparkSession, ["w0", "w1", "w2", "w3"]
    near, deep = min(NEAR, order), DEEP if order >= DEEP else None
    last = lambda k: F.shiftrightunsigned("key", 8).bitwiseAND((1 << 8 * k) - 1)
    shorter = lambda k: table.groupBy(F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")).agg(F.sum("n").alias("n"))
    base = None
    if near:  # 256 ** near rows at most
        base = spark.sparkContext.broadcast(Ppm(*_runs(shorter(near).toArrow()), near - 1))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, asked = _gathered(batches, ["key"])
        want = asked["key"].astype(np.int64).view(np.uint64)
        if not len(want):
            return
        ppm = Ppm(keys, counts, order, least=deep)
        for i in range(0, len(want), FLUSH):
            own = want[i : i + FLUSH]
            out, going, _, _ = ppm.descend(own)
            seen = np.zeros((len(own), 4), np.uint64)
            seen[going] = ppm.bytes_seen(own[going])
            done = np.ones(len(own), bool)
            done[going] = False
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(out), pa.array(done), *(pa.array(seen[:, k].view(np.int64)) for k in range(4))], ["key", "value", "done", *words])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, asked = _gathered(batches, ["key", "value", *words])
        want = asked["key"].astype(np.int64).view(np.uint64)
        if not len(want):
            return
        gone = np.stack([asked[w].astype(np.int64).view(np.uint64) for w in words], 1)
        ppm = Ppm(keys, counts, deep - 1 if deep else order, base.value if base else None)
        for i in range(0, len(want), FLUSH):
            own = want[i : i + FLUSH]
            out, going, _, gone_q = ppm.descend(own, gone[i : i + FLUSH])
            out[going] -= np.log10(256 - gone_q[going])
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(out + asked["value"][i : i + FLUSH])], ["key", "value"])

    nothing = [F.lit(0).cast("long").alias(w) for w in words]
    if deep is None:
        table_near, left = table.select("key", "n"), asked.select("key", F.lit(0.0).alias("value"), *nothing)
    else:
        both = table.select("key", "n").unionByName(asked.select("key", F.lit(0).cast("long").alias("n")))
        went = written(both.repartition(F.xxhash64(last(deep))).mapInArrow(first, "key long, value double, done boolean, " + ", ".join(f"{w} long" for w in words)), "deep-values")
        table_near, left = shorter(deep), went.where("not done").select("key", "value", *words)
    shares = max(1, min(MOST_SHARES, -(-left.count() // SHARE)))
    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    rows = table_near.select("key", "n", F.lit(0.0).alias("value"), *nothing, share.alias("share"))
    rows = rows.unionByName(left.select("key", F.lit(0).cast("long").alias("n"), "value", *words, F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int").alias("share")))
    rest = rows.repartition(last(near), "share").drop("share").mapInArrow(second, "key long, value double")
    return rest if deep is None else went.where("done").select("key", "value").union(rest)


def unvalued(key: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each text the runs without a value, with their frequencies."""
    at = np.flatnonzero(np.isnan(value))
    text, key = np.searchsorted(np.cumsum(sizes), at, side="right"), key[at].view(np.int64)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(key) != 0))) if len(at) else at
    times = np.diff(np.append(first, len(at)))
    ends = np.searchsorted(text[first], np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(key[first]), pa.array(times)], ["key", "n"]))


def scored(docs: DataFrame, train: DataFrame, order: int = ORDER, runs: int = RUNS, head: int = HEAD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row for each row of docs."""
    spark = docs.sparkSession
    context = spark.sparkContext
    train = pick(train, text).toDF("text").select(F.coalesce("text", F.lit("")).alias("text"))
    words = written(word_table(train), "words")
    trie = written(in_context(run_table(train, order)), "byte-runs")
    model = context.broadcast(top_values(trie, runs))
    ends = train.count()
    sums = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    total, distinct = (sums.n or 0) + ends, sums.v + (ends > 0)
    floor = total + 0.1 * (distinct + 1)
    log = lambda c: math.log10((c + 0.1) / floor)
    top = common_words(words, "word", "n", head).toArrow()
    shared = context.broadcast(dict(zip(top.column("word").to_pylist(), map(log, top.column("n").to_pylist()), strict=True)))
    end, end_known = log(ends), int(ends > 0)

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ppm = shared.value, model.value
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in small_batches(batches, "text", 1 << 20):
            split = [low_words(x) for x in batch.column(2).to_pylist()]
            base, here, rest = [], [], []
            for own in split:
                values = list(map(known.get, own))
                late = Counter(w for w, v in zip(own, values, strict=True) if v is None) if None in values else {}
                base.append(math.fsum(v for v in values if v is not None) + end)
                here.append(len(own) - sum(late.values()) + end_known)
                rest.append([{"word": w, "n": n} for w, n in late.items()])
            key, sizes = contexts([coded(x) for x in split], order)
            value = ppm.values(key)
            score = np.add.reduceat(np.nan_to_num(value, nan=0.0), np.cumsum(sizes) - sizes)
            columns = [pa.array([len(x) + 1 for x in split], pa.int64()), pa.array(here, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(rest, kind), unvalued(key, value, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), *columns], ["row", "doc_id", "n_bytes", "n_tokens", "known", "base", "score", "rest", "runs"])

    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    result = f"row long, doc_id {kind}, n_bytes long, n_tokens long, known long, base double, score double, rest array<struct<word: binary, n: long>>, runs array<struct<key: long, n: long>>"
    reduced = written(rows.mapInArrow(per_document, result), "word-frequencies")
    late = reduced.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.n").alias("times")).join(words, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    late = late.select("row", (F.col("times") * F.log10((c + 0.1) / floor)).alias("base"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"), F.lit(0.0).alias("score"))
    runs_left = reduced.select("row", F.explode("runs").alias("r")).select("row", "r.key", F.col("r.n").alias("times"))
    valued = runs_left.join(run_values(trie, runs_left.select("key").distinct(), order), "key")
    late = late.unionByName(valued.select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("times") * F.col("value")).alias("score")))
    parts = late.groupBy("row").agg(F.sum("base").alias("late_base"), F.sum("known").alias("late_known"), F.sum("score").alias("late_score"))
    out = reduced.drop("rest", "runs").join(parts, "row", "left")
    score = F.col("score") + F.coalesce("late_score", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens",
        (F.col("known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("late_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def held_out(docs: DataFrame, doc_id: str = "doc_id"):
    return F.coalesce(crc_of_id(docs[doc_id]) % 10 == 0, F.lit(False))
