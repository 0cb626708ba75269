"""Grouped prefix join: all pairs of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more.

1. `set_table`: a scan reduces each document to the size and digest of its shingle set. Documents with equal sets are
   one item. It also finds frequent shingles: counts of chunks are summed where a chunk has a shingle twice.
2. `posted`: in one order for all (rare by hash first, the frequent ones last) two sets can only be similar if their
   prefixes of n - ceil(0.75 n) + 1 shingles meet. Items with an identical prefix and size form a group, and
   only groups are posted under their prefix shingles, each with its place in the order.
3. `blocks_of`: posting lists of one group go away at once. The others, and groups of several items, are expanded into
   blocks of items. Two sets whose first common shingle stands at the places i and j share at most
   min(n_a - i, n_b - j) shingles, so a pair is only taken from a block where that can still be enough, and a
   block of shingles that stand late in all of its items gives no pair.
4. `small_pairs`, `hub_pairs`: blocks of at most `block` items give their pairs, filtered by size, place and the number of
   prefix shingles that they share; a larger block gives the pairs with a few hubs, more for larger ones (a logarithm).
5. `linked` verifies pairs exactly on the whole sets. `late_links`: where a larger block still has several
   components, each item outside the largest is compared with the items of the other components: as pairs, or in blocks
   of more than CELL_ROWS items in cells. Such a block is cut by set size and then into cells of bounded bytes, and a
   task compares the sets of two cells without a row for each pair; at most as many links as it has items leave it.
   So no link between components is lost, and no block emits all its pairs once its items are linked.

Sets are of 64-bit shingle hashes, digests have 128 bits. Rows are known by hashes of their id and text, never by a row
number, so an input that is computed anew in another order (behind a shuffle, after a lost executor) gives the same.

Null and empty texts have no shingles and no links; texts of fewer than five words have one shingle, the whole sequence.
Repeated rows and null ids each keep their row; a component of null ids alone has a null id. An empty table gives an
empty result. Other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import Remembered, discard, give_back, low_words, most_frequent, pick, shingle_hashes, small_batches, written, written_in_batches
from sievework.operators.graph import connected_components

SHINGLE, PERCENT = 5, 75
FREQUENT, MOST_FREQUENT, CHUNK = 9, 1_000_000, 2_000_000
BLOCK = 8
#: Cells of the comparison in larger blocks: items and bytes at most; sets whose sizes differ by this factor are apart.
CELL_ROWS, CELL_BYTES, BAND = 512, 8 << 20, 1.15
#: As many row keys are broadcast at most; beyond that the join is shuffled.
BROADCAST_ROWS = 2_000_000


class Shingles:
    def __init__(self, size: int):
        self.size, self.words = size, Remembered(xxhash.xxh3_64_intdigest)

    def of(self, text: str | None) -> np.ndarray:
        """The sorted set."""
        words = low_words(text)
        if not words:
            return np.empty(0, np.uint64)
        self.words.trim()
        return np.unique(shingle_hashes(np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words)), self.size))


def prefix_size(n, percent: int):
    return n - -(-percent * n // 100) + 1


def prefix_of(shingles: np.ndarray, frequent: np.ndarray, times: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first n - ceil(percent n) + 1 shingles: the infrequent by hash, then the frequent (sorted by hash) by times;
    and how many of them are infrequent."""
    size, n_rare = prefix_size(len(shingles), percent), len(shingles)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        late = frequent[at] == shingles
        if late.any():
            last = shingles[late]
            n_rare -= len(last)
            shingles = np.concatenate([shingles[~late], last[np.lexsort((last, times[at[late]]))]])
    return shingles[:size], min(size, n_rare)


def _sized(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _overlap(n_a: Column, n_b: Column, percent: int) -> Column:
    """How many shingles two similar sets of these sizes share at least."""
    return F.ceil((n_a + n_b) * percent / (100 + percent) - 1e-9)


def _first_here(a: str, b: str, percent: int) -> Column:
    """Whether a pair can be similar whose first common shingle is that of this block."""
    c = F.col
    return F.least(c(f"{a}.n") - c(f"{a}.place"), c(f"{b}.n") - c(f"{b}.place")) >= _overlap(c(f"{a}.n"), c(f"{b}.n"), percent)


def _least_shared(a: str, b: str, percent: int) -> Column:
    """How many prefix shingles two similar sets share at least: the overlap they need, without what can lie behind
    the prefixes. It may be 0 or less for sets of different sizes."""
    behind = F.greatest(F.col(f"{a}.n") - F.col(f"{a}.p"), F.col(f"{b}.n") - F.col(f"{b}.p"))
    return _overlap(F.col(f"{a}.n"), F.col(f"{b}.n"), percent) - behind


def _enough(a: str, b: str, percent: int) -> Column:
    """Whether what two items of a larger block have from it on, and in smaller blocks, can be as many as they must share."""
    return F.least(f"{a}.after", f"{b}.after") + F.least(f"{a}.small", f"{b}.small") >= _least_shared(a, b, percent)


def _leads(percent: int) -> Column:
    """Whether the place allows a partner of the same size or a larger one; without any such item a block has no pair."""
    return F.col("n") - F.col("place") >= _overlap(F.col("n"), F.col("n"), percent)


def _weight(at: str = "") -> Column:
    """Items of one group (kind 1) share their whole prefix, those of another block the one shingle."""
    return F.when(F.col(f"{at}kind") == 1, F.col(f"{at}p")).otherwise(1)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, mark, text_mark): hashes that name a row by what is in it."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    return rows.select("doc_id", "text", *_marks(F.col("doc_id"), F.col("text")))


def _marks(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), text, doc_id.cast("string"), doc_id.isNull()).alias("mark"), F.xxhash64(text, text.isNull()).alias("text_mark")]


def only_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) these keys, on all their columns; broadcast only if they are few."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, keys.columns, how)


def set_table(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, text_mark, n, item) for each row, and (shingle, times) for what a chunk holds more than once."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "mark", "text_mark", "n", "item", "shingle", "times"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, held, n_held, like = Shingles(size), set(), [], 0, None

        def often() -> Iterator[pa.RecordBatch]:
            value, times = np.unique(np.concatenate(held), return_counts=True)
            value, times = value[times >= 2].view(np.int64), times[times >= 2]
            none = [pa.nulls(len(value), t) for t in (like, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(value), pa.array(times, pa.int64())], names)

        for batch in small_batches(batches, "text"):
            like = batch.schema.field(0).type
            sets = [shingles.of(x) for x in batch.column(1).to_pylist()]
            items = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            m = len(sets)
            own = [batch.column(0), batch.column(2), batch.column(3), pa.array([len(x) for x in sets], pa.int64()), pa.array(items, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
            for x, item in zip(sets, items, strict=True):
                if item not in seen:
                    seen.add(item)
                    held.append(x)
                    n_held += len(x)
            if n_held > CHUNK:
                yield from often()
                held, n_held = [], 0
        if held:
            yield from often()
        del held, seen, shingles
        give_back()

    return written_in_batches(rows.mapInArrow(measure, f"doc_id {kind}, mark long, text_mark long, n long, item binary, shingle long, times long"), "sets")


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most MOST_FREQUENT shingles, sorted by hash, and their counts. Any order gives right results."""
    often = sets.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    top = most_frequent(often, "times", MOST_FREQUENT).toArrow()
    value, times = top.column("shingle").to_numpy().view(np.uint64), top.column("times").to_numpy()
    order = np.argsort(value)
    return value[order], times[order]


def posted(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, percent: int) -> DataFrame:
    """(item, n, p, g, mark, rare, prefix): a row for each item of a task, prefix only in the first of its group g; its
    first `rare` shingles are not frequent."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, groups, last = Shingles(size), set(), set(), shared.value
        for batch in small_batches(batches, "text"):
            out = []
            for x, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingles.of(x)
                item = xxhash.xxh3_128_digest(found.tobytes())
                if not len(found) or item in seen:
                    continue
                seen.add(item)
                prefix, rare = prefix_of(found, *last, percent)
                group = xxhash.xxh3_64_intdigest(prefix.tobytes() + len(found).to_bytes(8)) - (1 << 63)
                new = group not in groups
                groups.add(group)
                out.append((item, len(found), len(prefix), group, mark, rare, prefix.view(np.int64) if new else None))
            if out:
                types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["item", "n", "p", "g", "mark", "rare", "prefix"])
        del shingles, seen, groups
        give_back()

    posts = written_in_batches(rows.select("text", "mark").mapInArrow(post, "item binary, n int, p int, g long, mark long, rare int, prefix array<long>"), "prefixes")
    shared.destroy()
    return posts


def blocks_of(posts: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, s, item, n, p, place): the items that meet under a shingle s, or (kind 1) in a group s."""
    each = posts.where("prefix is not null")
    rare = each.select("g", F.posexplode(F.slice("prefix", 1, F.col("rare"))).alias("place", "s"))
    # a shingle that is not frequent has few groups, so a window holds few rows
    s = Window.partitionBy("s")
    rare = rare.withColumn("least", F.min("g").over(s)).withColumn("most", F.max("g").over(s)).where("least <> most").select("s", "g", "place")
    hot = each.where("rare < p").select("g", "rare", F.posexplode(F.slice("prefix", F.col("rare") + 1, F.col("p") - F.col("rare"))).alias("place", "s"))
    lists = rare.union(hot.select("s", "g", F.col("place") + F.col("rare"))).distinct().select(F.lit(0).alias("kind"), "s", "g", "place")
    several = members.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select(F.lit(1).alias("kind"), F.col("g").alias("s"), "g", F.lit(0).alias("place"))
    return written(lists.union(several).join(members.select("g", "item", "n", "p"), "g").select("kind", "s", "item", "n", "p", "place"), "blocks")


def small_pairs(small: DataFrame, in_large: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the blocks of a few items."""
    a, b = small.alias("a"), small.alias("b")
    same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.item") < F.col("b.item"))
    pairs = a.join(b, same & _sized(F.col("a.n"), F.col("b.n"), percent))
    # a pair inside a group shares its whole prefix, whatever else it meets in
    pairs = pairs.groupBy(F.col("a.item").alias("a"), F.col("b.item").alias("b"), _least_shared("a", "b", percent).alias("wanted"))
    pairs = pairs.agg(F.sum(_weight("a.")).alias("shared"), F.max(_first_here("a", "b", percent)).alias("first")).where("first")
    for side in "ab":
        pairs = pairs.join(in_large.select(F.col("item").alias(side), F.col("in_large").alias(f"large_{side}")), side, "left")
    more = F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0)))
    return pairs.where(F.col("shared") + more >= F.col("wanted")).select("a", "b")


def hub_pairs(ranked: DataFrame, block: int, percent: int) -> DataFrame:
    """(a, b) of the larger blocks: each item with the hubs, those that meet most others in each part of the block."""
    parts = F.greatest(F.lit(1), F.lit(1) + F.floor(F.log2(F.col("k") / (8 * block))).cast("int"))
    item = F.struct("in_large", "item", "n", "p", "place", "after", "small")
    hubs = ranked.where(_leads(percent)).groupBy("kind", "s", F.pmod(F.xxhash64("item"), parts).alias("part")).agg(F.max(item).alias("b"))
    pairs = ranked.select("kind", "s", item.alias("a")).join(hubs.select("kind", "s", "b"), ["kind", "s"])
    pairs = pairs.where((F.col("a.item") != F.col("b.item")) & _sized(F.col("a.n"), F.col("b.n"), percent) & _enough("a", "b", percent) & _first_here("a", "b", percent))
    return pairs.select(F.least("a.item", "b.item").alias("a"), F.greatest("a.item", "b.item").alias("b"))


def whole_sets(items: DataFrame, members: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(item, shingles) of these items, each made from one row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(size), set()
        for batch in small_batches(batches, "text"):
            found = [shingles.of(x).tobytes() for x in batch.column(0).to_pylist()]
            items = [xxhash.xxh3_128_digest(x) for x in found]
            new = [i for i, item in enumerate(items) if item not in seen and not seen.add(item)]
            yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in new], pa.binary()), pa.array([found[i] for i in new], pa.binary())], ["item", "shingles"])
        del shingles, seen
        give_back()

    needed = written(members.join(items, "item", "left_semi").select("mark"), "needed")
    full = written_in_batches(only_rows(rows.select("text", "mark"), needed, "left_semi").select("text").mapInArrow(read, "item binary, shingles binary"), "whole-sets")
    if full.count() > needed.count():  # rows that repeat id and text, in several tasks
        repeated, full = full, written(full.dropDuplicates(["item"]), "whole-sets")
        discard(repeated)
    discard(needed)
    return full


def linked(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets full(item, shingles)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                sizes.append((int((y[at] == x).sum()), len(x), len(y)))
            shared, m, n = np.array(sizes, np.int64).reshape(-1, 3).T.copy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(m + n - shared)], ["a", "b", "shared", "united"])
        give_back()

    both = pairs.join(full.select(F.col("item").alias("a"), F.col("shingles").alias("set_a")), "a").join(full.select(F.col("item").alias("b"), F.col("shingles").alias("set_b")), "b")
    sizes = both.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a binary, b binary, shared long, united long")
    return written_in_batches(sizes.where(F.col("shared") * 100 >= F.col("united") * percent).select("a", "b"), "links")


def cell_links(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """(a, b) of two tables (item, component, shingles): links that join components, as many as are needed for that."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    (xs, of_x, sets_x), (ys, of_y, sets_y) = ([t.column(c).to_pylist() for c in ("item", "component", "shingles")] for t in (left, right))
    sets = [np.frombuffer(y, np.uint64) for y in sets_y]
    n = np.array([len(y) for y in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    above: dict[bytes, bytes] = {}

    def top(c: bytes) -> bytes:
        while c in above:
            c = above[c]
        return c

    out = []
    for item, component, x in zip(xs, of_x, sets_x, strict=True):
        x = np.frombuffer(x, np.uint64)
        start, stop = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
        times = stop - start
        at = np.repeat(start - np.cumsum(times) + times, times) + np.arange(times.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(100 * shared >= percent * (len(x) + n - shared)).tolist():
            a, b = top(component), top(of_y[j])
            if a != b:
                above[a] = b
                out.append((item, ys[j]))
    return pa.table([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], schema=schema)


def open_items(ranked: DataFrame, parts: DataFrame) -> DataFrame:
    """ranked's rows in blocks of several components, with component and the block's largest one, main."""
    block = ["kind", "s"]
    placed = ranked.join(parts.select(F.col("node").alias("item"), "component"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    count = placed.groupBy(*block, "component").agg(F.count("*").alias("n_in"))
    main = count.groupBy(block).agg(F.max(F.struct("n_in", "component")).alias("main"), F.count("*").alias("components")).where("components > 1")
    main = written(main.select(*block, F.col("main.component").alias("main")), "open-blocks")
    items = written(placed.join(main, block).select(*block, "k", "item", "n", "p", "place", "after", "small", "component", "main"), "open-items")
    discard(main)
    return items


def late_pairs(items: DataFrame, percent: int) -> DataFrame:
    """(a, b) of blocks that are no larger than a cell: what lies outside the main component, with the others."""
    x, y = items.where("component <> main").alias("x"), items.alias("y")
    same = (F.col("x.kind") == F.col("y.kind")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.component") != F.col("y.component"))
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.item") < F.col("y.item"))
    met = x.join(y, same & once & _sized(F.col("x.n"), F.col("y.n"), percent) & _enough("x", "y", percent) & _first_here("x", "y", percent))
    return met.select(F.least("x.item", "y.item").alias("a"), F.greatest("x.item", "y.item").alias("b")).distinct()


def late_links(items: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join components in larger blocks."""
    block = ["kind", "s"]
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int")
    spread = items.select(*block, "item", "n", "p", "place", "after", "small", "component", (F.col("component") != F.col("main")).alias("outside"), band.alias("band"))
    cell = F.greatest(F.lit(1), F.least(F.lit(CELL_ROWS), F.floor(CELL_BYTES / 8 / F.pow(F.lit(BAND), F.col("band") + 1))))
    cells = spread.groupBy(*block, "band").agg(F.ceil(F.sum(F.col("outside").cast("long")) / cell).alias("cut_x"), F.ceil(F.count("*") / cell).alias("cut_y"))
    cells = written(cells, "cells")
    # how much a partner of a size shares at least in its prefix: it is lowest at an end of the band
    wanted = lambda m: (F.col("n") + m) * percent / (100 + percent) - F.greatest(F.col("n") - F.col("p"), m * percent / 100)
    # a partner is at most so large, by the place of the block's shingle
    most = (F.col("n") - F.col("place")) * (100 + percent) / percent - F.col("n")
    reach = int(math.log(100 / percent) / math.log(BAND)) + 1

    def side(items: DataFrame, own: str, other: str) -> DataFrame:
        """Each item once for every cell of the other side that may hold partners."""
        own_cells = cells.select(*block, "band", F.col(f"cut_{own}").alias("cut"))
        others = cells.where(F.col(f"cut_{other}") > 0).select(*block, F.col("band").alias("band_other"), F.col(f"cut_{other}").alias("cut_other"))
        met = items.join(own_cells, [*block, "band"]).join(others, block)
        least, end = (F.pow(F.lit(BAND), F.col("band_other") + k) for k in (0, 1))
        enough = F.col("after") + F.col("small") >= F.least(wanted(least), wanted(end)) - 1e-6
        met = met.where((F.abs(F.col("band") - F.col("band_other")) <= reach) & (least <= most + 1e-6) & enough)
        at = {own: F.pmod(F.xxhash64("item"), F.col("cut")), other: F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut_other") - 1))}
        in_band = {own: F.col("band"), other: F.col("band_other")}
        return met.select(*block, "item", "component", *[at[k].alias(f"at_{k}") for k in "xy"], *[in_band[k].alias(f"band_{k}") for k in "xy"])

    key = [*block, "band_x", "band_y", "at_x", "at_y"]
    x = side(spread.where("outside"), "x", "y").join(full, "item")
    y = side(spread, "y", "x").join(full, "item")
    y = y.toDF(*[f"{c}_" for c in y.columns])
    met = x.groupBy(*key).cogroup(y.groupBy(*[f"{c}_" for c in key]))
    met = met.applyInArrow(lambda a, b: cell_links(a, b.rename_columns([c[:-1] for c in b.column_names]), percent), "a binary, b binary")
    links = written(met, "links")
    discard(cells)
    return links


def similar_items(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, text_mark, n, item) for each row, and edges (a, b) between different items that connect those
    and only those that links connect."""
    rows = keyed(docs, doc_id, text)
    sets = set_table(rows, size)
    posts = posted(rows, frequent_shingles(sets), size, percent)
    members = posts.groupBy("item").agg(*[F.min(c).alias(c) for c in ("n", "p", "g", "mark")])
    blocks = blocks_of(posts, members)
    sizes = written(blocks.groupBy("kind", "s").agg(F.count("*").alias("k"), F.max(_leads(percent)).alias("leads")).where(F.col("k") > block), "large-sizes")
    small = blocks.join(sizes.select("kind", "s"), ["kind", "s"], "left_anti")
    large = blocks.join(sizes, ["kind", "s"])
    # blocks without a leading item give no pairs, but what items share there counts as well
    in_large = large.groupBy("item").agg(F.sum(_weight()).alias("in_large"), F.sum(F.when(F.col("leads"), 0).otherwise(_weight())).alias("idle"))
    in_large = written(in_large, "in-large")
    some = small.join(in_large.select("item"), "item", "left_semi").groupBy("item").agg(F.sum(_weight()).alias("small"))
    ranked = large.where("leads").drop("leads").join(in_large, "item").join(some, "item", "left")
    ranked = ranked.withColumn("small", F.coalesce("small", F.lit(0)) + F.col("idle")).withColumn("in_large", F.col("in_large") - F.col("idle")).drop("idle")
    # in the one order of all shingles, what an item has from a block on
    onwards = Window.partitionBy("item").orderBy(F.desc("kind"), "place", "s").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("after", F.sum(_weight()).over(onwards))
    ranked = written(ranked, "large-blocks")
    first = written(small_pairs(small, in_large, percent).union(hub_pairs(ranked, block, percent)).distinct(), "candidates")
    # the sets that pairs are compared by: of all candidates, and of all items that may become some; only those that a
    # comparison needs travel
    now = written(first.select(F.col("a").alias("item")).union(first.select("b")).distinct(), "items")
    full = whole_sets(now.union(ranked.select("item")).distinct(), members, rows, size)
    edges = linked(first, only_rows(full, now, "left_semi"), percent)
    discard(posts, blocks, sizes, in_large, first, now)
    if not ranked.isEmpty():
        parts = written(connected_components(edges, "a", "b"), "parts")
        items = open_items(ranked, parts)
        edges = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
        late = written(late_pairs(items.where(F.col("k") <= CELL_ROWS), percent), "late-candidates")
        if not late.isEmpty():
            some = written(late.select(F.col("a").alias("item")).union(late.select("b")).distinct(), "late-items")
            edges = edges.union(linked(late, only_rows(full, some, "left_semi"), percent))
        if not (large := items.where(F.col("k") > CELL_ROWS)).isEmpty():
            some = written(large.select("item").distinct(), "late-items")
            edges = edges.union(late_links(large, only_rows(full, some, "left_semi"), percent))
        discard(items, late)
    discard(ranked, full)
    return sets.where("mark is not null").select("doc_id", "mark", "text_mark", "n", "item"), edges


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, text_mark, n, first) for each row; first(none, doc_id, mark, text_mark) stands for its component."""
    own, edges = similar_items(docs, size, percent, doc_id=doc_id, text=text)
    parts = connected_components(edges, "a", "b").select(F.col("node").alias("item"), "component")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "text_mark")
    some = own.where("n > 0")
    placed = some.groupBy("item").agg(F.min(row).alias("row")).join(parts, "item", "left").withColumn("part", F.coalesce("component", "item"))
    placed = written(placed.select("item", "part", "row"), "placed")
    first = placed.groupBy("part").agg(F.min("row").alias("first"))
    firsts = written(placed.join(first, "part").select("item", "first"), "firsts")
    out = some.join(firsts, "item").select("doc_id", "mark", "text_mark", "n", "first")
    return out.union(own.where("n = 0").select("doc_id", "mark", "text_mark", "n", row.alias("first")))


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    return classes(docs, size, percent, doc_id, text).select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' rows, all columns: of each component the one with the lowest id (null ids last), and all without shingles.

    Of rows that repeat both id and text one stays, whichever."""
    keys = ["mark", "text_mark"]
    some = classes(docs, doc_id=doc_id, text=text).where("n > 0")
    stays = (F.col("mark") == F.col("first.mark")) & (F.col("text_mark") == F.col("first.text_mark"))
    told = written(some.groupBy(*keys, stays.alias("stays")).count().where("not stays or count > 1"), "verdicts")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), *_marks(docs[doc_id], docs[text]))
    left = only_rows(whole, told.where("not stays").select(keys), "left_anti")
    twice = told.where("stays").select(keys)
    if not twice.isEmpty():
        left = only_rows(left, twice, "left_anti").unionByName(only_rows(left, twice, "left_semi").dropDuplicates(keys))
    return left.select(*[F.col("whole")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w WHERE len(words) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, component) AS (SELECT a, a FROM e UNION SELECT e.b, r.component FROM r JOIN e ON e.a = r.node WHERE r.component < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(component) AS component FROM r GROUP BY node) c USING (doc_id)
"""
