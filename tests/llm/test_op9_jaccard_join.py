"""The grouped prefix join against brute force."""

import random
import re

import numpy as np
import pytest

from sievework.llm import op9_jaccard_join as join


def brute(texts, percent=75):
    """Shingle set sizes, and the lowest index of each component."""
    sets = []
    for x in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def clusters(seed, bases=4, copies=25, words=60, most=9):
    """Copies of a few texts, each with some words changed, so that links form chains and hubs."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for b in range(bases):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(most)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if b % 2:
                own = own + passage
            out.append(" ".join(own))
    out += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(60))]) for _ in range(20)]
    rng.shuffle(out)
    return out


def components(spark, texts, block=join.BLOCK, monkeypatch=None):
    if monkeypatch:
        monkeypatch.setattr(join.similar_items, "__defaults__", (join.SHINGLE, join.PERCENT, block, "doc_id", "text"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.components(docs).collect()}
    return [got[i][0] for i in range(len(texts))], [got[i][1] for i in range(len(texts))]


@pytest.mark.parametrize(("seed", "block", "most", "cell"), [(1, 8, 9, 512), (2, 1, 9, 512), (3, 2, 5, 3), (4, 1, 14, 5), (5, 1, 11, 1)])
def test_components_equal_brute_force(spark, seed, block, most, cell, monkeypatch):
    monkeypatch.setattr(join, "CELL_ROWS", cell)
    texts = clusters(seed, most=most)
    assert components(spark, texts, block, monkeypatch) == brute(texts)


def test_edge_cases(spark):
    texts = [None, "", " \n ", "one", "ONE", "one two", "one two", "a b c d e", "A B C D E\n", "a b c d e f", "x " * 5000, "x " * 20, "é b c d e f", None]
    assert components(spark, texts) == brute(texts)


def test_boundary_of_the_threshold(spark):
    w = [f"w{i}" for i in range(60)]
    # 3 of 4 shingles shared is a link, 5 of 7 is not
    texts = [" ".join(w[:7]), " ".join(w[:8]), " ".join(w[10:19]), " ".join(w[10:17] + ["q"] + w[30:33])]
    assert components(spark, texts) == brute(texts)
    assert brute(texts)[1][:2] == [0, 0]


def test_empty_table_null_and_repeated_ids_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert join.components(empty).count() == 0 and join.one_of_each(empty).count() == 0
    rows = [(None, "a b c d e f g", "r1", 1), (7, "a b c d e f g", "r2", 2), (7, "a b c d e f g", "r3", 3), (9, None, "r4", 4), (9, None, "r5", 5), (None, "z", "r6", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, item long")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in join.components(docs).collect()), key=str)
    assert got == sorted([(True, None, 3, 7), (False, 7, 3, 7), (False, 7, 3, 7), (False, 9, 0, 9), (False, 9, 0, 9), (True, None, 1, None)], key=str)
    left = join.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.item for r in left.collect()) in ([2, 4, 5, 6], [3, 4, 5, 6])


def test_rows_are_known_by_what_is_in_them(spark):
    """An input behind a shuffle that is computed anew, with its partitions coalesced, in each scan."""
    texts = clusters(7, copies=12)
    rows = [(i % 60, x, i) for i, x in enumerate(texts + texts[:20])]
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, more int").repartition(40).dropDuplicates(["text", "more"])
        got = [(r.doc_id, r.text, r.more) for r in join.one_of_each(docs).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    parts = brute([x for _, x, _ in rows])[1]
    least = {}
    for (i, x, _), part in zip(rows, parts, strict=True):
        least[part] = min(least.get(part, 99), i)
    assert len(got) == len(least) and set(got) <= set(rows)
    place = {m: part for (_, _, m), part in zip(rows, parts, strict=True)}
    assert all(least[place[m]] == i for i, _, m in got) and len({place[m] for _, _, m in got}) == len(got)


def test_a_passage_that_unlinked_documents_share(spark):
    """A block of texts that share most words but stay below the threshold, beside copies of some of them."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"u{i}-{k}" for k in range(rng.randrange(3, 30))] + passage) for i in range(60)]
    texts += [texts[i] + " more" for i in range(0, 60, 7)] + [texts[3]] * 30
    assert components(spark, texts) == brute(texts)


def test_repeated_rows_leave_one(spark):
    rows = [(5, "a b c d e f g")] * 40 + [(5, "other words are here now")] * 3 + [(6, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, join.one_of_each(docs).collect()), key=str) == sorted([(5, "a b c d e f g"), (5, "other words are here now"), (6, None), (6, None)], key=str)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    frequent = np.sort(rng.integers(0, 400, 60, dtype=np.uint64))
    frequent, times = np.unique(frequent), rng.integers(9, 99, len(np.unique(frequent)))
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 80), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 400, 3, dtype=np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
            assert len(np.intersect1d(join.prefix_of(a, frequent, times, 75)[0], join.prefix_of(b, frequent, times, 75)[0]))
