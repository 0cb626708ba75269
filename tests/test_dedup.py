"""Duplicates, representatives, components: boundaries, quirks and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.config import Config
from sievework.operators import dedup
from sievework.operators.graph import connected_components
from sievework.plans.pipeline import curate


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 100)], [(i, j) for i in range(12) for j in range(12)], [(2, 1), (1, 2), (5, 5), (9, 5)]])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == brute_components(edges) and len(got) == len({x for e in edges for x in e})


def test_components_don_t_depend_on_order(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    flipped = [(b, a) for a, b in reversed(edges)]
    got = [sorted(map(tuple, connected_components(spark.createDataFrame(e, "a long, b long")).collect())) for e in (edges, flipped)]
    assert got[0] == got[1] == sorted(brute_components(edges).items())


def test_representative_policies_and_ties(spark):
    rows = spark.createDataFrame([("g", "b", 2, 1.0, 5.0), ("g", "a", 2, 3.0, None), ("g", "c", 1, 3.0, 5.0), ("h", "z", None, None, None)], "g string, path string, size long, mtime double, sharpness double")
    pick = lambda p: {r.g: r.representative for r in dedup.representatives(rows, "g", "path", p).collect()}
    assert [pick(p)["g"] for p in ("first", "largest", "newest", "oldest", "sharpest")] == ["a", "a", "a", "b", "b"]
    assert pick("sharpest")["h"] == "z"
    with pytest.raises(ValueError):
        dedup.representatives(rows, "g", "path", "best")


def test_hamming_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(60) for _ in range(6)]
    rows = [(i, rng.choice(base) ^ (1 << rng.randrange(50)) if i % 3 else base[i % 6]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, h long")
    args = (df, "id", F.array("h"), F.shiftrightunsigned("h", 56), 2)
    pairs = {(r.a, r.b) for r in dedup.hamming_pairs(*args).collect()}
    links = {(r.a, r.b) for r in dedup.hamming_links(*args).collect()}
    assert pairs == {(a, b) for a, x in rows for b, y in rows if a < b and x >> 56 == y >> 56 and (x ^ y).bit_count() <= 2}
    assert brute_components(pairs) == brute_components(links) and len(links) < len(pairs)


def vectors(spark, n=90, seed=0):
    v = np.random.default_rng(seed).standard_normal((n, 8))
    v[n // 2 :] = v[: n - n // 2] + 0.05 * v[n // 2 :]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")


@pytest.mark.parametrize("block", [7, 1000])
def test_blocked_neighbours_are_exact(spark, block):
    v, df = vectors(spark)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(len(v)) for j in np.lexsort((np.arange(len(v)), -s[i]))[:4]}
    assert {(r.i, r.j) for r in dedup.blocked_neighbours(df, "id", "v", 4, block_rows=block).collect()} == want
    near = {(r.i, r.j) for r in dedup.blocked_neighbours(df, "id", "v", None, 0.9, block_rows=block).collect()}
    assert near == {(int(i), int(j)) for i, j in np.argwhere(s >= 0.9)}


def test_lsh_finds_near_identical_vectors(spark):
    v, df = vectors(spark)
    s = np.triu(v @ v.T, 1)
    want = {(int(i), int(j)) for i, j in np.argwhere(s >= 0.95)}
    got = {(r.i, r.j) for r in dedup.lsh_neighbours(df, "id", "v", None, 0.95).collect()}
    assert {p for p in got if p[0] < p[1]} <= want and len(want & got) >= 0.9 * len(want)


@pytest.mark.parametrize("most", [256, 20])
def test_recall_of_hash_tables_against_brute_force(spark, most):
    """3,000 vectors, near copies of a few among them, so that some keys are hot."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3000, 32))
    v[1500:2500] = v[:1000] + 0.25 * rng.standard_normal((1000, 32))
    v[2500:] = v[rng.integers(0, 12, 500)] + 0.2 * rng.standard_normal((500, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in np.argwhere(np.triu(v @ v.T, 1) >= 0.9)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(4)
    got = {(r.a, r.b) for r in dedup.lsh_pairs(df, "id", "v", 0.9, most=most).collect()}
    assert got <= want and len(want) > 5000 and len(got) >= (0.95 if most == 256 else 0.5) * len(want)


def test_pairs_inside_components_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 11)
    v, df = vectors(spark)
    within = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(80)], "node long, component long")
    s, part = v @ v.T, {i: 0 if i % 3 else i for i in range(80)}
    for least in (0.3, 0.9):
        want = {(i, j) for i in part for j in part if i < j and part[i] == part[j] and s[i, j] >= least}
        assert {(r.a, r.b) for r in dedup.cosine_pairs(df, "id", "v", least, within).collect()} == want
        assert {(r.a, r.b) for r in dedup.cosine_pairs(df, "id", "v", least).collect()} == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= least}


def test_groups_with_many_equal_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((60, 24))
    v[20:40] = v[0]
    v[40:50] = v[1:11] + 0.02 * v[40:50]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, v array<double>")
    want = brute_components([(int(i), int(j)) for i, j in np.argwhere(np.triu(v @ v.T, 1) >= 0.9)])
    for rows in (10**6, 5):  # beyond the bound hash tables are used
        monkeypatch.setattr(dedup, "EXACT_ROWS", rows)
        assert {r.node: r.component for r in dedup.near_groups_by_vector(df, "id", "v", None, 0.9).collect()} == want


def test_edges_symmetric_or_strict(spark):
    near = spark.createDataFrame([(5, 1, 0.9), (1, 2, 0.9), (2, 1, 0.9), (3, 4, 0.1)], "i long, j long, similarity double")
    assert {tuple(r) for r in dedup.neighbour_edges(near, 0.5).collect()} == {(1, 5), (1, 2)}
    assert {tuple(r) for r in dedup.neighbour_edges(near, 0.5, strict=True).collect()} == {(1, 2)}


@pytest.mark.parametrize("use_vectors", [True, False])
def test_every_asset_has_one_reason_and_each_group_one_survivor(spark, use_vectors):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(80):
        v = rng.standard_normal(6)
        rows.append((f"p{i:03}", f"s{i % 60}", [int(i % 4) << 60, 0, 0, 0], float(rng.integers(0, 200)), float(i % 30), 0.0, bool(i % 9 == 0), bool(i % 7 == 0), (v / np.linalg.norm(v)).tolist(), i, float(i)))
    df = spark.createDataFrame(rows, "path string, sha256 string, phash array<long>, sharpness double, saturation double, border_frac double, has_person boolean, has_face boolean, embedding array<double>, size long, mtime double")
    config = Config(min_sharpness=50.0, drop_grayscale=True, similarity=0.6, use_vectors=use_vectors, rep_policy="largest")
    got = curate(df, config)
    out = {r.path: r.reason for r in got.outcomes.collect()}
    summary = got.summary.first().asDict()
    assert len(out) == 80 and summary["total_input"] == 80
    assert sum(v for k, v in summary.items() if k.startswith("rejected_")) + summary["survivors"] == 80
    left = [r for r in rows if out[r[0]] is None]
    assert len({r[1] for r in left}) == len(left)
    assert all(out[r[0]] == "blurry" for r in rows if r[3] < 50)
