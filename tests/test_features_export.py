"""The feature table, numbering, masks, collisions, sampling, streaming."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import export, features
from sievework.operators.sampling import sample_seed
from sievework.schema import FEATURES, conform


def assets(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, size long, mtime double")


def stored(spark, *rows):
    return conform(spark.createDataFrame(list(rows), "key string, size long, mtime double, sha256 string, has_person boolean, params string"), FEATURES)


def test_validity_boundary(spark):
    now = assets(spark, ("a", 1, 11.0), ("b", 1, 11.5), ("c", 2, 10.0), ("d", 1, 10.0))
    table = stored(spark, ("a", 1, 10.0, "A", True, "p"), ("b", 1, 10.0, "B", True, "p"), ("c", 1, 10.0, "C", True, "p"), ("d", 1, 10.0, "D", True, "q"))
    assert {r.key: r.sha256 for r in features.lookup(now, table).collect()} == {"a": "A", "b": None, "c": None, "d": "D"}
    # other options make a stored value stale
    assert {r.key: r.sha256 for r in features.lookup(now, table, params="p").collect()} == {"a": "A", "b": None, "c": None, "d": None}


def test_second_run_computes_nothing(spark, tmp_path):
    table = features.FeatureTable(spark, f"file://{tmp_path}/t")
    now = assets(spark, ("a", 1, 10.0), ("b", 2, 20.0))
    assert features.missing(now, table.read(), "sha256", params="p").count() == 2
    table.upsert(conform(now.withColumn("sha256", F.upper("key")).withColumn("params", F.lit("p")), FEATURES))
    assert features.missing(now, table.read(), "sha256", params="p").count() == 0
    assert features.missing(now, table.read(), "sha256", "has_person", params="p").count() == 2
    assert table.info()["total_rows"] == 2 and table.info()["with_detection"] == 0
    assert table.prune(assets(spark, ("a", 1, 10.0))) == 1 and table.info()["total_rows"] == 1
    table.clear()
    assert table.info()["total_rows"] == 0


def test_a_changed_fingerprint_drops_old_features(spark):
    old = stored(spark, ("a", 1, 10.0, "A", True, "p"), ("b", 1, 10.0, "B", True, "p"), ("c", 1, 10.0, "C", True, "p"))
    new = stored(spark, ("a", 2, 10.0, None, False, "p"), ("b", 1, 10.5, None, False, "p"), ("n", 1, 1.0, "N", None, "p"))
    got = {r.key: (r.size, r.mtime, r.sha256, r.has_person) for r in features.merge(old, new).collect()}
    assert got == {"a": (2, 10.0, None, False), "b": (1, 10.0, "B", False), "c": (1, 10.0, "C", True), "n": (1, 1.0, "N", None)}


def test_families_with_their_own_options(spark):
    base = "key string, size long, mtime double, sha256 string, params string, unsafe_score double, unsafe_params string"
    table = lambda *rows: conform(spark.createDataFrame(list(rows), base), FEATURES)
    old = table(("a", 1, 1.0, "A", "p", None, None), ("b", 1, 1.0, "B", "p", 0.5, "u"))
    both = features.merge(old, table(("a", 1, 1.0, None, None, 0.1, "u"), ("b", 1, 1.0, None, None, 0.2, "v")))
    assert {r.key: (r.sha256, r.params, r.unsafe_score, r.unsafe_params) for r in both.collect()} == {"a": ("A", "p", 0.1, "u"), "b": ("B", "p", 0.2, "v")}
    now = assets(spark, ("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0))
    assert {r.key: (r.sha256, r.unsafe_score) for r in features.lookup(now, both, "p", unsafe_params="u").collect()} == {"a": ("A", 0.1), "b": ("B", None), "c": (None, None)}
    assert {r.key for r in features.missing(now, both, "unsafe_score", unsafe_params="u").collect()} == {"b", "c"}
    # other options of one family drop that family alone
    again = features.merge(both, table(("a", 1, 1.0, None, "q", None, None)))
    assert {r.key: (r.sha256, r.params, r.unsafe_score) for r in again.collect()}["a"] == (None, "q", 0.1)


def test_commits_are_small_and_make_a_new_base_at_times(spark, tmp_path):
    table = features.FeatureTable(spark, f"file://{tmp_path}/t", most=2)
    for k in range(8):
        table.upsert(conform(assets(spark, (f"k{k}", 1, 1.0), ("same", 1, 1.0)).withColumn("sha256", F.concat("key", F.lit(str(k)))).withColumn("params", F.lit("p")), FEATURES))
        rows = {r.key: r.sha256 for r in table.read().collect()}
        assert rows == {f"k{i}": f"k{i}{i}" for i in range(k + 1)} | {"same": f"same{k}"}
    names = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert [n for n in names if n[0] == "v"] == ["v1", "v2"] and sum(n[0] == "c" for n in names) <= 6


def test_numbering_is_gapless_over_partitions(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).repartition(7)
    got = export.numbered(rows, "k").collect()
    assert sorted((r["index"], r.k) for r in got) == [(i + 1, i) for i in range(500)]
    assert export.numbered(rows.where("k < 0"), "k").count() == 0


def test_collisions_respect_taken_names(spark):
    plan = spark.createDataFrame([("/x/a.jpg", "d/a.jpg"), ("/y/a.jpg", "d/a.jpg"), ("/z/b.jpg", "d/b.jpg"), ("/z/c", "d/c")], "src string, dst string")
    taken = spark.createDataFrame([("d/a.jpg",), ("d/a (3).jpg",), ("d/c",)], "dst string")
    free = {r.src: r.final for r in export.collision_free(plan, "dst", "src").collect()}
    assert free == {"/x/a.jpg": "d/a.jpg", "/y/a.jpg": "d/a (1).jpg", "/z/b.jpg": "d/b.jpg", "/z/c": "d/c"}
    got = {r.src: r.final for r in export.collision_free(plan, "dst", "src", taken).collect()}
    assert got["/z/b.jpg"] == "d/b.jpg" and got["/z/c"] == "d/c (1)"
    assert len(set(got.values())) == 4 and not set(got.values()) & {"d/a.jpg", "d/a (3).jpg", "d/c"}


def sequential(claims, taken):
    """What one claim after the other gets, if wanted names count as taken."""
    used, wanted, out = set(taken), {d for _, d in claims}, {}
    for src, dst in sorted(claims):
        final, n = dst, 0
        if dst in used:
            stem, dot, ext = dst.rpartition(".")
            while final in used | wanted:
                n += 1
                final = f"{stem} ({n}){dot}{ext}"
        used.add(final)
        out[src] = final
    return out


def test_final_names_are_unique_and_the_first_free_ones(spark):
    rng = random.Random(4)
    names = ["d/a.jpg", "d/a (1).jpg", "d/a (2).jpg", "d/a (1) (1).jpg", "d/a (03).jpg", "d/b.jpg", "d/a (9).jpg"]
    for size in (3, 12, 40):
        claims = [(f"s{i:03d}", rng.choice(names)) for i in range(size)]
        taken = rng.sample(names + ["d/a (4).jpg", "d/b (1).jpg"], rng.randrange(5))
        plan = spark.createDataFrame(claims, "src string, dst string")
        got = {r.src: r.final for r in export.collision_free(plan, "dst", "src", spark.createDataFrame([(x,) for x in taken], "dst string")).collect()}
        assert got == sequential(claims, taken) and len(set(got.values())) == size and not set(got.values()) & set(taken)


def test_moving_files_loses_none(spark, tmp_path):
    from sievework.sources import sinks

    wants = {"s1": "a.jpg", "s2": "a.jpg", "s3": "a (1).jpg", "s4": "b.jpg", "s5": "b.jpg"}
    for i, (folder, name) in enumerate(wants.items()):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_bytes(b"x" * (i + 1))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "b.jpg").write_bytes(b"old")
    rows = [(str(tmp_path / f / n), n, hashlib.sha256((tmp_path / f / n).read_bytes()).hexdigest()) for f, n in wants.items()]
    done = sinks.mirror(spark.createDataFrame(rows, "path string, rel_path string, sha256 string"), str(tmp_path / "out"), move=True, overwrite=True)
    assert done.where("done").count() == 5 and not any((tmp_path / f).iterdir() and list((tmp_path / f).iterdir()) for f in wants)
    left = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert left == {"a.jpg": b"x", "a (2).jpg": b"xx", "a (1).jpg": b"xxx", "b (1).jpg": b"xxxx", "b.jpg": b"xxxxx"}
    # a file that turns up after the plan was made is not replaced
    (tmp_path / "late").write_bytes(b"late")
    (tmp_path / "there").write_bytes(b"there")
    plan = spark.createDataFrame([(str(tmp_path / "late"), str(tmp_path / "there"), "copy", None)], "src string, final string, action string, sha256 string")
    assert [r.done for r in sinks.apply_plan(plan, move=True).collect()] == [False] and (tmp_path / "late").exists() and (tmp_path / "there").read_bytes() == b"there"


def test_mask_by_relative_path_or_root(spark):
    rows = spark.createDataFrame([("A", "x.jpg"), ("B", "x.jpg"), ("A", "y.jpg")], "root string, rel_path string")
    mask = spark.createDataFrame([("A", "x.jpg")], "root string, rel_path string")
    assert export.masked(rows, mask).count() == 1
    assert export.masked(rows, mask, by_root=True).count() == 2


def test_sample_is_bounded_and_reproducible(spark):
    rows = spark.range(1000).select(F.concat(F.lit("c"), (F.col("id") % 13).cast("string")).alias("c"), "id")
    a, b, c = (sorted(map(tuple, sample_seed(rows, "c", "id", 5, 3, seed).collect())) for seed in (1, 1, 2))
    assert a == b != c and len(a) == 15 and len({r[0] for r in a}) == 5


def test_image_stream_into_the_table(spark, tmp_path):
    from sievework.streaming.features import image_stream, into_feature_table, latest_by_key, windowed_counts

    (tmp_path / "in").mkdir()
    for i, name in enumerate(("a.png", "b.JPG", "c.txt")):
        (tmp_path / "in" / name).write_bytes(b"x" * (i + 1))
    table = features.FeatureTable(spark, f"file://{tmp_path}/t")
    for extra in (None, "d.png", None):
        if extra:
            (tmp_path / "in" / extra).write_bytes(b"new")
        into_feature_table(image_stream(spark, str(tmp_path / "in")), table, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.key.rsplit("/", 1)[1] for r in table.read().collect()) == ["a.png", "b.JPG", "d.png"]
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    assert sorted(map(tuple, latest_by_key(rows, "k", "v").collect())) == [("a", 2), ("b", 1)]
    source = tmp_path / "events"
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 05:00:00", "y", 3.0)], "ts string, event_type string, value double")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(source))
    q = windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_type, r.n, r.total) for r in spark.sql("select * from windows").collect()] == [("x", 2, 3.0)]


@pytest.mark.parametrize("limit", [1, 2])
def test_review_caption(spark, limit):
    rejected = spark.createDataFrame([("b.jpg",), ("a.jpg",)], "rel_path string")
    log = spark.createDataFrame([("a.jpg", "face")], "rel_path string, reason string")
    assert [r.caption for r in export.review(rejected, log, limit).collect()] == ["face", "b.jpg"][:limit]
