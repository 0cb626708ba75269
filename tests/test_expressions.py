"""Scalar functions and rules, with their boundaries."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.config import Config
from sievework.functions import expressions as X
from sievework.operators import filters


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_suffixes_and_stems(spark):
    rows = spark.createDataFrame([("a/B.PNG",), ("a.b/c",), ("x.jpeg",), (".hidden",), ("d/10.jpg",)], "p string")
    got = [tuple(r) for r in rows.select(X.suffix("p"), X.is_image_path("p"), X.stem("p")).collect()]
    assert got == [(".png", True, "B"), ("", False, "c"), (".jpeg", True, "x"), ("", False, ".hidden"), (".jpg", True, "10")]


def test_numeric_stems_come_first_by_value(spark):
    rows = spark.createDataFrame([("10.jpg",), ("9.jpg",), ("a.jpg",), ("100.jpg",)], "p string")
    assert [r.p for r in rows.orderBy(*X.stem_order("p")).collect()] == ["9.jpg", "10.jpg", "100.jpg", "a.jpg"]


def test_relative_path(spark):
    r = one(spark, inside=X.relative_path(F.lit("/a/b/c.jpg"), F.lit("/a/")), outside=X.relative_path(F.lit("/x/c.jpg"), F.lit("/a")), back=X.relative_path(F.lit("C:\\a\\b.png"), F.lit("C:\\a")))
    assert tuple(r) == ("b/c.jpg", "c.jpg", "b.png")


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**256 - 1), st.integers(0, 2**256 - 1))
def test_hash_codec_and_hamming(spark, x, y):
    a, b = X.hash_words(F.lit(f"{x:x}")), X.hash_words(F.lit(f"{y:064x}"))
    r = one(spark, hex=X.hash_hex(a), bucket=X.bucket32(a), d=X.hamming(a, b))
    assert (r.hex, r.bucket, r.d) == (f"{x:064x}", x >> 224, (x ^ y).bit_count())


@pytest.mark.parametrize(("w", "h", "want"), [(100, 200, (300, 600, 300, 0, 150)), (1000, 400, (1000, 400, 400, 300, 0)), (1000, 200, (1500, 300, 300, 600, 0)), (300, 300, (300, 300, 300, 0, 0)), (1, 1, (300, 300, 300, 0, 0))])
def test_crop_geometry(spark, w, h, want):
    r = one(spark, b=X.crop_box(F.lit(w), F.lit(h), 300)).b
    assert (r.scaled_w, r.scaled_h, r.edge, r.left, r.top) == want


def test_quality_precedence_and_boundaries(spark):
    config = Config(min_sharpness=100.0, drop_grayscale=True, drop_bordered=True)
    rows = [(1, 99.9, 5.0, 0.5), (2, 100.0, 10.0, 0.5), (3, 100.0, 10.01, 0.03), (4, 100.0, 11.0, 0.0299), (5, None, None, None), (6, 0.0, 50.0, 1.0)]
    got = spark.createDataFrame(rows, "id int, sharpness double, saturation double, border_frac double").select("id", filters.quality_reason(config)).collect()
    assert [r[1] for r in sorted(got)] == ["blurry", "grayscale", "bordered", None, None, "blurry"]
    assert not Config().quality_on


def test_detection_short_circuit_and_screen_boundary(spark):
    rows = spark.createDataFrame([(True, True), (True, None), (False, True), (False, False), (None, None)], "p boolean, f boolean")
    got = filters.detection_flags(rows, F.col("p"), F.col("f")).select("has_face", filters.detection_reason()).collect()
    assert [tuple(r) for r in got] == [(False, "person"), (False, "person"), (True, "face"), (False, None), (None, None)]
    scores = spark.createDataFrame([(0.49,), (0.5,), (None,), (float("nan"),)], "s double")
    assert [r[0] for r in scores.select(filters.screen_route("s", 0.5)).collect()] == ["moved", "blocked", "skipped", "skipped"]


def test_unsafe_scores(spark):
    r = one(
        spark,
        z=X.unsafe_from_similarities(F.lit(0.3), F.lit(0.1)),
        some=X.unsafe_from_labels(F.array(F.struct(F.lit("Porn").alias("label"), F.lit(0.7).alias("score")), F.struct(F.lit("sfw").alias("label"), F.lit(0.9).alias("score")))),
        none=X.unsafe_from_labels(F.array(F.struct(F.lit("sfw").alias("label"), F.lit(0.9).alias("score")))),
        box=X.has_class(F.array(F.struct(F.lit(0).alias("cls"), F.lit(0.25).alias("conf"))), 0.25),
    )
    assert math.isclose(r.z, 1 / (1 + math.exp(-0.2))) and (r.some, r.none, r.box) == (0.7, 0.0, True)


def test_zero_vectors_never_match(spark):
    r = one(spark, zero=X.normalised(F.array(F.lit(0.0), F.lit(0.0))), unit=X.normalised(F.array(F.lit(3.0), F.lit(4.0))))
    assert r.zero is None and r.unit == [0.6, 0.8]


@pytest.mark.parametrize("bad", [{"rep_policy": "best"}, {"phash_hamming": 257}, {"similarity": 2.0}, {"kept_side": 0}, {"neighbour_method": "x"}])
def test_config_is_checked_first(bad):
    with pytest.raises(ValueError):
        Config(**bad)
