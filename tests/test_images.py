"""Kernels, codecs, scans, sinks and whole runs on small drawn images."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework import cli
from sievework.config import Config
from sievework.functions import codecs, kernels, scorers
from sievework.operators import features
from sievework.plans import pipeline
from sievework.sources import files, sinks


def picture(seed=0, h=60, w=80):
    rng = np.random.default_rng(seed)
    return np.clip(np.cumsum(np.cumsum(rng.normal(0, 3, (h, w, 3)), 0), 1) + 128, 0, 255).astype(np.uint8)


def framed(colour, band=10):
    image = picture()
    image[:band] = image[-band:] = image[:, :band] = image[:, -band:] = colour
    return image


def test_grey_borders_count_and_coloured_ones_do_not():
    assert kernels.border_fraction(framed((90, 90, 90))) == pytest.approx(10 / 60)
    assert kernels.border_fraction(framed((255, 0, 0))) == 0.0
    edge = np.full((20, 20, 3), 100, np.uint8)
    edge[:, ::2] = 112
    assert kernels.flat_run(edge) == 20
    edge[:, ::2] = 113
    assert kernels.flat_run(edge) == 0


def test_flat_grey_is_blurry_first():
    flat = np.full((40, 40, 3), 128, np.uint8)
    assert kernels.quality(flat) == (0.0, 0.0, 1.0)


def test_sharpness_falls_with_blur_and_the_two_kinds_differ():
    board = np.kron(np.indices((125, 125)).sum(0) % 2 * 255, np.ones((8, 8))).astype(np.uint8)[..., None].repeat(3, 2)
    blurred = kernels.resize(kernels.resize(board, 500, 500), 1000, 1000)
    assert kernels.sharpness_full(blurred) < kernels.sharpness_full(board)
    assert kernels.sharpness_norm(board) != kernels.sharpness_full(board)
    assert kernels.laplacian_variance(np.array([[7]], np.uint8)) == 0.0


def test_perceptual_hash():
    bits = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(kernels.perceptual_hash(a), kernels.perceptual_hash(b), strict=True))
    a = picture(1, 120, 160)
    assert bits(a, np.clip(a.astype(int) + 9, 0, 255).astype(np.uint8)) <= 30
    assert bits(a, kernels.resize(a, 320, 240)) <= 30
    assert bits(a, picture(2, 120, 160)) > 60


@pytest.mark.parametrize(("w", "h"), [(100, 200), (1000, 400), (1000, 200), (300, 300), (1, 1)])
def test_crops_are_square(w, h):
    assert kernels.crop_square(np.zeros((h, w, 3), np.uint8)).shape == (300, 300, 3)


def test_orientation_and_turns():
    exif = b"\xff\xd8\xff\xe1\x00\x22Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    assert codecs.orientation(exif) == 6 and codecs.orientation(b"\xff\xd8") == 1
    image = np.arange(6).reshape(2, 3, 1)
    assert kernels.turned(image, 6)[..., 0].tolist() == [[3, 0], [4, 1], [5, 2]]
    assert kernels.turned(image, 8)[..., 0].tolist() == [[2, 5], [1, 4], [0, 3]]


def test_png_round_trip_and_damage():
    image = picture(3)
    data = codecs.png(image)
    assert (codecs.from_png(data) == image).all()
    assert codecs.from_png(data[:60]) is None and codecs.from_png(b"garbage") is None


@pytest.mark.parametrize("unit", [1, 3, 4])
def test_png_filters_undo_what_the_standard_says(unit):
    rng = np.random.default_rng(unit)
    image, kinds = rng.integers(0, 256, (23, 17 * unit)), np.concatenate([np.arange(5), rng.integers(0, 5, 18)])
    lines = np.zeros_like(image)
    for y in range(23):
        for x in range(17 * unit):
            left, up = image[y, x - unit] if x >= unit else 0, image[y - 1, x] if y else 0
            corner = image[y - 1, x - unit] if y and x >= unit else 0
            p = left + up - corner
            near = min((left, up, corner), key=lambda c: abs(p - c))
            lines[y, x] = (image[y, x] - (0, left, up, (left + up) // 2, near)[kinds[y]]) % 256
    assert (codecs._unfiltered(kinds.astype(np.uint8), lines.astype(np.uint8), unit) == image).all()


def test_jpeg_steps_say_what_the_blocks_hold():
    """The steps, read back one by one, give the coefficients."""
    rng = np.random.default_rng(8)
    blocks = np.where(rng.random((30, 64)) < rng.random((30, 1)) * 0.4, rng.integers(-200, 200, (30, 64)), 0)
    blocks[4] = 0
    blocks[7, 63] = 5
    steps, last = list(zip(*(x.tolist() for x in codecs._entropy_steps(blocks)), strict=True)), [0, 0, 0]
    value = lambda extra, n: extra if n and extra >> n - 1 else extra - (1 << n) + 1 if n else 0
    for i, want in enumerate(blocks):
        got = np.zeros(64, int)
        table, symbol, extra, n = steps.pop(0)
        assert (table, symbol) == (int(i % 3 > 0), n)
        got[0] = last[i % 3] = last[i % 3] + value(extra, n)
        at = 1
        while at < 64:
            table, symbol, extra, n = steps.pop(0)
            assert table == 2 + (i % 3 > 0)
            if symbol == 0:
                break
            at += symbol >> 4
            got[at] = value(extra, n)
            at += 1
        assert (got == want).all()
    assert not steps


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    a = picture(1)
    for name, data in {
        "a.png": codecs.png(a), "copy of a.png": codecs.png(a), "sub/near+1.PNG": codecs.png(np.clip(a.astype(int) + 4, 0, 255).astype(np.uint8)),
        "b.jpg": codecs.jpeg(picture(2)), "b[1]*.jpg": codecs.jpeg(picture(5)), "grey.png": codecs.png(np.repeat(picture(4)[..., :1], 3, 2)), "broken.jpg": b"nothing", "notes.txt": b"x", ".hid.png": codecs.png(a),
    }.items():
        (root / name).write_bytes(data)
    return root


def test_scan_and_decode(spark, folder, tmp_path, monkeypatch):
    found = files.collect_inputs(spark, [str(folder), str(folder / "sub")])
    assert sorted(r.rel_path for r in found.collect()) == ["a.png", "b.jpg", "b[1]*.jpg", "broken.jpg", "copy of a.png", "grey.png", "near+1.PNG"]
    assert files.count_images(spark, str(folder)) == 7
    with pytest.raises(ValueError):
        files.collect_inputs(spark, [str(tmp_path / "none")])
    assert files.scan_images(spark, [str(tmp_path / "none")]).count() == 0
    decoded = {r.path.rsplit("/", 1)[1]: files.unpacked(r.image) for r in files.pixels(spark, found).collect()}
    assert decoded["broken.jpg"] is None and (decoded["a.png"] == picture(1)).all()
    assert np.abs(decoded["b.jpg"].astype(int) - picture(2)).mean() < 4 and np.abs(decoded["b[1]*.jpg"].astype(int) - picture(5)).mean() < 4
    one = files.pixels(spark, found.where("rel_path = 'b.jpg'").drop("root")).collect()
    assert len(one) == 1 and (files.unpacked(one[0].image) == decoded["b.jpg"]).all()
    monkeypatch.setattr(files, "NAMED", 1)  # many files: their roots are read
    assert {r.path: r.image for r in files.pixels(spark, found).collect()}.keys() == {r.path for r in found.collect()}


def test_mirror_is_safe_to_repeat(spark, folder, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "a.png").write_bytes(b"other")
    (out / "grey.png").write_bytes((folder / "grey.png").read_bytes())
    rows = files.collect_inputs(spark, [str(folder)]).where(F.col("rel_path").isin("a.png", "grey.png", "sub/near+1.PNG")).withColumn("sha256", F.sha2("content", 256)).drop("content")
    for _ in range(2):
        done = {r.src.rsplit("/", 1)[1]: r.final[len(str(out)) + 1 :] for r in sinks.mirror(rows, str(out)).collect()}
        assert done["grey.png"] == "grey.png" and done["near+1.PNG"] == "sub/near+1.PNG"
    assert (out / "a.png").read_bytes() == b"other" and (out / "a (1).png").exists() and (folder / "a.png").exists()
    sinks.mirror(rows, str(out), move=True, overwrite=True).collect()
    assert not (folder / "a.png").exists() and (out / "a.png").read_bytes() != b"other"


@pytest.fixture
def models():
    """Scorers by content digest, standing in for models."""

    def embed(contents):
        out = []
        for c in contents:
            image = codecs.from_png(c)
            v = kernels.resize(image, 4, 4).astype(float).ravel() - 128 if image is not None else np.frombuffer(hashlib.sha256(c).digest(), np.uint8)[:48 % 32 or 16].astype(float)
            v = np.resize(v, 48)
            out.append((v / (np.linalg.norm(v) or 1)).astype(np.float32).tolist())
        return out

    scorers.register("embedding", "clip", lambda: embed)
    scorers.register("person", "yolo", lambda: lambda contents: [False] * len(contents))
    scorers.register("face", "haar", lambda: lambda contents: [False] * len(contents))
    yield
    scorers._registry.clear()


@pytest.mark.parametrize("use_vectors", [True, False])
def test_a_whole_run(spark, folder, tmp_path, models, use_vectors):
    kept, unkept = tmp_path / "kept", tmp_path / "unkept"
    config = Config(drop_grayscale=True, grayscale_max_saturation=0.5, use_vectors=use_vectors, similarity=0.95, rep_policy="first", kept_side=32)
    got = pipeline.run_full(spark, [str(folder)], str(kept), str(unkept), config)
    assert (got["total_input"], got["rejected_grayscale"], got["rejected_exact_dup"], got["rejected_near_dup"]) == (7, 1, 1, 1)
    # a.png, two JPEGs and the unreadable file survive; the latter keeps its number and is not written
    assert got["exported"] == 3 and sorted(p.name for p in kept.glob("*.jpg")) == ["1.jpg", "2.jpg", "3.jpg"]
    assert (kept / "manifest.csv").read_text().splitlines()[0] == "index,filename,original_path"
    lines = (unkept / "outcomes.csv").read_text().splitlines()
    assert lines[0] == "rel_path,reason,original_path" and len(lines) == 4
    assert {r.reason for r in files.read_outcomes(spark, str(unkept / "outcomes.csv")).collect()} == {"grayscale", "duplicate_exact", "duplicate_near"}
    again = pipeline.run_full(spark, [str(folder)], str(kept), str(unkept), config)
    assert {k: v for k, v in again.items() if k != "cache_info"} == {k: v for k, v in got.items() if k != "cache_info"}


def test_a_broken_run_resumes_and_verbs_share_the_table(spark, folder, tmp_path, models, monkeypatch):
    table, seen = features.FeatureTable(spark, str(tmp_path / "t")), []
    real, config = pipeline._computed, Config(skip_detect=True)

    def watched(spark, todo, config, detect):
        seen.append({r.path for r in todo.collect()})
        if len(seen) == 3:
            raise OSError("executors are gone")
        return real(spark, todo, config, detect)

    monkeypatch.setattr(pipeline, "_computed", watched)
    monkeypatch.setattr(pipeline, "SLICE_ROWS", 2)
    found = files.collect_inputs(spark, [str(folder)])
    with pytest.raises(OSError):
        pipeline._featured(spark, found, config, table, False)
    had = seen[0] | seen[1]
    out = pipeline._featured(spark, found, config, table, False)
    again = set().union(*seen[3:])
    assert had and again and not had & again and len(had | again) == found.count() == out.count()
    # the screen adds its own family; a second run and a second screen compute nothing
    scored = []
    scorers.register("unsafe", "auto", lambda: lambda contents: [scored.append(len(contents)) or 0.1 for _ in contents])
    for _ in range(2):
        got = pipeline.run_screen(spark, str(folder), str(tmp_path / "safe"), config, "auto", False, cache=str(tmp_path / "t"))
        assert (got["total"], got["blocked"]) == (7, 0)
    before = len(seen)
    rows = pipeline._featured(spark, found, config, table, False)
    assert len(seen) == before and rows.where("sha256 is null").count() == 0 and table.read().where("unsafe_score is null").count() == 0


def test_detection_fails_openly_only_on_request(spark):
    rows = spark.createDataFrame([(b"x",)], "content binary")

    def broken(contents):
        raise OSError("no weights")

    got = scorers.apply_scorer(rows, lambda: broken, "has_person", "boolean").first()
    assert got.has_person is None and "no weights" in got.has_person_error
    assert scorers.apply_scorer(rows, lambda: broken, "has_person", "boolean", fail_open=True).first().has_person is False
    with pytest.raises(ValueError):
        scorers.resolve("person", "missing")
    assert scorers.resolve("face", "off") is None


def test_command_line(spark, folder, tmp_path, models, capsys):
    said = lambda: json.loads(capsys.readouterr().out)
    assert cli.main(["dedup", "--input", str(folder), "--unkept", str(tmp_path / "u"), "--copy-instead", "--similarity", "0.95", "--rep-policy", "first"], spark) == 0
    assert said() == {"total": 7, "rejected_exact": 1, "rejected_near": 1, "survivors": 5}
    assert cli.main(["export", "--input", str(folder), "--unkept", str(tmp_path / "u"), "--kept", str(tmp_path / "k"), "--kept-side", "16"], spark) == 0
    assert said()["exported"] == 4
    scores = str(tmp_path / "scores")
    files.collect_inputs(spark, [str(folder)], content=False).select("path", F.when(F.col("path").endswith("b.jpg"), 0.9).when(~F.col("path").endswith("grey.png"), 0.1).alias("unsafe_score")).write.parquet(scores)
    assert cli.main(["nsfw", "--src", str(folder), "--dst", str(tmp_path / "safe"), "--copy", "--scores", scores], spark) == 0
    got = said()
    assert (got["total"], got["moved"], got["blocked"], got["skipped"]) == (7, 5, 1, 1)
    detections = str(tmp_path / "detections")
    spark.createDataFrame([(str(folder / "a.png"), "x"), (str(folder / "b.jpg"), "y"), (str(folder / "broken.jpg"), "z")], "path string, category string").write.parquet(detections)
    assert cli.main(["seed", "--detections", detections, "--output", str(tmp_path / "seed"), "--side", "16"], spark) == 0
    assert said()["processed"] == 2
    assert cli.main(["cache", "--db", str(tmp_path / "u" / ".features"), "info"], spark) == 0
    assert said()["total_rows"] == 7
    assert cli.main(["cache", "--db", str(tmp_path / "u" / ".features"), "prune"], spark) == 0
    assert said() == {"pruned": 0}
    assert cli.main(["dedup", "--input", str(tmp_path / "none"), "--unkept", str(tmp_path / "u")], spark) == 2
