"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.config import SUFFIXES


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def suffix(path: Column | str) -> Column:
    """The last dot and what follows it in the file name, in lower case; empty without one."""
    return F.lower(F.regexp_extract(_c(path), r"[^/](\.[^./]+)$", 1))


def is_image_path(path: Column | str) -> Column:
    return suffix(path).isin(*SUFFIXES)


def url_path(url: Column | str) -> Column:
    return F.regexp_replace(_c(url), r"[?#].*$", "")


def relative_path(path: Column | str, root: Column | str) -> Column:
    """What follows the root in a path, with forward slashes; the file name if the path lies elsewhere."""
    path, root = F.replace(_c(path), F.lit("\\"), F.lit("/")), F.rtrim(F.replace(_c(root), F.lit("\\"), F.lit("/")), F.lit("/"))
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(root) + 2, F.length(path))).otherwise(F.substring_index(path, "/", -1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(_c(path), "/", -1), r"(?<=.)\.[^.]*$", "")


def stem_order(path: Column | str) -> list[Column]:
    """Sort keys: numeric stems by value first, then the others by text."""
    number = F.regexp_extract(stem(path), r"^\s*[+-]?\d+\s*$", 0).try_cast("bigint")
    return [number.isNull(), number, stem(path), _c(path)]


def sha256_hex(content: Column | str) -> Column:
    return F.sha2(_c(content).cast("binary"), 256)


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(1e6)


def hash_words(hex64: Column | str) -> Column:
    """64 hexadecimal digits as four signed longs, highest first."""
    digits = F.lpad(F.lower(_c(hex64)), 64, "0")
    return F.array(*[F.conv(F.substring(digits, 1 + 16 * i, 16), 16, -10).cast("bigint") for i in range(4)])


def hash_hex(words: Column | str) -> Column:
    """The inverse of hash_words: 64 digits in lower case, zero-padded."""
    return F.lower(F.array_join(F.transform(_c(words), lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two arrays of longs."""
    bits = F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


def hamming_words(a: str, b: str, words: int) -> Column:
    """The same without a lambda, for arrays of a known size: it stays in generated code."""
    out = F.lit(0)
    for i in range(words):
        out = out + F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i))))
    return out


def bucket32(words: Column | str) -> Column:
    """The top 32 of 256 bits."""
    return F.shiftrightunsigned(F.get(_c(words), F.lit(0)), 32)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, accumulated in double whatever the storage width."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column | str) -> Column:
    """Unit length in double; null for null, empty and zero vectors, which never match anything."""
    v = _c(v)
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def unsafe_from_similarities(best_unsafe: Column | str, best_safe: Column | str) -> Column:
    """Softmax over the best similarity of either class."""
    return 1 / (1 + F.exp(_c(best_safe) - _c(best_unsafe)))


#: Labels that count as unsafe.
UNSAFE_LABELS = ("nsfw", "porn", "explicit")


def unsafe_from_labels(labels: Column | str) -> Column:
    """The highest score among unsafe labels of an array<struct<label, score>>; 0 without one, null for no array."""
    scores = F.transform(F.filter(_c(labels), lambda x: F.lower(x["label"]).isin(*UNSAFE_LABELS)), lambda x: x["score"].cast("double"))
    return F.when(_c(labels).isNotNull(), F.greatest(F.coalesce(F.array_max(scores), F.lit(0.0)), F.lit(0.0)))


def has_class(boxes: Column | str, conf: float, cls: int = 0) -> Column:
    """Whether an array<struct<cls, conf>> of boxes has one of the class at the confidence or above."""
    return F.exists(_c(boxes), lambda b: (b["cls"] == cls) & (b["conf"] >= conf))


def crop_box(width: Column | str, height: Column | str, side: int) -> Column:
    """Geometry of the centred square: size after upscaling, then left, top and edge of the crop."""
    w, h = _c(width), _c(height)
    scale = F.greatest(F.lit(side) / w, F.lit(side) / h, F.lit(1.0))
    w2, h2 = F.bround(w * scale).cast("int"), F.bround(h * scale).cast("int")
    edge = F.least(w2, h2)
    half = lambda x: F.floor((x - edge) / 2).cast("int")
    return F.struct(w2.alias("scaled_w"), h2.alias("scaled_h"), edge.alias("edge"), half(w2).alias("left"), half(h2).alias("top"))
