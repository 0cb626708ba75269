"""Image kernels on arrays of shape (height, width, 3), 8 bits a channel; NumPy only.

Resampling follows the usual convolution with a support widened by the reduction, each pass rounded to 8 bits.
Metrics aim at the reference formulas, not at another library's last bit.
"""

from __future__ import annotations

import numpy as np

FLAT = 12
SHARPNESS_EDGE, COLOUR_EDGE = 800, 256


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


FILTERS = {"lanczos": (_lanczos, 3.0), "bilinear": (_triangle, 1.0)}


def _weights(size: int, target: int, kind: str) -> np.ndarray:
    shape, support = FILTERS[kind]
    ratio = size / target
    stretch = max(1.0, ratio)
    centre = (np.arange(target) + 0.5) * ratio
    at = np.arange(size) + 0.5
    x = at[None, :] - centre[:, None]
    w = np.where(np.abs(x) < support * stretch, shape(x / stretch), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int, kind: str = "lanczos") -> np.ndarray:
    out = image.astype(np.float64)
    if out.shape[1] != width:
        out = np.clip(np.rint(np.einsum("tx,yx...->yt...", _weights(out.shape[1], width, kind), out, optimize=True)), 0, 255)
    if out.shape[0] != height:
        out = np.clip(np.rint(np.einsum("ty,yx...->tx...", _weights(out.shape[0], height, kind), out, optimize=True)), 0, 255)
    return out.astype(np.uint8)


def fitted(image: np.ndarray, edge: int, kind: str = "bilinear") -> np.ndarray:
    """Reduced to fit a square of this edge, in proportion; never enlarged."""
    h, w = image.shape[:2]
    if max(h, w) <= edge:
        return image
    long, short = max(h, w), min(h, w)
    exact = short * edge / long
    near = max(1, min((int(exact), int(exact) + 1), key=lambda n: abs(long / short - edge / n) if n else float("inf")))
    return resize(image, *((edge, near) if w >= h else (near, edge)), kind)


def grey(image: np.ndarray) -> np.ndarray:
    r, g, b = (image[..., i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16).astype(np.uint8)


def laplacian_variance(plane: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian; the border mirrors without repeating the edge."""
    edges = [(1, 1) if n > 1 else (0, 0) for n in plane.shape]
    p = np.pad(plane.astype(np.float64), edges, mode="reflect")
    p = np.pad(p, [(0, 0) if n > 1 else (1, 1) for n in plane.shape], mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def sharpness_full(image: np.ndarray) -> float:
    """At full resolution; only for the choice of a representative."""
    return laplacian_variance(grey(image))


def sharpness_norm(image: np.ndarray) -> float:
    """At a common resolution; for the blur rule."""
    return laplacian_variance(grey(fitted(image, SHARPNESS_EDGE)))


def saturation(image: np.ndarray) -> float:
    """Mean of the S of HSV, 0 to 255."""
    small = fitted(image, COLOUR_EDGE).astype(np.int32)
    high, low = small.max(-1), small.min(-1)
    return float(np.where(high > 0, 255 * (high - low) // np.maximum(high, 1), 0).mean())


def flat_run(lines: np.ndarray) -> int:
    """How many lines from the first are flat: at most FLAT between their extremes, over pixels and channels together."""
    spread = lines.reshape(len(lines), -1).max(1).astype(int) - lines.reshape(len(lines), -1).min(1)
    broken = np.flatnonzero(spread > FLAT)
    return int(broken[0]) if len(broken) else len(lines)


def border_fraction(image: np.ndarray) -> float:
    if not image.size:
        return 0.0
    rows, columns = image, image.swapaxes(0, 1)
    return max(max(flat_run(x), flat_run(x[::-1])) / len(x) for x in (rows, columns))


def quality(image: np.ndarray) -> tuple[float, float, float]:
    return sharpness_norm(image), saturation(image), border_fraction(fitted(image, COLOUR_EDGE))


def _dct(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return 2 * np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def perceptual_hash(image: np.ndarray, size: int = 16) -> list[int]:
    """size * size bits, row by row, as signed 64-bit words, highest first."""
    small = resize(grey(image), 4 * size, 4 * size).astype(np.float64)
    m = _dct(4 * size)
    low = (m @ small @ m.T)[:size, :size]
    bits = (low > np.median(low)).astype(np.uint8).ravel()
    return np.packbits(bits).view(">i8").tolist()


def crop_square(image: np.ndarray, side: int = 300) -> np.ndarray:
    """The centred square at this side; smaller images are enlarged first."""
    h, w = image.shape[:2]
    scale = max(side / w, side / h, 1.0)
    if scale > 1:
        image = resize(image, round(w * scale), round(h * scale))
        h, w = image.shape[:2]
    edge = min(w, h)
    left, top = (w - edge) // 2, (h - edge) // 2
    return resize(image[top : top + edge, left : left + edge], side, side)


def turned(image: np.ndarray, orientation: int) -> np.ndarray:
    """Upright for an EXIF orientation of 1 to 8."""
    flips = {2: (1,), 3: (0, 1), 4: (0,)}
    if orientation in flips:
        return np.flip(image, flips[orientation])
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
        return np.flip(image, {5: (), 6: (1,), 7: (0, 1), 8: (0,)}[orientation])
    return image
