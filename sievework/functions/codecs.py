"""Small image codecs without an image library: PNG both ways, baseline JPEG out, EXIF orientation."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter

import numpy as np

PIXELS = 933_120_000


def png(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    colour = 2 if image.ndim == 3 else 0
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray | None:
    """RGB of a PNG without interlacing at 8 or 16 bits; None for anything else or damage."""
    try:
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, body, palette = 8, b"", None
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
                if interlace or depth not in (8, 16) or w * h > PIXELS:
                    return None
            elif kind == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body += part
            at += 12 + size
        channels, step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour], depth // 8
        unit = channels * step
        lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * unit)
        image = _unfiltered(lines[:, 0], lines[:, 1:], unit).reshape(h, w, channels, step)[..., 0]
        if colour == 3:
            return palette[image[..., 0]]
        return np.repeat(image[..., :1], 3, 2) if channels < 3 else image[..., :3].copy()
    except (KeyError, ValueError, IndexError, TypeError, UnboundLocalError, struct.error, zlib.error):
        return None


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, unit: int) -> np.ndarray:
    """The rows of a PNG without their filters; kinds has the filter of each row."""
    h, n = lines.shape
    out = np.zeros((h, n), np.uint8)
    if (kinds < 3).all():  # each row at once
        above = np.zeros(n, np.uint8)
        for y, kind in enumerate(kinds.tolist()):
            line = lines[y]
            above = out[y] = line + above if kind == 2 else np.add.accumulate(line.reshape(-1, unit), 0, dtype=np.uint8).ravel() if kind == 1 else line
        return out
    # a pixel needs those to the left, above and between: pixels on one diagonal are independent
    w = n // unit
    left_of = np.isin(kinds, (1, 3, 4))[:, None]
    full = np.zeros((h + 1, w + 1, unit), np.int16)
    raw = lines.reshape(h, w, unit).astype(np.int16)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = full[y + 1, x], full[y, x + 1], full[y, x]
        p = left + up - corner
        by_left, by_up, by_corner = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        kind = kinds[y][:, None]
        guess = np.where(kind == 4, paeth, np.where(kind == 3, (left + up) >> 1, np.where(left_of[y], left, np.where(kind == 2, up, 0))))
        full[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return full[1:, 1:].reshape(h, n).astype(np.uint8)


def orientation(data: bytes) -> int:
    """The EXIF orientation of a JPEG, 1 where there is none."""
    at = data.find(b"Exif\0\0", 0, 65_536)
    if data[:2] != b"\xff\xd8" or at < 0:
        return 1
    tiff = data[at + 6 : at + 6 + 65_536]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        (first,) = struct.unpack_from(f"{order}I", tiff, 4)
        (n,) = struct.unpack_from(f"{order}H", tiff, first)
        for i in range(n):
            tag, _, _, value = struct.unpack_from(f"{order}HHIH", tiff, first + 2 + 12 * i)
            if tag == 0x0112:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


#: Fixed values of the JPEG standard (Annex K): quantisation of luminance and chrominance, row by row.
LUMINANCE = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMINANCE = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32


def zigzag() -> np.ndarray:
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))


def _code_lengths(counts: dict[int, int]) -> tuple[list[int], list[int]]:
    """Codes of each length from 1 to 16, and the symbols by rising length; the all-ones code stays free."""
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, (-1,))]
    heapq.heapify(heap)
    depth: Counter = Counter()
    number = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        depth.update(a + b)
        heapq.heappush(heap, (n + m, number := number + 1, a + b))
    bits = Counter(depth.values())
    for length in range(max(bits, default=0), 16, -1):  # codes beyond 16 bits are moved up in pairs
        while bits[length]:
            free = next(k for k in range(length - 2, 0, -1) if bits[k])
            bits[length] -= 2
            bits[length - 1] += 1
            bits[free + 1] += 2
            bits[free] -= 1
    longest = max(k for k, n in bits.items() if n)
    bits[longest] -= 1
    symbols = sorted((s for s in depth if s >= 0), key=lambda s: (depth[s], -counts[s], s))
    return [bits[k] for k in range(1, 17)], symbols


def _codes(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out[s] = code, length
            code += 1
        at, code = at + n, code << 1
    return out


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def _entropy_steps(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, symbol, extra bits, their number) of the blocks' coefficients in zigzag order; blocks of the three planes
    take turns. Tables 0 and 1 are for the first coefficient, 2 and 3 for the others."""
    n = len(blocks)
    chroma = (np.arange(n) % 3 > 0).astype(np.int64)
    first = blocks[:, 0].astype(np.int64)
    diff = first - np.concatenate([np.zeros(3, np.int64), first[:-3]])[:n]
    owner, at = np.nonzero(blocks[:, 1:])
    at = at + 1
    value = blocks[owner, at].astype(np.int64)
    new = np.diff(owner, prepend=-1) != 0
    run = at - np.where(new, 0, np.concatenate([[0], at[:-1]])) - 1
    long = run // 16  # each a step of its own
    last = np.zeros(n, np.int64)
    np.maximum.at(last, owner, at)
    ends = np.flatnonzero(last < 63)
    # (place in the scan, table, symbol, value) of all four sorts of steps; 66 places a block and two for each coefficient
    many = np.repeat(np.arange(len(at)), long)
    size_0, size = _bit_length(np.abs(diff)), _bit_length(np.abs(value))
    place = np.concatenate([np.arange(n) * 130, owner[many] * 130 + 2 * at[many], owner * 130 + 2 * at + 1, ends * 130 + 129])
    table = np.concatenate([chroma, 2 + chroma[owner[many]], 2 + chroma[owner], 2 + chroma[ends]])
    symbol = np.concatenate([size_0, np.full(len(many), 0xF0), run % 16 << 4 | size, np.zeros(len(ends), np.int64)])
    bits = np.concatenate([size_0, np.zeros(len(many), np.int64), size, np.zeros(len(ends), np.int64)])
    number = np.concatenate([diff, np.zeros(len(many), np.int64), value, np.zeros(len(ends), np.int64)])
    extra = np.where(number >= 0, number, number + (1 << bits) - 1)
    order = np.argsort(place, kind="stable")
    return table[order].astype(np.int64), symbol[order].astype(np.int64), extra[order], bits[order].astype(np.int64)


def _packed_bits(value: np.ndarray, length: np.ndarray) -> bytes:
    """Numbers of so many bits (32 at most) one after the other, the last byte filled with ones."""
    owner = np.repeat(np.arange(len(value)), length)
    end = np.cumsum(length)
    shift = end[owner] - 1 - np.arange(len(owner))
    bits = (value[owner] >> shift & 1).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def jpeg(image: np.ndarray, quality: int = 92) -> bytes:
    """A baseline JPEG without subsampling, with Huffman tables made for the image."""
    h, w = image.shape[:2]
    rgb = np.pad(image.astype(np.float64), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y - 128, (b - y) / 1.772, (r - y) / 1.402]
    scale = 5000 / max(1, quality) if quality < 50 else 200 - 2 * min(quality, 100)
    tables = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE)]
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    dct = np.cos(np.pi * k * (2 * x + 1) / 16) / 2
    dct[0] /= np.sqrt(2)
    order = zigzag()
    blocks = []
    for plane, table in zip(planes, (tables[0], tables[1], tables[1]), strict=True):
        tiles = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        blocks.append(np.rint((dct @ tiles @ dct.T).reshape(-1, 64) / table).astype(int)[:, order])
    table, symbol, extra, size = _entropy_steps(np.stack(blocks, 1).reshape(-1, 64))
    counts = np.bincount(table * 256 + symbol, minlength=1024).reshape(4, 256)
    huffman = [_code_lengths({int(s): int(c[s]) for s in np.flatnonzero(c)} or {0: 1}) for c in counts]
    code, length = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    for t, own in enumerate(huffman):
        for s, (bits, n) in _codes(*own).items():
            code[t, s], length[t, s] = bits, n
    scan = _packed_bits(code[table, symbol] << size | extra, length[table, symbol] + size).replace(b"\xff", b"\xff\x00")
    part = lambda mark, data: b"\xff" + bytes([mark]) + struct.pack(">H", len(data) + 2) + data
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += b"".join(part(0xDB, bytes([i, *t[order].astype(int).tolist()])) for i, t in enumerate(tables))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    out += b"".join(part(0xC4, bytes([kind, *lengths, *symbols])) for kind, (lengths, symbols) in zip((0x00, 0x01, 0x10, 0x11), huffman, strict=True))
    return out + part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + scan + b"\xff\xd9"
