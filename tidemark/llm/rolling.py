"""Rolling and piecewise hashes over code points, vectorised over one text."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_MULTIPLIER = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_MULTIPLIER), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gear_table(bits: int = 8) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed((np.arange(1 << bits, dtype=np.uint64) + U64(1)) * _MULTIPLIER) >> U64(32)).astype(np.uint32)


_GEAR = gear_table()


def gear(points: np.ndarray) -> np.ndarray:
    """Gear hash at each code point: h = (h << 1) + table[c] over 32 bits, which is a sum over the
    last 32 code points; doubling the span of partial sums gives all of them in five steps."""
    h = _GEAR[(points ^ (points >> np.uint32(8))) & np.uint32(255)].copy()
    span = 1
    while span < 32:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def trigger(points: np.ndarray, window: int = 7) -> np.ndarray:
    """Rolling hash of the last ``window`` code points."""
    wide = points.astype(np.uint32)
    h = np.zeros(len(wide), dtype=np.uint32)
    factor = 1
    for back in range(min(window, len(wide))):
        h[back:] += wide[: len(wide) - back] * np.uint32(factor)
        factor = factor * 0x01000193 & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    held = _POWERS.get(name)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 14), base, dtype=np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        if len(held) <= 1 << 18:
            _POWERS[name] = held
    return held[:n]


def piece_hashes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces that end (exclusive) at ``ends``: a polynomial in each piece's own
    code points, from differences of one prefix sum. A piece may be empty, also where there are no code points."""
    n = len(points)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + U64(1)) * _powers(n, _MULTIPLIER, "up"), dtype=np.uint64)])
        starts = np.concatenate([np.zeros(1, ends.dtype), ends[:-1]])
        own = (prefix[ends] - prefix[starts]) * _powers(n + 1, _INVERSE, "down")[starts]  # an empty piece may start at n
    return mixed(own)


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and byte length of each word of UTF-8 ``data``: a polynomial in the word's own bytes,
    from differences of one prefix sum."""
    points = np.frombuffer(data, dtype=np.uint8)
    gap = np.ones(len(points) + 2, dtype=bool)
    gap[1:-1] = (points == 32) | (points - np.uint8(9) < 5)
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[points] * _powers(len(points), _MULTIPLIER, "up"), out=prefix[1:])
        own = (prefix[ends] - prefix[starts]) * _powers(len(points), _INVERSE, "down")[starts]
    return mixed(own), ends - starts


def peaks(h: np.ndarray, reach: int) -> np.ndarray:
    """Positions whose value is above all ``reach`` values before and not below the ``reach`` after."""
    n = len(h)
    if n <= 2 * reach:
        return np.zeros(0, dtype=np.int64)
    best, span = h, 1
    while span * 2 <= reach:
        best = np.maximum(best[:-span], best[span:])
        span *= 2
    most = np.maximum(best[: n - reach + 1], best[reach - span :][: n - reach + 1]) if reach > span else best  # most[i]: of h[i : i + reach]
    at = np.arange(reach, n - reach)
    return at[(h[at] > most[at - reach]) & (h[at] >= most[at + 1])]


def last_maxima(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of the greatest value, the last one of equals, of every ``width`` neighbouring values."""
    if len(h) < width:
        return np.zeros(0, dtype=np.int64)
    best, span = (h.astype(np.uint64) << U64(32)) | np.arange(len(h), dtype=np.uint64), 1
    while span * 2 <= width:
        best = np.maximum(best[:-span], best[span:])
        span *= 2
    if width > span:
        best = np.maximum(best[: len(h) - width + 1], best[width - span :])
    at = (best & U64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def gram_hashes(points: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the ``width`` code points from each of ``starts``."""
    own = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            own = own * _MULTIPLIER + points[starts + i].astype(np.uint64) + U64(1)
    return mixed(own)
