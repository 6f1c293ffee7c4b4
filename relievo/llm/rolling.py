"""Digests of byte and word stretches with numpy, for texts as Arrow delivers them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Text bytes worked on together; a longer document is worked on by itself.
CHUNK_BYTES = 1 << 20
LOW = np.uint64((1 << 32) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=8)
def _letters(lane: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15 + 2 * lane))


@lru_cache(maxsize=8)
def _powers(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)[lane]
    up, down = np.full(size, base, "uint64"), np.full(size, pow(base, -1, 1 << 64), "uint64")
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Stretches:
    """Digests of any stretch [start, end) of a sequence of 64-bit values, each in constant time.

    The digest is a polynomial modulo 2^64 over the values, from prefix sums; equal stretches have
    equal digests wherever they start.
    """

    def __init__(self, values: np.ndarray, lane: int):
        n = len(values)
        size = 1 << max(10, (n + 1).bit_length())
        up, self.down = _powers(lane, size)
        self.n, self.sums = n, np.zeros(n + 1, "uint64")
        np.cumsum(values * up[:n], out=self.sums[1:])

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(x + (end - start).astype("uint64") * np.uint64(0xC2B2AE3D27D4EB4F))

    def all_of(self, k: int) -> np.ndarray:
        """Digests of the stretches of length k from every start."""
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, "uint64")
        return mix((self.sums[k:] - self.sums[:m]) * self.down[:m] + np.uint64(k * 0xC2B2AE3D27D4EB4F % (1 << 64)))


def of_bytes(data: np.ndarray, lane: int) -> Stretches:
    return Stretches(_letters(lane)[data], lane)


def text_column(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts (one more for the end)."""
    col = batch.column(name)
    _, offsets, data = col.buffers()
    kind = "int64" if "large" in str(col.type) else "int32"
    at = np.frombuffer(offsets, kind)[col.offset:col.offset + len(col) + 1].astype("int64") if len(col) else np.zeros(1, "int64")
    return (np.frombuffer(data, "uint8") if data is not None else np.zeros(0, "uint8")), at


def parts(at: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (i, j) of about `limit` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each row.

    `data` begins at the first row; words are runs of bytes other than space, tab, LF, VT, FF, CR.
    """
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.diff(np.searchsorted(start, at))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    span = 1
    n = len(x)
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    out = n - width + 1
    return np.minimum(x[:out], x[width - span:width - span + out])


def anchored_runs(one: Stretches, counts: np.ndarray, k: int, window: int):
    """Runs of consecutive windows that have the same anchor.

    The anchor of a window is its stretch of k values with the smallest digest, the last of several.
    It depends on the window's content alone, so equal windows have equal anchors at equal places, and
    only windows under equal anchors need ever be compared.
    Windows lie within rows (`counts`: values of each row). Returns first and last window start,
    anchor position, digest of the anchor, and digest of the run's whole content.
    """
    n = one.n
    empty = np.zeros(0, "int64")
    if n < window:
        return empty, empty, empty, empty.astype("uint64"), empty.astype("uint64")
    g = one.all_of(k)
    key = (g & ~LOW) | (LOW - np.arange(len(g), dtype="uint64"))
    at = (LOW - (sliding_min(key, window - k + 1) & LOW)).astype("int64")
    ends = np.cumsum(counts)
    start = np.flatnonzero(np.arange(window, n + 1) <= np.repeat(ends, counts)[:n - window + 1])
    if not len(start):
        return empty, empty, empty, empty.astype("uint64"), empty.astype("uint64")
    at = at[start]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
    a, b, p = start[new], start[np.append(new[1:], len(start)) - 1], at[new]
    return a, b, p, g[p], one.digest(a, b + window)
