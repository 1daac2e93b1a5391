"""Vectorised work on Arrow text columns: slices, word bounds and word hashes in numpy.

A word is a run of bytes outside 0x20 and 0x09-0x0D, the same as
``[^\\x20\\x09-\\x0D]+`` on the text, because UTF-8 uses those bytes for nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
BYTE_KEYS = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base's powers 0..n-1 and their inverses modulo 2**64; kept up to 2 Mi values."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > 1 << 21:
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def as_binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of bytes with 64-bit offsets; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(column: pa.Array, limit: int = 1 << 19, most: int = 50_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most limit bytes, or of one row, and of at most so many rows: first row, end row, bytes, row offsets."""
    n = len(column)
    if not n:
        return
    _, offs_buf, data = column.buffers()
    offs = np.frombuffer(offs_buf, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        b = min(b, n, a + most)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def blank_cuts(buf: np.ndarray, limit: int) -> list[int]:
    """Ends of parts of about limit bytes that each end with a blank, but for the last; a word is never cut."""
    ends, at = [], 0
    while len(buf) - at > limit:
        found = np.flatnonzero(SPACE[buf[at + limit // 2 : at + limit]])
        if len(found):
            at += limit // 2 + int(found[-1]) + 1
        else:  # a word longer than that: on to its end
            step = at + limit
            while step < len(buf) and not len(found := np.flatnonzero(SPACE[buf[step : step + limit]])):
                step += limit
            if step >= len(buf):
                break
            at = step + int(found[0]) + 1
        ends.append(at)
    return [*ends, len(buf)]


#: One part of a run of rows: its bytes, its rows' offsets in them, and whether the rows end with it.
Part = tuple[np.ndarray, np.ndarray, bool]


def runs(column: pa.Array, limit: int = 1 << 19, most: int = 50_000) -> Iterator[tuple[int, int, Iterator[Part]]]:
    """As slices, but a row longer than limit comes alone and in parts cut at blanks, so that one text's size bounds nothing but itself."""
    for a, b, buf, offs in slices(column, limit, most):
        if len(buf) <= 2 * limit:
            yield a, b, iter([(buf, offs, True)])
        else:
            ends = blank_cuts(buf, limit)
            yield a, b, ((buf[s:e], np.array([0, e - s]), e == len(buf)) for s, e in zip([0, *ends], ends, strict=False))


def parts_of(text: bytes, limit: int = 1 << 21) -> Iterator[bytes]:
    """A text in parts of about limit bytes, cut at blanks."""
    if len(text) <= 2 * limit:
        yield text
        return
    ends = blank_cuts(np.frombuffer(text, np.uint8), limit)
    for a, b in zip([0, *ends], ends, strict=False):
        yield text[a:b]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; rows bound words."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = ~SPACE[buf]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    o = offs[:-1]
    o = o[o < len(buf)]
    first[o] = m[o]
    o = offs[1:] - 1
    o = o[o >= 0]
    last[o] = m[o]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offs, start, side="right") - 1


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running sums of keyed bytes times powers; substring hashes are differences of these."""
    pw, _ = powers(len(buf))
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_KEYS[buf] * pw, out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes, equal hashes, wherever they stand."""
    _, inv = powers(len(pre))
    return finish((pre[end] - pre[start]) * inv[start])
