"""Vectorised text kernel: words, word hashes and k-gram hashes of whole Arrow batches.

Texts are handled as UTF-8 bytes. All word classes in this package are unions of ASCII
bytes and "every byte from 0x80", so byte runs equal code point runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles; a longer text makes a step of its own.
STEP_BYTES = 1 << 20
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.r) < n:
        m = max(n, STEP_BYTES + 1)
        r = np.full(m, _RADIX, np.uint64)
        r[0] = 1
        i = np.full(m, np.uint64(pow(int(_RADIX), -1, 1 << 64)), np.uint64)
        i[0] = 1
        _powers.r, _powers.i = np.cumprod(r), np.cumprod(i)
    return _powers.r, _powers.i


_powers.r = _powers.i = np.empty(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    codes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    codes[65:91] = codes[97:123]  # A-Z count as a-z
    return codes


CODES = _byte_codes()


def _table(good: str) -> np.ndarray:
    t = np.zeros(256, bool)
    if good == "alnum":
        t[0x30:0x3A] = t[0x61:0x7B] = t[0x41:0x5B] = True
        t[0x80:] = True
    else:
        t[:] = True
        t[0x20] = False
        t[0x09:0x0E] = False
    return t


#: alnum: digits, letters and all beyond ASCII; space: everything but ASCII white space.
WORD_CLASSES = {"alnum": _table("alnum"), "space": _table("space")}


class Step:
    """Some rows of a batch: row range, bytes, byte offsets of the rows."""

    __slots__ = ("lo", "hi", "data", "at")

    def __init__(self, lo: int, hi: int, data: np.ndarray, at: np.ndarray):
        self.lo, self.hi, self.data, self.at = lo, hi, data, at

    def words(self, kind: str) -> Words:
        return Words(self, WORD_CLASSES[kind])

    def raw(self, i: int) -> bytes:
        """Bytes of row i, counted from lo."""
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


class Words:
    """begin, end: byte range of each word; of: word range of each row (length rows + 1)."""

    __slots__ = ("begin", "end", "of", "step")

    def __init__(self, step: Step, table: np.ndarray):
        n, self.step = len(step.data), step
        m = table[step.data]
        cut = step.at[(step.at > 0) & (step.at < n)]
        before = np.zeros(n, bool)
        before[1:] = m[:-1]
        before[cut] = False
        after = np.zeros(n, bool)
        after[:-1] = m[1:]
        after[cut - 1] = False
        self.begin = np.flatnonzero(m & ~before)
        self.end = np.flatnonzero(m & ~after) + 1
        self.of = np.searchsorted(self.begin, step.at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word with A-Z lower-cased."""
        n = len(self.step.data)
        r, inverse = _powers(n)
        v = CODES[self.step.data]
        v *= r[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(v, out=total[1:])
        return mix((total[self.end] - total[self.begin]) * inverse[self.begin])

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; k - 1 shorter than h, rows not minded."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    m = len(h) - k + 1
    out = h[:m].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : j + m]
    return mix(out)


def text_steps(column: pa.Array, step_bytes: int = STEP_BYTES, step_rows: int = 4096) -> Iterator[Step]:
    """Split a string column into steps of bounded bytes (or one text) and rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step_bytes, "right")) - 1)
        hi = min(hi, lo + step_rows, len(column))
        yield Step(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi
