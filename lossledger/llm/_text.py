"""Vectorised text scanning shared by the corpus operators of this subpackage.

A *word* is a run of letters and digits of the lower-cased text: ASCII letters and digits and every non-ASCII code point except
Latin-1 signs (U+0080..U+00BF), general punctuation (U+2000..U+206F) and CJK punctuation (U+3000..U+303F).
WORD_RE is the same definition for SQL engines with RE2 syntax. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]+"

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if "p" not in _POW or len(_POW["p"]) < n:
        size = (1 << max(19, (n - 2).bit_length())) + 1  # of the slices that have been scanned, not of the largest that may come
        for name, base in (("p", _R), ("q", pow(_R, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
    return _POW["p"][:n], _POW["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array, target: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about target bytes; a longer text is a range of its own."""
    _, off = raw(texts)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + target, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words(NamedTuple):
    hash: np.ndarray  # uint64 for each word
    doc: np.ndarray  # row of each word
    start: np.ndarray  # byte range in buf
    end: np.ndarray
    first: np.ndarray  # first word of each row, and the number of words at the end
    buf: np.ndarray  # lower-cased bytes

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at these positions."""
        s, n = self.start[at], self.end[at] - self.start[at]
        off = np.zeros(len(at) + 1, np.int64)
        np.cumsum(n, out=off[1:])
        pos = np.arange(off[-1]) - np.repeat(off[:-1] - s, n)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off), pa.py_buffer(self.buf[pos].tobytes())).cast(pa.string())

    def chars(self) -> np.ndarray:
        """Code points in each word."""
        c = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=c[1:])
        return c[self.end] - c[self.start]


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range."""
    p, q = powers(len(buf) + 1)
    h = np.zeros(len(buf) + 1, np.uint64)
    w = buf.astype(np.uint64)  # in place: of these arrays, of 8 bytes for each of the text, there are two at a time
    w += np.uint64(1)
    w *= p[: len(buf)]
    np.cumsum(w, out=h[1:])
    return mix((h[end] - h[start]) * q[start])


def words(texts: pa.Array) -> Words:
    """All words of the texts, in order."""
    buf, off = raw(pc.utf8_lower(texts.cast(pa.large_string())) if len(texts) else texts)
    ok = _WORD_BYTE[buf]
    if len(buf) and buf.max() >= 0x80:
        for lead, seconds, n in ((0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3), (0xC2, None, 2)):
            at = np.flatnonzero(buf == lead)
            if len(at):
                if seconds:
                    at = at[np.isin(buf[np.minimum(at + 1, len(buf) - 1)], seconds)]
                    if 0x81 in seconds:  # U+2070 and above are letters here
                        at = at[(buf[at + 1] == 0x80) | (buf[np.minimum(at + 2, len(buf) - 1)] < 0xB0)]
                for k in range(n):
                    ok[at + k] = False
    n = len(buf)
    s, e = ok.copy(), ok.copy()
    if n:
        s[1:] &= ~ok[:-1]
        e[:-1] &= ~ok[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        s[cut] = ok[cut]
        e[cut - 1] = ok[cut - 1]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(hashes(buf, start, end), doc, start, end, first, buf)


def word_hash(words_: list[str] | pa.Array) -> np.ndarray:
    """The hashes that words() gives these words."""
    buf, off = raw(words_ if isinstance(words_, pa.Array) else pa.array(words_, pa.large_string()))
    return hashes(buf, off[:-1], off[1:])
