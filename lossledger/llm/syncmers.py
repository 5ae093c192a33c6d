"""Operator 8, document fingerprints by closed syncmers.

A k-mer (K consecutive characters) is chosen if the least of the hashes of its S-character substrings lies at its first or
last place. Whether it is chosen depends on the k-mer alone, so that a passage has the same anchors in every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

#: Every passage of 2 K - S - 1 = 51 characters has an anchor.
K = 32
S = 12
#: Two primes, each with a base: the first orders the inner substrings, both together are the hash of a k-mer.
PRIMES = ((1 << 31) - 1, 65599), ((1 << 31) - 19, 69069)
_A, _B = 1103515245, 12345
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, p: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo p."""
    if p not in _POW or len(_POW[p][0]) < n:
        size = max(n, 1 << 21)
        out = []
        for b in (base, pow(base, -1, p)):
            a = np.ones(1, np.uint64)
            while len(a) < size:  # doubling: a * b**len(a)
                a = np.concatenate([a, a * np.uint64(pow(b, len(a), p)) % np.uint64(p)])
            out.append(a[:size])
        _POW[p] = out[0], out[1]
    return _POW[p][0][:n], _POW[p][1][:n]


def _sums(code: np.ndarray, p: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(code) + 1, p, base)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * power[: len(code)] % np.uint64(p), out=sums[1:])
    return sums, inverse


def _spans(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray | slice, end: np.ndarray | slice, p: int) -> np.ndarray:
    """Scrambled polynomial hashes of the characters from at to end."""
    h = (sums[end] - sums[at]) % np.uint64(p) * inverse[at] % np.uint64(p)
    return (h * np.uint64(_A) + np.uint64(_B)) % np.uint64(p)


def closed_syncmers(texts: pa.Array, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in characters, hash of the k-mer) of every chosen k-mer."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    buf, _ = _text.raw(texts)
    code = np.frombuffer(bytes(buf).decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(code)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=off[1:])
    if n < k:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    sums, inverse = _sums(code, *PRIMES[0])
    h = _spans(sums, inverse, slice(0, n + 1 - s), slice(s, n + 1), PRIMES[0][0]).astype(np.uint32)
    w = k - s + 1
    low, width = h, 1
    while width < w:  # minimum over w places by doubling
        step = min(width, w - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    low = low[: n - k + 1]
    pick = (h[: n - k + 1] == low) | (h[w - 1 : w - 1 + n - k + 1] == low)
    at = np.flatnonzero(pick)
    row = np.searchsorted(off, at, "right") - 1
    inside = at + k <= off[row + 1]
    at, row = at[inside], row[inside]
    one, two = _spans(sums, inverse, at, at + k, PRIMES[0][0]), _spans(*_sums(code, *PRIMES[1]), at, at + k, PRIMES[1][0])
    return row, at - off[row], one << np.uint64(31) | two


def _run(k: int, s: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _text.slices(b.column(1), 1 << 20):
                part = b.slice(lo, hi - lo)
                row, pos, h = closed_syncmers(part.column(1), k, s)
                cut = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(cut, pa.array(pos.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(h.astype(np.int64)))],
                    ["doc_id", "positions", "hashes"],
                )

    return run


def fingerprints(docs: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, positions, hashes): the anchors of each document in order, positions counted in characters from 0.

    Every row gives a row, repeated and null ids included; texts shorter than k, empty and null texts have empty lists.
    Equal inner hashes are ties: a k-mer whose edge hash equals the least is chosen. Hashes are below 2**62, so that
    unrelated k-mers hardly ever share one. Long texts are read whole. No shuffle, and no column besides the two is read.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(k, s), f"doc_id {dict(docs.dtypes)[id_col]}, positions array<int>, hashes array<bigint>")


def _sql() -> str:
    def term(width: int, at: str, k: int) -> str:
        p, _ = PRIMES[k]
        return f"((list_sum(list_transform(range({width}), lambda j: (c[{at} + j + 1] * pw{k}[j + 1])::HUGEINT)) % {p}) * {_A} + {_B}) % {p}"

    pows = ", ".join(f"{[pow(base, j, p) for j in range(K)]}::BIGINT[] AS pw{k}" for k, (p, base) in enumerate(PRIMES))
    return f"""
WITH t AS (SELECT doc_id, list_transform(string_split(text, ''), lambda x: unicode(x)::BIGINT) AS c, {pows} FROM documents),
i AS (SELECT doc_id, c, pw0, unnest(range(greatest(len(c) - {S} + 1, 0))) AS i FROM t),
h AS (SELECT doc_id, i, len(c) AS n, {term(S, "i", 0)} AS h FROM i),
m AS (SELECT doc_id, i, n, h, min(h) OVER o AS low, last_value(h) OVER o AS z FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {K - S} FOLLOWING)),
p AS (SELECT doc_id, i FROM m WHERE i + {K} <= n AND (h = low OR z = low)),
q AS (SELECT p.doc_id, i, ({term(K, "i", 0)} * 2147483648 + {term(K, "i", 1)})::BIGINT AS hk FROM p JOIN t USING (doc_id)),
g AS (SELECT doc_id, list(i::INTEGER ORDER BY i) AS positions, list(hk ORDER BY i) AS hashes FROM q GROUP BY 1)
SELECT d.doc_id, coalesce(array_to_string(g.positions, ','), '') AS positions, coalesce(array_to_string(g.hashes, ','), '') AS hashes FROM documents d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
