"""Operator 10, quality rules by repetition coverage.

For each of several n-gram lengths, the share of a document's word characters that lie in a repeat, that is in an n-gram
that occurred before in the same document (overlaps count once); and the share of the characters of its lines that are repeats of
an earlier line. N-grams are compared by rolling 64-bit hashes of word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

#: The largest share of characters in repeated n-grams that is kept, by n, and that in repeated lines.
MAX_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINES = 0.20


def repeat_chars(w: _text.Words, lengths: list[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Characters of words by row, and those inside repeats for each n. lengths ascend."""
    chars = w.chars()
    n_rows = len(w.first) - 1
    total = np.bincount(w.doc, chars, n_rows)
    last = w.first[1:][w.doc]
    at = np.arange(len(w.hash))
    h, made, out = w.hash.copy(), 1, {}
    for n in lengths:
        # a repeated n-gram starts with a repeated shorter one: only starts that still have a partner go on
        for k in range(made, n):
            ok = at + k < last[at]
            at, h = at[ok], h[ok]
            h = _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[at + k])
        made = n
        key = pd.Series(h ^ _text.mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
        later = key.duplicated().to_numpy()
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, at[later], 1)
        np.add.at(cover, at[later] + n, -1)
        out[n] = np.bincount(w.doc, chars * (np.cumsum(cover[:-1]) > 0), n_rows)
        some = later | key.duplicated(keep="last").to_numpy()
        at, h = at[some], h[some]
    return total, out


def line_chars(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of non-blank lines by row, and those of lines that occurred before in the row. Spaces at ends don't count."""
    buf, off = _text.raw(texts)
    rows = len(off) - 1
    if not len(buf):
        return np.zeros(rows), np.zeros(rows)
    nl = np.flatnonzero(buf == 10)
    start = np.union1d(off[:-1][np.diff(off) > 0], nl + 1)
    start = start[start < len(buf)]
    row = np.searchsorted(off, start, "right") - 1
    end = np.minimum(np.append(nl, len(buf))[np.searchsorted(nl, start)], off[row + 1])
    ink = np.flatnonzero(buf != 32)
    if not len(ink):
        return np.zeros(rows), np.zeros(rows)
    a = np.searchsorted(ink, start)
    z = np.searchsorted(ink, end) - 1
    ok = a <= z
    start, end, row = ink[a[ok]], ink[z[ok]] + 1, row[ok]
    h = _text.hashes(buf, start, end) ^ _text.mix(row.astype(np.uint64) + np.uint64(1))
    c = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=c[1:])
    n = c[end] - c[start]
    return np.bincount(row, n, rows), np.bincount(row, n * pd.Series(h).duplicated().to_numpy(), rows)


def _run(max_share: dict[int, float], max_lines: float):
    lengths = sorted(max_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _text.slices(b.column(1)):
                part = b.slice(lo, hi - lo)
                total, rep = repeat_chars(_text.words(part.column(1)), lengths)
                lines, again = line_chars(part.column(1))
                share = {n: np.round(rep[n] / np.maximum(total, 1), 6) for n in lengths}
                of_lines = np.round(again / np.maximum(lines, 1), 6)
                keep = of_lines <= max_lines
                for n in lengths:
                    keep &= share[n] <= max_share[n]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(share[n]) for n in lengths], pa.array(of_lines), pa.array(keep)], ["doc_id", *[f"rep_{n}" for n in lengths], "rep_lines", "keep"])

    return run


def repetition(docs: DataFrame, max_share: dict[int, float] | None = None, max_lines: float = MAX_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rep_<n> for each n, rep_lines, keep) of every row, shares rounded to 6 places.

    Words are those of _text (lower-cased); lines are split at newlines, compared exactly but for spaces at their ends, blank ones left out.
    Null, empty and wordless texts have shares 0 and are kept. Null and repeated ids give a row for each input row. No
    shuffle; other columns are neither read nor returned.
    """
    max_share = MAX_SHARE if max_share is None else max_share
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"rep_{n} double" for n in sorted(max_share)) + ", rep_lines double, keep boolean"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(max_share, max_lines), schema)


def _sql() -> str:
    grams = []
    for n in sorted(MAX_SHARE):
        key = ", ".join(["w"] + [f"lead(w, {k}) OVER o AS w{k}" for k in range(1, n)])
        names = ", ".join(["w"] + [f"w{k}" for k in range(1, n)])
        grams.append(
            f"g{n} AS (SELECT doc_id, i, {key} FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)), "
            f"r{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, {names} ORDER BY i) AS k FROM g{n} WHERE w{n - 1} IS NOT NULL) WHERE k > 1), "
            f"c{n} AS (SELECT doc_id, sum(len(w)) AS c FROM words WHERE (doc_id, i) IN (SELECT (doc_id, i + d) FROM r{n}, range({n}) t(d)) GROUP BY 1)"
        )
    share = ", ".join(f"round(coalesce(c{n}.c, 0) / greatest(coalesce(t.c, 0), 1)::DOUBLE, 6) AS rep_{n}" for n in sorted(MAX_SHARE))
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = d.doc_id" for n in sorted(MAX_SHARE))
    keep = " AND ".join(f"rep_{n} <= {v}" for n, v in MAX_SHARE.items())
    return f"""
WITH b AS (SELECT doc_id, regexp_extract_all(lower(text), '{_text.WORD_RE}') AS ws, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM b), {", ".join(grams)},
t AS (SELECT doc_id, sum(len(w)) AS c FROM words GROUP BY 1),
l AS (SELECT doc_id, sum(len(l)) AS c, sum(len(l)) FILTER (k > 1) AS again FROM (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l) AS k FROM (SELECT doc_id, unnest(ls) AS l FROM b)) GROUP BY 1),
s AS (SELECT d.doc_id, {share}, round(coalesce(l.again, 0) / greatest(coalesce(l.c, 0), 1)::DOUBLE, 6) AS rep_lines
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id {joins})
SELECT *, {keep} AND rep_lines <= {MAX_LINES} AS keep FROM s
"""


SQL = _sql()
