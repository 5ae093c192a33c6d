"""Operator 2, token ids in Simple-8b words.

A 64-bit word holds a selector in its upper 4 bits and, in the other 60, as many ids of equal width as the selector says.
Selector 15 is an escape: the next word is one id of 64 bits. Ids are coded in blocks of BLOCK; each block starts a new word, and its first
word's index is kept, so that all blocks decode at once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from .bpe import CACHE, PATTERN, VOCABULARY, unit_text, units

BLOCK = 128
#: ids in a word by selector, and their width
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 0])
WIDTH = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 64])
ESCAPE = 15


def encode(ids: np.ndarray, block_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the number of words) for blocks of consecutive ids that start at block_of."""
    ids = np.ascontiguousarray(ids).astype(np.int64).view(np.uint64)
    n, ends = len(ids), np.append(block_of[1:], len(ids)).astype(np.int64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    if int(ids.max()) < 1 << 20:
        bits = _BITS[ids.astype(np.int64)] if int(ids.max()) < 1 << 16 else np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    else:  # a double may round up to the next power of two
        high = (ids >> np.uint64(32)).astype(np.float64)
        low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
        bits = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)
    left = np.repeat(ends, ends - block_of) - np.arange(n)  # ids to the end of the block
    choice = np.full(n, ESCAPE, np.uint8)  # of the word that would start here
    choice[bits <= 60] = 13
    top = int(bits.max())
    for s in range(12, -1, -1):  # ever more, narrower ids; the last that fits wins
        if WIDTH[s] >= top:
            choice[:] = s
            continue
        narrow = np.flatnonzero(bits <= WIDTH[s])
        if len(narrow):  # how far the narrow ids go on from each of them
            last = np.append(np.flatnonzero(np.diff(narrow) > 1), len(narrow) - 1)
            run = np.repeat(narrow[last], np.diff(last, prepend=-1)) - narrow + 1
            choice[narrow[run >= np.minimum(COUNT[s], left[narrow])]] = s
    return _place(ids, choice, left, block_of, ends)


_BITS = np.zeros(1 << 16, np.uint8)
_BITS[1:] = np.floor(np.log2(np.arange(1, 1 << 16))).astype(np.uint8) + 1


def _place(ids: np.ndarray, choice: np.ndarray, left: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    take = np.where(choice == ESCAPE, 1, np.minimum(COUNT[choice], left))
    head = np.zeros(len(ids), bool)
    at = begin[begin < ends]
    limit = ends[begin < ends]
    while len(at):  # all blocks step from word to word together
        head[at] = True
        at = at + take[at]
        go = at < limit
        at, limit = at[go], limit[go]
    at = np.flatnonzero(head)
    size = 1 + (choice[at] == ESCAPE)
    where = np.cumsum(size) - size  # a word's place
    total = int(size.sum())
    words = np.zeros(total, np.uint64)
    words[where] = choice[at].astype(np.uint64) << np.uint64(60)
    esc = choice[at] == ESCAPE
    words[where[esc] + 1] = ids[at[esc]]
    for k in range(60):
        ok = ~esc & (take[at] > k)
        if not ok.any():
            break
        at_k, where_k = at[ok], where[ok]
        words[where_k] |= ids[at_k + k] << (WIDTH[choice[at_k]] * k).astype(np.uint64)
    first = np.searchsorted(at, begin)
    return words, np.append(np.append(where, total)[first], total)


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of a document from its words and block offsets; every block is decoded in step with the others."""
    words = np.ascontiguousarray(words).view(np.uint64)
    out = np.zeros(n, np.uint64)
    at = np.asarray(offsets, np.int64)[: -(-n // block)].copy()
    pos = np.arange(len(at)) * block
    end = np.minimum(pos + block, n)
    while len(at):
        w = words[at]
        s = (w >> np.uint64(60)).astype(np.int64)
        esc = s == ESCAPE
        take = np.where(esc, 1, np.minimum(COUNT[s], end - pos))
        out[pos[esc]] = words[np.minimum(at[esc] + 1, len(words) - 1)]
        for k in range(int(take.max())):
            ok = ~esc & (take > k)
            width = WIDTH[s[ok]].astype(np.uint64)
            out[pos[ok] + k] = (w[ok] >> (width * np.uint64(k))) & ((np.uint64(1) << width) - np.uint64(1))
        pos, at = pos + take, at + 1 + esc
        go = pos < end
        at, pos, end = at[go], pos[go], end[go]
    return out.view(np.int64)


def _encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, object] = {}


def _run(path: str, block: int):
    known: dict[str, int] = {}  # unit -> its number; its ids are flat[begin : begin + size]
    nothing = np.zeros(0, np.int64)
    held = [np.zeros(0, np.int32), nothing, nothing]  # flat, begin, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = _encoder(path)
        tok = _ENCODERS[path].encode_ordinary
        for b in batches:
            for lo, hi in _text.slices(b.column(1), 1 << 22):
                part = b.slice(lo, hi - lo)
                bounds, code, names, hard = units(part.column(1))
                names = names.to_pylist()
                if len(known) + len(names) > CACHE:
                    known.clear()
                    held[:] = np.zeros(0, np.int32), nothing, nothing
                which = np.fromiter((known.get(u, -1) for u in names), np.int64, len(names))
                new = np.flatnonzero(which < 0)
                if len(new):
                    got = [tok(unit_text(names[i])) for i in new]
                    size = np.fromiter(map(len, got), np.int64, len(got))
                    flat = np.fromiter(chain.from_iterable(got), np.int32, int(size.sum()))
                    which[new] = len(known) + np.arange(len(new))
                    known.update(zip((names[i] for i in new), which[new].tolist()))
                    held[:] = np.append(held[0], flat), np.append(held[1], len(held[0]) + np.cumsum(size) - size), np.append(held[2], size)
                flat, begin, size = held
                each = which[code]
                n = size[each]
                end = np.cumsum(n)
                ids = flat[np.arange(int(n.sum())) + np.repeat(begin[each] - (end - n), n)]
                row_n = np.append(0, end)[bounds]
                counts = np.diff(row_n)
                if hard.any():
                    texts = part.column(1).to_pylist()
                    rows = [np.array(tok(texts[r] or ""), np.int32) if hard[r] else ids[row_n[r] : row_n[r + 1]] for r in range(len(part))]
                    ids, counts = np.concatenate(rows), np.array([len(x) for x in rows])
                yield encode_rows(part.column(0), ids, counts, block)

    return run


def encode_rows(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, block: int = BLOCK) -> pa.RecordBatch:
    """Rows of consecutive ids, coded together."""
    start = np.cumsum(counts) - counts
    blocks = -(-counts // block)
    nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    words, first = encode(ids, np.repeat(start, blocks) + nth * block)
    of_row = np.append(0, np.cumsum(blocks))  # blocks before each row
    word_at = first[of_row]
    data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer((word_at * 8).astype(np.int64)), pa.py_buffer(words.astype("<u8").tobytes())]).cast(pa.binary())
    rel = (first[:-1] - np.repeat(word_at[:-1], blocks)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(counts.astype(np.int64)), data, pa.ListArray.from_arrays(pa.array(of_row.astype(np.int32)), pa.array(rel))],
        ["doc_id", "n_ids", "words", "block_offsets"],
    )


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, words, block_offsets): each document's token ids as little-endian Simple-8b words.

    block_offsets[i] is the word at which ids i * block .. start; decode() gives the ids back exactly. Null and empty texts have no ids and no words. Null and repeated ids
    give a row for each input row. No shuffle; other columns are not read. `vocabulary` must be readable on every executor.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(vocabulary, block), f"doc_id {dict(docs.dtypes)[id_col]}, n_ids long, words binary, block_offsets array<int>")
