"""Operator 9, token counts by rank-synchronous merging of byte-pair sequences.

Pre-tokens are held as one ragged array of symbols. In each round every sequence finds its pair of lowest rank and merges all its
occurrences, all sequences at once; when no sequence has a pair left, the surviving symbols are the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A space after white space (in any script): there a text can't be cut into units at spaces.
_HARD = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
#: Unit counts a worker remembers; beyond it starts afresh.
CACHE = 1_000_000


class Ranks:
    """A byte-pair vocabulary as arrays: the rank of every mergeable pair of symbols."""

    _known: dict[str, Ranks] = {}

    def __init__(self, path: str) -> None:
        token = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
        self.size = max(token.values()) + 1
        self.byte = np.array([token.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError(f"{path} lacks single bytes")
        left, right, rank = [], [], []
        for t, r in token.items():
            for cut in range(1, len(t)):
                a, b = token.get(t[:cut]), token.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.index = pd.Index(np.array(left, np.int64) * self.size + np.array(right, np.int64))
        self.rank = np.append(np.array(rank, np.int64), self.size)  # last: no such pair

    @classmethod
    def load(cls, path: str) -> Ranks:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.rank[self.index.get_indexer(a * self.size + b)]


def merge_all(ranks: Ranks, pieces: list[bytes]) -> np.ndarray:
    """Tokens of each piece."""
    n = np.array([len(p) for p in pieces], np.int64)
    sym = ranks.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    seq = np.repeat(np.arange(len(n)), n)
    out = n.copy()
    rank = np.full(len(sym), ranks.size, np.int64)  # of the pair that starts here
    if len(sym) > 1:
        rank[:-1] = np.where(seq[1:] == seq[:-1], ranks.pair_ranks(sym[:-1], sym[1:]), ranks.size)
    while len(sym):
        first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        size = np.diff(np.append(first, len(sym)))
        low = np.minimum.reduceat(rank, first)
        live = low < ranks.size
        if not live.all():  # finished sequences leave
            out[seq[first[~live]]] = size[~live]
            stay = np.repeat(live, size)
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            if not len(sym):
                break
            size, low = size[live], low[live]
        lowest = np.repeat(low, size)
        hit = rank == lowest
        # in a run of overlapping hits (aaa) every second one merges, from the left
        over = hit[1:] & hit[:-1]
        if over.any():
            run = np.flatnonzero(hit)
            new = np.concatenate(([True], (np.diff(run) > 1) | (seq[run[1:]] != seq[run[:-1]])))
            start = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
            hit[run[(np.arange(len(run)) - start) % 2 == 1]] = False
        at = np.flatnonzero(hit)
        sym[at] = rank[at]  # a token's id is its rank
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        changed = np.zeros(len(sym), bool)
        changed[at] = True
        sym, seq, changed, rank = sym[keep], seq[keep], changed[keep], rank[keep]
        todo = changed.copy()
        todo[:-1] |= changed[1:]  # pairs with a merged symbol on either side
        i = np.flatnonzero(todo)
        nxt = np.minimum(i + 1, len(sym) - 1)
        ok = (nxt > i) & (seq[nxt] == seq[i])
        rank[i] = np.where(ok, ranks.pair_ranks(sym[i], sym[nxt]), ranks.size)
    return out


def count_texts(ranks: Ranks, texts: list[str]) -> np.ndarray:
    """Tokens of each text, every pre-token counted once however often it occurs."""
    found = [regex.findall(PATTERN, t) for t in texts]
    known: dict[str, int] = {}
    code = np.array([known.setdefault(p, len(known)) for f in found for p in f], np.int64)
    each = merge_all(ranks, [p.encode() for p in known])
    n = np.array([len(f) for f in found], np.int64)
    return np.bincount(np.repeat(np.arange(len(texts)), n), each[code], len(texts)).astype(np.int64)


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Texts cut at spaces: (bounds of each row's units, unit of each place, distinct units, hard rows).

    A space with no white space before it starts a pre-token, so that units can be tokenised alone: with their space, but for the first
    of a row, whose distinct unit is marked by a leading U+0000 here. Hard rows have a space after white space or a U+0000; their units don't count.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    hard = pc.or_(pc.match_substring_regex(texts, _HARD), pc.match_substring(texts, "\0"))
    hard = pc.or_(hard, pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.if_else(pa.array(hard), "", pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), texts, pa.scalar("", pa.large_string()))), " ")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    d = lists.flatten().dictionary_encode()
    return lists.offsets.to_numpy().astype(np.int64) - int(lists.offsets[0].as_py() if len(lists) else 0), d.indices.to_numpy().astype(np.int64), d.dictionary, hard


def unit_text(u: str) -> str:
    return u[1:] if u[:1] == "\0" else " " + u


def _run(path: str):
    known: dict[str, int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks.load(path)
        for b in batches:
            for lo, hi in _text.slices(b.column(1), 1 << 23):
                part = b.slice(lo, hi - lo)
                bounds, code, names, hard = units(part.column(1))
                names = names.to_pylist()
                new = [u for u in names if u not in known]
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = names
                known.update(zip(new, count_texts(ranks, [unit_text(u) for u in new]).tolist()))
                each = np.fromiter((known[u] for u in names), np.int64, len(names))
                sums = np.zeros(len(code) + 1, np.int64)
                np.cumsum(each[code], out=sums[1:])
                n = sums[bounds[1:]] - sums[bounds[:-1]]
                if hard.any():
                    n[hard] = count_texts(ranks, part.column(1).filter(pa.array(hard)).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row: tokens of the byte-pair vocabulary in the whole text.

    Null and empty texts have 0 tokens. Null and repeated ids give a row for each input row. No shuffle; other columns are not
    read. `vocabulary` must be readable on every executor.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(vocabulary), f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long")
