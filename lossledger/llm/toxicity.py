"""Operator 3, toxicity by lexicon induction.

1. Word statistics over all documents; every word counts, however few documents it is in.
2. Seeds from the labels: words whose labelled documents are toxic, or not, in their majority with confidence.
3. A word graph: its nodes are all words; its edges are all pairs of words within WINDOW words of each other in any document whose association
   is significant, weighted by positive pointwise mutual information.
4. Two random walks with restart over that graph, from its toxic and from its clean seeds. A word's polarity is
   (t - c) / (t + c), smoothed, of its probabilities in them; words above MIN_POLARITY are the lexicon, with the polarity as weight,
   except those that labelled documents show to be clean in their majority; the toxic seeds are in it with at least that weight.
5. A document's score is the log likelihood ratio of its weighted lexicon hits under the toxic and the clean hit rate;
   rates and threshold are fitted on a bounded sample of labelled documents (FIT_ROWS).

Up to NUMBERED words are numbered in every task: pairs and edges are packed arrays, and a walk's vector goes to every task. The graph of more words is
tables keyed by 64-bit word hashes, pairs and edges in rows and walks by joins, with nothing of the vocabulary's size on the driver. Either way the graph
and the walks are the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._blob import count_sorted, narrow, pack, pack_sorted, unpack, unpack_sorted
from ._tables import BROADCAST_ROWS, bit_map, buckets, discard, materialise, small, trim

WINDOW = 3
Z = 2.58
MIN_G2 = 10.83
RESTART = 0.5
STEPS = 6
MIN_POLARITY = 0.5
#: Labelled rows, at most, on which rates and threshold are fitted.
FIT_ROWS = 20_000
#: Words, at most, that are numbered in every task: 12 bytes each there, and 8 in a walk's vector.
NUMBERED = 4_000_000
#: Pairs of nodes that a task counts at a time.
_FLUSH = 2_500_000
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


# 1. word statistics ----


def _first(code: np.ndarray, size: int) -> np.ndarray:
    """Where each of the codes 0 to size - 1 is first."""
    first = np.zeros(size, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return first


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: word, occurrences, documents, toxic and clean labelled documents; the empty word has the totals."""
    total = np.zeros(4, np.int64)
    parts: list[tuple[np.ndarray, list[np.ndarray], pa.Array]] = []

    def flush() -> pa.RecordBatch | None:
        if not parts:
            return None
        code, uniq = pd.factorize(np.concatenate([p[0] for p in parts]))
        size = len(uniq)
        del uniq
        sums = [np.bincount(code, np.concatenate([p[1][k] for p in parts]), size).astype(np.int64) for k in range(4)]
        first = _first(code, size)
        del code
        names = pa.concat_arrays([p[2] for p in parts]).take(pa.array(first))
        parts.clear()
        return pa.RecordBatch.from_arrays([names, *[pa.array(s) for s in sums]], ["word", "n", "df", "toxic", "clean"])

    held = 0
    for b in batches:
        for lo, hi in _text.slices(b.column(0), 1 << 20):
            part = b.slice(lo, hi - lo)
            w = _text.words(part.column(0))
            label = part.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            total += np.array([len(w.hash), len(part), (label == 1).sum(), (label == 0).sum()])
            if not len(w.hash):
                continue
            code, uniq = pd.factorize(w.hash)
            key, _ = count_sorted(w.doc.astype(np.int64) * len(uniq) + code)
            doc, word = key // len(uniq), key % len(uniq)
            counts = [np.bincount(code, minlength=len(uniq)), *[np.bincount(word[ok], minlength=len(uniq)) for ok in (slice(None), label[doc] == 1, label[doc] == 0)]]
            parts.append((uniq, [narrow(c) for c in counts], w.strings(_first(code, len(uniq)))))
            held += len(uniq)
            del w, code, key, doc, word, counts
            if held > 1_500_000:
                yield flush()
                held = 0
    out = flush()
    if out:
        yield out
    yield pa.RecordBatch.from_arrays([pa.array([""]), *[pa.array([int(x)]) for x in total]], ["word", "n", "df", "toxic", "clean"])
    del out
    trim()


def word_stats(docs: DataFrame) -> DataFrame:
    """docs (text, label): a row for each word."""
    rows = docs.select("text", "label").mapInArrow(_stats, "word string, n long, df long, toxic long, clean long")
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "df", "toxic", "clean")])


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label): 1 toxic, 0 clean, null unlabelled or null id; a doc_id labelled both ways is toxic."""
    lab = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("int").alias("label"))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.join(small(lab, labels.count()), src["doc_id"] == lab["l_id"], "left").select("doc_id", "text", "label")


# 2. seeds ----


def wilson(k: Column, n: Column, sign: int, z: float = Z) -> Column:
    """Lower (sign -1) or upper (sign 1) bound of a share k / n."""
    p = k / n
    return (p + z * z / (2 * n) + sign * z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_text.word_hash(b.column(0)).view(np.int64)), *b.columns], ["h", *b.schema.names])


def vocabulary(both: DataFrame) -> tuple[DataFrame, int]:
    """(h, word, n, seed_t, seed_c, denied) of every word, a written table, and the number of all words.

    seed_t and seed_c: labelled documents with the word are toxic, or clean, in their majority with confidence; denied: most of them are clean.
    """
    k, n = F.col("toxic"), F.greatest(F.col("toxic") + F.col("clean"), F.lit(1))
    words = materialise(word_stats(both).select("word", "n", "toxic", "clean").mapInArrow(_hashed, "h long, word string, n long, toxic long, clean long"), True)
    total = words.where("word = ''").agg(F.sum("n")).first()[0] or 0
    seen = F.col("toxic") + F.col("clean") > 0
    return words.where("word <> ''").select("h", "word", "n", (seen & (wilson(k, n, -1) > 0.5)).alias("seed_t"), (seen & (wilson(k, n, 1) < 0.5)).alias("seed_c"), (F.col("toxic") < F.col("clean")).alias("denied")), total


# 3. word graph ----


def _beside(marks, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(i, j, n): how often a marked word i is within the window of another word j."""
        bits = marks.value
        for b in batches:
            for lo, hi in _text.slices(b.column(0), 1 << 22):
                w = _text.words(b.column(0).slice(lo, hi - lo))
                code, word = pd.factorize(w.hash)
                mark = ((bits[(word & np.uint64(len(bits) - 1)).astype(np.int64)] >> ((word >> np.uint64(20)) & np.uint64(63))) & np.uint64(1)).astype(bool)
                at = np.flatnonzero(mark[code])
                keys = []
                for d in (*range(-window, 0), *range(1, window + 1)):
                    to = at + d
                    ok = (to >= 0) & (to < len(code))
                    x, to = at[ok], to[ok]
                    ok = (w.doc[x] == w.doc[to]) & (code[x] != code[to])
                    keys.append(code[x[ok]].astype(np.uint64) << np.uint64(32) | code[to[ok]].astype(np.uint64))
                key, n = count_sorted(np.concatenate(keys))
                if len(key):
                    i, j = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(word[i].view(np.int64)), pa.array(word[j].view(np.int64)), pa.array(n.astype(np.int64))], ["i", "j", "n"])

    return run


def _packed(index_of, window: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bin, keys, n): packed pairs i < j of nodes (by number) within the window, and their counts in this flush."""
        hashes = index_of.value
        index = pd.Index(hashes)
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key, n = count_sorted(np.concatenate(held))
            held.clear()
            where = (_text.mix(key) % np.uint64(bins)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(bins + 1))
            rows = [(k, pack_sorted(key[order[a:z]]), pack(narrow(n[order[a:z]]))) for k, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if a < z]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]], ["bin", "keys", "n"])

        for b in batches:
            for lo, hi in _text.slices(b.column(0), 1 << 21):
                w = _text.words(b.column(0).slice(lo, hi - lo))
                at = index.get_indexer(w.hash)
                for d in range(1, window + 1):
                    x, y = at[:-d], at[d:]
                    ok = (x >= 0) & (y >= 0) & (x != y) & (w.doc[:-d] == w.doc[d:])
                    x, y = x[ok].astype(np.uint64), y[ok].astype(np.uint64)
                    held.append(np.minimum(x, y) << np.uint64(32) | np.maximum(x, y))
                if sum(map(len, held)) > _FLUSH:
                    yield flush()
        if sum(map(len, held)):
            yield flush()

    return run


def _summed(index_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(i, j, n) of pairs from rows sorted by bin; every pair is in one bin."""
        hashes = index_of.value.view(np.int64)

        def out(held: list) -> pa.RecordBatch:
            key, n = count_sorted(np.concatenate([unpack_sorted(k) for k, _ in held]), np.concatenate([unpack(n) for _, n in held]).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(hashes[(key >> np.uint64(32)).astype(np.int64)]), pa.array(hashes[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]), pa.array(n)], ["i", "j", "n"])

        now, held = None, []
        for b in batches:
            for at, *row in zip(*(b.column(k).to_pylist() for k in range(3))):
                if at != now and held:
                    yield out(held)
                    held = []
                now = at
                held.append(row)
        if held:
            yield out(held)

    return run


def _weighed(pairs: DataFrame, first: DataFrame, second: DataFrame, total: int, window: int, min_g2: float) -> DataFrame:
    """(i, j, w) of significant pairs (i, j, c) of a word of first and one of second; (h, n) each. w: log of observed over expected count."""
    for words, end, n in ((first, "i", "ni"), (second, "j", "nj")):
        pairs = pairs.join(small(words.select(F.col("h").alias(end), F.col("n").alias(n))), end)
    c, e = F.col("c"), 2.0 * window * F.col("ni") * F.col("nj") / F.lit(float(total))
    w = F.log(c / e)
    return pairs.select("i", "j", w.alias("w"), (2 * (c * w - (c - e))).alias("g2")).where((F.col("w") > 0) & (F.col("g2") >= min_g2)).select("i", "j", "w")


def node_pairs(docs: DataFrame, nodes: DataFrame, window: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """(i, j, c) of all pairs of nodes within the window. Up to `most` nodes are numbered in every task and pairs sent packed; of more, pairs are rows."""
    spark = docs.sparkSession
    if nodes.count() <= most:
        sent = spark.sparkContext.broadcast(np.sort(nodes.select("h").toArrow()["h"].to_numpy().view(np.uint64)))
        n = buckets(spark)
        packed = docs.select("text").mapInArrow(_packed(sent, window, 4 * n), "bin int, keys binary, n binary").repartition(n, "bin").sortWithinPartitions("bin")
        return packed.mapInArrow(_summed(sent), "i long, j long, c long")
    rows = docs.select("text").mapInArrow(_beside(spark.sparkContext.broadcast(bit_map(nodes, "h")), window), "i long, j long, n long").where("i < j")
    return rows.groupBy("i", "j").agg(F.sum("n").alias("c"))


def both_ways(half: DataFrame) -> DataFrame:
    """Edges (i, j, w) and the same from j to i: a written table."""
    return materialise(half.select(F.explode(F.array(F.struct("i", "j", "w"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "w"))).alias("e")).select("e.*"))


def word_graph(docs: DataFrame, words: DataFrame, total: int, window: int = WINDOW, min_g2: float = MIN_G2, most: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The part of the graph around the toxic seeds, a view of it; the walks of induce() go over all of it (polarities()).

    Nodes (h, n, seed_t, seed_c): toxic seeds and the words significantly associated with one; edges (i, j, w) between them in both directions: written tables.
    """
    seeds = materialise(words.where("seed_t").select("h", "n"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(seeds, "h"))
    near = docs.select("text").mapInArrow(_beside(sent, window), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("c"))
    beside = _weighed(near, seeds, words.select("h", "n"), total, window, min_g2).select(F.col("j").alias("h"))
    at = materialise(beside.unionByName(seeds.select("h")).distinct())
    nodes = materialise(words.select("h", "n", "seed_t", "seed_c").join(small(at), "h", "left_semi"))
    half = _weighed(node_pairs(docs, nodes, window, most), nodes, nodes, total, window, min_g2)
    return nodes, both_ways(half)


# the graph of all words, numbered ----


def _merged(held: list) -> tuple[np.ndarray, np.ndarray]:
    return count_sorted(np.concatenate([unpack_sorted(k) for k, _ in held]), np.concatenate([unpack(n) for _, n in held]).astype(np.int64))


def _by_bin(done):
    """done(bin, keys, counts) of each bin's keys, from packed rows (bin, keys, n) sorted by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for at, *row in zip(*(b.column(k).to_pylist() for k in range(3))):
                if at != now and held:
                    yield _block_rows([done(now, *_merged(held))])
                    held = []
                now = at
                held.append(row)
        if held:
            yield _block_rows([done(now, *_merged(held))])
        trim()

    return run


def _block_rows(rows: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    rows = [(k, pack_sorted(key), pack(narrow(n))) for k, key, n in rows if len(key)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]], ["bin", "keys", "n"])


_BLOCKS = "bin int, keys binary, n binary"


@dataclass(frozen=True)
class Numbering:
    """Words by number, the most frequent first. Word x is in bin x % bins, at place x // bins; a key is (place << 32) | another word's number."""

    hash: np.ndarray  # ascending
    number: np.ndarray  # of each of these hashes
    bins: int
    per: int

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.number[np.searchsorted(self.hash, h)].astype(np.uint64)

    def long_keys(self, x: np.ndarray) -> np.ndarray:
        """The upper half of keys that sort by bin, then place."""
        return ((x % np.uint64(self.bins)) * np.uint64(self.per) + x // np.uint64(self.bins)) << _HALF

    def cut(self, key: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
        """Rows of sorted long keys and the sums of their n, or how often each occurs: a bin at a time, so that nothing of all keys' size is copied."""
        base = np.arange(self.bins, dtype=np.uint64) * np.uint64(self.per) << _HALF
        at = np.append(np.searchsorted(key, base), len(key))

        def block(k: int, a: int, z: int) -> tuple[int, np.ndarray, np.ndarray]:
            own = key[a:z] - base[k]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            return k, own[first], np.diff(np.append(first, len(own))) if n is None else np.add.reduceat(n[a:z], first, dtype=np.int64)

        return _block_rows(block(k, a, z) for k, (a, z) in enumerate(zip(at[:-1], at[1:])) if a < z)


def _all_pairs(sent, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bin, keys, n): pairs of words within the window, in the bin of the rarer word, and their counts in this flush."""
        book = sent.value
        held, size = np.empty(0, np.uint64), 0

        def flush() -> pa.RecordBatch:
            key = held[:size]
            key.sort()
            return book.cut(key)

        for b in batches:
            for lo, hi in _text.slices(b.column(0), 1 << 19):
                w = _text.words(b.column(0).slice(lo, hi - lo))
                code, uniq = pd.factorize(w.hash)
                doc, x = w.doc, book.of(uniq)
                del w
                high = book.long_keys(x)
                for d in range(1, window + 1):
                    ok = np.flatnonzero((doc[:-d] == doc[d:]) & (code[:-d] != code[d:]))
                    for at in np.split(ok, range(_FLUSH, len(ok), _FLUSH)):
                        if size + len(at) > _FLUSH and size:
                            yield flush()
                            size = 0
                        if len(held) < _FLUSH:
                            held = np.empty(_FLUSH, np.uint64)
                        i, j = code[at], code[at + d]
                        swap = x[i] < x[j]
                        i, j = np.where(swap, j, i), np.where(swap, i, j)
                        held[size : size + len(at)] = high[i] | x[j]
                        size += len(at)
        if size:
            yield flush()
        del held
        trim()

    return run


def _association(c: np.ndarray, ni: np.ndarray, nj: np.ndarray, total: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Log of observed over expected count, and G2, as in _weighed()."""
    e = 2.0 * window * ni * nj / float(total)
    w = np.log(c / e)
    return w, 2 * (c * w - (c - e))


def _significant(count, bins: int, total: int, window: int, min_g2: float):
    def done(k: int, key: np.ndarray, c: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        n = count.value
        w, g2 = _association(c, n[(key >> _HALF).astype(np.int64) * bins + k], n[(key & _LOW).astype(np.int64)], total, window)
        ok = (w > 0) & (g2 >= min_g2)
        return k, key[ok], c[ok]

    return _by_bin(done)


def _turned(bins: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges in the bins of their other ends."""
        book = Numbering(np.zeros(0, np.uint64), np.zeros(0, np.uint32), bins, per)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            key, n = (np.concatenate([h[k] for h in held]) for k in range(2))
            held.clear()
            order = np.argsort(key, kind="stable")
            return book.cut(key[order], n[order])

        for b in batches:
            for k, keys, n in zip(*(b.column(c).to_pylist() for c in range(3))):
                key = unpack_sorted(keys)
                held.append((book.long_keys(key & _LOW) | (key >> _HALF) * np.uint64(bins) + np.uint64(k), unpack(n)))
                size += len(key)
                if size > _FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()
        trim()

    return run


def _sums(count, vector, bins: int, total: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bin, sums): for each place of a row's bin the sum of weight times vector over its edges."""
        n, q = count.value, vector.value
        for b in batches:
            for k, keys, c in zip(*(b.column(x).to_pylist() for x in range(3))):
                key = unpack_sorted(keys)
                place, other = (key >> _HALF).astype(np.int64), (key & _LOW).astype(np.int64)
                w, _ = _association(unpack(c).astype(np.int64), n[place * bins + k], n[other], total, window)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.bincount(place, w if q is None else w * q[other]).tobytes()], pa.binary())], ["bin", "sums"])
        trim()

    return run


class Graph:
    """The edges between all words, numbered; in the bin of each of their ends."""

    def __init__(self, docs: DataFrame, words: DataFrame, total: int, window: int = WINDOW, min_g2: float = MIN_G2) -> None:
        spark = docs.sparkSession
        w = words.select("h", "n", "seed_t", "seed_c").toArrow()
        self.hash, self.count = w["h"].to_numpy().view(np.uint64), w["n"].to_numpy()
        order = np.lexsort((self.hash, -self.count))
        self.hash, self.count = self.hash[order], self.count[order]
        self.count = narrow(self.count)
        self.seeds = [w[c].to_numpy()[order] for c in ("seed_t", "seed_c")]
        del w
        parts = buckets(spark)
        self.total, self.window, self.bins = total, window, 4 * parts
        per = -(-len(order) // self.bins)
        order = np.argsort(self.hash)
        book = spark.sparkContext.broadcast(Numbering(self.hash[order], order.astype(np.uint32), self.bins, per))
        self.sent = spark.sparkContext.broadcast(self.count)
        del order
        trim()
        binned = lambda df, f: df.mapInArrow(f, _BLOCKS).repartition(parts, "bin").sortWithinPartitions("bin")
        one = materialise(binned(docs.select("text"), _all_pairs(book, window)).mapInArrow(_significant(self.sent, self.bins, total, window, min_g2), _BLOCKS), True)
        book.destroy()
        two = materialise(binned(one, _turned(self.bins, per)).mapInArrow(_by_bin(lambda k, key, c: (k, key, c)), _BLOCKS), True)
        self.tables = one, two
        self.edges = one.unionByName(two)

    def times(self, vector: np.ndarray | None) -> np.ndarray:
        """The matrix of weights times a vector (of ones, if None). One at a time: it is all that the driver holds of a step."""
        sent = self.edges.sparkSession.sparkContext.broadcast(vector)
        rows = self.edges.mapInArrow(_sums(self.sent, sent, self.bins, self.total, self.window), "bin int, sums binary").toArrow()
        out = np.zeros(len(self.hash))
        for k, part in sorted(zip(rows["bin"].to_pylist(), rows["sums"]), key=lambda r: r[0]):
            part = np.frombuffer(part.as_buffer())
            out[k : k + self.bins * len(part) : self.bins] += part
        sent.destroy()
        del rows
        trim()
        self.edges.sparkSession._jvm.System.gc()  # what came through the JVM, before its heap grows for the next
        return out

    def polarity(self, restart: float = RESTART, steps: int = STEPS) -> np.ndarray:
        """Of each word by number, as polarity() has it."""
        degree = np.maximum(self.times(None), 1e-300)
        each = [1 / max(1, s.sum()) for s in self.seeds]
        p = [s * x for s, x in zip(self.seeds, each)]
        for _ in range(steps):
            for k, (s, x) in enumerate(zip(self.seeds, each)):
                p[k] /= degree
                p[k] = self.times(p[k])
                p[k] *= 1 - restart
                p[k][s] += restart * x
        return np.round((p[0] - p[1]) / (p[0] + p[1] + 1 / max(1, len(self.hash))), 6)

    def discard(self) -> None:
        self.sent.destroy()
        for t in self.tables:
            discard(t)


def polarities(docs: DataFrame, words: DataFrame, total: int, window: int = WINDOW, min_g2: float = MIN_G2, least: float = MIN_POLARITY, most: int = NUMBERED) -> DataFrame:
    """(h, value) of all toxic seeds and of all words with a polarity of `least` or more, from the walks over the graph of all words."""
    if words.count() <= most:
        graph = Graph(docs, words, total, window, min_g2)
        value = graph.polarity()
        graph.discard()
        at = np.flatnonzero((value >= least) | graph.seeds[0])
        return docs.sparkSession.createDataFrame(pa.table({"h": graph.hash[at].view(np.int64), "value": value[at]}))
    nodes = words.select("h", "n", "seed_t", "seed_c")
    edges = both_ways(_weighed(node_pairs(docs, nodes, window, 0), nodes, nodes, total, window, min_g2))
    return polarity(nodes, edges).join(nodes.select("h", "seed_t"), "h").where(F.col("seed_t") | (F.col("value") >= least)).select("h", "value")


# 4. random walks ----


def polarity(nodes: DataFrame, edges: DataFrame, restart: float = RESTART, steps: int = STEPS) -> DataFrame:
    """(h, value): (t - c) / (t + c + 1 / nodes) of the two walks' probabilities, to 6 places.

    The last term is an even walk's probability: a node that the walks hardly reach has a polarity near 0.
    """
    size, toxic, clean = nodes.agg(F.count("*"), F.sum(F.col("seed_t").cast("long")), F.sum(F.col("seed_c").cast("long"))).first()
    start = nodes.select("h", (F.col("seed_t").cast("double") / max(1, toxic or 0)).alias("t0"), (F.col("seed_c").cast("double") / max(1, clean or 0)).alias("c0"))
    degree = edges.groupBy("j").agg(F.sum("w").alias("d"))
    moves = materialise(edges.join(small(degree, size), "j").select("i", "j", (F.col("w") / F.col("d")).alias("a")))
    p = start.select("h", F.col("t0").alias("t"), F.col("c0").alias("c"))
    for _ in range(steps):
        came = moves.join(small(p, size), F.col("j") == F.col("h")).groupBy("i").agg(F.sum(F.col("a") * F.col("t")).alias("ti"), F.sum(F.col("a") * F.col("c")).alias("ci"))
        p = start.join(small(came, size), F.col("h") == F.col("i"), "left").select("h", *[(restart * F.col(f"{x}0") + (1 - restart) * F.coalesce(F.col(f"{x}i"), F.lit(0.0))).alias(x) for x in "tc"])
    return p.select("h", F.round((F.col("t") - F.col("c")) / (F.col("t") + F.col("c") + 1 / max(1, size)), 6).alias("value"))


# 5. documents ----


@dataclass(frozen=True)
class Lexicon:
    word: list[str]
    hash: np.ndarray
    weight: np.ndarray
    toxic_rate: float = 1.0  # weighted hits a word
    clean_rate: float = 0.0
    threshold: float = math.inf


def _hits(lex: Lexicon, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = _text.words(texts)
    at = pd.Index(lex.hash).get_indexer(w.hash)
    return np.diff(w.first), np.round(np.bincount(w.doc[at >= 0], lex.weight[at[at >= 0]], len(texts)).astype(float), 6)  # bincount of nothing gives integers


def llr(lex: Lexicon, n: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of Poisson hits at the toxic and at the clean rate."""
    return np.round(hits * math.log(lex.toxic_rate / lex.clean_rate) - n * (lex.toxic_rate - lex.clean_rate), 6) if lex.clean_rate > 0 else np.zeros(len(n))


def _score(lexicon, text_col: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for b in batches:
            k = b.schema.get_field_index(text_col)
            for lo, hi in _text.slices(b.column(k), 1 << 19):
                part = b.slice(lo, hi - lo)
                n, hits = _hits(lex, part.column(k))
                score = llr(lex, n, hits)
                toxic = score >= lex.threshold
                if keep_text:
                    yield part.filter(pa.array(~toxic))
                else:
                    yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(part.columns) if i != k], pa.array(n.astype(np.int64)), pa.array(hits), pa.array(score), pa.array(toxic)], [*[x for x in b.schema.names if x != text_col], "n_words", "hits", "score", "toxic"])
        b = part = None
        trim()

    return run


def fit(lex: Lexicon, n: np.ndarray, hits: np.ndarray, label: np.ndarray) -> Lexicon:
    """Rates by class and the threshold of the best F1 (of equal ones the middle of the widest gap's least)."""
    t, c = label == 1, label == 0
    rate = lambda m: hits[m].sum() / max(1, n[m].sum())
    floor = 0.5 / max(1, n.sum())
    hot, cold = max(rate(t), floor), max(rate(c), floor)
    if not t.any() or not hits[t].sum() or hot <= cold:
        return Lexicon(lex.word, lex.hash, lex.weight)
    lex = Lexicon(lex.word, lex.hash, lex.weight, hot, cold)
    s = llr(lex, n, hits)
    order = np.argsort(-s, kind="stable")
    tp, seen = np.cumsum(t[order]), np.arange(1, len(s) + 1)
    f1 = 2 * tp / (seen + t.sum())
    last = np.append(s[order][1:] != s[order][:-1], True)  # equal scores go together
    f1[~last] = -1
    best = int(np.argmax(f1))
    below = s[order][best + 1] if best + 1 < len(s) else s[order][best] - 1
    return Lexicon(lex.word, lex.hash, lex.weight, hot, cold, float((s[order][best] + max(below, 0.0)) / 2 if below > 0 or s[order][best] > 0 else s[order][best]))


def induce(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_g2: float = MIN_G2, min_polarity: float = MIN_POLARITY, fit_rows: int = FIT_ROWS, most: int = NUMBERED) -> Lexicon:
    """The fitted lexicon. Without documents, labels or toxic words it is empty and rejects nothing."""
    spark = docs.sparkSession
    nothing = Lexicon([], np.zeros(0, np.uint64), np.zeros(0))
    both = with_labels(docs, labels, id_col, text_col)
    words, total = vocabulary(both)
    if words.where("seed_t").isEmpty():
        return nothing
    found = polarities(both, words, total, window, min_g2, min_polarity, most)
    rows = words.where("not denied").select("h", "word").join(small(found), "h")
    rows = rows.select("h", "word", F.greatest("value", F.lit(min_polarity)).alias("value")).toPandas().sort_values("h")  # the lexicon alone
    lex = Lexicon(rows["word"].tolist(), rows["h"].to_numpy(np.int64).view(np.uint64), rows["value"].to_numpy(float))
    sent = spark.sparkContext.broadcast(lex)
    share = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_003))
    lab = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sample = lab.orderBy(share, "doc_id").limit(fit_rows).select(F.col("doc_id").alias("l_id"), "label")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("label", "text")  # at most fit_rows
    got = rows.mapInArrow(_score(sent, "text", False), "label int, n_words long, hits double, score double, toxic boolean").groupBy("label", "n_words", "hits").count().toPandas()
    got = got.loc[got.index.repeat(got["count"])].sort_values(["label", "n_words", "hits"])
    return fit(lex, got["n_words"].to_numpy(), got["hits"].to_numpy(), got["label"].to_numpy())


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(doc_id, n_words, hits, score, toxic) of every row.

    Null, empty and wordless texts score 0 and are not toxic; a score equal to the threshold is toxic. Null ids can't be labelled but are
    scored; repeated rows are scored alike; long texts are scored whole. labels needs doc_id and toxic (0, 1; other values and nulls are no label; a
    document labelled both ways is toxic). Other columns of either table are not read. Empty tables: nothing is toxic.
    """
    lex = docs.sparkSession.sparkContext.broadcast(induce(docs, labels, id_col, text_col, **params))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(lex, "text", False), f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, hits double, score double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents that are not toxic, with all their columns, whatever their names.

    Kept are all rows whose text is null, empty or without words, and everything where labels has no toxic document. Repeated rows are
    kept or dropped together. An empty table gives an empty result.
    """
    lex = docs.sparkSession.sparkContext.broadcast(induce(docs, labels, id_col, text_col, **params))
    return docs.mapInArrow(_score(lex, text_col, True), docs.schema)
