"""Operator 7, near-duplicate groups by an LSH forest over MinHash signatures.

Every document gets PERMS minimum hashes of its word shingles, of which it keeps four bits each, its sketch; the share of equal
hashes is estimated from the share of equal parts of two sketches, less those that agree by chance. Tree t of the forest sorts all sketches
beginning with the t-th run of hashes, the first LEAST of them whole (a region), the others by their four bits.

A document's candidates in a tree are all documents that share its longest prefix with at least ENOUGH documents: sparse regions
stay at LEAST hashes, dense ones are followed as deep as they are dense. As a prefix branches into 16, documents whose prefix ends early are
few at each branching, so that this is a bounded share of a region's pairs whatever its size. No candidate is left out; pairs
that matches have joined already aren't compared again. Regions of more than SPLIT documents are first divided by
the next two hashes, as often as it takes, so that no task gets an unbounded group. Matches join documents into groups (connected components).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._tables import buckets, discard, fresh, materialise, small, trim

SHINGLE = 2
PERMS = 128
TREES = 16
STEP = PERMS // TREES
LEAST = 2
ENOUGH = 64
#: Documents of a region in one task.
SPLIT = 100_000
THRESHOLD = 0.55
#: Bytes of a sketch; the whole hashes of the regions follow it.
SKETCH = PERMS // 2
#: Rows and pairs that a task works on at a time.
_ROWS, _PAIRS = 50_000, 200_000

_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(1 << 20, 1 << 31, PERMS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)


def signatures(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(rows with words, their signatures as uint16); texts of fewer words than a shingle count as one shingle."""
    w = _text.words(texts)
    n = np.diff(w.first)
    rows = np.flatnonzero(n)
    if not len(rows):
        return rows, np.zeros((0, PERMS), np.uint16)
    h = w.hash.copy()
    last = w.first[1:][w.doc] - 1  # last word of the row
    at = np.arange(len(h))
    for k in range(1, shingle):
        nxt = at + k
        inside = nxt <= last
        h = np.where(inside, _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[np.minimum(nxt, len(h) - 1)]), h)
    size = np.minimum(n, shingle)
    ok = at <= last - size[w.doc] + 1  # whole shingles only
    h, doc = h[ok], w.doc[ok]
    x = (h >> np.uint64(32)).astype(np.uint32)
    starts = np.searchsorted(doc, rows)
    sig = np.empty((len(rows), PERMS), np.uint16)
    for k in range(PERMS):
        y = x * _A[k]  # modulo 2**32
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y += _B[k]
        y ^= y >> np.uint32(12)
        m = np.minimum.reduceat(y, starts)
        m = m * np.uint32(0x297A2D39)
        sig[:, k] = (m ^ (m >> np.uint32(15))) & np.uint32(0xFFFF)
    return rows, sig


def pack_sketch(sig: np.ndarray) -> np.ndarray:
    """Rows of the sketch's bytes, then the first LEAST whole hashes of each tree."""
    low = (sig & np.uint16(15)).astype(np.uint8)
    first = np.stack([sig[:, t * STEP + k] for t in range(TREES) for k in range(LEAST)], axis=1)
    return np.hstack([low[:, 0::2] << 4 | low[:, 1::2], np.ascontiguousarray(first).view(np.uint8)])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in _text.slices(b.column(1)):
            part = b.slice(lo, hi - lo)
            rows, sig = signatures(part.column(1))
            if len(rows):
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), _binary(pack_sketch(sig))], ["doc_id", "sig"])
    b = part = rows = sig = None
    trim()


def _binary(rows: np.ndarray) -> pa.Array:
    off = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, off.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _forest(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document and tree: its region, and (if whole) the document and its sketch from the tree's first hash on."""
        for b in batches:
            sig = _bytes(b.column(1), SKETCH + 2 * LEAST * TREES)
            first = np.ascontiguousarray(sig[:, SKETCH:]).view(np.uint16)
            for t in range(TREES):
                key = np.full(len(sig), t, np.uint64)
                for k in range(LEAST):
                    key = key << np.uint64(16) | first[:, t * LEAST + k]
                region = pa.array(key.astype(np.int64))
                if whole:
                    yield pa.RecordBatch.from_arrays([region, b.column(0), _binary(np.roll(sig[:, :SKETCH], -t * STEP // 2, axis=1))], ["region", "doc_id", "body"])
                else:
                    yield pa.RecordBatch.from_arrays([region], ["region"])

    return run


def needed(threshold: float) -> int:
    """Equal parts of two sketches at which the estimated similarity is the threshold; a sixteenth of unequal hashes agree."""
    return int(np.ceil(PERMS * (threshold * 15 / 16 + 1 / 16) - 1e-9))


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each component, with the edges a, b besides."""
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return parent
        m = np.minimum(x, y)
        np.minimum.at(parent, x, m)
        np.minimum.at(parent, y, m)
        while (parent[parent] != parent).any():
            parent = parent[parent]


def runs(region: np.ndarray, body: np.ndarray, enough: int = ENOUGH) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted rows the bounds of the longest prefix that it shares with at least `enough` rows, itself counted, or of its region."""
    n = len(region)
    cut = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True])))
    start, end = np.repeat(cut[:-1], np.diff(cut)), np.repeat(cut[1:], np.diff(cut))
    rows = np.flatnonzero(end - start > enough)
    for d in range(LEAST, PERMS):
        if not len(rows):
            break
        v = body[rows, d // 2] >> 4 if d % 2 == 0 else body[rows, d // 2] & 15
        own = start[rows]
        cut = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (own[1:] != own[:-1]), [True])))
        size = np.repeat(np.diff(cut), np.diff(cut))
        first = rows[np.repeat(cut[:-1], np.diff(cut))]
        deep = size >= enough
        start[rows[deep]], end[rows[deep]] = first[deep], (first + size)[deep]
        rows = rows[size > enough]
    assert len(start) == n
    return start, end


def region_edges(region: np.ndarray, body: np.ndarray, threshold: float = THRESHOLD, enough: int = ENOUGH) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions (a, b) of edges that connect all matches among the candidates of rows sorted by region and body, and the number of pairs compared."""
    n, compared = len(region), 0
    parent = np.arange(n)
    twin = np.concatenate(([False], (region[1:] == region[:-1]) & (body[1:] == body[:-1]).all(axis=1)))
    parent = np.maximum.accumulate(np.where(twin, 0, parent))  # equal sketches: the first stands for all
    lead = np.flatnonzero(~twin)
    start, end = runs(region[lead], body[lead], enough)
    words, need = np.ascontiguousarray(body[lead]).view(np.uint64), needed(threshold)
    size = end - start
    todo = np.flatnonzero(size > 1)
    upto = np.cumsum(size[todo])
    lo = 0
    while lo < len(todo):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIRS, "right")))
        i = np.repeat(todo[lo:hi], size[todo[lo:hi]])
        j = np.arange(len(i)) - np.repeat(np.cumsum(size[todo[lo:hi]]) - size[todo[lo:hi]], size[todo[lo:hi]]) + start[i]
        new = ((j > i) | (size[j] < size[i])) & (parent[lead[i]] != parent[lead[j]])
        i, j = i[new], j[new]
        x = words[i] ^ words[j]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        x &= np.uint64(0x1111111111111111)
        hit = PERMS - np.bitwise_count(x).sum(axis=1, dtype=np.int64) >= need
        compared += len(i)
        if hit.any():
            parent = _union(parent, lead[i[hit]], lead[j[hit]])
        lo = hi
    at = np.flatnonzero(parent != np.arange(n))
    return at, parent[at], compared


def _match(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by region and body."""

        def judge(parts: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> pa.RecordBatch | None:
            key, body = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
            ids = pa.concat_arrays([p[1] for p in parts])
            a, b, _ = region_edges(key, body, threshold)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"]) if len(a) else None

        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        for b in batches:
            if not len(b):
                continue
            key, ids, body = b.column(0).to_numpy(), b.column(1), _bytes(b.column(2), SKETCH)
            end = int(np.searchsorted(key, key[-1]))  # the last region may go on in the next batch
            if end and sum(len(p[0]) for p in held) + end >= _ROWS or held and not end and held[-1][0][-1] != key[0]:
                out = judge(held + [(key[:end], ids.slice(0, end), body[:end])])
                if out:
                    yield out
                held = []
                key, ids, body = key[end:], ids.slice(end), body[end:]
            held.append((key, ids, body))
        if held:
            out = judge(held)
            if out:
                yield out
        b = key = ids = body = held = out = None
        trim()

    return run


def _divided(rows: DataFrame, counted: DataFrame, split: int) -> DataFrame:
    """Rows of regions of more than `split` documents get the region and the next two hashes as a region, until none is larger."""
    done = None
    for byte in range(LEAST // 2 + 1, SKETCH + 1):
        hot = materialise(counted.groupBy("region").count().where(F.col("count") > split).select(F.col("region").alias("hot")))
        n = hot.count()
        if not n:
            break
        few = small(hot, n)
        cool = rows.join(few, F.col("region") == F.col("hot"), "left_anti")
        done = cool if done is None else done.unionByName(cool)
        rows = materialise(rows.join(few, F.col("region") == F.col("hot"), "left_semi").withColumn("region", F.xxhash64("region", F.substring("body", byte, 1))))
        counted = rows.select("region")
    return rows if done is None else done.unionByName(rows)


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b) but the roots: the least vertex of its component.

    Alternates large-star and small-star steps until nothing changes; each round is a written table, so that neither the
    plan nor the recomputation after a lost executor grows with the rounds.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = materialise(star)
        discard(edges)
        # done when every vertex has one edge, to a root that has none itself
        if new.groupBy("u").count().where("count > 1").isEmpty() and new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return new.select(F.col("u").alias("w"), "v").select(F.col("w").alias("v"), F.col("v").alias("root"))
        edges = new


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, split: int = SPLIT) -> DataFrame:
    """(doc_id, group_id) of every document in a group of two or more; group_id is the group's least doc_id.

    ids are of any type that can be ordered. Rows with a null id or without words (null, empty, signs only) are never compared. Rows that
    repeat an id are one document: what either matches is in its group. Ties go to the lesser id. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    sigs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_sign, f"doc_id {kind}, sig binary")
    sigs = materialise(sigs)
    # equal sketches: one representative goes on
    exact = materialise(sigs.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    often = exact.where("n > 1").select("sig", F.col("doc_id").alias("b"))
    twins = materialise(sigs.join(small(often), "sig").select(F.col("doc_id").alias("a"), "b").where("a <> b"))
    repeated = sigs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("r"))
    n = buckets(spark)
    rows = exact.select("doc_id", "sig").mapInArrow(_forest(True), f"region long, doc_id {kind}, body binary")
    rows = _divided(rows, exact.select("doc_id", "sig").mapInArrow(_forest(False), "region long"), split)
    near = rows.repartition(n, "region").sortWithinPartitions("region", "body").mapInArrow(_match(threshold), f"a {kind}, b {kind}")
    c = components(near.unionByName(twins.join(small(repeated), F.col("a") == F.col("r"), "left_semi")))
    discard(sigs)
    discard(exact)
    of_twins = twins.join(c, F.col("b") == F.col("v"), "left").select(F.col("a").alias("doc_id"), F.coalesce("root", "b").alias("group_id"))
    members = c.select(F.col("v").alias("doc_id"), F.col("root").alias("group_id")).unionByName(of_twins).where("doc_id <> group_id").distinct()
    members = materialise(members)
    return members.unionByName(members.select(F.col("group_id").alias("doc_id"), "group_id").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, kept) for every row; documents without near duplicates are groups of their own.

    Null ids: a null group, kept. Null, empty and wordless texts are groups of their own, kept. Rows that repeat an id have one
    group and are kept or not together. Long texts are signed whole. An empty table gives an empty result. Other columns are not read.
    """
    g = near_groups(docs, id_col, text_col, threshold)
    out = docs.select(F.col(id_col).alias("doc_id")).join(g, "doc_id", "left")
    return out.select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), (F.col("doc_id").isNull() | (F.coalesce("group_id", "doc_id") == F.col("doc_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that another of their group stands for (the one of the least id); all columns pass through, whatever their names.

    Kept are all rows with null ids or without words, and every row of an id that is kept. An empty table gives an empty result.
    """
    name = fresh("gone", docs)
    gone = near_groups(docs, id_col, text_col, threshold).where("doc_id <> group_id").select(F.col("doc_id").alias(name))
    return docs.join(small(gone), docs[id_col] == F.col(name), "left_anti")
