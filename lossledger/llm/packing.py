"""Operator 1, best-fit packing of documents into sequences of fixed capacity.

The plan is made from the histogram of piece lengths (at most `capacity` distinct ones), not from documents: lengths are
taken from long to short, and the pieces of one length go, many at a time, to the fullest bins that still have room. Equal bins
are one run, so that the plan has a few rows for each length whatever the corpus holds. Each piece then takes its planned
slot by its rank within its length.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._tables import materialise, small

CAPACITY = 2048
#: Documents whose ranks one task counts.
PART = 1_000_000


def n_tokens(text: str | Column = "text") -> Column:
    """Units between white space, 0 for null; a tokenizer's counts can be given instead as a column."""
    t = F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s+", " "))
    return F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("int")


def plan_bins(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over (length, count): rows (length, first rank, end rank, first bin, pieces in a bin, offset of the first).

    Rank r of such a row is the piece (r - first rank) % pieces of the bin first bin + (r - first rank) // pieces. Of equally full
    bins the one opened first is taken. Lengths must be in 1..capacity, each given once; counts of 0 give no row.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: list[int] = []  # distinct free sizes, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # free size -> heap of (first bin, bins)
    bins = 0

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in runs:
                runs[free] = []
                insort(room, free)
            heapq.heappush(runs[free], (first, n))

    for length, count in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        rank = 0
        while rank < count:
            at = bisect_left(room, length)
            if at < len(room):
                free = room[at]
                first, n = heapq.heappop(runs[free])
                if not runs[free]:
                    del runs[free], room[at]
            else:  # open as many bins as these pieces need
                free, first, n = capacity, bins, -(-(count - rank) // (capacity // length))
                bins += n
            per = free // length  # a bin that took one piece is the fullest with room for the next
            full = min(n, (count - rank) // per)
            some = (count - rank - full * per) if full < n else 0  # the last bin takes what is left
            for k, pieces in ((full, per), (1 if some else 0, some)):
                if k:
                    rows.append((length, rank, rank + k * pieces, first, pieces, capacity - free))
                    rank += k * pieces
                    put(free - pieces * length, first, k)
                    first, n = first + k, n - k
            put(free, first, n)
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, part: int = PART) -> DataFrame:
    """(doc_id, piece, start, length, bin, bin_offset): where each piece of each document goes.

    length: tokens of each document (default: units between white space). A document longer than the capacity is cut
    into pieces of the full capacity and a rest; pieces keep their token range [start, start + length) of the document.
    Documents without tokens (empty or null text, null or negative length) take no room: one row with length 0 and
    null bin and offset. Pieces of equal length are ranked by id (tables of more than `part` rows: in parts by a hash of the id,
    and of the row where the id is null); null ids come first and stay null; rows that repeat an id are packed each on their own. Other columns
    of the input are neither read nor returned, so their names can't clash. An empty table gives an empty result.

    The text is read once, for a table of ids and lengths. Documents that fill several bins are ranked as one row and cut
    into pieces afterwards.
    """
    spark = docs.sparkSession
    n = F.greatest(F.coalesce((length if length is not None else n_tokens(text_col)).cast("long"), F.lit(0)), F.lit(0))
    sized = materialise(docs.select(F.col(id_col).alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("row")))
    parts = max(1, -(-sized.count() // part))
    where = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.xxhash64("row")), F.lit(parts)) if parts > 1 else F.lit(0)
    where = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("row"), F.lit(parts))).otherwise(where).cast("int")
    # one row for a document's full pieces and one for its rest
    full, rest = F.expr(f"n div {capacity}"), F.expr(f"cast(n % {capacity} as int)")
    both = F.array(F.struct(F.lit(capacity).alias("length"), full.alias("k"), F.lit(0).cast("long").alias("piece")), F.struct(rest.alias("length"), F.least(rest, F.lit(1)).cast("long").alias("k"), full.alias("piece")))
    items = sized.select("doc_id", "row", where.alias("part"), F.explode(both).alias("x")).select("doc_id", "row", "part", "x.*").where("k > 0")
    held = materialise(items.groupBy("length", "part").agg(F.sum("k").alias("k")))
    plan = plan_bins([tuple(r) for r in held.groupBy("length").agg(F.sum("k")).collect()], capacity)  # at most `capacity` rows
    before = F.sum("k").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = held.select(F.col("length").alias("b_length"), F.col("part").alias("b_part"), F.coalesce(before, F.lit(0)).alias("base"))
    ahead = F.sum("k").over(Window.partitionBy("length", "part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1))
    ranked = items.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    ranked = ranked.join(small(base, min(capacity, len({r[0] for r in plan})) * parts), (F.col("length") == F.col("b_length")) & (F.col("part") == F.col("b_part")))
    ranked = ranked.select("doc_id", "length", F.explode(F.expr("transform(sequence(0L, k - 1), i -> struct(piece + i as piece, base + ahead + i as rank))")).alias("x")).select("doc_id", "length", "x.*")
    slots = spark.createDataFrame(plan, "p_length int, lo long, hi long, first long, per int, at int")
    placed = ranked.join(small(slots, len(plan)), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.withColumn("r", F.col("rank") - F.col("lo")).select(
        "doc_id", F.col("piece").cast("int"), (F.col("piece") * capacity).alias("start"), "length",
        F.expr("first + r div per").alias("bin"), F.expr("cast(at + r % per * length as int)").alias("bin_offset"),
    )
    empty = sized.where("n = 0").selectExpr("doc_id", "0 as piece", "0L as start", "0 as length", "cast(null as long) as bin", "cast(null as int) as bin_offset")
    return placed.unionByName(empty)


# The same one piece at a time: a recursive query whose state is the room left in each bin, in the order of their opening.
SQL = f"""
WITH RECURSIVE
d AS (SELECT doc_id, CASE WHEN text IS NULL OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS n FROM documents),
p AS (SELECT doc_id, unnest(range(greatest(1, (n + {CAPACITY - 1}) // {CAPACITY}))) AS piece, n FROM d),
q AS (SELECT doc_id, piece, least(n - piece * {CAPACITY}, {CAPACITY}) AS length FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY length DESC, doc_id, piece) AS k FROM q WHERE length > 0),
fit AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS room, 0::BIGINT AS bin, 0::BIGINT AS bin_offset
  UNION ALL
  SELECT k, CASE WHEN best IS NULL THEN list_append(room, {CAPACITY} - length) ELSE list_concat(room[:pos - 1], [best - length], room[pos + 1:]) END,
    CASE WHEN best IS NULL THEN len(room) ELSE pos - 1 END, CASE WHEN best IS NULL THEN 0 ELSE {CAPACITY} - best END
  FROM (SELECT k, room, length, best, list_position(room, best) AS pos FROM (
    SELECT o.k, fit.room, o.length, list_min(list_filter(fit.room, lambda x: x >= o.length)) AS best FROM fit JOIN o ON o.k = fit.k + 1)))
SELECT q.doc_id, q.piece::INTEGER AS piece, q.piece * {CAPACITY} AS start, q.length::INTEGER AS length, f.bin, f.bin_offset::INTEGER AS bin_offset
FROM q LEFT JOIN o USING (doc_id, piece) LEFT JOIN (SELECT k, bin, bin_offset FROM fit WHERE k > 0) f ON f.k = o.k
"""
