"""Operator 6, mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent t in [0, 1] and normalised: w = p**t / sum(p**t). The exponent is
the largest one (found by bisection) whose weights meet the target: an entropy of at least `min_entropy`, and at most
`max_repeats` passes over any source. Each source then gets budget * w tokens: whole passes over all its documents and,
for the rest, the first blocks of a permutation of its blocks, within the last block the first documents of a permutation.

Sources are rows of a table, as many as there are; the driver sees only how many sources have each size, for the bisection. (k different sizes
take at least k**2 / 2 tokens.) A source has BLOCKS blocks, or more, so that a block is BLOCK_TOKENS on average.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._tables import materialise, small
from .packing import n_tokens

BLOCKS = 256
BLOCK_TOKENS = 4_000_000
STEPS = 50
#: Passes over a source at most, and the least entropy as a share of that of equal weights.
MAX_REPEATS = 4.0
ENTROPY_SHARE = 0.98


def weights(tokens: Sequence[int], t: float, times: Sequence[int] | None = None) -> list[float]:
    """Normalised p**t; sources without tokens weigh nothing. times: how many sources have each size."""
    times = [1] * len(tokens) if times is None else times
    total = sum(n * k for n, k in zip(tokens, times))
    raw = [math.exp(t * math.log(n / total)) if n else 0.0 for n in tokens]
    s = sum(r * k for r, k in zip(raw, times))
    return [r / s if s else 0.0 for r in raw]


def entropy(w: Sequence[float], times: Sequence[int] | None = None) -> float:
    return -sum(x * math.log(x) * k for x, k in zip(w, [1] * len(w) if times is None else times) if x > 0)


def exponent(tokens: Sequence[int], budget: float, min_entropy: float | None, max_repeats: float | None, times: Sequence[int] | None = None) -> float:
    """The largest t in [0, 1] that meets the entropy, then lowered never: repeats shrink as t grows, so that a repeat limit
    bounds t from below and, where both can't be met, wins."""

    def bisect(ok) -> float:
        lo, hi = 0.0, 1.0  # ok(lo) holds, ok(hi) doesn't
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    t = 1.0
    if min_entropy is not None and entropy(weights(tokens, 1.0, times), times) < min_entropy:
        t = bisect(lambda x: entropy(weights(tokens, x, times), times) >= min_entropy)
    if max_repeats is not None:
        repeats = lambda x: max((budget * w / n for w, n in zip(weights(tokens, x, times), tokens) if n), default=0.0)
        if repeats(t) > max_repeats:
            t = bisect(lambda x: repeats(x) > max_repeats) if repeats(1.0) <= max_repeats else 1.0
    return t


def _rand(salt: str, *cols: Column) -> Column:
    """32 reproducible bits of the columns, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 8), 16, 10).cast("long")


def mix_plan(sized: DataFrame, budget: float | None, min_entropy: float | None, max_repeats: float | None) -> tuple[DataFrame, int]:
    """Of documents (i, s, n, h): each source's passes, its blocks and where its rest is cut (s, passes, blocks, rank, block, last); and the number of sources."""
    totals = materialise(sized.groupBy("s").agg(F.sum("n").alias("size")))
    sizes = totals.groupBy("size").count().orderBy("size").collect()
    tokens, times = [r["size"] for r in sizes], [r["count"] for r in sizes]
    total, sources = sum(n * k for n, k in zip(tokens, times)), sum(times)
    budget = float(total) if budget is None else float(budget)
    if min_entropy is None:
        min_entropy = ENTROPY_SHARE * math.log(max(1, sum(k for n, k in zip(tokens, times) if n)))
    t = exponent(tokens, budget, min_entropy, max_repeats, times) if total else 1.0
    p = F.exp(F.log(F.greatest(F.col("size"), F.lit(1)) / float(total or 1)) * t)
    norm = sum(math.exp(t * math.log(n / total)) * k for n, k in zip(tokens, times) if n) if total else 1.0
    share = F.floor(p / norm * budget + 1e-6)
    # a source without tokens costs nothing: one pass
    plan = totals.withColumn("share", F.when(F.col("size") > 0, share)).selectExpr("s", f"cast(greatest({BLOCKS}, size div {BLOCK_TOKENS}) as int) as blocks", "if(size > 0, share div greatest(size, 1), 1) as passes", "if(size > 0, share % greatest(size, 1), 0) as rest")
    plan = materialise(plan)
    keyed = sized.join(small(plan.withColumnRenamed("s", "p_s"), sources), F.col("s").eqNullSafe(F.col("p_s"))).withColumn("b", _block()).where("rest > 0")
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("rank", "b"))
    blocks = keyed.groupBy("s", "b", "rest").agg(F.sum("n").alias("n")).withColumn("rank", _rand("order", F.col("s"), F.col("b"))).withColumn("upto", upto)
    cut = materialise(blocks.where("upto - n < rest and rest <= upto").selectExpr("s as c_s", "rank", "b as block", "rest - (upto - n) as left"))
    # documents of the one block of each source that the budget cuts
    edge = keyed.select("s", "b", "i", "h", "n").join(small(cut, sources), F.col("s").eqNullSafe(F.col("c_s")) & (F.col("b") == F.col("block")))
    edge = edge.groupBy("s", "left", _place("i", "h").alias("at")).agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    last = materialise(edge.withColumn("before", F.coalesce(before, F.lit(0))).where("before < left").groupBy(F.col("s").alias("l_s")).agg(F.max("at").alias("last")))
    plan = plan.join(small(cut, sources), F.col("s").eqNullSafe(F.col("c_s")), "left").join(small(last, sources), F.col("s").eqNullSafe(F.col("l_s")), "left")
    return plan.selectExpr("s as p_s", "passes", "blocks", "rank as cut_rank", "block", "last"), sources


def _id(i: str = "i", h: str = "h") -> Column:
    """The id, or the text's hash where it is null."""
    return F.coalesce(F.col(i).cast("string"), F.concat(F.lit("null "), F.col(h).cast("string")))


def _block() -> Column:
    return F.pmod(_rand("block", _id()), F.col("blocks")).cast("int")


def _place(i: str, h: str) -> Column:
    """What orders the documents of a block."""
    return F.struct(_rand("doc", _id(i, h)).alias("r"), F.col(i).isNotNull().alias("k"), F.col(i).alias("i"), F.col(h).alias("h"))


def mix(docs: DataFrame, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: Column | None = None, min_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> DataFrame:
    """Each document as often as the mixture takes it, with a column `epoch` (0, 1, ...) and its `block_rank` in that epoch.

    budget: tokens of the mixture, by default as many as the input has. Tokens are units between white space unless a
    length column is given; null lengths count 0. A null source is a source of its own. In the last, partial pass a document
    is taken while the documents before it leave room, so that a source overshoots by less than one document. Documents without tokens
    cost nothing and go with their block. Documents that share an id share a block and are ordered by text hash (null ids: by
    the text's hash alone); identical rows are taken together. Other columns pass through, whatever their names (existing columns epoch and
    block_rank are replaced); an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("epoch", "block_rank")]
    out = _take(docs, keep, budget, id_col, text_col, source_col, length, min_entropy, max_repeats)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("rank").alias("block_rank"), "epoch")


def sample(docs: DataFrame, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: Column | None = None, min_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> DataFrame:
    """The rows of mix() with the columns of docs alone, all of them."""
    return _take(docs, docs.columns, budget, id_col, text_col, source_col, length, min_entropy, max_repeats).select("row.*")


def _take(docs: DataFrame, keep: list[str], budget: float | None, id_col: str, text_col: str, source_col: str, length: Column | None, min_entropy: float | None, max_repeats: float | None) -> DataFrame:
    """(row, rank, epoch): the columns `keep` of each document, as often as it is taken."""
    n = F.greatest(F.coalesce((length if length is not None else n_tokens(text_col)).cast("long"), F.lit(0)), F.lit(0))
    key = [F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("s"), F.xxhash64(text_col).alias("h")]
    sized = materialise(docs.select(*key, n.alias("n")))
    plan, sources = mix_plan(sized, budget, min_entropy, max_repeats)
    every = docs.select(F.struct(*keep).alias("row"), *key).join(small(plan, sources), F.col("s").eqNullSafe(F.col("p_s")))
    every = every.withColumn("b", _block()).withColumn("rank", _rand("order", F.col("s"), F.col("b")))
    ahead = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("b") < F.col("block")))
    partial = ahead | ((F.col("b") == F.col("block")) & (_place("i", "h") <= F.col("last")))
    copies = F.col("passes") + F.when(F.coalesce(partial, F.lit(False)), 1).otherwise(0)
    return every.withColumn("copies", copies).where("copies > 0").select("row", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))


def sql(entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> str:
    """The same in SQL: the exponent by bisections in recursive queries, first for the entropy, then for the repeats."""

    def bisection(name: str, measure: str, ok: str) -> str:
        return f"""{name} AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN {ok} THEN mid ELSE lo END, CASE WHEN {ok} THEN hi ELSE mid END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS mid, h, total, (SELECT {measure} FROM p, (SELECT sum(p ** ((t.lo + t.hi) / 2)) AS z FROM p)) AS e
    FROM {name} t, target WHERE k < {STEPS}))"""

    x = "p ** ((t.lo + t.hi) / 2) / z"
    return f"""
WITH RECURSIVE
d AS (SELECT doc_id, source, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS n,
  ('0x' || md5('block|' || doc_id)[:8])::BIGINT AS block_draw, ('0x' || md5('doc|' || doc_id)[:8])::BIGINT AS doc_rank FROM documents),
s AS (SELECT source, sum(n)::DOUBLE AS n, greatest({BLOCKS}, sum(n)::BIGINT // {BLOCK_TOKENS}) AS blocks FROM d GROUP BY 1),
p AS (SELECT source, n, n / sum(n) OVER () AS p FROM s WHERE n > 0),
target AS (SELECT {entropy_share} * ln(count(*)) AS h, sum(n) AS total FROM p),
{bisection("by_entropy", f"-sum({x} * ln({x}))", "e >= h")},
{bisection("by_repeats", f"max(total * {x} / n)", f"e > {max_repeats}")},
t1 AS (SELECT CASE WHEN (SELECT -sum(p * ln(p)) FROM p) >= h THEN 1.0 ELSE (SELECT lo FROM by_entropy WHERE k = {STEPS}) END AS t FROM target),
r1 AS (SELECT max(total * p ** t / z / n) AS r FROM p, t1, target, (SELECT sum(p ** t) AS z FROM p, t1)),
t AS (SELECT CASE WHEN r <= {max_repeats} THEN t WHEN {max_repeats} < 1 THEN 1.0 ELSE (SELECT lo FROM by_repeats WHERE k = {STEPS}) END AS t FROM t1, r1),
w AS (SELECT source, n, p ** t / sum(p ** t) OVER () AS w, total FROM p, t, target),
b AS (SELECT source, n, floor(total * w + 1e-6) AS budget, floor(floor(total * w + 1e-6) / n) AS passes FROM w UNION ALL SELECT source, n, 0, 1 FROM s WHERE n = 0),
e AS (SELECT d.*, d.block_draw % s.blocks AS block FROM d JOIN s USING (source)),
o AS (SELECT source, block, ('0x' || md5('order|' || source || '|' || block)[:8])::BIGINT AS block_rank, sum(n) AS n FROM e GROUP BY 1, 2),
c AS (SELECT source, block, block_rank, n, sum(n) OVER (PARTITION BY source ORDER BY block_rank, block) AS upto FROM o),
x AS (SELECT e.doc_id, b.passes, c.block_rank, c.upto, c.n AS block_n, b.budget - b.passes * b.n AS rest,
  coalesce(sum(e.n) OVER (PARTITION BY e.source, e.block ORDER BY e.doc_rank, e.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e JOIN b USING (source) JOIN c ON c.source = e.source AND c.block = e.block),
y AS (SELECT doc_id, block_rank, passes + CASE WHEN rest > 0 AND upto - block_n < rest AND (upto < rest OR before < rest - (upto - block_n)) THEN 1 ELSE 0 END AS copies FROM x)
SELECT doc_id, block_rank, unnest(range(copies::BIGINT)) AS epoch FROM y
"""


SQL = sql()
