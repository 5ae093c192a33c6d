"""Operator 5, removal of repeated passages by overlapping windows of three lines.

Every three consecutive lines of a document, not all of them blank, are a window. A window whose three lines occur anywhere before, in the
order (doc_id, text hash, position), is a later occurrence; each line that a later occurrence covers is removed.

Windows are hashed once, into a table; only repeated ones go on to be ordered. Only texts that a bit map of fixed size marks as
cut are shuffled to their cuts, all others pass by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import SLOTS, bits, materialise, small

WIDTH = 3


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, cut): for each document that repeats something, by id and text hash, the positions of the lines to remove; a written table."""
    line = lambda x: F.struct(F.xxhash64(F.trim(x)).alias("a"), F.xxhash64(F.lit(7), F.trim(x)).alias("b"), (F.trim(x) != "").alias("ink"))
    windows = materialise(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.instr("text", "\n") > 0)
        .select("id", F.xxhash64("text").alias("h"), F.transform(F.split("text", "\n"), line).alias("l")).where(F.size("l") >= WIDTH)
        .select("id", "h", F.posexplode(F.expr(f"transform(sequence(0, size(l) - {WIDTH}), i -> struct(xxhash64(l[i].a, l[i+1].a, l[i+2].a) as a, xxhash64(l[i].b, l[i+1].b, l[i+2].b) as b, l[i].ink or l[i+1].ink or l[i+2].ink as ink))")).alias("pos", "w"))
        .where("w.ink").select("id", "h", "pos", "w.a", "w.b")
    )
    often = materialise(windows.groupBy("a", "b").count().where("count > 1").select("a", "b"))
    again = windows.join(small(often), ["a", "b"], "left_semi")
    at = F.struct(F.col("id").isNotNull().alias("has"), "id", "h", "pos")
    first = again.groupBy("a", "b").agg(F.min(at).alias("first"))
    later = again.join(first, ["a", "b"]).where(at != F.col("first"))
    return materialise(later.groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("pos", F.col("pos") + WIDTH - 1)))).alias("cut")))


def _cut(docs: DataFrame, names: list[str], id_col: str, text_col: str) -> DataFrame:
    """(row, text, n_lines, n_removed): each row's columns of these names, its new text, and its lines."""
    cut = repeated_lines(docs, id_col, text_col)
    key = F.xxhash64("id", "h")
    marks = F.broadcast(bits(cut.select(key.alias("k")), "k"))  # SLOTS rows at most
    src = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).withColumn("k", key)
    marked = src.join(marks, F.col("k").bitwiseAND(F.lit(SLOTS - 1)).cast("int") == F.col("slot"), "left")
    maybe = F.coalesce(F.expr("shiftrightunsigned(bits, cast(shiftrightunsigned(k, 20) & 63 as int)) & 1") == 1, F.lit(False))
    mine = cut.select(F.col("id").alias("c_id"), F.col("h").alias("c_h"), "cut")
    some = marked.where(maybe).join(mine, (F.col("h") == F.col("c_h")) & F.col("id").eqNullSafe(F.col("c_id")), "left").select("row", "cut")
    every = some.unionByName(marked.where(~maybe).select("row", F.lit(None).cast("array<int>").alias("cut")))
    text = F.col("row").getField(text_col)
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("cut"))  # by a hash set: linear in the lines
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return every.select("row", F.when(F.col("cut").isNull(), text).otherwise(kept).alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"))


def _own(names: list[str], text_col: str) -> list:
    return [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a new text, and n_lines and n_removed (existing columns of these names are replaced).

    Lines are split at newlines and compared without spaces at their ends; blank lines alone are no passage. Documents of fewer than three
    lines have no window and stay as they are, as do null and empty texts. Rows with the same id and the same text are one occurrence:
    they are cut alike, and the first of them is not a repeat of itself. Null ids come first in the order, texts of one id are ordered
    by their hash. A document all of whose lines are repeats gets an empty text (keep_rest() drops it). Long texts are cut like
    others. Other columns pass through unchanged, whatever their names. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _cut(docs, names, id_col, text_col).select(*_own(names, text_col), "n_lines", "n_removed")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, all of them, with the new texts of dedup_lines(), and without the documents that lost every line. Null and empty texts stay."""
    return _cut(docs, docs.columns, id_col, text_col).where("n_removed = 0 or n_removed < n_lines").select(*_own(docs.columns, text_col))


def keep_rest(deduped: DataFrame) -> DataFrame:
    """The result of dedup_lines() without the documents that lost every line, and without n_lines and n_removed. Null and empty texts stay."""
    return deduped.where("n_removed = 0 or n_removed < n_lines").drop("n_lines", "n_removed")


SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l),
w AS (SELECT doc_id, pos, trim(line) AS a, trim(lead(line) OVER o) AS b, trim(lead(line, 2) OVER o) AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w WHERE c IS NOT NULL AND a || b || c <> ''),
cut AS (SELECT DISTINCT doc_id, pos + d AS pos FROM r, (VALUES (0), (1), (2)) v(d) WHERE k > 1),
kept AS (SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.pos) AS text FROM p ANTI JOIN cut ON p.doc_id = cut.doc_id AND p.pos = cut.pos GROUP BY p.doc_id)
SELECT l.doc_id, coalesce(kept.text, '') AS text, len(l.ls)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed
FROM l LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY 1) c USING (doc_id)
"""
