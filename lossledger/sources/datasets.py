"""Fine-tuning datasets: JSON objects, one a line, with the numbers of the lines that are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, idx, fields, malformed): 1-based physical line of its file, 0-based index among parsed records, top-level fields as texts.

    Blank lines are left out. Fields keep strings as they are and other values as JSON text (a null as 'None'). Files are split
    as any text: lines are numbered within their block, and blocks by what is before them.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    blank = F.trim(F.regexp_replace("raw", r"\s+", " ")) == ""
    lines = raw.withColumn("malformed", ~blank & F.try_parse_json("raw").isNull()).withColumn("good", (~blank & ~F.col("malformed")).cast("long")).withColumn("blank", blank)
    here = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.sum("good").alias("goods"))  # a row for each block of a file
    blocks = blocks.select("file", "block", before("lines", "file").alias("lines_before"), before("goods").alias("goods_before"))
    own = F.map_from_entries(F.transform(F.map_entries(F.from_json("raw", "map<string,string>")), lambda e: F.struct(e["key"], F.coalesce(e["value"], F.lit("None")))))
    ranked = lines.select("file", "block", "raw", "blank", "malformed", F.count("*").over(here).alias("line"), F.sum("good").over(here).alias("rank"))
    ranked = ranked.where("not blank").join(F.broadcast(blocks), ["file", "block"])
    return ranked.select((F.col("line") + F.col("lines_before")).alias("line_no"), F.when(~F.col("malformed"), F.col("rank") - 1 + F.col("goods_before")).alias("idx"), own.alias("fields"), "malformed")
