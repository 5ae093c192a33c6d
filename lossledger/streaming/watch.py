"""Growing logs: every micro-batch appends records to a table and re-judges the runs that grew.

Judging needs exact medians, so that state is the records themselves, kept as Parquet by batch; only the runs of the batch are read back
(their run_ids are joined, and the table is partitioned by a hash of run_id, so that other runs' files are pruned at run time).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import thresholds as T
from ..operators.single_run import check_records

PARTS = 64


def judge_growing(spark: SparkSession, store: str, least: int = T.WATCH_MIN_POINTS) -> Callable[[DataFrame, int], DataFrame]:
    """A function of (new records, batch id) that stores them and returns the reports of the runs they belong to.

    Runs with fewer than `least` losses are warming up: verdict null. A batch that is repeated after a failure replaces its own files.
    """

    def run(batch: DataFrame, batch_id: int) -> DataFrame:
        part = F.pmod(F.xxhash64("run_id"), F.lit(PARTS)).cast("int")
        # each batch is a folder of its own: writing it again after a failure changes nothing
        batch.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={batch_id}")
        grown = spark.read.schema(StructType([*batch.schema.fields, StructField("part", IntegerType()), StructField("batch", IntegerType())])).parquet(store).where(F.col("batch") <= batch_id)
        runs = batch.select("run_id", part.alias("part")).distinct()
        reports = check_records(grown.join(runs, ["run_id", "part"], "left_semi").drop("part", "batch"))
        return reports.withColumn("verdict", F.when(F.col("n_loss") >= least, F.col("verdict")))

    return run


def watch(records: DataFrame, store: str, checkpoint: str, on_reports: Callable[[DataFrame, int], None], interval: str | None = None, stop_on_fail: bool = False) -> StreamingQuery:
    """Starts judging a stream of canonical records. on_reports gets the reports of each micro-batch; with stop_on_fail the query ends once a run fails.

    interval: a processing-time trigger; without one all that is there is judged and the query ends.
    """
    judge = judge_growing(records.sparkSession, store)
    state: dict[str, StreamingQuery] = {}

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        reports = judge(batch, batch_id).cache()
        on_reports(reports, batch_id)
        failed = stop_on_fail and not reports.where("verdict = 'FAIL'").isEmpty()
        reports.unpersist()
        if failed and "query" in state:
            state["query"].stop()

    writer = records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    state["query"] = writer.start()
    return state["query"]


def stream_records(spark: SparkSession, directory: str, schema: str | StructType) -> DataFrame:
    """Canonical records from JSON files that appear in a directory (run_id, rec_idx and metrics)."""
    return spark.readStream.schema(schema).json(directory)


def stalls(last_growth: DataFrame, now: float, timeout: float = T.STALL_SEC) -> DataFrame:
    """last_growth (run_id, grew_at in epoch seconds) -> a TP-STALL finding for each run that hasn't grown for longer than the timeout."""
    quiet = last_growth.where(F.lit(now) - F.col("grew_at") > timeout)
    return quiet.select("run_id", *[F.lit(v).alias(k) for k, v in stall_finding(timeout).items()])


def stall_finding(timeout: float) -> dict[str, str]:
    return dict(id="TP-STALL", level="WARN", message=f"The log hasn't grown for {timeout:.0f}s: training may be stalled.", evidence="")


class StallClock:
    """Warns once for each episode without growth of one file."""

    def __init__(self, timeout: float = T.STALL_SEC) -> None:
        self.timeout, self.size, self.since, self.warned = timeout, -1, None, False

    def tick(self, size: int, now: float) -> bool:
        if size != self.size and size >= 0:
            self.size, self.since, self.warned = size, now, False
        elif self.since is None:
            self.since = now
        elif not self.warned and now - self.since > self.timeout:
            self.warned = True
            return True
        return False
