"""TensorBoard event files: record framing and the few message fields that carry scalars, decoded by hand.

decode() turns the bytes of one file into scalars. read_scalars() runs it over `binaryFile` scans; EventSource is the same as a Python data
source (format "event_scalars"). Tags are then resolved and folded into records by plain DataFrame operations.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..functions.columns import canonical, normal_tag
from ..schema import METRICS
from .logs import is_event_file, path_column

SCALARS_DDL = "run_id string, tag string, step long, value double, wall_time double, file string, seq long"


def _fields(buf: memoryview) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a message's fields; IndexError or ValueError if it is broken."""

    def varint(at: int) -> tuple[int, int]:
        value = 0
        for shift in range(0, 70, 7):
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
        raise ValueError("varint too long")

    at = 0
    while at < len(buf):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 2, 5):
            size, at = varint(at) if kind == 2 else ((8 if kind == 1 else 4), at)
            if at + size > len(buf):
                raise IndexError("field runs past the end")
            value, at = buf[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, kind, value


#: Fields of a tensor that may hold its one number: (field, wire type) -> format.
_TENSOR = {(5, 2): "<f", (5, 5): "<f", (4, 2): "<f", (6, 2): "<d"}


def _tensor(buf: memoryview) -> float | None:
    for number, kind, value in _fields(buf):
        form = _TENSOR.get((number, kind))
        if form and len(value) >= struct.calcsize(form):
            return struct.unpack_from(form, value)[0]
    return None


def _event(buf: memoryview) -> Iterator[tuple[str, int, float, float]]:
    wall, step, out = 0.0, 0, []
    for number, kind, value in _fields(buf):
        if (number, kind) == (1, 1):
            (wall,) = struct.unpack("<d", value)
        elif (number, kind) == (2, 0):
            step = value - (1 << 64) if value >= 1 << 63 else value
        elif (number, kind) == (5, 2):
            for n, k, item in _fields(value):
                if (n, k) != (1, 2):
                    continue
                tag = x = None
                for field, wire, v in _fields(item):
                    if (field, wire) == (1, 2):
                        tag = bytes(v).decode("utf-8", "replace")
                    elif (field, wire) == (2, 5):
                        (x,) = struct.unpack("<f", v)
                    elif (field, wire) == (8, 2):
                        x = _tensor(v)
                if tag is not None and x is not None:
                    out.append((tag, x))
    for tag, x in out:
        yield tag, step, float(x), wall


def decode(data: bytes) -> list[tuple[str, int, float, float]]:
    """(tag, step, value, wall time) of a file; a broken record is left out, a cut last one ends the file."""
    buf, at, out = memoryview(data), 0, []
    while at + 12 <= len(buf):
        (size,) = struct.unpack_from("<Q", buf, at)
        body, nxt = at + 12, at + 16 + size
        if nxt > len(buf):
            break
        try:
            out.extend(_event(buf[body : body + size]))
        except (IndexError, ValueError, struct.error):
            pass  # this record only
        at = nxt
    return out


def _decode_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = decode(content)
            out = pd.DataFrame(rows, columns=["tag", "step", "value", "wall_time"])
            yield out.assign(run_id=path, file=path, seq=range(len(rows)))[["run_id", "tag", "step", "value", "wall_time", "file", "seq"]]


def read_scalars(spark: SparkSession, paths: str | list[str], named: bool = True, by_directory: bool = False) -> DataFrame:
    """Scalars of all event files under the paths; with by_directory the shards in one directory are one run."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    if named:
        raw = raw.where(is_event_file(F.col("_metadata.file_name")))
    out = raw.select(path_column().alias("path"), "content").mapInPandas(_decode_files, SCALARS_DDL)
    return out.withColumn("run_id", F.regexp_replace("file", "/[^/]*$", "")) if by_directory else out


def claim_winners(scalars: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """(run_id, canon, tag): for each metric the tag with most points, of equals the first by name."""
    tags = scalars.groupBy("run_id", "tag").agg(F.count("*").alias("n")).withColumn("canon", canonical(normal_tag(F.col("tag")), overrides)).where("canon is not null and canon <> 'step'")
    rank = F.row_number().over(Window.partitionBy("run_id", "canon").orderBy(F.desc("n"), "tag"))
    return tags.withColumn("k", rank).where("k = 1").select("run_id", "canon", "tag")


def fold(scalars: DataFrame, winners: DataFrame) -> DataFrame:
    """Records by step: the last value of a metric at a step wins; time is the wall time of the first metric there unless logged itself."""
    claimed = scalars.join(winners, ["run_id", "tag"])
    first_seen = F.min(F.struct("file", "seq")).over(Window.partitionBy("run_id", "canon"))
    claimed = claimed.withColumn("order", F.struct(first_seen.alias("claim"), "file", "seq"))
    cells = [F.expr(f"max_by(value, struct(file, seq)) FILTER (WHERE canon = '{m}')").alias(m) for m in METRICS if m != "step"]
    rows = claimed.groupBy("run_id", "step").agg(*cells, F.min_by("wall_time", "order").alias("wall"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("step")) - 1
    out = rows.select("run_id", rank.cast("long").alias("rec_idx"), *[F.col("step").cast("double").alias("step") if m == "step" else (F.coalesce("time", "wall").alias("time") if m == "time" else F.col(m)) for m in METRICS])
    cols = winners.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("canon", F.col("tag").alias("col")))).alias("cols"))
    return out.join(cols, "run_id", "left")


def read_event_records(spark: SparkSession, paths: str | list[str], overrides: dict[str, str] | None = None, named: bool = True, by_directory: bool = False) -> DataFrame:
    s = read_scalars(spark, paths, named, by_directory)
    return fold(s, claim_winners(s, overrides))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        files = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(os.path.join(self.path, "**", "*tfevents*"), recursive=True))
        return [_File(f) for f in files]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for seq, (tag, step, value, wall) in enumerate(decode(f.read())):
                yield partition.path, tag, step, value, wall, partition.path, seq


class EventSource(DataSource):
    """spark.read.format("event_scalars").load(path) on file systems that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "event_scalars"

    def schema(self) -> str:
        return SCALARS_DDL

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
