"""Headerless little-endian float32 files: sizes, range scans through a data source, writers; archives and names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def float_counts(spark: SparkSession, path: str) -> DataFrame:
    """path, samples of each file; a length that is no multiple of 4 is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ok = F.when(F.col("length") % 4 == 0, F.col("length") / 4).otherwise(F.raise_error(F.concat(F.lit("not a float32 file: "), F.col("path"))))
    return files.select("path", ok.cast("long").alias("samples"))


class _Range(InputPartition):
    def __init__(self, start: int, count: int):
        self.start, self.count = start, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, span: int, overlap: int, first: int, limit: int | None, channel: str):
        self.path, self.span, self.overlap, self.first, self.limit, self.channel = path, span, overlap, first, limit, channel

    def partitions(self):
        system, inner = _open(self.path)
        size = system.get_file_info(inner).size
        if size % 4:
            raise ValueError(f"not a float32 file: {self.path}")
        end = size // 4 if self.limit is None else min(size // 4, self.first + self.limit)
        return [_Range(s, min(self.span + self.overlap, end - s)) for s in range(self.first, end, self.span)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        system, inner = _open(self.path)
        with system.open_input_file(inner) as f:
            values = np.frombuffer(f.read_at(4 * part.count, 4 * part.start), "<f4").astype(np.float64)
        block = (part.start - self.first) // self.span
        yield pa.RecordBatch.from_pydict({"channel": [self.channel], "block": pa.array([block], pa.int64()), "start": pa.array([part.start], pa.int64()), "v": pa.array([values], pa.list_(pa.float64()))})


class Float32Source(DataSource):
    """format("float32"): blocks(channel, block, start, v) of a file. Options: path, span, overlap (m - 1), first, limit, channel."""

    @classmethod
    def name(cls) -> str:
        return "float32"

    def schema(self) -> str:
        return "channel string, block long, start long, v array<double>"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], int(o.get("span", 1 << 20)), int(o.get("overlap", 0)), int(o.get("first", 0)), int(o["limit"]) if "limit" in o else None, o.get("channel", "all"))


def read_blocks(spark: SparkSession, path: str, m: int = 1, span: int = 1 << 20, first: int = 0, limit: int | None = None, channel: str = "all") -> DataFrame:
    """Blocks of one file with an overlap of a window less one, each read by its own task; no exchange is needed before a search."""
    spark.dataSource.register(Float32Source)
    reader = spark.read.format("float32").option("path", path).option("span", str(span)).option("overlap", str(m - 1)).option("first", str(first)).option("channel", channel)
    return (reader if limit is None else reader.option("limit", str(limit))).load()


def read_series(spark: SparkSession, path: str, **options) -> DataFrame:
    held = read_blocks(spark, path, **options)
    return held.select("channel", "start", F.posexplode("v").alias("j", "v")).select("channel", (F.col("start") + F.col("j")).alias("pos"), "v")


def read_templates(spark: SparkSession, path: str, m: int, limit: int | None = None) -> DataFrame:
    """Templates(tid, v) of a packed file; a length that is no whole number of templates is an error."""
    system, inner = _open(path)
    if system.get_file_info(inner).size % (4 * m):
        raise ValueError("the file is no whole number of templates")
    return read_blocks(spark, path, span=m, limit=None if limit is None else limit * m).select(F.col("block").cast("int").alias("tid"), "v")


def _joined_parts(rows: DataFrame, path: str) -> int:
    """Writes the bytes of rows(place, data) to part files, one a row, by the executors, and joins them in order; returns the bytes.

    The driver copies bytes only, a part of bounded size at a time. The folder of parts is removed.
    """
    parts = path + ".parts"
    system, inner = _open(parts)
    system.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, folder = _open(parts)
        for batch in batches:
            for place, data in zip(batch.column("place").to_pylist(), batch.column("data").to_pylist(), strict=True):
                name = f"{folder}/{place:020d}"
                with own.open_output_stream(name) as f:  # a task that is run again writes the same bytes
                    f.write(data)
                yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "size": pa.array([len(data)], pa.int64())})

    written = rows.select("place", "data").mapInArrow(run, "place long, size long").orderBy("place")
    total = 0
    target, to = _open(path)
    with target.open_output_stream(to) as out:
        for row in written.toLocalIterator():
            with system.open_input_stream(f"{inner}/{row.place:020d}") as f:
                total += out.write(f.read())
    system.delete_dir(inner)
    return total


def _packed(rows: DataFrame, place: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v in zip(batch.column(place).to_pylist(), batch.column("v"), strict=True):
                data = v.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes()
                yield pa.RecordBatch.from_pydict({"place": pa.array([k], pa.int64()), "data": pa.array([data], pa.binary())})

    return rows.select(place, "v").mapInArrow(run, "place long, data binary")


def write_float32(series: DataFrame, path: str, span: int = 1 << 20) -> int:
    """Writes the values of one channel, whose positions have no gaps, in order; returns their number."""
    from ..operators.search import blocks

    return _joined_parts(_packed(blocks(series, 1, span), "start"), path) // 4


def write_templates(templates: DataFrame, path: str, m: int, many: int = 1 << 14) -> int:
    """Packs templates(tid, v) of m samples one after the other, by tid; returns their number. Template i of the file is the one of i-th least tid."""
    right = F.when(F.size("v") == m, F.col("v").cast("array<double>")).otherwise(F.raise_error(F.lit("a template has another length")))
    dealt = templates.select("tid", right.alias("v")).groupBy(F.floor(F.col("tid") / many).cast("long").alias("part"))
    flat = dealt.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tid", "v"))), lambda x: x["v"])).alias("v"))  # `many` templates a part
    return _joined_parts(_packed(flat, "part"), path) // (4 * m)


def inventory(spark: SparkSession, paths: DataFrame, prefixes: str = "HH|HN|BH") -> DataFrame:
    """network, station, location, channel, t_start, t_end from day-file names NET.STA.LOC.CHA.D.YEAR.JDAY."""
    p = F.split(F.element_at(F.split("path", "/"), -1), "\\.")
    day = F.date_add(F.make_date(p[5].cast("int"), F.lit(1), F.lit(1)), p[6].cast("int") - 1)
    named = paths.where(F.col("path").rlike(r"(^|/)[^./]*\.[^./]*\.[^./]*\.[^./]*\.D\.\d{4}\.\d{3}$"))
    rows = named.select(p[0].alias("network"), p[1].alias("station"), p[2].alias("location"), p[3].alias("channel"), day.alias("day")).where(F.col("channel").rlike(f"^({prefixes})"))
    return rows.groupBy("network", "station", "location", "channel").agg(F.min("day").cast("timestamp").alias("t_start"), F.date_add(F.max("day"), 1).cast("timestamp").alias("t_end")).orderBy("network", "station", "location", "channel")


_WAVE = r"^(.+)\.len(\d+)\.bin$"


def discovered(files: DataFrame) -> DataFrame:
    """key, samples, issue for files(path, length) named <key>.len<N>.bin: wrong sizes and repeated keys are told."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.where(name.rlike(_WAVE)).select("path", "length", F.regexp_extract(name, _WAVE, 1).alias("key"), F.regexp_extract(name, _WAVE, 2).cast("long").alias("samples"))
    copies = F.count("*").over(W.partitionBy("key"))
    issue = F.when(F.col("length") != F.col("samples") * 4, "size").when(copies > 1, "duplicate")
    return named.select("path", "key", "samples", issue.alias("issue"))


def is_wave(name: str) -> bool:
    return re.match(_WAVE, name) is not None
