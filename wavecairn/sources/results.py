"""Result files: neighbours, threshold hits, timings, metadata."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The columns of result files.
NEIGHBOURS = "tID int, k int, pos long, corr double"
HITS = "Query int, Counter long, Position long, `Cross Correlation` double"


def write_neighbours(found: DataFrame, path: str) -> None:
    rows = found.select(F.col("tid").alias("tID"), "k", "pos", "corr")
    rows.orderBy("tID", "k").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_hits(found: DataFrame, path: str) -> None:
    """One folder for each part, as searches over parts of a series write their own."""
    rows = found.select("part", F.col("tid").alias("Query"), F.col("counter").alias("Counter"), F.col("pos").alias("Position"), F.col("corr").alias("Cross Correlation"))
    rows.repartition("part").sortWithinPartitions("Query", "Counter").write.mode("overwrite").partitionBy("part").option("header", True).csv(path)


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NEIGHBOURS).option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """All parts together; parts with a header only add nothing."""
    return spark.read.schema(HITS).option("header", True).option("ignoreLeadingWhiteSpace", True).option("recursiveFileLookup", True).csv(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path)


def write_metadata(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").json(path)


def write_table(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


class Timers:
    """Named wall-clock timers, as a DataFrame."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def measure(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.seconds.items()), "name string, seconds double")


def deduplicated(hits: DataFrame) -> DataFrame:
    """One row for each channel, template and position of overlapping shards, the best if they differ."""
    return hits.groupBy("channel", "tid", "pos").agg(F.max("corr").alias("corr"))


class Counters:
    """Named counts of the rows that pass a place of a plan, taken while it runs and read afterwards."""

    def __init__(self):
        self.seen: list[Observation] = []

    def watch(self, df: DataFrame, **counts: Column) -> DataFrame:
        self.seen.append(Observation())
        return df.observe(self.seen[-1], *[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in counts.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(name, n) for o in self.seen for name, n in o.get.items()]
        return spark.createDataFrame(rows, "name string, count long")
