"""Series and templates from tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="wavecairn-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_positions(df: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """Adds pos, counted from 0 in this order (within each value of `by`), without sending all rows through one task.

    Rows are range-partitioned, sorted and numbered within their partition, and stored, so that a second pass sees
    the same partitions; offsets come from one count a partition (and value).
    """
    keys = [by] if by else []
    local = W.partitionBy("__pid", *keys).orderBy(*order)
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__pid", F.spark_partition_id())
    held = stored(ranged.withColumn("__row", F.row_number().over(local).cast("long")), "ranged")
    counts = held.groupBy("__pid", *keys).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return held.join(offsets, ["__pid", *keys]).withColumn("pos", F.col("__row") - 1 + F.col("__off")).drop("__pid", "__row", "__off")


def from_table(df: DataFrame, order: list[str], value: str, channel: str | None = None, name: str = "all") -> DataFrame:
    """series(channel, pos, v) from the rows of a table."""
    source = df.select(*dict.fromkeys([*order, value, *([channel] if channel else [])]))
    out = with_positions(source, order, channel)
    return out.select((F.col(channel) if channel else F.lit(name)).alias("channel"), "pos", F.col(value).cast("double").alias("v"))


def events(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_table(table, ["ts", "event_id"], "value", "event_type" if by_type else None, "events")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return from_table(table, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_extendedprice", None, "prices")


def prefix(series: DataFrame, length: int) -> DataFrame:
    """The first samples only; the filter reaches the scan of a stored series."""
    return series.where(F.col("pos") < length)


def cut(series: DataFrame, starts: list[int], m: int, channel: str | None = None) -> DataFrame:
    """Templates(tid, v): the windows of a series at these starts."""
    spark = series.sparkSession
    at = spark.createDataFrame(list(enumerate(starts)), "tid int, s long")
    own = series if channel is None else series.where(F.col("channel") == channel)
    near = own.where(" or ".join(f"pos between {int(s)} and {int(s) + m - 1}" for s in starts))  # bounded: m rows a template
    joined = near.join(F.broadcast(at), (F.col("pos") >= F.col("s")) & (F.col("pos") < F.col("s") + m))
    return joined.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("w")).select("tid", F.col("w.v").alias("v"))


def unpacked(flat: DataFrame, m: int) -> DataFrame:
    """Templates(tid, v) from rows (values: one flat array): template i is values[i*m:(i+1)*m]; a rest is an error. Other columns stay."""
    rest = [c for c in flat.columns if c != "values"]
    checked = flat.select(*rest, F.when(F.size("values") % m == 0, F.col("values")).otherwise(F.raise_error(F.lit("the values are no whole number of templates"))).alias("values"))
    ids = F.sequence(F.lit(0), (F.size("values") / m).cast("int") - 1)
    each = checked.where(F.size("values") > 0).select(*rest, "values", F.explode(ids).alias("tid"))
    return each.select(*rest, "tid", F.slice("values", F.col("tid") * m + 1, m).alias("v"))
