"""Catalogues of templates: CSV tables, nested event files in XML, and selection between them; traces by code and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import clean_code
from ..operators.etl import selected

CSV = "network string, station string, location string, channel string, starttime timestamp, endtime timestamp"
#: The fields of an event file that are used; all others are never parsed.
EVENTS = (
    "_publicID string, origin array<struct<_publicID string, arrival array<struct<pickID string, phase string>>>>, "
    "pick array<struct<_publicID string, time struct<value timestamp>, phaseHint string, "
    "waveformID struct<_networkCode string, _stationCode string, _locationCode string, _channelCode string>>>"
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """station, channel, starttime, endtime, and network and location (empty where the file has none)."""
    rows = spark.read.option("header", True).csv(path)
    named = {c.strip().lower(): c for c in rows.columns}
    column = lambda c: F.col(named[c]) if c in named else F.lit(None)
    texts = [clean_code(column(c).cast("string")).alias(c) for c in ("network", "station", "location", "channel")]
    return rows.select(*texts, *[F.try_to_timestamp(column(c)).alias(c) for c in ("starttime", "endtime")]).where("starttime is not null and endtime is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """One row for each arrival that refers to a pick of its event: event, network, station, location, channel, phase, time."""
    events = spark.read.format("xml").option("rowTag", "event").schema(EVENTS).load(path)
    arrivals = events.select("_publicID", "pick", F.explode("origin").alias("o")).select("_publicID", "pick", F.explode("o.arrival").alias("a")).where("a.pickID is not null")
    joined = arrivals.select("_publicID", F.filter("pick", lambda p: p["_publicID"] == F.col("a.pickID")).alias("p"), F.col("a.phase").alias("phase")).where(F.size("p") > 0)
    w = F.col("p")[0]["waveformID"]
    return joined.select(
        F.col("_publicID").alias("event"),
        clean_code(w["_networkCode"]).alias("network"),
        clean_code(w["_stationCode"]).alias("station"),
        clean_code(w["_locationCode"]).alias("location"),
        clean_code(w["_channelCode"]).alias("channel"),
        F.coalesce("phase", F.col("p")[0]["phaseHint"]).alias("phase"),
        F.col("p")[0]["time"]["value"].alias("time"),
    )


def windows_of_picks(picks: DataFrame, before: float = 2.0, length: float = 120.0) -> DataFrame:
    """Template times around picks: from `before` seconds before, `length` seconds long."""
    start = F.timestamp_add("MICROSECOND", F.lit(int(-before * 1e6)), F.col("time"))
    return picks.select("network", "station", "location", "channel", start.alias("starttime"), F.timestamp_add("MICROSECOND", F.lit(int((length - before) * 1e6)), F.col("time")).alias("endtime"))


def read(spark: SparkSession, path: str, kind: str = "auto", **picks) -> DataFrame:
    """Template times from a CSV or an event file; auto goes by the name."""
    if kind == "auto":
        kind = "qml" if path.lower().endswith((".qml", ".xml", ".quakeml")) else "csv"
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "qml":
        return windows_of_picks(read_events(spark, path), **picks)
    raise ValueError("a template source is auto, csv or qml")


def traces(samples: DataFrame, start: Column, end: Column, **codes: list[str] | None) -> DataFrame:
    """Samples with codes that match (* for any characters) and times in [start, end]; the range reaches the scan."""
    return selected(samples.where(F.col("ts").between(start, end)), **codes)
