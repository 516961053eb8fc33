"""Cleaning and summarising of samples and catalogues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import packed_length
from ..functions.kernels import SENTINEL, smooth_length
from ..sources.series import stored, with_positions
from .search import blocks


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without a zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts.cast("timestamp_ntz")) / 1e6


def amplitude(series: DataFrame) -> DataFrame:
    """Counts of finite, NaN and infinite samples, and min, max and mean of the finite ones, by channel."""
    v = F.col("v").cast("double")
    infinite = F.abs(v) == float("inf")
    finite = F.when(~F.isnan(v) & ~infinite, v)
    return series.groupBy("channel").agg(F.count(finite).alias("finite_points"), F.count_if(F.isnan(v)).alias("nan_points"), F.count_if(infinite).alias("inf_points"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(finite).alias("mean"))


def preview(series: DataFrame, bin_: int) -> DataFrame:
    """Least and greatest sample of each run of `bin_` positions."""
    return series.groupBy("channel", F.floor(F.col("pos") / bin_).cast("long").alias("bin")).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def fill_ratio(series: DataFrame) -> DataFrame:
    return series.groupBy("channel").agg(F.count_if(F.col("v") == SENTINEL).alias("filled"), F.count("*").alias("samples"), F.avg((F.col("v") == SENTINEL).cast("double")).alias("ratio"))


def chunk_map(chunks: DataFrame) -> DataFrame:
    """channel, chunk, start, end, count: adds the gap before, and where the chunk's samples begin in the output."""
    order = W.partitionBy("channel").orderBy("start", "chunk")
    gap = (seconds(F.col("start")) - seconds(F.lag("end").over(order))).alias("gap_before")
    before = F.coalesce(F.sum("count").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return chunks.select("channel", "chunk", "start", "end", "count", gap, before.alias("output_start"))


def without_overlap(samples: DataFrame, time: str = "ts") -> DataFrame:
    """Drops samples of a chunk that do not come after the end of all chunks before it."""
    ends = samples.groupBy("channel", "chunk").agg(F.max(time).alias("end"))
    order = W.partitionBy("channel").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    previous = ends.select("channel", "chunk", F.max("end").over(order).alias("previous_end"))
    return samples.join(previous, ["channel", "chunk"]).where(F.col("previous_end").isNull() | (F.col(time) > F.col("previous_end"))).drop("previous_end")


def inventory_report(rows: DataFrame) -> DataFrame:
    """network, station, channel, days: counts, distinct stations, mean, median and total days for all, by network, by station and by channel."""
    sets = rows.groupingSets([[], ["network"], ["network", "station"], ["channel"]], "network", "station", "channel")
    return sets.agg(F.count("*").alias("entries"), F.countDistinct(F.struct("network", "station")).alias("stations"), F.avg("days").alias("mean_days"), F.median("days").alias("median_days"), F.sum("days").alias("total_days"))


def detrend_constant(series: DataFrame) -> DataFrame:
    mean = series.groupBy("channel").agg(F.avg("v").alias("__mean"))
    return series.join(mean, "channel").select("channel", "pos", (F.col("v") - F.col("__mean")).alias("v"))


def detrend_linear(series: DataFrame) -> DataFrame:
    """Residuals of the least-squares line; one row of coefficients a channel goes back to the samples."""
    line = series.groupBy("channel").agg(F.regr_slope("v", "pos").alias("__a"), F.regr_intercept("v", "pos").alias("__b"))
    return series.join(line, "channel").select("channel", "pos", (F.col("v") - F.col("__a") * F.col("pos") - F.col("__b")).alias("v"))


def taper(series: DataFrame, share: float = 0.02) -> DataFrame:
    """Cosine taper of this share of the samples at each end."""
    length = series.groupBy("channel").agg(F.count("*").alias("__n"))
    width = F.floor(F.col("__n") * share)
    edge = F.least(F.col("pos"), F.col("__n") - 1 - F.col("pos"))
    weight = F.when(edge < width, 0.5 * (1 - F.cos(F.lit(np.pi) * edge / width))).otherwise(1.0)
    return series.join(length, "channel").select("channel", "pos", (F.col("v") * weight).alias("v"))


def decimate(series: DataFrame, factor: int = 2) -> DataFrame:
    return series.where(F.col("pos") % factor == 0).select("channel", (F.col("pos") / factor).cast("long").alias("pos"), "v")


def clipped(rows: DataFrame, low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Ranges cut to [low, high]; those that are empty then are dropped."""
    return rows.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)}).where(F.col(start) < F.col(end))


def _sections(low: float, high: float, rate: float, order: int) -> np.ndarray:
    """Butterworth band-pass as second-order sections by bilinear transformation."""
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = poles * (w2 - w1) / 2
    root = np.sqrt(half**2 - w1 * w2 + 0j)
    analog = np.concatenate([half + root, half - root])
    digital = (2 * rate + analog) / (2 * rate - analog)
    digital = digital[np.argsort(digital.imag)]
    upper = digital[digital.imag > 0]
    out = []
    for p in upper:
        out.append([1, 0, -1, 1, -2 * p.real, abs(p) ** 2])
    sections = np.array(out, float)
    centre = np.exp(2j * np.pi * np.sqrt(low * high) / rate)
    for s in sections:  # unit gain in the middle of the band
        s[:3] /= abs(np.polyval(s[:3], centre) / np.polyval(s[3:], centre))
    return sections


def _recursive(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    for b0, b1, b2, _, a1, a2 in sections.tolist():
        s1 = s2 = 0.0
        y = np.empty(len(x))
        for k, v in enumerate(x.tolist()):
            out = b0 * v + s1
            s1 = b1 * v - a1 * out + s2
            s2 = b2 * v - a2 * out
            y[k] = out
        x = y
    return x


def zero_phase_response(low: float, high: float, rate: float, order: int = 4, tail: float = 1e-9) -> np.ndarray:
    """The symmetric impulse response of the band-pass run forth and back, up to where its rest is under `tail` of its sum."""
    sections, n = _sections(low, high, rate, order), 256
    while True:
        one = _recursive(np.concatenate([[1.0], np.zeros(n - 1)]), sections)
        both = np.correlate(one, one, "full")[n - 1 :]
        rest = np.cumsum(np.abs(both[::-1]))[::-1]
        small = np.flatnonzero(rest <= tail * rest[0])
        if len(small) and small[0] < n // 2:
            half = both[: small[0]]
            return np.concatenate([half[:0:-1], half])
        n *= 2


def bandpass(series: DataFrame, low: float, high: float, rate: float, order: int = 4, span: int = 4096) -> DataFrame:
    """channel, pos, v: zero-phase band-pass, samples beyond the ends being 0.

    Blocks overlap by the length of the impulse response, so the result does not depend on them; each is one product of spectra.
    """
    response = zero_phase_response(low, high, rate, order)
    reach = len(response) // 2
    length = series.groupBy("channel").agg(F.max("pos").alias("last"))
    held = blocks(series, 2 * reach + 1, span).join(length, "channel")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for channel, start, v, last in zip(*(batch.column(c) for c in ("channel", "start", "v", "last")), strict=True):
                x, s, n = v.values.to_numpy(zero_copy_only=False), start.as_py(), last.as_py() + 1
                size = smooth_length(len(x) + len(response) - 1)
                full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(response, size), size)[reach : reach + len(x)]
                # a block owns the samples `reach` behind its starts; the ends of the series go to the first and last block
                first, end = (0 if s == 0 else s + reach), min(s + span + reach, n)
                if first < end:
                    y = full[first - s : end - s]
                    yield pa.RecordBatch.from_pydict({"channel": pa.array([channel.as_py()] * len(y), pa.string()), "pos": pa.array(np.arange(first, end), pa.int64()), "v": y})

    return held.select("channel", "start", "v", "last").mapInArrow(run, "channel string, pos long, v double")


def gap_fill(samples: DataFrame, step: float, seed: int = 0, scale: float = 3.0, run: int = 4096) -> DataFrame:
    """channel, ts (seconds), v: missing steps between neighbours get normal noise of `scale` deviations; filled tells which.

    The noise depends on seed, channel and time only, not on partitions. A long gap is made in runs of bounded size.
    """
    spread = samples.groupBy("channel").agg(F.stddev_pop("v").alias("__sd"))
    nxt = F.lead("ts").over(W.partitionBy("channel").orderBy("ts"))
    holes = samples.withColumn("__gap", F.round((nxt - F.col("ts")) / step).cast("long")).where(F.col("__gap") > 1)
    runs = holes.join(spread, "channel").select("channel", "ts", "__sd", "__gap", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__gap") - 2) / run))).alias("__run"))
    within = F.sequence(F.col("__run") * run + 1, F.least(F.col("__run") * run + run, F.col("__gap") - 1))
    made = runs.select("channel", "ts", "__sd", F.explode(within).alias("__k")).select("channel", (F.col("ts") + F.col("__k") * step).alias("ts"), "__sd")
    uniform = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), "channel", "ts"), 11) + 0.5) / float(1 << 53)
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * np.pi * uniform(2))
    noise = made.select("channel", "ts", (normal * scale * F.col("__sd")).alias("v"), F.lit(True).alias("filled"))
    return samples.select("channel", "ts", "v", F.lit(False).alias("filled")).unionByName(noise)


def by_interval(catalogue: DataFrame, samples: DataFrame, width: int) -> DataFrame:
    """Rows of catalogue(id, start, end) with the samples(ts, v) in [start, end], seconds: an equi-join on time buckets, then the exact test."""
    spread = catalogue.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    return spread.join(samples.withColumn("__b", F.floor(F.col("ts") / width)), "__b").where(F.col("ts").between(F.col("start"), F.col("end"))).drop("__b")


def complete_templates(samples: DataFrame, requests: DataFrame, multiple: int = 8) -> DataFrame:
    """tid, points, length, reason: which requests(tid, start, end, rate) samples(tid, ts, v) fill, times in seconds.

    The length is the requested duration in samples, rounded down to a multiple. A template must have so many samples, begin
    and end within one sample of what was asked for, have no gap, and be finite and not constant over its length.
    """
    v = F.col("v").cast("double")
    joined = samples.join(requests, "tid").withColumn("length", packed_length(F.rint((F.col("end") - F.col("start")) * F.col("rate")).cast("long"), multiple))
    used = F.row_number().over(W.partitionBy("tid").orderBy("ts")) <= F.col("length")
    own = F.when(used, v)
    bad = used & (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    joined = joined.select("tid", "ts", "length", "start", "end", "rate", own.alias("v"), bad.alias("bad"))
    one = lambda c: F.max(c).alias(c)
    seen = joined.groupBy("tid").agg(F.count("*").alias("points"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if("bad").alias("bad"), F.min("v").alias("low"), F.max("v").alias("high"), *map(one, ("length", "start", "end", "rate")))
    seen = requests.select("tid").join(seen, "tid", "left")
    late = 1.01 / F.col("rate")
    reason = (
        F.when(F.col("points").isNull(), "missing")
        .when(F.col("length") <= 0, "empty")
        .when(F.col("points") < F.col("length"), "short")
        .when((F.col("first") - F.col("start") > late) | (F.col("end") - F.col("last") > late), "endpoint")
        .when(F.rint((F.col("last") - F.col("first")) * F.col("rate")) + 1 > F.col("points"), "gap")
        .when(F.col("bad") > 0, "non-finite")
        .when(F.col("low") == F.col("high"), "constant")
        .otherwise("ok")
    )
    return seen.select("tid", F.coalesce("points", F.lit(0)).cast("long").alias("points"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), reason.alias("reason"))


def described(rows: DataFrame, by: list[str], start: str, end: str, sets: list[str], counts: list[str]) -> DataFrame:
    """Time bounds, sorted sets of values and counters ("value:count") of a catalogue; the sets and counters are over few distinct values."""
    bounds = rows.groupBy(*by).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("entries"), *[F.array_sort(F.collect_set(c)).alias(c) for c in sets])
    for c in counts:
        each = rows.groupBy(*by, c).agg(F.count("*").alias("__n"))  # counted before they meet
        told = F.transform(F.array_sort(F.collect_list(F.struct(F.col(c).alias("k"), "__n"))), lambda x: F.concat_ws(":", x["k"].cast("string"), x["__n"].cast("string")))
        bounds = bounds.join(each.groupBy(*by).agg(told.alias(c)), by)
    return bounds


def waveform_metadata(series: DataFrame, rate: float, dataset: str, band: tuple[float, float], factor: int = 1) -> DataFrame:
    """One nested row a channel: what is written beside a waveform file."""
    stats = amplitude(series)
    length = series.groupBy("channel").agg(F.count("*").alias("number_of_points"))
    both = stats.join(length, "channel")
    amplitudes = F.struct("finite_points", "nan_points", "inf_points", "min", "max", "mean")
    frequency = F.struct(F.lit(float(rate)).alias("sampling_rate_hz"), F.lit(float(band[0])).alias("bandpass_min_hz"), F.lit(float(band[1])).alias("bandpass_max_hz"), F.lit(factor).alias("downsample_factor"))
    n = F.col("number_of_points")
    return both.select(
        F.lit(dataset).alias("dataset"), F.lit("waveform").alias("kind"), F.lit(2).alias("pipeline_version"), "channel", "number_of_points", F.lit("float32").alias("dtype"),
        F.concat("channel", F.lit(".len"), n, F.lit(".bin")).alias("binary_file_name"), (n * 4).alias("binary_file_size_bytes"), amplitudes.alias("amplitude_stats"), frequency.alias("frequency"),
        F.struct((n / F.lit(float(rate))).alias("actual_duration_seconds")).alias("source"),
    )


def prepared(series: DataFrame, rate: float, low: float, high: float, factor: int = 1, share: float = 0.02) -> DataFrame:
    """The cleaning chain of a waveform: constant and linear trends go, the ends are tapered, the band is passed, and every factor-th sample stays."""
    out = bandpass(stored(taper(detrend_linear(detrend_constant(series)), share), "tapered"), low, high, rate)
    return decimate(out, factor) if factor > 1 else out


def generate(series: DataFrame, folder: str, rate: float, low: float, high: float, factor: int = 1, dataset: str = "all") -> DataFrame:
    """Cleans all channels, writes a float32 file for each and the metadata beside them, and returns the metadata."""
    from ..sources import raw, results

    clean = stored(prepared(series, rate, low, high, factor), "prepared")
    told = stored(waveform_metadata(clean, rate / factor, dataset, (low, high), factor), "metadata")
    for row in told.select("channel", "binary_file_name").toLocalIterator():  # a row a channel
        raw.write_float32(clean.where(F.col("channel") == row.channel), f"{folder}/{row.binary_file_name}")
        results.write_metadata(told.where(F.col("channel") == row.channel), f"{folder}/metadata/{row.channel}")
    return told


def selected(rows: DataFrame, **wanted: list[str] | None) -> DataFrame:
    """Rows whose columns match one of the given values; None takes all, * stands for any characters."""
    for column, values in wanted.items():
        if values is not None:
            pattern = "^(" + "|".join("".join(".*" if c == "*" else f"\\Q{c}\\E" for c in v) for v in values) + ")$"
            rows = rows.where(F.col(column).rlike(pattern))
    return rows


def of_duration(rows: DataFrame, seconds: float = 10.0, tolerance: float = 1.0) -> DataFrame:
    length = (F.unix_micros("endtime") - F.unix_micros("starttime")) / 1e6
    return rows.where(F.abs(length - seconds) <= tolerance)


def strided(rows: DataFrame, order: list[str], offset: int, stride: int, most: int | None = None) -> DataFrame:
    """Every stride-th row of a sorted inventory, of its first `most` rows if that is given."""
    numbered = with_positions(rows, order)
    if most is not None:
        numbered = numbered.where(F.col("pos") < most)
    return numbered.where((F.col("pos") >= offset) & (F.pmod(F.col("pos") - offset, F.lit(stride)) == 0)).drop("pos")


def hashed_share(rows: DataFrame, column: str, offset: int, stride: int) -> DataFrame:
    return rows.where(F.crc32(F.col(column)) % stride == offset)


def picks(events: DataFrame, picks_: DataFrame) -> DataFrame:
    """Nested events (id, origins.arrivals.pick_id) joined with their picks; arrivals without one are dropped."""
    arrivals = events.select("id", F.explode("origins").alias("o")).select("id", F.explode("o.arrivals").alias("a")).select("id", F.col("a.pick_id").alias("pick_id"))
    return arrivals.where("pick_id is not null").join(picks_.withColumnRenamed("id", "pick_id"), "pick_id")
