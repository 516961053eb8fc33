"""Exact subsequence similarity search as DataFrame plans.

``knn_search`` and ``threshold_search`` take series(channel, pos, v), blocks(channel, block, start, v), or an
``index.Index`` built before, and templates(tid, v), or templates(channel, tid, v) that are looked for in their own
channel only, and return ordinary DataFrames. Samples are grouped into blocks that overlap by a window less one, so
every window lies in one block and matching needs no further exchange; blocks that are stored or read as such need
none at all. Templates reach the kernels in slices of bounded size. Ordered folds run in the JVM over islands of hits
that cannot influence each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Switches
from ..functions import kernels
from . import index
from .index import Index

#: Windows in a block; bytes of templates sent to all tasks at once.
SPAN, TEMPLATE_BYTES = 4096, 32 << 20
#: The span of blocks that are given: all that they hold.
WHOLE = 1 << 40
#: Points of all templates that the plain form takes.
SQL_POINTS = 20_000
STRATEGIES = ("auto", "sql", "scan", "sax", "index", "fft")


def check(m: int, segments: int = 16, k: int | None = None, t: float | None = None, o: int = 0, groups: int = 1, strategy: str = "scan") -> None:
    if m < 1 or (strategy in ("sax", "index") and m % segments):
        raise ValueError("the window length must be positive and a multiple of the segments")
    if k is not None and k < 1 or o < 0 or groups < 1:
        raise ValueError("k and groups must be positive, the offset not negative")
    if t is not None and not -1 <= t <= 1:
        raise ValueError("the correlation threshold lies in [-1, 1]")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")


def is_blocks(source: DataFrame) -> bool:
    return {"block", "start", "v"} <= set(source.columns)


def samples(source: DataFrame) -> DataFrame:
    """channel, pos, v of a series or of blocks; the overlap of blocks counts once."""
    if not is_blocks(source):
        return source
    each = source.select("channel", "start", F.posexplode("v").alias("j", "v")).select("channel", (F.col("start") + F.col("j")).alias("pos"), "v")
    return each.dropDuplicates(["channel", "pos"])


def blocks(series: DataFrame, m: int, span: int = SPAN) -> DataFrame:
    """channel, block, start and samples: block b owns the windows that start in [b*span, (b+1)*span).

    Blocks given as such stay as they are, whatever their length; they must overlap by m - 1 samples, and own all windows they hold.
    """
    if is_blocks(series):
        return series.select("channel", "block", "start", F.col("v").cast("array<double>").alias("v"))
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - (m - 1)) / span)).cast("long")
    dealt = series.select("channel", "pos", F.col("v").cast("double").alias("v"), F.explode(F.sequence(first, F.floor(F.col("pos") / span).cast("long"))).alias("block"))
    return (
        dealt.groupBy("channel", "block")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
        .select("channel", "block", (F.col("block") * span).alias("start"), F.col("s.v").alias("v"))
    )


class Slice(NamedTuple):
    """Some templates: ids, z-normalised rows, and the channel of each, or None if they apply to all."""

    ids: np.ndarray
    z: np.ndarray
    channels: list[str] | None


def slices(templates: DataFrame, m: int) -> Iterator[Slice]:
    """Templates so many bytes at a time; each slice is a pass over the blocks of its channels."""
    most = max(1, TEMPLATE_BYTES // (8 * m))
    own = ["channel"] if "channel" in templates.columns else []
    good = templates.where(F.size("v") == m).select(*own, F.col("tid").cast("int").alias("tid"), F.col("v").cast("array<double>").alias("v"))

    def slice_(rows: list) -> Slice:
        got = sorted(tuple(r) for r in rows)
        return Slice(np.array([r[-2] for r in got], np.int32), np.array([kernels.znorm(np.array(r[-1])) for r in got]), [r[0] for r in got] if own else None)

    first = good.limit(most + 1).collect()  # a slice and one more at most
    if len(first) <= most:
        if first:
            yield slice_(first)
        return
    parts = 2 * -(-good.count() // most)
    for k in range(parts):
        rows = good.where(F.pmod(F.xxhash64(*own, "tid"), F.lit(parts)) == k).collect()
        if rows:
            yield slice_(rows)


def _matched(held: DataFrame, part: Slice, bound: float, strategy: str, segments: int, span: int, top: tuple[int, int] | None = None, limits: DataFrame | None = None) -> DataFrame:
    """Pairs within the bound, or within limits(channel, tid, ed) where there is one. top: only the best k of each block and template that are o apart."""
    m = part.z.shape[1]
    if part.channels is not None:
        held = held.where(F.col("channel").isin(sorted(set(part.channels))))
    if limits is None:
        blocks_ = held.select("channel", "start", "v", F.lit(None).cast("array<struct<tid:int,ed:double>>").alias("limits"))
    else:
        by_channel = limits.groupBy("channel").agg(F.collect_list(F.struct(F.col("tid").cast("int").alias("tid"), "ed")).alias("limits"))  # a slice's templates at most
        blocks_ = held.join(by_channel, "channel", "left").select("channel", "start", "v", "limits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for channel, start, v, own in zip(*(batch.column(c) for c in ("channel", "start", "v", "limits")), strict=True):
                c, s, x = channel.as_py(), start.as_py(), v.values.to_numpy(zero_copy_only=False)[: span + m - 1]
                use = np.arange(len(part.ids)) if part.channels is None else np.flatnonzero([o == c for o in part.channels])
                ids, known = part.ids[use], {r["tid"]: r["ed"] for r in own.as_py() or ()}
                most = np.array([known.get(int(t), bound) for t in ids])
                # long blocks are compared piece by piece
                pieces = [(lo, kernels.matches(x[lo : lo + SPAN + m - 1], part.z[use], most, strategy, segments)) for lo in range(0, max(1, len(x) - m + 1), SPAN)]
                i = np.concatenate([a + lo for lo, (a, _, _) in pieces])
                j, corr = (np.concatenate([p[k] for _, p in pieces]) for k in (1, 2))
                if top and len(i):
                    k, o = top
                    keep = []
                    for t in np.unique(j):
                        at = np.flatnonzero(j == t)
                        at = at[np.lexsort((i[at], -corr[at]))]
                        if o > 0:
                            chosen = set(kernels.separated(i[at], k, o))
                            at = np.array([a for a in at if i[a] in chosen])
                        keep.append(at[:k])
                    keep = np.concatenate(keep)
                    i, j, corr = i[keep], j[keep], corr[keep]
                if len(i):
                    yield pa.RecordBatch.from_pydict({"channel": pa.array([c] * len(i), pa.string()), "tid": ids[j], "pos": pa.array(i + s, pa.int64()), "corr": corr})

    return blocks_.mapInArrow(run, "channel string, tid int, pos long, corr double")


def _united(parts: list[DataFrame], spark) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], "channel string, tid int, pos long, corr double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_sql(series: DataFrame, templates: DataFrame, m: int) -> DataFrame:
    """All correlations by window frames and a join on shifted positions: the plain form that others are held against.

    It makes a row for each sample and template point, so more than SQL_POINTS template points are an error.
    """
    if (templates.agg(F.sum(F.size("v"))).first()[0] or 0) > SQL_POINTS:
        raise ValueError("too many templates for the strategy sql")
    frame = W.partitionBy("channel").orderBy("pos").rowsBetween(0, m - 1)
    value = F.when(F.col("v") == kernels.SENTINEL, 0.0).otherwise(F.col("v").cast("double"))
    s = series.select("channel", "pos", "v", value.alias("x"))
    stats = s.select("channel", "pos", "v", F.avg("x").over(frame).alias("mu"), F.stddev_pop("x").over(frame).alias("sd"), F.count("*").over(frame).alias("c"))
    stats = stats.where((F.col("c") == m) & (F.col("sd") > kernels.TINY) & (F.col("v") != kernels.SENTINEL))
    own = ["channel"] if "channel" in templates.columns else []
    long = templates.where(F.size("v") == m).select(*own, "tid", F.posexplode(F.col("v").cast("array<double>")).alias("j", "q"))
    each = W.partitionBy(*own, "tid")
    z = long.select(*own, "tid", "j", ((F.col("q") - F.avg("q").over(each)) / F.stddev_pop("q").over(each)).alias("z"), F.stddev_pop("q").over(each).alias("qs")).where(F.col("qs") > kernels.TINY)
    z = z.select(*own, "tid", "j", "z")
    paired = s.join(z, own) if own else s.crossJoin(z)
    dots = paired.groupBy("channel", "tid", (F.col("pos") - F.col("j")).alias("pos")).agg(F.sum(F.col("z") * F.col("x")).alias("dot"), F.sum("z").alias("sz"))
    corr = (F.col("dot") - F.col("mu") * F.col("sz")) / (F.lit(float(m)) * F.col("sd"))
    return dots.join(stats, ["channel", "pos"]).select("channel", F.col("tid").cast("int").alias("tid"), "pos", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr)).alias("corr"))


def merged(hits: DataFrame, o: int, groups: list[str]) -> DataFrame:
    """Keeps a hit unless it lies within o of the last one kept. Hits more than o after their predecessor start islands that are folded alone."""
    key = ["channel", "tid", *groups]
    if o > 0:
        order = W.partitionBy(*key).orderBy("pos")
        new = F.coalesce((F.col("pos") - F.lag("pos").over(order) > o).cast("int"), F.lit(1))
        islands = hits.withColumn("__new", new).withColumn("__island", F.sum("__new").over(order))

        def fold(kept: Column, hit: Column) -> Column:
            near = (F.size(kept) > 0) & (hit["pos"] < F.element_at(kept, -1)["pos"] + o + 1)
            return F.when(near, kept).otherwise(F.concat(kept, F.array(hit)))

        run = F.array_sort(F.collect_list(F.struct("pos", "corr")))
        empty = F.array().cast("array<struct<pos:bigint,corr:double>>")
        hits = islands.groupBy(*key, "__island").agg(F.aggregate(run, empty, fold).alias("kept")).select(*key, F.inline("kept"))
    counter = F.row_number().over(W.partitionBy(*key).orderBy("pos")) - 1
    return hits.withColumn("counter", counter.cast("long"))


def threshold_search(series: DataFrame | Index, templates: DataFrame, m: int, t: float, o: int = 0, groups: int = 1, strategy: str = "auto", segments: int = 16, span: int = SPAN) -> DataFrame:
    """channel, tid, part, counter, pos, corr of all windows with correlation of t at least, merged by o within each of `groups` equal ranges of starts."""
    source, strategy, segments, span, ix = _prepared(series, m, strategy, segments, span)
    check(m, segments, t=t, o=o, groups=groups, strategy=strategy)
    bound = kernels.cc_to_ed(t, m)
    if strategy == "auto":
        from ..plans.planner import choose

        strategy = choose(source, templates, m, bound=bound, segments=segments, span=span)
    if strategy == "sql":
        hits = by_sql(samples(source), templates, m).where(F.col("corr") >= t)
    elif strategy == "index":
        ix = ix or index.build(source, m, segments, span)
        parts = [index.refined(ix, index.surviving(ix, *p, bound), p.ids, p.z, bound) for p in slices(templates, m)]
        hits = _united(parts, source.sparkSession)
    else:
        held = blocks(source, m, span)
        hits = _united([_matched(held, p, bound, strategy, segments, span) for p in slices(templates, m)], source.sparkSession)
    if groups > 1:
        last = F.max(F.col("start") + F.size("v")) if is_blocks(source) else F.max("pos") + 1
        length = source.groupBy("channel").agg(last.alias("__n"))
        width = F.greatest(F.lit(1), F.floor(F.col("__n") / groups))
        hits = hits.join(length, "channel").withColumn("part", F.least(F.lit(groups - 1), F.floor(F.col("pos") / width)).cast("int")).drop("__n")
    else:
        hits = hits.withColumn("part", F.lit(0))
    return merged(hits, o, ["part"]).select("channel", "tid", "part", "counter", "pos", "corr")


def _prepared(series: DataFrame | Index, m: int, strategy: str, segments: int, span: int):
    """The blocks or samples of a source, and what an index settles."""
    if not isinstance(series, index.Index):
        return series, strategy, segments, WHOLE if is_blocks(series) else span, None
    if series.m != m:
        raise ValueError(f"the index holds windows of {series.m} samples")
    return series.held, "index" if strategy == "auto" else strategy, series.segments, series.span, series


def excluded(ranked: DataFrame, k: int, o: int) -> DataFrame:
    """Walks candidates by (corr descending, pos) and keeps those o apart from all kept ones, k at most, as (rank, pos, corr)."""

    def fold(kept: Column, hit: Column) -> Column:
        clash = F.exists(kept, lambda y: F.abs(y["pos"] - hit["pos"]) < o)
        return F.when((F.size(kept) >= k) | clash, kept).otherwise(F.concat(kept, F.array(hit)))

    run = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("corr")).alias("d"), "pos", "corr"))), lambda x: F.struct(x["pos"].alias("pos"), x["corr"].alias("corr")))
    empty = F.array().cast("array<struct<pos:bigint,corr:double>>")
    kept = ranked.groupBy("channel", "tid").agg(F.aggregate(run, empty, fold).alias("kept"))
    return kept.select("channel", "tid", F.posexplode("kept").alias("k", "hit")).select("channel", "tid", (F.col("k") + 1).cast("long").alias("k"), "hit.pos", "hit.corr")


def candidate_limit(k: int, o: int) -> int:
    """Each kept window excludes 2o - 1 positions at most, so the k-th answer is among so many best windows."""
    return (k - 1) * max(1, 2 * o - 1) + 1


def _best(hits: DataFrame, n: int) -> DataFrame:
    order = W.partitionBy("channel", "tid").orderBy(F.desc("corr"), "pos")
    return hits.withColumn("k", F.row_number().over(order).cast("long")).where(F.col("k") <= n)


def _limits(apart: DataFrame, wanted: int, m: int) -> DataFrame:
    """channel, tid, ed: the distance of the last of so many separated windows; no row where there are fewer."""
    enough = apart.groupBy("channel", "tid").agg(F.count("*").alias("n"), F.min("corr").alias("corr")).where(F.col("n") == wanted)
    return enough.select("channel", "tid", (2.0 * m * (1 - F.col("corr")) + 1e-9).alias("ed"))


def knn_search(series: DataFrame | Index, templates: DataFrame, m: int, k: int, o: int = 0, strategy: str = "auto", segments: int = 16, span: int = SPAN, pad: bool = False) -> DataFrame:
    """channel, tid, k, pos, corr of the k nearest windows of each template, o apart.

    A first pass takes the best separated windows of each block; 2k - 1 of them that are o apart bound the
    k-th distance. A second pass keeps only windows within the bound, so later steps see few rows. Without an
    exclusion zone the first pass is the answer. With an index the first pass reads only each template's own leaf and
    the next ones by lower bound, as many as must hold 2k - 1 separated windows, the second only the leaves within the bound.
    """
    source, strategy, segments, span, ix = _prepared(series, m, strategy, segments, span)
    check(m, segments, k=k, o=o, strategy=strategy)
    if strategy == "auto":
        from ..plans.planner import choose

        strategy = choose(source, templates, m, bound=None, segments=segments, span=span, k=k)
    wanted = 2 * k - 1 if o else k
    if strategy == "sql":
        hits = by_sql(samples(source), templates, m)
    elif strategy == "index":
        ix = ix or index.build(source, m, segments, span)
        parts = []
        for part in slices(templates, m):
            ids, z, _ = part
            if not Switches.of(source.sparkSession).seed:
                parts.append(index.refined(ix, index.surviving(ix, *part, 4.0 * m), ids, z, 4.0 * m))
                continue
            seeds = index.refined(ix, index.seeded(ix, *part, candidate_limit(wanted, o)), ids, z, 4.0 * m)
            best = _best(seeds, candidate_limit(wanted, o))
            rows = _limits(excluded(best, wanted, o) if o else best.where(F.col("k") <= k), wanted, m).collect()  # a row for each template of a slice and channel
            limits = {(r["channel"], r["tid"]): r["ed"] for r in rows}
            parts.append(index.refined(ix, index.surviving(ix, *part, 4.0 * m, limits), ids, z, 4.0 * m, limits))
        hits = _united(parts, source.sparkSession)
    else:
        held = blocks(source, m, span)
        parts = []
        for part in slices(templates, m):
            seeds = _matched(held, part, 4.0 * m, "scan" if strategy == "sax" else strategy, segments, span, top=(wanted, o))
            seeds = _best(seeds, candidate_limit(wanted, o))
            if not o:  # the best k of each block hold the answer
                parts.append(seeds.select("channel", "tid", "pos", "corr"))
                continue
            parts.append(_matched(held, part, 4.0 * m, strategy, segments, span, limits=_limits(excluded(seeds, wanted, o), wanted, m)))
        hits = _united(parts, source.sparkSession)
    best = _best(hits, candidate_limit(k, o))
    out = (excluded(best, k, o) if o else best).select("channel", "tid", "k", "pos", "corr")
    if pad:
        names, tids = source.select("channel").distinct(), templates.drop("v").withColumn("tid", F.col("tid").cast("int"))
        slots = (names.join(tids, "channel") if "channel" in tids.columns else names.crossJoin(tids)).select("channel", "tid", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("k"))
        out = slots.join(out, ["channel", "tid", "k"], "left").select("channel", "tid", "k", "pos", "corr")
    return out
