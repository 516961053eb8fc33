"""Comparison of result sets, audits of inputs, and evaluation plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.series import with_positions


def compared(left: DataFrame, right: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """query, pos, corr of two result sets side by side, with a verdict for each pair."""
    a, b = left.select("query", "pos", F.col("corr").alias("corr_a")), right.select("query", "pos", F.col("corr").alias("corr_b"))
    verdict = F.when(F.col("corr_b").isNull(), "only_left").when(F.col("corr_a").isNull(), "only_right").when(F.abs(F.col("corr_a") - F.col("corr_b")) <= tolerance, "same").otherwise("different")
    return a.join(b, ["query", "pos"], "full").withColumn("verdict", verdict)


def comparison_summary(pairs: DataFrame) -> DataFrame:
    gap = F.abs(F.col("corr_a") - F.col("corr_b"))
    return pairs.groupBy("verdict").agg(F.count("*").alias("n"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def agreement(left: DataFrame, right: DataFrame, t: float, o: int, tolerance: float = 1e-4) -> DataFrame:
    """query, verdict of two threshold results: same, boundary or different.

    Only detections of one side are walked. They form chains of gaps up to o; a chain is explained if one of it lies
    within the tolerance of t, and a query is a boundary case if all its chains are.
    """
    key = ["query", "pos"]
    union = left.select(*key, "corr").join(right.select(*key, F.col("corr").alias("other")), key, "full")
    rows = union.select(*key, F.coalesce("corr", "other").alias("corr"), (F.col("corr").isNull() | F.col("other").isNull()).alias("odd"))
    order = W.partitionBy("query").orderBy("pos")
    odd = rows.where("odd").withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(order) > o).cast("int"), F.lit(1))).withColumn("chain", F.sum("new").over(order))
    chains = odd.groupBy("query", "chain").agg(F.min(F.abs(F.col("corr") - t)).alias("near"))
    worst = chains.groupBy("query").agg(F.max("near").alias("near"))
    verdict = F.when(F.col("near").isNull(), "same").when(F.col("near") < tolerance, "boundary").otherwise("different")
    return rows.select("query").distinct().join(worst, "query", "left").select("query", verdict.alias("verdict"))


def neighbour_agreement(left: DataFrame, right: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """query, verdict of two neighbour results (query, k, pos, corr): same, tie (other positions at equal correlations) or different."""
    both = left.join(right.select("query", "k", F.col("pos").alias("other"), F.col("corr").alias("other_corr")), ["query", "k"], "full")
    state = F.when(F.col("pos") == F.col("other"), 0).when(F.abs(F.col("corr") - F.col("other_corr")) < tolerance, 1).otherwise(2)
    worst = both.groupBy("query").agg(F.max(state).alias("s"))
    return worst.select("query", F.when(F.col("s") == 0, "same").when(F.col("s") == 1, "tie").otherwise("different").alias("verdict"))


def matched_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """run_id, mode, status of the runs (run_id, mode) of two result folders: matched, other_mode, only_left or only_right."""
    both = left.select("run_id", F.col("mode").alias("a")).join(right.select("run_id", F.col("mode").alias("b")), "run_id", "full")
    status = F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right").when(F.col("a") != F.col("b"), "other_mode").otherwise("matched")
    return both.select("run_id", F.coalesce("a", "b").alias("mode"), status.alias("status"))


def set_relations(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: sizes of the union and the intersection of two sets of rows, and whether the sets are equal."""
    marked = left.distinct().withColumn("side", F.lit(1)).unionByName(right.distinct().withColumn("side", F.lit(2)))
    sides = marked.groupBy(*left.columns).agg(F.sum("side").alias("side"))
    return sides.agg(F.count("*").alias("in_union"), F.count_if(F.col("side") == 3).alias("in_both"), F.coalesce(F.bool_and(F.col("side") == 3), F.lit(True)).alias("equal"))


def slowest(timings: DataFrame) -> DataFrame:
    """run, index_time, query_time: a run takes as long as its slowest rank."""
    return timings.groupBy("run").agg(F.max("index_time").alias("index_time"), F.max("query_time").alias("query_time"), F.count("*").alias("ranks"))


def tolerant_matches(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Greedy nearest unused matches within `reach` positions. Hits more than reach apart from all others form groups of their own."""
    both = left.select("query", "pos", F.lit(0).alias("side")).unionByName(right.select("query", "pos", F.lit(1).alias("side")))
    order = W.partitionBy("query").orderBy("pos", "side")
    marked = both.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(order) > reach).cast("int"), F.lit(1))).withColumn("chain", F.sum("new").over(order))

    def match(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (query, _), own in group.groupby(["query", "chain"]):
            free = sorted(own.loc[own["side"] == 1, "pos"])
            for p in sorted(own.loc[own["side"] == 0, "pos"]):
                best = min(free, key=lambda q: (abs(q - p), q), default=None)
                if best is not None and abs(best - p) <= reach:
                    free.remove(best)
                    out.append((query, p, best))
        return pd.DataFrame(out, columns=["query", "pos", "other"])

    # many chains share a call, since a call costs more than a chain
    return marked.groupBy("query", F.floor(F.col("chain") / 512).alias("run")).applyInPandas(match, "query int, pos long, other long")


def digest(results: DataFrame) -> DataFrame:
    """One order-free digest of each query's positions."""
    return results.groupBy("query").agg(F.md5(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("pos")), lambda x: x.cast("string")))).alias("digest"))


def lint(neighbours: DataFrame, k: int) -> DataFrame:
    """tid, issues of neighbour lists that are incomplete, out of order, repeated or out of range."""
    seen = neighbours.groupBy("tid").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("corr").alias("a"), F.max("corr").alias("b"))
    return seen.select("tid", _reasons(rows=F.col("n") != k, ranks=(F.col("lo") != 1) | (F.col("hi") != k), positions=F.col("d") != F.col("n"), range=(F.col("a") < -1.0002) | (F.col("b") > 1.0002)).alias("issues"))


def _reasons(**tests: Column) -> Column:
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def audited(queries: DataFrame, waves: DataFrame, query_sidecars: DataFrame, wave_sidecars: DataFrame, segments: int = 16, divisor: int = 4, version: int = 2) -> DataFrame:
    """path, key, reasons, valid: why a template file can't be run with the waveform of its key.

    queries(path, key, count, window, floats, rest), waves(key, samples), and sidecars by path and by key
    (version, rate, bad: non-finite samples). rest: bytes beyond whole floats.
    """
    q = query_sidecars.select("path", F.col("version").alias("qv"), F.col("rate").alias("qr"), F.col("bad").alias("qb"))
    w = wave_sidecars.select("key", F.col("version").alias("wv"), F.col("rate").alias("wr"), F.col("bad").alias("wb"))
    joined = queries.join(waves.select("key", "samples"), "key", "left").join(q, "path", "left").join(w, "key", "left")
    m = F.col("window")
    told = F.col("qv").isNotNull() & F.col("wv").isNotNull()
    reasons = _reasons(
        nonpositive=(F.col("count") <= 0) | (m <= 0),
        remainder=F.col("rest") != 0,
        query_floats=F.col("floats") != F.col("count") * m,
        window_multiple=F.pmod(m, F.lit(8)) != 0,
        window_segments=F.pmod(m, F.lit(segments)) != 0,
        merge_offset=F.floor(m / divisor) <= 0,
        no_waveform=F.col("samples").isNull(),
        short_waveform=F.col("samples") < m,
        no_metadata=~told,
        obsolete=told & ((F.col("qv") != version) | (F.col("wv") != version)),
        sampling_rate=told & (F.col("qr") != F.col("wr")),
        not_finite=told & ((F.col("qb") > 0) | (F.col("wb") > 0)),
    )
    return joined.select("path", "key", reasons.alias("reasons"), (F.size(reasons) == 0).alias("valid"))


def evenly_spaced(cases: DataFrame, count: int, size: str = "samples", key: str = "key", least: int = 0) -> DataFrame:
    """`count` cases of at least so many samples at evenly spaced ranks by size; all if count is 0 or too large, the middle one if it is 1."""
    eligible = cases.where(F.col(size) >= least)
    n = eligible.count()
    if count <= 0 or count >= n:
        return eligible
    ranks = [n // 2] if count == 1 else sorted({round(i * (n - 1) / (count - 1)) for i in range(count)})
    spots = cases.sparkSession.createDataFrame([(r,) for r in ranks], "pos long")
    return with_positions(eligible, [size, key]).join(F.broadcast(spots), "pos").select(*cases.columns)  # the caller's count of rows


def sampled(templates: DataFrame, limit: int, seed: int) -> DataFrame:
    """A reproducible sample: the least digests of seed and id."""
    return templates.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "tid")), "tid").limit(limit)


def case_seed(seed: int, dataset: Column, case: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), dataset, case), 256)


def batches(plan: DataFrame, size: int, by: list[str], order: list[str]) -> DataFrame:
    """Numbers the rows of each group of a plan and packs them into batches."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return plan.withColumn("row", n.cast("long")).withColumn("batch", F.floor((n - 1) / size).cast("long"))


def plan(cases: DataFrame, nodes: list[int], values: list[float]) -> DataFrame:
    """Every case with every node count and parameter value, with a run id. The parameter lists are the caller's few literals."""
    crossed = cases.withColumn("nodes", F.explode(F.array(*map(F.lit, nodes)))).withColumn("value", F.explode(F.array(*map(F.lit, values))))
    return crossed.withColumn("run_id", F.concat_ws("__", "key", F.concat(F.lit("n"), F.col("nodes")), F.concat(F.lit("v"), F.col("value"))))


def run_limits(cases: DataFrame, nodes: list[int], most: int) -> DataFrame:
    """For each node count: samples of the largest share, and how many cases fit."""
    local = F.ceil(F.col("samples") / F.col("nodes"))
    crossed = cases.withColumn("nodes", F.explode(F.array(*map(F.lit, nodes))))
    return crossed.groupBy("nodes").agg(F.max(local).cast("long").alias("largest"), F.count_if(local <= most).cast("long").alias("fitting"), F.count("*").alias("cases"))
