"""The iSAX index: words of all windows, a tree of leaves over them, and the windows of each leaf.

``build`` writes three tables once: the blocks of samples, the leaves (region and number of windows, by channel), and
the postings (which windows of which block a leaf holds). Searches read the leaf table, keep the leaves that can
matter, and touch only the blocks and windows that those list. Words are counted before they meet; nodes with more
than GROUP distinct words are split by Spark with a few sums a node, smaller ones are finished in one group each, so
no group grows with the series. A node is split by one bit of the segment whose next breakpoint lies closest to its
mean, within three deviations if there is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import kernels
from ..sources.series import stored

#: Distinct words that one group may hold.
GROUP = 1 << 19
HITS = "channel string, tid int, pos long, corr double"


class Index(NamedTuple):
    """A series made ready for many searches with windows of m samples."""

    m: int
    segments: int
    span: int
    held: DataFrame  # channel, block, start, v
    nodes: DataFrame  # channel, leaf, root, prefix, bits, size
    postings: DataFrame  # leaf, channel, block, offsets


def summaries(held: DataFrame, m: int, segments: int = 16, span: int = 4096) -> DataFrame:
    """channel, block, pos, mu, sd, word of every window that may match; held: blocks of samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for channel, block, start, v in zip(*(batch.column(c) for c in ("channel", "block", "start", "v")), strict=True):
                x = v.values.to_numpy(zero_copy_only=False)[: span + m - 1]
                view, first = kernels.windows(x, m)
                if len(view):
                    mu, sd = kernels.statistics(view)
                    keep = np.flatnonzero(first & (sd > kernels.TINY))
                    words = kernels.placed_words(x, start.as_py(), m, sd, segments)[keep]
                    yield pa.RecordBatch.from_pydict(
                        {"channel": pa.array([channel.as_py()] * len(keep), pa.string()), "block": pa.array([block.as_py()] * len(keep), pa.int64()), "pos": keep + start.as_py(), "mu": mu[keep], "sd": sd[keep], "word": pa.array([w.tobytes() for w in words], pa.binary())}
                    )

    return held.mapInArrow(run, "channel string, block long, pos long, mu double, sd double, word binary")


def rooted(words: DataFrame, segments: int) -> DataFrame:
    """Adds root: the first bit of each symbol, first segment highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(segments - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            w = np.frombuffer(b"".join(batch.column("word").to_pylist()), np.uint8).reshape(-1, segments)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((w >> 7).astype(np.int64) @ weights)], [*batch.schema.names, "root"])

    return words.mapInArrow(run, words.schema.simpleString()[7:-1].replace(":", " ") + ", root long")


def worded(held: DataFrame, m: int, segments: int, span: int) -> DataFrame:
    """root, word, channel, block, offsets: the distinct words of a block and the windows that have them."""
    weights = 1 << np.arange(segments - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for channel, block, start, v in zip(*(batch.column(c) for c in ("channel", "block", "start", "v")), strict=True):
                x = v.values.to_numpy(zero_copy_only=False)[: span + m - 1]
                view, first = kernels.windows(x, m)
                if not len(view):
                    continue
                mu, sd = kernels.statistics(view)
                keep = np.flatnonzero(first & (sd > kernels.TINY))
                if not len(keep):
                    continue
                words, place = np.unique(kernels.placed_words(x, start.as_py(), m, sd, segments)[keep], axis=0, return_inverse=True)
                order = np.argsort(place.ravel(), kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(place.ravel()))])
                offsets = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keep[order], pa.int32()))
                n = len(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((words >> 7).astype(np.int64) @ weights), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([channel.as_py()] * n, pa.string()), pa.array([block.as_py()] * n, pa.int64()), offsets],
                    ["root", "word", "channel", "block", "offsets"],
                )

    return held.mapInArrow(run, "root long, word binary, channel string, block long, offsets array<int>")


def _edges() -> np.ndarray:
    return np.concatenate([[-4.0], kernels.breakpoints(), [4.0]])


def _values(words: np.ndarray) -> np.ndarray:
    """The middle of each symbol's interval."""
    edges = _edges()
    return (edges[words.astype(int)] + edges[words.astype(int) + 1]) / 2


def split_segment(word: np.ndarray, bits: np.ndarray, mean: np.ndarray, spread: np.ndarray, depth: int) -> int:
    """The segment by whose next bit a node is split. word: any word of the node."""
    step = np.where(bits < depth, bits, depth - 1)
    cut = _edges()[((word >> (8 - step)).astype(int) * 2 + 1) << (7 - step)]
    gap = np.where(bits < depth, np.abs(cut - mean), np.inf)
    within = gap <= 3 * spread
    return int(np.argmin(np.where(within, gap, np.inf) if within.any() else gap))


def _byte_array(column, segments: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, segments)


def _narrowed(counted: DataFrame, segments: int, leaf_size: int, depth: int) -> DataFrame:
    """Splits nodes until none has more than GROUP distinct words; one row of sums a node reaches a group."""
    key = ["root", "bits", "prefix"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, n = _byte_array(batch.column("word").to_pylist(), segments), batch.column("n").to_numpy(zero_copy_only=False)
            value = _values(w)
            frame = pd.DataFrame({k: batch.column(k).to_pylist() for k in key}).assign(at=np.arange(len(w)))
            for k, own in frame.groupby(key)["at"]:
                i = own.to_numpy()
                yield pa.RecordBatch.from_pydict({"root": [k[0]], "bits": [k[1]], "prefix": [k[2]], "word": [w[i[0]].tobytes()], "d": [len(i)], "n": [int(n[i].sum())], "s": [(value[i] * n[i, None]).sum(0).tolist()], "q": [(value[i] ** 2 * n[i, None]).sum(0).tolist()]})

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pick = []
            for word, bits, n, s, q in zip(f["word"], f["bits"], f["n"], f["s"], f["q"], strict=True):
                mean = np.array(s) / n
                spread = np.sqrt(np.maximum(np.array(q) / n - mean**2, 0))
                pick.append(split_segment(np.frombuffer(word, np.uint8), np.frombuffer(bits, np.uint8).astype(np.int64), mean, spread, depth))
            yield f[key].assign(segment=np.array(pick, np.int32))

    def refined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                w, b = _byte_array(f["word"], segments), _byte_array(f["bits"], segments).copy()
                some = np.flatnonzero(f["segment"].notna())
                b[some, f["segment"].to_numpy()[some].astype(int)] += 1
                yield pd.DataFrame({"root": f["root"], "word": f["word"], "n": f["n"], "bits": [x.tobytes() for x in b], "prefix": [x.tobytes() for x in (w >> (8 - b)).astype(np.uint8)]})

    schema = "root long, word binary, n long, bits binary, prefix binary"
    both = [F.array(*[F.sum(F.col(c)[i]) for i in range(segments)]).alias(c) for c in ("s", "q")]
    while True:
        per = counted.mapInArrow(sums, "root long, bits binary, prefix binary, word binary, d long, n long, s array<double>, q array<double>")
        full = per.groupBy(*key).agg(F.min("word").alias("word"), F.sum("d").alias("d"), F.sum("n").alias("n"), *both).where(F.col("d") > GROUP).where(F.col("n") > leaf_size)
        full = stored(full.mapInPandas(chosen, "root long, bits binary, prefix binary, segment int"), "full")  # a row for each GROUP words at most
        if full.isEmpty():
            return counted
        counted = stored(counted.join(full, key, "left").mapInPandas(refined, schema), "counted")


def assigned(words: DataFrame, segments: int, leaf_size: int = 2000, depth: int = 8) -> DataFrame:
    """root, word, n, prefix, bits: the leaf of every distinct word. words: root, word, n."""
    counted = words.groupBy("root", "word").agg(F.sum("n").alias("n"))
    one = F.lit(bytes([1] * segments))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(prefix=[x.tobytes() for x in _byte_array(f["word"], segments) >> 7])

    counted = stored(counted.withColumn("bits", one).mapInPandas(first, "root long, word binary, n long, bits binary, prefix binary"), "counted")
    total = counted.count()
    if total > GROUP:
        counted = _narrowed(counted, segments, leaf_size, depth)

    def split(w: np.ndarray, n: np.ndarray, at: np.ndarray, bits: np.ndarray, out: list) -> None:
        total = int(n.sum())
        if total <= leaf_size or (bits >= depth).all() or len(w) == 1:
            out.append((at, (w[0] >> (8 - bits)).astype(np.uint8).tobytes(), bits.astype(np.uint8).tobytes()))
            return
        value = _values(w)
        mean = (value * n[:, None]).sum(0) / total
        spread = np.sqrt(((value - mean) ** 2 * n[:, None]).sum(0) / total)
        s = split_segment(w[0], bits, mean, spread, depth)
        high = (w[:, s] >> (7 - bits[s]) & 1).astype(bool)
        bits = bits.copy()
        bits[s] += 1
        for side in (~high, high):
            if side.any():
                split(w[side], n[side], at[side], bits, out)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        prefix, bits = np.empty(len(group), object), np.empty(len(group), object)
        group = group.sort_values("word", ignore_index=True)
        w, n = _byte_array(group["word"], segments), group["n"].to_numpy()
        for (_, b, _), own in group.groupby(["root", "bits", "prefix"]).indices.items():
            out: list = []
            split(w[own], n[own], own, np.frombuffer(b, np.uint8).astype(np.int64), out)
            for at, p, q in out:
                prefix[at], bits[at] = p, q
        return pd.DataFrame({"root": group["root"], "word": group["word"], "n": group["n"], "prefix": prefix, "bits": bits})

    # many nodes share a call, since a call costs more than a small node
    buckets = max(8, -(-4 * total // GROUP))
    return counted.groupBy(F.pmod(F.xxhash64("root", "bits", "prefix"), F.lit(buckets)).alias("bucket")).applyInPandas(grow, "root long, word binary, n long, prefix binary, bits binary")


def leaves(words: DataFrame, segments: int, leaf_size: int = 2000, depth: int = 8) -> DataFrame:
    """root, prefix, bits, size of the leaves over the windows of words(word)."""
    found = assigned(rooted(words.groupBy("word").agg(F.count("*").alias("n")), segments), segments, leaf_size, depth)
    return found.groupBy("root", "prefix", "bits").agg(F.sum("n").alias("size"))


def build(source: DataFrame, m: int, segments: int = 16, span: int = 4096, leaf_size: int = 2000, depth: int = 8) -> Index:
    """Writes the index of a series, or of blocks of it, to the shared folder."""
    from .search import WHOLE, blocks, check, is_blocks

    check(m, segments, strategy="index")
    span = WHOLE if is_blocks(source) else span
    held = stored(blocks(source, m, span), "blocks")
    words = stored(worded(held, m, segments, span), "words")
    leaf = F.xxhash64("root", "prefix", "bits")
    of = stored(assigned(words.select("root", "word", F.size("offsets").cast("long").alias("n")), segments, leaf_size, depth).withColumn("leaf", leaf), "assigned")
    met = words.join(of.drop("n"), ["root", "word"])
    postings = met.groupBy("leaf", "channel", "block").agg(F.flatten(F.collect_list("offsets")).alias("offsets"), F.first("root").alias("root"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    postings = stored(postings.repartitionByRange("leaf").sortWithinPartitions("leaf"), "postings")
    nodes = stored(postings.groupBy("channel", "leaf", "root", "prefix", "bits").agg(F.sum(F.size("offsets")).alias("size")), "leaves")
    return Index(m, segments, span, held, nodes, postings.select("leaf", "channel", "block", "offsets"))


def tree_statistics(nodes: DataFrame, segments: int) -> DataFrame:
    """roots, leaves, height, windows, largest leaf, empty roots."""
    height = F.expr("aggregate(transform(sequence(1, length(bits)), i -> conv(hex(substring(bits, i, 1)), 16, 10)), 0, (s, x) -> s + cast(x as int))") - segments
    return nodes.agg(
        F.countDistinct("root").alias("roots"),
        F.count("*").alias("leaves"),
        F.max(height).cast("long").alias("height"),
        F.sum("size").alias("windows"),
        F.max("size").alias("largest"),
        (F.lit(float(2**segments)) - F.countDistinct("root")).cast("long").alias("empty_roots"),
    )


Limits = dict[tuple[str, int], float]


def _bounds_of(batch: pa.RecordBatch, means: np.ndarray, m: int, segments: int) -> np.ndarray:
    """Least squared distance of each template to each leaf of a batch."""
    edges = np.concatenate([[-np.inf], kernels.breakpoints(), [np.inf]])
    w = _byte_array(batch.column("prefix").to_pylist(), segments).astype(int)
    b = _byte_array(batch.column("bits").to_pylist(), segments).astype(int)
    low, high = edges[w << (8 - b)], edges[(w + 1) << (8 - b)]
    return np.stack([m / segments * (np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(1) for q in means])


def surviving(ix: Index, ids: np.ndarray, z: np.ndarray, channels: list[str] | None, bound: float, limits: Limits | None = None) -> DataFrame:
    """channel, leaf, at (places of templates in z): leaves that can hold a window within the bound, or within a template's limit in that channel."""
    good = np.flatnonzero(~np.isnan(z).any(1))
    means, m, segments = kernels.paa(z[good], ix.segments), ix.m, ix.segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                if not len(good):
                    continue
                least, names = _bounds_of(part, means, m, segments), part.column("channel").to_pylist()
                most = np.full(least.shape, bound) if limits is None else np.array([[limits.get((c, int(ids[g])), bound) for c in names] for g in good])
                live = least <= most * (1 + 1e-9) + 1e-6
                if channels is not None:
                    live &= np.array([[channels[g] == c for c in names] for g in good])
                keep = np.flatnonzero(live.any(0))
                if len(keep):
                    at = [good[np.flatnonzero(live[:, k])].tolist() for k in keep]
                    yield pa.RecordBatch.from_pydict({"channel": pa.array([names[k] for k in keep], pa.string()), "leaf": part.column("leaf").take(pa.array(keep)), "at": pa.array(at, pa.list_(pa.int32()))})

    return ix.nodes.mapInArrow(run, "channel string, leaf long, at array<int>")


def seeded(ix: Index, ids: np.ndarray, z: np.ndarray, channels: list[str] | None, windows: int) -> DataFrame:
    """channel, leaf, at: for each template and channel its own leaf and the next ones by lower bound, until they hold so many windows.

    Each task merges its leaves first and sends on no more than that takes.
    """
    good = np.flatnonzero(~np.isnan(z).any(1))
    means, m, segments = kernels.paa(z[good], ix.segments), ix.m, ix.segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, int], list] = {}
        for batch in batches:
            if not batch.num_rows or not len(good):
                continue
            least = _bounds_of(batch, means, m, segments)
            names, sizes, leaf = np.array(batch.column("channel").to_pylist(), object), batch.column("size").to_numpy(zero_copy_only=False), batch.column("leaf").to_numpy(zero_copy_only=False)
            for c in set(names.tolist()):
                own = np.flatnonzero(names == c)
                for g, row in zip(good.tolist(), least, strict=True):
                    if channels is None or channels[g] == c:
                        both = sorted([*best.get((c, g), ()), *zip(row[own].tolist(), leaf[own].tolist(), sizes[own].tolist(), strict=True)])
                        total = np.cumsum([x[2] for x in both])
                        best[c, g] = both[: int(np.searchsorted(total, windows)) + 1]
        rows = [(c, g, *x) for (c, g), own in best.items() for x in own]
        if rows:
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["channel", "at", "least", "leaf", "size"])

    found = ix.nodes.mapInArrow(run, "channel string, at int, least double, leaf long, size long")
    before = F.sum("size").over(W.partitionBy("channel", "at").orderBy("least", "leaf").rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < windows).groupBy("channel", "leaf").agg(F.collect_list("at").alias("at"))


def refined(ix: Index, chosen: DataFrame, ids: np.ndarray, z: np.ndarray, bound: float, limits: Limits | None = None) -> DataFrame:
    """channel, tid, pos, corr of the windows of chosen(channel, leaf, at) within the bound or limit; no other window is read."""
    m, span = ix.m, ix.span
    listed = ix.postings.join(chosen, ["channel", "leaf"]).groupBy("channel", "block").agg(F.collect_list(F.struct("offsets", "at")).alias("lists"))
    rows = ix.held.join(listed, ["channel", "block"]).select("channel", "start", "v", "lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for channel, start, v, lists in zip(*(batch.column(c) for c in ("channel", "start", "v", "lists")), strict=True):
                c, s = channel.as_py(), start.as_py()
                view, _ = kernels.windows(v.values.to_numpy(zero_copy_only=False)[: span + m - 1], m)
                wanted: dict[int, list] = {}
                for one in lists.as_py():
                    for g in one["at"]:
                        wanted.setdefault(g, []).append(one["offsets"])
                every = np.unique(np.concatenate([np.array(o) for own in wanted.values() for o in own]))
                mu, sd = kernels.statistics(view[every])
                for g, own in wanted.items():
                    at = np.searchsorted(every, np.sort(np.concatenate(own)))
                    most = bound if limits is None else limits.get((c, int(ids[g])), bound)
                    pos, corr = kernels.verified(view, every[at], mu[at], sd[at], z[g], most)
                    if len(pos):
                        yield pa.RecordBatch.from_pydict({"channel": pa.array([c] * len(pos), pa.string()), "tid": pa.array([int(ids[g])] * len(pos), pa.int32()), "pos": pa.array(pos + s, pa.int64()), "corr": corr})

    return rows.mapInArrow(run, HITS)
