"""b-bit MinHash near-duplicates: packed low bits of minima, banded candidates, collision-corrected estimates.

Documents with the same shingle set are one class, so exact copies meet in one aggregation and never form
pairs. A class has 128 minima. 32 bands of 4 whole minima put it into 32 buckets; the low 4 bits of all
minima are its packed signature of 64 bytes. Two classes of one bucket are candidates if the similarity
estimated from the equal nibbles, corrected for chance collisions, is not more than MARGIN (6 standard
deviations) under the wanted one; candidates are then confirmed on the full sets, worked out from the texts.

Buckets are not expanded into pairs. Buckets with equal members count once. Each class is first confirmed
against the bucket leader it shares most buckets with (a leader is the member with the fullest buckets, so the
original rather than one of its copies), and components are formed. Then only buckets that still hold several
components are searched: classes outside a bucket's largest component against all its members, in blocks of bounded
size, so one stray class costs a bucket one pass over its members. A first pass over packed signatures keeps the classes
with a candidate in another component, a second counts exact intersections of their full sets and returns only the
links that join components, fewer than its classes. What stays unchecked lies in one component already, so no
component is missed but by the bands: a pair at the limit misses all of them with probability under 1e-7.

Frequent buckets, leaders and labels are joined by broadcast (`common.met`: a thousand rows at most); a frequent
leader's text is dealt to one task for every PAIRS candidates. Intermediate tables are removed once read.

Rows are told apart by their sets, not ids: repeated rows and repeated ids are harmless. A null or empty
text, or one of separators only, has an empty set and is linked with nothing. A null doc_id never names a
component unless all ids of it are null. Texts may be of any length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MINIMA, ROWS, LOW_BITS, MARGIN = 128, 4, 4, 0.2
BANDS = MINIMA // ROWS
#: Members of a bucket that one task compares with each other at most.
BLOCK = 1000
#: Candidates that share one copy of their leader's text.
PAIRS = 500

_rng = np.random.default_rng(31337)
_A = _rng.integers(1, 2**63, MINIMA, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, MINIMA, dtype=np.int64).astype(np.uint64)


def minima(sets: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over one set."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(sets), 2048):
        x = (sets[lo : lo + 2048, None] ^ _B) * _A
        np.minimum(least, x.min(0), out=least)
    return least


def pack(least: np.ndarray) -> bytes:
    """The low bits of the minima, two to a byte. They are taken from the middle of the product, whose last bits are weak."""
    low = (least >> np.uint64(30)).astype(np.uint8) & 15
    return (low[::2] << 4 | low[1::2]).astype(np.uint8).tobytes()


def bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = common.mix(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return key.view(np.int64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a packed signature with each of several: the share of equal nibbles, less what chance makes equal."""
    x = many ^ one
    equal = np.count_nonzero((x & 0xF0) == 0, axis=-1) + np.count_nonzero((x & 0x0F) == 0, axis=-1)
    chance = 1 / (1 << LOW_BITS)
    return (equal / MINIMA - chance) / (1 - chance)


def _sets(part: pa.RecordBatch, column: str, size: int) -> list[np.ndarray]:
    data, offsets = common.utf8(part.column(column))
    out = []
    for lo, hi in common.blocks(offsets):
        hashed, _, _, by_row = common.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        out += common.shingles(hashed, by_row, size)
    return out


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, class (hash of the set, null if empty), n_shingles, packed signature and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                names, counts, packed, keys = [], [], [], []
                for s in _sets(part, "text", size):
                    counts.append(len(s))
                    if len(s):
                        least = minima(s)
                        names.append(hashlib.sha256(s.tobytes()).digest()[:16])
                        packed.append(pack(least))
                        keys.append(bands(least))
                    else:
                        names.append(None)
                        packed.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "text_key": pa.array([common.text_key(t) for t in part.column("text").to_pylist()], pa.string()),
                        "class": pa.array(names, pa.binary()),
                        "n_shingles": pa.array(counts, pa.int64()),
                        "packed": pa.array(packed, pa.binary()),
                        "bands": pa.array(keys, pa.list_(pa.int64())),
                    }
                )

    return common.texts(docs).mapInArrow(run, "doc_id long, text_key string, class binary, n_shingles long, packed binary, bands array<long>")


def _confirmed(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """Of stored candidate pairs (a, b), in which many share an a, those whose full sets reach the similarity."""
    counts = common.stored(pairs.groupBy("a").agg(F.count("*").alias("times")), "counts")
    shares = F.ceil(F.col("times") / PAIRS).cast("int")
    dealt = common.met(pairs, counts, "a", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), shares).cast("int").alias("share"))
    heads = counts.join(bodies.withColumnRenamed("class", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.col("text").alias("text_a"))
    both = dealt.join(bodies.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b").join(heads, ["a", "share"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                keep = []
                for x, y in zip(_sets(part, "text_a", size), _sets(part, "text_b", size), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """class, component (least class reachable) for all classes with a link: least labels spread along links and jump along labels."""
    both = common.stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    total = both.count()
    # times: links of the class, by which those of a frequent one are told
    labels = common.stored(both.groupBy(F.col("a").alias("class")).agg(F.least("class", F.min("b")).alias("component"), F.count("*").alias("times")), "labels")
    while True:
        told = common.met(both, labels.withColumnRenamed("class", "b"), "b", total).groupBy(F.col("a").alias("class")).agg(F.min("component").alias("told"))
        near = common.stored(labels.join(told, "class", "left").select("class", "component", "times", F.least("component", "told").alias("least")), "near")
        # a frequent label is looked up once, not by each of its classes
        asked = near.groupBy("least").agg(F.count("*").alias("rows"))
        of = labels.select(F.col("class").alias("least"), F.col("component").alias("jump"))
        jumps = common.stored(asked.join(of, "least", "left").select("least", F.least("least", "jump").alias("to"), F.col("rows").alias("times")), "jumps")
        moved = common.met(near.withColumnRenamed("times", "degree"), jumps, "least", total)
        fresh = common.stored(moved.select("class", F.col("to").alias("component"), F.col("degree").alias("times"), (F.col("to") < F.col("component")).alias("moved")), "labels")
        for table in (near, jumps, labels):
            common.dropped(table)
        labels = common.kept(fresh.drop("moved"), fresh)
        if fresh.where("moved").isEmpty():
            common.dropped(both)
            return common.kept(labels.drop("times"), fresh)


def _bodies(docs: DataFrame, signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and text of one document of each wanted class."""
    one = signed.join(wanted, "class").groupBy("class").agg(F.min("text_key").alias("text_key"))
    text = F.col("text")
    keyed = docs.select(F.col("text").cast("string").alias("text")).where(text.isNotNull()).withColumn("text_key", F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))
    return common.stored(keyed.join(one, "text_key").dropDuplicates(["text_key"]).select("class", "text"), "bodies")


def _near(group: pd.DataFrame, limit: float) -> pd.DataFrame:
    """The classes of a block pair that have a candidate in another component: outer classes against members."""
    group = group.sort_values(["outer", "class"], ignore_index=True)
    part, first = pd.factorize(group["component"])[0], int((~group["outer"]).sum())
    signs = np.frombuffer(b"".join(group["packed"]), np.uint8).reshape(len(group), -1)
    keep = np.zeros(len(group), bool)
    for k in range(first, len(group)):
        near = np.flatnonzero(part[:first] != part[k])
        near = near[estimate(signs[k], signs[near]) >= limit]
        keep[near] = True
        keep[k] = len(near) > 0
    return group.loc[keep, ["bucket", "i", "j", "outer", "class", "component"]]


def _joined(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links on full sets that join components: all intersections of the outer classes with the members."""
    group = group.sort_values(["outer", "class"], ignore_index=True)
    part, first = pd.factorize(group["component"])[0], int((~group["outer"]).sum())
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    distinct, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, column = owner[times[column] > 1], column[times[column] > 1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets) - first, first), np.float32)
    for lo in range(0, len(distinct), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        if a < b:
            _, local = np.unique(column[a:b], return_inverse=True)
            has = np.zeros((len(sets), local.max() + 1), np.float32)
            has[owner[a:b], local] = 1
            shared += has[first:] @ has[:first].T
    shared = shared.astype(np.int64)
    linked = 100 * shared >= percent * (sizes[first:, None] + sizes[None, :first] - shared)
    linked &= part[first:, None] != part[None, :first]
    root = list(range(part.max() + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b, names = [], [], group["class"].tolist()
    for x, y in zip(*(v.tolist() for v in np.nonzero(linked)), strict=True):
        p, q = find(int(part[first + x])), find(int(part[y]))
        if p != q:
            root[p] = q
            a.append(names[first + x])
            b.append(names[y])
    return pd.DataFrame({"a": a, "b": b}, dtype=object)


def _with_sets(bodies: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_pydict({"class": part.column("class"), "shingles": pa.array([s.tobytes() for s in _sets(part, "text", size)], pa.binary())})

    return bodies.mapInArrow(run, "class binary, shingles binary")


def classes(docs: DataFrame, size: int = 3, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """One row for each document (doc_id, text_key, class, n_shingles), and class, component for linked classes."""
    limit = percent / 100 - MARGIN
    signed = common.stored(_signed(docs, size), "signed")
    rows = signed.select("doc_id", "text_key", "class", "n_shingles")
    known = common.stored(signed.where("class is not null").groupBy("class").agg(F.first("packed").alias("packed"), F.first("bands").alias("bands")), "classes")
    placed = known.select("class", F.explode("bands").alias("bucket"))
    mark = F.xxhash64("class")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("s")).where("members > 1")
    shared = common.stored(shared.groupBy("members", "x", "s").agg(F.min("bucket").alias("bucket"), F.count("*").alias("weight")).select("bucket", F.col("members").alias("times"), "weight"), "shared")
    # adaptive execution may split this join, since nothing is aggregated behind it
    held = common.stored(placed.join(shared, "bucket").select("bucket", F.col("times").alias("members"), "weight", "class"), "buckets")
    total = held.count()
    central = held.groupBy("class").agg(F.sum(F.col("members") * F.col("weight")).alias("central"))
    leaders = held.join(central, "class").groupBy("bucket").agg(F.max(F.struct("central", "class")).alias("top"), F.count("*").alias("times"))
    leaders = common.stored(leaders.select("bucket", F.col("top.class").alias("leader"), "times"), "leaders")
    bodies = _bodies(docs, signed, central.select("class"))
    packed = known.join(central.select("class"), "class", "left_semi").select("class", "packed")

    led = common.met(held, leaders, "bucket", total).where("class <> leader").groupBy("class", "leader").agg(F.sum("weight").alias("weight"))
    best = common.stored(led.groupBy("class").agg(F.max_by("leader", F.struct("weight", "leader")).alias("leader")), "best")
    heads = best.groupBy("leader").agg(F.count("*").alias("times")).join(packed.select(F.col("class").alias("leader"), F.col("packed").alias("sign")), "leader")
    heads = common.stored(heads, "heads")
    first = common.met(best.join(packed, "class"), heads, "leader", best.count()).select("class", "leader", "packed", "sign")
    first = common.stored(_estimated(first, percent).select(F.col("leader").alias("a"), F.col("class").alias("b")), "pairs")
    links = common.stored(_confirmed(first, bodies, size, percent), "confirmed")
    found = components(links)

    # buckets that hold several components still
    named = held.join(found, "class", "left").select("bucket", "class", F.coalesce("component", "class").alias("component"))
    parts = named.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("times"))
    open_ = common.stored(parts.where("top.n < times").select("bucket", F.col("top.component").alias("major"), (F.col("times") - F.col("top.n")).alias("strays"), "times"), "open")
    left = common.met(named, open_, "bucket", total).join(packed, "class")
    strays, members = F.ceil(F.col("strays") / BLOCK).cast("int"), F.ceil(F.col("times") / BLOCK).cast("int")
    place = lambda blocks: F.pmod(F.xxhash64("class"), blocks).cast("int")
    row = ["class", "packed", "component"]
    dealt = left.select("bucket", F.explode(F.sequence(F.lit(0), strays - 1)).alias("i"), place(members).alias("j"), F.lit(False).alias("outer"), *row)
    dealt = dealt.unionByName(left.where("component <> major").select("bucket", place(strays).alias("i"), F.explode(F.sequence(F.lit(0), members - 1)).alias("j"), F.lit(True).alias("outer"), *row))
    near = dealt.groupBy("bucket", "i", "j").applyInPandas(lambda g: _near(g, limit), "bucket long, i int, j int, outer boolean, class binary, component binary")
    near = common.stored(near, "near")
    full = near.join(_with_sets(bodies.join(near.select("class").distinct(), "class", "left_semi"), size), "class")
    more = common.stored(full.groupBy("bucket", "i", "j").applyInPandas(lambda g: _joined(g, percent), "a binary, b binary").distinct(), "joined")
    if not more.isEmpty():
        before = found
        found = components(links.union(more))
        common.dropped(before)
    for table in (known, shared, held, leaders, bodies, best, heads, first, links, open_, near, more):
        common.dropped(table)
    return rows, found


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    limit = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("packed").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            y = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            yield batch.filter(pa.array(estimate(x, y) >= limit))

    return pairs.mapInArrow(run, pairs.schema)


def dedup(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    rows, found = classes(docs, size, percent)
    named = rows.select("class", "doc_id").where("class is not null").join(found, "class", "left").select("class", F.coalesce("component", "class").alias("component"), "doc_id")
    # pre-aggregated by class, so that a large group meets as one row a class
    heads = named.groupBy("component", "class").agg(F.min("doc_id").alias("least"))
    least = heads.groupBy("component").agg(F.min("least").alias("component_id"))
    of = heads.join(least, "component").select("class", "component_id")
    out = rows.join(of, "class", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == own)).alias("kept"))


def survivors(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: least doc_id (nulls last), then least digest of the text.

    Rows with an empty set all stay; of rows with the same doc_id and text that stays whose other columns are least as JSON.
    Columns may have any names.
    """
    rows, found = classes(docs, size, percent)
    id_, key = F.col("doc_id"), F.col("text_key")
    rank = F.struct(id_.isNull().alias("none"), id_.alias("id"), key.alias("key"))
    heads = rows.where("class is not null").groupBy("class").agg(F.min(rank).alias("head"))
    heads = heads.join(found, "class", "left").groupBy(F.coalesce("component", "class").alias("component")).agg(F.min("head").alias("head"))
    empty = rows.where("class is null").select(F.struct(id_.isNull().alias("none"), id_.alias("id"), key.alias("key")).alias("head"))
    keep = heads.select("head").union(empty).select(F.col("head.id").alias("keep_id"), F.col("head.key").alias("keep_key")).distinct()
    held = common.packed(docs)
    text, id_ = F.col("row.text").cast("string"), F.col("row.doc_id").cast("long")
    keyed = held.select("row", id_.alias("id"), F.when(text.isNull(), "null").otherwise(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32)).alias("key"))
    joined = keyed.join(keep, (F.col("key") == F.col("keep_key")) & F.col("id").eqNullSafe(F.col("keep_id")))
    rest = [F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    first = joined.groupBy("key", "id").agg(F.min_by("row", F.to_json(F.struct(*rest)) if rest else F.lit(0)).alias("row"))
    return common.unpacked(first, docs)
