"""Benchmark decontamination by greedy string tiling.

Words of documents and items are compared by 64-bit hashes. Runs of SEED words that a document shares with an
item are seeds; a document without seeds is clean at once. For each document and item that share seeds, tiling
repeatedly marks the longest match of unmarked words, found by running Karp-Rabin hashes over ever shorter
lengths, until none of LEAST words is left. The tiles do not overlap, whatever their order, so an item whose
sentences were moved around is covered like one copied whole. A document is contaminated if the share of some
item's words in tiles reaches COVER.

The benchmark is taken in blocks of at most BLOCK bytes of text, each sent to all tasks; a larger benchmark
makes more passes over the documents, never a larger broadcast (an item is not divided: one longer than BLOCK is a
block). Items with fewer than LEAST words must occur whole. Equal coverage goes to the least item_id (nulls last),
then to fewer tiles, whatever the blocks. Null and empty texts are clean; null or wordless items match nothing; of
repeated item_ids each text counts. Words are lowered A-Z and stripped of punctuation. Columns may have any names.
Rows are independent: repeated rows give repeated results, an empty table or benchmark gives no contamination.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from . import common

SEED, LEAST, COVER, BLOCK = 4, 5, 0.5, 8 << 20
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
#: Punctuation counts as a separator, so that a passage is known whatever stands beside it.
_BREAK = np.arange(256, dtype=np.uint8)
_BREAK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = common.utf8(column)
    hashed, by_row = [], [np.zeros(1, np.int64)]
    total = 0
    for lo, hi in common.blocks(offsets):
        h, _, _, rows = common.words(_BREAK[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo])
        hashed.append(h)
        by_row.append(rows[1:] + total)
        total += len(h)
    return np.concatenate(hashed) if hashed else np.zeros(0, np.uint64), np.concatenate(by_row)


def runs(hashed: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of `size` words."""
    if size <= 0 or len(hashed) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashed) - size + 1, np.uint64)
    for k in range(size):
        out = out * _MULTIPLIER + hashed[k : len(hashed) - size + 1 + k]
    return out


def _prefix(hashed: np.ndarray) -> np.ndarray:
    total, out = 0, [0]
    for h in hashed.tolist():
        total = (total * int(_MULTIPLIER) + h) & 0xFFFFFFFFFFFFFFFF
        out.append(total)
    return np.array(out, np.uint64)


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of `size` unmarked words."""
    if len(marked) < size:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[size:] == total[:-size])


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in item, start in document, length) of the matches marked, longest first."""
    n, m = len(item), len(doc)
    if not n or not m:
        return []
    least = min(least, n)
    own, other = _prefix(item), _prefix(doc)
    power = common.powers(n + 1, int(_MULTIPLIER))
    marked_i, marked_d = np.zeros(n, np.int8), np.zeros(m, np.int8)
    out = []

    def common_at(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = _free(marked_i, size), _free(marked_d, size)
        x, y = own[a + size] - own[a] * power[size], other[b + size] - other[b] * power[size]
        return a, b, x, y

    high = min(n, m)
    while high >= least:
        lo, hi = least - 1, high  # the longest length that still matches: matches of one length contain those of all shorter ones
        while lo < hi:
            mid = (lo + hi + 1) // 2
            a, b, x, y = common_at(mid)
            if len(x) and len(y) and np.isin(x, y).any():
                lo = mid
            else:
                hi = mid - 1
        if lo < least:
            break
        a, b, x, y = common_at(lo)
        places: dict[int, list[int]] = {}
        for p, h in zip(b.tolist(), y.tolist(), strict=True):
            places.setdefault(h, []).append(p)
        for p, h in zip(a.tolist(), x.tolist(), strict=True):
            if marked_i[p : p + lo].any():
                continue
            for q in places.get(h, ()):
                if not marked_d[q : q + lo].any() and np.array_equal(item[p : p + lo], doc[q : q + lo]):
                    marked_i[p : p + lo] = marked_d[q : q + lo] = 1
                    out.append((p, q, lo))
                    break
        high = lo - 1  # every match of this length that does not overlap a marked one is marked now
    return out


class Items:
    """A block of the benchmark, ready for lookups."""

    def __init__(self, ids: list, texts: list[str | None]):
        hashed, by_row = word_hashes(pa.array(texts, pa.string()))
        self.ids, self.words = ids, [hashed[a:b] for a, b in zip(by_row[:-1], by_row[1:], strict=True)]
        keys, owners, short = [], [], []
        for k, w in enumerate(self.words):
            if len(w) >= SEED:
                own = np.unique(common.mix(runs(w, SEED)))
                keys.append(own)
                owners.append(np.full(len(own), k))
            elif len(w):
                short.append(k)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners, self.short = keys[order], owners[order], short
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def seeds(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run of SEED words starts that is some item's, and its hash."""
        run = common.mix(runs(hashed, SEED)) if len(hashed) >= SEED else np.zeros(0, np.uint64)
        place = np.flatnonzero(self.bits[(run >> np.uint64(42)).astype(np.int64)])
        if len(place) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, run[place]), len(self.keys) - 1)
            place = place[self.keys[at] == run[place]]
        return place, run[place]

    def best(self, doc: np.ndarray, place: np.ndarray, run: np.ndarray) -> tuple[float, object, int]:
        """Most covered item of a document with these seeds: coverage, item id, tiles. Ties go to the least id."""
        found = []
        lo, hi = np.searchsorted(self.keys, run, "left"), np.searchsorted(self.keys, run, "right")
        by_item: dict[int, list[int]] = {}
        for p, a, b in zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for k in self.owners[a:b].tolist():
                by_item.setdefault(k, []).append(p)
        for k, at in by_item.items():
            item = self.words[k]
            near = np.zeros(len(doc) + 1, np.int32)  # only words near seeds can be in tiles
            np.add.at(near, np.maximum(np.array(at) - LEAST, 0), 1)
            np.add.at(near, np.minimum(np.array(at) + SEED + LEAST, len(doc)), -1)
            inside = np.cumsum(near[:-1]) > 0
            part = doc.copy()
            gaps = np.flatnonzero(~inside)
            part[gaps] = common.mix(gaps.astype(np.uint64))  # words that match nothing
            keep = inside | np.concatenate([[False], inside[:-1]])
            got = tiles(item, part[keep])
            found.append((sum(t[2] for t in got) / len(item), self.ids[k], len(got)))
        for k in self.short:
            item = self.words[k]
            if np.isin(runs(doc, len(item)), runs(item, len(item))).any():
                found.append((1.0, self.ids[k], 1))
        return max((f for f in found if f[0]), key=lambda f: (f[0], f[1] is not None, -(f[1] or 0), -f[2]), default=(0.0, None, 0))


def _tiled(rows: DataFrame, block: Items, text: int) -> DataFrame:
    """rows(row, best): best becomes the most covered item of this block. text: which field of row is the text."""
    held = rows.sparkSession.sparkContext.broadcast(block)  # at most BLOCK bytes of text and its hashes
    kinds = [pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                hashed, by_row = word_hashes(pc.struct_field(part.column("row"), [text]))
                place, seed = items.seeds(hashed)
                a, b = np.searchsorted(place, by_row[:-1]), np.searchsorted(place, by_row[1:] - (SEED - 1))
                out = []
                for r in range(part.num_rows):
                    if a[r] < b[r] or items.short:
                        own = slice(a[r], max(a[r], b[r]))
                        out.append(items.best(hashed[by_row[r] : by_row[r + 1]], place[own] - by_row[r], seed[own]))
                    else:
                        out.append((0.0, None, 0))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], [*part.schema.names, *_FOUND])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("coverage", DoubleType()).add("item", LongType()).add("tiles", LongType()))


_FOUND = ["coverage", "item", "tiles"]


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-2 * size // BLOCK)
    if count <= 1:
        parts = [rows.orderBy("item_id", "text")] if size else []
    else:
        key = F.pmod(F.xxhash64("text"), F.lit(count))
        parts = [rows.where(key == k).orderBy("item_id", "text") for k in range(count)]
    for part in parts:
        got = part.collect()
        if got:
            yield Items([r.item_id for r in got], [r.text for r in got])


def covered(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row (the columns of docs), coverage, item and tiles of the most covered item over all blocks."""
    out, text = common.packed(docs), docs.columns.index("text")
    least = [F.lit(0.0).alias("coverage"), F.lit(None).cast("long").alias("item"), F.lit(0).cast("long").alias("tiles")]
    before = F.struct(*least)
    for block in _blocks(benchmark):
        more = _tiled(out.select("row", before.alias("before")), block, text)
        # the rule of Items.best, over blocks
        rank = lambda s: F.struct(s("coverage"), s("item").isNotNull(), -F.coalesce(s("item"), F.lit(0)), -s("tiles"))
        better = rank(F.col) > rank(lambda n: F.col(f"before.{n}"))
        out = more.select("row", *[F.when(better, F.col(n)).otherwise(F.col(f"before.{n}")).alias(n) for n in _FOUND])
        before = F.struct(*_FOUND)
    return out if "coverage" in out.columns else out.select("row", *least)


def scan(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, contaminated, item_id (most covered), coverage, n_tiles."""
    out = covered(common.texts(docs), benchmark)
    return out.select("row.doc_id", (F.col("coverage") >= cover).alias("contaminated"), F.col("item").alias("item_id"), "coverage", F.col("tiles").alias("n_tiles"))


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """docs without contaminated rows; columns stay."""
    return common.unpacked(covered(docs, benchmark).where(F.col("coverage") < cover), docs)
