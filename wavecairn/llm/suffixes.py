"""Suffix-array deduplication by induced sorting.

``suffix_array`` classifies suffixes, sorts leftmost-smaller (LMS) substrings by induction, names them, sorts
the string of names recursively, and induces the order of all suffixes from that of the LMS ones. The top
level, over bytes, works bucket by bucket on whole arrays; the deeper levels, over names, are at most half as
long and run as plain loops. ``permuted_lcp`` computes common prefixes in text order: only irreducible
positions are compared, the others follow from their left neighbour.

To spread the work, every window of PASSAGE bytes is represented by its anchor, the k-mer of least hash in it,
which depends on the window's bytes only. An anchor that occurs at one place only rules its windows out. All
windows of another go, with the bytes that follow them up to 400, to the shard of the anchor's first occurrence, a
piece of text called its leader, so equal windows always meet, and neighbouring anchors mostly share a leader. An
anchor that occurs over MANY times has a shard of its own instead, so that a large group of near copies is split by
its places. Pieces with equal bytes enter a shard's suffix array once, with their count. A string is a repeat if its
suffix shares its bytes with a neighbour in the array, or its piece is one of several. Repeats of 400 bytes are
removed; runs covered by repeats of PASSAGE bytes (fifty words or so) are counted as passages.

Matches never cross documents; texts are bytes of UTF-8, null is empty. Documents are told apart by text and
number of rows, so repeated rows count as repeats of each other whatever their ids. Texts under 400 bytes lose
nothing. An empty table gives an empty result.
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

LENGTH, PASSAGE, KMER, SLICE = 400, 300, 100, 1 << 21
#: Bytes that a shard is meant to hold, and bytes of a leader's text that its followers come to one shard for.
SHARD, LEAD = 2 << 20, 4096
#: Occurrences beyond which an anchor has a shard of its own.
MANY = 2048
INVERSE = pow(common._BASE, -1, 2**64)


# ---- induced sorting -----------------------------------------------------------------------------


def _is_small(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the end is smaller than all."""
    n = len(text)
    small = np.zeros(n, bool)
    if n > 1:
        change = np.flatnonzero(text[1:] != text[:-1])
        run = np.zeros(n, bool)
        run[change] = text[change] < text[change + 1]
        lengths = np.diff(np.concatenate([[-1], change, [n - 1]]))
        small = np.repeat(np.append(run[change], False), lengths)
    return small


def _spread(place: np.ndarray, letters: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends positions to the lists of their letters, in order."""
    if len(place):
        order = np.argsort(letters, kind="stable")
        place, letters = place[order], letters[order]
        cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        lo = 0
        for hi in [*cuts.tolist(), len(place)]:
            into[letters[lo]].append(place[lo:hi])
            lo = hi


def _chain(wave: np.ndarray, c: int, coded: np.ndarray, kind: int, into: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Scans a bucket's own entries: predecessors of the wanted type join this bucket's end or another bucket."""
    seen = []
    while len(wave):
        seen.append(wave)
        before = wave[wave > 0] - 1
        code = coded[before]
        fits = (code >> 8) == kind
        before, letter = before[fits], (code[fits] & 255).astype(np.uint8)
        same = letter == c
        wave = before[same]
        _spread(before[~same], letter[~same], into)
    return seen


def _induce(n: int, coded: np.ndarray, lms: list[np.ndarray]) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes of each letter in order. coded: letter, plus 256 for the smaller type."""
    none = np.zeros(0, np.int32)
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[coded[n - 1] & 255].append(np.array([n - 1], np.int32))
    full: list[np.ndarray] = []
    for c in range(256):
        seen = _chain(np.concatenate(large[c]), c, coded, 0, large) if large[c] else []
        full.append(np.concatenate(seen) if seen else none)
        if len(lms[c]):
            _chain_once(lms[c], coded, 0, large)
    small: list[list[np.ndarray]] = [[] for _ in range(256)]
    parts = []
    for c in range(255, -1, -1):
        seen = _chain(np.concatenate(small[c]), c, coded, 1, small) if small[c] else []
        if len(full[c]):
            _chain_once(full[c][::-1], coded, 1, small)
        if seen:
            parts.append(np.concatenate(seen)[::-1])
        parts.append(full[c])
    return np.concatenate(parts[::-1])


def _chain_once(wave: np.ndarray, coded: np.ndarray, kind: int, into: list[list[np.ndarray]]) -> None:
    before = wave[wave > 0] - 1
    code = coded[before]
    fits = (code >> 8) == kind
    _spread(before[fits], (code[fits] & 255).astype(np.uint8), into)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a byte array in order."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _is_small(text)
    coded = text.astype(np.int16) + (small.astype(np.int16) << 8)
    first = small.copy()
    first[0] = False
    first[1:] &= ~small[:-1]
    lms = np.flatnonzero(first).astype(np.int32)

    def by_letter(order: np.ndarray) -> list[np.ndarray]:
        letters = text[order]
        cuts = np.searchsorted(letters, np.arange(257))
        return [order[cuts[c] : cuts[c + 1]] for c in range(256)]

    if len(lms) < 2:
        return _induce(n, coded, by_letter(lms))
    rough = _induce(n, coded, by_letter(lms[np.argsort(text[lms], kind="stable")]))
    rough = rough[first[rough]]
    span = np.zeros(n, np.int32)
    span[lms[:-1]] = np.diff(lms) + 1  # to the next LMS suffix, its letter included; 0 for the last, which is like no other
    a, b = rough[:-1], rough[1:]
    equal = (span[a] == span[b]) & (span[a] > 0)
    live = np.flatnonzero(equal)
    k = 0
    while len(live) and k < 64:
        live = live[span[a[live]] > k]
        other = text[a[live] + k] != text[b[live] + k]
        equal[live[other]] = False
        live = live[~other]
        k += 1
    for j in live.tolist():
        equal[j] = np.array_equal(text[a[j] : a[j] + span[a[j]]], text[b[j] : b[j] + span[b[j]]])
    names = np.zeros(n, np.int32)
    names[rough] = np.concatenate([[0], np.cumsum(~equal)])
    if not equal.any():
        return _induce(n, coded, by_letter(rough))
    order = np.array(_sort_names(names[lms].tolist()), np.int64)
    return _induce(n, coded, by_letter(lms[order]))


def _sort_names(s: list[int]) -> list[int]:
    """The same induction for integers, one at a time; the end of the list is smaller than all."""
    n = len(s)
    if n < 2:
        return list(range(n))
    small = bytearray(n)
    for i in range(n - 2, -1, -1):
        x, y = s[i], s[i + 1]
        if x < y or x == y and small[i + 1]:
            small[i] = 1
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    size = max(s) + 1
    count = [0] * (size + 1)
    for x in s:
        count[x + 1] += 1
    for c in range(size):
        count[c + 1] += count[c]

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = count[1:]
        for i in reversed(order):
            c = s[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = count[:]
        c = s[n - 1]
        sa[head[c]] = n - 1
        head[c] += 1
        for r in range(n):
            i = sa[r] - 1
            if i >= 0 and not small[i]:
                c = s[i]
                sa[head[c]] = i
                head[c] += 1
        tail = count[1:]
        for r in range(n - 1, -1, -1):
            i = sa[r] - 1
            if i >= 0 and small[i]:
                c = s[i]
                tail[c] -= 1
                sa[tail[c]] = i
        return sa

    if len(lms) < 2:
        return induce(lms)
    rough = [i for i in induce(lms) if i and small[i] and not small[i - 1]]
    after = {x: y for x, y in zip(lms, lms[1:], strict=False)}
    name, names, last = -1, [0] * n, None
    for i in rough:
        end = after.get(i)
        own = s[i : end + 1] if end is not None else None
        if own is None or own != last:
            name += 1
        names[i], last = name, own
    if name + 1 == len(lms):
        return induce(rough)
    return induce([lms[r] for r in _sort_names([names[i] for i in lms])])


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the bytes shared with the suffix before its own in the array, and with the one after it."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n, dtype=np.int64)
    derived = (before > 0) & (here > 0)
    derived[derived] = text[here[derived] - 1] == text[before[derived] - 1]
    root = np.flatnonzero(~derived)
    shared = np.zeros(len(root), np.int64)
    live = np.flatnonzero(before[root] >= 0)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded, 0, (1,))
    k = 0
    while len(live) and k < 2048:
        i, j = root[live], before[root[live]]
        room = n - np.maximum(i, j)
        x = words[np.minimum(i + k, n)] ^ words[np.minimum(j + k, n)]
        low = x & (~x + np.uint64(1))
        more = (x == 0) & (room > k + 8)
        done = ~more
        step = np.where(x[done] == 0, 8, np.log2(np.maximum(low[done], 1).astype(np.float64)).astype(np.int64) >> 3)
        shared[live[done]] = np.minimum(k + step, room[done])
        live = live[more]
        k += 8
    for r in live.tolist():
        i, j = int(root[r]), int(before[root[r]])
        at, room = k, n - max(i, j)
        while at < room:
            m = min(1 << 16, room - at)
            other = np.flatnonzero(text[i + at : i + at + m] != text[j + at : j + at + m])
            if len(other):
                at += int(other[0])
                break
            at += m
        shared[r] = at
    lengths = np.diff(np.append(root, n))
    ahead = np.repeat(shared, lengths) - (here - np.repeat(root, lengths))
    behind = np.zeros(n, np.int64)
    behind[sa[:-1]] = ahead[sa[1:]]
    return ahead, behind


def repeats(pieces: list[bytes], several: list[bool], *lengths: int) -> list[list[list[tuple[int, int]]]]:
    """For each length, maximal runs of bytes of each piece that are covered by repeated strings of this length."""
    if not pieces:
        return [[] for _ in lengths]
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    ahead, behind = permuted_lcp(text, suffix_array(text))
    room = np.repeat(start + sizes, sizes + 1) - np.arange(len(text))
    shared = np.minimum(np.where(np.repeat(np.array(several, bool), sizes + 1), room, np.maximum(ahead, behind)), room)
    out: list[list[list[tuple[int, int]]]] = [[[] for _ in pieces] for _ in lengths]
    for found, length in zip(out, lengths, strict=True):
        place = np.flatnonzero(shared >= length)
        if len(place):
            owner = np.searchsorted(start, place, "right") - 1
            cut = np.flatnonzero((place[1:] > place[:-1] + length) | (owner[1:] != owner[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
                k = int(owner[lo])
                found[k].append((int(place[lo] - start[k]), int(place[hi - 1] - start[k]) + length))
    return out


# ---- anchors -------------------------------------------------------------------------------------


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of `width` keys, from running minima of blocks in both directions."""
    m = len(keys)
    full = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:m] = keys
    block = full.reshape(-1, width)
    right = np.minimum.accumulate(block, axis=1).ravel()
    left = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: m - width + 1], right[width - 1 : m])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row with a window: row, and for each of its anchors hash, place, first window, last window.

    The rows' bytes come in slices that overlap by a window, so that long texts need no more memory than short ones.
    """
    for lo, hi in common.blocks(offsets, SLICE):
        a, b = int(offsets[lo]), int(offsets[hi])
        for s in range(a, max(a + 1, b - length + 1), SLICE):
            part = data[s : min(b, s + SLICE + length - 1)]
            n = len(part)
            if n < length:
                continue
            up, down = common.powers(SLICE + length), common.powers(SLICE + length, INVERSE)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(common.BYTE_CODE[part] * down[:n], out=total[1:])
            hashed = common.mix((total[kmer:] - total[:-kmer]) * up[: n + 1 - kmer])
            keys = (hashed & ~np.uint64(0xFFFFFF)) | np.arange(len(hashed), dtype=np.uint64)
            least = _least(keys, length - kmer + 1)
            for r in range(lo, hi):
                first, last = max(int(offsets[r]) - s, 0), min(int(offsets[r + 1]) - s, n) - length
                if last < first:
                    continue
                own = least[first : last + 1]
                turn = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
                place = (own[turn] & np.uint64(0xFFFFFF)).astype(np.int64)
                base = s - int(offsets[r])
                until = np.append(turn[1:], len(own)) - 1
                yield r, hashed[place].view(np.int64), place + base, turn + first + base, until + first + base


def _anchored(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, class (sha256 of the bytes), n_bytes, text, and the row's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                data, offsets = common.utf8(part.column("text"))
                raw = data.tobytes()
                found: dict[int, list] = {}
                for r, *four in anchors(data, offsets, window):
                    found.setdefault(r, []).append(four)
                lists = {}
                for k, name in enumerate(("hash", "place", "lo", "hi")):
                    kind = pa.int64()
                    lists[name] = pa.array([np.concatenate([f[k] for f in found[r]]) if r in found else [] for r in range(part.num_rows)], pa.list_(kind))
                names = pa.array([hashlib.sha256(raw[offsets[r] : offsets[r + 1]]).digest() for r in range(part.num_rows)], pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "class": names, "n_bytes": pa.array(np.diff(offsets), pa.int64()), "text": part.column("text"), **lists})

    return common.texts(docs).mapInArrow(run, "doc_id long, class binary, n_bytes long, text string, hash array<long>, place array<long>, lo array<long>, hi array<long>")


def _cut(pieces: DataFrame, length: int) -> DataFrame:
    """shard, rep, start and bytes of each piece: the union of the windows that a text sends to a shard, with what follows them up to `length`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = []
                for shard, rep, windows, text in zip(*(part.column(c).to_pylist() for c in ("shard", "rep", "windows", "text")), strict=True):
                    raw = text.encode()
                    for s, e in merged((w["lo"], w["hi"] + length) for w in windows):
                        piece = raw[s:e]
                        rows.append((shard, hashlib.sha256(piece).digest()[:16], rep, s, piece))
                if rows:
                    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "digest", "rep", "start", "piece"])

    return pieces.mapInArrow(run, "shard long, digest binary, rep long, start long, piece binary")


def merged(spans) -> list[tuple[int, int]]:
    """Spans that overlap or touch, together."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def dedup(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, and removed: the removed spans in bytes, ends exclusive.

    passage: at most `length`; n_passages counts the maximal runs covered by strings of that many bytes that start elsewhere too.
    """
    window = min(length, passage)
    base = common.stored(_anchored(docs, window).withColumn("row", F.monotonically_increasing_id()), "anchored")
    rows = base.select("doc_id", "class", "n_bytes")
    # equal texts are one; the least row stands for them
    classes = common.stored(base.groupBy("class").agg(F.min("row").alias("rep"), F.count("*").alias("n_rows")), "classes")
    alone = base.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").where(F.size("hash") > 0)
    each = common.stored(alone.select(F.col("row").alias("rep"), F.explode(F.arrays_zip("hash", "place", "lo", "hi")).alias("w")).select("rep", "w.*"), "anchors")
    spot = F.struct("rep", "place")
    found = each.groupBy("hash").agg(F.min(spot).alias("leader"), F.max(spot).alias("last"), F.count("*").alias("times")).where("leader <> last")
    apart = F.col("times") > MANY
    led = F.when(apart, F.xxhash64("hash")).otherwise(F.xxhash64("leader.rep", F.floor(F.col("leader.place") / LEAD)))
    found = common.stored(found.select("hash", "times", led.alias("led")), "leaders")
    met = common.stored(common.met(each, found, "hash", each.count()).select("rep", "led", "lo", "hi"), "met")
    common.dropped(each)
    volume = met.agg(F.sum(F.col("hi") - F.col("lo") + length // 2)).first()[0] or 0
    shards = max(1, int(volume // SHARD))
    windows = (
        met.withColumn("shard", F.pmod("led", F.lit(shards)))
        .groupBy("rep", "shard")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("windows"))
    )
    # the text of one document of each class that has windows to compare
    bodies = common.stored(base.select(F.col("row").alias("rep"), "class", "text").join(met.select("rep").distinct(), "rep", "left_semi"), "bodies")
    pieces = common.stored(_cut(windows.join(bodies.select("rep", "text"), "rep"), length), "pieces")
    distinct = pieces.groupBy("shard", "digest").agg(F.count("*").alias("times"), F.first("piece").alias("piece"))

    def sort(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("digest")
        both = repeats(list(group["piece"]), list(group["times"] > 1), length, window)
        found = [(s, d, k, a, b) for k, spans in enumerate(both) for s, d, own in zip(group["shard"], group["digest"], spans, strict=True) for a, b in own]
        return pd.DataFrame(found, columns=["shard", "digest", "kind", "a", "b"])

    hits = common.stored(distinct.repartition(shards, "shard").groupBy("shard").applyInPandas(sort, "shard long, digest binary, kind int, a long, b long"), "hits")
    spans = pieces.select("shard", "digest", "rep", "start").join(hits, ["shard", "digest"])
    place = F.struct((F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b")).alias("e"))
    spans = spans.groupBy("rep").agg(F.collect_list(F.when(F.col("kind") == 0, place)).alias("spans"), F.collect_list(F.when(F.col("kind") == 1, place)).alias("told"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text, given, told in zip(*(batch.column(c).to_pylist() for c in ("class", "text", "spans", "told")), strict=True):
                raw, at, kept = text.encode(), 0, []
                cut = merged((x["s"], x["e"]) for x in given)
                for s, e in cut:
                    kept.append(raw[at:s])
                    at = e
                out.append((name, [{"s": s, "e": e} for s, e in cut], len(merged((x["s"], x["e"]) for x in told)), hashlib.sha256(b"".join([*kept, raw[at:]])).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["class", "spans", "told", "kept"])

    kinds = [pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.int64(), pa.string()]
    cut = spans.join(bodies, "rep").mapInArrow(keep, "class binary, spans array<struct<s:long,e:long>>, told long, kept string")
    copies = classes.where("n_rows > 1").select("class", "n_rows")
    out = rows.join(copies, "class", "left").join(cut, "class", "left")
    several = F.col("n_rows").isNotNull()
    whole = several & (F.col("n_bytes") >= length)
    removed = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<s:long,e:long>>")))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "n_bytes",
        F.aggregate(removed, F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"]).alias("n_removed"),
        F.size(removed).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept", F.lower(F.hex("class")))).alias("kept_sha256"),
        F.when(several & (F.col("n_bytes") >= window), 1).otherwise(F.coalesce("told", F.lit(0))).cast("long").alias("n_passages"),
        removed.alias("removed"),
    )
