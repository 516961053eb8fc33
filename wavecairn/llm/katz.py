"""Language-model scoring: n-grams with Katz backoff, of order 3 unless another is asked for.

Training documents give counts of tokens and of their runs of 2 to `order` tokens (begin marks stand before the first).
Counts up to CUT are discounted by Good-Turing, each order by its own counts of counts; what the discounts free in a
context h goes to the tokens not seen after h, in proportion to what the shorter context gives them:

    P(v | h) = d(c(h,v)) c(h,v) / c(h)           if the run was seen
             = alpha(h) P(v | h without its first)  if only h was seen
             = P(v | h without its first)          if h was not seen

The unigram level is discounted in the same way; what it frees is the probability of the one unknown token.
alpha(h) = (1 - sum of the discounted seen) / (1 - sum of the shorter context's P(v) over the seen), so every context
sums to 1. A level or context in which nothing would be freed gives 1 / (count + 1) to the unseen instead.

Data flow. Documents are read once into batches of bounded size: distinct word hashes, counts, and the token
stream as ranks. (1) Hashes go to vocabulary parts by range, which count and number the words and answer each
batch. (2) Batches send their tokens, as numbers with unigram counts and the numbers before them, to parts by the hash
of the left neighbour: all contexts that end in it meet there, whatever the order, so one exchange serves all. A left
neighbour that was learned more than TOKENS times is split: the hash of the right token spreads its runs over as many
parts as it fills. (3) Parts count runs and write the model table; counts of counts are summed over all parts. Order
by order, the sums of split contexts (discount classes, probability of the seen) are added up over their parts. (4)
Tokens meet the model table of their part and are scored recursively; sums by document go back. All exchanges of tokens
carry compressed arrays, one row for each batch and part; intermediate tables are removed when they are no longer read,
shuffle files when a table is written, and tokens are exchanged in WAVES of keys. Nothing of the model is broadcast but totals, and the sums of split contexts where
Spark finds them under its broadcast threshold. So no part grows with a frequent word; a single frequent pair stays
in one part, where each batch brings it as one count to learn and a run of equal values to score.

Words are numbered by 32 bits, so a vocabulary of over 4 billion distinct words is an error.

Null texts are empty: their one token is the end. Rows are scored one by one, so repeated rows count as
often as they stand there; a null doc_id has the empty text's remainder. An empty table, or one without
training rows, gives an empty result, or every token the unknown one's probability, 1.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text in a batch; entries that a vocabulary part and tokens that a context part take.
BATCH, ENTRIES, TOKENS = 12 << 20, 1_500_000, 1_500_000
CUT, ORDER = 5, 3
#: Tokens are exchanged in so many waves, so that shuffle files hold a share of them at a time.
WAVES = 4
LOW = np.uint64(0xFFFFFFFF)
UNKNOWN, BEGIN, END = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def squeeze(values: np.ndarray) -> bytes:
    """An integer array, byte planes apart, compressed; the item size leads."""
    if values.dtype.kind == "u" and len(values):
        size = next(s for s in (1, 2, 4, 8) if int(values.max()) < 1 << 8 * s)
        values = values.astype(f"<u{size}")
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T
    return bytes([size]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, kind: type = np.uint64) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data[1:]) if len(data) > 1 else b""
    size = data[0]
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel().astype(kind)


def discounts(count_of_counts: np.ndarray) -> np.ndarray:
    """Factors for counts 0..CUT (0 unused) from the numbers of types that occur 1..CUT+1 times.

    A Good-Turing factor that is no number in (0, 1] (small or odd samples) becomes 1 - 1 / (2 r).
    """
    n = np.concatenate([[0], np.asarray(count_of_counts, float)])
    out = np.ones(CUT + 1)
    for r in range(1, CUT + 1):
        with np.errstate(all="ignore"):
            tail = (CUT + 1) * n[CUT + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        out[r] = d if np.isfinite(d) and 1e-3 < d <= 1 else 1 - 0.5 / r
    return out


def count_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(counts[(counts > 0) & (counts <= CUT + 1)].astype(np.int64), minlength=CUT + 2)[1:].tolist()


class Unigrams:
    """Discounted unigram probabilities as a function of the count."""

    def __init__(self, total: int, types: list[int]):
        self.total, self.factor = total, discounts(np.array(types))
        freed = sum((1 - self.factor[r]) * r * types[r - 1] for r in range(1, CUT + 1)) / total if total else 1.0
        self.scale, self.unknown = (1.0, freed) if freed > 1e-12 else (total / (total + 1), 1 / (total + 1))

    def of(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        p = self.scale * self.factor[np.where(counts <= CUT, counts, 0)] * counts / self.total
        return np.where(counts > 0, p, self.unknown)


def _batches(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    def pack(number: int, ids: list, columns: list[pa.Array]) -> pa.RecordBatch:
        hashed, sizes = [], []
        for column in columns:
            data, offsets = common.utf8(column)
            for lo, hi in common.blocks(offsets):
                h, _, _, rows = common.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                hashed.append(h)
                sizes.append(np.diff(rows))
        words, sizes = np.concatenate(hashed), np.concatenate(sizes)
        train = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus != held for i in ids], bool)
        distinct, place = np.unique(words, return_inverse=True)
        learned = np.bincount(place[np.repeat(train, sizes)], minlength=len(distinct))
        order = np.argsort(-np.bincount(place, minlength=len(distinct)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        row = {
            "batch": number,
            "ids": ids,
            "train": train.tobytes(),
            "sizes": squeeze(sizes.astype(np.uint64)),
            "hashes": distinct.tobytes(),
            "learned": squeeze(learned.astype(np.uint64)),
            "order": squeeze(order.astype(np.uint64)),
            "stream": squeeze(rank[place].astype(np.uint64)),
            "n_distinct": len(distinct),
            "n_words": len(words),
        }
        return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.int64()) if k == "ids" else None) for k, v in row.items()], list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, columns, held_bytes = [], [], 0
        for batch in batches:
            _, offsets = common.utf8(batch.column("text"))
            for lo, hi in common.blocks(offsets, BATCH):
                size = int(offsets[hi] - offsets[lo])
                if ids and held_bytes + size > BATCH:
                    yield pack(number, ids, columns)
                    number, ids, columns, held_bytes = number + 1, [], [], 0
                part = batch.slice(lo, hi - lo)
                ids += part.column("doc_id").to_pylist()
                columns.append(part.column("text"))
                held_bytes += size
        if ids:
            yield pack(number, ids, columns)

    schema = "batch long, ids array<long>, train binary, sizes binary, hashes binary, learned binary, order binary, stream binary, n_distinct long, n_words long"
    return common.texts(docs).mapInArrow(run, schema)


def _requests(table: DataFrame, bits: int) -> DataFrame:
    """The distinct hashes of each batch, cut by their leading bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw, learned in zip(*(batch.column(c).to_pylist() for c in ("batch", "hashes", "learned")), strict=True):
                hashes, counts = np.frombuffer(raw, np.uint64), unsqueeze(learned)
                part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
                for p in range(1 << bits):
                    own = slice(cuts[p], cuts[p + 1])
                    if cuts[p] < cuts[p + 1]:
                        yield pa.RecordBatch.from_pydict({"part": [p], "batch": [number], "hashes": [hashes[own].tobytes()], "learned": [squeeze(counts[own])]})

    return table.select("batch", "hashes", "learned").mapInArrow(run, "part long, batch long, hashes binary, learned binary")


def _numbered(bits: int):
    def run(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        asked = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        learned = [unsqueeze(x, np.int64) for x in table.column("learned").to_pylist()]
        distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(place, np.concatenate(learned), len(distinct)).astype(np.int64)
        if len(distinct) >= 1 << (32 - bits):
            raise ValueError("the vocabulary has more words than 32 bits can number")
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order)) | p << (32 - bits)
        number[counts == 0] = UNKNOWN
        rows, at = [], 0
        for b, own in zip(table.column("batch").to_pylist(), asked, strict=True):
            mine = place[at : at + len(own)]
            at += len(own)
            rows.append(("answer", p, b, squeeze(number[mine].astype(np.uint64)), squeeze(counts[mine].astype(np.uint64)), None))
        known = counts > 0
        rows.append(("word", p, None, distinct[known].tobytes(), squeeze(counts[known].astype(np.uint64)), [int(known.sum()), int(counts.sum()), *count_of_counts(counts)]))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ANSWER_KINDS, strict=True)], _ANSWER_NAMES)

    return run


_ANSWER_NAMES = ["kind", "part", "batch", "numbers", "counts", "totals"]
_ANSWER_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
_ANSWER = "kind string, part long, batch long, numbers binary, counts binary, totals array<long>"
_SENT_NAMES = ["part", "batch", "ids", "info", "sizes", "left", "left_table", "right", "right_table", "right_counts", "train", "split", "deep"]
_SENT = "part long, batch long, ids array<long>, info binary, sizes binary, left binary, left_table binary, right binary, right_table binary, right_counts binary, train binary, split array<long>, deep array<binary>"
_SENT_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 8, pa.list_(pa.int64()), pa.list_(pa.binary())]


def spread(left: np.ndarray, right: np.ndarray, learned: np.ndarray, parts: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each pair, and into how many shares its context is split: one for each `most` times it was learned.

    An unknown context needs no counts of its own, so its tokens go to any part.
    """
    shares = np.where(left == UNKNOWN, parts, np.minimum(1 + learned // most, parts)).astype(np.uint64)
    share = common.mix(right) % shares
    return (common.mix(left | share << np.uint64(32)) % np.uint64(parts)).astype(np.int64), shares


def _sent(parts: int, n_train: int, most: int, order_: int):
    """A batch's tokens, cut by the part of their left neighbour, and its documents' plain sums."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        answers = sorted(answers.to_pylist(), key=lambda a: a["part"])
        none = np.zeros(0, np.uint64)
        numbers = np.concatenate([none, *(unsqueeze(a["numbers"]) for a in answers)])
        counts = np.concatenate([none.astype(np.int64), *(unsqueeze(a["counts"], np.int64) for a in answers)])
        stream = unsqueeze(row["order"], np.int64)[unsqueeze(row["stream"], np.int64)]
        sizes, train = unsqueeze(row["sizes"], np.int64), np.frombuffer(row["train"], bool)
        n, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        c = counts[stream]
        plain = np.bincount(doc, np.log10(c + 1.0), n) + np.log10(n_train + 1.0)
        known = np.bincount(doc, c > 0, n) + (n_train > 0)
        info = np.stack([sizes + 1.0, known, plain]).tobytes()
        rows = [(-1, row["batch"], row["ids"], info, *[None] * 9)]
        end = np.cumsum(sizes + 1)
        last = np.zeros(len(stream) + n, bool)
        last[end - 1] = True
        right = np.full(len(last), END, np.uint64)
        right[~last] = numbers[stream]
        weight = np.full(len(last), n_train, np.int64)
        weight[~last] = c
        left = np.empty(len(last), np.uint64)
        left[1:] = right[:-1]
        left[end - sizes - 1] = BEGIN
        learned = np.full(len(last), n_train, np.int64)
        learned[1:] = weight[:-1]
        learned[end - sizes - 1] = n_train
        deep, near = [], left
        for _ in range(order_ - 2):  # the tokens further back
            far = np.empty(len(last), np.uint64)
            far[1:] = near[:-1]
            far[end - sizes - 1] = BEGIN
            deep.append(far)
            near = far
        owner = np.repeat(np.arange(n), sizes + 1)
        part, shares = spread(left, right, learned, parts, most)
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for q in range(parts):
            at = order[cuts[q] : cuts[q + 1]]
            if len(at):
                lefts, li = np.unique(left[at], return_inverse=True)
                rights, first, ri = np.unique(right[at], return_index=True, return_inverse=True)
                own_sizes = np.bincount(owner[at], minlength=n).astype(np.uint64)
                split = np.unique(left[at][(shares[at] > 1) & (left[at] != UNKNOWN)]).tolist()
                further = [squeeze(x.astype(np.uint64)) for far in deep for x in np.unique(far[at], return_inverse=True)]
                rows.append((q, row["batch"], None, None, squeeze(own_sizes), squeeze(li.astype(np.uint64)), squeeze(lefts), squeeze(ri.astype(np.uint64)), squeeze(rights), squeeze(weight[at][first].astype(np.uint64)), train.tobytes(), split, further))
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _SENT_KINDS, strict=True)], _SENT_NAMES)

    return run


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of one batch's tokens in one part: pair, unigram count of the right token, document, whether it is learned from, tokens further back."""
    lefts, rights, weights = unsqueeze(row["left_table"]), unsqueeze(row["right_table"]), unsqueeze(row["right_counts"], np.int64)
    li, ri, sizes = unsqueeze(row["left"], np.int64), unsqueeze(row["right"], np.int64), unsqueeze(row["sizes"], np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    further = row["deep"] or []
    deep = [unsqueeze(table)[unsqueeze(at, np.int64)] for table, at in zip(further[::2], further[1::2], strict=True)]
    return lefts[li] << np.uint64(32) | rights[ri], weights[ri], doc, np.frombuffer(row["train"], bool)[doc], deep


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, once each; a plain sort is faster than hashing here."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def runs(pair: np.ndarray, deep: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct runs by length: pairs, then (place of the shorter run, token before it) as one number; places of the pairs' first tokens, and each token's longest run."""
    seen, first, at = np.unique(pair, return_index=True, return_inverse=True)
    out = [seen]
    for u in deep:
        keys, at = np.unique(at.astype(np.uint64) << np.uint64(32) | u, return_inverse=True)
        out.append(keys)
    return out, first, at


def spelled(grams: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each longest run the place of its pair, and the tokens further back."""
    at, deep = np.arange(len(grams[-1])), []
    for keys in grams[:0:-1]:
        deep.append(keys[at] & LOW)
        at = (keys[at] >> np.uint64(32)).astype(np.int64)
    return at, deep[::-1]


def _by_length(grams: list[np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    """Counts of the runs of each length, from those of the longest."""
    out = [counts]
    for shorter, keys in zip(grams[-2::-1], grams[:0:-1], strict=True):
        out.append(np.bincount((keys >> np.uint64(32)).astype(np.int64), out[-1], len(shorter)).astype(np.int64))
    return out[::-1]


_MODEL = "part long, grams array<binary>, counts binary, rights binary, types array<array<long>>, asked array<binary>, sums binary"
#: Of a split context in one part: runs that occur 1..CUT times, the sum of higher counts, the shorter context's probability of the seen.
_SUMS = [f"s{k}" for k in range(CUT + 2)]
_WHOLE = "part long, id long, " + ", ".join(f"{k} double" for k in _SUMS)


def _counted(unigrams: Unigrams, order: int):
    """A part of the model table: runs in order, counts of the longest, unigram counts of the right tokens, split contexts that its tokens have, and what it adds to the sums of those of one token."""

    def run(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        none = np.zeros(0, np.uint64)
        pairs, weights, times, deeps, split = [none], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [[none] * (order - 2)], set()
        asked = [[none] for _ in range(order - 2)]
        for batch in table.to_batches():
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                split.update(row["split"])
                pair, weight, _, train, deep = _pairs(row)
                if deep and row["split"]:
                    own = np.isin(pair >> np.uint64(32), np.array(row["split"], np.uint64))
                    asked[0].append(distinct(pair[own] & ~LOW | deep[0][own]))
                grams, first, at = runs(pair[train], [u[train] for u in deep])
                place, further = spelled(grams)
                pairs.append(grams[0][place])
                weights.append(weight[train][first][place])
                times.append(np.bincount(at, minlength=len(grams[-1])))
                deeps.append(further)
        grams, first, at = runs(np.concatenate(pairs), [np.concatenate(u) for u in zip(*deeps, strict=True)])
        counts = np.bincount(at, np.concatenate(times), len(grams[-1])).astype(np.int64)
        weight = np.concatenate(weights)[first]
        ids = [np.array(sorted(split), np.uint64), *(distinct(np.concatenate(x)) for x in asked)]
        sums = Part(grams, counts, weight, unigrams, [], []).sums(ids[0])
        return pa.table({
            "part": pa.array([p], pa.int64()), "grams": pa.array([[squeeze(g) for g in grams]], pa.list_(pa.binary())), "counts": [squeeze(counts.astype(np.uint64))], "rights": [squeeze(weight.astype(np.uint64))],
            "types": pa.array([[count_of_counts(c) for c in _by_length(grams, counts)]], pa.list_(pa.list_(pa.int64()))), "asked": pa.array([[squeeze(i) for i in ids]], pa.list_(pa.binary())), "sums": pa.array([sums.tobytes()], pa.binary()),
        })

    return run


def _find(keys: np.ndarray, wanted: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Places of the wanted among sorted keys; -1 where there is none or it is not live."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(live & (keys[at] == wanted), at, -1)


class Part:
    """One part of the model: probabilities of its contexts, exactly normalised, for as many orders as sums of split contexts are given.

    A context of one token has that as its number, one of two tokens both of them (the nearer one first).
    """

    def __init__(self, grams: list[np.ndarray], counts: np.ndarray, rights: np.ndarray, unigrams: Unigrams, factors: list[np.ndarray], wholes: list[tuple[np.ndarray, np.ndarray]]):
        self.grams, self.unigrams, self.contexts, self.log_seen, self.log_back = grams, unigrams, [], [], []
        lower, floor, place = unigrams.of(rights), unigrams.unknown, None
        for k, own_counts in enumerate(_by_length(grams, counts)):
            if k:
                parent = (grams[k] >> np.uint64(32)).astype(np.int64)
                key, lower = place[parent].astype(np.uint64) << np.uint64(32) | grams[k] & LOW, lower[parent]
            else:
                key = grams[0] >> np.uint64(32)
            if k == len(wholes):
                # what this part knows of the contexts of the next order
                self.open = (key, own_counts, lower)
                break
            ids, sums = wholes[k]
            wanted = self._key(ids, k)
            contexts = distinct(np.concatenate([key, wanted]))
            place, n = np.searchsorted(contexts, key), len(contexts)
            own = own_counts * factors[k][np.where(own_counts <= CUT, own_counts, 0)]
            total, kept, known = (np.bincount(place, x, n) for x in (own_counts, own, lower))
            if len(ids):
                occurring = sums[:, :CUT] * np.arange(1, CUT + 1)
                c = np.searchsorted(contexts, wanted)
                total[c] = occurring.sum(1) + sums[:, CUT]
                kept[c] = occurring @ factors[k][1:] + sums[:, CUT]
                known[c] = sums[:, CUT + 1]
            freed = 1 - kept / total
            nothing = freed < 1e-9
            scale = np.where(nothing, total / (total + 1), 1.0)
            freed = np.where(nothing, 1 / (total + 1), freed)
            if k:
                floor = floor[(contexts >> np.uint64(32)).astype(np.int64)]
            back = freed / np.maximum(1 - known, floor)
            lower = own / total[place] * scale[place]
            floor = floor * back
            self.contexts.append(contexts)
            self.log_seen.append(np.log10(lower))
            self.log_back.append(np.log10(back))

    def _key(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Numbers of contexts of k + 1 tokens as they are known in this part; those of one token are the same everywhere."""
        return ids if not k else np.searchsorted(self.contexts[0], ids >> np.uint64(32)).astype(np.uint64) << np.uint64(32) | ids & LOW

    def sums(self, ids: np.ndarray) -> np.ndarray:
        """What this part adds to the sums of these contexts of the next order."""
        key, counts, lower = self.open
        contexts, at = np.unique(key, return_inverse=True)
        n = len(contexts)
        every = [*(np.bincount(at[counts == r], minlength=n) for r in range(1, CUT + 1)), np.bincount(at, np.where(counts > CUT, counts, 0), n), np.bincount(at, lower, n)]
        own = _find(contexts, self._key(ids, len(self.contexts)), np.ones(len(ids), bool))
        table = np.concatenate([np.stack(every, 1), np.zeros((1, CUT + 2))])  # the last row is that of a context without runs here
        return table[own]

    def log_probability(self, pairs: np.ndarray, deep: list[np.ndarray], rights: np.ndarray) -> np.ndarray:
        """From the shortest context on: the run if it was seen, else its context's weight, if that was seen, on top of what the shorter one gave."""
        out = np.log10(self.unigrams.of(rights))
        left = pairs >> np.uint64(32)
        known = left != UNKNOWN
        c, g = _find(self.contexts[0], left, known), _find(self.grams[0], pairs, known)
        for k in range(len(self.grams)):
            if k:
                c = _find(self.contexts[k], c.astype(np.uint64) << np.uint64(32) | deep[k - 1], c >= 0)
                g = _find(self.grams[k], g.astype(np.uint64) << np.uint64(32) | deep[k - 1], g >= 0)
            if len(self.log_back[k]):
                out += np.where(c >= 0, self.log_back[k][c], 0.0)
            if len(self.log_seen[k]):
                out = np.where(g >= 0, self.log_seen[k][g], out)
        return out


def _part(table: pa.Table, unigrams: Unigrams, factors: list[np.ndarray], order: int, levels: int) -> tuple[Part, list]:
    """A part from its row of the model table and its rows of sums, for so many orders of contexts."""
    m = table.filter(pc.is_valid(table.column("grams"))).to_pylist()
    none = np.zeros(0, np.uint64)
    grams, counts, rights = ([unsqueeze(g) for g in m[0]["grams"]], unsqueeze(m[0]["counts"], np.int64), unsqueeze(m[0]["rights"], np.int64)) if m else ([none] * (order - 1), *[np.zeros(0, np.int64)] * 2)
    sums = table.filter(pc.is_valid(table.column("id")))
    wholes = []
    for k in range(levels):
        own = sums.filter(pc.equal(sums.column("level"), k))
        ids, matrix = own.column("id").to_numpy().view(np.uint64), np.stack([own.column(c).to_numpy() for c in _SUMS], 1) if own.num_rows else np.zeros((0, CUT + 2))
        learned = matrix[:, : CUT + 1].sum(1) > 0  # a context of held-out texts only is an unseen one
        rank = np.argsort(ids[learned])
        wholes.append((ids[learned][rank], matrix[learned][rank]))
    return Part(grams, counts, rights, unigrams, factors, wholes), m


def _listed(part: int, ids: np.ndarray, sums: np.ndarray) -> dict:
    return {"part": pa.array(np.full(len(ids), part), pa.int64()), "id": pa.array(ids.view(np.int64)), **{c: pa.array(sums[:, k]) for k, c in enumerate(_SUMS)}}


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of split contexts of one token, a row each."""
    for batch in batches:
        for p, asked, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "asked", "sums")), strict=True):
            yield pa.RecordBatch.from_pydict(_listed(p, unsqueeze(asked[0]), np.frombuffer(sums, float).reshape(-1, CUT + 2)))


def _summed(unigrams: Unigrams, factors: list[np.ndarray], order: int, level: int):
    """The sums of each split context of `level` + 1 tokens that a part's tokens have, as far as the part knows."""

    def run(table: pa.Table) -> pa.Table:
        part, m = _part(table, unigrams, factors, order, level)
        ids = unsqueeze(m[0]["asked"][level]) if m else np.zeros(0, np.uint64)
        return pa.table(_listed(m[0]["part"] if m else 0, ids, part.sums(ids)))

    return run


def _scored(unigrams: Unigrams, factors: list[np.ndarray], order: int):
    def run(tokens: pa.Table, model: pa.Table) -> pa.Table:
        batches, sums = [], []
        part, _ = _part(model, unigrams, factors, order, order - 1)
        for batch in tokens.to_batches():
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                pairs, weights, doc, _, deep = _pairs(row)
                grams, first, at = runs(pairs, deep)
                place, further = spelled(grams)
                p = part.log_probability(grams[0][place], further, weights[first][place])
                batches.append(row["batch"])
                sums.append(np.bincount(doc, p[at], len(row["train"])).tobytes())
        return pa.table({"batch": pa.array(batches, pa.int64()), "sums": pa.array(sums, pa.binary())})

    return run


def _added(n_all: int, vocabulary: int):
    def run(table: pa.Table) -> pa.Table:
        ids, info, score = [], None, 0.0
        for row in table.to_pylist():
            if row["info"] is not None:
                ids, info = row["ids"], np.frombuffer(row["info"], float).reshape(3, -1)
            else:
                score = score + np.frombuffer(row["sums"], float)
        base = info[2] - info[0] * np.log10(n_all + vocabulary + 1.0)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": info[0].astype(np.int64), "n_known": info[1].astype(np.int64), "base_score": base, "score": score + np.zeros(len(base))})

    return run


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def _wave(key: str) -> Column:
    return F.pmod(F.hash(key), F.lit(WAVES))


def score(docs: DataFrame, modulus: int = 7, held: int = 2, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. order: 2 or 3."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    table = common.stored(_batches(docs, modulus, held), "batches")
    size = table.agg(F.sum("n_distinct").alias("entries"), F.sum("n_words").alias("words"), F.sum(F.size("ids")).alias("docs")).first()
    n_train = docs.where(common.crc_mod(F.col("doc_id"), modulus) != held).count()
    bits = max(0, int(np.ceil(np.log2(max(1, (size["entries"] or 0) / ENTRIES)))))
    answers = common.stored(_requests(table, bits).repartition(1 << bits, "part").groupBy("part").applyInArrow(_numbered(bits), _ANSWER), "vocabulary", "kind")
    words = answers.where("kind = 'word'").agg(*[F.sum(F.col("totals")[k]).alias(f"t{k}") for k in range(CUT + 3)]).first()
    known, n_words, *types = (int(x or 0) for x in words)
    n_all, vocabulary = n_words + n_train, known + (n_train > 0)
    if 0 < n_train <= CUT + 1:
        types[n_train - 1] += 1
    unigrams = Unigrams(n_all, types)
    parts = max(1, -(-((size["words"] or 0) + (size["docs"] or 0)) // TOKENS))
    mine = answers.where("kind = 'answer'").select("batch", "part", "numbers", "counts")
    answer, waves, share = _sent(parts, n_train, TOKENS, order), range(WAVES), -(-parts // WAVES)
    sent = []
    for k in waves:
        own, theirs = (t.where(_wave("batch") == k).groupBy("batch") for t in (table, mine))
        rows = own.cogroup(theirs).applyInArrow(answer, _SENT).withColumn("wave", F.when(F.col("part") < 0, -1).otherwise(_wave("part")))
        sent.append(common.stored(rows, "tokens", "wave"))
    common.dropped(table)
    common.dropped(answers)

    def by_part(rows: DataFrame):
        return rows.repartition(share, "part").groupBy("part")

    tokens = [_union([t.where(F.col("wave") == k) for t in sent]).drop("ids", "info", "wave") for k in waves]
    models = [common.stored(by_part(t).applyInArrow(_counted(unigrams, order), _MODEL), "model") for t in tokens]
    types = _union(models).agg(*[F.sum(F.col("types")[k][r]).alias(f"t{k}{r}") for k in range(order - 1) for r in range(CUT + 1)]).first()
    factors = [discounts(np.array([int(types[f"t{k}{r}"] or 0) for r in range(CUT + 1)])) for k in range(order - 1)]
    nothing = docs.sparkSession.createDataFrame([], _WHOLE + ", level int").drop("part")
    wholes = []

    def read(k: int) -> DataFrame:
        known = models[k].select("part", "grams", "counts", "rights", "asked").unionByName(nothing, allowMissingColumns=True)
        return functools.reduce(lambda a, b: a.unionByName(b.where(_wave("part") == k), allowMissingColumns=True), wholes, known)

    for level in range(order - 1):
        if level:
            partial = [common.stored(by_part(read(k)).applyInArrow(_summed(unigrams, factors, order, level), _WHOLE), "partial") for k in waves]
        else:
            partial = [common.stored(_union(models).select("part", "asked", "sums").mapInArrow(_told, _WHOLE), "partial")]
        every = _union(partial)
        sums = every.groupBy("id").agg(*[F.sum(c).alias(c) for c in _SUMS])
        wholes.append(common.stored(every.select("part", "id").join(sums, "id").withColumn("level", F.lit(level)), "sums"))
        for old in partial:
            common.dropped(old)
    rate = _scored(unigrams, factors, order)
    scores = [common.stored(by_part(t.drop("split")).cogroup(by_part(read(k))).applyInArrow(rate, "batch long, sums binary"), "scores") for k, t in zip(waves, tokens, strict=True)]
    info = common.stored(_union(sent).where("wave = -1").select("batch", "ids", "info"), "batch_info")
    for old in (*sent, *models, *wholes):
        common.dropped(old)
    sums = _union(scores)
    both = info.withColumn("sums", F.lit(None).cast("binary")).unionByName(sums, allowMissingColumns=True)
    out = both.groupBy("batch").applyInArrow(_added(n_all, vocabulary), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (common.crc_mod(F.col("doc_id"), modulus) == held).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
