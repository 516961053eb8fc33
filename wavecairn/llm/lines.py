"""Line and paragraph deduplication by hashing.

A unit is a line (or a paragraph) with at least `least_words` words. Units are normalised (A-Z lowered, separators
collapsed), their digests grouped over all documents, and the earliest occurrence stays: least doc_id (nulls last),
then least digest of the text, then least place. All others are removed, with the newline or blank lines that ended
them, and their original offsets (code points, ends exclusive) are returned.

A passage that stands in the middle of lines shares no whole line, so sentences (units cut also behind . ! or ?) are
hashed in the same way: a run of consecutive sentences that each occur elsewhere too is reported as a passage if it
has PASSAGE words. Sentences under SENTENCE words neither end a run nor count. The first occurrence is reported like
the others; passages are told, not removed.

Rows with the same doc_id and text are one document and give the same result; rows that share a doc_id only
are different documents. Null texts stay null and empty texts empty. Winners and counts are pre-aggregated, and the
few digests that fill over a thousandth of all units are joined by broadcast, so no task holds the
occurrences of a frequent line. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_WORDS, SENTENCE, PASSAGE = 1, 5, 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BREAK = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[\x20\x09]*\n\s*"), "sentence": re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|\n")}


def units(text: str, kind: str = "line") -> list[tuple[int, int, int]]:
    """Start, end, and start of the next unit."""
    out, at = [], 0
    for m in _BREAK[kind].finditer(text):
        out.append((at, m.start(), m.end()))
        at = m.end()
    return [*out, (at, len(text), len(text))]


def digest(unit: str, least_words: int = LEAST_WORDS) -> bytes | None:
    words = _WORD.findall(unit.translate(_LOWER))
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest() if len(words) >= max(1, least_words) else None


def sentences(text: str) -> list[tuple[int, int, int, int]]:
    """Start, end, words and 64-bit hash of each sentence of SENTENCE words."""
    low, out = text.translate(_LOWER), []
    for s, e, _ in units(text, "sentence"):
        words = _WORD.findall(low, s, e)
        if len(words) >= SENTENCE:
            out.append((s, e, len(words), int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True)))
    return out


def passages(found: list[tuple[int, int, int]], repeated: set[int], least: int = PASSAGE) -> list[dict]:
    """Runs of repeated sentences (start, end, words) with so many words."""
    out, run = [], None
    for k, (s, e, n) in enumerate(found):
        if k not in repeated:
            run = None
        elif run is None:
            run = {"s": s, "e": e, "words": n}
            out.append(run)
        else:
            run["e"], run["words"] = e, run["words"] + n
    return [r for r in out if r["words"] >= least]


def without(text: str, gone: set[int], kind: str = "line") -> tuple[str, list[dict]]:
    """The text without these units, and their offsets. Units that stay are joined by the break that follows them."""
    parts, spans, found = [], [], units(text, kind)
    for k, (s, e, nxt) in enumerate(found):
        if k in gone:
            spans.append({"s": s, "e": e})
        else:
            parts.append((text[s:e], text[e:nxt]))
    return "".join(u + (b if k < len(parts) - 1 else "") for k, (u, b) in enumerate(parts)), spans


def dedup(docs: DataFrame, kind: str = "line", least_words: int = LEAST_WORDS, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_units, n_removed, n_repeated (units that occur elsewhere too, kept ones included), n_passages, removed and passages (spans), kept (the text that stays)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                places, digests, keys, hashed, bounds = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    own = [(k, d) for k, (s, e, _) in enumerate(units(text, kind)) if (d := digest(text[s:e], least_words))]
                    places.append([k for k, _ in own])
                    digests.append([d for _, d in own])
                    found = sentences(text)
                    hashed.append([h for *_, h in found])
                    bounds.append(np.array([x[:3] for x in found], np.int64).tobytes())
                keys = [common.text_key(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"), "text": part.column("text").cast(pa.string()), "text_key": keys, "place": pa.array(places, pa.list_(pa.int32())),
                        "digest": pa.array(digests, pa.list_(pa.binary())), "sentence": pa.array(hashed, pa.list_(pa.int64())), "bounds": pa.array(bounds, pa.binary()),
                    }
                )

    schema = "doc_id long, text string, text_key string, place array<int>, digest array<binary>, sentence array<long>, bounds binary"
    table = common.stored(common.texts(docs).mapInArrow(hashes, schema).withColumn("row", F.monotonically_increasing_id()), "units")
    size = table.agg(F.sum(F.size("place")).alias("units"), F.sum(F.size("sentence")).alias("sentences")).first()

    spot = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "place")
    zipped = table.select("row", "doc_id", "text_key", F.explode(F.arrays_zip("digest", "place")).alias("u"))
    each = zipped.select("row", "doc_id", "text_key", "u.*").select("row", "digest", spot.alias("spot"))
    firsts = common.stored(each.groupBy("digest").agg(F.min("spot").alias("first"), F.count("*").alias("times")).where("times > 1"), "firsts")
    met = common.met(each, firsts, "digest", size["units"] or 0)
    gone = met.groupBy("row").agg(F.count("*").alias("n_repeated"), F.collect_set(F.when(F.col("first") != F.col("spot"), F.col("spot.place"))).alias("gone"))

    heard = table.select("row", F.posexplode("sentence").alias("k", "sentence"))
    twice = common.stored(heard.groupBy("sentence").agg(F.count("*").alias("times")).where("times > 1"), "sentences")
    again = common.met(heard, twice, "sentence", size["sentences"] or 0).groupBy("row").agg(F.collect_list("k").alias("again"))
    joined = table.select("row", "doc_id", "text", "bounds").join(gone, "row", "left").join(again, "row", "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                kept, spans, counts, told = [], [], [], []
                for text, out, bounds, again in zip(*(part.column(c).to_pylist() for c in ("text", "gone", "bounds", "again")), strict=True):
                    new, cut = without(text, set(out), kind) if out else (text, [])
                    kept.append(new)
                    spans.append(cut)
                    counts.append(len(units(text, kind)) if text else 0)
                    told.append(passages(np.frombuffer(bounds, np.int64).reshape(-1, 3).tolist(), set(again), passage) if again else [])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"), "n_units": pa.array(counts, pa.int64()), "n_removed": pa.array([len(s) for s in spans], pa.int64()),
                        "n_repeated": part.column("n_repeated").fill_null(0), "n_passages": pa.array([len(p) for p in told], pa.int64()),
                        "removed": pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                        "passages": pa.array(told, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("words", pa.int64())]))), "kept": pa.array(kept, pa.string()),
                    }
                )

    return joined.select("doc_id", "text", "bounds", "gone", "n_repeated", "again").mapInArrow(
        keep, "doc_id long, n_units long, n_removed long, n_repeated long, n_passages long, removed array<struct<s:long,e:long>>, passages array<struct<s:long,e:long,words:long>>, kept string"
    )


#: The same for lines with DuckDB's functions, over one row for each document.
SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
l as (select doc_id, t, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as place from d),
u as (select *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) as unit,
      coalesce(sum(length(line) + 1) over (partition by doc_id order by place rows between unbounded preceding and 1 preceding), 0) as s from l),
r as (select *, unit <> '' and row_number() over (partition by unit order by doc_id, place) > 1 as gone, unit <> '' and count(*) over (partition by unit) > 1 as twice from u),
o as (select doc_id, cast(case when min(t) = '' then 0 else count(*) end as bigint) as n_units, cast(count(*) filter (where gone) as bigint) as n_removed, cast(count(*) filter (where twice) as bigint) as n_repeated,
      coalesce(string_agg(cast(s as bigint) || ':' || cast(s + length(line) as bigint), ',' order by place) filter (where gone), '') as removed,
      sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256 from r group by doc_id),
p as (select doc_id, string_split(regexp_replace(t, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) as parts from d),
q as (select doc_id, unnest(parts) as sentence, unnest(range(len(parts))) as k from p),
n as (select doc_id, k, trim(regexp_replace(translate(sentence, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) as sentence from q),
w as (select *, len(string_split(sentence, ' ')) as words, count(*) over (partition by sentence) > 1 as twice from n where sentence <> '' and len(string_split(sentence, ' ')) >= {SENTENCE}),
i as (select *, row_number() over (partition by doc_id order by k) - row_number() over (partition by doc_id, twice order by k) as island from w),
g as (select doc_id, island from i where twice group by 1, 2 having sum(words) >= {PASSAGE}),
c as (select doc_id, count(*) as n from g group by 1)
select o.doc_id, n_units, n_removed, n_repeated, cast(coalesce(c.n, 0) as bigint) as n_passages, removed, kept_sha256 from o left join c using (doc_id)
"""
