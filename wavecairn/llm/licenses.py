"""License scan by conditional compression.

Candidate blocks are licensing words with so many words on both sides as a window can reach, whatever the lines.
Windows of a block that hold a template's words, in any order, are compressed alone and with every template as a
zstandard raw dictionary, and templates are ranked by the share of bytes that they save. In that order each is
confirmed by its exact differences: nearly all of the template's words must stand there in order, and no telling
word (a number, a version, a clause name, a negation) may be missing or come in between. The wording so found is
ranked like the window, and counts if its template saves enough of its bytes. No template is left out by its rank.

All licenses confirmed are returned, each with the span of its wording and the sentence end after it, and with what
the steps found; overlapping windows of one license are one span, which takes the findings of its best one. Equal
blocks are decided once for each worker.

Null and empty texts have no blocks. Rows are independent: repeated rows give repeated results, an empty table an
empty one.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common

# Wordings by which licenses are commonly declared.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}
# Words that tell one license from another.
TELLING = frozenset("apache mit gnu lesser affero bsd mozilla mpl isc cc by sa nc nd cc0 creative commons attribution sharealike noncommercial noderivatives general public domain not clause version all".split())
_HINT = re.compile(r"licen[sc]|copyright|public[\W_]+domain|redistribut|permission|rights[\W_]+reserved|creative[\W_]+commons|\bspdx\b", re.I)
_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
_END = re.compile(r"[.!?]?")
#: Share of a template's words that must be there, blocks and windows a worker remembers, least share of bytes saved.
COVER, MEMO, RANKED, SAVED = 0.9, 100_000, 10_000, 0.2
#: A window spans so many times its template's words at most.
SPREAD = 6


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _telling(word: str) -> bool:
    return word in TELLING or any(c.isdigit() for c in word)


class Template:
    """A wording's words, with what a block must have to be aligned with it."""

    def __init__(self, name: str, wording: str):
        self.name, self.words = name, _words(wording)
        self.telling = [_telling(w) for w in self.words]
        self.spare = len(self.words) - math.ceil(COVER * len(self.words))
        self.needed = frozenset(w for w, t in zip(self.words, self.telling, strict=True) if t)
        self.distinct = frozenset(self.words)

    def may(self, places: dict[str, list[int]]) -> bool:
        """Whether a block has the words at all. places: where each word stands."""
        return self.needed <= places.keys() and len(self.distinct - places.keys()) <= self.spare

    def held(self, places: dict[str, list[int]], stops: list[int]) -> Iterator[tuple[int, int]]:
        """Least word ranges that hold all telling words and all but `spare` others in any order, from each place where the template may begin. stops: places of telling words.

        Exact windows from there hold these, so ranges with more telling words than the template has are left out.
        """
        if not self.may(places):
            return
        for first in range(self.spare + 1):
            if any(self.telling[:first]):
                break
            for start in places.get(self.words[first], ()):
                last = start + SPREAD * len(self.words)
                needed, others = [], []
                for word in self.distinct:
                    own = places.get(word, ())
                    k = bisect_left(own, start)
                    (needed if word in self.needed else others).append(own[k] if k < len(own) else last)
                end = max([start, *needed, *sorted(others)[: max(0, len(others) - self.spare)]])
                if end < last and bisect_right(stops, end) - bisect_left(stops, start) <= sum(self.telling):
                    yield start, end + 1

    def aligned(self, start: int, places: dict[str, list[int]], stops: list[int]) -> list[tuple[int, int, int]]:
        """The exact differences from a place on: (missing words, size, start) of the windows that begin there and hold the template in order.

        All telling words must be matched, and none may stand in between; `spare` other words may be missing.
        A state is the earliest end for the words matched so far and the number missing.
        """
        found = []
        for first in range(self.spare + 1):
            if any(self.telling[:first]):
                break
            own = places.get(self.words[first], ())
            k = bisect_left(own, start)
            if k == len(own) or own[k] != start:
                continue
            last = start + SPREAD * len(self.words)
            ends = {first: start + 1}
            for a in range(first + 1, len(self.words)):
                own, reached = places.get(self.words[a], ()), {}
                for missing, end in ends.items():
                    k = bisect_left(own, end)
                    if k < len(own) and own[k] < last:
                        stop = bisect_left(stops, end)
                        if stop == len(stops) or stops[stop] >= own[k]:
                            reached[missing] = min(reached.get(missing, last), own[k] + 1)
                    if missing < self.spare and not self.telling[a]:
                        reached[missing + 1] = min(reached.get(missing + 1, last), end)
                ends = reached
                if not ends:
                    break
            found += [(missing, end - start, start) for missing, end in ends.items()]
        return found


class Finding(NamedTuple):
    """A license in a text: code-point offsets, share of bytes its template saves, the license's rank by that (1: none saves more), and the exact differences in words."""

    name: str
    start: int
    end: int
    saved: float
    rank: int
    missing: int
    added: int


class Scanner:
    def __init__(self):
        settings = zstandard.ZstdCompressionParameters.from_level(19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(compression_params=settings)
        self.given = []
        for name, wordings in TEMPLATES.items():
            for t in wordings:
                raw = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.given.append((Template(name, t), zstandard.ZstdCompressor(dict_data=raw, compression_params=settings)))
        #: Words on both sides of a hint that a window around it can reach.
        self.reach = SPREAD * max(len(t.words) for t, _ in self.given)
        self.memo: dict[str, list[Finding]] = {}
        self.shares: dict[str, array] = {}

    def saved(self, window: str, compressor: zstandard.ZstdCompressor) -> float:
        """Share of the window's bytes that a template saves."""
        raw = window.encode()
        return 1 - len(compressor.compress(raw)) / len(self.alone.compress(raw))

    def ranked(self, window: str) -> list[tuple[float, int]]:
        """Share of the window's bytes that each template saves, and its place in `given`; most saved first."""
        if window not in self.shares:
            if len(self.shares) >= RANKED:
                self.shares.clear()
            raw = window.encode()
            size = len(self.alone.compress(raw))
            self.shares[window] = array("d", (1 - len(c.compress(raw)) / size for _, c in self.given))
        return sorted(((x, k) for k, x in enumerate(self.shares[window])), key=lambda y: (-y[0], y[1]))

    def decide(self, block: str) -> list[Finding]:
        """All licenses confirmed in a block, by start."""
        if block not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            at, places, stops = [], {}, []
            for k, m in enumerate(_WORD.finditer(block)):
                word = m[0].lower()
                at.append(m.span())
                places.setdefault(word, []).append(k)
                if _telling(word):
                    stops.append(k)
            text = lambda first, end: block[at[first][0] : at[end - 1][1]]
            exact: dict[int, set[tuple[int, int, int]]] = {}
            seen = set()
            for first, end in sorted({w for template, _ in self.given for w in template.held(places, stops)}):
                for _, k in self.ranked(text(first, end)):
                    if (first, k) not in seen:
                        seen.add((first, k))
                        exact.setdefault(k, set()).update(self.given[k][0].aligned(first, places, stops))
            spans: dict[str, list[Finding]] = {}
            for k, windows in exact.items():
                template, kept = self.given[k][0], []
                for missing, size, first in sorted(windows):  # fewest missing words first, then shortest
                    end = first + size
                    j = bisect_left(kept, (first, 0))
                    if j < len(kept) and kept[j][0] < end or j and kept[j - 1][1] > first:
                        continue
                    order = self.ranked(text(first, end))
                    saved = next(y for y, x in order if x == k)
                    ahead = {self.given[x][0].name for y, x in order if y > saved} - {template.name}
                    if saved >= SAVED:
                        kept.insert(j, (first, end))
                        e = at[end - 1][1]
                        spans.setdefault(template.name, []).append(Finding(template.name, at[first][0], _END.match(block, e).end(), saved, 1 + len(ahead), missing, size - len(template.words) + missing))
            self.memo[block] = sorted((f for own in spans.values() for f in _outer(own)), key=lambda f: (f.start, f.end, f.name))
        return self.memo[block]


def _outer(found: list[Finding]) -> list[Finding]:
    """Findings of one license, overlapping ones as one with what the best ranked found."""
    out: list[Finding] = []
    for f in sorted(found, key=lambda f: (f.start, f.end)):
        if out and f.start < out[-1].end:
            best = min(out[-1], f, key=lambda x: (x.rank, -x.saved, x.start))
            out[-1] = best._replace(start=out[-1].start, end=max(f.end, out[-1].end))
        else:
            out.append(f)
    return out


def candidate_blocks(text: str, reach: int) -> list[tuple[int, int]]:
    """Licensing words with `reach` words on both sides, overlapping ones as one, as code-point offsets."""
    hints = [m.span() for m in _HINT.finditer(text)]
    if not hints:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    out: list[tuple[int, int]] = []
    for s, e in hints:
        low, high = max(0, bisect_right(ends, s) - reach), min(len(words), bisect_left(starts, e) + reach) - 1
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return [(starts[low], ends[high]) for low, high in out]


def findings(scanner: Scanner, text: str) -> tuple[int, list[Finding]]:
    """Number of blocks and what was found in them."""
    blocks = candidate_blocks(text, scanner.reach)
    # the sentence end after a window may follow the block's last word
    return len(blocks), [f._replace(start=s + f.start, end=s + f.end) for s, e in blocks for f in scanner.decide(text[s : e + 1])]


def scan_text(scanner: Scanner, text: str) -> tuple[int, list[tuple[str, int, int]]]:
    """Number of blocks and the licenses found in them."""
    n, found = findings(scanner, text)
    return n, [f[:3] for f in found]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, n_licenses, licenses (distinct names, comma-joined), spans (name:start:end, comma-joined), evidence.

    evidence has for each span percent of bytes saved:rank of the license by that:missing words:added words, comma-joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = [findings(scanner, t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_blocks": pa.array([n for n, _ in got], pa.int64()),
                        "n_licenses": pa.array([len(f) for _, f in got], pa.int64()),
                        "licenses": [",".join(sorted({x.name for x in f})) for _, f in got],
                        "spans": [",".join(f"{x.name}:{x.start}:{x.end}" for x in f) for _, f in got],
                        "evidence": [",".join(f"{math.floor(100 * x.saved)}:{x.rank}:{x.missing}:{x.added}" for x in f) for _, f in got],
                    }
                )

    return common.texts(docs).mapInArrow(run, "doc_id long, n_blocks long, n_licenses long, licenses string, spans string, evidence string")
