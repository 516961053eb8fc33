"""Byte-level BPE by prefix-sharing trie traversal.

The state of a prefix is the last token of its encoding. That token is the one suffix of the prefix that
is compatible with the state of what stands before it: no merge of the pair's own merges crosses the border.
Distinct words are visited in sorted order, which is the depth-first order of their trie, so a stack holds
the states from the root to the current node and each shared prefix is worked out once. Walking a word's
states back from its end gives its ids. The tokens that end at a place come from an automaton of all tokens,
whose node is kept beside the state. Tables and ready words outlive a task in its worker.

Texts may be null or empty (no tokens) and of any length; the text of an added token becomes that token.
Rows are independent: repeated rows give repeated results, an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The byte-level pre-tokeniser's pattern. What begins with a quote and what with a letter or digit never compete, so the frequent comes first.
PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept ready by a worker, so that its memory is bounded on any input.
MEMO = 400_000
#: Pairs of tokens and steps of the automaton kept ready; tokens decoded at once.
PAIRS, STEPS, TOKENS = 2_000_000, 1_000_000, 1 << 18


def _plain() -> str:
    """The same pattern over ASCII, by the classes that `regex` has there."""
    among = lambda kind: "".join(re.escape(chr(c)) for c in range(128) if regex.fullmatch(kind, chr(c)))
    letter, digit, space = among(r"\p{L}"), among(r"\p{N}"), among(r"\s")
    return PATTERN.replace(r"\s\p{L}\p{N}", space + letter + digit).replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{digit}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")


def _byte_letters() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for letters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in own):
        letters[chr(256 + k)] = b
    return letters


class Encoder:
    """One worker's tables: spellings, merges, and the spines by which compatibility is decided."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, letters = spec["model"], _byte_letters()
        if spec.get("normalizer") or model.get("byte_fallback") or model.get("end_of_word_suffix"):
            raise ValueError("only plain byte-level BPE is supported")
        spell = lambda s: bytes(letters[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.id_of = {spell(s): i for s, i in model["vocab"].items() if s not in self.added}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = (spell(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b = self.id_of[left], self.id_of[right]
            self.rank[a, b] = r
            self.parts.setdefault(self.id_of[left + right], (a, b, r))
        bytes_of = {i: s for s, i in self.id_of.items()} | {i: s.encode() for s, i in self.added.items()}
        ids = range(max(bytes_of, default=-1) + 1)
        self.size = np.array([len(bytes_of.get(i, b"")) for i in ids], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.known = np.array([i in bytes_of for i in ids], bool)
        self.blob = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in ids), np.uint8)
        self.four = [i.to_bytes(4, "little") for i in ids]
        self._automaton()
        self.agree: dict[int, bool] = {}
        self.pattern, self.plain = regex.compile(PATTERN), re.compile(_plain())
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.memo: dict[str, bytes] = {}

    def _automaton(self) -> None:
        """Nodes are the beginnings of tokens; fits: the tokens that end there with their lengths, the longest first."""
        trie: dict[int, int] = {}
        own, levels = [()], []
        for spelled, i in self.id_of.items():
            node = 0
            for depth, c in enumerate(spelled):
                nxt = trie.get(node << 8 | c)
                if nxt is None:
                    nxt = trie[node << 8 | c] = len(own)
                    own.append(())
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((node, c, nxt))
                node = nxt
            if spelled:
                own[node] = ((len(spelled), i),)
        self.trie, self.steps, self.fits, self.fail = trie, dict(trie), own, [0] * len(own)
        for level in levels:
            for node, c, nxt in level:
                if node:
                    self.fail[nxt] = self._beyond(node, c)
                    self.fits[nxt] += self.fits[self.fail[nxt]]

    def _beyond(self, node: int, c: int) -> int:
        """The node after c where `node` itself has no such child or its own is not meant."""
        while node:
            node = self.fail[node]
            if (nxt := self.trie.get(node << 8 | c)) is not None:
                return nxt
        return 0

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that touch one end while `token` grows, each with the rank at which it is merged away."""
        out: list[tuple[int, float]] = [(token, float("inf"))]
        while token in self.parts:
            *pair, r = self.parts[token]
            token = pair[side]
            out.append((token, r))
        return out[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay as they are. At equal ranks the leftmost merge goes first."""
        left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while i < len(left) and j < len(right):
            (x, gone_x), (y, gone_y) = left[i], right[j]
            r = self.rank.get((x, y))
            if r is not None and r < gone_x and r <= gone_y:
                return False
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1
        return True

    def learn(self, fresh: list[str]) -> None:
        """Puts the ids of distinct words into the memo, depth first over their trie."""
        steps, fits, agree, four, memo = self.steps, self.fits, self.agree, self.four, self.memo
        state, back, nodes, last = [-1], [0], [0], b""  # by length of the prefix: last token, where it starts, node
        for spelled, word in sorted([(w.encode(), w) for w in fresh]):
            shared = 0
            for x, y in zip(last, spelled):  # noqa: B905
                if x != y:
                    break
                shared += 1
            end = shared + 1
            del state[end:], back[end:], nodes[end:]
            node = nodes[-1]
            for c in spelled[shared:]:
                key = node << 8 | c
                node = steps.get(key)
                if node is None:
                    node = self._beyond(key >> 8, c)
                    if len(steps) < STEPS:
                        steps[key] = node
                for length, t in fits[node]:
                    start = end - length
                    if start:
                        pair = state[start] << 32 | t
                        fit = agree.get(pair)
                        if fit is None:
                            fit = agree[pair] = self.compatible(state[start], t)
                        if not fit:
                            continue
                    state.append(t)
                    back.append(start)
                    nodes.append(node)
                    break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                end += 1
            last, end = spelled, len(spelled)
            ids = [four[state[end]]]
            while end := back[end]:
                ids.append(four[state[end]])
            memo[word] = b"".join(ids[::-1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = []
        for text in texts:
            at, pieces = 0, []
            for m in self.split.finditer(text) if self.split else ():
                pieces += [text[at : m.start()], self.added[m[0]]]
                at = m.end()
            cut.append([*pieces, text[at:]] if at else [text])
        found = [[p if isinstance(p, int) else (self.plain if p.isascii() else self.pattern).findall(p) for p in pieces] for pieces in cut]
        distinct = set().union(*(p for pieces in found for p in pieces if not isinstance(p, int)))
        if len(self.memo) + len(distinct) > MEMO:
            self.memo.clear()
        if len(self.agree) > PAIRS:
            self.agree.clear()
        self.learn(list(distinct.difference(self.memo)))
        ready = self.memo.__getitem__
        return [b"".join([self.four[p] if isinstance(p, int) else b"".join(map(ready, p)) for p in pieces]) for pieces in found]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The spelled bytes of the ids of each text, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        each = np.frombuffer(b"".join(ids), "<u4")
        size, raw = self.size[each], []
        if not self.known[each].all():
            raise ValueError("no such token")
        for lo in range(0, len(each), TOKENS):
            length = size[lo : lo + TOKENS]
            ends = np.cumsum(length)
            raw.append(self.blob[np.repeat(self.start[each[lo : lo + TOKENS]] - ends + length, length) + np.arange(ends[-1])].tobytes())
        whole, at = b"".join(raw), np.concatenate([[0], np.cumsum(size)])
        cuts = at[np.cumsum([0] + [len(x) // 4 for x in ids])].tolist()
        return [whole[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    """Kept by a worker for its next tasks."""
    return Encoder(definition)


def encode(docs: DataFrame, tokenizer: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, if keep_ids), ids_sha256, decoded (string, if keep_ids), decoded_sha256.

    tokenizer: path of a tokenizers JSON on the driver; its bytes travel with the tasks through Spark's files.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            coder = _encoder(f.read())
        for batch in batches:
            _, offsets = common.utf8(batch.column("text"))
            for lo, hi in common.blocks(offsets):
                part = batch.slice(lo, hi - lo)
                ids = coder.encode([t or "" for t in part.column("text").to_pylist()])
                back = coder.decode(ids)
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": [common.sha(x) for x in ids],
                    "decoded_sha256": [common.sha(x) for x in back],
                }
                if keep_ids:
                    columns |= {"ids": pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), "decoded": [x.decode() for x in back]}
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return common.texts(docs).mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    return encode(docs, tokenizer, keep_ids=False).select("doc_id", "n_tokens", F.col("ids_sha256"), F.col("decoded_sha256"))
