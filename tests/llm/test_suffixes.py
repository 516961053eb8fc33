import hashlib
import random

import numpy as np

from wavecairn.llm import common, suffixes


def naive(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


def test_induced_sorting_and_common_prefixes():
    rng = random.Random(2)
    cases = [b"", b"a", b"aa", b"ab", b"ba", b"mississippi", b"abracadabra" * 9, b"a" * 300, b"ab" * 200, bytes(range(255, -1, -1)), b"abcab\xffabcab\xff" * 5]
    cases += [bytes(rng.choice(rng.choice([b"ab", b"abc", b"abcdefgh", bytes(range(256))])) for _ in range(rng.randrange(1, 600))) for _ in range(150)]
    cases.append(b"".join(rng.choice([b"foo", b"bar", b"foobar", b"x"]) for _ in range(2000)) * 2)
    for text in cases:
        sa = suffixes.suffix_array(np.frombuffer(text, np.uint8))
        assert sa.tolist() == naive(text), text[:50]
        assert suffixes._sort_names(list(text)) == naive(text)
        if len(text) > 1:
            ahead, behind = suffixes.permuted_lcp(np.frombuffer(text, np.uint8), sa)
            order = sa.tolist()
            for r in range(len(text)):
                i = order[r]
                for j, got in ((order[r - 1] if r else None, ahead[i]), (order[r + 1] if r + 1 < len(order) else None, behind[i])):
                    k = 0
                    while j is not None and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                        k += 1
                    assert got == k


def brute(rows, length):
    """rows: (doc_id, text): the contract, by counting all strings of this length."""
    raw = [(t or "").encode() for _, t in rows]
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            w = hash(b[i : i + length])
            count[w] = count.get(w, 0) + 1
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[hash(b[k : k + length])] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = [k for k in range(len(b)) if gone[k] and not (k and gone[k - 1])]
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def key(x):
    return tuple((v is None, v) for v in x)


def same(df, rows, length=400, passage=300):
    """The contract's columns, and the passages: the spans of a shorter length."""
    want = [(*x, y[3]) for x, y in zip(brute(rows, length), brute(rows, passage), strict=True)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages) for r in df.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_whole_table_against_brute_force(spark, sf_dir):
    from wavecairn.llm.queries import op10_suffixes

    rows = [(r.doc_id, r.text) for r in common.documents(spark, sf_dir).collect()]
    same(op10_suffixes(spark, sf_dir), rows)


def test_shared_passages_slices_and_odd_rows(spark, monkeypatch):
    rng = random.Random(8)
    for name, value in (("SLICE", 1 << 12), ("SHARD", 5000), ("LEAD", 512), ("MANY", 4)):
        monkeypatch.setattr(suffixes, name, value)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [make(rng.randrange(300, 900)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, make(700)), (4, "a" * 1500), (5, "ab" * 900), (6, make(9000))]
    rows += [(k, make(rng.randrange(300)) + rng.choice(passages) + make(rng.randrange(600)) + rng.choice(passages)[: rng.randrange(900)] + make(50)) for k in range(10, 50)]
    rows += [rows[10], (99, rows[12][1]), (100, rows[7][1][2000:6000])]
    docs = spark.createDataFrame([(i, t, "c", 3) for i, t in rows], "doc_id long, text string, class string, n_bytes int")
    same(suffixes.dedup(docs), rows)
    same(suffixes.dedup(docs, 300, 500), rows, 300, 300)
    assert suffixes.dedup(docs.limit(0)).count() == 0
