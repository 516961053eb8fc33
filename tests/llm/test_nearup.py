import random
import re

import numpy as np

from wavecairn.llm import common, nearup
from wavecairn.llm.queries import op8_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def brute(rows, size=3, percent=85):
    """rows: (doc_id, text). Components of the exact similarity graph by inverted lists."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    for k, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in where[g]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = root(k)
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def same(got, want):
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = op8_minhash(spark, d).collect()
    rows = [(r.doc_id, r.text) for r in common.documents(spark, d).select("doc_id", "text").collect()]
    same(got, brute(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(nearup, "BLOCK", 7)
    monkeypatch.setattr(nearup, "PAIRS", 3)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (None, "one two"), (1005, "one two"), (1006, "É É É É"), (1007, "é é é é"), (5, "x " * 50_000)]
    base = [rng.choice(words) for _ in range(80)]
    for k in range(60):  # drifts slowly: neighbours are similar, ends are not
        base[rng.randrange(80)] = rng.choice(words)
        rows.append((k, " ".join(base)))
    for k in range(100, 160):  # copies with a few edits each
        own = base[:]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(80)] = rng.choice(words)
        rows.append((k, " ".join(own)))
    rows += rows[20:25]
    docs = spark.createDataFrame([(i, t, "c", 1, "b") for i, t in rows], "doc_id long, text string, class string, packed int, component string")
    got = nearup.dedup(docs).collect()
    same(got, brute(rows))
    left = nearup.survivors(docs, 3, 85)
    assert left.columns == docs.columns
    heads = {c for i, n, c in brute(rows) if n} | {1000, 1001, 1002}
    assert sorted(r.doc_id for r in left.collect()) == sorted(heads)
    assert nearup.dedup(docs.limit(0)).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000, dtype=np.int64).astype(np.uint64)
    for keep in (1000, 900, 700, 400, 0):
        y = np.concatenate([x[:keep], rng.integers(0, 2**63, 1000 - keep, dtype=np.int64).astype(np.uint64)])
        one, two = (np.frombuffer(nearup.pack(nearup.minima(s)), np.uint8) for s in (x, y))
        assert abs(nearup.estimate(one, two[None])[0] - keep / (2000 - keep)) < 0.16


def test_frequent_keys_go_either_way(spark, monkeypatch):
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*words[:200], f"own{k}"])) for k in range(150)] + [(900, " ".join(words[100:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 10**9):
        monkeypatch.setattr(common, "HOT", hot)
        same(nearup.dedup(docs).collect(), brute(rows))


def test_survivors_with_any_column_names(spark):
    rows = [(1, "a b c d e f", 2, 5, 6, {"x": 1}), (1, "a b c d e f", 1, 5, 6, {"x": 1}), (2, "a b c d e f", 0, 5, 6, None), (None, None, 3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `__key` int, row int, `c``d` map<string,int>")
    left = nearup.survivors(docs)
    assert left.schema.names == docs.schema.names
    assert sorted((str(r.doc_id), r["a.b"]) for r in left.collect()) == [("1", 1), ("None", 3)]
