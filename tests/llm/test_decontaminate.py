import random
import re

import numpy as np
import pyarrow as pa

from wavecairn.llm import common, decontaminate
from wavecairn.llm.queries import op4_tiling


def split(text):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).split()


def brute(item, doc, least):
    """Greedy tiling by the book, on words; returns the number of item words covered."""
    least = min(least, len(item))
    mi, md = [False] * len(item), [False] * len(doc)
    while item:
        best = 0
        at = []
        for p in range(len(item)):
            for q in range(len(doc)):
                k = 0
                while p + k < len(item) and q + k < len(doc) and item[p + k] == doc[q + k] and not mi[p + k] and not md[q + k]:
                    k += 1
                if k > best:
                    best, at = k, []
                if k == best and k:
                    at.append((p, q))
        if best < least:
            break
        for p, q in at:
            if not any(mi[p : p + best]) and not any(md[q : q + best]):
                for k in range(best):
                    mi[p + k] = md[q + k] = True
    return sum(mi)


def test_tiling_against_brute_force():
    rng = random.Random(4)
    for _ in range(250):
        item = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))]
        doc = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))]
        for _ in range(2):
            a, b = rng.randrange(len(item)), rng.randrange(len(doc) + 1)
            doc[b:b] = item[a : a + 8]
        code = lambda ws: common.mix(np.array([ord(w) for w in ws], np.uint64))
        got = decontaminate.tiles(code(item), code(doc), 3)
        assert sum(t[2] for t in got) == brute(item, doc, 3)


def test_query_finds_planted_items_and_only_those(spark):
    d = "/root/testdata/sf0.01"
    items = [(r.item_id, split(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in op4_tiling(spark, d).collect()}
    hits = 0
    for r in common.documents(spark, d).collect():
        text = " " + " ".join(split(r.text)) + " "
        whole = [i for i, w in items if " " + " ".join(w) + " " in text]
        hits += bool(whole)
        assert got[r.doc_id].contaminated == bool(whole) or got[r.doc_id].coverage < 1
        if whole:
            assert got[r.doc_id].coverage == 1 and got[r.doc_id].item_id == min(whole)
    assert hits > 5 and sum(r.contaminated for r in got.values()) <= hits * 1.1


def test_reordered_passages_blocks_and_odd_rows(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(40)) for k in range(30)] + [(30, None), (31, ""), (32, "tiny item"), (None, text(20)), (3, text(30))]
    moved = items[3][1].split()
    rows = [(1, text(50) + " " + " ".join(moved[25:] + moved[:25]) + " " + text(30), 7), (2, text(200), 7), (3, None, 7), (4, "", 7), (5, "A TINY, item!", 7), (None, items[-2][1], 7), (6, " ".join(items[8][1].split()[:12]) + text(90), 7), (7, text(60_000) + " " + items[9][1].upper(), 7), (7, text(60), 7)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, coverage int, row int, `a.b` int, `__item` int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    results = []
    for block in (decontaminate.BLOCK, 600, 100):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        results.append(sorted(map(str, decontaminate.scan(docs, bench).collect())))
        assert results[0] == results[-1]
        got = [(r.doc_id, r.item_id) for r in decontaminate.scan(docs, bench).collect() if r.contaminated]
        assert sorted(got, key=str) == sorted([(1, 3), (5, 32), (None, None), (7, 9)], key=str)
        kept = decontaminate.clean(docs, bench)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 7]
    assert decontaminate.scan(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    assert len(decontaminate.word_hashes(pa.array(["a-b c", None]))[0]) == 3


def test_ties_go_to_the_least_item_whatever_the_blocks(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(40))
    items = [(k, f"{text} own{k}") for k in (5, 2, 9, 7)] + [(2, f"{text} again"), (None, f"{text} none")]
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "w1 w2 w3 w4 alone")], "doc_id long, text string")
    for block in (decontaminate.BLOCK, 300, 50):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        got = {r.doc_id: (r.item_id, r.n_tiles, r.contaminated) for r in decontaminate.scan(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
        assert got == {1: (2, 1, True), 2: (None, 0, False)}
