import math
import zlib

import numpy as np

from wavecairn.llm import common, quality
from wavecairn.llm.queries import op1_quality


def test_held_out_accuracy_and_rule(spark):
    d = "/root/testdata/sf0.01"
    rows = op1_quality(spark, d).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == common.documents(spark, d).count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    assert sum((s >= 0.5) == q for s, q in held) / len(held) > 0.93


def test_equal_texts_score_alike_and_odd_rows(spark):
    rows = [(k, ("some clean words of the text. " if k % 2 else "##$$ %%% *** ") * (k % 7 + 1), k) for k in range(40)]
    docs = spark.createDataFrame([*rows, (40, None, 0), (41, "", 0), (None, "the words", 0), (1, rows[1][1], 5), (50, "x" * 300_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, 0), (99, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 45 and len({r.score for r in got if r.doc_id == 1}) == 1
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 5}
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_query_against_the_plain_method(spark):
    """The ranking is the one minimum of its loss, the threshold the best quantile, and every row scores as worked out one by one."""
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in common.documents(spark, d).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    learned = [i for i in truth if i in texts and truth[i] in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    x = np.array([[*(m := quality.measures(texts[i])), *(v * v for v in m)] for i in learned])
    y = np.array([truth[i] for i in learned])
    order = np.lexsort((*x.T[::-1], y))
    x, y = x[order], y[order]
    model = quality.train(common.documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))
    mean, scale = x.mean(0), x.std(0)
    z = np.clip((x - mean) / np.where(scale > 1e-9, scale, np.inf), -8, 8)
    a, b = quality.pairs(y)
    # the loss is convex, so a slope of nothing is its minimum
    slope, w = np.zeros(len(mean)), model["weights"]
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        assert y[i] == 1 and y[j] == 0
        slope += (z[i] - z[j]) / (1 + math.exp((z[i] - z[j]) @ w))
    assert np.abs(slope / len(a) - quality.RIDGE * w).max() < 1e-6
    strength = z @ w
    cuts = [np.quantile(strength, q) for q in np.linspace(0, 1, 401)]
    errors = [np.mean(strength[y == 1] < c) + np.mean(strength[y == 0] >= c) for c in cuts]
    own = np.mean(strength[y == 1] < model["threshold"]) + np.mean(strength[y == 0] >= model["threshold"])
    assert own <= min(errors) + 1e-9
    for r in op1_quality(spark, d).collect():
        v = np.array([*(m := quality.measures(texts[r.doc_id])), *(c * c for c in m)])
        s = np.clip((v - mean) / np.where(scale > 1e-9, scale, np.inf), -8, 8) @ w - model["threshold"]
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-500, min(500, s)))), rel_tol=1e-6, abs_tol=1e-12)
