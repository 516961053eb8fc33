"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is linear in measures of its whole text. The chance that a document labelled 1 is
preferred to one labelled 0 is the logistic function of the difference of their strengths, so the weights
come from logistic loss on feature differences of preference pairs. A quantile of the training strengths
is the threshold; a score is the logistic function of strength less threshold, so 0.5 is that quantile.

Labels are learned from at most TRAINING rows, those with the least hash of their id: a bound on what
reaches the driver, beyond which the few dozen weights no longer change. Scoring covers every row and
never sees labels, lang, source or doc_id.

Null and empty texts have all measures 0 and are scored like any other. Labels that are null, lack their
document, or contradict each other (rows of one doc_id with both values) are not learned from. Without
both classes the weights are 0 and every score is 0.5. Repeated rows are scored alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows to learn from, preference pairs drawn from them, strength of the ridge penalty.
TRAINING, PAIRS, RIDGE = 20_000, 200_000, 1e-4

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se avec ce il sont "
    "el los y del se las por con no su para al lo como más o pero sus le".split()
)
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256), "space": (32,), "line": (10,),
    "stop": b".", "comma": b",;:", "bang": b"!?", "symbol": b"#$%&*@^~+=<>", "bar": b"|_/\\", "quote": b"\"'()[]{}`",
}
_GROUP = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _GROUP[list(_members), _k] = 1
_STOP = re.compile(r"[.!?\n]\s*")
NAMES = [
    *_CLASSES, "log_bytes", "log_words", "word_length", "distinct", "top_word", "function", "distinct_lines", "line_words",
    "deflate", "marked_words", "short_words", "sentence_words", "distinct_sentences", "longest_word", "empty",
]


def measures(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _GROUP / n
    words = text.lower().split()
    w = len(words)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x]
    sentences = [x for x in _STOP.split(text) if x]
    clean = sum(c for x, c in count.items() if x.isalpha())
    per = 1 / max(w, 1)
    return [
        *shares.tolist(), np.log1p(n), np.log1p(w), n * per, len(count) * per, max(count.values(), default=0) * per,
        sum(c for x, c in count.items() if x.strip(".,") in FUNCTION_WORDS) * per, len(set(lines)) / max(len(lines), 1), np.log1p(w / max(len(lines), 1)),
        len(zlib.compress(raw, 1)) / (n + 50), 1 - clean * per,
        sum(c for x, c in count.items() if len(x) < 3) * per, np.log1p(w / max(len(sentences), 1)),
        len(set(sentences)) / max(len(sentences), 1), np.log1p(max(map(len, count), default=0)), 0.0,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    """Measures and their squares, one row for each text."""
    x = np.array([measures(t) for t in texts], float).reshape(len(texts), len(NAMES))
    return np.hstack([x, x * x])


def pairs(labels: np.ndarray, most: int = PAIRS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of preferred and other documents: every preferred row and every other row equally often, in random order."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    n = min(most, len(good) * len(bad))
    if not n:
        return good[:0], bad[:0]
    rng = np.random.default_rng(seed)
    deal = lambda rows: rng.permutation(np.resize(rows, n))
    return deal(good), deal(bad)


def fit(x: np.ndarray, labels: np.ndarray) -> dict:
    """Newton's method on logistic loss of differences; the threshold is the quantile that errs least on the training rows."""
    mean, scale = x.mean(0) if len(x) else np.zeros(x.shape[1]), x.std(0) if len(x) else np.ones(x.shape[1])
    scale = np.where(scale > 1e-9, scale, np.inf)
    z = np.clip((x - mean) / scale, -8, 8)
    a, b = pairs(labels)
    weights = np.zeros(x.shape[1])
    if not len(a):
        return {"mean": mean, "scale": scale, "weights": weights, "threshold": 0.0, "quantile": 0.0}
    diff = z[a] - z[b]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ weights, -30, 30)))
        slope = diff.T @ (1 - p) / len(a) - RIDGE * weights
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(a) + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ weights
    order = np.sort(strength)
    grid = np.linspace(0, 1, 401)
    cuts = np.quantile(order, grid)
    good, bad = np.sort(strength[labels == 1]), np.sort(strength[labels == 0])
    wrong = np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = best[len(best) // 2]
    return {"mean": mean, "scale": scale, "weights": weights, "threshold": float(cuts[k]), "quantile": float(grid[k])}


def strengths(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["weights"] - model["threshold"]


def train(docs: DataFrame, labels: DataFrame, training: int = TRAINING) -> dict:
    """A model from labelled rows outside the held-out third; measures are taken on the executors."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .where(common.crc_mod(F.col("doc_id"), 3) != 1)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(training)
        .select("doc_id", "quality")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                x = matrix(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"quality": part.column("quality"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    # at most `training` rows of two integers are broadcast
    got = common.texts(docs).join(F.broadcast(known), "doc_id").select("text", "quality").mapInArrow(run, "quality int, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), float).reshape(-1, 2 * len(NAMES))
    y = np.array(got.column("quality").to_pylist(), int)
    order = np.lexsort((*x.T[::-1], y))  # rows arrive in any order; the model must not depend on it
    return fit(x[order], y[order])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with the columns score and predicted added behind doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                s = strengths(model, matrix(part.column("text").to_pylist()))
                p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": p, "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return common.texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return score(docs, model).select("doc_id", (common.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs without the rows that the model rejects; all their columns stay as they are. labelled: rows to learn from, if not docs."""
    model = train(docs if labelled is None else labelled, labels)
    names = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                keep = strengths(model, matrix(part.column("text").to_pylist())) >= 0
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, names)
