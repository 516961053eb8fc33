"""Which strategy a search runs with, from a sample and fixed costs, so that equal inputs get equal plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Row

from ..config import Switches
from ..functions import kernels
from ..operators.search import SPAN, blocks, slices

#: FFT must cost less than this share of a scan. The shares of sampled windows under which the index and lower bounds pay are session settings.
FFT_SHARE = 0.9
#: Windows to sample, and relative costs of a multiply-add in the scan and of a point and level in the FFT.
SAMPLE, SCAN_COST, FFT_COST = 65_536, 1.0, 24.0
#: Templates that are tried on the sample.
TRIED = 64


def decide(series: DataFrame, templates: DataFrame, m: int, bound: float | None, segments: int = 16, span: int = SPAN, k: int | None = None) -> dict:
    """The sampled pass fraction of lower bounds, the costs, and the strategy they lead to.

    Without a bound, that of a template is its k-th least distance in the sample, which the true one does not exceed.
    """
    span = min(span, SPAN)  # long blocks are compared piece by piece
    points = span + m - 1
    scan = SCAN_COST * m
    fft = FFT_COST * np.log2(max(2, points)) * points / span
    fraction = None
    if (bound is not None or k is not None) and m % segments == 0:
        held = blocks(series, m, span)
        most = min(span, SAMPLE)  # windows of a block
        some = held.select("channel", "block", F.slice("v", 1, most + m - 1).alias("v")).orderBy(F.xxhash64("channel", "block")).limit(SAMPLE // most)
        first = next(slices(templates, m), None)
        own, near = [], []
        for row in some.toLocalIterator():  # a bounded sample of blocks
            view, start = kernels.windows(np.array(row["v"]), m)
            if len(view) and first is not None:
                mu, sd = kernels.statistics(view)
                valid = start & (sd > kernels.TINY)
                own.append(kernels.words(view[valid], mu[valid], sd[valid], segments))
                if bound is None:
                    near.append(kernels.cc_to_ed(kernels.correlations(view[valid], first.z[:TRIED], mu[valid], sd[valid]), m))
        passed = total = 0
        if own:
            words = np.concatenate(own)
            each = np.concatenate(near) if near else None
            for g, q in enumerate(kernels.paa(first.z[:TRIED], segments)):
                if np.isnan(q).any() or not len(words):
                    continue
                limit = bound if each is None else np.partition(each[:, g], min(k, len(words)) - 1)[min(k, len(words)) - 1]
                passed += int((kernels.lower_bound(q, words, m) <= limit).sum())
                total += len(words)
        fraction = passed / total if total else 1.0
    switches = Switches.of(series.sparkSession)
    if fraction is not None and fraction <= switches.index_fraction:
        strategy = "index"
    elif fraction is not None and fraction < switches.bound_fraction:
        strategy = "sax"
    else:
        strategy = "fft" if switches.fft and fft < FFT_SHARE * scan else "scan"
    return {"fraction": fraction, "scan_cost": float(scan), "fft_cost": float(fft), "strategy": strategy}


def choose(series: DataFrame, templates: DataFrame, m: int, bound: float | None, segments: int = 16, span: int = SPAN, k: int | None = None) -> str:
    return decide(series, templates, m, bound, segments, span, k)["strategy"]


def decision(series: DataFrame, templates: DataFrame, m: int, bound: float | None, segments: int = 16, span: int = SPAN) -> DataFrame:
    return series.sparkSession.createDataFrame([Row(**decide(series, templates, m, bound, segments, span))], "fraction double, scan_cost double, fft_cost double, strategy string")
