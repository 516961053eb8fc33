"""Matching of samples as they arrive: a state of the last window less one of each channel.

Input rows are (channel, pos, v); rows of a channel may come in any order within a micro-batch, and positions
already passed are dropped, as repeated chunks of an archive are. A gap in positions starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels


def threshold_stream(samples: DataFrame, ids: np.ndarray, z: np.ndarray, t: float) -> DataFrame:
    """channel, tid, pos, corr of windows that are completed by new samples and reach t."""
    m = z.shape[1]
    bound = np.full(len(ids), kernels.cc_to_ed(t, m))

    def match(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, nxt = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(list(frames)).drop_duplicates("pos").sort_values("pos")
        pos, v = rows["pos"].to_numpy(), rows["v"].to_numpy(float)
        if nxt is not None:
            pos, v = pos[pos >= nxt], v[pos >= nxt]
        out = []
        cuts = np.flatnonzero(np.diff(pos) != 1) + 1
        for p, x in zip(np.split(pos, cuts), np.split(v, cuts), strict=True):
            if not len(p):
                continue
            if nxt is None or p[0] != nxt:
                held = []
            joined = np.concatenate([held, x])
            i, j, corr = kernels.matches(joined, z, bound)
            out.append(pd.DataFrame({"channel": key[0], "tid": ids[j], "pos": i + p[0] - len(held), "corr": corr}))
            held, nxt = joined[-(m - 1) :].tolist() if m > 1 else [], int(p[-1]) + 1
        if nxt is not None:
            state.update((held, nxt))
        yield pd.concat(out) if out else pd.DataFrame({"channel": [], "tid": [], "pos": [], "corr": []})

    return samples.groupBy("channel").applyInPandasWithState(match, "channel string, tid int, pos long, corr double", "held array<double>, nxt long", "append", GroupStateTimeout.NoTimeout)
