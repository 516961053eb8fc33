"""Names for SQL: znorm, paa, sax and correlation of arrays as Arrow functions, and windows of an array as a table function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from . import kernels


def register(spark: SparkSession) -> None:
    @pandas_udf("array<double>")
    def wave_znorm(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None else [None if np.isnan(x) else float(x) for x in kernels.znorm(np.asarray(a, float))])

    @pandas_udf("array<double>")
    def wave_paa(v: pd.Series, segments: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else kernels.paa(np.asarray(a, float)[None], int(s))[0].tolist() for a, s in zip(v, segments, strict=True)])

    @pandas_udf("binary")
    def wave_sax(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None else kernels.sax(np.asarray(a, float)).tobytes())

    @pandas_udf("double")
    def wave_mindist(means: pd.Series, word: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([float(kernels.lower_bound(np.asarray(a, float), np.frombuffer(w, np.uint8), int(k))) for a, w, k in zip(means, word, m, strict=True)])

    @pandas_udf("double")
    def wave_corr(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            r = float(kernels.znorm(np.asarray(x, float)) @ kernels.znorm(np.asarray(y, float)) / len(x))
            return None if np.isnan(r) else r

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    @udtf(returnType="pos long, mean double, deviation double")
    class WaveWindows:
        def eval(self, v: list, m: int):
            view, start = kernels.windows(np.asarray(v, float), m)
            mu, sd = kernels.statistics(view)
            for k in np.flatnonzero(start).tolist():
                yield k, float(mu[k]), float(sd[k])

    for f in (wave_znorm, wave_paa, wave_sax, wave_mindist, wave_corr):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("wave_windows", WaveWindows)
