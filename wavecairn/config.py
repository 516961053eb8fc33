"""Settings of a search, and the command line that fills them."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass
class SearchConfig:
    waveform: str = ""
    templates: str = ""
    window: int = 1000
    mode: str = "threshold"
    threshold: float = 0.9
    neighbours: int = 5
    merge_offset: int = 0
    groups: int = 1
    strategy: str = "auto"
    segments: int = 16
    leaf_size: int = 2000
    depth: int = 8
    index_fraction: float = 0.01
    bound_fraction: float = 0.05
    fft: int = 1
    seed: int = 1
    pad: int = 0
    skip: int = 0
    channel: str = "all"
    dataset_size: int = 0
    query_count: int = 0
    span: int = 1 << 16
    output: str = ""
    timings: str = ""
    print_results: int = 0

    def checked(self) -> SearchConfig:
        from .operators.search import check

        if self.mode not in ("knn", "threshold"):
            raise ValueError("the mode is knn or threshold")
        check(self.window, self.segments, self.neighbours, self.threshold, self.merge_offset, self.groups, self.strategy)
        return self


@dataclass
class Switches:
    """What a session turns on or off: spark.wavecairn.fft, .seed, .indexFraction, .boundFraction."""

    fft: bool = True
    seed: bool = True
    index_fraction: float = 0.01
    bound_fraction: float = 0.05

    @classmethod
    def of(cls, spark: SparkSession) -> Switches:
        get = lambda name, default: spark.conf.get(f"spark.wavecairn.{name}", str(default))
        return cls(get("fft", True).lower() == "true", get("seed", True).lower() == "true", float(get("indexFraction", cls.index_fraction)), float(get("boundFraction", cls.bound_fraction)))

    def apply(self, spark: SparkSession) -> None:
        for name, value in (("fft", self.fft), ("seed", self.seed), ("indexFraction", self.index_fraction), ("boundFraction", self.bound_fraction)):
            spark.conf.set(f"spark.wavecairn.{name}", str(value))


def parse(arguments: list[str]) -> SearchConfig:
    parser = argparse.ArgumentParser(prog="wavecairn", description="Exact subsequence search of templates in a float32 waveform.")
    for f in fields(SearchConfig):
        parser.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    return SearchConfig(**vars(parser.parse_args(arguments))).checked()
