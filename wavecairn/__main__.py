"""python -m wavecairn --waveform FILE --templates FILE --window M --mode knn|threshold ..."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .config import SearchConfig, Switches, parse
from .operators import index, search
from .sources import raw, results


def run(spark: SparkSession, c: SearchConfig):
    timers = results.Timers()
    Switches(bool(c.fft), bool(c.seed), c.index_fraction, c.bound_fraction).apply(spark)
    source = raw.read_blocks(spark, c.waveform, c.window, c.span, c.skip, c.dataset_size or None, c.channel)
    with timers.measure("index"):
        if c.strategy == "index":
            source = index.build(source, c.window, c.segments, c.span, c.leaf_size, c.depth)
    with timers.measure("plan"):
        templates = raw.read_templates(spark, c.templates, c.window, c.query_count or None)
        if c.mode == "knn":
            found = search.knn_search(source, templates, c.window, c.neighbours, c.merge_offset, c.strategy, c.segments, c.span, bool(c.pad))
        else:
            found = search.threshold_search(source, templates, c.window, c.threshold, c.merge_offset, c.groups, c.strategy, c.segments, c.span)
    with timers.measure("search"):
        if c.output:
            (results.write_neighbours if c.mode == "knn" else results.write_hits)(found, c.output)
        if c.print_results or not c.output:
            found.orderBy("tid", "k" if c.mode == "knn" else "counter").show(c.print_results or 20, truncate=False)
    if c.timings:
        results.write_table(timers.table(spark), c.timings)
    return found


if __name__ == "__main__":
    run(SparkSession.builder.appName("wavecairn").getOrCreate(), parse(sys.argv[1:]))
