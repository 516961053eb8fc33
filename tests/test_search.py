"""Search against a numpy oracle on an adversarial series, for all strategies, block sizes and offsets."""

import numpy as np
import pytest

from wavecairn.functions import kernels
from wavecairn.operators import index, search

N, M, K = 4096, 64, 5


@pytest.fixture(scope="module")
def fixture(spark):
    rng = np.random.default_rng(734)
    x = rng.standard_normal(N).astype(np.float32).astype(float)
    x[1000:1128] = 0  # constant
    x[2000:2500] *= 1e6  # loud
    x[2500:2900] *= 1e-3  # quiet, right after it
    x[2900:3100] *= 1e-6
    x[3500] = x[3600] = kernels.SENTINEL
    q = [x[s : s + M] for s in (0, 2040, 2600, N - M)] + [rng.standard_normal(M), np.zeros(M)]
    series = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "channel string, pos long, v double").repartition(3).cache()
    templates = spark.createDataFrame([(k, [float(v) for v in a]) for k, a in enumerate(q)], "tid int, v array<double>")
    return x, q, series, templates


def oracle(x, q):
    start = x[: N - M + 1] != kernels.SENTINEL
    w = np.lib.stride_tricks.sliding_window_view(np.where(x == kernels.SENTINEL, 0, x), M)
    c = w - w.mean(1)[:, None]
    norm = np.sqrt((c**2).sum(1))
    out = np.full((len(q), len(w)), -np.inf)
    for k, a in enumerate(q):
        z = a - a.mean()
        if np.sqrt((z**2).mean()) > 1e-12:
            good = start & (norm > 1e-12 * np.sqrt(M))
            out[k, good] = c[good] @ z / (norm[good] * np.sqrt((z**2).sum()))
    return out


def merged(corr, t, o, lo=0, hi=None):
    kept = []
    for p in np.flatnonzero(corr >= t):
        if lo <= p < (hi or len(corr)) and (not o or not kept or p >= kept[-1] + o + 1):
            kept.append(int(p))
    return kept


def nearest(corr, k, o):
    kept = []
    for p in np.lexsort((np.arange(len(corr)), -corr)):
        if np.isfinite(corr[p]) and all(abs(p - y) >= max(o, 1) for y in kept):
            kept.append(int(p))
            if len(kept) == k:
                break
    return kept


@pytest.mark.parametrize(("strategy", "span", "o"), [("scan", 4096, 0), ("scan", 100, 16), ("sax", 512, 16), ("fft", 700, 16), ("index", 512, 16), ("sql", 1, 16), ("auto", 512, 40)])
def test_threshold(fixture, strategy, span, o):
    x, q, series, templates = fixture
    corr = oracle(x, q)
    got = search.threshold_search(series, templates, M, 0.4, o, 1, strategy, 16, span).collect()
    for k in range(len(q)):
        rows = sorted((r for r in got if r.tid == k), key=lambda r: r.counter)
        assert [r.pos for r in rows] == merged(corr[k], 0.4, o), (strategy, k)
        assert np.allclose([r.corr for r in rows], [corr[k][r.pos] for r in rows], atol=1e-9)
        assert [r.counter for r in rows] == list(range(len(rows)))


def test_threshold_by_parts(fixture):
    x, q, series, templates = fixture
    corr = oracle(x, q)
    got = search.threshold_search(series, templates, M, 0.3, 50, 3, "scan").collect()
    w = N // 3
    for k in range(len(q)):
        for g in range(3):
            want = merged(corr[k], 0.3, 50, g * w, N if g == 2 else (g + 1) * w)
            assert [r.pos for r in sorted(got, key=lambda r: r.counter) if r.tid == k and r.part == g] == want


@pytest.mark.parametrize(("strategy", "span", "o"), [("scan", 4096, 0), ("scan", 100, 16), ("sax", 512, 40), ("fft", 700, 16), ("index", 512, 300), ("sql", 1, 16)])
def test_neighbours(fixture, strategy, span, o):
    x, q, series, templates = fixture
    corr = oracle(x, q)
    got = search.knn_search(series, templates, M, K, o, strategy, 16, span).collect()
    for k in range(len(q)):
        rows = sorted((r for r in got if r.tid == k), key=lambda r: r.k)
        want = nearest(corr[k], K, o)
        assert np.allclose([r.corr for r in rows], corr[k][want], atol=1e-9) and len({r.pos for r in rows}) == len(want)
        assert [r.pos for r in rows] == want
        assert [r.k for r in rows] == list(range(1, len(want) + 1))


def test_templates_of_a_channel_in_slices(spark, fixture, monkeypatch):
    x, q, series, templates = fixture
    monkeypatch.setattr(search, "TEMPLATE_BYTES", 8 * M * 2)
    two = series.unionByName(series.withColumn("channel", search.F.lit("d")))
    own = templates.withColumn("channel", search.F.when(search.F.col("tid") % 2 == 0, "c").otherwise("d"))
    corr = oracle(x, q)
    for strategy in ("scan", "sql", "index"):
        got = search.threshold_search(two, own, M, 0.4, 16, 1, strategy).collect()
        for k in range(len(q)):
            for c in "cd":
                want = merged(corr[k], 0.4, 16) if c == "cd"[k % 2] else []
                assert sorted(r.pos for r in got if r.tid == k and r.channel == c) == want
    near = search.knn_search(two, own, M, 3, 20, "scan", pad=True).collect()
    for k in range(5):
        assert [r.pos for r in sorted(near, key=lambda r: r.k) if r.tid == k] == nearest(corr[k], 3, 20)


def test_an_index_is_built_once_and_reads_few_windows(spark, fixture):
    rng = np.random.default_rng(5)
    shape = np.sin(np.arange(M) / 5)
    x = np.concatenate([np.concatenate([shape + 0.01 * rng.standard_normal(M) for _ in range(8)]), np.tile([1.0, -1.0], 1000) + 0.01 * rng.standard_normal(2000)])
    series = spark.createDataFrame([(c, i, float(v)) for c in "cd" for i, v in enumerate(x)], "channel string, pos long, v double")
    templates = spark.createDataFrame([(0, shape.tolist()), (1, [0.0] * M)], "tid int, v array<double>")
    ix = index.build(series, M, 16, 256, leaf_size=20)
    rows = lambda s, q, k, o: sorted((r.channel, r.tid, r.k, r.pos) for r in search.knn_search(s, q, M, k, o, "auto" if s is ix else "scan", span=256).collect())
    own = templates.withColumn("channel", search.F.lit("d"))
    for k, o in ((3, 40), (1, 0), (40, 0), (100, 60)):
        assert rows(ix, templates, k, o) == rows(series, templates, k, o) and rows(ix, own, k, o) == rows(series, own, k, o)
    (part,) = search.slices(templates, M)
    few = ix.postings.join(index.surviving(ix, *part, kernels.cc_to_ed(0.95, M)), ["channel", "leaf"]).agg(search.F.sum(search.F.size("offsets"))).first()[0]
    assert 0 < few < 0.3 * ix.nodes.agg(search.F.sum("size")).first()[0]
    hits = lambda s: sorted((r.channel, r.tid, r.pos) for r in search.threshold_search(s, templates, M, 0.9, 10, span=256, strategy="auto" if s is ix else "scan").collect())
    assert hits(ix) == hits(series)
    with pytest.raises(ValueError):
        search.knn_search(ix, templates, 32, 1)


def test_nodes_are_split_by_spark_first(fixture, monkeypatch):
    _, _, series, _ = fixture
    words = index.summaries(search.blocks(series, M, 512), M, 8, 512)
    plain = sorted(map(str, index.leaves(words, 8, 20).collect()))
    monkeypatch.setattr(index, "GROUP", 100)
    assert sorted(map(str, index.leaves(words, 8, 20).collect())) == plain


def test_blocks_are_searched_as_they_are(fixture):
    x, q, series, templates = fixture
    held = search.blocks(series, M, 512)
    for strategy in ("scan", "sax", "fft", "index", "sql"):
        for of in (lambda s: search.threshold_search(s, templates, M, 0.4, 16, 3, strategy), lambda s: search.knn_search(s, templates, M, 3, 20, strategy, pad=True)):  # noqa: B023
            assert sorted(map(str, [(r.tid, r.pos) for r in of(held).collect()])) == sorted(map(str, [(r.tid, r.pos) for r in of(series).collect()]))
    long = held.where("block = 0").select("channel", "block", "start", search.F.lit(x.tolist()).alias("v"))
    got = search.threshold_search(long, templates, M, 0.4, 0, 1, "scan").collect()
    assert len(search.threshold_search(index.build(held, M), templates, M, 0.4).collect()) == len(got)
    assert len(search.threshold_search(held, templates, M, 0.4, strategy="auto").collect()) == len(got)
    corr = oracle(x, q)
    assert all(sorted(r.pos for r in got if r.tid == k) == merged(corr[k], 0.4, 0) for k in range(len(q)))


def test_windows_are_given_up_early():
    rng = np.random.default_rng(8)
    x = rng.standard_normal(3000)
    view, _ = kernels.windows(x, M)
    mu, sd = kernels.statistics(view)
    z = kernels.znorm(x[77 : 77 + M] * np.linspace(0.1, 3, M))
    order = kernels.energy_order(z)
    assert sorted(np.concatenate(order)) == list(range(M)) and (z[order[0]] ** 2).sum() >= (z[order[-1]] ** 2).sum()
    at = np.arange(len(view))
    ed = (((view - mu[:, None]) / sd[:, None] - z) ** 2).sum(1)
    for bound in (10.0, 90.0, 120.0):
        assert kernels.unabandoned(view, at, mu, sd, z, bound).tolist() == np.flatnonzero(ed <= bound).tolist()
        place, corr = kernels.verified(view, at, mu, sd, z, bound)
        assert place.tolist() == np.flatnonzero(ed <= bound).tolist() and np.allclose(corr, 1 - ed[place] / (2 * M))


def test_padding_and_arguments(fixture):
    x, q, series, templates = fixture
    got = search.knn_search(series.where("pos < 100"), templates, M, 4, 30, "scan", pad=True).collect()
    assert len(got) == 4 * len(q) and all((r.pos is None) == (r["corr"] is None) for r in got)
    for bad in ({"k": 0}, {"o": -1}, {"strategy": "none"}):
        with pytest.raises(ValueError):
            search.knn_search(series, templates, **({"m": M, "k": 1, "o": 0, "strategy": "scan"} | bad))
    with pytest.raises(ValueError):
        search.threshold_search(series, templates, M, 1.5)


def test_lower_bounds_hold_and_leaves_cover():
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.standard_normal(1500))
    view, _ = kernels.windows(x, M)
    mu, sd = kernels.statistics(view)
    z = kernels.znorm(x[300 : 300 + M])[None]
    ed = kernels.cc_to_ed(kernels.correlations(view, z, mu, sd)[:, 0], M)
    for w in (4, 8, 16):
        words = kernels.words(view, mu, sd, w)
        for bits in (8, 4, 1):
            low = kernels.lower_bound(kernels.paa(z, w)[0], words >> (8 - bits), M, bits)
            assert (low <= ed + 1e-6).all()
    assert kernels.smooth_length(11) == 12 and kernels.smooth_length(97) == 98


def test_sums_do_not_depend_on_the_block():
    x = np.random.default_rng(5).integers(0, 9, 700) / 10
    for width in (1, 4, 8, 16, 40, 64):
        every = kernels.sums(x, 0, width)
        assert np.allclose(every, np.lib.stride_tricks.sliding_window_view(x, width).sum(1)) and len(kernels.sums(x[: width - 1], 3, width)) == 0
        for start in (1, 15, 16, 333):
            assert (kernels.sums(x[start : start + 200], start, width) == every[start : start + 201 - width]).all()


def test_leaves_hold_all_windows(fixture):
    _, _, series, _ = fixture
    words = index.summaries(search.blocks(series, M, 512), M, 8, 512)
    nodes = index.leaves(words, 8, 50).collect()
    assert sum(r["size"] for r in nodes) == words.count() and len({(r.root, r.prefix, r.bits) for r in nodes}) == len(nodes)
    split = [r for r in nodes if sum(r.bits) < 64]
    assert all(r["size"] <= 50 for r in split)


def test_switches_change_the_plan_not_the_rows(spark, fixture):
    from wavecairn.config import Switches
    from wavecairn.plans import planner

    _, _, series, templates = fixture
    ix = index.build(series, M, 16, 512)
    rows = lambda: sorted((r.tid, r.k, r.pos) for r in search.knn_search(ix, templates, M, 3, 16).collect())
    want = rows()
    try:
        Switches(fft=False, seed=False).apply(spark)
        assert rows() == want
        assert planner.choose(series, templates, M, None, span=512, k=3) != "fft"
        Switches(index_fraction=1.0).apply(spark)
        assert planner.choose(series, templates, M, None, span=512, k=3) == "index"
    finally:
        Switches().apply(spark)
