import numpy as np
import pytest

from wavecairn.functions import kernels, udfs
from wavecairn.operators import etl, evaluate, search
from wavecairn.sources import raw, results
from wavecairn.sources import series as S
from wavecairn.streaming.incremental import threshold_stream


def test_raw_files_round_trip(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal(5000).astype("<f4")
    path = str(tmp_path / "a.len5000.bin")
    x.tofile(path)
    assert raw.float_counts(spark, path).first().samples == 5000
    s = raw.read_series(spark, path, span=700)
    got = s.orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(5000)) and np.allclose([r.v for r in got], x)
    held = raw.read_blocks(spark, path, m=64, span=512, channel="c")
    want = search.blocks(s.select(search.F.lit("c").alias("channel"), "pos", "v"), 64, 512)
    assert sorted((r.block, r.start, r.v) for r in held.collect()) == sorted((r.block, r.start, r.v) for r in want.collect())
    assert raw.read_series(spark, path, span=700, first=100, limit=50).count() == 50
    assert raw.read_templates(spark, path, 1000, 3).count() == 3
    copy = str(tmp_path / "b.bin")
    assert raw.write_float32(s, copy) == 5000 and open(copy, "rb").read() == x.tobytes()
    open(copy, "ab").write(b"x")
    with pytest.raises(Exception, match="float32"):
        raw.float_counts(spark, copy).collect()


def test_names_and_inventory(spark):
    files = spark.createDataFrame([("d/k1.len5.bin", 20), ("d/k2.len5.bin", 24), ("e/k1.len5.bin", 20), ("d/readme", 1)], "path string, length long")
    assert sorted((r.key, r.issue) for r in raw.discovered(files).collect()) == [("k1", "duplicate"), ("k1", "duplicate"), ("k2", "size")]
    paths = spark.createDataFrame([("r/2010/N/S/HHZ.D/N.S.00.HHZ.D.2010.060",), ("r/N.S.00.HHZ.D.2010.001",), ("r/N.S.00.LHZ.D.2010.001",), ("x",)], "path string")
    (row,) = raw.inventory(spark, paths).collect()
    assert (row.channel, row.t_start.isoformat(), row.t_end.isoformat()) == ("HHZ", "2010-01-01T00:00:00", "2010-03-02T00:00:00")


def test_results_round_trip(spark, tmp_path):
    hits = spark.createDataFrame([("c", 0, 0, 0, 5, 0.5), ("c", 1, 1, 0, 9, 0.25)], "channel string, tid int, part int, counter long, pos long, corr double")
    results.write_hits(hits, str(tmp_path / "h"))
    assert sorted(tuple(r) for r in results.read_hits(spark, str(tmp_path / "h")).collect()) == [(0, 0, 5, 0.5), (1, 0, 9, 0.25)]
    near = hits.selectExpr("tid", "cast(1 as long) as k", "pos", "corr")
    results.write_neighbours(near, str(tmp_path / "n"))
    back = results.read_neighbours(spark, str(tmp_path / "n"))
    assert [tuple(r) for r in back.collect()] == [(0, 1, 5, 0.5), (1, 1, 9, 0.25)]
    assert {tuple(r.issues) for r in evaluate.lint(back.withColumnRenamed("tID", "tid"), 2).collect()} == {("rows", "ranks")}
    timers = results.Timers()
    with timers.measure("a"):
        pass
    assert timers.table(spark).first().name == "a"


def test_positions_without_one_big_task(spark):
    rows = [(k * 7919 % 1000, "ab"[k % 2], float(k)) for k in range(1000)]
    df = spark.createDataFrame(rows, "o int, c string, v double").repartition(5)
    got = {(r.o, r.pos) for r in S.with_positions(df, ["o"]).collect()}
    assert got == {(o, o) for o, _, _ in rows}
    by = S.with_positions(df, ["o"], "c").collect()
    for c in "ab":
        own = sorted(o for o, x, _ in rows if x == c)
        assert {(r.o, r.pos) for r in by if r.c == c} == {(o, k) for k, o in enumerate(own)}


def test_unpacked_and_udfs(spark):
    flat = spark.createDataFrame([([1.0, 2.0, 3.0, 5.0],)], "values array<double>")
    assert sorted((r.tid, r.v) for r in S.unpacked(flat, 2).collect()) == [(0, [1.0, 2.0]), (1, [3.0, 5.0])]
    with pytest.raises(Exception, match="whole number"):
        S.unpacked(flat, 3).collect()
    udfs.register(spark)
    row = spark.sql("select wave_znorm(array(1D, 3D)) z, wave_paa(array(1D, 3D, 5D, 7D), 2) p, wave_corr(array(1D, 2D, 4D), array(2D, 4D, 8D)) c, hex(wave_sax(array(-9D, 0D, 9D))) s").first()
    assert row.z == [-1.0, 1.0] and row.p == [2.0, 6.0] and abs(row.c - 1) < 1e-12 and row.s == "007FFF"
    assert spark.sql("select count(*) from wave_windows(array(1D, 2D, 3D, 4D), 2)").first()[0] == 3


def test_cleaning(spark):
    s = spark.createDataFrame([("a", 0, float("nan")), ("a", 1, 2.0), ("a", 2, float("inf")), ("a", 3, 4.0)], "channel string, pos long, v double")
    r = etl.amplitude(s).first()
    assert (r.finite_points, r.nan_points, r.inf_points, r["min"], r["max"], r["mean"]) == (2, 1, 1, 2.0, 4.0, 3.0)
    t = np.arange(2000) / 50
    mixed = np.sin(2 * np.pi * 0.1 * t) + np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 20 * t)
    out = etl._recursive(etl._recursive(mixed, etl._sections(1, 10, 50, 4))[::-1], etl._sections(1, 10, 50, 4))[::-1]
    assert np.abs(out - np.sin(2 * np.pi * 5 * t))[300:-300].max() < 0.1
    gaps = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 4.0, 2.0)], "channel string, ts double, v double")
    assert sorted(r.ts for r in etl.gap_fill(gaps, 1.0).where("filled").collect()) == [2.0, 3.0]
    rows = spark.createDataFrame([("HHZ",), ("HHN",), ("BHZ",)], "cha string")
    assert etl.selected(rows, cha=["HH*"]).count() == 2 and etl.selected(rows, cha=None).count() == 3
    assert sorted(r.cha for r in etl.strided(rows, ["cha"], 0, 2).collect()) == ["BHZ", "HHZ"]


def test_agreement_and_tolerance(spark):
    a = spark.createDataFrame([(0, 10, 0.9), (0, 30, 0.50005), (1, 5, 0.8), (2, 1, 0.7)], "query int, pos long, corr double")
    b = spark.createDataFrame([(0, 10, 0.9), (1, 6, 0.8), (2, 1, 0.7)], "query int, pos long, corr double")
    assert {r.query: r.verdict for r in evaluate.agreement(a, b, 0.5, 4).collect()} == {0: "boundary", 1: "different", 2: "same"}
    # a common hit explains nothing: only detections of one side form chains
    c = spark.createDataFrame([(0, 10, 0.50001), (0, 13, 0.9)], "query int, pos long, corr double")
    assert [r.verdict for r in evaluate.agreement(c, c.where("pos = 10"), 0.5, 4).collect()] == ["different"]
    assert [r.verdict for r in evaluate.agreement(c, c.limit(0), 0.5, 4).collect()] == ["boundary"]
    n = spark.createDataFrame([(0, 1, 5, 0.9), (1, 1, 5, 0.9), (2, 1, 5, 0.9), (3, 1, 5, 0.9)], "query int, k long, pos long, corr double")
    o = spark.createDataFrame([(0, 1, 5, 0.9), (1, 1, 6, 0.90001), (2, 1, 6, 0.8)], "query int, k long, pos long, corr double")
    assert {r.query: r.verdict for r in evaluate.neighbour_agreement(n, o).collect()} == {0: "same", 1: "tie", 2: "different", 3: "different"}
    assert sorted(tuple(r) for r in evaluate.tolerant_matches(a, b, 2).collect()) == [(0, 10, 10), (1, 5, 6), (2, 1, 1)]
    assert evaluate.symmetric_difference(a.select("query", "pos"), b.select("query", "pos")).count() == 3


def test_evenly_spaced_cases(spark):
    cases = spark.createDataFrame([(k, k * 10) for k in range(10)], "key long, samples long")
    keys = lambda *a, **b: sorted(r.key for r in evaluate.evenly_spaced(cases, *a, **b).collect())
    assert keys(1) == [5] and keys(0) == keys(10) == keys(99) == list(range(10)) and keys(3) == [0, 4, 9] and keys(2, least=45) == [5, 9] and keys(1, least=1000) == []


def test_writers_and_counters(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(3000)
    series = spark.createDataFrame([("c", k, float(v)) for k, v in enumerate(x)], "channel string, pos long, v double").repartition(4)
    path = str(tmp_path / "w.bin")
    assert raw.write_float32(series, path, span=700) == 3000 and np.array_equal(np.fromfile(path, "<f4"), x.astype("<f4"))
    templates = S.cut(series, [5, 100, 700], 32)
    assert raw.write_templates(templates, path, 32, many=2) == 3
    assert [r.v for r in raw.read_templates(spark, path, 32).orderBy("tid").collect()] == [x[s : s + 32].astype("<f4").tolist() for s in (5, 100, 700)]
    with pytest.raises(Exception, match="another length"):
        raw.write_templates(templates, path, 31)
    counters = results.Counters()
    counters.watch(series, samples=search.F.count("*"), loud=search.F.count_if(search.F.col("v") > 100)).write.format("noop").mode("overwrite").save()
    assert {r.name: r["count"] for r in counters.table(spark).collect()} == {"samples": 3000, "loud": 0}


def test_bandpass_against_the_recursion_whatever_the_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal(5000)
    series = spark.createDataFrame([(c, k, float(v)) for c in "ab" for k, v in enumerate(x)], "channel string, pos long, v double")
    sections, pad = etl._sections(1, 10, 50, 4), np.zeros(4000)
    want = etl._recursive(etl._recursive(np.concatenate([pad, x, pad]), sections)[::-1], sections)[::-1][4000:-4000]
    for span in (300, 4096):
        got = etl.bandpass(series, 1, 10, 50, span=span).orderBy("channel", "pos").collect()
        assert [(r.channel, r.pos) for r in got] == [(c, k) for c in "ab" for k in range(5000)]
        assert np.abs(np.array([r.v for r in got]).reshape(2, -1) - want).max() < 1e-6


def test_generation_and_reproducible_noise(spark, tmp_path):
    rng = np.random.default_rng(2)
    series = spark.createDataFrame([(c, k, float(v)) for c in ("N.S.HHZ", "N.S.HHN") for k, v in enumerate(rng.standard_normal(2000))], "channel string, pos long, v double")
    told = {r.channel: r for r in etl.generate(series, str(tmp_path), 50, 1, 10, 2, "d").collect()}
    assert told["N.S.HHZ"].number_of_points == 1000 and told["N.S.HHZ"].frequency.sampling_rate_hz == 25
    want = [r.v for r in etl.prepared(series, 50, 1, 10, 2).where("channel = 'N.S.HHN'").orderBy("pos").collect()]
    assert np.allclose(np.fromfile(tmp_path / "N.S.HHN.len1000.bin", "<f4"), want, atol=1e-5)
    assert results.read_metadata(spark, str(tmp_path / "metadata")).count() == 2
    gaps = spark.createDataFrame([("a", 0.0, 1.0), ("a", 30000.0, 3.0), ("b", 4.0, 2.0)], "channel string, ts double, v double")
    rows = lambda n: sorted(map(tuple, etl.gap_fill(gaps.repartition(n), 1.0, seed=3).collect()))
    assert rows(1) == rows(5)
    noise = np.array([r[2] for r in rows(2) if r[3]])
    assert len(noise) == 29999 and abs(noise.mean()) < 0.1 and abs(noise.std() - 3) < 0.1


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, m = rng.standard_normal(600), 16
    series = spark.createDataFrame([("c", k, float(v)) for k, v in enumerate(x)], "channel string, pos long, v double")
    for k in range(3):
        series.where(f"pos >= {k * 200 - 20} and pos < {(k + 1) * 200}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    z = np.stack([kernels.znorm(x[50 : 50 + m]), kernels.znorm(x[300 : 300 + m])])
    found = threshold_stream(spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), np.array([0, 1], np.int32), z, 0.5)
    found.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    i, j, _ = kernels.matches(x, z, np.full(2, kernels.cc_to_ed(0.5, m)))
    got = [(r.pos, r.tid) for r in spark.sql("select * from hits").collect()]
    assert sorted(got) == sorted(zip(i.tolist(), j.tolist(), strict=True))


def test_tolerant_matches_against_the_plain_rule(spark):
    rng = np.random.default_rng(12)
    a, b = ([(int(q), int(p), 0.5) for q in range(3) for p in sorted(rng.choice(600, 150, replace=False))] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "query int, pos long, corr double")
    want = []
    for q in range(3):
        free = sorted(p for i, p, _ in b if i == q)
        for p in sorted(p for i, p, _ in a if i == q):
            near = [x for x in free if abs(x - p) <= 2]
            if near:
                best = min(near, key=lambda x: (abs(x - p), x))
                free.remove(best)
                want.append((q, p, best))
    assert sorted(tuple(r) for r in evaluate.tolerant_matches(frame(a), frame(b), 2).collect()) == want


def test_command_line_with_an_index(spark, tmp_path):
    from wavecairn.__main__ import run
    from wavecairn.config import parse

    x = np.random.default_rng(1).standard_normal(4000).astype("<f4")
    wave, cut = str(tmp_path / "w.bin"), str(tmp_path / "t.bin")
    x.tofile(wave)
    np.concatenate([x[100:164], x[900:964]]).tofile(cut)
    found = []
    for strategy in ("scan", "index"):
        out = tmp_path / strategy
        run(spark, parse(["--waveform", wave, "--templates", cut, "--window", "64", "--mode", "knn", "--neighbours", "2", "--merge-offset", "16", "--strategy", strategy, "--span", "1000", "--output", str(out), "--timings", str(out) + ".t"]))
        found.append(sorted((r.tID, r.k, r.pos) for r in results.read_neighbours(spark, str(out)).collect()))
    assert found[0] == found[1] and [f for f in found[0] if f[1] == 1] == [(0, 1, 100), (1, 1, 900)]
