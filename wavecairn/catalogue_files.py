"""Registered queries that go through files: raw samples, templates, results, catalogues and sidecars are written and read back.

Files lie in the folder that driver and executors share. The SQL computes the same rows from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalogue import _PAA, _S, _T, _TWO, _cases, _corr, _events, _hits, _knn, _r, _sql_knn, _sql_threshold, _threshold, _two, K, M, O, SEG, STARTS, T
from .functions import expressions as X
from .functions import kernels, udfs
from .operators import etl, evaluate, search
from .sources import catalogues, raw, results
from .sources import series as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name, run, sql):
    QUERIES[name] = run
    ORACLES[name] = sql


def _path(spark, name):
    return f"{S.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _waveform(spark, d):
    """The events as a float32 file."""
    path = _path(spark, "events") + ".bin"
    raw.write_float32(_events(spark, d), path)
    return path


_FLOAT = "cast(cast(value as float) as double)"
_S32 = _S.replace("value as v", f"{_FLOAT} as v")

# ---- raw samples ---------------------------------------------------------------------------------


def raw_float_count(spark, d):
    return raw.float_counts(spark, _waveform(spark, d)).select("samples")


def raw_range_scan(spark, d):
    """Every range by its own task."""
    return raw.read_series(spark, _waveform(spark, d), span=1000).select("pos", "v")


def raw_prefix_scan(spark, d):
    """The first half of the file, and not the first hundred samples of that."""
    path = _waveform(spark, d)
    half = raw.float_counts(spark, path).first().samples // 2
    return raw.read_series(spark, path, span=1000, first=100, limit=half - 100).select("pos", "v")


def raw_block_search(spark, d):
    """Blocks of a file are searched as they are read, templates come from a packed file."""
    path, packed = _waveform(spark, d), _path(spark, "templates") + ".bin"
    raw.write_templates(S.cut(raw.read_series(spark, path), list(STARTS), M), packed, M)
    held = raw.read_blocks(spark, path, m=M, span=4096)
    return _hits(search.threshold_search(held, raw.read_templates(spark, packed, M), M, T, O))


def template_file(spark, d):
    path = _path(spark, "templates") + ".bin"
    raw.write_templates(S.cut(_events(spark, d), list(STARTS), M), path, M)
    rows = raw.read_templates(spark, path, M).select("tid", F.posexplode("v").alias("j", "v"))
    return rows.select(F.col("tid").cast("long").alias("tid"), F.col("j").cast("long").alias("j"), "v")


def template_buffer(spark, d):
    """Templates of 16 samples from the flat arrays of a table."""
    flat = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("values"))
    rows = S.unpacked(flat, 16).select("vec_id", "tid", F.posexplode("v").alias("j", "v"))
    return rows.select("vec_id", F.col("tid").cast("long").alias("tid"), F.col("j").cast("long").alias("j"), _r(F.col("v").cast("double")).alias("v"))


def generated_files(spark, d):
    """Cleaned waveforms of all channels, found again by their names and sizes."""
    folder = _path(spark, "generated")
    etl.generate(S.stored(S.events(spark, d, by_type=True), "series"), folder, 50, 1, 10, 2)
    files = spark.read.format("binaryFile").load(f"{folder}/*.bin").select("path", "length")
    return raw.discovered(files).select("key", "samples", "issue")


def generated_sidecars(spark, d):
    """The metadata beside them."""
    folder = _path(spark, "generated")
    etl.generate(S.stored(S.events(spark, d, by_type=True), "series"), folder, 50, 1, 10, 2, "events")
    told = results.read_metadata(spark, f"{folder}/metadata")
    return told.select("channel", "dataset", "kind", "number_of_points", "binary_file_name", "binary_file_size_bytes", F.col("frequency.sampling_rate_hz").alias("rate"), F.col("amplitude_stats.finite_points").alias("finite_points"))


_add("raw_float_count", raw_float_count, "select count(*) as samples from events")
_add("raw_range_scan", raw_range_scan, f"with {_S32} select pos, v from s")
_add("raw_prefix_scan", raw_prefix_scan, f"with {_S32} select pos, v from s where pos >= 100 and pos < (select count(*) // 2 from s)")
_add("raw_block_search", raw_block_search, _sql_threshold(o=O, corr=_corr(_S32)))
_add("template_file", template_file, f"with {_S32}, {_T} select cast(tid as bigint) as tid, cast(j as bigint) as j, q as v from tpl")
_add("template_buffer", template_buffer, "with e as (select vec_id, unnest(embedding) as v, unnest(range(len(embedding))) as n from embeddings) select vec_id, cast(n // 16 as bigint) as tid, cast(n % 16 as bigint) as j, round(cast(v as double), 6) as v from e")
_add("generated_files", generated_files, "select event_type as key, cast((count(*) + 1) // 2 as bigint) as samples, cast(null as varchar) as issue from events group by 1")
_add(
    "generated_sidecars",
    generated_sidecars,
    """with n as (select event_type as channel, cast((count(*) + 1) // 2 as bigint) as n from events group by 1)
 select channel, 'events' as dataset, 'waveform' as kind, n as number_of_points, channel || '.len' || n || '.bin' as binary_file_name, n * 4 as binary_file_size_bytes, 25.0::double as rate, n as finite_points from n""",
)

# ---- results -------------------------------------------------------------------------------------


def neighbour_file(spark, d):
    path = _path(spark, "neighbours")
    results.write_neighbours(_knn("scan", K)(spark, d), path)
    return results.read_neighbours(spark, path).select(F.col("tID").cast("long").alias("tid"), F.col("k").cast("long").alias("k"), "pos", "corr")


def hit_files(spark, d):
    """The union of the parts."""
    path = _path(spark, "hits")
    results.write_hits(_threshold("scan", o=O, groups=7)(spark, d), path)
    return results.read_hits(spark, path).select(F.col("Query").cast("long").alias("tid"), F.col("Counter").alias("counter"), F.col("Position").alias("pos"), F.col("Cross Correlation").alias("corr"))


def plan_file(spark, d):
    path = _path(spark, "plan")
    p = evaluate.plan(_cases(spark, d), [1, 2, 8], [0.5, 0.9])
    results.write_table(p.select("run_id", "key", "samples", "nodes", "value"), path)
    return spark.read.schema("run_id string, key long, samples long, nodes long, value double").option("header", True).option("sep", "\t").csv(path)


def comparison_file(spark, d):
    path = _path(spark, "comparison")
    results.write_table(evaluate.compared(*_two(spark, d)).select("query", "pos", "verdict"), path)
    return spark.read.schema("query int, pos long, verdict string").option("header", True).option("sep", "\t").csv(path)


def row_counters(spark, d):
    """Counts taken while a plan runs."""
    counters = results.Counters()
    e = counters.watch(spark.read.parquet(f"{d}/events.parquet"), read=F.count("*"), large=F.count_if(F.col("value") > 100))
    kept = counters.watch(e.where("value > 100"), kept=F.count("*"))
    kept.write.format("noop").mode("overwrite").save()
    return counters.table(spark)


_add("neighbour_file", neighbour_file, _sql_knn())
_add("hit_files", hit_files, f"select tid, counter, pos, corr from ({_sql_threshold(o=O, groups=7)})")
_add("plan_file", plan_file, "select o_orderkey || '__n' || n || '__v' || v as run_id, o_orderkey as key, o_custkey as samples, cast(n as bigint) as nodes, v as value from orders cross join (values (1), (2), (8)) t(n) cross join (values (0.5::double), (0.9::double)) u(v)")
_add("comparison_file", comparison_file, f"with {_TWO} select query, pos, case when b.corr is null then 'only_left' when a.corr is null then 'only_right' when abs(a.corr - b.corr) <= 1e-3 then 'same' else 'different' end as verdict from a full join b using (query, pos)")
_add("row_counters", row_counters, "select unnest(['read', 'large', 'kept']) as name, unnest([count(*), count(*) filter (where value > 100), count(*) filter (where value > 100)]) as count from events")

# ---- catalogues ----------------------------------------------------------------------------------

_CODES = "['HHZ', 'HNZ', 'BHZ', 'LHZ']"


def _coded(spark, d):
    """Events as samples of stations."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    codes = F.array(*map(F.lit, ("HHZ", "HNZ", "BHZ", "LHZ")))
    return e.select("event_id", "ts", F.concat(F.lit("S"), F.col("user_id") % 23).alias("station"), F.element_at(codes, (F.col("event_id") % 4 + 1).cast("int")).alias("channel"))


def archive_inventory(spark, d):
    name = F.concat(F.lit("archive/N."), "station", F.lit(".."), "channel", F.lit(".D."), F.date_format("ts", "yyyy"), F.lit("."), F.date_format("ts", "DDD"))
    held = raw.inventory(spark, _coded(spark, d).select(name.alias("path")).distinct())
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return held.select("network", "station", "location", "channel", day("t_start"), day("t_end"))


def archive_traces(spark, d):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return catalogues.traces(_coded(spark, d), at("2024-01-05 06:00:00"), at("2024-01-20 18:00:00"), station=["S1*", "S7"], channel=["H*Z", "BHZ"]).select("event_id", "station", "channel")


def template_csv(spark, d):
    """Templates of about ten seconds from a CSV file with blanks, times that can't be read and columns that aren't wanted."""
    path = _path(spark, "templates")
    key = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp_ntz")
    end = F.timestamp_add("SECOND", (8 + key % 5).cast("int"), start)
    text = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        F.concat(F.lit(" S"), F.col("o_custkey") % 50, F.lit(" ")).alias("Station"), F.col("o_orderstatus").alias("channel"),
        F.when(key % 17 == 0, "none").otherwise(text(start)).alias("starttime"), text(end).alias("endtime"), F.col("o_orderpriority").alias("other"), key.cast("string").alias("location"),
    )
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    found = etl.of_duration(catalogues.read(spark, path))
    return found.select("network", "station", "location", "channel", text("starttime").alias("starttime"), text("endtime").alias("endtime"))


def event_files(spark, d):
    """Orders as events, their lines as arrivals and picks, through XML: arrivals without a pick are dropped, phases may come from the pick."""
    path = _path(spark, "events")
    line = F.col("l_linenumber")
    pick = F.concat_ws("-", "l_orderkey", "l_linenumber")
    time = F.timestamp_add("SECOND", line, F.col("day").cast("timestamp_ntz"))
    l = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("day"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    arrival = F.struct(F.when(line == 4, "none").otherwise(pick).alias("pickID"), F.when(line % 2 == 1, F.col("flag")).alias("phase"))
    codes = F.struct(F.lit("N").alias("_networkCode"), F.concat(F.lit("S"), F.col("l_orderkey") % 9).alias("_stationCode"), F.lit("HHZ").alias("_channelCode"))
    held = F.struct(pick.alias("_publicID"), F.struct(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("value")).alias("time"), F.col("status").alias("phaseHint"), codes.alias("waveformID"))
    origin = F.array(F.struct(F.concat(F.lit("o"), "l_orderkey").alias("_publicID"), F.collect_list(arrival).alias("arrival")))  # the lines of an order
    events = l.groupBy("l_orderkey").agg(origin.alias("origin"), F.collect_list(held).alias("pick"))
    events.select(F.col("l_orderkey").cast("string").alias("_publicID"), "origin", "pick").write.format("xml").option("rootTag", "eventParameters").option("rowTag", "event").save(path)
    found = catalogues.read_events(spark, path)
    return found.select("event", "network", "station", "location", "channel", "phase", F.unix_seconds("time").alias("seconds"))


def nested_picks(spark, d):
    """Nested arrivals joined with a table of picks."""
    l = spark.read.parquet(f"{d}/lineitem.parquet")
    arrivals = F.collect_list(F.struct(F.when(F.col("l_linenumber") != 4, F.col("l_partkey")).alias("pick_id")))
    events = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.array(F.struct(arrivals.alias("arrivals"))).alias("origins"))
    picks = spark.read.parquet(f"{d}/part.parquet").where("p_size < 30").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("phase"))
    return etl.picks(events, picks).select("id", "pick_id", "phase")


_CODED = f"e as (select event_id, ts, 'S' || (user_id % 23) as station, {_CODES}[event_id % 4 + 1] as channel from events)"
_add("archive_inventory", archive_inventory, f"with {_CODED} select 'N' as network, station, '' as location, channel, strftime(min(cast(ts as date)), '%Y-%m-%d') as t_start, strftime(max(cast(ts as date)) + interval 1 day, '%Y-%m-%d') as t_end from e where channel <> 'LHZ' group by station, channel")
_add("archive_traces", archive_traces, f"with {_CODED} select event_id, station, channel from e where ts between '2024-01-05 06:00:00' and '2024-01-20 18:00:00' and (station like 'S1%' or station = 'S7') and channel in ('HHZ', 'HNZ', 'BHZ')")
_add(
    "template_csv",
    template_csv,
    """select '' as network, 'S' || (o_custkey % 50) as station, cast(o_orderkey as varchar) as location, o_orderstatus as channel, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as starttime,
 strftime(o_orderdate + to_seconds(8 + o_orderkey % 5), '%Y-%m-%d %H:%M:%S') as endtime from orders where o_orderkey % 17 <> 0 and o_orderkey % 5 between 1 and 3""",
)
_add(
    "event_files",
    event_files,
    """with l as (select l_orderkey, l_linenumber, min(l_shipdate) as day, min(l_returnflag) as flag, min(l_linestatus) as status from lineitem group by 1, 2)
 select cast(l_orderkey as varchar) as event, 'N' as network, 'S' || (l_orderkey % 9) as station, '' as location, 'HHZ' as channel, case when l_linenumber % 2 = 1 then flag else status end as phase,
 cast(epoch_us(day) // 1000000 + l_linenumber as bigint) as seconds from l where l_linenumber <> 4""",
)
_add("nested_picks", nested_picks, "select l_orderkey as id, l_partkey as pick_id, p_brand as phase from lineitem join part on p_partkey = l_partkey where l_linenumber <> 4 and p_size < 30")

# ---- helpers -------------------------------------------------------------------------------------


def fill_ratio(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    s = e.select(F.col("event_type").alias("channel"), F.when(F.col("event_id") % 97 == 0, kernels.SENTINEL).otherwise(F.col("value")).alias("v"))
    return etl.fill_ratio(s).select("channel", "filled", "samples", _r("ratio").alias("ratio"))


def packed_lengths(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", X.packed_length(F.col("o_custkey"), 8).alias("length"))


def cleaned_codes(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    code = F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), "c_mktsegment"))
    return c.select("c_custkey", X.clean_code(code, "--").alias("code"))


def sampled_templates(spark, d):
    """A sample of 100, which is the feature; the order is that of a digest of seed and id."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("tid"))
    return evaluate.sampled(e, 100, 7)


def sql_functions(spark, d):
    """Normalised templates, their words, and their correlations with each other, by the functions registered for SQL."""
    udfs.register(spark)
    S.cut(_events(spark, d), list(STARTS), M).createOrReplaceTempView("wave_templates")
    a = f"select tid, v, wave_paa(wave_znorm(v), {SEG}) as p from wave_templates"
    return spark.sql(
        f"""select cast(a.tid as long) as tid, cast(b.tid as long) as other, hex(wave_sax(a.p)) as word, round(wave_corr(a.v, b.v), 6) as corr, round(wave_mindist(a.p, wave_sax(a.p), {M}), 6) as own
 from ({a}) a join ({a}) b on a.tid < b.tid"""
    )


_add("fill_ratio", fill_ratio, "select event_type as channel, count(*) filter (where event_id % 97 = 0) as filled, count(*) as samples, round(avg(case when event_id % 97 = 0 then 1.0::double else 0 end), 6) as ratio from events group by 1")
_add("packed_lengths", packed_lengths, "select o_orderkey, o_custkey - o_custkey % 8 as length from orders")
_add("cleaned_codes", cleaned_codes, "select c_custkey, case when c_custkey % 3 = 1 then c_mktsegment else '--' end as code from customer")
_add("sampled_templates", sampled_templates, "select vec_id as tid from embeddings order by md5('7:' || vec_id), vec_id limit 100")
_add(
    "sql_functions",
    sql_functions,
    f"""with {_PAA}, y as (select tid, string_agg(printf('%02X', len(list_filter({'[' + ', '.join(repr(float(b)) for b in kernels.breakpoints()) + ']'}, lambda b: b < value))), '' order by segment) as word from p group by 1)
 select cast(a.tid as bigint) as tid, cast(b.tid as bigint) as other, any_value(word) as word, round(corr(a.q, b.q), 6) as corr, 0.0::double as own from tpl a join tpl b on a.j = b.j and a.tid < b.tid join y on y.tid = a.tid group by 1, 2""",
)
