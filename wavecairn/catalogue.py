"""Registered queries, each over its whole tables, and the SQL that checks them.

Waveforms are the events' values in order of time and the line items' prices; templates are windows of the
same series. Every double is rounded to six digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import expressions as X
from .functions import kernels
from .operators import etl, evaluate, index, search, vectors
from .plans import planner
from .sources import results
from .sources import series as S

M, STARTS = 64, (100, 400, 700)
T, O, K = 0.15, 200, 10


def _r(column):
    return F.round(column, 6)


def _events(spark, d):
    return S.stored(S.events(spark, d), "series")


def _both(spark, d, m=M):
    s = _events(spark, d)
    return s, S.cut(s, list(STARTS), m)


_INDEXES: dict = {}


def _indexed(spark, d):
    """The index of the events and the templates cut from it, made once a session and read by every query that uses them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        ix = index.build(_events(spark, d), M, 16)
        _INDEXES[key] = ix, S.stored(S.cut(search.samples(ix.held), list(STARTS), M), "templates")
    return _INDEXES[key]


def _index(spark, d):
    return _indexed(spark, d)[0]


def _hits(found):
    return found.select(F.col("tid").cast("long").alias("tid"), F.col("part").cast("long").alias("part"), "counter", "pos", _r("corr").alias("corr"))


def _near(found):
    return found.select(F.col("tid").cast("long").alias("tid"), "k", "pos", _r("corr").alias("corr"))


def _threshold(strategy, t=T, o=0, groups=1):
    def run(spark, d):
        s, q = _both(spark, d)
        return _hits(search.threshold_search(s, q, M, t, o, groups, strategy))

    return run


def _knn(strategy, k=K, o=0):
    def run(spark, d):
        s, q = _both(spark, d)
        return _near(search.knn_search(s, q, M, k, o, strategy))

    return run


# ---- SQL pieces ----------------------------------------------------------------------------------

_S = "s as (select row_number() over (order by ts, event_id) - 1 as pos, value as v from events)"
_T = f"tpl as (select t.tid, s.pos - t.st as j, s.v as q from s join (values {', '.join(f'({k}, {x})' for k, x in enumerate(STARTS))}) as t(tid, st) on s.pos between t.st and t.st + {M - 1})"


def _corr(source=_S, value="v", start="true"):
    """CTEs up to c(tid, pos, corr): all correlations."""
    return f"""{source}, x as (select pos, v, {value} as x from s),
 {_T.replace("s.v", "s.v")},
 tn as (select tid, j, (q - avg(q) over w) / stddev_pop(q) over w as z from tpl window w as (partition by tid)),
 st as (select pos, v, avg(x) over f as mu, stddev_pop(x) over f as sd, count(*) over f as n from x window f as (order by pos rows between current row and {M - 1} following)),
 dp as (select tid, x.pos - tn.j as pos, sum(z * x) as dot, sum(z) as sz from tn cross join x where x.pos >= tn.j group by 1, 2),
 c as (select cast(tid as bigint) as tid, dp.pos, greatest(-1.0, least(1.0, (dot - mu * sz) / ({M} * sd))) as corr from dp join st using (pos) where n = {M} and sd > 1e-12 and {start})"""


def _sql_threshold(t=T, o=0, groups=1, corr=None):
    corr = corr or _corr()
    part = f"least({groups - 1}, pos // greatest(1, (select count(*) from s) // {groups}))" if groups > 1 else "0"
    hits = f"h as (select tid, cast({part} as bigint) as part, pos, corr from c where corr >= {t})"
    if o:
        kept = f"""g as (select tid, part, min(pos) as pos from h group by 1, 2
  union all select g.tid, g.part, (select min(h.pos) from h where h.tid = g.tid and h.part = g.part and h.pos >= g.pos + {o + 1}) from g where g.pos is not null)"""
        return f"with recursive {corr}, {hits}, {kept} select h.tid, h.part, cast(row_number() over (partition by h.tid, h.part order by h.pos) - 1 as bigint) as counter, h.pos, round(h.corr, 6) as corr from h join (select distinct * from g where pos is not null) g using (tid, part, pos)"
    return f"with {corr}, {hits} select tid, part, cast(row_number() over (partition by tid, part order by pos) - 1 as bigint) as counter, pos, round(corr, 6) as corr from h"


def _sql_knn(k=K, o=0):
    if not o:
        return f"with {_corr()}, r as (select *, row_number() over (partition by tid order by corr desc, pos) as k from c) select tid, cast(k as bigint) as k, pos, round(corr, 6) as corr from r where k <= {k}"
    return f"""with recursive {_corr()}, r as (select *, row_number() over (partition by tid order by corr desc, pos) as n from c),
 g as (select tid, n, [pos] as kept, pos, corr from r where n = 1
  union all select q.tid, q.n, list_append(q.before, q.pos), q.pos, q.corr from (
    select r.tid, r.n, r.pos, r.corr, g.kept as before, row_number() over (partition by r.tid order by r.n) as first
    from g join r on r.tid = g.tid and r.n > g.n and len(g.kept) < {k} and len(list_filter(g.kept, lambda y: abs(y - r.pos) < {o})) = 0) q where q.first = 1)
 select tid, cast(len(kept) as bigint) as k, pos, round(corr, 6) as corr from g"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# ---- search --------------------------------------------------------------------------------------

_add("threshold_plain", _threshold("scan"), _sql_threshold())
_add("threshold_merged", _threshold("scan", o=O), _sql_threshold(o=O))
_add("threshold_partitioned", _threshold("scan", o=O, groups=7), _sql_threshold(o=O, groups=7))
_add("threshold_by_sql", _threshold("sql", o=O), _sql_threshold(o=O))
_add("threshold_sax", _threshold("sax", t=0.4), _sql_threshold(t=0.4))
_add("threshold_index", lambda spark, d: _hits(search.threshold_search(*_indexed(spark, d), M, 0.6)), _sql_threshold(t=0.6))
_add("threshold_index_tight", lambda spark, d: _hits(search.threshold_search(*_indexed(spark, d), M, 0.9)), _sql_threshold(t=0.9))
_add("threshold_fft", _threshold("fft"), _sql_threshold())
_add("threshold_adaptive", _threshold("auto", t=0.9), _sql_threshold(t=0.9))
_add("knn_plain", _knn("scan"), _sql_knn())
_add("knn_exclusion", _knn("scan", o=O), _sql_knn(o=O))
_add("knn_sax_pruned", _knn("sax", o=O), _sql_knn(o=O))
_add("knn_index", lambda spark, d: _near(search.knn_search(*_indexed(spark, d), M, K, O)), _sql_knn(o=O))
_add("knn_index_plain", lambda spark, d: _near(search.knn_search(*_indexed(spark, d), M, K)), _sql_knn())
_add("knn_fft", _knn("fft", o=O), _sql_knn(o=O))
_add("knn_adaptive", _knn("auto", o=O), _sql_knn(o=O))


def knn_padded(spark, d):
    s, q = _both(spark, d)
    return _near(search.knn_search(s, q, M, 5, 200, "scan", pad=True))


_add("knn_padded", knn_padded, _sql_knn(5, 200).replace(" select tid, cast(len(kept) as bigint) as k", ", f as (select tid, cast(len(kept) as bigint) as k").replace("from g", "from g", 1) + f") select t.tid, k.k, f.pos, f.corr from (select unnest(range({len(STARTS)})) as tid) t cross join (select unnest(range(1, 6)) as k) k left join f on f.tid = t.tid and f.k = k.k")


def knn_multi_channel(spark, d):
    s = S.stored(S.events(spark, d, by_type=True), "series")
    q = S.cut(s, [20, 60], 32, "click")
    return search.knn_search(s, q, 32, 5, 0, "scan").select("channel", F.col("tid").cast("long").alias("tid"), "k", "pos", _r("corr").alias("corr"))


_add(
    "knn_multi_channel",
    knn_multi_channel,
    """with s as (select event_type as channel, row_number() over (partition by event_type order by ts, event_id) - 1 as pos, value as v from events),
 tpl as (select t.tid, s.pos - t.st as j, s.v as q from s join (values (0, 20), (1, 60)) as t(tid, st) on s.pos between t.st and t.st + 31 where channel = 'click'),
 tn as (select tid, j, (q - avg(q) over w) / stddev_pop(q) over w as z from tpl window w as (partition by tid)),
 st as (select channel, pos, avg(v) over f as mu, stddev_pop(v) over f as sd, count(*) over f as n from s window f as (partition by channel order by pos rows between current row and 31 following)),
 dp as (select channel, tid, s.pos - tn.j as pos, sum(z * v) as dot, sum(z) as sz from tn cross join s where s.pos >= tn.j group by 1, 2, 3),
 c as (select channel, tid, pos, (dot - mu * sz) / (32 * sd) as corr from dp join st using (channel, pos) where n = 32 and sd > 1e-12),
 r as (select *, row_number() over (partition by channel, tid order by corr desc, pos) as k from c)
 select channel, cast(tid as bigint) as tid, cast(k as bigint) as k, pos, round(corr, 6) as corr from r where k <= 5""",
)


def missing_sentinel_search(spark, d):
    table = spark.read.parquet(f"{d}/events.parquet").withColumn("value", F.when(F.col("event_id") % 97 == 0, kernels.SENTINEL).otherwise(F.col("value")))
    s = S.stored(S.from_table(table, ["ts", "event_id"], "value", None, "events"), "series")
    q = S.cut(_events(spark, d), list(STARTS), M)
    return _hits(search.threshold_search(s, q, M, T, O, 1, "scan"))


_GAPS = "s0 as (select row_number() over (order by ts, event_id) - 1 as pos, value as v from events), s as (select row_number() over (order by ts, event_id) - 1 as pos, case when event_id % 97 = 0 then -100000.0 else value end as v from events)"
_add("missing_sentinel_search", missing_sentinel_search, _sql_threshold(o=O, corr=_corr(_GAPS, "case when v = -100000 then 0 else v end", "st.v <> -100000").replace("s.pos - t.st as j, s.v as q from s join", "s0.pos - t.st as j, s0.v as q from s0 join").replace("on s.pos between", "on s0.pos between")))


def long_waveform(spark, d):
    s = S.stored(S.prices(spark, d), "series")
    return _near(search.knn_search(s, S.cut(s, [5, 3000], M), M, 5, 16, "fft"))


_add(
    "long_waveform",
    long_waveform,
    _sql_knn(5, 16).replace("row_number() over (order by ts, event_id) - 1 as pos, value as v from events", "row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos, cast(l_extendedprice as double) as v from lineitem").replace(
        ", ".join(f"({k}, {x})" for k, x in enumerate(STARTS)), "(0, 5), (1, 3000)"
    ),
)


def distance_profile(spark, d):
    s, q = _both(spark, d)
    return search.by_sql(s, q, M).select(F.col("tid").cast("long").alias("tid"), "pos", _r(X.cc_to_ed(F.col("corr"), M)).alias("ed"))


_add("distance_profile", distance_profile, f"with {_corr()} select tid, pos, round(2.0 * {M} * (1 - corr), 6) as ed from c")


def window_stats(spark, d):
    held = search.blocks(_events(spark, d), M)
    return index.summaries(held, M).select("pos", F.round("mu", 8).alias("mu"), F.round("sd", 8).alias("sd"))


_add("window_stats", window_stats, f"with {_S}, st as (select pos, avg(v) over f as mu, stddev_pop(v) over f as sd, count(*) over f as n from s window f as (order by pos rows between current row and {M - 1} following)) select pos, round(mu, 8) as mu, round(sd, 8) as sd from st where n = {M} and sd > 1e-12")


def znorm_template(spark, d):
    _, q = _both(spark, d)
    v = F.col("v")
    z = q.withColumn("mu", X.mean(v)).withColumn("sd", X.deviation(v)).select("tid", F.posexplode(X.znorm(v, F.col("mu"), F.col("sd"))).alias("j", "z"))
    return z.select(F.col("tid").cast("long").alias("tid"), F.col("j").cast("long").alias("j"), _r("z").alias("z"))


_TN = f"{_S}, {_T}, tn as (select tid, j, (q - avg(q) over w) / stddev_pop(q) over w as z from tpl window w as (partition by tid))"
_add("znorm_template", znorm_template, f"with {_TN} select cast(tid as bigint) as tid, cast(j as bigint) as j, round(z, 6) as z from tn")


# ---- summaries -----------------------------------------------------------------------------------

SEG = 8
_BP = "[" + ", ".join(repr(float(b)) for b in kernels.breakpoints()) + "]"


def _paa(spark, d):
    _, q = _both(spark, d)
    v = F.col("v")
    z = q.withColumn("mu", X.mean(v)).withColumn("sd", X.deviation(v)).select("tid", X.znorm(v, F.col("mu"), F.col("sd")).alias("z"))
    return z.select("tid", F.posexplode(X.paa(F.col("z"), M, SEG)).alias("segment", "value"))


def paa(spark, d):
    return _paa(spark, d).select(F.col("tid").cast("long").alias("tid"), F.col("segment").cast("long").alias("segment"), _r("value").alias("value"))


def sax_word(spark, d):
    return _paa(spark, d).select(F.col("tid").cast("long").alias("tid"), F.col("segment").cast("long").alias("segment"), X.sax_symbol(F.col("value")).cast("long").alias("symbol"))


_PAA = f"{_TN}, p as (select cast(tid as bigint) as tid, cast(j // {M // SEG} as bigint) as segment, avg(z) as value from tn group by 1, 2)"
_add("paa", paa, f"with {_PAA} select tid, segment, round(value, 6) as value from p")
_add("sax_word", sax_word, f"with {_PAA} select tid, segment, cast(len(list_filter({_BP}, lambda b: b < value)) as bigint) as symbol from p")


def _bounds(spark, d):
    """tid, pos, bound as SQL has it before it rounds."""
    s, q = _both(spark, d)
    words = index.summaries(search.blocks(s, M), M, SEG)
    means = sorted((r.tid, kernels.ordered_paa(r.v, SEG)) for r in q.where(F.size("v") == M).collect())  # three templates

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            w = np.frombuffer(b"".join(batch.column("word").to_pylist()), np.uint8).reshape(-1, SEG)
            for t, m in means:
                yield pa.RecordBatch.from_pydict({"tid": pa.array([t] * len(w), pa.int64()), "pos": batch.column("pos"), "bound": kernels.lower_bound(m, w, M)})

    return words.mapInArrow(run, "tid long, pos long, bound double")


def lower_bound(spark, d):
    return _bounds(spark, d).select("tid", "pos", (F.round(F.col("bound") * 1e6) / 1e6).alias("bound"))  # SQL rounds the multiple, F.round alone the decimal text


def _words(seg):
    """CTEs up to sy(pos, segment, symbol): the words of all windows."""
    w = M // seg
    return f"""{_TN}, p as (select cast(tid as bigint) as tid, cast(j // {w} as bigint) as segment, avg(z) as value from tn group by 1, 2),
 st as (select pos, avg(v) over f as mu, stddev_pop(v) over f as sd, count(*) over f as n from s window f as (order by pos rows between current row and {M - 1} following)),
 sg as (select pos, {', '.join(f'avg(v) over (order by pos rows between {k * w} following and {(k + 1) * w - 1} following) as a{k}' for k in range(seg))} from s),
 wd as (select pos, unnest(range({seg})) as segment, (unnest([{', '.join(f'a{k}' for k in range(seg))}]) - mu) / sd as value from sg join st using (pos) where n = {M} and sd > 1e-12),
 sy as (select pos, segment, len(list_filter({_BP}, lambda b: b < value)) as symbol from wd)"""


_WORDS = _words(SEG)
_add(
    "lower_bound",
    lower_bound,
    f"""with {_WORDS}, e as (select list_concat([-2000000.0], {_BP}, [2000000.0]) as edges)
 select tid, pos, round({M // SEG} * sum(power(greatest(edges[symbol + 1] - value, value - edges[symbol + 2], 0.0), 2)), 6) as bound
 from sy join p using (segment) cross join e group by tid, pos""",
)


def isax_root_histogram(spark, d):
    words = index.summaries(search.blocks(_events(spark, d), M), M, SEG)
    return index.rooted(words, SEG).groupBy("root").agg(F.count("*").alias("windows"))


_add("isax_root_histogram", isax_root_histogram, f"with {_WORDS}, r as (select pos, cast(sum((symbol // 128) * power(2, {SEG - 1} - segment)) as bigint) as root from sy group by pos) select root, count(*) as windows from r group by root")


def isax_leaf_stats(spark, d):
    words = index.summaries(search.blocks(_events(spark, d), M), M, SEG)
    return index.tree_statistics(index.leaves(words, SEG, 100), SEG)


_add("isax_leaf_stats", isax_leaf_stats)


def index_build(spark, d):
    """What the index holds; the first query of a session that needs it builds it."""
    ix = _index(spark, d)
    return ix.nodes.agg(F.sum("size").alias("windows"), F.countDistinct("root").alias("roots"))


def index_postings(spark, d):
    """The root of every window, by its leaf."""
    ix = _index(spark, d)
    rows = ix.postings.join(ix.nodes.select("leaf", "root"), "leaf").join(ix.held.select("channel", "block", "start"), ["channel", "block"])
    return rows.select("start", "root", F.explode("offsets").alias("offset")).select((F.col("start") + F.col("offset")).alias("pos"), "root")


_add("index_build", index_build, f"with {_words(16)}, r as (select pos, cast(sum((symbol // 128) * power(2, 15 - segment)) as bigint) as root from sy group by pos) select cast(count(*) as bigint) as windows, count(distinct root) as roots from r")
_add("index_postings", index_postings, f"with {_words(16)} select pos, cast(sum((symbol // 128) * power(2, 15 - segment)) as bigint) as root from sy group by pos")


def sax_midpoint(spark, d):
    words = sax_word(spark, d)
    return words.select("tid", "segment", _r(X.symbol_middle(F.col("symbol"))).alias("value"))


_add("sax_midpoint", sax_midpoint, f"with {_PAA}, y as (select tid, segment, len(list_filter({_BP}, lambda b: b < value)) as n from p), e as (select {_BP} as b) select tid, segment, round(case when n = 0 then b[1] + (b[1] - b[128]) / 2 when n = 255 then b[255] + (b[255] - b[128]) / 2 else (b[n] + b[n + 1]) / 2 end, 6) as value from y cross join e")


def predicted_work(spark, d):
    """The sigmoid of predicted work over best distances so far."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", _r(X.sigmoid_basis(F.col("value") / 100, 0.5, 4.0, 1.5, 2.0)).alias("work"))


_add("predicted_work", predicted_work, "select event_id, round(0.5 + 3.5 / (1 + exp(-1.5 * (value / 100 - 2.0))), 6) as work from events")


def planner_decision(spark, d):
    s, q = _both(spark, d)
    return planner.decision(s, q, M, kernels.cc_to_ed(0.9, M))


_add("planner_decision", planner_decision)


def embedding_knn_l2(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = vectors.knn_l2(e, e.where("id % 50 = 0"), 5, 64)  # the stated query set against all rows
    return out.select("query", "k", F.col("id").alias("vec_id"), F.round("ed", 4).alias("ed"))


_add(
    "embedding_knn_l2",
    embedding_knn_l2,
    """with p as (select q.vec_id as query, e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda t: power(cast(t[1] as double) - t[2], 2))) as ed
 from embeddings e join embeddings q on q.vec_id % 50 = 0 and e.vec_id <> q.vec_id), r as (select *, row_number() over (partition by query order by ed, vec_id) as k from p)
 select query, cast(k as bigint) as k, vec_id, round(ed, 4) as ed from r where k <= 5""",
)


def _enveloped(s, r):
    w = W.partitionBy("channel").orderBy("pos").rowsBetween(-r, r)
    return s.select("channel", "pos", "v", F.max("v").over(w).alias("upper"), F.min("v").over(w).alias("lower"))


def envelope(spark, d):
    return _enveloped(_events(spark, d), 5).select("pos", _r("upper").alias("upper"), _r("lower").alias("lower"))


def lb_keogh(spark, d):
    s, q = _both(spark, d)
    long = q.select(F.col("tid").cast("string").alias("channel"), F.posexplode("v").alias("pos", "v"))
    e = _enveloped(long, 5)
    first, other = e.select("pos", F.col("channel").alias("a"), "upper", "lower"), long.select("pos", F.col("channel").alias("b"), "v")
    out = first.join(other, "pos").where("a <> b").groupBy("a", "b").agg(F.sum(X.lb_keogh(F.col("upper"), F.col("lower"), F.col("v"))).alias("bound"))
    return out.select("a", "b", _r("bound").alias("bound"))


_add("envelope", envelope, f"with {_S} select pos, round(max(v) over w, 6) as upper, round(min(v) over w, 6) as lower from s window w as (order by pos rows between 5 preceding and 5 following)")
_add("lb_keogh", lb_keogh, f"with {_S}, {_T}, e as (select tid, j, max(q) over w as u, min(q) over w as l from tpl window w as (partition by tid order by j rows between 5 preceding and 5 following)) select cast(e.tid as varchar) as a, cast(t.tid as varchar) as b, round(sum(power(greatest(q - u, l - q, 0.0), 2)), 6) as bound from e join tpl t using (j) where e.tid <> t.tid group by 1, 2")


# ---- samples -------------------------------------------------------------------------------------


def amplitude_stats(spark, d):
    s = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("channel"), F.col("value").alias("v"))
    return etl.amplitude(s).select("channel", "finite_points", "nan_points", "inf_points", _r("min").alias("min"), _r("max").alias("max"), _r("mean").alias("mean"))


_add("amplitude_stats", amplitude_stats, "select event_type as channel, count(*) filter (where isfinite(value)) as finite_points, count(*) filter (where isnan(value)) as nan_points, count(*) filter (where isinf(value)) as inf_points, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean from events group by 1")


def preview_minmax(spark, d):
    return etl.preview(_events(spark, d), 50).select("bin", _r("low").alias("low"), _r("high").alias("high"))


_add("preview_minmax", preview_minmax, f"with {_S} select pos // 50 as bin, round(min(v), 6) as low, round(max(v), 6) as high from s group by 1")


def _chunks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.col("event_type").alias("channel"), F.to_date("ts").alias("chunk")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("count"))


def chunk_map(spark, d):
    return etl.chunk_map(_chunks(spark, d)).select("channel", F.date_format("chunk", "yyyy-MM-dd").alias("chunk"), "count", _r("gap_before").alias("gap_before"), "output_start")


_add(
    "chunk_map",
    chunk_map,
    """with c as (select event_type as channel, cast(ts as date) as chunk, min(ts) as a, max(ts) as b, count(*) as n from events group by 1, 2)
 select channel, strftime(chunk, '%Y-%m-%d') as chunk, n as count, round(epoch_us(a) / 1e6 - epoch_us(lag(b) over w) / 1e6, 6) as gap_before, cast(coalesce(sum(n) over (partition by channel order by a, chunk rows between unbounded preceding and 1 preceding), 0) as bigint) as output_start
 from c window w as (partition by channel order by a, chunk)""",
)


def overlap_drop(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("channel"), (F.col("event_id") % 7).alias("chunk"), "ts", "event_id")
    return etl.without_overlap(e).groupBy("channel", "chunk").agg(F.count("*").alias("kept"))


_add("overlap_drop", overlap_drop, "with e as (select event_type as channel, event_id % 7 as chunk, ts from events), m as (select channel, chunk, max(ts) as b from e group by 1, 2), p as (select channel, chunk, max(b) over (partition by channel order by chunk rows between unbounded preceding and 1 preceding) as b from m) select channel, chunk, count(*) as kept from e join p using (channel, chunk) where p.b is null or ts > p.b group by 1, 2")


def inventory_grouping_sets(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("N"), F.col("user_id") % 3).alias("network"), F.concat(F.lit("S"), F.col("user_id") % 11).alias("station"), F.col("event_type").alias("channel"), F.col("value").alias("days"))
    return etl.inventory_report(e).select("network", "station", "channel", "entries", "stations", _r("mean_days").alias("mean_days"), _r("median_days").alias("median_days"), F.round("total_days", 3).alias("total_days"))


_add("inventory_grouping_sets", inventory_grouping_sets, "with e as (select 'N' || (user_id % 3) as network, 'S' || (user_id % 11) as station, event_type as channel, value as days from events) select network, station, channel, count(*) as entries, count(distinct network || '/' || station) as stations, round(avg(days), 6) as mean_days, round(median(days), 6) as median_days, round(sum(days), 3) as total_days from e group by grouping sets ((), (network), (network, station), (channel))")


def detrend_linear(spark, d):
    return etl.detrend_linear(_events(spark, d)).select("pos", _r("v").alias("v"))


def taper_cosine(spark, d):
    return etl.taper(_events(spark, d)).select("pos", _r("v").alias("v"))


def decimate(spark, d):
    return etl.decimate(_events(spark, d)).select("pos", _r("v").alias("v"))


_add("detrend_linear", detrend_linear, f"with {_S}, l as (select regr_slope(v, pos) as a, regr_intercept(v, pos) as b from s) select pos, round(v - a * pos - b, 6) as v from s cross join l")
_add("taper_cosine", taper_cosine, f"with {_S}, n as (select count(*) as n from s), e as (select pos, v, least(pos, n - 1 - pos) as e, floor(n * 0.02) as w from s cross join n) select pos, round(v * case when e < w then 0.5 * (1 - cos(pi() * e / w)) else 1.0 end, 6) as v from e")
_add("decimate", decimate, f"with {_S} select pos // 2 as pos, round(v, 6) as v from s where pos % 2 = 0")


BAND = (1, 10, 50)


def bandpass(spark, d):
    return etl.bandpass(_events(spark, d), *BAND).select("pos", _r("v").alias("v"))


def gap_fill(spark, d):
    s = spark.read.parquet(f"{d}/events.parquet").where("event_type is not null").select(F.col("event_type").alias("channel"), F.floor(etl.seconds(F.col("ts")) / 3600).cast("double").alias("ts"), F.col("value").alias("v")).groupBy("channel", "ts").agg(F.avg("v").alias("v"))
    return etl.gap_fill(s, 1.0).groupBy("channel", "filled").agg(F.count("*").alias("samples"))


_RESPONSE = etl.zero_phase_response(*BAND)
_add("bandpass", bandpass, f"with {_S}, g as (select unnest(range({len(_RESPONSE)})) - {len(_RESPONSE) // 2} as k, unnest([{', '.join(repr(float(x)) for x in _RESPONSE)}]) as g) select s.pos + g.k as pos, round(sum(s.v * g.g), 6) as v from s cross join g where s.pos + g.k between 0 and (select max(pos) from s) group by 1")
_add("gap_fill", gap_fill, "with s as (select distinct event_type as channel, floor(epoch_us(ts) / 3.6e9) as h from events), g as (select channel, h, lead(h) over (partition by channel order by h) - h as gap from s) select channel, false as filled, count(*) as samples from s group by 1 union all select channel, true, cast(sum(gap - 1) as bigint) from g where gap > 1 group by 1")


def template_interval_join(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(etl.seconds(F.col("ts")).alias("ts"), F.col("value").alias("v"))
    o = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), etl.seconds(F.col("ts")).alias("start"), (etl.seconds(F.col("ts")) + 120).alias("end"))
    return etl.by_interval(o, e, 600).groupBy("id").agg(F.count("*").alias("points"), _r(F.avg("v")).alias("mean"))


_add("template_interval_join", template_interval_join, "with e as (select event_id as id, epoch_us(ts) / 1e6 as ts, value as v from events) select a.id, count(*) as points, round(avg(b.v), 6) as mean from e a join e b on b.ts between a.ts and a.ts + 120 group by 1")


def template_validity(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet")
    samples = l.select(F.col("l_orderkey").alias("tid"), F.col("l_linenumber").cast("double").alias("ts"), F.round("l_quantity", -1).cast("double").alias("v")).groupBy("tid", "ts").agg(F.max("v").alias("v"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("tid"), F.lit(1.0).alias("start"), (1.0 + F.col("o_custkey") % 8).alias("end"), F.lit(1.0).alias("rate"))
    return etl.complete_templates(samples, o, 2).select("tid", "points", "length", "reason")


_add(
    "template_validity",
    template_validity,
    """with q as (select o_orderkey as tid, 1.0 as a, 1.0 + o_custkey % 8 as b, (o_custkey % 8) // 2 * 2 as length from orders),
 l as (select l_orderkey as tid, cast(l_linenumber as double) as ts, max(cast(round(l_quantity, -1) as double)) as v, row_number() over (partition by l_orderkey order by l_linenumber) as n from lineitem group by l_orderkey, l_linenumber),
 g as (select q.tid, a, b, length, count(ts) as points, min(ts) as first, max(ts) as last, min(v) filter (where n <= length) as low, max(v) filter (where n <= length) as high from q left join l using (tid) group by all)
 select tid, points, cast(case when points = 0 then 0 else length end as bigint) as length, case when points = 0 then 'missing' when length <= 0 then 'empty' when points < length then 'short' when first - a > 1.01 or b - last > 1.01 then 'endpoint' when last - first + 1 > points then 'gap' when low = high then 'constant' else 'ok' end as reason from g""",
)


def clip_ranges(spark, d):
    c = _chunks(spark, d).select("channel", F.date_format("chunk", "yyyy-MM-dd").alias("chunk"), etl.seconds(F.col("start")).alias("start"), etl.seconds(F.col("end")).alias("end"))
    bounds = c.agg(F.min("start").alias("a"), F.max("end").alias("b"))
    cut = etl.clipped(c.crossJoin(F.broadcast(bounds)), F.col("a") + (F.col("b") - F.col("a")) / 4, F.col("b") - (F.col("b") - F.col("a")) / 4)  # one row of bounds
    return cut.select("channel", "chunk", _r("start").alias("start"), _r("end").alias("end"))


_add(
    "clip_ranges",
    clip_ranges,
    """with c as (select event_type as channel, strftime(cast(ts as date), '%Y-%m-%d') as chunk, min(epoch_us(ts)) / 1e6 as a, max(epoch_us(ts)) / 1e6 as b from events group by 1, 2),
 m as (select min(a) + (max(b) - min(a)) / 4 as lo, max(b) - (max(b) - min(a)) / 4 as hi from c)
 select channel, chunk, round(greatest(a, lo), 6) as start, round(least(b, hi), 6) as end from c cross join m where greatest(a, lo) < least(b, hi)""",
)


def catalogue_described(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_shipdate").cast("timestamp_ntz").alias("l_shipdate"), "l_linestatus", "l_linenumber")
    out = etl.described(l, ["l_returnflag"], "l_shipdate", "l_shipdate", ["l_linestatus"], ["l_linenumber"])
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("l_returnflag", day("start"), day("end"), "entries", F.concat_ws(",", "l_linestatus").alias("statuses"), F.concat_ws(",", "l_linenumber").alias("numbers"))


_add(
    "catalogue_described",
    catalogue_described,
    """with n as (select l_returnflag, l_linenumber, count(*) as n from lineitem group by 1, 2), c as (select l_returnflag, string_agg(l_linenumber || ':' || n, ',' order by l_linenumber) as numbers from n group by 1)
 select l_returnflag, strftime(min(l_shipdate), '%Y-%m-%d') as start, strftime(max(l_shipdate), '%Y-%m-%d') as end, count(*) as entries, array_to_string(list_sort(list(distinct l_linestatus)), ',') as statuses, any_value(numbers) as numbers from lineitem join c using (l_returnflag) group by 1""",
)


def waveform_metadata(spark, d):
    s = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("channel"), F.col("value").alias("v"))
    m = etl.waveform_metadata(s, 50, "events", (1, 10))
    a = F.col("amplitude_stats")
    return m.select("channel", "kind", "number_of_points", "binary_file_name", "binary_file_size_bytes", a["finite_points"].alias("finite_points"), _r(a["mean"]).alias("mean"), F.col("frequency.sampling_rate_hz").alias("rate"), _r("source.actual_duration_seconds").alias("seconds"))


_add("waveform_metadata", waveform_metadata, "select event_type as channel, 'waveform' as kind, count(*) as number_of_points, event_type || '.len' || count(*) || '.bin' as binary_file_name, count(*) * 4 as binary_file_size_bytes, count(*) filter (where isfinite(value)) as finite_points, round(avg(value), 6) as mean, 50.0::double as rate, round(count(*) / 50.0::double, 6) as seconds from events group by 1")


def inventory_share(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey", "c_custkey")
    return etl.strided(c, ["c_nationkey", "c_custkey"], 2, 5)  # the split of an inventory by offset and stride


_add("inventory_share", inventory_share, "select c_nationkey, c_custkey from (select *, row_number() over (order by c_nationkey, c_custkey) - 1 as n from customer) where n >= 2 and (n - 2) % 5 = 0")


# ---- evaluation ----------------------------------------------------------------------------------


def _two(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select((F.col("user_id") % 5).cast("int").alias("query"), F.col("event_id").alias("pos"), F.col("value").alias("corr"))
    return rows.where("pos % 3 <> 0"), rows.where("pos % 4 <> 0").withColumn("corr", F.col("corr") + F.when(F.col("pos") % 10 == 1, 0.5).otherwise(0.0))


_TWO = "e as (select cast(user_id % 5 as integer) as query, event_id as pos, value as corr from events), a as (select * from e where pos % 3 <> 0), b as (select query, pos, corr + case when pos % 10 = 1 then 0.5 else 0 end as corr from e where pos % 4 <> 0)"


def compare_runs(spark, d):
    out = evaluate.comparison_summary(evaluate.compared(*_two(spark, d)))
    return out.select("verdict", "n", _r("max_gap").alias("max_gap"), _r("mean_gap").alias("mean_gap"))


_add("compare_runs", compare_runs, f"with {_TWO}, j as (select a.corr as x, b.corr as y from a full join b using (query, pos)) select case when y is null then 'only_left' when x is null then 'only_right' when abs(x - y) <= 1e-3 then 'same' else 'different' end as verdict, count(*) as n, round(max(abs(x - y)), 6) as max_gap, round(avg(abs(x - y)), 6) as mean_gap from j group by 1")


def set_symmetric_difference(spark, d):
    a, b = (x.select("query", "pos") for x in _two(spark, d))
    return evaluate.symmetric_difference(a, b)


_add("set_symmetric_difference", set_symmetric_difference, f"with {_TWO}, x as (select query, pos from a except all select query, pos from b), y as (select query, pos from b except all select query, pos from a) select query, pos, 'left' as side from x union all select query, pos, 'right' from y")


def agreement_verdicts(spark, d):
    s, q = _both(spark, d)
    hits = lambda t: search.threshold_search(s, q, M, t, O, 1, "scan").select(F.col("tid").alias("query"), "pos", "corr")
    return evaluate.agreement(hits(T), hits(T + 5e-5), T, O)


_ODD = f"with recursive {_corr()}, " + ", ".join(
    f"h{k} as (select tid, pos, corr from c where corr >= {t}), g{k} as (select tid, min(pos) as pos from h{k} group by 1 union all select g{k}.tid, (select min(h{k}.pos) from h{k} where h{k}.tid = g{k}.tid and h{k}.pos >= g{k}.pos + {O + 1}) from g{k} where g{k}.pos is not null), m{k} as (select distinct h{k}.* from h{k} join g{k} using (tid, pos))"
    for k, t in enumerate((T, T + 5e-5))
)
_add(
    "agreement_verdicts",
    agreement_verdicts,
    f"""{_ODD}, u as (select tid, pos, coalesce(a.corr, b.corr) as corr, a.corr is null or b.corr is null as odd from m0 a full join m1 b using (tid, pos)),
 w as (select *, case when pos - lag(pos) over (partition by tid order by pos) <= {O} then 0 else 1 end as new from u where odd),
 ch as (select *, sum(new) over (partition by tid order by pos) as chain from w),
 e as (select tid, chain, min(abs(corr - {T})) as near from ch group by 1, 2), v as (select tid, max(near) as near from e group by 1)
 select cast(u.tid as integer) as query, case when any_value(near) is null then 'same' when any_value(near) < 1e-4 then 'boundary' else 'different' end as verdict from u left join v using (tid) group by u.tid""",
)


def neighbour_verdicts(spark, d):
    s, q = _both(spark, d)
    near = lambda k, o: search.knn_search(s, q, M, k, o, "scan").select(F.col("tid").alias("query"), "k", "pos", "corr")
    return evaluate.neighbour_agreement(near(5, 0), near(5, 1))


_add("neighbour_verdicts", neighbour_verdicts, f"select unnest(range({len(STARTS)}))::integer as query, 'same' as verdict")


def matched_runs(spark, d):
    c, s = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/supplier.parquet")
    mode = lambda k: F.when(F.col(k) % 3 == 0, "knn").otherwise("threshold").alias("mode")
    return evaluate.matched_runs(c.select(F.col("c_custkey").alias("run_id"), mode("c_nationkey")), s.select((F.col("s_suppkey") * 2).alias("run_id"), mode("s_nationkey")))


_add(
    "matched_runs",
    matched_runs,
    """with a as (select c_custkey as run_id, case when c_nationkey % 3 = 0 then 'knn' else 'threshold' end as m from customer), b as (select s_suppkey * 2 as run_id, case when s_nationkey % 3 = 0 then 'knn' else 'threshold' end as m from supplier)
 select run_id, coalesce(a.m, b.m) as mode, case when b.m is null then 'only_left' when a.m is null then 'only_right' when a.m <> b.m then 'other_mode' else 'matched' end as status from a full join b using (run_id)""",
)


def set_relations(spark, d):
    a, b = (x.select("query", "pos") for x in _two(spark, d))
    return evaluate.set_relations(a, b)


_add("set_relations", set_relations, f"with {_TWO}, x as (select distinct query, pos from a), y as (select distinct query, pos from b), j as (select x.pos is not null as l, y.pos is not null as r from x full join y on x.query = y.query and x.pos = y.pos) select count(*) as in_union, count(*) filter (where l and r) as in_both, bool_and(l and r) as equal from j")


def slowest_ranks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return evaluate.slowest(e.select(F.col("user_id").alias("run"), F.col("value").alias("index_time"), (500 - F.col("value")).alias("query_time"))).select("run", _r("index_time").alias("index_time"), _r("query_time").alias("query_time"), "ranks")


_add("slowest_ranks", slowest_ranks, "select user_id as run, round(max(value), 6) as index_time, round(max(500 - value), 6) as query_time, count(*) as ranks from events group by 1")


def deduplicated_hits(spark, d):
    s, q = _both(spark, d)
    shards = search.threshold_search(s, q, M, T, 0, 1, "scan").unionByName(search.threshold_search(s, q, M, 0.3, 0, 1, "fft"))
    return results.deduplicated(shards).select(F.col("tid").cast("long").alias("tid"), "pos", _r("corr").alias("corr"))


_add("deduplicated_hits", deduplicated_hits, f"with {_corr()} select tid, pos, round(corr, 6) as corr from c where corr >= {T}")


def answer_digest(spark, d):
    a, _ = _two(spark, d)
    return evaluate.digest(a)


_add("answer_digest", answer_digest, f"with {_TWO} select query, md5(string_agg(cast(pos as varchar), ',' order by pos)) as digest from a group by 1")


def tolerant_matches(spark, d):
    a, b = (x.select("query", F.col("pos") * 10 + F.col("pos") % 7) for x in _two(spark, d))
    return evaluate.tolerant_matches(a.toDF("query", "pos"), b.toDF("query", "pos"), 4)


_add(
    "tolerant_matches",
    tolerant_matches,
    f"""with recursive {_TWO}, l as (select query, pos * 10 + pos % 7 as pos, row_number() over (partition by query order by pos) as n from a), r as (select query, pos * 10 + pos % 7 as pos from b),
 g as (select query, 0::bigint as n, null::bigint as pos, null::bigint as other, []::bigint[] as used from (select distinct query from l)
  union all select query, n, pos, other, case when other is null then used else list_append(used, other) end from (
   select g.query, l.n, l.pos, list_filter(g.used, lambda x: x >= l.pos - 4) as used,
    (select r.pos from r where r.query = g.query and r.pos between l.pos - 4 and l.pos + 4 and not list_contains(g.used, r.pos) order by abs(r.pos - l.pos), r.pos limit 1) as other
   from g join l on l.query = g.query and l.n = g.n + 1) s)
 select query, pos, other from g where other is not null""",
)


def _cases(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("samples"), (F.col("o_orderkey") % 5 * 8).alias("m"))


def case_audit(spark, d):
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    n, m = F.col("o_orderkey") % 7, F.col("o_custkey") % 9 * 8 + F.when(F.col("o_orderkey") % 13 == 0, 4).otherwise(0)
    q = read("orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 40).alias("key"), n.alias("count"), m.alias("window"), (n * m + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)).alias("floats"), (F.col("o_orderkey") % 17 == 0).cast("int").alias("rest"))
    waves = read("nation").select(F.col("n_nationkey").cast("long").alias("key"), (F.col("n_nationkey") * 5).alias("samples"))
    told = read("part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(2).alias("version"), F.when(F.col("p_partkey") % 3 == 0, 100).otherwise(50).alias("rate"), (F.col("p_partkey") % 19 == 0).cast("int").alias("bad"))
    other = read("supplier").select(F.col("s_suppkey").alias("key"), F.lit(2).alias("version"), F.lit(50).alias("rate"), (F.col("s_suppkey") % 8 == 0).cast("int").alias("bad"))
    return evaluate.audited(q, waves, told, other, 16, 4).select("path", F.concat_ws(",", "reasons").alias("reasons"), "valid")


_add(
    "case_audit",
    case_audit,
    """with q0 as (select o_orderkey as path, o_custkey % 40 as key, o_orderkey % 7 as n, o_custkey % 9 * 8 + case when o_orderkey % 13 = 0 then 4 else 0 end as m from orders),
 q as (select *, n * m + case when path % 11 = 0 then 1 else 0 end as floats, path % 17 = 0 as rest from q0),
 j as (select q.*, w.n_nationkey * 5 as samples, a.p_partkey as pa, b.s_suppkey as sb, a.p_partkey is not null and b.s_suppkey is not null as told from q left join nation w on w.n_nationkey = q.key left join part a on a.p_partkey = q.path left join supplier b on b.s_suppkey = q.key),
 r as (select path, list_filter([case when n <= 0 or m <= 0 then 'nonpositive' end, case when rest then 'remainder' end, case when floats <> n * m then 'query_floats' end, case when m % 8 <> 0 then 'window_multiple' end, case when m % 16 <> 0 then 'window_segments' end, case when m // 4 <= 0 then 'merge_offset' end,
  case when samples is null then 'no_waveform' end, case when samples < m then 'short_waveform' end, case when not told then 'no_metadata' end, case when told and pa % 5 = 0 then 'obsolete' end, case when told and pa % 3 = 0 then 'sampling_rate' end, case when told and (pa % 19 = 0 or sb % 8 = 0) then 'not_finite' end], lambda x: x is not null) as x from j)
 select path, array_to_string(x, ',') as reasons, len(x) = 0 as valid from r""",
)


def size_stratified_cases(spark, d):
    return evaluate.evenly_spaced(_cases(spark, d), 9, least=10).select("key", "samples")


_add("size_stratified_cases", size_stratified_cases, "with c as (select o_orderkey as key, o_custkey as samples, row_number() over (order by o_custkey, o_orderkey) - 1 as r from orders where o_custkey >= 10), n as (select count(*) as n from c) select key, samples from c where r in (select cast(round_even(i * (n - 1) / 8.0, 0) as bigint) from n cross join range(9) t(i))")


def plan_batches(spark, d):
    p = evaluate.plan(_cases(spark, d), [1, 2, 8], [0.5, 0.9])
    return evaluate.batches(p, 100, ["nodes"], ["value", "key"]).select("key", F.col("nodes").cast("long").alias("nodes"), "value", "row", "batch")


_add("plan_batches", plan_batches, "with p as (select o_orderkey as key, cast(n as bigint) as nodes, v as value, row_number() over (partition by n order by v, o_orderkey) as r from orders cross join (values (1), (2), (8)) t(n) cross join (values (0.5::double), (0.9::double)) u(v)) select key, nodes, value, r as row, (r - 1) // 100 as batch from p")


def run_limits(spark, d):
    return evaluate.run_limits(_cases(spark, d), [1, 2, 4, 8], 200).select(F.col("nodes").cast("long").alias("nodes"), "largest", "fitting", "cases")


_add("run_limits", run_limits, "select cast(n as bigint) as nodes, cast(max(ceil(o_custkey / n)) as bigint) as largest, count(*) filter (where ceil(o_custkey / n) <= 200) as fitting, count(*) as cases from orders cross join (values (1), (2), (4), (8)) t(n) group by 1")


def hash_split(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("station"))
    return c.select("station", F.crc32("station").alias("crc"), (F.crc32("station") % 4).alias("share"))


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c_name, ''), lambda ch: ascii(ch)::bigint)), lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda i: i::bigint)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)), 4294967295::bigint)"
_add("hash_split", hash_split, f"select c_name as station, {_CRC} as crc, {_CRC} % 4 as share from customer")


def names(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", X.slug(F.col("c_name")).alias("slug"), evaluate.case_seed(7, F.lit("ds"), F.col("c_name")).alias("seed"))


_add("names", names, "select c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, sha256('7:ds:' || c_name) as seed from customer")
