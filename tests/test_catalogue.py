"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from wavecairn import catalogue, catalogue_files

QUERIES, ORACLES = catalogue.QUERIES | catalogue_files.QUERIES, catalogue.ORACLES | catalogue_files.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got
    if name in ORACLES:
        out = con.execute(ORACLES[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        want = sorted((tuple(r[names.index(c)] for c in columns) for r in out.fetchall()), key=str)
        assert got == want


def test_padded_neighbours_are_those_of_the_whole_series(spark, con, sf_dir):
    found = {(r.tid, r.k): (r.pos, r.corr) for r in con.execute(catalogue._sql_knn(5, 200)).fetchdf().itertuples()}
    got = {(r.tid, r.k): (r.pos, r.corr) for r in catalogue.QUERIES["knn_padded"](spark, sf_dir).collect()}
    assert got == {(tid, k): found.get((tid, k), (None, None)) for tid in range(len(catalogue.STARTS)) for k in range(1, 6)}


@pytest.fixture(scope="module")
def ties(spark, tmp_path_factory):
    """Events of a few values only, so that the mean of many segments is exactly that of their window."""
    d = str(tmp_path_factory.mktemp("ties"))
    duckdb.sql(f"copy (select i as event_id, timestamp '2024-01-01' + to_seconds(i) as ts, (hash(i) % 5) / 10.0::double + 0.1 as value from range(3000) t(i)) to '{d}/events.parquet' (format parquet)")
    return d


def same_as_sql(spark, d, name):
    df = QUERIES[name](spark, d)
    out = duckdb.execute(ORACLES[name].replace("from events", f"from '{d}/events.parquet'"))
    names = [x[0] for x in out.description]
    want = sorted(out.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == want and want


def test_ties_in_postings(spark, ties):
    same_as_sql(spark, ties, "index_postings")


def test_ties_in_roots(spark, ties):
    same_as_sql(spark, ties, "isax_root_histogram")


def test_ties_in_bounds(spark, ties):
    same_as_sql(spark, ties, "lower_bound")


def write_events(folder, values):
    rows = ", ".join(f"({i}, {float(v)!r}::double)" for i, v in enumerate(values))
    duckdb.sql(f"copy (select i as event_id, timestamp '2024-01-01' + to_seconds(i) as ts, v as value from (values {rows}) t(i, v)) to '{folder}/events.parquet' (format parquet)")
    return str(folder)


def test_bounds_beside_a_half_are_rounded_as_in_sql(spark, tmp_path):
    """Of events of sf0.1 20 times: a bound within rounding of 201.5183205."""
    values = [(7 * i * i + i) % 97 for i in range(900)]
    values[100:164] = [50.91] * 20 + [67.07] * 20 + [7.94] * 20 + [34.15] * 4
    values[813:877] = [21.6] * 7 + [0.54] * 20 + [3.61] * 20 + [53.98] * 17
    same_as_sql(spark, write_events(tmp_path, values), "lower_bound")


def test_bounds_of_a_constant_template(spark, tmp_path):
    values = [(7 * i * i + i) % 97 / 10 for i in range(900)]
    values[390:470] = [5.3] * 80
    same_as_sql(spark, write_events(tmp_path, values), "lower_bound")


def test_bounds_equal_those_of_sql_before_rounding(spark, ties):
    """One thread of SQL adds segments in order (but for a few groups that lie in two chunks); with more the order, and so the last bits, change from run to run."""
    con = duckdb.connect(config={"threads": 1})
    sql = ORACLES["lower_bound"].replace("from events", f"from '{ties}/events.parquet'")
    bare = sql.replace("round(8 * sum(", "(8 * sum(").replace("2)), 6) as bound", "2))) as bound")
    assert bare != sql
    want = {(t, p): b for t, p, b in con.execute(bare).fetchall()}
    got = {(r.tid, r.pos): r.bound for r in catalogue._bounds(spark, ties).collect()}
    assert got.keys() == want.keys() and sum(got[k] != want[k] for k in want) < len(want) / 100


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
