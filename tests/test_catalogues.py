import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecairn import config
from wavecairn.__main__ import run
from wavecairn.sources import catalogues, results

XML = """<?xml version="1.0"?><q><eventParameters>
<event publicID="e1"><origin publicID="o1"><arrival><pickID>p1</pickID><phase>P</phase></arrival><arrival><pickID>none</pickID></arrival></origin>
<pick publicID="p1"><time><value>2020-01-02T03:04:05.5Z</value></time><waveformID networkCode="N" stationCode=" S " channelCode="HHZ"/></pick></event>
<event publicID="e2"><origin publicID="o2"/></event></eventParameters></q>"""


def test_csv_and_event_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Station,channel,starttime,endtime,other\n S1 ,HHZ,2020-01-01 00:00:00,2020-01-01 00:00:10,x\nS2,HHN,bad,2020-01-01 00:00:10,y\n")
    (row,) = catalogues.read(spark, str(tmp_path / "t.csv")).collect()
    assert (row.network, row.station, row.channel, row.endtime.second) == ("", "S1", "HHZ", 10)
    (tmp_path / "e.xml").write_text(XML)
    (pick,) = catalogues.read_events(spark, str(tmp_path / "e.xml")).collect()
    assert (pick.event, pick.station, pick.location, pick.phase) == ("e1", "S", "", "P")
    (window,) = catalogues.read(spark, str(tmp_path / "e.xml")).collect()
    assert (window.endtime - window.starttime).total_seconds() == 120 and (pick.time - window.starttime).total_seconds() == 2
    with pytest.raises(ValueError):
        catalogues.read(spark, "x", "other")
    samples = spark.createDataFrame([("HHZ", 1.0), ("HHZ", 9.0), ("BHZ", 1.0)], "channel string, ts double")
    assert catalogues.traces(samples, F.lit(0), F.lit(5), channel=["H*"]).count() == 1


def test_command_line(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal(3000).astype("<f4")
    x.tofile(tmp_path / "w.bin")
    np.concatenate([x[100:164], x[900:964]]).tofile(tmp_path / "t.bin")
    base = ["--waveform", str(tmp_path / "w.bin"), "--templates", str(tmp_path / "t.bin"), "--window", "64", "--span", "500", "--strategy", "scan"]
    run(spark, config.parse([*base, "--mode", "knn", "--neighbours", "2", "--merge-offset", "16", "--output", str(tmp_path / "knn"), "--timings", str(tmp_path / "time")]))
    found = results.read_neighbours(spark, str(tmp_path / "knn")).where("k = 1").collect()
    assert [(r.tID, r.pos) for r in found] == [(0, 100), (1, 900)] and all(abs(r.corr - 1) < 1e-6 for r in found)
    hits = run(spark, config.parse([*base, "--threshold", "0.99", "--dataset-size", "500", "--output", str(tmp_path / "hits")]))
    assert [(r.tid, r.pos) for r in hits.collect()] == [(0, 100)]
    with pytest.raises(ValueError):
        config.parse([*base, "--mode", "none"])
