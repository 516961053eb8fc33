import hashlib

import duckdb

from wavecairn.llm import common, lines
from wavecairn.llm.queries import ORACLES, op7_lines


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(con.execute(ORACLES["op7_lines"]).fetchall())
    got = op7_lines(spark, d)
    assert got.columns == ["doc_id", "n_units", "n_removed", "n_repeated", "n_passages", "removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == want and sum(r[2] for r in want) > 50 and sum(r[4] for r in want) > 50


def test_odd_rows(spark):
    line, other = "one two  three four five", "six seven eight nine ten"
    rows = [
        (1, None), (2, ""), (3, f"{line}\nshort\n{other}"), (4, f"x\nOne two three\tfour five\nshort\n"), (None, f"{line}\n{line}"),
        (5, f"{other}\n\n{other}\n"), (5, f"{other}\n\n{other}\n"), (5, "é"), (6, "\n".join(["a b c d e"] * 3000)), (3, f"{line} "),
    ]
    docs = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, place int, gone string")
    got = sorted((str(r.doc_id), r.n_units, r.n_removed, r.kept, [tuple(x) for x in r.removed]) for r in lines.dedup(docs, least_words=5).collect())
    want = {
        "1": [(0, 0, None, [])],
        "2": [(0, 0, "", [])],
        "4": [(4, 1, "x\nshort\n", [(2, 25)])],
        "None": [(2, 2, "", [(0, 24), (25, 49)])],
        "5": [(1, 0, "é", []), (4, 2, "\n", [(0, 24), (26, 50)]), (4, 2, "\n", [(0, 24), (26, 50)])],
    }
    for i, rows_ in want.items():
        assert sorted(x[1:] for x in got if x[0] == i) == rows_
    assert [x[1:4] for x in got if x[0] == "6"] == [(3000, 2999, "a b c d e")]
    first = min((hashlib.sha256(t.encode()).hexdigest(), t) for i, t in rows if i == 3)[1]
    assert sorted(x[2] for x in got if x[0] == "3") == ([0, 1] if first else [])
    assert lines.dedup(docs.limit(0)).count() == 0


def test_paragraphs_keep_their_breaks():
    text = "a b c d e\nf\n\ng h i j k\n \nz"
    assert [text[s:e] for s, e, _ in lines.units(text, "paragraph")] == ["a b c d e\nf", "g h i j k", "z"]
    assert lines.without(text, {1}, "paragraph") == ("a b c d e\nf\n\nz", [{"s": 13, "e": 22}])


def test_short_lines_go_and_passages_inside_lines_are_told(spark):
    passage = "one two three four five six. Seven eight nine ten eleven twelve thirteen! Yes. " + " ".join(f"w{k}" for k in range(20)) + "?"
    rows = [(1, f"intro here {passage} outro a\nHi"), (2, f"other words {passage.upper()} z\nhi "), (3, "one two three four five six."), (4, "hi\nhi")]
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), passage=28).collect()}
    assert [got[k].n_removed for k in (1, 2, 3, 4)] == [0, 1, 0, 2]
    assert [got[k].n_repeated for k in (1, 2, 3, 4)] == [1, 1, 0, 2]
    assert [got[k].n_passages for k in (1, 2, 3, 4)] == [0, 0, 0, 0]  # 27 words: the first sentence is not alone
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), passage=27).collect()}
    assert [[x.words for x in got[k].passages] for k in (1, 2, 3, 4)] == [[27], [27], [], []]
    (span,) = got[1].passages
    assert rows[0][1][span.s : span.e].startswith("Seven eight") and rows[0][1][span.s : span.e].endswith("w19?")


def test_frequent_units_meet_by_broadcast(spark, monkeypatch):
    rows = [(k, f"the same line of words\nown line number {k}\n") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(str, lines.dedup(docs).collect()))
    monkeypatch.setattr(common, "HOT", 1)  # nothing is frequent
    assert sorted(map(str, lines.dedup(docs).collect())) == plain
    assert sum("n_removed=1" in x for x in plain) == 2999
