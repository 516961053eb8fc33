import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_decontaminate import split
from test_nearup import brute as groups
from tokenizers import Tokenizer

from wavecairn.llm import common, decontaminate, pii, quality


def test_stages_against_plain_versions(spark):
    d = "/root/testdata/sf0.001"
    docs = common.documents(spark, d)
    columns, rows = docs.columns, [r.asDict() for r in docs.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    items = [(r.item_id, split(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, d), name)
        got.append([r.asDict() for r in docs.collect()])
        if name != "byte_pairs":
            assert docs.columns == columns
    ids = lambda rs: sorted(r["doc_id"] for r in rs)
    # quality: the model applied row by row
    model = quality.train(common.documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))
    good = [r for r in rows if quality.strengths(model, quality.matrix([r["text"]]))[0] >= 0]
    assert ids(got[0]) == ids(good)
    assert np.mean([labels[r["doc_id"]] for r in good if r["doc_id"] in labels]) > 0.9
    # near-duplicates: components of the exact graph
    heads = {c for i, _, c in groups([(r["doc_id"], r["text"]) for r in good], 5, 80)}
    assert ids(got[1]) == sorted(heads)
    # decontamination: documents that hold an item whole go, those without any five words of one stay
    runs = {tuple(w[k : k + 5]) for _, w in items for k in range(len(w) - 4)}
    for r in got[1]:
        w = split(r["text"])
        text = f" {' '.join(w)} "
        whole = any(f" {' '.join(x)} " in text for _, x in items)
        none = not any(tuple(w[k : k + 5]) in runs for k in range(len(w) - 4))
        assert not whole or r["doc_id"] not in ids(got[2])
        assert not none or r["doc_id"] in ids(got[2])
    assert decontaminate.COVER == 0.5
    # personal data: texts redacted one by one
    want = {r["doc_id"]: pii.redact(r["text"], pii.spans(r["text"])[1]) for r in got[2]}
    assert {r["doc_id"]: r["text"] for r in got[3]} == want and all(r["n_chars"] == len(r["text"]) for r in got[3])
    # token ids: the tokenizers library
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got[4]:
        e = t.encode(want[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == e and r["ids_sha256"] == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
    assert ids(got[4]) == sorted(want)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == sorted(want)


def test_stages_take_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", None, "s", 15), (3, "mail me@x.org now", "en", None, 17), (3, "mail me@x.org now", "en", None, 17), (4, "a " * 60_000, "en", "s", 1)]
    for t, s in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("documents", schema)):
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.createDataFrame(rows, schema)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = common.stored(stage(spark, docs, str(tmp_path)), name), common.stored(stage(spark, empty, str(tmp_path)), name)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "3", "4", "None"] and empty.count() == 0
