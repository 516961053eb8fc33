import numpy as np

from wavecairn.operators import vectors


def test_neighbours_in_query_slices(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (300, 8)).astype(float)  # many ties
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0])], "id long, v array<double>").repartition(3)
    queries = df.where("id % 50 = 0")
    for size, room in ((vectors.QUERY_BYTES, vectors.ROOM), (64 * 2, vectors.ROOM), (vectors.QUERY_BYTES, 150)):
        monkeypatch.setattr(vectors, "QUERY_BYTES", size)
        monkeypatch.setattr(vectors, "ROOM", room)
        got = {(r.query, r.k): (r.id, r.ed) for r in vectors.knn_l2(df, queries, 4, 8).collect()}
        assert len(got) == 6 * 4
        for q in range(0, 300, 50):
            ed = ((x - x[q]) ** 2).sum(1)
            order = [i for i in np.lexsort((np.arange(300), ed)) if i != q][:4]
            assert [got[q, k + 1] for k in range(4)] == [(i, ed[i]) for i in order]
    assert vectors.knn_l2(df, queries.limit(0), 4, 8).count() == 0
