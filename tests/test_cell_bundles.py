"""Searches by cells at more rows: what is sent and written a query does not grow with the cells."""

import numpy as np

from quarryline.operators import vectors
from quarryline.runtime import made


def test_a_query_is_sent_to_few_bundles_however_many_cells_there_are(spark, monkeypatch):
    n, rng = 3600, np.random.default_rng(5)
    matrix = rng.normal(size=(n, 12))  # no cell can be left out
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(matrix)], "id long, embedding array<double>")
    monkeypatch.setattr(vectors, "SIDE", 3, raising=False)
    before = made()
    found, met = vectors.top_by_cells(frame, frame.withColumnRenamed("id", "qid"), 4)
    got = {}
    for r in found.collect():
        got.setdefault(r.qid, []).append((-r.score, r.id))
    scores = np.round(matrix @ matrix.T, 9)
    assert all([i for _, i in sorted(got[q])[:4]] == np.lexsort((np.arange(n), -scores[q]))[:4].tolist() for q in range(n))
    assert met.count() > 8 * n
    tables = [p for p in made()[len(before) :] if "/first-cells-" not in p]  # those are results
    assert tables and all(spark.read.parquet(p).count() <= 6 * n for p in tables)


def test_scores_below_the_one_to_reach_are_left_out_and_ties_by_nine_digits_kept():
    rng = np.random.default_rng(2)
    scores = np.round(rng.normal(size=(500, 40)), 1) + rng.normal(scale=1e-10, size=(500, 40))
    ids, rounded = rng.permutation(500), np.round(scores, 9)
    rows, columns = vectors.best_of(ids, rounded, 5)
    want = list(zip(ids[rows], columns, rounded[rows, columns], strict=True))
    kth = np.sort(rounded, axis=0)[-5]
    for least in (np.full(40, np.nan), kth, np.where(np.arange(40) % 2, kth, np.nan)):
        rows, columns, found = vectors.best_dots(ids, scores, 5, least)
        assert list(zip(ids[rows], columns, found, strict=True)) == want
    assert len(vectors.best_dots(ids, scores, 5, np.full(40, 99.0))[0]) == 0
