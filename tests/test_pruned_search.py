"""Searches that skip most of an index, against those that read it all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import edges, lexical, vectors
from quarryline.runtime import written


def _texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        topic = k // 64 * 3
        rows.append((k, " ".join(["all", "most"][: rng.randint(1, 2)] + rng.choices(words[topic % 57 : topic % 57 + 3], k=rng.randint(1, 9)) + rng.choices(words, k=2))))
    return rows


@pytest.fixture(scope="module")
def index(spark):
    return lexical.build_index(spark.createDataFrame(_texts(1500), "id long, text string"))


def test_bounded_blocks_give_what_a_full_search_gives(spark, index, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_BLOCKS", 2)
    # Words of one topic, of two, words that nearly all documents have (their weight has a floor), and none.
    asked = spark.createDataFrame([(1, "w0 w1 w0"), (2, "w30 all"), (3, "all most"), (4, "w5 w50 w51 most"), (5, "nothing here")], "qid long, query string")
    whole = sorted(tuple(r) for r in lexical.top(index, asked, 5).select("qid", "id", "rank").collect())
    monkeypatch.setattr(lexical, "SCORE_ALL", -1)
    assert sorted(tuple(r) for r in lexical.top(index, asked, 5).select("qid", "id", "rank").collect()) == whole
    terms = written(lexical.query_terms(index, asked).drop("df"), "terms")
    read = lexical.best_in_blocks(index, terms, 5, 1.5, 0.75)[1]
    assert read.where("qid = 1").count() < lexical.block_bounds(index, terms).where("qid = 1").count() / 2
    assert read.where("qid = 1").select("block").distinct().count() < 24


def test_bounded_blocks_hold_for_negative_weights(spark, monkeypatch):
    # Two words in nearly all texts: the floor of their weight is a share of a mean that is negative itself.
    rows = [(k, "a b" if k % 9 else "a b c") for k in range(400)] + [(400, "x")]
    index = lexical.build_index(spark.createDataFrame(rows, "id long, text string"))
    assert index.corpus.first().mean_raw < 0
    asked = spark.createDataFrame([(1, "a"), (2, "a c"), (3, "x a")], "qid long, query string")
    whole = sorted(tuple(r) for r in lexical.top(index, asked, 6).select("qid", "id", "rank").collect())
    monkeypatch.setattr(lexical, "SCORE_ALL", -1)
    assert sorted(tuple(r) for r in lexical.top(index, asked, 6).select("qid", "id", "rank").collect()) == whole


def test_bounds_are_no_less_than_any_score(spark, index):
    asked = spark.createDataFrame([(k, f"w{k} w{k + 2} all") for k in range(0, 50, 5)], "qid long, query string")
    terms = lexical.query_terms(index, asked).drop("df")
    sums = lexical.block_bounds(index, terms).groupBy("qid", "block").agg(F.sum("bound").alias("bound"))
    met = lexical.scores(index, asked).withColumn("block", lexical.block_of(F.col("id"))).join(sums, ["qid", "block"])
    assert met.where("score > bound + 1e-9").isEmpty() and met.count() > 100


def _clustered(n, seed=3, dims=8, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    rows = middle[rng.integers(0, centres, n)] + rng.normal(scale=0.05, size=(n, dims))
    rows[:60] = rows[0]  # one vector many times
    return [(k, v.tolist()) for k, v in enumerate(rows / np.linalg.norm(rows, axis=1, keepdims=True))]


def test_cells_give_the_nearest_of_all(spark, monkeypatch):
    rows = _clustered(900)
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = frame.where("id % 3 = 0").withColumnRenamed("id", "qid")
    matrix = np.array([v for _, v in rows])
    scores = np.round(matrix @ matrix.T, 9)
    want = sorted((q, int(i)) for q in range(0, 900, 3) for i in np.lexsort((np.arange(900), -scores[q]))[:5])
    monkeypatch.setattr(vectors, "PIECE", 50)
    monkeypatch.setattr(vectors, "PASS", 10)
    assert sorted((r.qid, r.id) for r in vectors.top(frame, asked, 5).collect()) == want
    _, met = vectors.top_by_cells(frame, asked, 5)
    n_cells = vectors.in_cells(frame, vectors.fit_pivots(frame, 900)).select("cell").distinct().count()
    assert met.count() < 0.8 * 300 * n_cells


def test_cells_of_few_odd_and_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PASS", 1)
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [-1e3, 1.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "qid long, embedding array<double>")
    got = sorted((r.qid, r.id, r.rank) for r in vectors.top(frame, asked, 3).collect())
    assert got == [(7, 1, 1), (7, 2, 2), (7, 5, 3), (8, 1, 1), (8, 2, 2), (8, 5, 3)]
    assert vectors.top(frame.limit(0), asked, 3).count() == 0 and vectors.top(frame, asked.limit(0), 3).count() == 0


def test_a_deep_chain_of_bases_takes_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(edges, "written", lambda df, label: made.append(label) or written(df, label))
    chain = spark.createDataFrame([(f"C{k}", f"C{k + 1}", 0) for k in range(500)], "class string, base string, pos int")
    reached = edges.ancestry(chain).where("class = 'C0'")
    assert reached.agg(F.max("depth"), F.count("*")).first() == (500, 501)
    assert len(made) - 1 <= 10


def test_ancestry_keeps_the_order_of_the_search(spark):
    rng = random.Random(4)
    bases = [(f"C{k}", f"C{b}", pos) for k in range(40) for pos, b in enumerate(rng.sample(range(40), rng.randint(0, 3)))]
    of = {}
    for c, b, p in bases:
        of.setdefault(c, []).append((p, b))
    want = set()
    for c in of:
        seen, front = {c: (0, ())}, [((), c)]
        while front:
            step = {}
            for path, at in sorted(front):
                for p, b in sorted(of.get(at, [])):
                    if b not in seen:
                        step.setdefault(b, (*path, p))
            seen |= {b: (len(path), path) for b, path in step.items()}
            front = [(path, b) for b, path in step.items()]
        want |= {(c, a, d, path) for a, (d, path) in seen.items()}
    got = {(r["class"], r.ancestor, r.depth, tuple(r.path)) for r in edges.ancestry(spark.createDataFrame(bases, "class string, base string, pos int")).collect()}
    assert got == want
