import random
import re

import numpy as np
from pyspark.sql import functions as F

from quarryline.llm.ngram_join import common_depth, jaccard_classes, linked, match_depth, overlaps, signatures

SCHEMA = "doc_id long, text string, source string, keys string"


def brute(rows, n=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    near = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9} for i in sets}
    label = {}
    for i in sorted(sets):
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += near[x]
    return {i: (label[i], len(near[i]), len(sets[i])) for i in sets}


def corpus(seed, families=12, size=10, words=60):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "s", "x") for i, t in rows], SCHEMA)
    return {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in jaccard_classes(df, **more).collect()}


def test_matches_brute_force(spark):
    rows = list(enumerate(corpus(1)))
    assert found(spark, rows) == brute(rows)


def test_large_components_go_in_blocks(spark):
    rows = list(enumerate(corpus(2, families=2, size=40)))
    assert found(spark, rows, block=5) == brute(rows)


def test_nulls_empty_short_and_repeated_texts(spark):
    rows = [(1, None), (2, ""), (3, " !! "), (4, "one two"), (5, "One  two"), (6, "a b c d e"), (7, "A B C D E"), (8, "word " * 30000)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_missing_id_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_classes(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e", None, None), (3, "a b c d e", None, None), (3, "a b c d e", None, None)], SCHEMA)
    got = sorted((r.doc_id is None, r.class_id, r.n_links) for r in jaccard_classes(df).collect())
    assert got == [(False, 3, 1), (False, 3, 1), (True, None, 0)]


def test_depth_shortens_until_the_target():
    assert match_depth(0.8, 20, 8, 0.9999) == 4
    assert match_depth(0.8, 20, 8, 0.5) > match_depth(0.8, 20, 8, 0.999)


def family(n, seed=4):
    """Sets of 200 numbers, each but the first with up to 30 others."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    return [np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in rng.integers(0, 30, n)]


def descent(sets, target, floor=4, threshold=0.8):
    nodes = np.arange(len(sets))
    keys, tails = signatures(sets, 20, floor, 8)
    groups = []
    for t in range(20):
        for key in np.unique(keys[:, t]):
            groups.append((-1, np.flatnonzero(keys[:, t] == key)))
    return linked(nodes, np.ones(len(sets), np.int64), keys, tails, sets, groups, None, threshold, target, floor)


def test_longest_prefix_of_a_pair():
    sets = [np.arange(50, dtype=np.uint64) << np.uint64(33), np.arange(50, dtype=np.uint64) << np.uint64(33), np.arange(90, 140, dtype=np.uint64) << np.uint64(33)]
    keys, tails = signatures(sets, 20, 4, 8)
    same, depth = common_depth(keys, tails, 0, np.array([1, 2]), 4)
    assert same[0].all() and depth[0] == 8 and not same[1].any() and depth[1] == 0


def test_prefixes_are_shortened_until_the_recall_is_reached():
    sets = family(400)
    links = sum(len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9 for i, a in enumerate(sets) for b in sets[:i])
    met, found = {}, {}
    for target in (0.9, 0.99, 0.9999, 1.0):
        n, _, met[target] = descent(sets, target)
        found[target] = n.sum() / 2 / links
        assert found[target] >= target - 0.001
    # The higher the recall, the shorter the prefixes and the more pairs meet.
    assert met[0.9] < met[0.99] < met[1.0] and met[0.9999] <= met[1.0]


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    found = 0
    for _ in range(300):
        base = rng.integers(0, 2**63, 90, dtype=np.uint64)
        pair = [np.unique(base), np.unique(np.concatenate([base[10:], rng.integers(0, 2**63, 10, dtype=np.uint64)]))]
        found += descent(pair, 0.9999)[0][0]
    assert found >= 299


def test_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in jaccard_classes(docs.withColumn("extra", F.lit(1))).collect()}
    assert got == brute(rows)


def test_overlaps_are_exact():
    sets = family(40) + [np.zeros(0, np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert overlaps(sets, sets).tolist() == want
    assert overlaps(sets[:9], sets[9:]).tolist() == [row[9:] for row in want[:9]]
    assert overlaps([], sets).shape == (0, 41)


def test_counts_of_a_large_family_are_whole_whatever_the_block(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(1500):
        w = list(base)
        k = rng.choice([0, 1, len(w) - 1])
        w[k] = f"v{i}"
        rows.append((i, " ".join(w)))
    want = brute(rows)
    assert found(spark, rows, block=400) == want
    assert found(spark, rows, block=2000) == want
