"""Trees that executors list, hubs of the graph, and a cache with several writers."""

import random

import numpy as np
from pyspark.sql import functions as F

from quarryline.operators import edges, vectors
from quarryline.sources import files


def test_a_tree_written_listed_and_read_by_executors(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"{'/'.join(rng.choices(['a', 'b', '_c', '.d', 'é x'], k=rng.randint(0, 5)))}/f{k}.py".lstrip("/"), rng.choice(["", "x = 1\n", "# ü\r\n", None])) for k in range(300)]
    rows += [("p/__init__.py", "p"), (".git/h.py", "h"), ("q/.venv/v.py", "v"), ("n.txt", "n")]
    root = f"file://{tmp_path}/tree"
    frame = spark.createDataFrame(rows, "file string, text string")
    assert files.write_tree(frame, root) == len(rows)
    assert files.write_tree(frame, root) == len(rows)  # again: the same files
    assert {(r.file, r.size) for r in files.scan_tree(spark, root).collect()} == {(f, len((t or "").encode())) for f, t in rows if ".git/" not in f and ".venv/" not in f}
    assert {(r.file, r.text) for r in files.read_sources(spark, root).collect()} == {(f, t or "") for f, t in rows if f.endswith(".py")}
    (tmp_path / "none").mkdir()
    assert files.scan_tree(spark, str(tmp_path / "none")).count() == 0


def test_a_store_of_ones_own(spark, tmp_path):
    from pyarrow import fs

    (tmp_path / "one.py").write_bytes(b"\xff1")
    place = str(tmp_path)
    opener = lambda uri: (fs.LocalFileSystem(), uri.replace("mine://", place + "/", 1))
    assert [tuple(r) for r in files.read_sources(spark, "mine://", opener=opener).collect()] == [("one.py", "�1")]


def test_edges_of_a_hub_are_ranked_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(edges, "PIECE_EDGES", 40)
    rng = random.Random(3)
    rows = [(k + 1, "hub" if rng.random() < 0.6 else f"n{rng.randrange(9)}", "hub" if rng.random() < 0.3 else f"n{rng.randrange(9)}", "CALLS", k) for k in range(1000)]
    frame = spark.createDataFrame(rows, "ord long, source string, target string, type string, line int")
    want = set()
    for node in {n for _, s, t, _, _ in rows for n in (s, t)}:
        own = [("incoming", o, s, t, line) for o, s, t, _, line in rows if t == node] + [("outgoing", o, s, t, line) for o, s, t, _, line in rows if s == node]
        want |= {(node, s, t, line, d, k) for k, (d, _, s, t, line) in enumerate(sorted(own), 1)}
    near = edges.relationships(frame, spark.createDataFrame([(n,) for n in {w[0] for w in want}], "node string"))
    assert {tuple(r) for r in near.select("node", "source", "target", "line", "direction", "place").collect()} == want


def test_a_hub_of_many_edges_bounds_every_window(spark):
    frame = spark.range(1_000_000).select((F.col("id") + 1).alias("ord"), F.lit("hub").alias("source"), F.concat(F.lit("n"), (F.col("id") % 1000).cast("string")).alias("target"), F.lit("CALLS").alias("type"), F.col("id").cast("int").alias("line"))
    near = edges.relationships(frame, spark.createDataFrame([("hub",)], "node string"))
    assert near.agg(F.count("*"), F.sum((F.col("place") == F.col("line") + 1).cast("int")), F.max("place")).first() == (1_000_000,) * 3
    pieces = frame.groupBy(F.floor(F.col("ord") / edges.PIECE_EDGES)).count()
    assert pieces.agg(F.max("count")).first()[0] <= edges.PIECE_EDGES


def test_the_cache_serves_nulls_and_two_writers(spark, tmp_path):
    bag = lambda texts: np.array([[len(t), 1.0] for t in texts])
    encode = lambda t: vectors.encode(t, bag, "digest")
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "bbb"), (4, "")], "id long, text string")
    path = str(tmp_path / "cache")
    late = lambda missing: (files.cached_vectors(docs.where("id < 3"), path, encode).count(), encode(missing))[1]
    # Another job fills the cache between this one's look and its append.
    got = files.cached_vectors(docs, path, late).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4]
    assert sorted(r.id for r in files.cached_vectors(docs, path, encode).collect()) == [1, 2, 3, 4]
