import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import exact_dedup, mixing, sharding

DOCS = "doc_id long, text string, source string, lang string, bucket int, shard string, taken int"
BLANKS = " \t\n\x0b\x0c\r"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, "x", 9) for i, t, s in rows], DOCS)


def brute_exact(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in BLANKS)
    out = []
    for i, t in rows:
        group = [(j, u) for j, u in rows if norm(u) == norm(t)]
        lead = min(group, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        kept = i == lead[0] and len(t or "") == len(lead[1] or "")
        out.append((i, lead[0], len(group), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def test_exact_matches_brute_force_on_hard_rows(spark):
    rng = random.Random(1)
    rows = [(None, None), (5, ""), (3, " \x0b\x0c"), (9, "a b"), (2, "ab"), (7, "a  b"), (-4, "a  b"), (None, "a  b"), (8, " "), (8, " "), (2**63 - 1, "q"), (-(2**63), "q"), (6, "x" * 200_000)]
    rows += [(100 + k, rng.choice(["x y", "xy ", "z", "é", "é", "🙂", "\U0001f642 "])) for k in range(60)]
    got = exact_dedup.exact_duplicates(docs(spark, [(i, t, None) for i, t in rows]))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == sorted(brute_exact(rows), key=key)
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    rows = [(k, f"text {k}", None) for k in range(400)]
    frame = docs(spark, rows)
    index, _, _ = exact_dedup.build_index(frame, exact_dedup.narrow_rows(frame), 16, 10)
    per = index.groupBy("bucket").agg(F.count("*").alias("n"), F.min("depth").alias("d"), F.max("depth").alias("e")).collect()
    assert max(r.n for r in per) <= 16 and all(r.d == r.e for r in per) and len(per) > 10
    assert sum(r.n for r in per) == 400
    # A bucket covers the whole of its key range, and no parent would have fitted.
    for r in per:
        low = r.bucket >> (10 - r.d + 1) << (10 - r.d + 1)
        assert sum(x.n for x in per if low <= x.bucket < low + (1 << (10 - r.d + 1))) > 16


def test_rows_reach_their_entry_only_through_the_directory(spark):
    frame = docs(spark, [(k, f"text {k % 90}", None) for k in range(200)])
    rows = exact_dedup.narrow_rows(frame)
    index, directory, bits = exact_dedup.build_index(frame, rows, 8, 8)
    assert exact_dedup.probe(rows, index, directory, bits).count() == 200
    moved = directory.withColumn("bucket", F.col("bucket") + F.when(F.col("pointer") % 2 == 0, 1).otherwise(0))
    assert exact_dedup.probe(rows, index, moved, bits).count() < 200


def test_two_texts_of_one_digest_are_told_apart_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_key", lambda bare: F.lit(7).cast("long"))
    monkeypatch.setattr(exact_dedup, "_digest", lambda bare: F.unhex(F.lit("00")))
    with pytest.raises(Exception, match="one SHA-256"):
        exact_dedup.exact_duplicates(docs(spark, [(1, "a", None), (2, "b", None)])).collect()


def test_pointers_grow_with_the_keys():
    assert [exact_dedup.pointer_bits(n, 4096) for n in (0, 4096, 8192, 2**40)] == [4, 4, 5, exact_dedup.MAX_DEPTH]


def test_colliding_keys_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_key", lambda bare: F.lit(7).cast("long"))
    got = exact_dedup.exact_duplicates(docs(spark, [(1, "a", None), (2, "b", None), (3, "a ", None)]), capacity=1)
    assert sorted((r.doc_id, r.keep_id, r.chain) for r in got.collect()) in ([(1, 3, 0), (2, 2, 1), (3, 3, 0)], [(1, 3, 1), (2, 2, 0), (3, 3, 1)])


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cell = np.arange(1 << (dims * bits))
    coords = np.stack([(cell >> (bits * k)) & ((1 << bits) - 1) for k in range(dims)], axis=1)
    index = sharding.hilbert_index(coords, bits)
    assert sorted(index) == list(range(len(cell)))
    assert (np.abs(np.diff(coords[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_shards_are_even_whole_and_ordered(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["", "copy", None, "t" * rng.randint(1, 900), f"t{k}"]), rng.choice(["a", "a", "a", "b", None])) for k in range(203)] + [(5, "again", None)] * 3
    narrow = sharding.describe_rows(docs(spark, rows))
    got = sharding.hilbert_shards(narrow, 24, group="text_key").collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    order = [(r.curve, r.text_key, r.doc_id) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    # Equal texts lie side by side in the whole order.
    keys = [k for _, k, _ in order]
    assert sum(a != b for a, b in zip(keys, keys[1:])) == len(set(keys)) - 1
    assert sharding.hilbert_shards(sharding.describe_rows(docs(spark, [])), 24).count() == 0
    few = sharding.hilbert_shards(sharding.describe_rows(docs(spark, rows[:5])), 24).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(k, 0) for k in range(5)]


def water(sizes, weights=(5, 2, 1), repeats=3):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > repeats * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = repeats * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixture_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randint(0, 40)) if k % 11 else None, rng.choice(["a"] * 8 + ["b", "c", "d", "e", None])) for k in range(400)]
    frame = docs(spark, rows).withColumn("size", mixing.word_count(F.col("text")))
    got = mixing.mix(frame).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r["size"]
    want = water(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and r["size"] == len((r.text or "").split())
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix(frame.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}
    times = Counter(r.doc_id for r in mixing.repeated(mixing.mix(frame)).collect())
    assert times == Counter({r.doc_id: -(-r.taken // r["size"]) for r in got if r.taken})


def test_mixture_of_nothing(spark):
    none = docs(spark, []).withColumn("size", F.lit(0).cast("long"))
    assert mixing.mix(none).count() == 0
    blank = docs(spark, [(1, None, None), (1, " ", None), (None, "", "a")]).withColumn("size", mixing.word_count(F.col("text")))
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0, 0]
    one = docs(spark, [(1, "a b", "s"), (1, "a b", "s")]).withColumn("size", mixing.word_count(F.col("text")))
    assert sorted(r.taken for r in mixing.mix(one).collect()) == [2, 2]


INNER = ("held", "label0", "label1", "tie0", "tie1", "group", "of", "lead", "value0", "place0", "cell", "at_cell", "at", "total", "row", "place", "part", "own", "ahead", "before", "inside", "amount", "origin", "of_part", "offset", "key", "times", "sum", "curve_", "id")


def test_columns_of_any_name_stay_as_they_are(spark):
    rows = docs(spark, [(k, "a b " * (k % 5), "s" if k % 3 else "t") for k in range(50)])
    odd = rows.select("*", F.xxhash64("text").alias("text_key"), *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in INNER]).withColumn("size", mixing.word_count(F.col("text")))
    for got in (sharding.hilbert_shards(odd, 5, group="text_key"), mixing.mix(odd), mixing.mixed_documents(odd)):
        assert set(odd.columns) - {"shard", "taken"} <= set(got.columns) and len(set(got.columns)) == len(got.columns)
        found = got.collect()
        assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in INNER)
    few = odd.select("doc_id", "text", "lang", "curve_", F.lit(3).alias("curve"), *INNER[:3], "size", "source", "text_key")
    assert {r.curve for r in sharding.hilbert_shards(few, 5, outputs=("shard", "slot")).collect()} == {3}


def test_label_with_many_values_is_ranked_without_one_task(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BROADCAST_VALUES", 0)
    rows = docs(spark, [(k, f"text {k}", f"s{k % 97}") for k in range(300)])
    got = sharding.hilbert_shards(sharding.describe_rows(rows), 7).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(7) for k in range(43 if s < 6 else 42)]
    place = {r.value: r.position for r in sharding.rank_positions(rows, "source", 5).collect()}
    names = sorted(f"s{k % 97}" for k in range(300))
    assert place == {n: names.index(n) * 32 // 300 for n in names}
