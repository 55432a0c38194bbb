import random

import numpy as np
import pytest

from quarryline.llm import suffix_array, suffix_dedup

DOCS = "doc_id long, text string, body string, doc int, tie int, at int, spans string, bucket int"


def test_suffix_arrays_and_common_prefixes_match_brute_force(monkeypatch):
    rng = random.Random(1)
    for trial in range(120):
        # No waves: the induction of many letters.
        monkeypatch.setattr(suffix_array, "WAVE_LETTERS", 0 if trial % 3 == 0 else 1024)
        pieces = [bytes(rng.choices(rng.choice([b"a", b"ab", b"abc", bytes(range(256))]), k=rng.randint(0, 30))) for _ in range(rng.randint(1, 12))]
        data, _, left = suffix_array.joined(pieces)
        text, letters = suffix_array.letters_of(data, left)
        order, t = suffix_array.suffix_array(text, letters), text.tolist()
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        before, common = suffix_array.permuted_common_prefixes(data, left, order[1:])
        for x, y in zip(order[1:].tolist(), order[2:].tolist()):
            n = 0
            while n < min(left[x], left[y]) and data[x + n] == data[y + n]:
                n += 1
            assert before[y] == x and common[y] == n


def test_equal_windows_have_one_minimizer_and_every_window_one_piece():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 400))) for _ in range(40)] + [b"a" * 1000, bytes(300)]
    rows = suffix_dedup.fingerprints([(k, 0, 0, t) for k, t in enumerate(texts)], 100)
    met, marks = {k: [] for k in range(len(texts))}, {}
    for r in rows:
        for w in range(r["windows"]):
            at = int(r["at"]) + w
            met[int(r["doc"])].append(at)
            assert marks.setdefault(texts[int(r["doc"])][at : at + 100], (int(r["mark"]), int(r["place"]) - w)) == (int(r["mark"]), int(r["place"]) - w)
    assert all(sorted(met[k]) == list(range(max(0, len(t) - 99))) for k, t in enumerate(texts))
    # Parts of a hot piece: each window once, equal keys for equal windows.
    keys = {}
    for r in rows:
        body = texts[int(r["doc"])]
        parts = list(suffix_dedup.cut_piece(body, r, 100, True))
        assert sorted(a + w for _, a, n in parts for w in range(n)) == list(range(int(r["at"]), int(r["at"]) + int(r["windows"])))
        for key, a, n in parts:
            for w in range(n):
                assert keys.setdefault(body[a + w : a + w + 100], key) == key




def brute_removed(rows, length):
    """{(doc_id, text): spans}; rows of one id must differ from each other by no repeated window."""
    seen, out = set(), {}
    for i, t in sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        body, own, spans = (t or "").encode(), set(), []
        for at in range(len(body) - length + 1):
            window = body[at : at + length]
            if window in seen or window in own:
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = at + length
                else:
                    spans.append([at, at + length])
            own.add(window)
        seen |= own
        out[i, t or ""] = [tuple(s) for s in spans]
    return out


def check(spark, rows, length=100):
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3, "y", 4) for r in rows], DOCS).repartition(7)
    want = brute_removed(rows, length)
    got = suffix_dedup.without_repeats(frame, length).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode())
    for r in got:
        options = []
        for body in texts[r.doc_id]:
            spans = want[r.doc_id, body.decode()]
            kept = b"".join(body[x:y] for x, y in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(body)]))
            options.append((len(body), kept, spans))
        assert (r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans]) in options, r.doc_id
    return got


def rows_with_copies(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghéüß🙂", k=rng.randint(2, 8))) for _ in range(400)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    passages = [say(30) for _ in range(4)]
    line = say(9)
    rows = [(k * 3, rng.choice([say(60), say(20) + passages[k % 4] + say(20), say(15) + " " + line + " " + say(15), "ab" * rng.randint(20, 120), say(5)])) for k in range(n)]
    near = say(80).split()
    for k in range(30):
        near[rng.randrange(80)] = words[rng.randrange(400)]
        rows.append((1000 + k, " ".join(near)))
    return rows + [(2000 + k, passages[0]) for k in range(40)]


def test_removal_matches_brute_force(spark):
    rows = rows_with_copies(3)
    rows += [(-5, None), (-4, ""), (-3, "x" * 99), (-2, "x" * 100), (-1, "x" * 5000), (1, "x" * 101), (7, "y" * 101), (10**12, "long " * 30_000)]
    got = check(spark, rows)
    assert sum(bool(r.spans) for r in got) > 60


def test_hot_minimizers_slices_and_sections_change_nothing(spark, monkeypatch):
    rows = rows_with_copies(4) + [(5000, "z1234567" * 400)]
    for name, value in (("HOT_IN_SLICE", 3), ("HOT", 5), ("SLICE", 700), ("BUCKET_PIECES", 50), ("SHARD_BYTES", 2000), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(suffix_dedup, name, value)
    check(spark, rows)
    monkeypatch.setattr(suffix_dedup, "HOT_IN_SLICE", 10**6)
    check(spark, rows, 80)


def test_repeated_rows_and_missing_ids(spark):
    rng = random.Random(8)
    a, b, c = ("".join(rng.choices("abcdef ", k=300)) for _ in range(3))
    # Rows that are there twice are one document; a missing id comes last.
    check(spark, [(1, a), (1, a), (None, b), (None, b), (3, b + c), (4, c), (4, None), (None, None)])
    # Of two texts of one id, one or the other comes first.
    got = suffix_dedup.without_repeats(spark.createDataFrame([(1, a + b, *["x"] * 1, 1, 2, 3, "y", 4), (1, b, "x", 1, 2, 3, "y", 4)], DOCS)).collect()
    assert sorted(len(r.kept) for r in got) in ([0, 600], [300, 300])
    assert suffix_dedup.without_repeats(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="windows have"):
        suffix_dedup.without_repeats(spark.createDataFrame([], DOCS), 20)


def test_stretches_unite():
    a, b = suffix_dedup.merged(np.array([0, 5, 20]), np.array([10, 12, 30]))
    assert (a.tolist(), b.tolist()) == ([0, 20], [12, 30])
