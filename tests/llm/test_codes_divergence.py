import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quarryline.llm import divergence, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, code string, part int, n int, ints string"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Rows (vec_id, vector, label) of one length, by the definition."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    if not kept:
        return []
    d = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, p: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        moved = [[list(c) for c in b] for b in books]
        for p in range(parts):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[best(cut(v, p), p)[1]].append(cut(v, p))
            for e, own in of.items():
                moved[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books = moved
    signed = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [best(cut(v, p), p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found), label))
    by = Counter()
    for _, _, error, label in out:
        by[label] += error
    return [(i, c, e, by[label], signed) for i, c, e, label in out]


def test_codes_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([k, k, k // 3]), [rng.choice([-0.5, -0.001, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(32)], rng.choice([None, 1, 2])) for k in range(150)]
    rows += [(999, rows[0][1], 3)] * 70  # a hot vector
    rows += [(None, rows[1][1], None), (-7, [1e3] * 32, 4), (7, None, 1), (8, [None] + [0.0] * 31, 1), (9, [math.nan] * 32, 1), (10, [math.inf] + [0.0] * 31, 1), (11, [], 1), (12, [0.1] * 31, 1)]
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], VECTORS)
    got = vector_codes.vector_codes(frame)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_codes(rows), key=key)


def test_codes_of_other_lengths_huge_values_and_no_rows(spark):
    rng = random.Random(6)
    short, long = ([(k, [rng.uniform(-1, 1) for _ in range(n)], 1) for k in range(9)] for n in (16, 48))
    frame = lambda rows: spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], VECTORS)
    got = sorted((r.vec_id, r.code, r.error, r.codebooks_sha256) for r in vector_codes.vector_codes(frame(short + long)).collect())
    assert got == sorted((i, c, e, s) for rows in (short, long) for i, c, e, _, s in brute_codes(rows))
    huge = vector_codes.vector_codes(frame([(1, [1e300] * 16, None), (2, [-1e300] * 16, None)]), entries=1).collect()
    assert len(huge) == 2 and all(0 < r.error <= r.label_error < 2**63 for r in huge)
    assert vector_codes.vector_codes(frame([])).count() == 0
    with pytest.raises(ValueError, match="two hexadecimal digits"):
        vector_codes.vector_codes(frame([]), entries=257)


DOCS = "doc_id long, text string, lang string, source string, term string, value int, n int, size int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, least=3, top=200):
    rows = [tuple("" if x is None else x for x in r) for r in rows]
    split = [(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), a, s) for t, a, s in rows]
    out = []
    for lang in {a for _, a, _ in split}:
        docs = Counter(w for ws, a, _ in split if a == lang for w in set(ws))
        kept = [w for w, n in docs.items() if n >= least]
        groups = {s: Counter() for _, a, s in split if a == lang}
        for ws, a, s in split:
            if a == lang:
                groups[s].update(w for w in ws if docs[w] >= least)
        whole = sum(groups.values(), Counter())
        p_of = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // q
        shares, base = {s: p_of(c) for s, c in groups.items()}, p_of(whole)
        for s, p in shares.items():
            pairs = [(o, sum(f(p[w], q[w]) for w in kept)) for o, q in shares.items() if o != s]
            terms = [(w, f(p[w], base[w])) for w in kept if groups[s][w] and p[w] > base[w]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[1], x[0].encode()))[:top])):
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)]
    return sorted(out)


def audit_rows(spark, rows, **sizes):
    frame = spark.createDataFrame([(k, *r, "x", 1, 2, 3) for k, r in enumerate(rows)], DOCS)
    return sorted(map(tuple, divergence.audit(frame, **sizes).collect()))


def test_audit_matches_brute_force(spark):
    rng = random.Random(7)
    words = ["Été", "été", "straße", "ABC", "abc", "İ", "a1b", "x_y", "𝔘", " ", "é", "don't"] + [f"w{chr(97 + k)}" for k in range(20)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 30)))
    rows = [(text(), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", "", None])) for _ in range(150)]
    rows += [("solo words only here", "xx", "one"), (None, "en", "empty"), ("", "en", "blank"), ("12 34", "zz", "p"), ("!", "zz", "q"), ("abc " * 3000, "en", "a")]
    rows += [("hot source of equal rows", "en", "hot")] * 60
    want = brute_audit(rows)
    assert audit_rows(spark, rows) == want
    # Small chunks, blocks and spans: many tiles, the same sums.
    assert audit_rows(spark, rows, chunk=3, block=2, span=2) == want
    assert audit_rows(spark, []) == []


def test_audit_keeps_the_top_terms_and_passes_full_tables_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FOLD", 50)
    rows = [(" ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(s, s + 60)), "en", f"s{s % 3}") for s in range(90)]
    assert audit_rows(spark, rows, top=5) == brute_audit(rows, top=5)


def test_shares_stay_exact_for_counts_beyond_a_billion(spark):
    import numpy as np

    n, total, size = 7 * 10**13, 8 * 10**14, 10**7
    want = 1 + 10**9 * (n + 1) // (total + size)
    assert divergence.shares(np.array([[n]]), np.array([total]), size)[0, 0] == want
    assert spark.range(1).selectExpr(f"{n}L AS n", f"{total}L AS t", f"{size}L AS v").select(divergence.share("n", "t", "v")).first()[0] == want
