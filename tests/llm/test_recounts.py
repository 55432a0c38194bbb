"""Language identification and the secret scan, recomputed row by row without Spark."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from quarryline.llm import language, secrets
from quarryline.llm.textnp import BASE

SF = "/root/testdata/sf0.001"
BITS, EACH = 10, 12


def _grams(text: str) -> Counter:
    # A text ends with a blank, so that its last word has an end as all others have.
    letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower() + " ")).lstrip(" ")
    out: Counter = Counter()
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            code = 0
            for c in letters[i : i + n]:
                code = code << 21 | ord(c)
            out[(code * (BASE + 2 * n) % 2**64) >> (64 - BITS)] += 1
    return out


def _hash(doc_id: int, text: str) -> int:
    def signed(x: int) -> int:
        return x - 2**64 if x >= 2**63 else x

    own = xxhash.xxh64_intdigest(text.encode(), 42)
    seed = xxhash.xxh64_intdigest((doc_id % 2**64).to_bytes(8, "little"), 42)
    return signed(xxhash.xxh64_intdigest(own.to_bytes(8, "little"), seed))


def _vector(text: str, idf: list[float]) -> dict[int, float]:
    v = {s: math.log1p(c) * idf[s] for s, c in _grams(text).items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {s: x / size for s, x in v.items()} if size else {}


def _shares(scores: list[float]) -> list[float]:
    e = [math.exp(s - max(scores)) for s in scores]
    return [x / sum(e) for x in e]


def _recount(rows: list) -> dict[int, tuple[str, float]]:
    may = [r for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    seen = Counter(s for r in may for s in _grams(r.text))
    idf = [math.log((1 + len(may)) / (1 + seen[s])) + 1 for s in range(1 << BITS)]
    by_lang = defaultdict(dict)
    for r in may:
        by_lang[r.lang][_hash(r.doc_id, r.text)] = r.text
    sample = sorted((h, lang, text) for lang, found in by_lang.items() for h, text in sorted(found.items())[:EACH])
    names = sorted(by_lang)
    k = len(names)
    x, y = [_vector(t, idf) | {1 << BITS: 1.0} for _, _, t in sample], [names.index(lang) for _, lang, _ in sample]
    train = [i for i in range(len(y)) if i % 5 != 4]
    z, n = defaultdict(float), defaultdict(float)

    def weight(s: int, c: int) -> float:
        shrunk = math.copysign(max(abs(z[s, c]) - 1e-3, 0), z[s, c])
        return -shrunk / (1 + math.sqrt(n[s, c]) + 1e-3)

    order = np.random.default_rng(7)
    for _ in range(4):
        for i in order.permutation(len(train)):
            row, want = x[train[i]], y[train[i]]
            w = {(s, c): weight(s, c) for s in row for c in range(k)}
            p = _shares([sum(v * w[s, c] for s, v in row.items()) for c in range(k)])
            for s, v in row.items():
                for c in range(k):
                    g = v * (p[c] - (c == want))
                    z[s, c] += g - (math.sqrt(n[s, c] + g * g) - math.sqrt(n[s, c])) * w[s, c]
                    n[s, c] += g * g

    def logits(row: dict[int, float]) -> list[float]:
        return [sum(v * weight(s, c) for s, v in row.items()) for c in range(k)]

    held = [(logits(x[i]), y[i]) for i in range(len(y)) if i % 5 == 4]
    doubt = 1 / (len(held) + 2)

    def loss(t: float) -> float:
        out = 0.0
        for scores, want in held:
            p = [math.log(v) for v in _shares([s / math.exp(t) for s in scores])]
            out -= (1 - doubt) * p[want] + doubt * sum(p) / k
        return out

    coarse = min((-4 + 8 * i / 800 for i in range(801)), key=loss)
    heat = math.exp(min((coarse + i / 20000 for i in range(-400, 401)), key=loss))
    out = {}
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            out[r.doc_id] = ("und", 0.0)
            continue
        p = _shares([s / heat for s in logits(_vector(r.text, idf) | {1 << BITS: 1.0})])
        out[r.doc_id] = (names[p.index(max(p))], max(p))
    return out


def test_languages_match_a_plain_recount(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 4000)
    more = spark.createDataFrame([(90001, None, "en"), (90002, "12 -- 3", "de"), (90003, "", None), (90004, "Àé ÉÈ", None)], "doc_id long, text string, lang string")
    table = table.select("doc_id", "text", "lang").unionByName(more)
    rows = table.collect()
    want = _recount(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(table, EACH, BITS).collect()}
    assert len(got) == len(rows) > 100 and len({v[0] for v in want.values()}) >= 4
    close = [d for d, (_, score) in want.items() if score < 0.5 + 1e-3]  # two languages may tie up to rounding
    assert {d: v[0] for d, v in got.items() if d not in close} == {d: v[0] for d, v in want.items() if d not in close}
    assert all(got[d][1] == pytest.approx(v[1], abs=1e-4) for d, v in want.items())


# --- secrets -------------------------------------------------------------------------------------------------


def _found(text: str) -> dict[tuple[int, str], tuple[str, str]]:
    """(start, candidate) -> (before, after), with the neighbourhood of a run before that of a value."""
    out: dict = {}
    for pattern in (secrets.CANDIDATE, secrets.VALUE):
        spans = [m.span() for m in regex.finditer(pattern, text, regex.ASCII)]
        for i, (a, b) in enumerate(spans):
            low, high = spans[i - 1][1] if i else 0, spans[i + 1][0] if i + 1 < len(spans) else len(text)
            out.setdefault((a, text[a:b]), (text[max(low, a - 40) : a], text[b : min(high, b + 40)]))
    return out


def _kind(c: str) -> int:
    return ord(c.lower()) - 97 if "a" <= c.lower() <= "z" else 26 if "0" <= c <= "9" else 27


def _features(c: str, before: str, after: str, path: str, pairs: list[list[float]], words: list[str]) -> list[float]:
    n = len(c)
    share = lambda p: len(re.findall(p, c)) / n
    bare = re.sub("|".join(sorted(words, key=lambda w: -len(w))), "", c.lower()) if words else c
    return [
        min(n, 200),
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        share("[+/_=-]"),
        share("[^A-Za-z0-9+/_=-]"),
        share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        len(set(c)) / min(n, 64),
        sum(pairs[_kind(a)][_kind(b)] for a, b in zip(c, c[1:])) / max(n - 1, 1),
        (n - len(bare)) / n,
        float(bool(re.search(secrets.NAMES, before))),
        float(bool(re.search(secrets.ASSIGNED, before, re.ASCII))),
        float(bool(re.search("[\"'`]$", before) and re.search("^[\"'`]", after))),
        float(bool(re.search(secrets.SAMPLES, path))),
        float(path.count("/")),
        float(len(re.findall("[A-Za-z]{2,}", before))),
    ]


def _chance(trees: dict[int, dict], row: list[float]) -> float:
    total = 0.0
    for nodes in trees.values():
        at = nodes[0]
        while at.leftChild >= 0:
            at = nodes[at.leftChild if row[at.split.featureIndex] <= at.split.leftCategoriesOrThreshold[0] else at.rightChild]
        total += at.impurityStats[1] / sum(at.impurityStats)
    return total / len(trees)


def test_secrets_match_a_plain_recount(spark, monkeypatch, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.concat_ws("/", F.lit("src"), F.when(F.col("doc_id") % 3 == 0, "tests"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    odd = [(90001, f'my Token = "{key}" and {key}', "a/b"), (90002, None, "c"), (90003, "", None), (90004, 'password = "Tr0ub4dor&3" here, pwd=x9$Kq2!a, next', None), (90005, f"secret: {key}.{key[:9]}, then\n\ttoken:\n'{key[:20]}'", "test/x"), (90006, "the-and/or_with-Words+TOGETHER=now", "d/e/f")]
    table = table.unionByName(spark.createDataFrame(odd, "doc_id long, text string, path string"))
    forests, kept = [], []
    plain, wide = secrets.train_forest, secrets.features
    monkeypatch.setattr(secrets, "train_forest", lambda rows: forests.append(plain(rows)) or forests[-1])
    monkeypatch.setattr(secrets, "features", lambda *given: kept.append(wide(*given)) or kept[-1])
    scored = {(r.doc_id, r.start, r.length): r for r in secrets.scan(table).collect()}
    made = {(r.doc_id, r.start, r.length): r for r in kept[-1].collect()}

    rows = table.collect()
    counts: Counter = Counter()
    for r in rows:
        bare = re.sub(rf"(?<![A-Za-z0-9+/_=-]){secrets.CANDIDATE}", " ", r.text or "")
        counts.update(w for w in re.split("[^a-z]+", bare.lower()) if 2 <= len(w) <= 15)
    pairs = [[1.0] * 28 for _ in range(28)]
    for w, n in counts.items():
        for a, b in zip(w, w[1:]):
            pairs[_kind(a)][_kind(b)] += n
    pairs = [[math.log(v / sum(line)) for v in line] for line in pairs]
    words = [w for w, n in counts.items() if len(w) >= 4 and n >= 5]
    want = {(r.doc_id, a, c): _features(c, before, after, r.path or "", pairs, words) for r in rows for (a, c), (before, after) in _found(r.text or "").items()}

    forests[0].write().save(f"file://{tmp_path}/forest")
    nodes = spark.read.parquet(f"file://{tmp_path}/forest/data").collect()
    trees: dict = defaultdict(dict)
    for r in nodes:
        trees[r.treeID][r.nodeData.id] = r.nodeData
    assert len(trees) == 20
    assert {(r.doc_id, r.start, r.candidate) for r in made.values()} == set(want) and len(want) > 20
    by_span = {(d, a, len(c)): (c, v) for (d, a, c), v in want.items()}
    assert set(scored) == set(by_span)
    differing = 0
    for span, (c, row) in by_span.items():
        own = [made[span][name] for name in secrets.FEATURES]
        assert own == pytest.approx(row, abs=1e-9), (span, c)
        # The forest's own rows, since a last digit may part at a threshold.
        assert scored[span].score == pytest.approx(_chance(trees, own), abs=2e-6)
        differing += abs(scored[span].score - _chance(trees, row)) > 2e-6
        assert scored[span].is_secret == (scored[span].score >= 0.5)
    assert differing <= len(by_span) // 50
