"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed runs of 1 to 3 characters of the lower-case text, in which every run of other
characters than letters is one blank. Weights are learnt by follow-the-regularised-leader with an L1 and
an L2 penalty on a bounded sample per language; the document frequencies behind the IDF cover every row
that may be learnt from. A temperature fitted on rows set aside from the sample calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarryline.llm.textnp import BASE, code_points, holds, slices

UNDETERMINED = "und"


@dataclass
class Model:
    """Everything that a prediction needs: 2 ** bits by languages in size, whatever the data."""

    languages: list[str]
    bits: int
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def gram_counts(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (texts x 2 ** bits) and whether each text has a letter."""
    dims = 1 << bits
    points, text_ends = code_points([t.lower() for t in texts])
    letter = holds(points, str.isalpha)
    symbols = np.where(letter, points, 32).astype(np.uint64)
    after_letter = np.concatenate([[False], letter[:-1]])
    row = np.repeat(np.arange(len(texts)), np.diff(text_ends, prepend=0))
    keep = letter | after_letter
    symbols, row = symbols[keep], row[keep]
    out = np.zeros((len(texts), dims), np.float32)
    code = np.zeros(len(symbols), np.uint64)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    for n in (1, 2, 3):
        tail = symbols[n - 1 :]
        code = (code[: len(tail)] << np.uint64(21)) | tail if n > 1 else symbols.copy()
        slot = ((code * np.uint64(BASE + 2 * n)) >> np.uint64(64 - bits)).astype(np.int32)
        for i in range(len(texts)):
            a, b = cut[i], cut[i + 1] - n + 1
            if b > a:
                out[i] += np.bincount(slot[a:b], minlength=dims)
    return out, np.add.reduceat(letter, np.concatenate([[0], text_ends[:-1]])) > 0 if len(texts) else np.zeros(0, bool)


def features(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, dims: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate follow-the-regularised-leader over sparse rows (indices, values); the bias is the last coordinate."""
    z, n = np.zeros((dims + 1, n_classes)), np.zeros((dims + 1, n_classes))

    def leader(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            at, value = np.append(x[i][0], dims), np.append(x[i][1], 1.0)
            w = leader(at)
            p = softmax(value @ w)
            p[y[i]] -= 1
            g = np.outer(value, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = leader(np.arange(dims + 1))
    return w[:dims], w[dims]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm.

    A share 1 / (rows + 2) of each row counts as spread over all classes (the rule of succession), so that
    rows without an error do not drive the temperature to zero.
    """
    if not len(y):
        return 1.0
    doubt = 1 / (len(y) + 2)

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))
        return float(-((1 - doubt) * p[np.arange(len(y)), y] + doubt * p.mean(1)).mean())

    a, b, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from: with text and lang, and not held out."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def document_frequencies(rows: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """Over all of ``rows``: in how many each hashed n-gram occurs, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, 1 << 19):
                for i in range(a, b, 128):
                    total += (gram_counts(texts[i : min(i + 128, b)], bits)[0] > 0).sum(0)
                n += b - a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << bits, dtype=np.int32)), pa.array(np.concatenate([[n], total]))], ["slot", "n"])

    table = rows.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << bits) + 1, np.int64)
    out[table["slot"].to_numpy() + 1] = table["n"].to_numpy()
    return out[1:], int(out[0])


def training_sample(rows: DataFrame, per_language: int, bits: int) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, hash, slots, counts) of the ``per_language`` texts of each language with the smallest hashes of id and text.

    Rows with one language, id and text count once, so that no more than the parameter allows reach the driver.
    """
    from pyspark.sql import Window

    named = rows.select("doc_id", "lang", F.xxhash64("text").alias("t")).withColumn("h", F.xxhash64("doc_id", "t"))
    # First the smallest of each of 64 parts, so that a common language does not meet in one task.
    order = [F.col("h"), F.col("doc_id"), F.col("t")]
    parts = named.dropDuplicates(["lang", "doc_id", "t"]).withColumn("part", F.pmod("h", F.lit(64)))
    parts = parts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= per_language).drop("r")
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= per_language)
    # per_language ids of each language: bounded by the parameter.
    chosen = F.broadcast(ranked.select("lang", "h").distinct())

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, h, texts = (batch.column(i).to_pylist() for i in range(3))
            for i in range(0, len(texts), 64):
                counts, _ = gram_counts(texts[i : i + 64], bits)
                slots = [np.flatnonzero(c).astype(np.int32) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang[i : i + 64], pa.string()), pa.array(h[i : i + 64], pa.int64()), pa.array(slots, pa.list_(pa.int32())), pa.array([c[s] for c, s in zip(counts, slots, strict=True)], pa.list_(pa.float32()))],
                    ["lang", "h", "slots", "counts"],
                )

    mine = rows.withColumn("h", F.xxhash64("doc_id", F.xxhash64("text"))).join(chosen, ["lang", "h"])
    got = mine.select("lang", "h", "text").dropDuplicates(["lang", "h"]).mapInArrow(sparse, "lang string, h long, slots array<int>, counts array<float>").toArrow()
    found = sorted(zip(*(got.column(c).to_pylist() for c in ("lang", "h", "slots", "counts")), strict=True), key=lambda r: (r[1], r[0]))
    return [(lang, h, np.array(s, np.int64), np.array(c, np.float64)) for lang, h, s, c in found]


def fit(docs: DataFrame, per_language: int = 400, bits: int = 13) -> Model:
    """Fit on text and lang of the learnable rows only. Without any, the model knows no language."""
    rows = learnable(docs)
    df, n = document_frequencies(rows, bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = training_sample(rows, per_language, bits)
    languages = sorted({s[0] for s in sample})
    x = []
    for _, _, slots, counts in sample:
        v = np.log1p(counts) * idf[slots]
        x.append((slots, v / max(np.sqrt((v * v).sum()), 1e-12)))
    y = np.array([languages.index(s[0]) for s in sample], np.int64)
    aside = np.array([i % 5 == 4 for i in range(len(y))], bool)
    k = len(languages)
    if not k:
        return Model([], bits, idf, np.zeros((1 << bits, 0)), np.zeros(0), 1.0)
    if len(set(y[~aside])) < k:
        aside[:] = False
    train = np.flatnonzero(~aside)
    weights, bias = train_ftrl([x[i] for i in train], y[train], k, 1 << bits)
    held = np.flatnonzero(aside)
    logits = np.array([v @ weights[s] + bias for s, v in (x[i] for i in held)]).reshape(len(held), k)
    return Model(languages, bits, idf.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32), fit_temperature(logits, y[held]))


#: Rows of an Arrow batch that are labelled, and passed on, together.
ROWS = 1024


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score.

    ``und`` with score 0 for a null text, one without a letter, or a model without languages. Whole texts
    are read; equal texts get equal predictions. Columns named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    # Plain values only: executors load the broadcast without a copy of this package.
    held = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for whole in batches:
            # Some rows at a time, so that neither their strings nor the result of a whole batch are held at once.
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                names: list[str] = []
                scores: list[float] = []
                for a, b in slices(texts, 1 << 19):
                    for i in range(a, b, 128):
                        counts, lettered = gram_counts(texts[i : min(i + 128, b)], m.bits)
                        lettered = lettered & bool(m.languages)
                        p = softmax((features(counts, m.idf) @ m.weights + m.bias) / m.temperature) if m.languages else np.zeros((len(counts), 1))
                        best = p.argmax(1)
                        names += [m.languages[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)]
                        scores += np.where(lettered, p[np.arange(len(p)), best], 0.0).astype(float).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(label, schema)


def identify(docs: DataFrame, per_language: int = 400, bits: int = 13) -> DataFrame:
    """``predict`` with a model learnt from ``docs`` itself, plus held_out (false where doc_id is null)."""
    out = predict(docs.drop("held_out"), fit(docs, per_language, bits))
    return out.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
