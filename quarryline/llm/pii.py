"""Personal data by exact patterns and a linear-chain conditional random field.

The patterns give the base spans. The field labels whitespace-separated tokens; it adds spans where its labels
find data that no pattern matches, such as a phone number without a country code. Its features are the word shapes
of a token and its neighbours. It is trained on a small labelled table that this module writes out by rule.

The field goes by shape; what it finds must then hold as its kind: digits of a card pass Luhn's test, and a span over
several cards is cut into them.

Decoding is constrained: a token without a digit and without an at sign is outside of any span. So a text falls
into short independent runs of the other tokens, each with fixed ends, and Viterbi over all runs of a batch is
exact. Runs of equal position advance together in numpy.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.textnp import code_points, slices

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is outside; 1 + 2 k begins kind k, 2 + 2 k goes on with it.
N_LABELS = 1 + 2 * len(KINDS)
#: Characters before the at sign, what follows it, and the searches of the other kinds.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans, found from the at signs, so that a long run without one costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = _LOCAL.match(text[free:at][::-1]).end()
        domain = _DOMAIN.match(text, at) if before else None
        if domain:
            yield at - before, domain.end()
        # No character of a later match lies before the next at sign's own run.
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def dotted_quads(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of each chain of numbers with single dots between."""
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        start = chain.start()
        for k in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[k : k + 4])) + 3
            yield start, end
            start = end + 1


def matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a kind's pattern that do not overlap, in time proportional to the text."""
    if kind == "email":
        return emails(text)
    if kind == "ip":
        return dotted_quads(text)
    return (m.span() for m in (_CARD if kind == "card" else _PHONE).finditer(text))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found.split("."))
    digits = "".join(_DIGIT.findall(found))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points: leftmost matches of each pattern that hold, by kind and start."""
    out: list[tuple[int, int, int]] = []
    at = "@" in text
    digit = _DIGIT.search(text) is not None
    for k, kind in enumerate(KINDS):
        if (at if kind == "email" else digit and ("+" in text if kind == "phone" else True)):
            out += [(k, a, b) for a, b in matches(kind, text) if valid(kind, text[a:b])]
    return out


# --- word shapes ---------------------------------------------------------------------------------------------

#: Ranges of the shape's parts; a shape is their mixed-radix number.
PARTS = {"digits": 12, "letters": 3, "at": 2, "dots": 5, "dashes": 3, "plus": 2, "brackets": 2, "hex": 2, "other": 2}
N_SHAPES = int(np.prod(list(PARTS.values())))
#: Neighbours that count: two before, the token, two after; shape N_SHAPES stands for a plain word, one more for the edge.
OFFSETS = (-2, -1, 0, 1, 2)


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(mask)])
    return run[ends] - run[starts]


def token_shapes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shape of each token, and whether it may be part of a span."""
    is_digit = (points >= 48) & (points <= 57)
    low = points | 32
    is_alpha = (low >= 97) & (low <= 122)
    digits, letters = _sums(is_digit, starts, ends), _sums(is_alpha | (points > 127), starts, ends)
    hexa = _sums((low >= 97) & (low <= 102), starts, ends)
    counts = {c: _sums(points == ord(c), starts, ends) for c in "@.-+"}
    brackets = _sums((points == 40) | (points == 41), starts, ends)
    # A full stop that ends the token is no part of its shape.
    dots = counts["."] - (points[ends - 1] == 46)
    known = digits + letters + counts["@"] + counts["."] + counts["-"] + counts["+"] + brackets
    bucket = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6, 7, 7, 7, 8, 8, 8, 8, 9, 10, 10, 10, 11])
    parts = {
        "digits": bucket[np.minimum(digits, 20)],
        "letters": np.minimum(letters, 2),
        "at": np.minimum(counts["@"], 1),
        "dots": np.minimum(np.maximum(dots, 0), 4),
        "dashes": np.minimum(counts["-"], 2),
        "plus": np.minimum(counts["+"], 1),
        "brackets": np.minimum(brackets, 1),
        "hex": ((hexa == letters) & (letters > 0)).astype(int),
        "other": (known < ends - starts).astype(int),
    }
    shape = np.zeros(len(starts), np.int64)
    for name, size in PARTS.items():
        shape = shape * size + parts[name]
    return shape, (digits > 0) | (counts["@"] > 0)


@dataclass
class Field:
    """Emission weights by offset, shape and label (plain words and edges included), and transitions."""

    emit: np.ndarray
    step: np.ndarray


def runs_of(points: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and maximal runs of open tokens: starts, ends and text of the tokens, contexts, first token and length of the runs."""
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, len(OFFSETS)), np.int64), none, none
    shape, open_ = token_shapes(points, starts, ends)
    text = np.searchsorted(text_ends, starts, side="right")
    shape = np.where(open_, shape, N_SHAPES)
    index = np.flatnonzero(open_)
    context = np.full((len(index), len(OFFSETS)), N_SHAPES + 1)
    for j, d in enumerate(OFFSETS):
        to = index + d
        inside = (to >= 0) & (to < len(shape))
        to = np.clip(to, 0, len(shape) - 1)
        context[:, j] = np.where(inside & (text[to] == text[index]), shape[to], N_SHAPES + 1)
    new = np.ones(len(index), bool)
    new[1:] = (np.diff(index) > 1) | (np.diff(text[index]) != 0)
    first = np.flatnonzero(new)
    return starts[index], ends[index], text[index], context, first, np.diff(np.append(first, len(index)))


def emissions(field: Field, context: np.ndarray) -> np.ndarray:
    return sum(field.emit[j, context[:, j]] for j in range(len(OFFSETS)))


def viterbi(score: np.ndarray, step: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best labels of all runs. Ends are outside labels: a run is entered from and left to label 0."""
    labels = np.zeros(len(score), np.int64)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    longest = int(length[0]) if len(length) else 0
    back: list[np.ndarray] = []
    best = step[0] + score[first]
    held: list[np.ndarray] = [best]
    for t in range(1, longest):
        n = int(np.searchsorted(-length, -t, side="left"))  # runs longer than t
        cand = held[-1][:n, :, None] + step[None]
        back.append(cand.argmax(1))
        held.append(cand.max(1) + score[first[:n] + t])
    for t in range(longest - 1, -1, -1):
        n = len(held[t])
        longer = len(held[t + 1]) if t + 1 < longest else 0
        here = np.empty(n, np.int64)
        here[longer:] = (held[t][longer:] + step[:, 0]).argmax(1)
        if longer:
            here[:longer] = back[t][np.arange(longer), labels[first[:longer] + t + 1]]
        labels[first[:n] + t] = here
    return labels


# --- training ------------------------------------------------------------------------------------------------


def labelled_table(n: int = 360, seed: int = 3) -> list[list[tuple[str, str]]]:
    """Lines of (token, label), written by rule: data of each kind in several forms, and what only looks like it."""
    rng = np.random.default_rng(seed)
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9)))
    octets = lambda: ".".join(str(x) for x in rng.integers(1, 255, 4))

    def card(k: int) -> str:
        """``k`` digits that pass Luhn's test."""
        head = number(k - 1)
        return head + next(d for d in "0123456789" if luhn(head + d))

    def pieces(kind: int) -> list[str]:
        form = int(rng.integers(0, 4))
        if kind == 0:
            return [[f"{word()}{number(2)}@{word()}.com"], [f"<{word()}@{word()}.example.org>"], [f"{word()}.{word()}@{word()}"], [f"mailto:{word()}@{word()}.net,"]][form]
        if kind == 1:
            return [[octets()], [octets() + "."], [octets() + ":8080"], [f"({octets()})"]][form]
        if kind == 2:
            n = card(15 if form == 3 else 16)
            fours = [n[a : a + 4] for a in range(0, 16, 4)]
            return [fours, [n], ["-".join(fours)], [n[:4], n[4:10], n[10:]]][form]
        return [["+1", f"({number(3)})", f"{number(3)}-{number(4)}"], [f"({number(3)})", f"{number(3)}-{number(4)}"], [f"{number(3)}-{number(3)}-{number(4)}"], [f"+{number(2)}", number(3), number(7)]][form]

    def plain() -> list[str]:
        form = int(rng.integers(0, 9))
        return [[number(4)], [f"{rng.integers(1, 9)}.0."], [number(2) + "%"], [f"{number(2)}.{number(2)}"], [hashlib.sha1(number(6).encode()).hexdigest()], [f'"{hashlib.sha1(number(5).encode()).hexdigest()}"'], [number(1) + ","], [f"{word()}{number(2)}"], [f"20{number(2)}-{number(2)}-{number(2)}"]][form]

    out = []
    for i in range(n):
        line = [(word(), "O") for _ in range(int(rng.integers(1, 4)))]
        kind = i % (len(KINDS) + 3)
        if kind < len(KINDS):
            line += [(p, f"{'I' if j else 'B'}-{KINDS[kind]}") for j, p in enumerate(pieces(kind))]
        else:
            line += [(p, "O") for p in plain()]
        line += [(word(), "O") for _ in range(int(rng.integers(0, 3)))]
        out.append(line)
    return out


def _label(name: str) -> int:
    return 0 if name == "O" else 1 + 2 * KINDS.index(name[2:]) + (name[0] == "I")


def train(table: list[list[tuple[str, str]]], epochs: int = 120, rate: float = 0.2, l2: float = 1e-3) -> Field:
    """Maximum conditional likelihood with a Gaussian prior, by AdaGrad on the whole table.

    Transitions into the inside of a kind from anything but that kind are ruled out.
    """
    texts = [" ".join(t for t, _ in line) for line in table]
    points, text_ends = code_points(texts)
    starts, _, _, context, first, length = runs_of(points, text_ends)
    gold_at: dict[int, int] = {}
    at = 0
    for line, text in zip(table, texts, strict=True):
        for token, name in line:
            gold_at[at] = _label(name)
            at += len(token) + 1
    gold = np.array([gold_at[int(s)] for s in starts])
    barred = np.zeros((N_LABELS, N_LABELS), bool)
    for k in range(len(KINDS)):
        barred[:, 2 + 2 * k] = True
        barred[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
    emit, step = np.zeros((len(OFFSETS), N_SHAPES + 2, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    sums = [np.full_like(emit, 1e-6), np.full_like(step, 1e-6)]
    held = [context[:, j] for j in range(len(OFFSETS))]
    for _ in range(epochs):
        score = emissions(Field(emit, step), context)
        move = np.where(barred, -1e9, step)
        g_emit, g_step = -l2 * emit, -l2 * step
        for a, n in zip(first, length, strict=True):
            fwd, bwd = np.zeros((n, N_LABELS)), np.zeros((n, N_LABELS))
            fwd[0] = move[0] + score[a]
            for t in range(1, n):
                fwd[t] = np.logaddexp.reduce(fwd[t - 1][:, None] + move, 0) + score[a + t]
            bwd[n - 1] = move[:, 0]
            for t in range(n - 2, -1, -1):
                bwd[t] = np.logaddexp.reduce(move + (bwd[t + 1] + score[a + t + 1])[None], 1)
            z = np.logaddexp.reduce(fwd[n - 1] + bwd[n - 1])
            delta = -np.exp(fwd + bwd - z)
            delta[np.arange(n), gold[a : a + n]] += 1
            for j in range(len(OFFSETS)):
                np.add.at(g_emit[j], held[j][a : a + n], delta)
            path = np.concatenate([[0], gold[a : a + n], [0]])
            np.add.at(g_step, (path[:-1], path[1:]), 1)
            g_step[0] -= np.exp(move[0] + score[a] + bwd[0] - z)
            g_step[:, 0] -= np.exp(fwd[n - 1] + move[:, 0] - z)
            for t in range(1, n):
                g_step -= np.exp(fwd[t - 1][:, None] + move + (score[a + t] + bwd[t])[None] - z)
        for w, g, s in zip((emit, step), (g_emit, g_step), sums, strict=True):
            s += g * g
            w += rate * g / np.sqrt(s)
    return Field(emit, np.where(barred, -1e9, step))


def field_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of each text as the field labels it; leading and trailing marks are no part of a span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    points, text_ends = code_points(texts)
    starts, ends, text, context, first, length = runs_of(points, text_ends)
    if not len(starts):
        return out
    labels = viterbi(emissions(field, context), field.step, first, length)
    begin = np.flatnonzero(labels % 2 == 1)
    origin = np.concatenate([[0], text_ends[:-1]])
    for b in begin:
        e = b
        while e + 1 < len(labels) and labels[e + 1] == labels[b] + 1 and text[e + 1] == text[b]:
            e += 1
        i = int(text[b])
        s, t = int(starts[b] - origin[i]), int(ends[e] - origin[i])
        found = texts[i][s:t]
        s, t = s + len(found) - len(found.lstrip("<\"'[{,;:")), t - (len(found) - len(found.rstrip(">\"']}.,;:!?")))
        if t > s:
            out[i] += holding((int(labels[b]) - 1) // 2, texts[i], s, t)
    return out


def holding(kind: int, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """What holds of a span of the field: itself, the cards that its tokens make in order, or nothing."""
    name = KINDS[kind]
    if name == "email":
        return [(kind, start, end)]
    if name != "card":
        return [(kind, start, end)] if valid(name, text[start:end].strip("()")) else []
    out: list[tuple[int, int, int]] = []
    tokens = [(m.start() + start, m.end() + start) for m in re.finditer(r"\S+", text[start:end])]
    k = 0
    while k < len(tokens):
        digits = ""
        for j in range(k, len(tokens)):
            digits += "".join(_DIGIT.findall(text[slice(*tokens[j])]))
            if len(digits) > 19:
                break
            if len(digits) >= 13 and luhn(digits):
                out.append((kind, tokens[k][0], tokens[j][1]))
                k = j
                break
        k += 1
    return out


def merged(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans and those of ``more`` that touch none of them. Spans of one kind do not overlap."""
    out = list(base)
    for kind in range(len(KINDS)):
        taken = [(s, e) for k, s, e in base if k == kind]
        starts, ends = [s for s, _ in taken], [e for _, e in taken]
        # The first span that ends behind x's start must begin at or behind x's end.
        more = [x for x in more if (i := bisect_left(ends, x[1] + 1)) == len(ends) or starts[i] >= x[2]]
    return sorted(out + more)


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are of the base spans; ``spans`` lists all, by kind and then start. Null counts
    as the empty text: no spans, the digest of nothing. Repeated rows get equal results; an empty table gives
    no rows; other columns are ignored. Ids must be integers.
    """
    field = field or train(labelled_table())
    # Arrays only: executors load the broadcast without a copy of this package.
    held = docs.sparkSession.sparkContext.broadcast((field.emit, field.step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = Field(*held.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans, added = [], [], []
            for a, b in slices(texts, 1 << 19):
                for text, more in zip(texts[a:b], field_spans(texts[a:b], learnt), strict=True):
                    base = base_spans(text)
                    every = merged(base, more)
                    for k, column in enumerate(counts):
                        column.append(sum(x[0] == k for x in base))
                    digests.append(hashlib.sha256(written_out(base).encode()).hexdigest())
                    spans.append(written_out(every))
                    added.append(len(every) - len(base))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: str, mark: str = "*") -> str:
    """``text`` with every code point of its ``spans`` replaced."""
    out = list(text)
    for piece in filter(None, spans.split(",")):
        _, s, e = piece.split(":")
        out[int(s) : int(e)] = mark * (int(e) - int(s))
    return "".join(out)
