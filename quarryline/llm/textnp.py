"""Numpy views of text batches: code points, words and hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def slices(texts: list[str], max_chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``max_chars`` code points, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > max_chars:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points with a line feed after each text, and where each text ends."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    joined = "\n".join(texts) + "\n" if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths)


def holds(points: np.ndarray, test: Callable[[str], bool]) -> np.ndarray:
    """Which code points pass ``test``; it is called once for each different one."""
    present = np.flatnonzero(np.bincount(points))
    table = np.zeros(int(present[-1]) + 1 if len(present) else 1, bool)
    for p in present:
        table[p] = test(chr(p))
    return table[points]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_char(c: str) -> bool:
    return c.isalnum() or c == "_"


def word_spans(points: np.ndarray, test: Callable[[str], bool] = word_char) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of characters that pass ``test``."""
    inside = np.concatenate([[False], holds(points, test), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: differences of one running polynomial, moved back to power 0."""
    up, down = powers(BASE, len(points)), powers(pow(BASE, -1, 1 << 64), len(points))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    return mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) if len(starts) else np.zeros(0, np.uint64)


def shingle_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` lower-case words and how many each text has.

    A text of 1 to n - 1 words has one shingle, of all its words; one without words has none.
    """
    points, text_ends = code_points([t.lower() for t in texts])
    starts, ends = word_spans(points)
    hashes = word_hashes(points, starts, ends)
    last = np.searchsorted(starts, text_ends)
    words = np.diff(last, prepend=0)
    first = last - words
    counts = np.where(words == 0, 0, np.maximum(words - n + 1, 1))
    offset = np.cumsum(counts) - counts
    at = np.repeat(first - offset, counts) + np.arange(int(counts.sum()))
    stop = np.repeat(last, counts)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    for k in range(n):
        # Beyond the end of a short text, zeros.
        out = mixed(out * np.uint64(BASE) + np.where(at + k < stop, padded[np.minimum(at + k, len(padded) - 1)], np.uint64(0)) + np.uint64(k))
    return out, counts
