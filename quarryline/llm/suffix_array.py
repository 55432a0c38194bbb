"""Suffix arrays by induced sorting, and permuted longest common prefixes, of bounded strings in numpy."""

from __future__ import annotations

import numpy as np

#: Up to so many letters, buckets are filled a wave at a time in numpy; beyond, one suffix after the other.
WAVE_LETTERS = 1024


def suffix_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S); the last, a unique least letter, is S too."""
    n = len(text)
    rise = np.concatenate([np.sign(text[1:].astype(np.int64) - text[:-1]), [1]])
    # Equal letters take the type of what follows their run.
    at = np.where(rise != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return rise[following] > 0


def leftmost(small: np.ndarray) -> np.ndarray:
    """Positions of leftmost S suffixes, in text order."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _dealt(preds: np.ndarray, letters: np.ndarray, pending: list[list[np.ndarray]]) -> None:
    """Append ``preds`` to the buckets of their letters, in order."""
    order = np.argsort(letters, kind="stable")
    preds, letters = preds[order], letters[order]
    cut = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    for part, c in zip(np.split(preds, cut), letters[np.concatenate([[0], cut])].tolist(), strict=True):
        pending[c].append(part)


def induce_by_waves(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes from the ``seeds`` (leftmost S, sorted), bucket by bucket.

    What a bucket induces in itself is its next wave; there are as many waves as its letter repeats in a row.
    """
    none = np.zeros(0, np.int64)
    seed_letters = text[seeds]
    bound = np.searchsorted(seed_letters, np.arange(letters + 1))
    large: list[np.ndarray] = []
    pending: list[list[np.ndarray]] = [[] for _ in range(letters)]

    def spread(wave: np.ndarray, c: int, want_small: bool) -> np.ndarray:
        """Deal out what ``wave`` induces; what falls into bucket ``c`` itself is returned."""
        preds = wave[wave > 0] - 1
        preds = preds[small[preds] == want_small]
        if not len(preds):
            return none
        found = text[preds]
        own = found == c
        if own.all():
            return preds
        _dealt(preds[~own], found[~own], pending)
        return preds[own]

    for c in range(letters):
        parts, wave = [], np.concatenate(pending[c]) if pending[c] else none
        while len(wave):
            parts.append(wave)
            wave = spread(wave, c, False)
        large.append(np.concatenate(parts) if parts else none)
        if bound[c] < bound[c + 1]:
            spread(seeds[bound[c] : bound[c + 1]], c, False)
    pending = [[] for _ in range(letters)]
    pending[int(text[-1])].append(np.array([len(text) - 1]))
    out: list[np.ndarray] = []
    for c in range(letters - 1, -1, -1):
        parts, wave = [], np.concatenate(pending[c]) if pending[c] else none
        while len(wave):
            parts.append(wave)
            wave = spread(wave, c, True)
        if parts:
            out.append(np.concatenate(parts))
        if len(large[c]):
            out.append(large[c][::-1])
            spread(large[c][::-1], c, True)
    return np.concatenate(out)[::-1]


def induce_by_scan(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """The same one suffix after the other, for many letters."""
    sizes = np.bincount(text, minlength=letters)
    ends = np.cumsum(sizes)
    found, is_small, letter = [-1] * len(text), small.tolist(), text.tolist()
    free = ends.tolist()
    for j in seeds[::-1].tolist():
        free[letter[j]] -= 1
        found[free[letter[j]]] = j
    free = (ends - sizes).tolist()
    for i in range(len(found)):
        j = found[i] - 1
        if j >= 0 and not is_small[j]:
            c = letter[j]
            found[free[c]] = j
            free[c] += 1
    free = ends.tolist()
    for i in range(len(found) - 1, -1, -1):
        j = found[i] - 1
        if j >= 0 and is_small[j]:
            c = letter[j]
            free[c] -= 1
            found[free[c]] = j
    return np.array(found, np.int64)


def named(text: np.ndarray, starts: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """A name of each leftmost-S substring in text order, from their sorted order, and how many names there are."""
    rank = np.full(len(text), -1, np.int64)
    rank[starts] = np.arange(len(starts))
    length = np.diff(np.append(starts, starts[-1])) + 1
    size = length[rank[ordered]]
    a, b = ordered[:-1], ordered[1:]
    equal = size[1:] == size[:-1]
    active = np.flatnonzero(equal)
    step = 0
    while len(active):
        same = text[a[active] + step] == text[b[active] + step]
        equal[active[~same]] = False
        step += 1
        active = active[same & (size[active] > step)]
    names = np.concatenate([[0], np.cumsum(~equal)])
    out = np.zeros(len(starts), np.int64)
    out[rank[ordered]] = names
    return out, int(names[-1]) + 1


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """Positions of the suffixes of ``text`` in order. Its last letter must be its only least one.

    Suffixes are classified; the leftmost-S substrings are sorted by a first induction and named; the string of the
    names is sorted by recursion where names repeat; a second induction sorts all suffixes.
    """
    if len(text) < 3:
        return np.arange(len(text) - 1, -1, -1) if len(text) < 2 or text[0] > text[-1] else np.arange(len(text))
    induce = induce_by_waves if letters <= WAVE_LETTERS else induce_by_scan
    small = suffix_types(text)
    starts = leftmost(small)
    by_letter = starts[np.argsort(text[starts], kind="stable")]
    first = induce(text, small, by_letter, letters)
    is_start = np.zeros(len(text), bool)
    is_start[starts] = True
    ordered = first[is_start[first]]
    names, n_names = named(text, starts, ordered)
    if n_names < len(starts):
        ordered = starts[suffix_array(names, n_names)]
    return induce(text, small, ordered, letters)


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with a 0 after each piece, where each piece starts, and how much of its piece is left at each position."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(lengths + 1) - lengths - 1
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    left = np.repeat(starts + lengths, lengths + 1) - np.arange(len(data))
    return data, starts, left


def letters_of(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int]:
    """Bytes as letters from 2, ends of pieces as 1, and a 0 at the end; with the number of letters."""
    return np.append(np.where(left == 0, 1, data.astype(np.uint16) + 2), np.uint16(0)).astype(np.uint16), 258


def permuted_common_prefixes(data: np.ndarray, left: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the suffix before it in ``order`` and the length of their common prefix within their pieces.

    Where the letters in front of both are equal, the value is one less than that of the position in front; only the
    others are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words[: max(n - k, 0)] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    known = before >= 0
    limit = np.where(known, np.minimum(left, left[before]), 0)
    reduced = np.zeros(n, bool)
    reduced[1:] = known[1:] & known[:-1] & (before[1:] > 0) & (left[:-1] > 0) & (data[:-1] == data[before[1:] - 1]) & (left[before[1:] - 1] > 0)
    own = np.flatnonzero(~reduced & (limit > 0))
    common = np.zeros(n, np.int64)
    at, other, most = own, before[own], limit[own]
    step = 0
    while len(at):
        differ = words[at + step] ^ words[other + step]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.searchsorted(np.left_shift(np.uint64(1), np.arange(0, 64, 8, dtype=np.uint64)), low, side="right") - 1)
        common[at] = np.minimum(step + same, most)
        on = (differ == 0) & (step + 8 < most)
        at, other, most = at[on], other[on], most[on]
        step += 8
    lead = np.maximum.accumulate(np.where(reduced, 0, np.arange(n)))
    common = np.where(reduced, common[lead] - (np.arange(n) - lead), common)
    return before, np.maximum(np.minimum(common, limit), 0)
