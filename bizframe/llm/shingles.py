"""Weighted word shingles of many texts at once, in numpy.

Words are what ASCII white space separates, lower-cased. A word's hash is the polynomial of its bytes modulo 2**64, read
off prefix sums over a whole block of texts; a shingle's hash mixes its words' hashes in order; its weight is how often
it occurs in its text. A text of fewer words than a shingle has one shingle of all its words; a text without words none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text that are handled together.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
ROUNDS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= ROUNDS[0]
    x ^= x >> np.uint64(27)
    x *= ROUNDS[1]
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int) -> np.ndarray:
    """n unrelated odd multipliers, so that no reordering of what they weigh gives the same sum."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of at most BLOCK bytes together (or one text), with the index of the first."""
    run: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        data = (t or "").lower().encode()
        if run and size + len(data) > BLOCK:
            yield first, run
            run, size, first = [], 0, i
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, run


def shingle_hashes(data: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For every shingle of a block, in order: the text's index and the hash."""
    flat = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power = powers(BASE, len(flat))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * power, dtype=np.uint64)])
    inverse = powers(pow(BASE, -1, 1 << 64), len(flat))
    hashes = mixed((prefix[end] - prefix[start]) * inverse[start])

    ends = np.cumsum([len(x) + 1 for x in data])
    text_of = np.searchsorted(ends, start, side="right")
    count = np.bincount(text_of, minlength=len(data))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(data)), n)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    last = first + count
    out = np.zeros(len(at), np.uint64)
    for j, factor in enumerate(odd_constants(words)):
        here = at + j
        inside = here < last[owner]
        out += np.where(inside, hashes[np.minimum(here, len(hashes) - 1)], np.uint64(0)) * factor
    return owner, mixed(out)


def weighted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ordered by text and hash: text, hash, weight."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return o[at], h[at], np.diff([*at, len(h)])


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets (sorted hashes, weights): the sum over the shared i of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1][ia].astype(np.float64), b[1][ib].astype(np.float64)
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    order = np.argsort(wb / wa, kind="stable")
    wa, wb = wa[order], wb[order]
    ratio = wb / wa
    upto = np.searchsorted(ratio, ratio, side="right")
    low = np.concatenate([[0], np.cumsum(wa)])[upto] + only_a  # where b_j / a_j is no larger, a_j / a_i counts
    high = wb.sum() - np.concatenate([[0], np.cumsum(wb)])[upto] + only_b
    return float((1 / (low / wa + high / wb)).sum())


#: Shingles that are looked up together.
LOOKUPS = 1 << 20


def similarities(a: np.ndarray, b: np.ndarray, texts: int, owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """probability_jaccard() of the pairs of texts (a, b), of weighted(). Where no shingle repeats in either text it is the
    shared part of all shingles of both, counted for many pairs at once."""
    sizes = np.bincount(owner, minlength=texts)
    first = np.cumsum(sizes) - sizes
    repeats = np.bincount(owner, weight != 1, texts) > 0
    out = np.zeros(len(a))
    rank = np.unique(hashes, return_inverse=True)[1].reshape(-1).astype(np.int64)
    place = owner * (len(hashes) + 1) + rank  # ascending, as weighted() sorts
    small = np.where(sizes[a] <= sizes[b], a, b)
    large = a + b - small
    plain = np.flatnonzero(~repeats[a] & ~repeats[b] & (sizes[small] > 0))
    ends = np.cumsum(sizes[small[plain]])
    cuts = np.flatnonzero(np.diff(ends // LOOKUPS, prepend=-1)) if len(plain) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(plain))):
        some = plain[lo:hi]
        n = sizes[small[some]]
        of = np.repeat(np.arange(len(some)), n)
        at = np.repeat(first[small[some]] - (np.cumsum(n) - n), n) + np.arange(len(of))
        wanted = large[some][of] * (len(hashes) + 1) + rank[at]
        near = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
        both = np.bincount(of, place[near] == wanted, len(some))
        out[some] = both / (n + sizes[large[some]] - both)
    part = lambda k: (hashes[first[k] : first[k] + sizes[k]], weight[first[k] : first[k] + sizes[k]])
    for i in np.flatnonzero(repeats[a] | repeats[b] | (sizes[small] == 0)):
        out[i] = probability_jaccard(part(a[i]), part(b[i]))
    return out
