"""Vectorised views of many texts at once: word boundaries, rolling hashes, minimizers."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93

#: The six separators of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Separators of the looser rule: every ASCII character that is neither a letter nor a digit.
PUNCT = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= MIX
    x ^= x >> np.uint64(29)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1] = base
            k = 2
            while k < size:
                p[k : 2 * k] = p[:k] * np.uint64(pow(base, k, 1 << 64))
                k *= 2
            both.append(p)
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def prefix(data: np.ndarray) -> np.ndarray:
    """prefix[i] hashes data[:i]; a slice's hash comes from two of them (see span_hash)."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(len(p))[1]
    return mixed((p[ends] - p[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, ends: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, first): byte bounds of every word, and the index of each text's first word (one more at the end)."""
    inside = ~separators[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    cuts = ends[(ends > 0) & (ends < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, ends)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of hashes[i:i+k] at every i; the last k - 1 places, which have no such slice, hold junk."""
    n = len(hashes) - k + 1
    g = np.zeros(len(hashes), np.uint64)
    if n > 0:
        for j in range(k):
            g[:n] += hashes[j : j + n] * np.uint64(pow(BASE, j, 1 << 64))
    return mixed(g)


def minimizers(g: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leftmost minima of all windows of `width` places inside the spans [first[d], last[d]).

    Returns (place, low, high): the windows that start at low..high have their leftmost minimum at `place`.
    Equal stretches of text choose equal places, wherever they stand.  Spans must be ascending and disjoint.
    """
    long = last - first >= width
    first, last = first[long].astype(np.int64), last[long].astype(np.int64)
    none = np.zeros(0, np.int64)
    if not len(first):
        return none, none, none
    dense = 8 if width < 64 else 32  # places that are no minimum of any such window fall out in a few array passes
    keep = np.ones(len(g), bool)
    if width >= dense and len(g) >= 2 * dense:
        m = g.copy()
        step = 1
        while step < dense:
            np.minimum(m[:-step], m[step:], out=m[:-step])
            step *= 2
        step = 1
        while step < dense:
            m[step:] = np.maximum(m[step:], m[:-step])
            step *= 2
        np.equal(g, m, out=keep)
        edge = (np.concatenate([first, last])[:, None] + np.arange(-2 * dense, 2 * dense)).ravel()
        keep[edge[(edge >= 0) & (edge < len(g))]] = True
    p = np.flatnonzero(keep)
    d = np.searchsorted(first, p, side="right") - 1
    fits = (d >= 0) & (p < last[np.maximum(d, 0)])
    p, d = p[fits], d[fits]
    widths = []
    w = 2 * dense
    while w < width:
        widths.append(w)
        w *= 2
    for w in [*widths, width]:
        v, lo, hi = g[p], np.maximum(first[d] - 1, p - w), np.minimum(last[d], p + w)
        for left in (True, False):
            at = np.arange(len(p))
            j = 0
            while len(at):
                j += 1
                other = at - j if left else at + j
                ok = (other >= 0) & (other < len(p))
                at, other = at[ok], other[ok]
                near = p[other] > lo[at] if left else p[other] < hi[at]
                at, other = at[near], other[near]
                found = v[other] <= v[at] if left else v[other] < v[at]
                (lo if left else hi)[at[found]] = p[other[found]]
                at = at[~found]
        stay = hi - lo - 1 >= w
        p, d, lo, hi = p[stay], d[stay], lo[stay], hi[stay]
    low = np.maximum(lo + 1, p - width + 1)
    high = np.minimum(p, hi - width)
    return p, low, high
