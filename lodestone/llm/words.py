"""Vectorised splitting into words ``[^\\x20\\x09-\\x0D]+`` and 64-bit word hashes."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK = 1 << 19
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to ``n`` at least; those up to CHUNK are kept, longer ones are made for the call."""
    if n <= CHUNK and _tables:
        return _tables[0]
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(max(n, CHUNK) + 1, base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    if n <= CHUNK:
        _tables.append((out[0], out[1]))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _split_piece(b: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE):
    """Words of one piece; ``bounds`` are text starts inside it (a word never spans one)."""
    word = ~space[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(b))]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    power, inverse = _powers(len(b))
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    h = (total[e] - total[s]) * inverse[s]
    h ^= (e - s).astype(np.uint64) << np.uint64(48)
    return s, e, mix(h)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
    """All words of concatenated texts.

    Returns (start, end, hash, pointer): byte ranges, word hashes and, for each text i, its words at
    pointer[i]:pointer[i+1]. Equal words have equal hashes wherever they stand.
    """
    parts, at, n = [], 0, len(data)
    while at < n:
        stop = min(n, at + CHUNK)
        if stop < n:
            cut = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[cut] > at:
                stop = int(offsets[cut])
            else:
                # inside one long text: cut at its last white space, or at the next one
                spaces = np.flatnonzero(space[data[at:stop]])
                if len(spaces):
                    stop = at + int(spaces[-1]) + 1
                else:
                    limit = int(offsets[cut + 1])
                    while stop < limit:
                        ahead = np.flatnonzero(space[data[stop : min(limit, stop + CHUNK)]])
                        if len(ahead):
                            stop += int(ahead[0]) + 1
                            break
                        stop = min(limit, stop + CHUNK)
        piece = data[at:stop]
        if lower:
            piece = LOWER[piece]
        lo, hi = np.searchsorted(offsets, [at, stop])
        s, e, h = _split_piece(piece, offsets[lo:hi] - at, space)
        parts.append((s + at, e + at, h))
        at = stop
    if parts:
        start, end, hashes = (np.concatenate(x) for x in zip(*parts))
    else:
        start = end = np.empty(0, np.int64)
        hashes = np.empty(0, np.uint64)
    return start, end, hashes, np.searchsorted(start, offsets)
