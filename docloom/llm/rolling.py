"""Polynomial hashes of byte windows, in numpy: equal strings have equal hashes wherever they stand.

Unequal strings may have equal hashes (long ones can be made to), so whoever needs equality compares the bytes as well, as
`distinct_spans` does.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_MULTIPLIER = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of MurmurHash3, on arrays (fixed values)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2^64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            one = np.ones(1, np.uint64)
            cls.up = np.cumprod(np.concatenate([one, np.full(n - 1, _MULTIPLIER, np.uint64)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([one, np.full(n - 1, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of value(raw[k]) m^k over i <= k < j, modulo 2^64; raw holds bytes or code points."""
    up, _ = _Powers.to(len(raw) + 1)
    values = _BYTES[raw] if raw.dtype == np.uint8 else mix((raw.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(raw)], dtype=np.uint64)])


def window_hashes(sums: np.ndarray, first: np.ndarray | slice, last: np.ndarray | slice) -> np.ndarray:
    """64-bit hashes of raw[first:last]."""
    _, down = _Powers.to(len(sums))
    return mix((sums[last] - sums[first]) * down[first])


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, then the next, as one array of indices."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, which value each place has, counts), by one unstable sort."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[first], order[first], which, np.diff(first, append=len(order))


#: Masks of the lowest 0 .. 8 bytes of a word.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer strings are hashed and compared one by one.
_WORDWISE = 256


class Words:
    """A byte array whose eight bytes from any place on are read as one number."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.at = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))

    def keys(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64-bit keys of strings: of those of at most seven bytes no two share one, longer ones may."""
        out = self.at[start] & _LOWEST[np.minimum(size, 8)]
        out ^= np.where(size < 8, size, 0).astype(np.uint64) << np.uint64(56)
        out = mix(out)
        live, k = np.flatnonzero((size > 8) & (size <= _WORDWISE)), 8
        while len(live):
            word = self.at[start[live] + k] & _LOWEST[np.minimum(size[live] - k, 8)]
            out[live] = mix(out[live] * np.uint64(_MULTIPLIER) + word + np.uint64(k))
            k += 8
            live = live[size[live] > k]
        for i in np.flatnonzero(size > _WORDWISE).tolist():
            out[i] = xxh3_64_intdigest(self.raw[start[i] : start[i] + size[i]].tobytes())
        return out

    def equal(self, first: np.ndarray, other: Words, second: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether self.raw[first : first + size] and other.raw[second : second + size] are the same bytes."""
        out = np.ones(len(size), bool)
        for i in np.flatnonzero(size > _WORDWISE).tolist():
            out[i] = np.array_equal(self.raw[first[i] : first[i] + size[i]], other.raw[second[i] : second[i] + size[i]])
        live, k = np.flatnonzero((size > 0) & (size <= _WORDWISE)), 0
        while len(live):
            differ = (self.at[first[live] + k] ^ other.at[second[live] + k]) & _LOWEST[np.minimum(size[live] - k, 8)]
            out[live[differ != 0]] = False
            k += 8
            live = live[(differ == 0) & (size[live] > k)]
        return out


def distinct_spans(words: Words, start: np.ndarray, size: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct string, which one each place has, counts) for spans of bytes.

    Spans are grouped by their keys; longer ones are compared byte by byte with the first of their group, and what differs
    from it, by a collision, is told apart by its bytes.
    """
    _, at, which, counts = distinct(words.keys(start, size) if keys is None else keys)
    first = at[which]
    wrong = size != size[first]
    long = np.flatnonzero((size > (7 if keys is None else 0)) & ~wrong & (first != np.arange(len(first))))
    twin = first[long]
    wrong[long] = ~words.equal(start[long], words, start[twin], size[long])
    if not wrong.any():
        return at, which, counts
    found: dict[bytes, int] = {}
    more = []
    for i in np.flatnonzero(wrong).tolist():
        which[i] = found.setdefault(words.raw[start[i] : start[i] + size[i]].tobytes(), len(at) + len(found))
        if len(found) > len(more):
            more.append(i)
    at = np.concatenate([at, np.array(more, np.int64)])
    return at, which, np.bincount(which, minlength=len(at))
