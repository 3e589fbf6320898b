"""Word shingles as 64-bit numbers, in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

WORDS = 5

_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)
_S32, _S29 = np.uint64(32), np.uint64(29)


def scramble(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random; another one for every seed."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


#: Odd multipliers, one for each place in a shingle.
_PLACES = scramble(np.arange(1, WORDS + 1, dtype=np.uint64), 77) | np.uint64(1)


#: Random values of bytes (A-Z as a-z), which bytes are blank, and an odd base with its inverse modulo 2^64.
_VALUES = scramble(np.arange(256, dtype=np.uint64), 1234567)
_VALUES[65:91] = _VALUES[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = int(scramble(np.array([99], np.uint64))[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: A text is hashed in segments of about so many bytes, cut at blanks.
SEGMENT = 1 << 18


class Powers:
    """Powers of the base and of its inverse, as far as they have been needed."""

    def __init__(self) -> None:
        self.size, self.up, self.down = 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def grow(self, size: int) -> None:
        if size > self.size:
            self.size = max(size, 2 * self.size, 4096)
            ones = np.full(self.size, _BASE, np.uint64), np.full(self.size, _INVERSE, np.uint64)
            for x in ones:
                x[0] = 1
            self.up, self.down = (np.cumprod(x) for x in ones)


def _segment_hashes(data: np.ndarray, powers: Powers, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    powers.grow(len(data) + 1)
    edge = np.diff(np.concatenate([[False], ~blank[data], [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers.up[: len(data)], out=sums[1:])
    return scramble((sums[ends] - sums[starts]) * powers.down[starts], 7) + (ends - starts).astype(np.uint64), starts


def located(text: bytes | None, powers: Powers, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a UTF-8 text, A-Z lower-cased, and the byte where it starts.

    Words are cut at the bytes that blank marks. A word's hash is the sum of its bytes' values times powers of the base;
    differences of running sums give it for all words at once.
    """
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    if len(data) <= 2 * SEGMENT:
        return _segment_hashes(data, powers, blank)
    parts, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and not blank[data[end]]:
            more = np.flatnonzero(blank[data[end : end + 4096]])
            end = end + int(more[0]) if len(more) else min(end + 4096, len(data))
        found, starts = _segment_hashes(data[at:end], powers, blank)
        parts.append((found, starts + at))
        at = end
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def hashes(text: bytes | None, powers: Powers) -> np.ndarray:
    """The hashes of a text's words, cut at the six ASCII blanks only."""
    return located(text, powers)[0]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a plain sort is several times faster than np.unique)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def positions(word_hashes: np.ndarray, width: int = WORDS) -> np.ndarray:
    """The shingle at each place, with repeats; a shorter text is one shingle, an empty one has none."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < width:
        return scramble(np.array([xxhash.xxh3_64_intdigest(word_hashes.tobytes(), seed=n)], np.uint64), 5)
    total = word_hashes[: n - width + 1] * _PLACES[0]
    for k in range(1, width):
        total = total + word_hashes[k : n - width + 1 + k] * _PLACES[k]
    return scramble(total)


def shingle_set(text: bytes | None, powers: Powers) -> np.ndarray:
    """Sorted distinct shingles of a text."""
    return distinct(positions(hashes(text, powers)))


def set_key(shingles: np.ndarray) -> bytes:
    """16 bytes that name a set of shingles."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def unions(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Node to least node of its component, for the nodes of some pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}
