"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import hashlib
import secrets
from dataclasses import dataclass

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROOT = 0x2545F4914F6CDD1D  # odd, so it has an inverse
_INVERSE = pow(_ROOT, -1, 1 << 64)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A random 64-bit value for each byte.
_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}

#: Bytes of words, by operator: all but ASCII white space, or digits, letters and everything outside ASCII.
NOT_WHITE = np.ones(256, dtype=bool)
NOT_WHITE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words of more bytes are hashed by BLAKE2, others eight bytes at a time.
LONG_WORD = 64
#: A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def powers(root: int, n: int) -> np.ndarray:
    """root**0 .. root**(n - 1), modulo 2**64."""
    known = _powers.get(root)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 21), root, dtype=np.uint64)
        known[0] = 1
        _powers[root] = known = np.multiply.accumulate(known)
    return known[:n]


@dataclass
class Words:
    """Words in order: byte bounds, the text each is in, and 64-bit hashes; ``first[i]`` is the first word of text i."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return self.first[1:][self.row] - np.arange(len(self.row))


def new_seed() -> int:
    """A key for the hashes of one query (or of one comparison within a task)."""
    return secrets.randbits(63)


def split_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool, seed: int = 0) -> Words:
    """The words of the texts that lie between ``offsets`` in ``data``.

    Hashes are keyed by ``seed``: with one drawn for a query, nobody can have made up words that collide, and different words
    have equal hashes by 64-bit chance only. Words of eight bytes or fewer and one length never do.
    """
    n = len(data)
    inside = word_bytes[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, row, word_hashes(LOWER[data] if lower else data, start, end, seed), first)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of data[start:end], keyed by ``seed``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = end - start
    key = mix(np.full(1, seed, np.uint64) + _MUL)
    out = mix(key + length.astype(np.uint64))
    live = np.flatnonzero(length <= LONG_WORD)
    k = 0
    while len(live):
        left = np.minimum(length[live] - k, 8)
        # The bytes of the word alone, low ones first.
        chunk = eight[start[live] + k] & (_ONES >> (np.uint64(8) * (8 - left).astype(np.uint64)))
        out[live] = mix((out[live] ^ chunk) * _MUL + key)
        k += 8
        live = live[length[live] > k]
    secret = key.tobytes()
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=secret).digest(), "little")
    return out


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, from each word but the last k - 1 on, across texts too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = mix(out * _MUL + hashes[i : i + n])
    return out
