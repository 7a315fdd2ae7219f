"""Words of whole texts as arrays of 64-bit hashes, and rolling hashes of runs of words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U = np.uint64
#: What separates words: space and the controls from tab to carriage return (what bytes.split() splits at).
SPACES = b" \t\n\v\f\r"
#: Longer words are hashed by xxHash: modulo 2**64 a polynomial of any odd base maps some texts of 1024 bytes to one value.
POLYNOMIAL_BYTES = 32
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _table(lower: bool) -> np.ndarray:
    codes = np.arange(256)
    if lower:
        codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return mixed(codes.astype(np.uint64) + U(0x632BE59BD9B4E019))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.r_[U(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up, self.down


_bytes_powers, _word_powers = Powers(_BASE), Powers(_WORD_BASE)


def measured_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and lengths in bytes of all words of all texts in turn, and the number of words of each text. lower: A-Z count as a-z."""
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    ends_of_texts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _bytes_powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_table(lower)[buf] * up[: len(buf)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > POLYNOMIAL_BYTES).tolist():
        word = buf[starts[i] : ends[i]].tobytes()
        hashes[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return hashes, ends - starts, np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, counts = measured_words(texts, lower)
    return hashes, counts


class Rolling:
    """Rabin-Karp hashes of runs of hashed words, from one prefix sum (of up to 100 words or so: see POLYNOMIAL_BYTES)."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        up, self.down = _word_powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * up[: self.n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts] + np.asarray(length).astype(np.uint64) * U(_BASE))
