"""Hashes of words as numpy arrays."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words of more bytes are hashed one by one.
LONG = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
#: Keeps the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt * _BASE & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lanes:
    """Reads words of a byte array eight bytes at a time, from any place."""

    def __init__(self, raw: np.ndarray):
        self.held = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.at = np.ndarray((len(raw) + 1,), "<u8", self.held, strides=(1,))

    def read(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first eight bytes from each start, or as many as its size."""
        return self.at[starts] & _FIRST[np.minimum(sizes, 8)]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word: mixed eight bytes after eight, so no two short words of equal length
    share it but by chance; words of more than ``LONG`` bytes by a cryptographic digest."""
    out = mix((ends - starts).astype(np.uint64) * ODD[7])
    if not len(starts):
        return out
    lanes, sizes = Lanes(raw), ends - starts
    live, at, left = slice(None), starts, sizes
    for k in range(LONG // 8):
        out[live] = mix(out[live] * ODD[6] ^ lanes.read(at, left), k + 1)
        more = np.flatnonzero(sizes > 8 * (k + 1))
        if not len(more):
            break
        live, at, left = more, starts[more] + 8 * (k + 1), sizes[more] - 8 * (k + 1)
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].data, digest_size=8).digest(), "little")
    return out


def same_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether each word of ``raw`` has the bytes of the word beside it in ``others``."""
    sizes = ends - starts
    same = sizes == stop - begin
    x, y = Lanes(raw), Lanes(others)
    live, k = np.flatnonzero(same), 0
    while len(live):
        left = sizes[live] - k
        good = x.read(starts[live] + k, left) == y.read(begin[live] + k, left)
        same[live[~good]] = False
        k += 8
        live = live[good & (left > 8)]
    return same
