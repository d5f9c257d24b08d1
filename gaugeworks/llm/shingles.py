"""Hashed word shingles of many texts at once, in numpy, and exact ones of a few."""

from __future__ import annotations

import hashlib

import numpy as np

#: Maps A-Z to lower case and ASCII white space to one byte.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))
_R = np.random.default_rng(20_240_229)
PLACE = _R.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a word that are mixed eight at a time; a longer word has the rest in a cryptographic digest.
MIXED_BYTES = 64
#: The low n bytes of eight, by n.
LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts in order, the number of its text, and where it begins and ends in the joined texts.

    Words are read eight bytes at a time, each eight mixed with those before: no sum of bytes, so words of one length
    don't share a hash by their structure. What is decided is never decided by these hashes alone.
    """
    body = (b" ".join(texts) + b" ").translate(FOLD)
    data = np.frombuffer(body + bytes(8), np.uint8)
    inside = data[: len(body)] != 32
    # the last byte is white space: starts and ends alternate
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.r_[0, edges]
    start, end = edges[::2], edges[1::2]
    n = end - start
    eight = np.ndarray((len(body),), "<u8", data, strides=(1,))
    h = mix((eight[start] & LOW_BYTES[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    on, at = np.flatnonzero(n > 8), 8
    while len(on) and at < MIXED_BYTES:
        left = n[on] - at
        h[on] = mix((h[on] ^ (eight[start[on] + at] & LOW_BYTES[np.minimum(left, 8)])) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(at))
        on, at = on[left > 8], at + 8
    for i in on.tolist():
        h[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(body[start[i] : end[i]], digest_size=8).digest(), "little"))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    # texts are few, words many
    return h, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, bounds), prepend=0)), start, end


def sequence_digest(text: bytes) -> bytes | None:
    """128 bits of the words of ``text`` in order, cryptographic; None without words."""
    words = text.translate(FOLD).split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of ``k`` words of each text, as hashes; a text with fewer words has its whole sequence as one."""
    h, text, _, _ = hashed_words(texts)
    counts = np.bincount(text, minlength=len(texts))
    first = np.r_[0, np.cumsum(counts)]
    n = max(len(h) - k + 1, 0)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s += h[i : i + n] * PLACE[i]
    s = mix(s)
    out = []
    for i, c in enumerate(counts.tolist()):
        a = int(first[i])
        if c >= k:
            out.append(np.unique(s[a : a + c - k + 1]))
        elif c:
            out.append(mix((h[a : a + c] * PLACE[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class ExactSets:
    """Shingle sets of the words themselves, as numbers that are equal only for equal shingles given to the same object."""

    def __init__(self, k: int):
        self.k = k
        self.words: dict[bytes, int] = {}
        self.longer: list[dict[int, int]] = [{} for _ in range(k)]

    def of(self, text: bytes) -> np.ndarray:
        own = text.translate(FOLD).split()
        if not own:
            return np.zeros(0, np.int64)
        number = self.words
        s = np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own))
        first, n = s, max(len(s) - self.k + 1, 1)
        for i in range(1, min(self.k, len(own))):
            # a shingle one word longer is a pair of numbers, numbered itself
            m = n if len(own) >= self.k else len(own) - i
            pairs, inverse = np.unique((s[:m] << 31) | first[i : i + m], return_inverse=True)
            names = self.longer[i]
            s = np.array([names.setdefault(x, len(names)) for x in pairs.tolist()], np.int64)[inverse]
        if len(own) < self.k:
            # a shorter text's only shingle: numbers under zero, by its length and its last name
            return np.array([-1 - (int(s[0]) * self.k + len(own))])
        return np.unique(s)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)
