"""MD5 of many short texts at once in NumPy, for draws that any SQL engine can repeat."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def head(words: list[np.ndarray | int], count: int) -> np.ndarray:
    """The first eight hex digits, as numbers, of the digests of ``count`` texts of one block each. A word of the block is an array, or one number for all texts."""
    a, b, c, d = (np.full(count, x, np.uint32) for x in START)
    f, more = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for t in range(61):  # the first word is final then
        if t < 16:
            at = t
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif t < 32:
            at = (5 * t + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif t < 48:
            at = (3 * t + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * t % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word, by = words[at], TURNS[t // 16][t % 4]
        a += f
        if isinstance(word, np.ndarray):
            a += word
            a += np.uint32(SINES[t])
        else:
            a += np.uint32((SINES[t] + word) % 2**32)
        np.right_shift(a, np.uint32(32 - by), out=more)
        np.left_shift(a, np.uint32(by), out=a)
        a |= more
        a += b
        a, b, c, d = d, a, b, c
    return (b + np.uint32(START[0])).byteswap()


def draws(seed: int, resamples: range, n: int, chunk: int = 32_768) -> Iterator[tuple[int, np.ndarray]]:
    """(b, numbers) for the texts ``seed|b|i`` of all i under ``n``, in pieces: for each resample the ``head`` of every i once, i ascending."""
    for first in (0, *[10**k for k in range(1, len(str(max(n - 1, 0))))]):  # texts of one length at a time
        digits = len(str(first))
        for start in range(first, min(n, 10**digits), chunk):
            rest = np.arange(start, min(start + chunk, n, 10**digits), dtype=np.uint64)
            count = len(rest)
            tail = np.empty((digits, count), np.uint8)
            for k in range(digits - 1, -1, -1):
                rest, tail[k] = np.divmod(rest, np.uint64(10))
            tail += ord("0")
            shaped: dict[int, dict[int, np.ndarray]] = {}  # the words with digits of i, by the length of what stands before
            for b in resamples:
                before = f"{seed}|{b}|".encode()
                length = len(before) + digits
                block = bytearray(64)
                block[: len(before)] = before
                block[length] = 0x80
                block[56:] = (8 * length).to_bytes(8, "little")
                if len(before) not in shaped:
                    own = shaped[len(before)] = {}
                    for k in range(digits):
                        at = len(before) + k
                        word = own.setdefault(at // 4, np.zeros(count, np.uint32))
                        word |= tail[k].astype(np.uint32) << np.uint32(8 * (at % 4))
                words: list = [int.from_bytes(block[4 * w : 4 * w + 4], "little") for w in range(16)]
                for w, x in shaped[len(before)].items():
                    words[w] = x | np.uint32(words[w])
                yield b, head(words, count)
