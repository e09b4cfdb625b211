"""MD5 of many short texts at once, as NumPy words: what keys.draw() tells one by one."""

from __future__ import annotations

import hashlib
import math

import numpy as np

SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts at a time, so that a word of each stays in a core's cache, and the longest text of one block.
RUN, LONGEST = 16384, 55


def _compressed(x: list) -> list[np.ndarray]:
    """The four words of the digests of messages of one block, given by their 16 words: arrays, or a number where all have the same."""
    n = next(len(w) for w in x if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(n, v, dtype=np.uint32) for v in START)
    f, t = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        w = x[PLACES[i]]
        np.add(f, a, out=f)
        if isinstance(w, np.ndarray):
            np.add(f, w, out=f), np.add(f, np.uint32(SINES[i]), out=f)
        else:
            np.add(f, np.uint32((SINES[i] + w) & 0xFFFFFFFF), out=f)
        np.left_shift(f, np.uint32(SHIFTS[i]), out=t), np.right_shift(f, np.uint32(32 - SHIFTS[i]), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return [np.add(v, np.uint32(s)) for v, s in zip((a, b, c, d), START)]


def md5_words(prefixes: list[bytes], numbers: np.ndarray, words: int = 4) -> np.ndarray:
    """(prefixes, numbers, words) uint32: the first words, big-endian as in the hex digest, of the MD5 of each prefix followed by each whole number in decimal."""
    out = np.empty((len(prefixes), len(numbers), words), dtype=np.uint32)
    lengths, digits = np.array([len(p) for p in prefixes]), np.char.str_len(numbers.astype(str))
    tails = np.zeros((len(numbers), digits.max(initial=0) + 1), dtype=np.uint8)  # a number's digits, and the bit that ends the text
    tails[:, :-1] = numbers.astype(f"S{tails.shape[1] - 1}").view(np.uint8).reshape(len(numbers), -1) if len(numbers) else 0
    tails[np.arange(len(numbers)), digits] = 0x80
    for size in np.unique(lengths):
        own = np.flatnonzero(lengths == size)
        end = int(size + tails.shape[1] - 1)
        if end > LONGEST:
            for i in own:
                for j, number in enumerate(numbers):
                    out[i, j] = np.frombuffer(hashlib.md5(prefixes[i] + str(number).encode()).digest(), dtype=">u4")[:words]
            continue
        heads = np.frombuffer(b"".join(prefixes[i] for i in own), dtype=np.uint8).reshape(len(own), size)
        step = max(1, RUN // max(1, len(numbers)))
        for k in range(0, len(own), step):
            head = heads[k : k + step]
            for j in range(0, len(numbers), RUN):
                tail = tails[j : j + RUN]
                text = np.zeros((len(head), len(tail), 4 * (end // 4 + 1)), dtype=np.uint8)
                text[:, :, :size], text[:, :, size : end + 1] = head[:, None], tail[None]
                block = text.view("<u4").reshape(len(head) * len(tail), -1)
                x: list = [np.ascontiguousarray(block[:, w]) if w <= end // 4 else 0 for w in range(16)]
                x[14] = np.tile(8 * (size + digits[j : j + RUN]).astype(np.uint32), len(head))
                got = _compressed(x)[:words]
                out[own[k : k + step], j : j + RUN] = np.stack([w.byteswap() for w in got], axis=1).reshape(len(head), len(tail), words)
    return out
