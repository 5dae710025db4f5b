"""One-hot codes of words in windows of bytes: encoding, decoding by columns, and decoding that keeps to UTF-8."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Row of UTF-8's well-formed sequences: first and last lead byte, how many bytes follow, range of the first that follows.
WELL_FORMED = ((0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

#: Bytes that follow each lead byte, -1 where it can't lead; and the range of the first.
FOLLOW, LOW, HIGH = np.full(256, -1), np.zeros(256, int), np.zeros(256, int)
for _a, _b, _n, _low, _high in WELL_FORMED:
    FOLLOW[_a : _b + 1], LOW[_a : _b + 1], HIGH[_a : _b + 1] = _n, _low, _high


def encode(words: Sequence[bytes], length: int) -> np.ndarray:
    """(word, 256, position): 1 over the root of ``length`` at each byte, every word then of mean 0 and deviation 1; bytes beyond the window are cut."""
    out = np.zeros((len(words), 256, length))
    for i, w in enumerate(words):
        cut = np.frombuffer(w[:length], np.uint8)
        out[i, cut, np.arange(len(cut))] = 1 / np.sqrt(length)
    flat = out.reshape(len(words), 256 * length)
    deviation = flat.std(axis=1, keepdims=True)
    return ((flat - flat.mean(axis=1, keepdims=True)) / np.where(deviation > 0, deviation, 1.0)).reshape(out.shape)


def decode(codes: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Words and margins (word, position): each column's greatest byte, up to the first whose lead over the next is below half the word's largest lead."""
    if not len(codes):
        return [], np.zeros((0, codes.shape[2]))
    two = np.partition(codes, 254, axis=1)[:, 254:]
    margins = two[:, 1] - two[:, 0]
    faint = margins < 0.5 * margins.max(axis=1, keepdims=True)
    ends = np.where(faint.any(axis=1), faint.argmax(axis=1), codes.shape[2])
    best = codes.argmax(axis=1).astype(np.uint8)
    return [bytes(b[:n]) for b, n in zip(best, ends, strict=True)], margins


def decode_utf8(codes: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Words of at most ``lengths`` bytes, well-formed: a byte that can't follow is masked out before each column's greatest is taken.

    A character only starts where it fits; where the greatest byte starts one that doesn't, the word ends, but not empty.
    All words go through a position together: what each expects next is a count of bytes and a range.
    """
    n, _, length = codes.shape
    every = np.arange(256)
    left, low, high = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    ended, out, size = lengths <= 0, np.zeros((n, length), np.uint8), np.zeros(n, int)
    for p in range(length):
        column, room = codes[:, :, p], lengths - p
        wish = column.argmax(axis=1)
        start = left == 0
        ended |= (room <= 0) | (start & (p > 0) & (FOLLOW[wish] >= room))
        lead = (FOLLOW[None, :] >= 0) & (FOLLOW[None, :] < room[:, None])
        follow = (every >= low[:, None]) & (every <= high[:, None])
        allowed = np.where(start[:, None], lead, follow)
        best = np.where(allowed, column, -np.inf).argmax(axis=1)
        go = ~ended & allowed.any(axis=1)
        ended |= ~go
        out[go, p] = best[go]
        size[go] += 1
        left = np.where(go, np.where(start, FOLLOW[best], left - 1), left)
        low, high = np.where(start, LOW[best], 0x80), np.where(start, HIGH[best], 0xBF)
    return [bytes(b[:k]) for b, k in zip(out, size, strict=True)]
