"""Hashes of the words of many texts at once, by array operations on their bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Bytes of a word hashed at a time.
STEP = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit numbers (the finaliser of a public hash function)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, end to end; the line of each, counted over all texts; the first line of each text.

    A-Z are lower-cased; words are runs between ASCII white space, and lines end at ``\\n``. A hash takes in its
    word's bytes eight at a time, each step with its number of bytes, and is the same in any text.
    """
    texts = [t or "" for t in texts]
    first = np.cumsum([0, *(t.count("\n") + 1 for t in texts)])[:-1]
    data = np.frombuffer(("\n".join(texts) + " " * STEP).encode().lower(), np.uint8)
    space = (data == 32) | ((data - np.uint8(9)) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = edge if space[0] else np.r_[0, edge]
    starts, left = edge[::2].copy(), (edge[1::2] - edge[::2]).astype(np.uint64)
    breaks = np.flatnonzero(data == 10)
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.r_[0, np.searchsorted(starts, breaks), len(starts)]))
    windows = np.ndarray((len(data) - STEP + 1,), "<u8", data, strides=(1,))

    def step(hashes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        here = np.minimum(left, np.uint64(STEP))
        part = windows[at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * here))
        return mix(mix(hashes + here * np.uint64(0x9E3779B97F4A7C15)) + part)

    hashes = step(np.zeros(len(starts), np.uint64), starts, left)
    rows, done = np.flatnonzero(left > STEP), STEP
    while len(rows):
        hashes[rows] = step(hashes[rows], starts[rows] + done, left[rows] - np.uint64(done))
        done += STEP
        rows = rows[left[rows] > done]
    return hashes, line, first
