"""Hashed word shingles of whole texts, in numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from orrery.llm.support import BLANKS

U64 = np.uint64
#: Bytes that are looked at together; longer texts are looked at alone.
BLOCK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


IS_BLANK = np.zeros(256, bool)
IS_BLANK[[ord(c) for c in BLANKS]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
STEP = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> np.ndarray:
    out = np.full(n, STEP, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of the bytes."""
    blank = IS_BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, U64)
    lengths = ends - starts
    inside = np.flatnonzero(~blank)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    terms = BYTE[data[inside]] * powers(int(lengths.max()))[place]
    return starts, mixed(np.add.reduceat(terms, first) + lengths.astype(U64))


def blocks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts as bytes) of runs of about BLOCK bytes."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        run.append((text or "").encode())
        size += len(run[-1])
        if size >= BLOCK:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


def shingle_sets(texts: Iterable[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its n-word shingles, A-Z lower-cased.

    A text of fewer than n words has its whole sequence as one; one without words has none.
    """
    for _, run in blocks(texts):
        data = LOWER[np.frombuffer(b" ".join(run) + b" ", np.uint8)]
        starts, words = word_hashes(data)
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in run]))
        grams = np.zeros(max(0, len(words) - n + 1), U64)
        for j in range(n):
            grams = mixed(grams * U64(STEP) + words[j : j + len(grams)] + U64(n))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            else:
                short = np.zeros(1, U64)
                for w in words[lo:hi]:
                    short = mixed(short * U64(STEP) + w + U64(hi - lo))
                yield short[: int(hi > lo)]
