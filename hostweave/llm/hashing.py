"""Word and shingle hashes of many texts at once, with NumPy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, _U)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, _BASE)]))
    return _powers[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _SPACE[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, _U), np.zeros(len(texts), np.int64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = _BYTE[_LOWER[data[~blank]]] * powers(int(sizes.max()))[inside]
    hashes = mix64(np.add.reduceat(values, first) + sizes.astype(_U))
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    upto = np.searchsorted(starts, text_ends)
    return hashes, np.diff(upto, prepend=0)


def shingle_hashes(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words, but at least one, has one shingle: all its words.
    """
    words, counts = word_hashes(texts)
    out: list[np.ndarray] = []
    if len(words) >= width:
        n = len(words) - width + 1
        wide = words[:n] * _PLACE[0]
        for j in range(1, width):
            wide = wide + words[j : n + j] * _PLACE[j]
        wide = mix64(wide)
    at = 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(wide[at : at + c - width + 1]))
        elif c:
            out.append(mix64(np.array([(words[at : at + c] * _PLACE[:c]).sum() + _U(c)], _U)))
        else:
            out.append(np.empty(0, _U))
        at += c
    return out


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Neighbouring items in slices of at most ``most`` in all, or one item each if it is larger."""
    out, begin, total = [], 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            out.append((begin, i))
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out
