"""Word-shingle sets of documents as 52-bit hashes, computed in numpy.

A text is lower-cased (A-Z) and its words joined by single spaces, so that a
shingle of k words is a substring; substring hashes come from prefix sums of a
polynomial modulo 2^64 over random byte values.  Two different shingles of a
pair of sets share a hash with a probability below 2^-45.
"""

from __future__ import annotations

import numpy as np

#: Texts are hashed together up to about this many bytes.
_TOGETHER = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_VALUES = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Cells that shingle counts are folded into.
CELLS = 1 << 20
MASK = np.uint64((1 << 52) - 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        n = max(n, _TOGETHER + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, inverse)):
                steps = np.full(n, b)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _hashed(texts: list[bytes], counts: list[int], k: int) -> list[np.ndarray]:
    whole = b" ".join(texts)
    data = np.frombuffer(whole, np.uint8)
    power, back = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * power[: len(data)], out=sums[1:])
        space = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], space + 1])
        ends = np.concatenate([space, [len(data)]])
        out, at = [], 0
        for n in counts:
            m = max(1, n - k + 1)
            s, e = starts[at : at + m], ends[at + min(k, n) - 1 : at + n]
            out.append(mixed((sums[e] - sums[s]) * back[s]))
            at += n
    return out


def shingle_hashes(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Hashes (64 bits, with repeats) of each text's shingles; fewer than k words are one shingle, none is empty."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    held, size = [], 0
    for i, text in enumerate(texts):
        words = text.encode().lower().split() if text else []
        if words:
            held.append((i, b" ".join(words), len(words)))
            size += len(held[-1][1]) + 1
        if held and (size >= _TOGETHER or i == len(texts) - 1):
            for (j, _, _), h in zip(held, _hashed([t for _, t, _ in held], [n for _, _, n in held], k)):
                out[j] = h
            held, size = [], 0
    if held:
        for (j, _, _), h in zip(held, _hashed([t for _, t, _ in held], [n for _, _, n in held], k)):
            out[j] = h
    return out


def shingle_sets(texts: list[str | None], ranks: np.ndarray | None = None, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text, 52 bits each; ``ranks`` (12 bits by cell) go in front, so rare cells sort first."""
    out = []
    for h in shingle_hashes(texts, k):
        h &= MASK
        if ranks is not None:
            h |= ranks[(h & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(52)
        h.sort()
        out.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h)
    return out


def signature(tokens: np.ndarray) -> bytes:
    """Parities of a set's hashes over a power of two of bits, about as many as it has members."""
    bits = 1 << max(6, int(len(tokens) - 1).bit_length())
    place = ((tokens & MASK) >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two signed sets."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = len(a) * 8, len(b) * 8
    while n > m:  # fold the larger one: parities of places that become one
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit key of a sorted array of hashes."""
    with np.errstate(over="ignore"):
        one = mixed(tokens + np.uint64(0x632BE59BD9B4E019))
        return int(mixed(np.array([one.sum() * np.uint64(3) ^ np.bitwise_xor.reduce(one) ^ np.uint64(len(tokens))], np.uint64)).astype(np.int64)[0])
