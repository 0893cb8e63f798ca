"""Hashes of words, shingles and byte strings, worked out for many texts at once on NumPy arrays inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), U(base))
        steps[0] = U(1)
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of other than ASCII white space, A-Z lower-cased) of all ``texts`` one after another,
    and the index of each text's first word, with their number at the end."""
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    space = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U), np.cumsum((buf.astype(U) + U(1)) * powers(BASE, len(buf)))))
        h = (sums[ends] - sums[starts]) * powers(INVERSE, len(buf))[starts]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return mix(h + (ends - starts).astype(U)), np.searchsorted(starts, offsets)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` words; of all its words if they are fewer."""
    h, first = word_hashes(texts)
    n = max(0, len(h) - k + 1)
    with np.errstate(over="ignore"):
        s = np.zeros(n, U)
        for j in range(k):
            s = s * U(BASE) + h[j : j + n]
    s = mix(s)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            whole = U(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = whole * U(BASE) + x
            out.append(mix(np.array([whole], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def batches(texts, most: int = 1 << 20, length=len):
    """Slices of ``texts`` of about ``most`` bytes each."""
    a = size = i = 0
    for i, t in enumerate(texts):
        n = length(t) + 1
        if size and size + n > most:
            yield slice(a, i)
            a, size = i, 0
        size += n
    if size:
        yield slice(a, i + 1)
