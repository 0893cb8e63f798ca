"""Blocked Bloom filters, built by Spark and probed on NumPy arrays inside tasks.

A block has 512 bits in eight lanes of 64; a hash sets one bit in each lane of one block, so a probe touches one block.
Filters are built from (shard, hash) rows as partial blocks, joined by bit_or, and only whole blocks reach the driver: their
bytes are set by the caller and don't grow beyond that, whatever is put in; a fuller filter lets more false positives
through and never loses a true one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, mix

LANES, BLOCK_BYTES = 8, 64
#: Keys for a block, at which one probe in 2,000 is a false positive.
PER_BLOCK = 32
ROWS = "shard int, block int, " + ", ".join(f"w{i} bigint" for i in range(LANES))


def placed(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash among ``blocks``, and the bits from which its places in the lanes are taken."""
    h = mix(h)
    return ((h >> U(32)) * U(blocks) >> U(32)).astype(np.int64), mix(h ^ U(0x5851F42D4C957F2D))


def _bit(g: np.ndarray, lane: int) -> np.ndarray:
    return (g >> U(6 * lane)) & U(63)


def partial(shard: np.ndarray, h: np.ndarray, blocks: dict[int, int]) -> pa.RecordBatch:
    """Rows of blocks that hold the hashes of each shard, one for each block touched."""
    out = []
    for s in np.unique(shard):
        at, g = placed(h[shard == s], blocks[int(s)])
        order = np.argsort(at, kind="stable")
        at, g = at[order], g[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        words = [np.bitwise_or.reduceat(U(1) << _bit(g, i), first).view(np.int64) for i in range(LANES)]
        out.append((np.full(len(first), s), at[first], *words))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * (2 + LANES)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if i < 2 else np.int64)) for i, c in enumerate(columns)], [f.split()[0] for f in ROWS.split(", ")])


def built(rows: DataFrame, hashed: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], blocks: dict[int, int]) -> dict[int, np.ndarray]:
    """The filter of each shard, (blocks, LANES) words. hashed: (shard, hash) of a batch of ``rows``; those of a shard that
    ``blocks`` lacks are left out. What is collected is ``sum(blocks.values()) * BLOCK_BYTES`` at most."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            shard, h = hashed(part)
            have = np.isin(shard, list(blocks))
            yield partial(shard[have], h[have], blocks)

    words = [f"w{i}" for i in range(LANES)]
    got = rows.mapInArrow(run, ROWS).groupBy("shard", "block").agg(*[F.bit_or(w).alias(w) for w in words]).toArrow()
    shard, block = got["shard"].to_numpy(), got["block"].to_numpy()
    filled = np.stack([got[w].to_numpy() for w in words], 1).view(np.uint64) if len(got) else np.zeros((0, LANES), U)
    out = {}
    for s, n in blocks.items():
        out[s] = np.zeros((n, LANES), U)
        out[s][block[shard == s]] = filled[shard == s]
    return out


def found(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes that may be in the filter; lanes are looked at one after another, for what is left."""
    at, g = placed(h, len(table))
    left = np.arange(len(h))
    for i in range(LANES):
        left = left[((table[at[left], i] >> _bit(g[left], i)) & U(1)).astype(bool)]
    return left
