"""Blocked Bloom filter: 256-bit blocks of 8 words, one bit set in each word; of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the most blocks (32 MB, for 16 million keys). A longer list makes the filter pass more, never less.
BITS_A_KEY, MAX_BLOCKS = 16, 1 << 20


def masks(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the 8 one-bit words of each 64-bit hash."""
    u = h.view(np.uint64)
    block = ((u >> np.uint64(32)) & np.uint64(blocks - 1)).astype(np.int64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    words = np.empty((len(u), 8), np.uint32)
    for k in range(8):
        x = (u ^ np.uint64(k * 0x1000193)) * (odd + np.uint64(2 * k))
        words[:, k] = np.uint32(1) << (x >> np.uint64(59)).astype(np.uint32)
    return block, words


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold; none that it holds is missed."""
    block, words = masks(h, len(table))
    return ((table[block] & words) == words).all(axis=1)


def build(hashes: DataFrame) -> np.ndarray:
    """The filter of a one-column frame of longs: tasks fill parts, Spark joins them by bit_or, a row a block."""
    n = hashes.count()
    blocks = 1
    while blocks * 256 < BITS_A_KEY * n and blocks < MAX_BLOCKS:
        blocks *= 2
    names = [f"w{k}" for k in range(8)]

    def fill(batches):
        part = np.zeros((blocks, 8), np.uint32)
        for b in batches:
            block, words = masks(b.column(0).to_numpy(zero_copy_only=False), blocks)
            np.bitwise_or.at(part, block, words)
        used = np.flatnonzero(part.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(part[used, k].astype(np.int64)) for k in range(8)]], names=["block", *names])

    parts = hashes.mapInArrow(fill, "block bigint, " + ", ".join(f"{k} bigint" for k in names))
    table = parts.groupBy("block").agg(*[F.bit_or(k).alias(k) for k in names]).toArrow()
    out = np.zeros((blocks, 8), np.uint32)
    if table.num_rows:
        out[table["block"].to_numpy()] = np.stack([table[k].to_numpy() for k in names], axis=1).astype(np.uint32)
    return out
