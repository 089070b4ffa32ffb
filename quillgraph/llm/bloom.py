"""Bloom filters of the 64-bit hashes that occur more than once, built by partition and merged in a tree."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BITS = 1 << 20
PROBES = 3
FAN_IN = 32
STATE = "part int, chunk int, once binary, twice binary"


def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """PROBES bit positions of each hash, by double hashing of its halves."""
    h = h.astype(np.int64).view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)]


def _has(filter_: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    hit = np.ones(len(at[0]), dtype=bool)
    for p in at:
        hit &= (filter_[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return hit


def _add(filter_: np.ndarray, at: list[np.ndarray]) -> None:
    for p in at:
        np.bitwise_or.at(filter_, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))


def _partial(bits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h, n = np.unique(batch.iloc[:, 0].to_numpy(np.int64), return_counts=True)
            at = positions(h, bits)
            again = _has(once, at) | (n > 1)
            _add(twice, [p[again] for p in at])
            _add(once, at)
        step = min(CHUNK_BITS, bits) // 8
        for k in range(len(once) // step):
            part = once[k * step : (k + 1) * step]
            if part.any():
                yield pd.DataFrame(
                    {
                        "part": [TaskContext.get().partitionId()],
                        "chunk": [k],
                        "once": [zlib.compress(part.tobytes(), 1)],
                        "twice": [zlib.compress(twice[k * step : (k + 1) * step].tobytes(), 1)],
                    }
                )

    return build


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """What several parts saw once each was seen twice."""
    once = twice = None
    for o, t in zip(group.once, group.twice):
        o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
        once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
    first = group.iloc[0]
    return pd.DataFrame({"part": [first.part // FAN_IN], "chunk": [first.chunk], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})


def filter_bits(keys: int, per_key: int, most: int) -> int:
    """A power of two of at least ``per_key`` bits for each key, at most ``most``."""
    bits = 1 << 13
    while bits < min(keys * per_key, most):
        bits <<= 1
    return bits


def repeat_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The merged filter of hashes seen repeatedly in the one bigint column of ``hashes``: ``bits`` / 8 bytes.

    Each partition keeps a filter of what it saw once and one of what it saw again; merging in a tree of FAN_IN parts
    also takes over what two parts saw once each. No repeated hash is missed; others may pass by chance.
    """
    parts = hashes.rdd.getNumPartitions()
    state = hashes.mapInPandas(_partial(bits), STATE)
    while parts > 1:
        state = state.groupBy(F.col("chunk"), F.floor(F.col("part") / FAN_IN)).applyInPandas(_merge, STATE)
        parts = -(-parts // FAN_IN)
    step = min(CHUNK_BITS, bits) // 8
    merged = np.zeros(bits // 8, np.uint8)
    for row in state.select("chunk", "twice").toLocalIterator():
        merged[row.chunk * step : (row.chunk + 1) * step] |= np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint8)
    return merged


@contextmanager
def may_repeat(hashes: DataFrame, bits: int) -> Iterator[Callable[[Column], Column]]:
    """A test for columns of hashes: false only for hashes that occur once in ``hashes``.

    The filter that goes to the executors has ``bits`` bits; it is dropped there at the end of the context.
    """
    sent = hashes.sparkSession.sparkContext.broadcast(zlib.compress(repeat_filter(hashes, bits).tobytes(), 1))
    kept: dict[str, np.ndarray] = {}

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        if "f" not in kept:
            kept["f"] = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        return pd.Series(_has(kept["f"], positions(h.to_numpy(np.int64), bits)))

    yield test
    sent.unpersist()
