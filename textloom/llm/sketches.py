"""Count-min sketches and Bloom filters over 64-bit hashes, built by tasks and merged.

A sketch keeps two bits a slot, as two planes: seen at least once, and at least
twice.  Every input partition makes one sketch, and sends its blocks packed, so
that a partition sends about as much as it set bits.  Sketches merge with bit
operations, block by block in two steps, so no task holds more than one block of
many sketches.  Estimates never fall below the true count (up to two).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .windows import U64, mix

ROWS = 2
_BLOCK = 1 << 16  # bytes
_MERGE_WAYS = 64


class Sketch:
    """Counts up to two in ``ROWS`` rows of ``2**bits`` slots, two bits a slot."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros((2, ROWS, (1 << bits) // 8), dtype=np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for r in range(ROWS):
            slot = np.sort(slots(hashes, r, self.bits))
            new = np.ones(len(slot), dtype=bool)
            new[1:] = slot[1:] != slot[:-1]
            _set(self.twice[r], np.unique(slot[~new]))
            slot = slot[new]
            _set(self.twice[r], slot[(self.once[r, slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1])
            _set(self.once[r], slot)

    def blocks(self) -> Iterator[pd.DataFrame]:
        for r in range(ROWS):
            planes = [self.once[r].tobytes(), self.twice[r].tobytes()]
            at = range(0, len(planes[0]), _BLOCK)
            on = [i for i, lo in enumerate(at) if self.once[r, lo : lo + _BLOCK].any()]
            packed = [[zlib.compress(p[at[i] : at[i] + _BLOCK], 1) for i in on] for p in planes]
            yield pd.DataFrame({"block": [r * len(at) + i for i in on], "once": packed[0], "twice": packed[1]})


def _set(plane: np.ndarray, slot: np.ndarray) -> None:
    """Set the bits of sorted slots."""
    if len(slot):
        byte = slot >> 3
        begin = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        plane[byte[begin]] |= np.bitwise_or.reduceat(np.uint8(128) >> (slot & 7).astype(np.uint8), begin)


def slots(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes, 31 + row) >> U64(64 - bits)).astype(np.int64)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once = twice = None
    for a, b in zip(pdf["once"], pdf["twice"]):
        a, b = np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})


_SCHEMA = "block int, once binary, twice binary"


def build(df: DataFrame, hashes: Callable[[Iterator[pd.DataFrame]], Iterator[np.ndarray]], bits: int, plane: str) -> np.ndarray:
    """One merged plane (``once`` or ``twice``) of ``ROWS x 2**bits / 8`` bytes.

    ``hashes`` turns a task's batches into hash arrays.  A task builds one sketch
    of ``ROWS * 2**bits / 4`` bytes; only the asked plane of the merged one reaches
    the driver, packed.
    """

    def task(batches):
        sketch = Sketch(bits)
        for h in hashes(batches):
            if len(h):
                sketch.add(h)
        yield from sketch.blocks()

    # Each group holds the like block of at most (tasks / ways), then ways, sketches.
    parts = df.mapInPandas(task, _SCHEMA).withColumn("way", F.spark_partition_id() % _MERGE_WAYS)
    some = parts.groupBy("block", "way").applyInPandas(lambda _, p: _merge(p), _SCHEMA)
    merged = np.zeros(ROWS * (1 << bits) // 8, np.uint8)
    per_row = -(-((1 << bits) // 8) // _BLOCK)
    for row in some.groupBy("block").applyInPandas(_merge, _SCHEMA).select("block", plane).collect():
        lo = row["block"] // per_row * ((1 << bits) // 8) + row["block"] % per_row * _BLOCK
        got = np.frombuffer(zlib.decompress(row[plane]), np.uint8)
        merged[lo : lo + len(got)] = got
    return merged


def test(plane: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether all of a hash's bits are set in a plane."""
    out = np.ones(len(hashes), dtype=bool)
    for r in range(ROWS):
        at = slots(hashes, r, bits) + r * (1 << bits)
        out &= (plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def fitting_bits(items: float, least: int, most: int) -> int:
    """Slots for about two a item, within ``2**least`` to ``2**most``."""
    return int(np.clip(np.ceil(np.log2(max(items, 1) * 2)), least, most))


def broadcast(spark: SparkSession, plane: np.ndarray):
    return spark.sparkContext.broadcast(plane)
