"""A Bloom filter of bounded size over 64-bit keys of a table.

It only ever spares work: what passes is checked again by whoever asks, so a filter that is too full lets more through
but loses nothing. It has 16 bits for each key and at most ``most_bits``, whatever the number of keys, and that is
all that reaches the driver and the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.arrowtext import column
from cartolith.llm.flatwords import mix
from cartolith.llm.workers import tidy

CHUNKS_LOG = 6


class KeyFilter:
    def __init__(self, bits: np.ndarray, log: int) -> None:
        self.bits, self.log = bits, log

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in places(keys, self.log):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def places(keys: np.ndarray, log: int) -> list[np.ndarray]:
    """Two bits for each key, both in the chunk that the key's first mix names."""
    h = mix(keys.astype(np.uint64))
    inner = np.uint64(log - CHUNKS_LOG)
    chunk = (h >> np.uint64(64 - CHUNKS_LOG)) << inner
    mask = (np.uint64(1) << inner) - np.uint64(1)
    return [chunk | (h & mask), chunk | (mix(h + np.uint64(0x9E3779B97F4A7C15)) & mask)]


def build(keys: DataFrame, name: str, most_bits: int = 1 << 28) -> KeyFilter:
    """Each partition's keys, sorted by chunk, fill one chunk after the other; chunks of all partitions are or-ed on the executors."""
    count = keys.count()
    log = int(np.clip(int(16 * max(count, 1) - 1).bit_length(), 16, most_bits.bit_length() - 1))
    step = 1 << (log - CHUNKS_LOG - 3)
    pieces = 1 << max(0, log - CHUNKS_LOG - 3 - 16)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (log - 3), np.uint8)
        for b in batches:
            for at in places(column(b, "key").to_numpy().view(np.uint64), log):
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        size = step // pieces
        for n in range(len(bits) // size):
            own = bits[n * size : (n + 1) * size]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([pa.compress(own.tobytes(), "zstd", asbytes=True)], pa.binary())], ["n", "bits"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(step // pieces, np.uint8)
        for b in batches:
            for x in column(b, "bits").to_pylist():
                total |= np.frombuffer(pa.decompress(x, len(total), "zstd", asbytes=True), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["n", "bits"])

    own = keys.select(F.col(name).cast("long").alias("key")).where("key is not null")
    rows = own.mapInArrow(run, "n int, bits binary").groupBy("n").applyInArrow(merge, "n int, bits binary").collect()
    bits = np.zeros(1 << (log - 3), np.uint8)
    size = step // pieces
    for r in rows:
        bits[r.n * size : (r.n + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return KeyFilter(bits, log)
