"""Blocked Bloom filters over 64-bit hashes, filled by Spark tasks and tested in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of one block; a hash touches a single block.
BLOCK_SLOTS = 1 << 16
#: Slots a hash sets in its block.
PROBES = 3
#: Rows in which a task sends its slots, at most; hashes that it holds before it sends them.
GROUPS, HELD_HASHES = 256, 1_000_000
#: 65,536 blocks are the most that the upper 16 bits of a hash can name.
MOST_BLOCKS = 1 << 16


def blocks_for(keys: int, slots_per_key: int = 16, most_bytes: int = 64 << 20) -> int:
    """Blocks (a power of two) for ``keys`` hashes, never over ``most_bytes``."""
    wanted = max(1, -(-keys * slots_per_key // BLOCK_SLOTS))
    most = min(MOST_BLOCKS, max(1, most_bytes * 8 // BLOCK_SLOTS))
    return min(1 << (wanted - 1).bit_length(), 1 << (most.bit_length() - 1))


def locate(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its ``PROBES`` slots in that block."""
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes.astype(np.uint64)
    block = (h >> np.uint64(48)) & np.uint64(blocks - 1)
    slots = np.stack([(h >> np.uint64(16 * i)) & np.uint64(0xFFFF) for i in range(PROBES)], axis=1)
    return block.astype(np.int64), slots.astype(np.uint16)


def join_blocks(rows: list[tuple[int, bytes]], blocks: int) -> bytes:
    """One filter from its non-empty blocks."""
    filled = bytearray(blocks * BLOCK_SLOTS // 8)
    for block, bits in rows:
        start = block * BLOCK_SLOTS // 8
        filled[start:start + len(bits)] = bits
    return bytes(filled)


def contains(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have all their slots set."""
    table = np.frombuffer(bits, dtype=np.uint8)
    block, slots = locate(hashes, len(bits) * 8 // BLOCK_SLOTS)
    at = block[:, None] * BLOCK_SLOTS + slots
    return ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def _slots(blocks: int, most: int):
    each = -(-blocks // GROUPS)  # blocks that share a row and a task

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        # More than ``most`` of a hash within one task say no more than that many.
        hashes, times = np.unique(np.concatenate(held), return_counts=True)
        block, slots = locate(np.repeat(hashes, np.minimum(times, most)), blocks)
        order = np.argsort(block, kind="stable")
        slots, sizes = slots[order], np.bincount(block, minlength=each * GROUPS).astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(sizes.reshape(-1, each).sum(axis=1))]).astype(np.int64)
        named = np.flatnonzero(np.diff(ends))
        return pa.RecordBatch.from_arrays(
            [pa.array(named, pa.int32()), pa.array([sizes[g * each:(g + 1) * each].tobytes() for g in named], pa.binary()),
             pa.array([slots[ends[g]:ends[g + 1]].tobytes() for g in named], pa.binary())], names=["part", "sizes", "slots"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= HELD_HASHES:
                yield rows(held)
                held = []
        if held:
            yield rows(held)
    return emit


def _filled(blocks: int, times: int):
    each = -(-blocks // GROUPS)

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        positions = []
        for sizes, slots in zip(table.column("sizes").to_pylist(), table.column("slots").to_pylist()):
            of = np.repeat(np.arange(each), np.frombuffer(sizes, np.uint32) * PROBES)
            positions.append(of * BLOCK_SLOTS + np.frombuffer(slots, np.uint16))
        kept = np.bincount(np.concatenate(positions), minlength=each * BLOCK_SLOTS) >= times
        bits = np.packbits(kept).reshape(each, -1)
        found = [i for i in range(each) if bits[i].any()]
        return pa.table({"block": pa.array([part * each + i for i in found], pa.int32()),
                         "bits": pa.array([bits[i].tobytes() for i in found], pa.binary())})
    return merge


def build(hashes: DataFrame, column: str, rows: int, times: int = 1, most_bytes: int = 64 << 20) -> bytes:
    """The filter of the slots that at least ``times`` rows set (1 or 2).

    Each task sends the slots of its hashes, two bytes each, to the tasks of their blocks. With
    ``times`` 2 a hash that occurs twice has all its slots kept, one that occurs once has not unless
    others fill them. The filter, which the driver holds, grows with the rows up to ``most_bytes`` (64 MB);
    beyond, it lets more hashes through, but never loses one. At 16 slots a row about 0.5 % pass wrongly.
    """
    blocks = blocks_for(rows, most_bytes=most_bytes)
    sent = hashes.select(F.col(column)).mapInArrow(_slots(blocks, times), "part int, sizes binary, slots binary")
    kept = sent.groupBy("part").applyInArrow(_filled(blocks, times), "block int, bits binary")
    return join_blocks([(r.block, r.bits) for r in kept.collect()], blocks)


def test(spark: SparkSession, hashes: Column, bits: bytes) -> Column:
    """Whether a hash may be in the filter, as a column."""
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def possible(values: pa.Array) -> pa.Array:
        return pa.array(contains(shared.value, values.to_numpy(zero_copy_only=False)))

    return possible(hashes)
