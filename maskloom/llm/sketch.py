"""Counting sketches and bitmaps: one for each task, merged in a tree, returned at a fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICES = 32
FAN_IN = 32
LISTED_SLICES = 256
SCHEMA = "part long, slice int, body binary"


def slots(h: np.ndarray, width: int, row: int = 0) -> np.ndarray:
    """Cells of hashes in row ``row`` of a sketch; width is a power of two."""
    from maskloom.llm.words import mix

    return (mix(h + np.uint64((0xA0761D6478BD642F * (row + 1)) % 2**64)) & np.uint64(width - 1)).astype(np.int64)


def width_for(items: int, least: int = 1 << 16, most: int = 1 << 24) -> int:
    """A power of two of at least ``items`` cells within bounds; more items only make estimates larger."""
    return min(most, max(least, 1 << max(0, int(items) - 1).bit_length()))


def add(table: np.ndarray, at: np.ndarray) -> None:
    """Count cells, saturating at the counters' largest value."""
    if not len(at):
        return
    most = np.iinfo(table.dtype).max
    if len(at) * 8 < len(table):
        at, n = np.unique(at, return_counts=True)
        table[at] = np.minimum(table[at].astype(np.int64) + n, most)
    else:
        n = np.bincount(at, minlength=len(table))
        np.minimum(n + table, most, out=n)
        table[:] = n


def _packed(table: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    cut = np.array_split(table, SLICES)
    filled = [(k, c) for k, c in enumerate(cut) if c.any()]
    if filled:
        yield pa.record_batch({
            "part": pa.array([part] * len(filled), pa.int64()),
            "slice": pa.array([k for k, _ in filled], pa.int32()),
            "body": pa.array([pa.compress(c.tobytes(), codec="zstd", asbytes=True) for _, c in filled], pa.binary()),
        })


def counted(cells: int, fill: Callable[[np.ndarray, pa.RecordBatch], None], kind: type = np.uint8) -> Callable:
    """For mapInArrow: one sketch of ``cells`` counters for the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, kind)
        for batch in batches:
            fill(table, batch)
        yield from _packed(table, TaskContext.get().partitionId())

    return run


def merged(parts: DataFrame, cells: int, kind: type = np.uint8) -> np.ndarray:
    """Sum of the tasks' sketches, saturating, ``FAN_IN`` at a time.

    Saturating sums do not depend on their order, so neither a retried task nor the shape of the tree
    shows. A group holds at most FAN_IN slices; the driver gets SLICES rows.
    """
    sizes = [len(c) for c in np.array_split(np.empty(cells, np.uint8), SLICES)]
    wide, most = np.dtype(kind).itemsize, np.iinfo(kind).max

    def add_up(table: pa.Table) -> pa.Table:
        k = table["slice"][0].as_py()
        total = np.zeros(sizes[k], np.int64)
        for body in table["body"]:
            total += np.frombuffer(pa.decompress(body.as_buffer(), decompressed_size=sizes[k] * wide, codec="zstd"), kind)
        body = pa.compress(np.minimum(total, most).astype(kind).tobytes(), codec="zstd", asbytes=True)
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int64()), "slice": pa.array([k], pa.int32()), "body": pa.array([body], pa.binary())})

    left = parts.rdd.getNumPartitions()
    while True:
        parts = parts.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("to")).applyInArrow(add_up, SCHEMA)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    out = [np.zeros(n, kind) for n in sizes]
    for r in parts.collect():
        out[r["slice"]] = np.frombuffer(pa.decompress(r["body"], decompressed_size=sizes[r["slice"]] * wide, codec="zstd"), kind)
    return np.concatenate(out)


def _sparse(at: np.ndarray, n: np.ndarray, width: int, part: int) -> Iterator[pa.RecordBatch]:
    """Sorted cells and their counts, in slices of ``width`` cells: gaps and counts, compressed."""
    bounds = np.flatnonzero(np.diff(at // width, prepend=-1)) if len(at) else np.zeros(0, np.int64)
    ends = np.append(bounds[1:], len(at))
    rows = []
    for a, b in zip(bounds.tolist(), ends.tolist(), strict=False):
        k = int(at[a]) // width
        gaps = np.diff(at[a:b] - k * width, prepend=0).astype(np.uint32)
        body = pa.compress(gaps.tobytes() + np.minimum(n[a:b], 255).astype(np.uint8).tobytes(), codec="zstd", asbytes=True)
        rows.append((k, (b - a).to_bytes(4, "little") + body))
    if rows:
        yield pa.record_batch({"part": pa.array([part] * len(rows), pa.int64()), "slice": pa.array([k for k, _ in rows], pa.int32()), "body": pa.array([x for _, x in rows], pa.binary())})


def slice_width(cells: int) -> int:
    """Cells in a slice of a listed sketch: whole bytes of bits."""
    return -(-cells // (8 * LISTED_SLICES)) * 8


def listed(cells: int, each: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Callable:
    """For mapInArrow: a sketch of ``cells`` counters that only holds the cells that the task's rows touch."""
    width = slice_width(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new: list[np.ndarray] = []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([at, *new])
            weight = np.concatenate([n, np.ones(len(every) - len(at), np.int64)])
            cell, which = np.unique(every, return_inverse=True)
            return cell, np.bincount(which, weight, minlength=len(cell)).astype(np.int64)

        for batch in batches:
            new += each(batch)
            if sum(map(len, new)) > 1 << 20:
                at, n = fold()
                new = []
        at, n = fold()
        yield from _sparse(at, n, width, TaskContext.get().partitionId())

    return run


def repeated_bits(parts: DataFrame, cells: int, least: int = 2) -> np.ndarray:
    """Packed bits (little-endian) of the cells whose counts, over all tasks, reach ``least``.

    Merged FAN_IN slices at a time like ``merged``; the driver gets one bit for each cell.
    """
    width = slice_width(cells)

    def add_up(last: bool) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            k, total = table["slice"][0].as_py(), np.zeros(width, np.uint8)
            for body in table["body"]:
                raw = body.as_buffer()
                size = int.from_bytes(raw[:4].to_pybytes(), "little")
                flat = np.frombuffer(pa.decompress(raw[4:], decompressed_size=5 * size, codec="zstd"), np.uint8)
                at = np.cumsum(flat[: 4 * size].copy().view(np.uint32).astype(np.int64))
                total[at] = np.minimum(total[at].astype(np.int64) + flat[4 * size :], 255)
            part = table["part"][0].as_py() // FAN_IN
            if last:
                packed = pa.compress(np.packbits(total >= least, bitorder="little").tobytes(), codec="zstd", asbytes=True)
                return pa.table({"part": pa.array([part], pa.int64()), "slice": pa.array([k], pa.int32()), "body": pa.array([packed], pa.binary())})
            at = np.flatnonzero(total)
            (batch,) = _sparse(at + k * width, total[at], width, part)
            return pa.Table.from_batches([batch])

        return run

    left = parts.rdd.getNumPartitions()
    while True:
        left = -(-left // FAN_IN)
        parts = parts.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("to")).applyInArrow(add_up(left <= 1), SCHEMA)
        if left <= 1:
            break
    out = np.zeros(-(-cells // width) * width // 8, np.uint8)
    for r in parts.collect():
        bits = np.frombuffer(pa.decompress(r["body"], decompressed_size=width // 8, codec="zstd"), np.uint8)
        out[r["slice"] * width // 8 : r["slice"] * width // 8 + len(bits)] = bits
    return out[: -(-cells // 8)]


#: Cells tested for a key, and cells a key at which a bitmap is made.
PROBES, ROOM = 3, 16


def bits_at(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """True where the cell's bit is set, of packed bits (little-endian)."""
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0


def bitmap(keys: DataFrame, column: str, expected: int, most: int = 1 << 30) -> Broadcast:
    """A Bloom filter of a long column, as packed bits: false only for values that are not in it.

    It has ``ROOM`` bits for each of ``expected`` keys (about one other value in 200 passes), up to
    ``most`` bits; with more keys more values pass. Tasks list the cells that they touch, so only the
    finished filter has this size.
    """
    spark: SparkSession = keys.sparkSession
    width = width_for(ROOM * expected, 1 << 12, most)

    def cells(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        h = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        for k in range(PROBES):
            yield slots(h, width, k)

    return spark.sparkContext.broadcast(repeated_bits(keys.select(column).mapInArrow(listed(width, cells), SCHEMA), width, 1))


def flagged(bits: np.ndarray, keys: pa.Array) -> np.ndarray:
    """True for keys that may be in a ``bitmap``."""
    h = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    width = 8 * len(bits)
    keep = bits_at(bits, slots(h, width, 0))
    for k in range(1, PROBES):
        left = np.flatnonzero(keep)
        keep[left] = bits_at(bits, slots(h[left], width, k))
    return keep
