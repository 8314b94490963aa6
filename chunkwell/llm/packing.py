"""Best-fit packing of token sequences, hierarchical.

Each partition tokenizes its documents, cuts those longer than the capacity and packs its pieces best-fit in
order of falling length. Bins that are nearly full are done. Those that are not go up as items: they are dealt
into groups of bounded size, each packed best-fit again, round after round, until a round joins hardly any.
A piece's place is its place in its bin plus that bin's place in the bin above, so only (bin, length) pairs move.

Of pieces of equal length those come first that arrive first, and of equally full bins the one last added to: the
sequences depend on how rows are dealt over partitions, the pieces do not.

Null and empty texts have the end token alone. Repeated rows are packed each for itself. A piece is never cut
again. Extra columns are not carried: the result is keyed by doc_id (which may be null) and piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import bounded_batches, cut, text_or_empty

#: Pieces of a partition that are packed together; the underfull bins of all meet in the rounds.
PIECES_AT_ONCE = 1 << 17
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit by falling size: the bin and the offset of each item, and the fill of each bin."""
    order = np.argsort(-sizes, kind="stable").tolist()
    sizes = sizes.tolist()
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # a bit for each amount of room that some bin has
    for k in order:
        size = sizes[k]
        open_rooms = rooms >> size
        if open_rooms:
            room = size + (open_rooms & -open_rooms).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return np.array(bins, dtype=np.int64), np.array(offsets, dtype=np.int64), np.array(fills, dtype=np.int64)


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; all but the first have the full capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def local_pieces(df: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    bounded_batches(df.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        vocab, base, rows = bpe.vocabulary(path), TaskContext.get().partitionId() << 36, [[], [], [], [], []]

        def packed():
            nonlocal base
            bins, offsets, fills = best_fit(np.array(rows[3], dtype=np.int64), capacity)
            columns = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(bins + base), pa.array(offsets), pa.array(fills[bins])], names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])
            base += len(fills)
            for column in rows:
                column.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(vocab.encode_bytes(text) + end)
                for k, (start, length) in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    for column, value in zip(rows, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        column.append(value)
            if len(rows[3]) >= PIECES_AT_ONCE:
                yield packed()
        yield packed()

    return df.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def merge_round(items: DataFrame, groups: int, capacity: int, round_no: int) -> DataFrame:
    """Packs the items (bin, fill) of each of so many groups: bin, above, shift, fill of the bin above."""

    def run(batches):
        bins, fills = [], []
        for batch in batches:
            bins.append(batch.column(0).to_numpy())
            fills.append(batch.column(1).to_numpy())
        bins = np.concatenate(bins) if bins else np.zeros(0, dtype=np.int64)
        fills = np.concatenate(fills) if fills else np.zeros(0, dtype=np.int64)
        order = np.argsort(bins, kind="stable")  # the order in which rows arrive doesn't matter
        bins, fills = bins[order], fills[order]
        at, shift, total = best_fit(fills, capacity)
        base = (round_no << 58) | (TaskContext.get().partitionId() << 36)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(at + base), pa.array(shift), pa.array(total[at])], names=["bin", "above", "shift", "fill"])

    return items.repartition(groups, F.xxhash64("bin")).mapInArrow(run, "bin long, above long, shift long, fill long")


def pack(df: DataFrame, capacity: int = 1024, path: str | None = None, end_id: int = 2, nearly_full: float = 0.99, group_items: int = 50_000, least_gain: float = 0.002, rounds: int = 16) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, fill.

    group_items bounds the items of one task of a merging round; least_gain is the part of the underfull bins
    that a round must save for another one to follow; at most 31 rounds.
    """
    pieces = cut(local_pieces(df, path or bpe.default_path(), capacity, end_id))
    full = int(nearly_full * capacity)
    # bins that go up: each has one piece at offset 0
    items = pieces.filter((F.col("offset") == 0) & (F.col("fill") < full)).select("bin", "fill")
    place = None
    n = items.count()
    for round_no in range(1, min(rounds, 31) + 1):
        if n < 2:
            break
        step = cut(merge_round(items, -(-n // group_items), capacity, round_no))
        place = step if place is None else cut(
            place.alias("a").join(step.alias("b"), F.col("a.above") == F.col("b.bin"), "left").select(
                "a.bin", F.coalesce("b.above", "a.above").alias("above"), (F.col("a.shift") + F.coalesce("b.shift", F.lit(0))).alias("shift"), F.coalesce("b.fill", "a.fill").alias("fill")
            )
        )
        items = step.filter((F.col("shift") == 0) & (F.col("fill") < full)).select(F.col("above").alias("bin"), "fill")
        made = step.filter("shift = 0").count()
        left = items.count()
        if n <= group_items or n - made < least_gain * n:
            break
        n = left
    if place is None:
        return pieces.withColumnRenamed("bin", "sequence_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill")
    p, q = pieces.alias("p"), place.alias("q")
    return p.join(q, F.col("p.bin") == F.col("q.bin"), "left").select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32",
        F.coalesce("q.above", "p.bin").alias("sequence_id"), (F.col("p.offset") + F.coalesce("q.shift", F.lit(0))).alias("offset"), F.coalesce("q.fill", "p.fill").alias("fill"),
    )
