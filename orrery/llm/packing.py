"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Best fit decreasing depends on the lengths alone. The plan is therefore made once, on the driver, from
the counts of each length (at most `capacity` numbers): open bins with the same room form runs, a segment
tree over the rooms gives the tightest one that fits in logarithmic time, and all documents of one length
go in together, run by run, just as one by one. Each run says which ranks of a length go to which
sequences at which offset. Ranks come from windows over (length, shard); no task holds a whole length.

Nulls: a null text is empty and still has its end id; a null id is ordinary. Repeated rows are packed
each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import staged
from .tokens import forget, token_ids


class RoomTree:
    """Segment tree over rooms 0..n: how many runs of open bins have each room."""

    def __init__(self, n: int) -> None:
        self.base = 1 << n.bit_length()
        self.sum = [0] * (2 * self.base)

    def add(self, room: int, by: int) -> None:
        at = self.base + room
        while at:
            self.sum[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least need that some bin has."""
        at = self.base + need
        if self.sum[at]:
            return need
        while at > 1:
            if not at & 1 and self.sum[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.sum[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset): rank r of a length goes to sequence first + r - first rank."""
    tree, runs, made = RoomTree(capacity), [], 0
    open_: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, n, room = made, -(-left // each), capacity
                made += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -1)
            each = room // length
            full = min(n, left // each)
            for k in range(each if full else 0):
                runs.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            left -= full * each
            put(room - each * length, first, full)
            first, n = first + full, n - full
            if n and 0 < left < each:
                for k in range(left):
                    runs.append((length, rank + k, 1, first, capacity - room + k * length))
                rank += left
                put(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            if room < capacity:
                put(room, first, n)
    return runs


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", style: str = "byte", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """id, piece, start, length, ids_crc32: whole documents, or pieces of capacity of which the first may be shorter."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the worker outlives the task, often idle beside later stages: the memo goes with the task
        try:
            for part, ids, ends in token_ids(tokenizer, style).of_batches(batches):
                n = part.num_rows
                data = memoryview(np.insert(ids, ends, end_id).astype("<u4").tobytes())
                size = np.diff(ends, prepend=0) + 1
                many = -(-size // capacity)
                row = np.repeat(np.arange(n), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                head = np.where(size % capacity, size % capacity, capacity)[row]
                start = np.where(piece, head + (piece - 1) * capacity, 0)
                length = np.where(piece, capacity, head)
                at = 4 * (start + np.repeat(np.cumsum(size) - size, many))
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            forget()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, *, capacity: int = 1024, shard_rows: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to pieces(); at most capacity counts come to the driver."""
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shards = max(1, -(-max(counts.values(), default=0) // shard_rows))
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = cut.withColumn("_shard", F.pmod(F.xxhash64(*fields), F.lit(shards)))
    sizes = dealt.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    first = sizes.select(F.col("length").alias("_l"), F.col("_shard").alias("_h"), before.alias("_before"))
    in_shard = F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("_in", in_shard).join(first, (F.col("length") == F.col("_l")) & (F.col("_shard") == F.col("_h"))).select(*fields, (F.col("_in") + F.col("_before")).alias("_rank"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    wide = (runs[:, 0] << 44) | runs[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(wide, (length << 44) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])], [*fields, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, **how) -> DataFrame:
    """One row per piece with its place."""
    return place(staged(pieces(docs, tokenizer, capacity=capacity, **how), "pieces"), capacity=capacity)
