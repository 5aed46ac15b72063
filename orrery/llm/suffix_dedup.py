"""Exact substring dedup across documents by prefix-free parsing.

Documents are written once as slices of about SLICE bytes, in a table bucketed by groups of slices, so every
later step meets a slice's text where it lies; only notes about slices travel.

Parse. A window of `length` bytes whose rolling hash is small is a trigger; a phrase runs from one trigger
through the next one, so neighbours share a trigger and every string of `length` bytes lies whole in some
phrase. The parse is one row a distinct phrase of a slice, named by a 128-bit digest, with its occurrences
there. The dictionary is the distinct phrases, each at the document with the smallest id that has it; an
occurrence in a later document is removed as a whole. Copies of documents, however many, end here.

Dictionary suffixes. Comparisons end at `length` bytes and never reach past a phrase, so the dictionary's
suffix array is needed to that depth only. Its suffixes are dealt by anchors: of a string the least rolling hash of
its `piece`-byte pieces; equal strings have equal anchors, and neighbouring strings with one anchor form a
run. Each slice says which anchors it has; of those that runs of the dictionary share, the runs come
together, equal ones are put in order once, and prefix doubling gives the suffix array of the distinct ones
to the depth of `length`.

Corpus order. The parse gives every dictionary suffix its document, so a class of equal suffixes has its
first document; the suffixes of later documents are removed. Since a phrase's later occurrences are removed
already, the parse's own suffix order beyond a phrase decides nothing here, and is not built.

Hot keys. A phrase's first document is an aggregation with partial sums in the map tasks and a plain join
back. An anchor whose runs hold more than `crowd` bytes forms no group: its strings go by 128-bit keys
through an aggregation and a join, which split hot keys. A run of more than PIECES strings is cut.

Nulls: a null text is empty; a row with a null id keeps all bytes and is nobody's earlier document. Rows
with equal ids do not remove from each other, so repeated rows and ties keep all they share. Texts of fewer
than `length` bytes and empty ones keep all; a long text is a slice of its own. An empty table gives an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import scratch, staged, text_slices

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240301))
_TABLES = [_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in range(2)]
_BASES = [_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)]
_BACK = [_U(pow(int(b), -1, 1 << 64)) for b in _BASES]
_power: list[tuple[np.ndarray, np.ndarray]] = []
#: Bytes of a slice, slices of a group, strings of a run, bytes that are put in suffix order at once.
SLICE, GROUP, PIECES, CHUNK = 1 << 20, 16, 256, 2 << 20
_NOTE = "gid int, sid long, part int, at long, upto long, data binary"
_LATE, _SPANS = -1, -2


def _powers(t: int) -> tuple[np.ndarray, np.ndarray]:
    if not _power:
        grow = lambda x: np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(SLICE, x, _U))])
        _power.extend((grow(b), grow(i)) for b, i in zip(_BASES, _BACK, strict=True))
    return _power[t]


def rolled(raw: np.ndarray, width: int, t: int = 0) -> np.ndarray:
    """Hashes of all pieces of width bytes, block by block."""
    n = max(0, len(raw) - width + 1)
    out, (up, back), step = np.empty(n, _U), _powers(t), SLICE - width + 1
    for lo in range(0, n, step):
        part = raw[lo : lo + step + width - 1]
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(_TABLES[t][part] * up[: len(part)], out=total[1:])
        np.multiply(total[width:] - total[:-width], back[: len(part) - width + 1], out=out[lo : lo + step])
    return out


def parse(raw: np.ndarray, bounds: np.ndarray, length: int, modulus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of every phrase; rows shorter than length have none."""
    n = len(bounds) - 1
    long = np.flatnonzero(np.diff(bounds) >= length)
    hit = np.flatnonzero(rolled(raw, length) < _U((1 << 64) // modulus))
    row = np.searchsorted(bounds, hit, "right") - 1
    hit = hit[hit + length <= bounds[row + 1]]
    start = np.unique(np.concatenate([bounds[long], hit]))
    # an empty row shares its bound with the next; the last row that begins there is the one with bytes
    row = np.searchsorted(bounds, start, "right") - 1
    after = np.append(start[1:], bounds[n])
    return start, np.where(after < bounds[row + 1], after + length, bounds[row + 1]), row


def alive(bounds: np.ndarray, length: int, usable: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Of every byte of a slice, whether a string begins there that is in a usable row and in no late phrase (start, end)."""
    edge = np.zeros(int(bounds[-1]) + 1, np.int32)
    stop = np.maximum(bounds[1:] - length + 1, bounds[:-1])
    np.add.at(edge, bounds[:-1][usable], 1)
    np.add.at(edge, stop[usable], -1)
    live = np.cumsum(edge[:-1]) > 0
    if len(late):
        edge[:] = 0
        np.add.at(edge, late[:, 0], 1)
        np.add.at(edge, late[:, 1] - length + 1, -1)
        live &= np.cumsum(edge[:-1]) == 0
    return live


def runs(raw: np.ndarray, live: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of live string starts with one anchor: first start, number, anchor."""
    h = rolled(raw, piece)
    span = length - piece + 1
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if span > width:
        h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    live = live[: len(h)]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (live[1:] != live[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(h)))
    keep = live[first]
    # least hashes crowd near zero; a multiplication spreads them over the buckets
    return first[keep], count[keep], h[first[keep]] * _U(0xC2B2AE3D27D4EB4F)


def own_anchors(anchor: np.ndarray, weight: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of a slice by bucket: (bucket, low 48 bits, weight in 64 bytes with a flag for more than one run, and each run's place)."""
    bucket = ((anchor >> _U(32)) * _U(buckets)) >> _U(32)
    order = np.lexsort((anchor & _U((1 << 48) - 1), bucket))
    b, low = bucket[order], (anchor & _U((1 << 48) - 1))[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    many = np.diff(np.append(first, len(order))) > 1
    total = np.minimum(-(-np.add.reduceat(weight[order], first) // 64), 0x7FFF) if len(first) else np.zeros(0, np.int64)
    return b[first].astype(np.int64), low[first], (total.astype(np.uint16) | (many.astype(np.uint16) << np.uint16(15))), place


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One binary value for each stretch between edges."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * raw.itemsize).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the stretches of equal keys begin, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every position's suffix to the given depth, by prefix doubling; equal strings have equal ranks.

    Ranks of positions with fewer than depth bytes before the end mean nothing.
    """

    def ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(np.concatenate([[False], key[order[1:]] != key[order[:-1]]]))
        return out

    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(len(text), _U)
    for j in range(min(8, depth)):
        key = (key << _U(8)) | padded[j : j + len(text)].astype(_U)
    rank, known = ranks(key), 8
    while known < depth:
        step = min(known, depth - known)
        ahead = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])[: len(rank)]
        rank, known = ranks(rank * np.int64(len(rank) + 1) + ahead), known + step
    return rank


def later_strings(ids: np.ndarray, counts: np.ndarray, texts: pa.Array, length: int) -> np.ndarray:
    """For the strings of runs (counts[i] of them in texts[i]), in order, which of them a document with a smaller id among the runs has too."""
    coded = texts.dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    distinct = coded.dictionary
    size = np.diff(np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, distinct.offset * 4)).astype(np.int64)
    text = np.frombuffer(distinct.buffers()[2], np.uint8, int(size.sum()))
    first = np.cumsum(size) - size
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    rank = suffix_ranks(text, length)
    many = size - length + 1
    own = np.repeat(np.arange(len(size)), many)
    begin = np.cumsum(many) - many
    rank = rank[np.arange(int(many.sum())) + np.repeat(first - begin, many)]
    low = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, rank, least[own])
    earliest = low[rank]
    at = np.arange(int(counts.sum())) + np.repeat(begin[which] - np.cumsum(counts) + counts, counts)
    return earliest[at] < np.repeat(ids, counts)


def _murmur(k: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of ints, by which it deals rows and buckets."""
    with np.errstate(over="ignore"):
        x = k.astype(np.uint32) * np.uint32(0xCC9E2D51)
        x = ((x << np.uint32(15)) | (x >> np.uint32(17))) * np.uint32(0x1B873593)
        x = np.uint32(seed) ^ x
        x = ((x << np.uint32(13)) | (x >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        x ^= np.uint32(4)
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (x ^ (x >> np.uint32(16))).view(np.int32).astype(np.int64)


def _bucket_keys(at: int, buckets: int, n: int) -> np.ndarray:
    """The first n integers that Spark puts into bucket `at`."""
    out, lo = [], 0
    while sum(map(len, out)) < n:
        k = np.arange(lo, lo + (1 << 16))
        out.append(k[_murmur(k) % buckets == at])
        lo += 1 << 16
    return np.concatenate(out)[:n]


def _even_keys(n: int, tasks: int) -> np.ndarray:
    """n different integers of which Spark deals as many to each of the tasks, give or take one."""
    out = np.full(n, -1, np.int64)
    lo, filled = 0, np.zeros(tasks, np.int64)
    while (out < 0).any():
        k = np.arange(lo, lo + 4 * n + 1024)
        lo += len(k)
        to = _murmur(k) % tasks
        order = np.argsort(to, kind="stable")
        k, to = k[order], to[order]
        edge = np.searchsorted(to, np.arange(tasks))
        place = (filled[to] + np.arange(len(k)) - edge[to]) * tasks + to
        out[place[place < n]] = k[place < n]
        filled += np.bincount(to, minlength=tasks)
    return out


def _sliced(docs: DataFrame) -> DataFrame:
    """The documents as a table of slices (gid, sid, ids, known, bounds, text, size), bucketed by gid: a task's slices are one bucket."""
    parts = max(1, min(docs.rdd.getNumPartitions(), 50_000))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        keys, n = _bucket_keys(part % parts, parts, 16), 0
        for batch, raw, bounds in text_slices(batches, "text", SLICE):
            if n // GROUP >= len(keys):
                keys = _bucket_keys(part % parts, parts, 4 * len(keys))
            # tasks that share a bucket share its keys; a group may then hold slices of both
            ids = batch.column(0)
            row = [int(keys[n // GROUP]), (part << 32) + n, ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), bounds.astype(np.int64).tobytes(), raw.tobytes(), len(raw)]
            kinds = (pa.int32(), pa.int64(), *(pa.binary(),) * 4, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["gid", "sid", "ids", "known", "bounds", "text", "size"])
            n += 1

    spark, name = docs.sparkSession, f"orrery_slices_{uuid.uuid4().hex}"
    rows = docs.mapInArrow(each, "gid int, sid long, ids binary, known binary, bounds binary, text binary, size long")
    rows.write.bucketBy(parts, "gid").option("compression", "zstd").option("path", scratch(spark, "slices")).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  (the relation is resolved; the files outlive the name)
    spark.sql(f"drop table {name}")
    return table


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gid, sid, ids, known, bounds, bytes) of each slice."""
    def values(column: pa.ChunkedArray, i: int, kind: type) -> np.ndarray:
        data = column[i].as_buffer()
        return np.frombuffer(data, kind) if data.size else np.zeros(0, kind)

    for i in range(table.num_rows):
        yield table.column(0)[i].as_py(), table.column(1)[i].as_py(), *(values(table.column(j), i, k) for j, k in ((2, np.int64), (3, np.bool_), (4, np.int64), (5, np.uint8)))


def _phrases(slices: DataFrame, length: int, modulus: int) -> DataFrame:
    """The parse: (gid, sid, id, most, d1, d2, data) of every distinct phrase of a slice, of rows with an id: least and greatest id, and (at, upto, id) of each occurrence."""
    names = ["gid", "sid", "id", "most", "d1", "d2", "data"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, sid, ids, known, bounds, raw in _rows(batch):
                start, end, row = parse(raw, bounds, length, modulus)
                keep = known[row]
                start, end, row = start[keep], end[keep], row[keep]
                data = memoryview(raw)
                digest = np.frombuffer(b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                order = np.lexsort((ids[row], digest[:, 1], digest[:, 0]))
                digest, found = digest[order], np.column_stack([start, end, ids[row]])[order].astype(np.int64)
                new = np.ones(len(order), bool)
                new[1:] = (digest[1:] != digest[:-1]).any(1)
                edge = np.append(np.flatnonzero(new), len(order))
                first, last = edge[:-1], edge[1:] - 1
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gid, np.int32)), pa.array(np.full(n, sid)), pa.array(found[first, 2]), pa.array(found[last, 2]), pa.array(digest[first, 0]), pa.array(digest[first, 1]), _cut(found, edge * 3)], names)

    return slices.mapInArrow(each, "gid int, sid long, id long, most long, d1 long, d2 long, data binary")


def _late(data: pa.Scalar, first: int) -> np.ndarray:
    """(at, upto) of a phrase's occurrences in documents after its first."""
    found = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, 3)
    return found[found[:, 2] > first, :2]


def _with_notes(slices: DataFrame, notes: DataFrame, each: Callable, schema: str) -> DataFrame:
    """each(slice, late phrases, single stretches, notes with data) for every slice; the text does not move, its notes come to it."""

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pa.array(np.argsort(right.column(1).to_numpy(), kind="stable")))
        sid, part, at, upto = (right.column(i).to_numpy() for i in range(1, 5))
        full = right.column(5).combine_chunks().is_valid().to_numpy(zero_copy_only=False) & (part != _LATE)
        stretch = np.column_stack([at, upto]).astype(np.int64)
        out = []
        for piece in _rows(left):
            lo, hi = np.searchsorted(sid, [piece[1], piece[1] + 1])
            bare, kind = ~full[lo:hi], part[lo:hi]
            noted = [(int(part[i]), int(at[i]), right.column(5)[int(i)].as_buffer()) for i in lo + np.flatnonzero(~bare)]
            gone = [_late(right.column(5)[int(i)], int(at[i])) for i in lo + np.flatnonzero(kind == _LATE)]
            out.append(each(piece, np.concatenate([np.zeros((0, 2), np.int64), *gone]), stretch[lo:hi][bare & (kind == _SPANS)], noted))
        out = [x for x in out if x is not None and x.num_rows]
        return pa.Table.from_batches(out) if out else kinds.empty_table()

    kinds = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    return slices.groupBy("gid").cogroup(notes.groupBy("gid")).applyInArrow(group, schema)


def _anchors(slices: DataFrame, late: DataFrame, length: int, piece: int, buckets: int) -> DataFrame:
    """(bucket, gid, sid, low, weight): the distinct anchors of the dictionary's runs in each slice."""

    names = _even_keys(buckets, _tasks(slices))

    def each(x, gone, _single, _notes):
        gid, sid, _ids, known, bounds, raw = x
        _at, count, anchor = runs(raw, alive(bounds, length, known, gone), length, piece)
        bucket, low, weight, _place = own_anchors(anchor, count + length - 1, buckets)
        edge = _edges(bucket)
        n = len(edge) - 1
        packed = np.column_stack([(low & _U(0xFFFF)).astype(np.uint16), ((low >> _U(16)) & _U(0xFFFF)).astype(np.uint16), (low >> _U(32)).astype(np.uint16)])
        return pa.RecordBatch.from_arrays([pa.array(names[bucket[edge[:-1]]].astype(np.int32)), pa.array(np.full(n, gid, np.int32)), pa.array(np.full(n, sid)), _cut(packed, edge * 3), _cut(weight, edge)], ["bucket", "gid", "sid", "low", "weight"])

    return _with_notes(slices, late, each, "bucket int, gid int, sid long, low binary, weight binary")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_bucket(rows: DataFrame, solve: Callable, schema: str) -> DataFrame:
    """solve(table of one bucket's rows) -> batches, bucket by bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            edge = _edges(batch.column(0).to_numpy())
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                bucket = batch.column(0)[a].as_py()
                if held and bucket != last:
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                last = bucket
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return rows.repartition(_tasks(rows), "bucket").sortWithinPartitions("bucket").mapInArrow(each, schema)


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of binary rows put together, and where each row's end."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts), np.cumsum([len(x) for x in parts])


def _shared(anchors: DataFrame, crowd: int) -> DataFrame:
    """Notes: for each slice and bucket one byte an anchor: 0 of one run alone, 1 shared, 2 crowded."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        low, ends = _joined(rows.column(3), "<u2")
        low = low.reshape(-1, 3).astype(_U)
        low = low[:, 0] | (low[:, 1] << _U(16)) | (low[:, 2] << _U(32))
        weight, ends = _joined(rows.column(4), "<u2")
        order = np.argsort(low)
        first = _edges(low[order])
        total = np.add.reduceat((weight & 0x7FFF).astype(np.int64)[order] * 64, first[:-1])
        many = (np.diff(first) > 1) | (np.maximum.reduceat(weight[order], first[:-1]) >> 15 > 0)
        flag = np.empty(len(low), np.uint8)
        flag[order] = np.repeat(np.where(many, np.where(total > crowd, 2, 1), 0).astype(np.uint8), np.diff(first))
        n = rows.num_rows
        cols = [rows.column(i).combine_chunks() for i in (1, 2, 0)]
        has = np.maximum.reduceat(flag, np.concatenate([[0], ends[:-1]])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*cols, pa.array(has), pa.array(np.zeros(n, np.int64)), _cut(flag, np.concatenate([[0], ends]))], ["gid", "sid", "part", "at", "upto", "data"])

    return _by_bucket(anchors, solve, _NOTE)


def _flagged(x, gone, notes, length: int, piece: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slice's runs again with the byte that `_shared` gave each one's anchor."""
    _gid, _sid, _ids, known, bounds, raw = x
    at, count, anchor = runs(raw, alive(bounds, length, known, gone), length, piece)
    bucket, _low, _weight, place = own_anchors(anchor, count, len(names))
    flag = np.zeros(len(bucket), np.uint8)
    edge = _edges(bucket)
    where = {int(names[bucket[a]]): (a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)}
    for part, _has, data in notes:
        a, b = where[part]
        flag[a:b] = np.frombuffer(data, np.uint8)
    return at, count, anchor, flag[place]


def _emitted(slices: DataFrame, notes: DataFrame, length: int, piece: int, buckets: int) -> DataFrame:
    """(bucket, gid, sid, anchor, at, count, id, text): the shared runs of each slice."""

    names = _even_keys(buckets, _tasks(slices))

    def each(x, gone, _single, notes):
        gid, sid, ids, _known, bounds, raw = x
        at, count, anchor, flag = _flagged(x, gone, notes, length, piece, names)
        keep = flag == 1
        at, count, anchor = at[keep], count[keep], anchor[keep]
        pieces = -(-count // PIECES)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, anchor = np.repeat(at, pieces) + nth * PIECES, np.repeat(anchor, pieces)
        count = np.minimum(PIECES, np.repeat(count, pieces) - nth * PIECES)
        bucket = (((anchor >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, count, anchor, bucket = at[order], count[order], anchor[order], bucket[order]
        size = count + length - 1
        ends = np.concatenate([[0], np.cumsum(size)])
        text = raw[np.arange(int(ends[-1])) + np.repeat(at - ends[:-1], size)]
        row = np.searchsorted(bounds, at, "right") - 1
        edge = _edges(bucket)
        n = len(edge) - 1
        cols = [_cut(anchor, edge), _cut(at.astype(np.uint32), edge), _cut(count.astype(np.uint16), edge), _cut(ids[row], edge), _cut(text, ends[edge])]
        return pa.RecordBatch.from_arrays([pa.array(names[bucket[edge[:-1]]].astype(np.int32)), pa.array(np.full(n, gid, np.int32)), pa.array(np.full(n, sid)), *cols], ["bucket", "gid", "sid", "anchor", "at", "count", "id", "text"])

    return _with_notes(slices, notes, each, "bucket int, gid int, sid long, anchor binary, at binary, count binary, id binary, text binary")


def _ordered(emitted: DataFrame, length: int) -> DataFrame:
    """Notes: the removed stretches of each slice, from the suffix order of the runs that come together."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, ends = _joined(rows.column(3), "<u8")
        at, count, ids, text = (_joined(rows.column(i), k)[0] for i, k in ((4, "<u4"), (5, "<u2"), (6, "<i8"), (7, "|u1")))
        count = count.astype(np.int64)
        owner = np.repeat(np.arange(rows.num_rows), np.diff(ends, prepend=0))
        size = count + length - 1
        begin = np.cumsum(size) - size
        order = np.argsort(anchor, kind="stable")
        group = _edges(anchor[order])
        upto = np.cumsum(size[order])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lo = 0
        while lo < len(order):
            # whole groups of about CHUNK bytes
            base = upto[lo - 1] if lo else 0
            hi = group[np.searchsorted(group, np.searchsorted(upto, base + CHUNK), "right") - 1]
            hi = int(hi) if hi > lo else int(group[np.searchsorted(group, lo, "right")])
            pick = order[lo:hi]
            lo = hi
            n, m = size[pick], count[pick]
            to = np.concatenate([[0], np.cumsum(n)])
            data = text[np.arange(int(to[-1])) + np.repeat(begin[pick] - to[:-1], n)]
            late = later_strings(ids[pick], m, pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]), length)
            if late.any():
                last = np.cumsum(m)
                mark = np.zeros(len(late) + len(m) + 1, np.int8)  # a gap after each run
                run = np.repeat(np.arange(len(m)), m)
                mark[np.arange(len(late)) + run + 1] = late
                step = np.diff(mark.astype(np.int8), append=np.int8(0))
                a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                own = np.searchsorted(last + np.arange(len(m)), a, "right")
                within = a - own - (last - m)[own]
                start = at[pick][own].astype(np.int64) + within
                found.append((owner[pick][own], start, start + (b - a) - 1 + length))
        if not found:
            return
        who, start, end = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(who, kind="stable")
        who, spans = who[order], np.column_stack([start, end])[order]
        edge = _edges(who)
        take = pa.array(who[edge[:-1]])
        n = len(edge) - 1
        yield pa.RecordBatch.from_arrays([rows.column(1).combine_chunks().take(take), rows.column(2).combine_chunks().take(take), pa.array(np.full(n, _SPANS, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)), _cut(spans, edge * 2)], ["gid", "sid", "part", "at", "upto", "data"])

    return _by_bucket(emitted, solve, _NOTE)


def _after_first(rows: DataFrame, keys: list[str], most: str = "id") -> DataFrame:
    """Rows (ids from id to most) with an id that is not their key's least. Only keys of several ids are written and joined, so a hot key can be split."""
    first = rows.groupBy(*keys).agg(F.min("id").alias("first"), F.max(most).alias("last")).where("first < last")
    return rows.join(staged(first.select(*keys, "first"), "first"), keys).where(f"first < {most}")


def _crowded(slices: DataFrame, notes: DataFrame, length: int, piece: int, buckets: int) -> DataFrame:
    """Notes: removed strings of crowded anchors, by 128-bit keys."""

    names = _even_keys(buckets, _tasks(slices))

    def each(x, gone, _single, notes):
        gid, sid, ids, _known, bounds, raw = x
        if not any(has == 2 for _part, has, _data in notes):
            return None
        at, count, _anchor, flag = _flagged(x, gone, notes, length, piece, names)
        at, count = at[flag == 2], count[flag == 2]
        every = np.repeat(at - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        n = len(every)
        keys = [pa.array(rolled(raw, length, t)[every].view(np.int64)) for t in (0, 1)]
        row = np.searchsorted(bounds, every, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, gid, np.int32)), pa.array(np.full(n, sid)), pa.array(every), pa.array(ids[row]), *keys], ["gid", "sid", "at", "id", "k1", "k2"])

    rows = staged(_with_notes(slices, notes, each, "gid int, sid long, at long, id long, k1 long, k2 long"), "crowded")
    late = _after_first(rows, ["k1", "k2"])
    return late.select("gid", "sid", F.lit(_SPANS).alias("part"), "at", (F.col("at") + length).alias("upto"), F.lit(None).cast("binary").alias("data"))


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, modulus: int = 256, piece: int = 24, crowd: int = 1 << 20, bucket_bytes: int = 32 << 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    slices = _sliced(docs)
    total = slices.agg(F.sum("size")).first()[0] or 0
    buckets = max(_tasks(docs), -(-total // bucket_bytes))
    phrases = staged(_phrases(slices, length, modulus), "phrases")
    late = staged(_after_first(phrases, ["d1", "d2"], "most").select("gid", "sid", F.lit(_LATE).alias("part"), F.col("first").alias("at"), F.lit(0).cast("long").alias("upto"), "data"), "late")
    shared = staged(_shared(_anchors(slices, late, length, piece, buckets), crowd), "shared")
    spans = _ordered(_emitted(slices, late.unionByName(shared), length, piece, buckets), length)
    if not shared.where("at = 2").isEmpty():
        spans = spans.unionByName(_crowded(slices, late.unionByName(shared), length, piece, buckets))
    spans = staged(spans, "spans")

    def each(x, gone, single, notes):
        _gid, _sid, ids, known, bounds, raw = x
        cover = np.concatenate([gone, single, *(np.frombuffer(data, np.int64).reshape(-1, 2) for _part, _has, data in notes)])
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, cover[:, 0], 1)
        np.add.at(edge, cover[:, 1], -1)
        cut = np.cumsum(edge[:-1]) > 0
        starts = cut.copy()
        starts[1:] &= ~cut[:-1]
        head = bounds[:-1][np.diff(bounds) > 0]
        starts[head] = cut[head]
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])
        removed, count = sums(cut), sums(starts)
        data, kept = memoryview(raw), []
        for a, b, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), removed.tolist(), strict=True):
            kept.append(raw[a:b][~cut[a:b]].tobytes() if n else data[a:b])
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        cols = [pa.array(ids, mask=~known), pa.array(np.diff(bounds)), pa.array(removed), pa.array(count), pa.array(sha, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            cols.append(pa.array([bytes(k) for k in kept], pa.binary()))
        return pa.RecordBatch.from_arrays(cols, [*names, "kept"][: len(cols)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return _with_notes(slices, late.unionByName(spans), each, schema)
