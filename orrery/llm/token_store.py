"""Token ids in files, coded by a static range asymmetric numeral system.

One frequency table, counted over the whole corpus and scaled to 2**SCALE, serves all files. A segment
file holds consecutive documents in ascending id order. Its ids are cut into blocks of LANES x STEPS
symbols; the lanes of a block are interleaved in one stream of 32-bit words. Every EVERY steps a
checkpoint keeps the lanes' states and the place in the stream, so that all parts of a file decode side
by side. Each block has a CRC-32 of its stream and checkpoints, each file one of its document table.

Files go to the shared folder under a name of the range partition, by way of a temporary name, so a task
that runs again replaces its own file. They are read back with Spark's binaryFile source.

Nulls: a null text is empty and has its end id alone; a null id comes first and stays null. Repeated rows
are stored each. An empty table writes no segment and gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import scratch, staged, summed
from .tokens import forget, token_ids

SCALE, LANES, STEPS, EVERY = 20, 32, 512, 128
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIQQIIIII")
_MAGIC, _TABLE = b"RNS1", b"RNT1"


class Broken(ValueError):
    """A file whose magic, table or checksum is not what it should be."""


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts to frequencies that sum to 2**SCALE, at least 1 for every symbol that occurs."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if not len(used):
        return out
    exact = counts[used] / counts[used].sum() * ((1 << SCALE) - len(used))
    share = np.floor(exact).astype(np.int64)
    rest = (1 << SCALE) - len(used) - int(share.sum())
    share[np.argsort(-(exact - share), kind="stable")[:rest]] += 1
    out[used] = share + 1
    return out


class Coder:
    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    def encode(self, ids: np.ndarray, group: int = 32) -> Iterator[bytes]:
        """The blocks of ids, `group` blocks coded side by side at a time."""
        for lo in range(0, len(ids), group * LANES * STEPS):
            yield from self._blocks(ids[lo : lo + group * LANES * STEPS])

    def _blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        n = len(ids)
        blocks = -(-n // (LANES * STEPS))
        full = np.full(blocks * LANES * STEPS, int(np.argmax(self.freq)), np.int32)
        full[:n] = ids
        full = full.reshape(blocks, STEPS, LANES)
        x = np.full((blocks, LANES), _LOW, np.uint64)
        words = np.zeros(full.shape, "<u4")
        sent = np.zeros(full.shape, bool)
        marks = np.zeros((blocks, STEPS // EVERY, LANES), "<u8")
        for t in range(STEPS - 1, -1, -1):
            s = full[:, t]
            f = self.freq[s]
            over = x >= (f << np.uint64(63 - SCALE))
            words[:, t], sent[:, t] = x, over
            x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            x = (q << np.uint64(SCALE)) + (x - q * f) + self.cum[s]
            if t % EVERY == 0:
                marks[:, t // EVERY] = x
        per = sent.reshape(blocks, STEPS // EVERY, -1).sum(2)
        at = (np.cumsum(per, 1) - per).astype("<u4")
        for b in range(blocks):
            body = marks[b].tobytes() + at[b].tobytes() + words[b][sent[b]].tobytes()
            size = min(LANES * STEPS, n - b * LANES * STEPS)
            yield struct.pack("<III", size, len(body), zlib.crc32(body)) + body

    def decode(self, data: bytes, blocks: int) -> np.ndarray:
        """All ids of the blocks; every checkpoint starts a lane group of its own."""
        parts = STEPS // EVERY
        marks, at, streams, sizes, base, seek = [], [], [], [], 0, 0
        for _ in range(blocks):
            size, length, crc = struct.unpack_from("<III", data, seek)
            body = data[seek + 12 : seek + 12 + length]
            if zlib.crc32(body) != crc or len(body) != length:
                raise Broken("block checksum")
            cut = 8 * parts * LANES
            marks.append(np.frombuffer(body, "<u8", parts * LANES).reshape(parts, LANES))
            at.append(np.frombuffer(body, "<u4", parts, cut).astype(np.int64) + base)
            streams.append(np.frombuffer(body, "<u4", -1, cut + 4 * parts))
            base += len(streams[-1])
            sizes.append(size)
            seek += 12 + length
        if not blocks:
            return np.zeros(0, np.int64)
        x, ptr = np.concatenate(marks).astype(np.uint64), np.concatenate(at)
        stream = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
        out = np.zeros((len(x), EVERY, LANES), np.uint32)
        mask = np.uint64((1 << SCALE) - 1)
        for t in range(EVERY):
            slot = x & mask
            s = self.symbol[slot]
            out[:, t] = s
            x = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.cum[s]
            low = x < _LOW
            place = ptr[:, None] + np.cumsum(low, 1) - 1
            x = np.where(low, (x << np.uint64(32)) | stream[np.where(low, place, 0)], x)
            ptr = ptr + low.sum(1)
        flat = out.reshape(blocks, -1)
        return np.concatenate([flat[b, : sizes[b]] for b in range(blocks)])


def dump_segment(coder: Coder, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> Iterator[bytes]:
    """The parts of a segment file, block by block."""
    named = np.array([x is not None for x in doc_ids], np.uint8)
    table = zlib.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + named.tobytes() + np.array(lengths, "<u8").tobytes(), 1)
    blocks = -(-len(ids) // (LANES * STEPS))
    yield _HEAD.pack(_MAGIC, coder.crc, len(doc_ids), len(ids), LANES, STEPS, blocks, len(table), zlib.crc32(table)) + table
    yield from coder.encode(ids)


def load_segment(coder: Coder, data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a segment file."""
    magic, crc, docs, tokens, lanes, steps, blocks, size, check = _HEAD.unpack_from(data)
    table = data[_HEAD.size : _HEAD.size + size]
    if magic != _MAGIC or crc != coder.crc or (lanes, steps) != (LANES, STEPS) or zlib.crc32(table) != check:
        raise Broken("segment head")
    raw = zlib.decompress(table)
    names, named = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, np.uint8, docs, 8 * docs)
    lengths = np.frombuffer(raw, "<u8", docs, 9 * docs).astype(np.int64)
    ids = coder.decode(data[_HEAD.size + size :], blocks)
    if len(ids) != tokens or lengths.sum() != tokens:
        raise Broken("segment length")
    return [int(x) if y else None for x, y in zip(names, named, strict=True)], lengths, ids


def _put(path: str, parts: Iterable[bytes], attempt: int) -> None:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{at}.{attempt}.tmp") as out:
        for data in parts:
            out.write(data)
    store.move(f"{at}.{attempt}.tmp", at)


def tokenized(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, style: str, end_id: int, vocab: int) -> DataFrame:
    """Staged rows (doc_id, row, ids) and, for each partition, one row of counts."""
    kind = docs.schema[id_col].dataType.simpleString()
    code = "<u2" if vocab <= 1 << 16 else "<u4"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, part, key = np.zeros(vocab, np.int64), 0, TaskContext.get().partitionId(), None
        names = ["doc_id", "row", "ids", "counts"]
        for b, ids, ends in token_ids(tokenizer, style).of_batches(batches):
            key, n = b.schema.field(0).type, b.num_rows
            every = np.insert(ids, ends, end_id)
            counts += np.bincount(every, minlength=vocab)
            edge = (np.concatenate([[0], ends + np.arange(1, n + 1)]) * np.dtype(code).itemsize).astype(np.int64)
            data = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(every.astype(code).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((part << 40) + seen + np.arange(n)), data, pa.nulls(n, pa.binary())], names)
            seen += n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(coded, f"doc_id {kind}, row long, ids binary, counts binary"), "ids")


def write_store(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", style: str = "word", end_id: int = 1, vocab: int = 49_408, segment_tokens: int = 4_000_000) -> DataFrame:
    """Writes table.rant and the segment files; the manifest (segment, n_docs, n_tokens) as a staged table."""
    rows = tokenized(docs, tokenizer, id_col=id_col, text_col=text_col, style=style, end_id=end_id, vocab=vocab)
    counts = summed(rows, "counts", vocab)
    freq = scaled(counts)
    packed = zlib.compress(freq.astype("<u4").tobytes())
    _put(f"{folder}/table.rant", [_TABLE + struct.pack("<III", vocab, len(packed), zlib.crc32(packed)) + packed], 0)
    code = "<u2" if vocab <= 1 << 16 else "<u4"
    parts = max(1, -(-int(counts.sum()) // segment_tokens))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the encoders' memo, if this worker has tokenised before
        coder, task = Coder(freq), TaskContext.get()
        done: list[tuple[str, int, int]] = []
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            name = f"seg-{task.partitionId():07d}-{len(done):04d}.rans"
            _put(f"{folder}/{name}", dump_segment(coder, names, [len(x) for x in held], np.concatenate(held)), task.taskAttemptId())
            done.append((name, len(names), size))
            names.clear()
            held.clear()
            size = 0

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                held.append(np.frombuffer(ids.as_py(), code))
                size += len(held[-1])
                if size >= 2 * segment_tokens:
                    flush()
        if names:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["segment", "n_docs", "n_tokens"])

    ordered = rows.where("ids is not null").select("doc_id", "row", "ids").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("row")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    return staged(ordered.select("doc_id", "ids").mapInArrow(save, "segment string, n_docs long, n_tokens long"), "manifest")


def read_table(folder: str) -> np.ndarray:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(f"{folder}/table.rant")
    with store.open_input_stream(at) as f:
        data = f.read()
    vocab, size, crc = struct.unpack_from("<III", data, 4)
    packed = data[16 : 16 + size]
    if data[:4] != _TABLE or zlib.crc32(packed) != crc:
        raise Broken("table")
    return np.frombuffer(zlib.decompress(packed), "<u4", vocab).astype(np.int64)


def read_store(spark: SparkSession, folder: str, manifest: DataFrame, *, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files."""
    freq = read_table(folder)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, lengths, ids = load_segment(coder, content.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                part = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends, lengths, strict=True)]
                cols = [pa.array([path.rpartition("/")[2]] * len(names), pa.string()), pa.array(names, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in part], pa.int64())]
                kept = [pa.array([bytes(x) for x in part], pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(cols + kept, ["segment", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: 5 + with_ids])

    # starts of segments: within hundreds of range partitions, then over the hundreds
    group = manifest.withColumn("g", F.substring("segment", 1, 9))
    before = F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    groups = group.groupBy("g").agg(F.sum("n_tokens").alias("n")).select(F.col("g").alias("_g"), before.alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("g").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    base = group.withColumn("inner", inner).join(groups, F.col("g") == F.col("_g")).select("segment", (F.col("inner") + F.col("before")).alias("base"))
    if not manifest.take(1):
        found = spark.createDataFrame([], f"segment string, doc_id {id_type}, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(folder).select("path", "content")
        found = files.mapInArrow(load, "segment string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    out = found.join(base, "segment")
    return out.select(F.col("doc_id").cast(id_type).alias("doc_id"), (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def store_and_read(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Writes all documents to a new folder of the shared one and reads them back."""
    folder = scratch(docs.sparkSession, "tokens")
    manifest = write_store(docs, tokenizer, folder, **how)
    return read_store(docs.sparkSession, folder, manifest)
