"""Helpers shared by the operators of this subpackage: staging, text slices, word hashes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Word of the contracts: a run of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are handled at once by the vectorised code.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="orrery-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/orrery-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of at most size bytes while jobs run: a batch stands in the JVM and in the worker at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: the lineage ends here."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_of(batch: pa.RecordBatch, text: str) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The batch, the UTF-8 bytes of its text column (null: empty), and where each row's bytes begin."""
    arr = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
    bounds = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return batch, raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """columns_of() for runs of rows of about size bytes; a longer row is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole, raw, bounds = columns_of(batch, text)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1)
            hi = min(hi, batch.num_rows)
            yield whole.slice(lo, hi - lo), raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
            lo = hi
    # the worker outlives the task: what Arrow keeps for later goes back
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(0, n - 1), _STEP, np.uint64))]) if n else np.zeros(0, np.uint64)


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of every word."""
    solid = ~_SPACE[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = solid
    before[bounds] = False
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = solid
    after[bounds] = False
    start = np.flatnonzero(solid & ~before[:-1])
    end = np.flatnonzero(solid & ~after[1:]) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    picked = raw[at + np.repeat(start, size)]
    return mix64(np.add.reduceat(_BYTE[picked] * powers(int(size.max()))[at], first))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k words that follow each other; runs over row ends are for the caller to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    scale = powers(k + 1)[1:]
    total = words[:n] * scale[0]
    for j in range(1, k):
        total += words[j : j + n] * scale[j]
    return mix64(total)


def summed(rows: DataFrame, column: str, width: int, tasks: int = 4, kind: str = "<i8", merge: np.ufunc = np.add) -> np.ndarray:
    """Sum (or another merge) of the vectors in a binary column: `tasks` vectors come to the driver.

    Of many partitions the sums are written first, so the last step reads few rows.
    """
    out = "|u1" if kind == "|u1" else "<i8"

    def adder(code: str):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width, out)
            for batch in batches:
                for x in batch.column(0):
                    merge(total, np.frombuffer(x.as_buffer(), code), out=total)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        return add

    some = rows.where(f"{column} is not null").select(column)
    if some.rdd.getNumPartitions() > 16 * tasks:
        some, kind = staged(some.coalesce(16 * tasks).mapInArrow(adder(kind), "total binary"), "sums"), out
    total = np.zeros(width, out)
    for r in some.coalesce(tasks).mapInArrow(adder(kind), "total binary").toLocalIterator():
        merge(total, np.frombuffer(r.total, out), out=total)
    return total
