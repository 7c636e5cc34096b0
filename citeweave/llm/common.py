"""What the corpus operators share: scratch tables, range buckets and array code over words.

Scratch tables live in the folder named by ``spark.checkpoint.dir``, which driver and
executors share; a temporary folder stands in only where that setting is missing (tests).
"""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the controls 9 to 13.
SEPARATORS = bytes([32, 9, 10, 11, 12, 13])
#: Bytes of text that array code handles at once.
CHUNK_BYTES = 1 << 20

_fallback: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="citeweave-")
    return _fallback[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it.

    Lineage ends here, an executor's loss costs nothing that was written, and the
    reader's size is known to the planner, which then decides on broadcasts by it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again (their readers have been written themselves)."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows and bytes of an Arrow batch of texts, where the session has not chosen them itself.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by rows and bytes, as batches of long texts are several times their size in buffers.

    What the session or its context set stays.
    """
    chosen = {k for k, _ in spark.sparkContext.getConf().getAll()} | set(spark.conf.getAll)
    for key, value in BATCHES.items():
        if key not in chosen:
            spark.conf.set(key, value)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bucket(key: Column, bounds: list) -> Column:
    """Number of bounds below ``key`` (bounds sorted); nulls get 0.

    Two levels of about sqrt(n) comparisons each, so that thousands of bounds stay cheap.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.array(*[F.lit(g[-1]) for g in groups[:-1]]) if len(groups) > 1 else None
    nested = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < key))

    coarse = below(tops) if tops is not None else F.lit(0)
    fine = below(F.element_at(nested, (coarse + 1).cast("int")))
    return F.when(key.isNull(), F.lit(0)).otherwise(coarse * step + fine).cast("int")


def lean(run: Callable) -> Callable:
    """A function over batches that gives freed memory back to the system when its task ends.

    Workers are kept for later tasks, of other stages too; what they hold on to adds up.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return wrapped


# --------------------------------------------------------------------------- words as arrays

_rng = np.random.Generator(np.random.PCG64(20240229))
_SEP = np.zeros(256, dtype=bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and those of its inverse."""
    if len(_pow[0]) < n:
        for k, base in ((0, _R), (1, _R_INV)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each span; the same values give the same hash anywhere."""
    up, down = powers(max(1, len(values)))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 512) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows; a run exceeds ``limit`` only if it is one row.

    The column is converted ``rows`` at a time, so a batch of long texts is never held twice.
    """
    for base in range(0, len(column), rows):
        part = text_array(column.slice(base, rows))
        n = len(part)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + n + 1]
        data = part.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        i = 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1))
            yield base + i, base + j, whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``buf``, and for each row the index of its first word (one more at the end)."""
    n = len(buf)
    sep = _SEP[buf]
    before = np.ones(n, dtype=bool)
    before[1:] = sep[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = True
    starts = np.flatnonzero(before & ~sep)
    after = np.ones(n, dtype=bool)
    after[:-1] = sep[1:]
    after[cuts[cuts > 0] - 1] = True
    ends = np.flatnonzero(after & ~sep) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, A-Z lower-cased, and the index of each row's first word.

    A very long row is hashed in pieces that end at separators, to bound the arrays.
    """
    starts, ends, first = word_bounds(buf, offsets)
    if len(buf) <= 4 * CHUNK_BYTES:
        return span_hashes(_BYTE_LOWER[buf], starts, ends), first
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 2 * CHUNK_BYTES, side="right")))
        low, high = starts[i], ends[j - 1]
        out[i:j] = span_hashes(_BYTE_LOWER[buf[low:high]], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out, first
