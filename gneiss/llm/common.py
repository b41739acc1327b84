"""Shared pieces of the training-data operators: scratch tables, size-checked broadcasts, vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word definition here: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that may be broadcast after they were counted; wider rows divide it.
BROADCAST_ROWS = 100_000
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only where that is unset
    (a local run or a test) a temporary folder takes its place."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again, which cuts the lineage and survives the loss
    of executors. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gneiss-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a path when the application ends."""

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM is already gone; there is nobody left to tell
            return

    atexit.register(remove)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted ``rows`` are within ``limit``; otherwise the join shuffles, and adaptive
    execution splits its hot keys."""
    return F.broadcast(df) if rows <= limit else df


def n_words(text: str = "text"):
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def id_bucket(n: int = 5, doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def small_batches(spark: SparkSession) -> None:
    """Rows travel to Python in batches of at most BATCH_BYTES, unless the session asks for something itself: the default
    of 64 MB is held several times over in each task."""
    if spark.conf.get(_BATCH) in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def trim() -> None:
    """Gives memory that a task is done with back to the system; workers are used again for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library, which has no such call
        return


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def raw_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offset of each text (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes together (one text may be longer): first, end, bytes, offsets."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def texts_of(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """The texts of a column one by one, few of them as Python strings at a time."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the first word of each text (one more than texts)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = _LOWER) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lowered."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    letters = fold[data[pos + np.repeat(starts, lens)]].astype(np.uint64) + np.uint64(1)
    h = np.add.reduceat(letters * _powers(int(lens.max()))[pos], first)
    return mix(h ^ (lens.astype(np.uint64) * _PRIME))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        x = np.full(max(256, 2 * n), _PRIME | np.uint64(1), np.uint64)
        x[0] = 1
        _POWERS = np.multiply.accumulate(x)
    return _POWERS


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes (empty if there are fewer)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return mix(out)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], list[pa.RecordBatch] | Iterator[pa.RecordBatch]], schema, rows: int = 1_000) -> DataFrame:
    """``mapInArrow`` with a function of at most ``rows`` rows at a time, which bounds what is held as Python objects."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield from f(batch.slice(i, rows))
        trim()

    small_batches(df.sparkSession)
    return df.mapInArrow(each, schema)
