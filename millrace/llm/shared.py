"""What the operators share: the folder all executors see, lineage cuts, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word-based contract: blank and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text handled at once in Python; bounds the working arrays of a task.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary local folder is made in local mode (tests), where all run in
    one process; on a cluster executors would not see each other's files, so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            found = "file://" + folder
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder; later stages survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Seconds between two calls of the driver's collector by ``tidy``, and when the last one was.
TIDY_SECONDS = 4.0
_tidied = [0.0]


def tidy(spark: SparkSession) -> None:
    """Have Spark remove shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's collector runs, which by itself may be half an hour apart; operators of many large shuffles call this after each,
    so that their disk holds one or two of them, not all. Results do not depend on it.
    """
    if time.monotonic() - _tidied[0] >= TIDY_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _tidied[0] = time.monotonic()


#: What operators keep in a worker from task to task, such as encoders; each registers its own table.
_kept: list[dict] = []


def keeps(table: dict) -> dict:
    """Register a table of what a worker keeps from task to task, for ``let_go``."""
    _kept.append(table)
    return table


def let_go() -> None:
    """Drop what other operators have kept in this worker, and give its memory back to the system.

    Workers outlive an operator's tasks, so in a chain of operators each would hold the others' tables besides its own arrays.
    Called first in tasks that need none of them; costs nothing where nothing is kept, and results do not depend on it.
    """
    if any(_kept):
        for table in _kept:
            table.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # glibc only
            trim(0)


#: Paths that ``stored`` has written and ``release`` has not removed.
_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as compressed Parquet to the shared folder and read it back.

    Smaller on disk than ``cut`` and prunes columns on later reads.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> frozenset[str]:
    """The paths that ``stored`` has written so far and that are still there."""
    return frozenset(_written)


def release(spark: SparkSession, keep: DataFrame | None = None, others: frozenset[str] = frozenset()) -> None:
    """Remove what ``stored`` has written, but for the files that ``keep`` reads and the paths of ``others``.

    For callers that have written their result and use no other table of an operator any more.
    """
    needed = [f.rsplit("/", 1)[0] for f in keep.inputFiles()] if keep is not None else []
    needed = {n.split("://")[-1].removeprefix("file:").lstrip("/") for n in needed}
    for path in list(_written):
        if path.split("://")[-1].removeprefix("file:").lstrip("/") not in needed and path not in others:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _written.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; works for any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_word_count(text) -> "F.Column":
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- words in NumPy

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and an odd base: a rolling polynomial modulo 2**64.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, kept between calls."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)]), dtype=np.uint64) for b in (BASE, BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without copying, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) > 1 else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about SLICE_BYTES of text and ``rows`` rows, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = text_bytes(batch.column(text))[1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(sizes, sizes[first] + SLICE_BYTES, "right")) - 1
            last = min(max(last, first + 1), first + rows, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in byte positions, and for each row its first word (n + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_GAP[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    breaks = offsets[1:-1]
    breaks = breaks[breaks < len(raw)]
    begins[breaks] = inside[breaks]  # a row's first byte starts a word even if the row before ends in one
    finishes = np.empty(len(raw), bool)
    finishes[-1] = inside[-1]
    finishes[:-1] = inside[:-1] & (~inside[1:] | begins[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; lower folds A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw = _LOWER[raw] if lower else raw
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, in order: one for each start, len(words) - n + 1 in all."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * np.uint64((0xA0761D6478BD642F + 2 * k * 0xE7037ED1A0B428DB) & ((1 << 64) - 1) | 1)
        total ^= total >> np.uint64(29)
    return mix(total)


def rolling_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Like gram_hashes in time that does not depend on n, for long runs."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1] + np.uint64(n))
