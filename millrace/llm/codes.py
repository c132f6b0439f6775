"""Compression of vectors into codes: integer codebooks for the parts of a vector, fitted by exact integer arithmetic."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import BROADCAST_ROWS
from millrace.llm.shared import stored

#: Components become integers of this many units.
SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Rows whose distances are computed at once.
ROWS = 8192
#: No squared distance of two whole vectors exceeds this, so that all distances are exact as long.
MOST_ERROR = 1 << 62


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part: one int64 matrix (entries x length of the part) a part."""

    books: tuple[np.ndarray, ...]

    @property
    def bounds(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance to it, for each row and part; ties go to the lower index.

        |x|^2 - 2 x c + |c|^2 over int64: it may wrap in between, but the distance itself fits, so it is exact.
        """
        at, far = np.zeros((len(x), len(self.books)), np.int64), np.zeros((len(x), len(self.books)), np.int64)
        for k, (book, first, last) in enumerate(zip(self.books, self.bounds, self.bounds[1:])):
            part = x[:, first:last]
            apart = (part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1)[None, :]
            at[:, k] = apart.argmin(1)
            far[:, k] = np.take_along_axis(apart, at[:, k : k + 1], 1)[:, 0]
        return at, far

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, decimal, joined by commas."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column whose lists all have ``width`` integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def quantised(vectors: DataFrame, column: str = "embedding", keep: tuple = ("vec_id", "label")) -> DataFrame:
    """``keep`` and ``units``: floor(SCALE x component) of each vector; rows whose vector is null, empty, or holds null, NaN or infinity are left out.

    Integers are held within +-sqrt(MOST_ERROR / width) / 2, for 64 components those of 32 768 and more, so that every squared distance fits in a long.
    """

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            if not pa.types.is_list(lists.type):
                lists = lists.cast(pa.list_(lists.type.value_type))
            good = np.asarray(lists.is_valid().to_numpy(zero_copy_only=False), bool)
            values = lists.flatten()
            flat = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            sizes = np.where(good, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good &= (sizes > 0) & (bad[ends] == bad[ends - sizes])
            with np.errstate(invalid="ignore", over="ignore"):
                most = np.repeat(np.minimum(np.floor(np.sqrt(MOST_ERROR / np.maximum(sizes, 1)) / 2), 1 << 30), sizes)
                units = np.clip(np.where(np.isnan(flat), 0.0, np.floor(flat * SCALE)), -most, most).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(units))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), whole], names=[*keep, "units"]).filter(pa.array(good))

    source = vectors.select(*keep, F.col(column).cast("array<double>").alias(column))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep)
    return source.mapInArrow(floors, kinds + ", units array<int>")


def start(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors of the least vec_ids (nulls last, equal ids by their integers); None without vectors."""
    first = kept.select("vec_id", "units").orderBy(F.col("vec_id").asc_nulls_last(), "units").limit(entries).collect()
    if not first:
        return None
    width = len(first[0]["units"])
    rows = np.array([r["units"] for r in first if len(r["units"]) == width], np.int64)
    return Codebooks(tuple(np.ascontiguousarray(b) for b in np.array_split(rows, parts, axis=1)))


def refine(kept: DataFrame, now: Codebooks) -> Codebooks:
    """One round: each entry becomes the floored mean of the parts that are nearest to it; unused entries stay.

    A task sends one sum and count for each entry and position; they are added by a grouped shuffle, and the codebooks' size is what reaches the driver.
    """
    shared = kept.sparkSession.sparkContext.broadcast(now)
    width, entries = int(now.bounds[-1]), len(now.books[0])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total, count = np.zeros((entries, width), np.int64), np.zeros((len(books.books), entries), np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column("units").slice(first, ROWS), width)
                at, _ = books.nearest(x)
                for k, (a, b) in enumerate(zip(books.bounds, books.bounds[1:])):
                    chosen = (at[:, k][None, :] == np.arange(entries)[:, None]).astype(np.int64)
                    total[:, a:b] += chosen @ x[:, a:b]
                    count[k] += chosen.sum(1)
        if count.any():
            sizes = np.repeat(count, np.diff(books.bounds), axis=0).T  # entries x width
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(entries * width)), pa.array(total.ravel()), pa.array(sizes.ravel())], names=["slot", "total", "n"])

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = kept.select("units").mapInArrow(summed, "slot long, total long, n long").groupBy("slot").agg(big("total"), big("n")).filter("n > 0").collect()
    shared.unpersist()
    flat = np.concatenate([b for b in now.books], axis=1)
    for r in sums:
        flat[r["slot"] // width, r["slot"] % width] = int(r["total"]) // int(r["n"])
    return Codebooks(tuple(np.ascontiguousarray(flat[:, a:b]) for a, b in zip(now.bounds, now.bounds[1:])))


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all rows of ``kept`` (as ``quantised`` makes them, of one width)."""
    books = start(kept, parts, entries)
    for _ in range(rounds if books else 0):
        books = refine(kept, books)
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """``kept`` with code (two hex digits a part) and error (squared distances to the entries, summed) instead of units."""
    shared, others = kept.sparkSession.sparkContext.broadcast(books), [c for c in kept.columns if c != "units"]
    width = int(books.bounds[-1])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                at, far = shared.value.nearest(matrix(part.column("units"), width))
                digits = at.astype(np.uint8).tobytes().hex()
                step = 2 * at.shape[1]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array([digits[k : k + step] for k in range(0, step * len(at), step)], pa.string()), pa.array(far.sum(1))], names=[*others, "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "units")
    return kept.mapInArrow(coded, kinds + ", code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``vector``: the entries that a code names, divided by SCALE; a null or malformed code gives null."""
    size = 2 * len(books.books)
    tables = [F.array(*[F.array(*[F.lit(v / SCALE) for v in row]) for row in b.tolist()]) for b in books.books]
    place = [F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int") for k in range(len(books.books))]
    whole = F.concat(*[F.get(t, p) for t, p in zip(tables, place)])
    return codes.withColumn("vector", F.when(F.length("code") == size, whole))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code, error, and the codebooks of all ``vectors``.

    Kept are vectors of the width of the least vec_id's; those that are null, empty, of another width, or hold null or non-finite
    components are left out. Widths that do not divide evenly give parts that differ by one. Repeated and equal rows are coded alike; with fewer rows
    than entries the codebooks have as many as there are rows; an empty table gives no rows and no codebooks. Other columns are ignored.
    """
    kept = stored(quantised(vectors), "units")
    books = start(kept, parts, entries)
    if books is None:
        return kept.selectExpr("vec_id", "label", "cast(null as string) as code", "cast(null as long) as error"), None
    kept = kept.filter(F.size("units") == int(books.bounds[-1]))
    books = fit(kept, parts, entries, rounds)
    return encode(kept, books), books


def compressed_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error (of all rows with the label, nulls together) and the digest of the codebooks.

    Errors are summed by label first; the sums are broadcast if they are few, else joined by label, where a hot label's rows are split.
    """
    codes, books = compress(vectors)
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    codes = stored(codes, "codes")
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("long").alias("label_error"))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")
