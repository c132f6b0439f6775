"""Benchmark decontamination by the q-gram lemma over diagonal bands, with banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import join_checked
from millrace.llm.shared import cut, slices, text_bytes

#: Length of a gram in bytes of normal form; eight fit one machine word.
Q = 8
#: One edit is allowed for so many bytes of an item.
BYTES_PER_EDIT = 10
#: Items are sent to the executors in parts of about this many characters.
PART_CHARS = 4_000_000
_TABLE_BITS = 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_KEEP = np.full(256, 32, np.uint8)
for _lo, _hi in ((48, 58), (97, 123), (128, 256)):
    _KEEP[_lo:_hi] = np.arange(_lo, _hi)


def normal_form(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of lower-cased text, all between them as one blank; a blank at both ends.

    Returns the bytes of all rows and the n + 1 offsets.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    padded = pc.binary_join_element_wise(pa.scalar(""), pc.utf8_lower(texts.fill_null("")), pa.scalar(""), pa.scalar(" "))
    raw, offsets = text_bytes(padded)
    folded = _KEEP[raw]
    keep = np.ones(len(folded), bool)
    filled = folded != 32
    np.logical_or(filled[1:], filled[:-1], out=keep[1:])
    keep[offsets[:-1]] = True
    kept = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return folded[keep], kept[offsets]


def edit_budget(length: int) -> int:
    """Edits within which an item of so many bytes is found: one in ten, fewer for very short items.

    The lemma says that a region within e edits shares length - Q + 1 - Q * e grams or more;
    the budget keeps that number at one or more.
    """
    return max(0, min(length // BYTES_PER_EDIT, (length - Q) // Q))


@dataclass
class Items:
    """The grams of one part of the benchmark, as sorted codes with their places."""

    ids: list
    texts: list[bytes]
    budget: np.ndarray
    least: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray
    #: Items too short for a gram: for each length with its closing blank, sorted codes and their ids.
    short: dict[int, tuple[np.ndarray, list]]

    @classmethod
    def of(cls, rows: list[tuple]) -> "Items":
        """From (item id, text) pairs; items without letters and digits are in no document.

        Items with less than Q bytes of normal form have no gram; they are found exactly, as whole words.
        """
        if rows:
            flat, offsets = normal_form(pa.array([r[1] for r in rows], pa.string()))
        pairs = [(r[0], bytes(flat[offsets[k] : offsets[k + 1]]).strip()) for k, r in enumerate(rows)]
        short: dict[int, list] = {}
        for i, t in pairs:
            if 0 < len(t) < Q:
                short.setdefault(len(t) + 1, []).append((int.from_bytes(t + b" ", "little"), i))
        short = {n: (np.array([c for c, _ in sorted(found, key=lambda f: f[0])], np.uint64), [i for _, i in sorted(found, key=lambda f: f[0])]) for n, found in short.items()}
        pairs = [(i, t) for i, t in pairs if len(t) >= Q]
        budget = np.array([edit_budget(len(t)) for _, t in pairs], np.int64)
        length = np.array([len(t) for _, t in pairs], np.int64)
        codes = [_grams(np.frombuffer(t, np.uint8)) for _, t in pairs]
        item = np.repeat(np.arange(len(pairs)), [len(c) for c in codes])
        at = np.concatenate([np.arange(len(c)) for c in codes]) if pairs else np.zeros(0, np.int64)
        every = np.concatenate(codes) if pairs else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        unique, first = np.unique(every[order], return_index=True)
        least = np.maximum(length - Q + 1 - Q * budget, 1)
        # Grams that several items share cost most and tell least. An item may go without some of its
        # grams if as many are taken from its bound, which then still holds: up to half of the bound.
        item, at, times = item[order], at[order], np.diff(np.append(first, len(every)))
        spare, use = least // 2, np.ones(len(unique), bool)
        for k in sorted(np.flatnonzero(times > 1), key=lambda k: (-times[k], k)):
            own, uses = np.unique(item[first[k] : first[k] + times[k]], return_counts=True)
            if (spare[own] >= uses).all():
                spare[own] -= uses
                use[k] = False
        least = least - (least // 2 - spare)
        kept = np.repeat(use, times)
        first = np.concatenate([[0], np.cumsum(times[use])])
        seen = np.zeros(1 << _TABLE_BITS, bool)
        seen[_slot(unique[use])] = True
        return cls([i for i, _ in pairs], [t for _, t in pairs], budget, least, unique[use], first, item[kept], at[kept], seen, short)


def _grams(raw: np.ndarray) -> np.ndarray:
    """The Q bytes at each position as one number; no two grams share one."""
    if len(raw) < Q:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(raw)
    return np.ndarray((len(raw) - Q + 1,), "<u8", raw.data, 0, (1,)).astype(np.uint64)


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * _SPREAD) >> np.uint64(64 - _TABLE_BITS)


def banded_distance(item: bytes, region: bytes, budget: int) -> tuple[int, int] | None:
    """Least edits that turn ``item`` into a substring of ``region``, and where it ends, or None if over budget.

    Rows are item bytes; a row keeps only columns within the band that the budget leaves around
    the region's free start.
    """
    n, m = len(region), len(item)
    if m - budget > n:
        return None
    text = np.frombuffer(region, np.uint8)
    slack = max(n - m, 0) + budget  # the start is free within the region
    low, high = 0, min(n, slack)
    row = np.zeros(high - low + 1, np.int64)
    for j in range(1, m + 1):
        new_low, new_high = max(0, j - budget), min(n, j + slack)
        size = new_high - new_low + 1
        best = np.full(size, budget + 1, np.int64)
        cols = np.arange(new_low, new_high + 1)
        take = (cols >= low) & (cols <= high)
        best[take] = row[cols[take] - low] + 1  # item byte dropped
        take = (cols - 1 >= low) & (cols - 1 <= high)
        c = cols[take]
        best[take] = np.minimum(best[take], row[c - 1 - low] + (text[c - 1] != item[j - 1]))
        best = np.minimum(np.minimum.accumulate(best - np.arange(size)) + np.arange(size), budget + 1)  # region byte added
        if best.min() > budget:
            return None
        row, low, high = best, new_low, new_high
    k = int(row.argmin())
    return (int(row[k]), low + k) if row[k] <= budget else None


def find_short(items: Items, flat: np.ndarray, offsets: np.ndarray) -> list[tuple[int, object, int]]:
    """(row, item id, 0) for each row of normal-form texts and item of less than Q bytes that is in it as whole words."""
    if not items.short or not len(flat):
        return []
    starts = np.flatnonzero((flat[1:] != 32) & (flat[:-1] == 32)) + 1
    padded = np.concatenate([flat, np.zeros(Q, np.uint8)])
    codes = np.ndarray((len(flat) + 1,), "<u8", padded.data, 0, (1,))[starts]
    found = set()
    for n, (known, ids) in items.short.items():
        own = codes & np.uint64((1 << 8 * n) - 1)
        low, high = np.searchsorted(known, own), np.searchsorted(known, own, "right")
        for k in np.flatnonzero(high > low).tolist():
            row = int(np.searchsorted(offsets, starts[k], "right")) - 1
            found.update((row, ids[j], 0) for j in range(low[k], high[k]))
    return list(found)


def find(items: Items, flat: np.ndarray, offsets: np.ndarray) -> list[tuple[int, object, int]]:
    """(row, item id, edits) for each row of normal-form texts and item found in it."""
    exact = find_short(items, flat, offsets)
    if not len(items.codes) or len(flat) < Q:
        return exact
    codes = _grams(flat)
    where = np.flatnonzero(items.seen[_slot(codes)])
    k = np.minimum(np.searchsorted(items.codes, codes[where]), len(items.codes) - 1)
    hit = items.codes[k] == codes[where]
    where, k = where[hit], k[hit]
    times = items.first[k + 1] - items.first[k]
    entry = np.repeat(items.first[k] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    item, diagonal = items.item[entry], np.repeat(where, times) - items.at[entry]
    # bands begin at each multiple of budget + 1 and are twice as wide: any spread of e diagonals is inside one
    shift = max(map(len, items.texts)) + Q  # diagonals may be below 0
    band = (diagonal + shift) // (items.budget + 1)[item]
    span = len(flat) + 2 * shift + 2
    keys = np.sort(item * span + band)
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    unique, counts = keys[begins], np.diff(np.append(begins, len(keys)))
    with_next = counts.copy()
    with_next[:-1] += np.where(unique[1:] == unique[:-1] + 1, counts[1:], 0)
    enough = with_next >= items.least[unique // span]
    found: dict[tuple[int, int], int] = {}
    for key in unique[enough]:
        i, b = int(key // span), int(key % span)
        e, text = int(items.budget[i]), items.texts[i]
        begin = b * (e + 1) - shift
        lo, hi = begin - e, begin + 2 * (e + 1) + len(text) + e
        first = int(np.searchsorted(offsets, max(lo, 0), "right")) - 1
        last = int(np.searchsorted(offsets, min(hi, len(flat)) - 1, "right")) - 1
        for row in range(first, last + 1):  # a band may reach over a row's end
            if found.get((row, i)) == 0:
                continue
            region = bytes(flat[max(lo, offsets[row]) : min(hi, offsets[row + 1])])
            edits = 0 if text in region else (banded_distance(text, region, e) or (None,))[0]
            if edits is not None and edits < found.get((row, i), e + 1):
                found[row, i] = edits
    return exact + [(row, items.ids[i], edits) for (row, i), edits in found.items()]


def _parts(benchmark: DataFrame, part_chars: int) -> Iterator[Items]:
    """The distinct texts of the benchmark in parts of about ``part_chars`` characters; their ids are hashes of the text.

    The driver holds one part at a time, and a text once, however many items have it.
    """
    known = cut(benchmark.select(F.col("text").cast("string").alias("text")).filter("text is not null").distinct())
    parts = int((known.agg(F.sum(F.length("text"))).first()[0] or 0) // part_chars) + 1
    for part in range(parts):
        yield Items.of([tuple(r) for r in known.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).select(F.xxhash64("text"), "text").collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, item_id and least edits for each document that holds a benchmark item.

    An item is held if some substring of the document's normal form is within ``edit_budget``
    edits of the item's; an item of less than Q bytes if it is there as whole words. The benchmark is measured first and sent out in parts of about
    ``part_chars`` characters, one pass over the documents for each part, whatever its size.
    Null and empty texts hold nothing and are held by none; repeated rows of a document count once; a null doc_id is kept, and so is a null item_id.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema, out = "doc_id long, key long, edits int", None
    for items in _parts(benchmark, part_chars):
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches):
                hits = find(shared.value, *normal_form(piece.column("text")))
                if hits:
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array([h[0] for h in hits])), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int32())], names=["doc_id", "key", "edits"])

        found = source.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    least = out.groupBy("doc_id", "key").agg(F.min("edits").alias("edits"))
    ids = cut(benchmark.filter("text is not null").select("item_id", F.xxhash64(F.col("text").cast("string")).alias("key")).distinct())
    return join_checked(least, ids, "key").groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def clean(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The documents that hold no benchmark item (see ``leaks``); columns are kept.

    Null and empty texts hold none and stay, each of repeated rows fares alike, and an empty benchmark takes none away.
    """
    schema, names = docs.schema, docs.columns
    for items in _parts(benchmark, part_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches):
                good = np.ones(piece.num_rows, bool)
                good[[h[0] for h in find(shared.value, *normal_form(piece.column("text")))]] = False
                yield piece.filter(pa.array(good)).select(names)

        docs = docs.mapInArrow(keep, schema)
    return docs
