"""Repeated passages by a sparse suffix array over word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import join_checked
from millrace.llm.shared import cut, mix, powers, rolling_hashes, slices, stored, text_bytes, word_bounds, word_hashes

#: Words of the shortest passage that is reported.
PASSAGE = 50
#: Variants of a gram's surroundings that are extended against each other in one task, at most.
MOST_VARIANTS = 64
#: Rows that are broadcast, and places in them, at most; beyond that they are joined by shuffling.
PLACED_ROWS, PLACES = 100_000, 2_000_000
_MOST = np.uint64((1 << 64) - 1)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values, by doubling."""
    out, done = values, 1
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, the row of each, and the rows' first words."""
    raw, offsets = text_bytes(column)
    starts, ends, first = word_bounds(raw, offsets)
    return word_hashes(raw, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def anchors(words: np.ndarray, row_of: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Content-selected positions, and the hash of the gram that starts at each.

    Grams have passage // 2 + 1 words; a position is selected if its gram has the least hash of
    some run of as many grams as fit in one passage. So every run of ``passage`` words of a row
    has a selected gram wholly inside, and equal runs have it at the same place.
    """
    gram = passage // 2 + 1
    width = passage - gram + 1
    if len(words) < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = rolling_hashes(words, gram)
    least = _slide(hashes, width, np.minimum)
    whole = row_of[: len(words) - passage + 1] == row_of[passage - 1 :]
    best = np.zeros(len(hashes) + width - 1, np.uint64)
    best[width - 1 : width - 1 + len(least)] = np.where(whole, least, np.uint64(0))
    chosen = np.flatnonzero((_slide(best, width, np.maximum)[: len(hashes)] == hashes) & (hashes > 0))
    return chosen, hashes[chosen]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and text of all rows, and a key of both: rows that repeat an id, or have none, are told apart by it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def surroundings(words: np.ndarray, at: np.ndarray, before: np.ndarray, length: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes at ``at`` a hash of the words as far to both sides as passages with the gram reach, and the bits of those passages.

    ``before`` is how many words the document has before the suffix, ``length`` how many it has. Bit l of the
    second is for the passage that begins l words before the gram.
    """
    gram = passage // 2 + 1
    reach = passage - gram
    left, right = np.minimum(before, reach), np.clip(length - before - gram, 0, reach)
    up, down = powers(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])])
    run = (total[at + gram + right] - total[at - left]) * down[at - left]
    starts = np.arange(reach + 1)
    whole = ((starts <= left[:, None]) & (reach - starts <= right[:, None])) @ (np.int64(1) << starts)
    return mix(run + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), whole


def sparse_suffixes(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """key, doc_id, n_words, digest, and of the selected suffixes gram hashes, positions, variants and bits (``surroundings``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, row_of, first = _words(part.column("text"))
            at, grams = anchors(words, row_of, passage)
            bounds = np.searchsorted(at, first)
            place = (np.arange(len(words)) - first[row_of]).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
            one = np.concatenate([[np.uint64(0)], np.cumsum(mix(words + place * np.uint64(0x9E3779B97F4A7C15)))])
            digest = one[first[1:]] - one[first[:-1]]
            local = at - first[row_of[at]] if len(at) else np.zeros(0, np.int64)
            variant, whole = surroundings(words, at, local, np.diff(first)[row_of[at]], passage) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            ends = pa.array(bounds.astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (grams.view(np.int64), local.astype(np.int32), variant.view(np.int64), whole.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(np.diff(first)), pa.array(digest.view(np.int64)), *lists], names=["key", "doc_id", "n_words", "digest", "grams", "places", "variants", "wholes"])

    return _rows(docs).mapInArrow(run, "key long, doc_id long, n_words long, digest long, grams array<long>, places array<int>, variants array<long>, wholes array<int>")


_SUFFIX = "gram long, key long, place int, variant long, whole int, kind string"


def repeated_suffixes(suffixes: DataFrame) -> DataFrame:
    """The suffixes (gram, key, place, variant, whole) whose gram occurs again.

    The suffixes are sorted over the cluster by (gram, variant, key, place) and neighbours compared.
    A gram that many documents share is spread over several sorted runs. A suffix alone with its
    gram in its run can have equals in other runs only if it is the run's first or last; these
    edges, two a run, are matched among all runs afterwards.
    """
    names = ["gram", "key", "place", "variant", "whole"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(rows: pa.RecordBatch, kind: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array([kind] * rows.num_rows, pa.string())], names=[*names, "kind"])

        held = None  # the last row: its gram, the row, whether it equals the row before, whether it is the run's first
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(names)
            g = batch.column("gram").to_numpy(zero_copy_only=False)
            before = np.empty(len(g), bool)
            before[0] = held is not None and held[0] == g[0]
            before[1:] = g[1:] == g[:-1]
            if held is not None:
                kind = "again" if held[2] or before[0] else "edge" if held[3] else None
                if kind:
                    yield marked(held[1], kind)
            hit = before[:-1] | before[1:]
            if hit.any():
                yield marked(batch.slice(0, len(g) - 1).filter(pa.array(hit)), "again")
            if held is None and len(g) > 1 and not before[1]:
                yield marked(batch.slice(0, 1), "edge")
            held = (g[-1], batch.slice(len(g) - 1, 1), bool(before[-1]), held is None and len(g) == 1)
        if held is not None:
            yield marked(held[1], "again" if held[2] else "edge")

    order = ["gram", "variant", "key", "place"]
    runs = suffixes.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(runs.mapInArrow(compare, _SUFFIX), "repeated")
    edges = cut(found.filter("kind = 'edge'").groupBy("gram").agg(F.count(F.lit(1)).alias("_edges")))
    grams = found.filter("kind = 'again'").select("gram").distinct()  # a hot gram is one row before it meets the edges
    inner = join_checked(grams, edges.select("gram"), "gram").withColumn("_inner", F.lit(True))
    known = edges.join(inner, "gram", "left").filter("_edges > 1 or _inner").select("gram")
    return found.filter("kind = 'again'").select(*names).unionByName(found.filter("kind = 'edge'").join(known, "gram").select(*names))


def _around(docs: DataFrame, places: DataFrame, passage: int, runs: bool) -> DataFrame:
    """What is around the suffixes of ``places`` (gram, variant, key, place).

    With ``runs`` a row for each passage with the gram: variant, l (it begins l words before the gram), hash.
    Without, a row a suffix: gram, variant, left and right, 32-bit hashes of the words before the gram, the nearest
    first, and of those after it, as far as a passage with the gram inside can reach and the document goes.
    """
    gram = passage // 2 + 1
    reach = passage - gram
    per = places.groupBy("key").agg(F.collect_list(F.struct("place", "gram", "variant")).alias("found"))
    chosen = join_checked(_rows(docs), per, "key", most=PLACED_ROWS if places.count() <= PLACES else 0)
    span = np.arange(reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, row_of, first = _words(part.column("text"))
            lists = part.column("found")
            flat = lists.flatten()
            place, grams, variant = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "gram", "variant"))
            owner = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
            at = first[owner] + place
            n_left, n_right = np.minimum(place, reach), np.clip(np.diff(first)[owner] - place - gram, 0, reach)
            if runs:
                starts = np.arange(reach + 1)
                row, l = np.nonzero((starts <= n_left[:, None]) & (reach - starts <= n_right[:, None]))
                code = mix(rolling_hashes(words, passage)[at[row] - l] + grams.view(np.uint64)[row] * np.uint64(3) + l.astype(np.uint64)) if len(row) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(variant[row]), pa.array(l.astype(np.int8)), pa.array(code.view(np.int64))], names=["variant", "l", "hash"])
                continue
            short = (words >> np.uint64(32)).astype(np.uint32).view(np.int32)
            sides = []
            for count, base, step in ((n_left, at - 1, -1), (n_right, at + gram, 1)):
                use = span < count[:, None]
                sides.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(short[(base[:, None] + step * span)[use]])))
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(variant), *sides], names=["gram", "variant", "left", "right"])

    return chosen.select("key", "text", "found").mapInArrow(run, "variant long, l byte, hash long" if runs else "gram long, variant long, left array<int>, right array<int>")


def extend(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, reach: int) -> np.ndarray:
    """For each variant of one gram which passages with the gram inside another variant has too, as bits.

    Bit l is for the passage that begins l words before the gram. Each pair of variants is extended from the gram to the
    left and to the right until their words differ; they share the passages within.
    """
    m, span = len(left), np.arange(reach)

    def common(words: np.ndarray, number: np.ndarray) -> np.ndarray:
        both = np.minimum(number[:, None], number[None, :])
        same = (words[:, None, :] == words[None, :, :]) & (span < both[:, :, None])
        return np.cumprod(same, axis=2).sum(2) if reach else both

    far_left, far_right = common(left, n_left), common(right, n_right)
    bits, other = np.zeros(m, np.int64), ~np.eye(m, dtype=bool)
    for k in range(reach + 1):
        bits |= ((far_left >= k) & (far_right >= reach - k) & other).any(1).astype(np.int64) << k
    return bits


def shared_passages(docs: DataFrame, found: DataFrame, passage: int) -> DataFrame:
    """variant, bits: the passages around each variant of a gram that occur at two places or more (see ``extend``).

    Equal surroundings are counted before a gram's variants meet, so a hot passage with one surrounding is one row; what
    is around a variant that occurs twice is repeated as it is. Of grams with several variants one place of each is looked at
    again for its words; the variants are sorted and extended against each other; of a gram with more than
    MOST_VARIANTS, each passage of each variant is counted by its hash instead, which spreads them.
    """
    reach = passage - (passage // 2 + 1)
    each = cut(found.groupBy("gram", "variant").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("_at"), F.first("whole").cast("long").alias("whole")))
    size = cut(each.groupBy("gram").agg(F.count(F.lit(1)).alias("_v")).filter("_v > 1"))
    copies = each.filter("n > 1").select("variant", F.col("whole").alias("bits"))
    places = cut(join_checked(each.filter("whole <> 0"), size, "gram", most=PLACED_ROWS).select("gram", "variant", "_at.key", "_at.place", "_v"))
    few = _around(docs, places.filter(F.col("_v") <= MOST_VARIANTS), passage, runs=False)
    many = _around(docs, places.filter(F.col("_v") > MOST_VARIANTS), passage, runs=True)

    def wide(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        number = np.asarray(column.value_lengths()).astype(np.int64)
        out = np.zeros((len(column), reach), np.int32)
        out[np.arange(reach) < number[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out, number

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, found = None, []

        def close() -> None:
            variant = np.concatenate([p.column("variant").to_numpy(zero_copy_only=False) for p in held])
            (a, na), (b, nb) = ([np.concatenate(x) for x in zip(*(wide(p.column(c)) for p in held))] for c in ("left", "right"))
            found.append((variant, extend(a, b, na, nb, reach)))
            held.clear()

        def lines() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["variant", "bits"])
            found.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and gram[a] != last:
                    close()
                held.append(batch.slice(a, b - a))
                last = gram[a]
            if found:
                yield lines()
        if held:
            close()
            yield lines()

    compared = few.repartition("gram").sortWithinPartitions("gram", "right", "left").select("gram", "variant", "left", "right").mapInArrow(pairs, "variant long, bits long")
    again = many.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("hash")
    counted = many.join(again, "hash").groupBy("variant").agg(F.sum(F.expr("shiftleft(1L, cast(l as int))")).alias("bits"))
    return copies.unionByName(compared).unionByName(counted).filter("bits <> 0").groupBy("variant").agg(F.bit_or("bits").alias("bits"))


def _spans(hits: DataFrame, passage: int) -> DataFrame:
    """key, spans: the merged word ranges of the passages given by (key, place, bits)."""
    reach = passage - (passage // 2 + 1)
    per = hits.groupBy("key").agg(F.collect_list(F.struct("place", "bits")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for found in batch.column("found"):
                flat = found.values
                place, bits = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "bits"))
                starts = np.unique((place[:, None] - np.arange(reach + 1))[(bits[:, None] >> np.arange(reach + 1) & 1).astype(bool)])
                breaks = np.flatnonzero(np.diff(starts) > passage)
                begins, ends = starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])] + passage
                spans.append([{"first": int(a), "last": int(b)} for a, b in zip(begins, ends)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], names=["key", "spans"])

    return per.mapInArrow(run, "key long, spans array<struct<first:int,last:int>>")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """doc_id, spans, n_repeated, n_words of each document with a repeated passage.

    ``spans`` are the merged word ranges [first, last) covered by runs of ``passage`` words
    (``[^\\x20\\x09-\\x0D]+``, compared byte by byte) that occur at two places or more of the
    corpus; ``n_repeated`` is the number of words in them.

    1. Documents with equal word sequences become one; each of them is repeated as a whole.
    2. Suffixes are kept at content-selected minimiser positions only (``anchors``), sorted, and
       compared with their neighbours (``repeated_suffixes``).
    3. Suffixes that match are extended to the left and to the right word by word (``extend``), and
       the passages that they share are joined to maximal spans.

    Null, empty and shorter texts have no passages; rows without doc_id are compared with the
    others and not reported; rows that repeat an id are places of their own, and the spans of
    its different texts are reported together, each in the words of its own text.
    """
    table = stored(sparse_suffixes(docs, passage), "suffixes")
    alike = table.groupBy("n_words", "digest").agg(F.min("key").alias("keep"), F.count(F.lit(1)).alias("copies")).filter(f"copies > 1 and n_words >= {int(passage)}")
    alike = cut(table.select("key", "doc_id", "n_words", "digest").join(alike.hint("shuffle_hash"), ["n_words", "digest"]))
    others = alike.filter("key <> keep").select("key").distinct()
    zipped = F.explode(F.arrays_zip("grams", "places", "variants", "wholes")).alias("_s")
    suffixes = join_checked(table.filter(F.size("grams") > 0), others, "key", "left_anti").select("key", zipped).select(F.col("_s.grams").alias("gram"), "key", F.col("_s.places").alias("place"), F.col("_s.variants").alias("variant"), F.col("_s.wholes").alias("whole"))
    found = repeated_suffixes(suffixes)
    bits = cut(shared_passages(docs, found, passage))
    hits = join_checked(found.select("key", "place", "variant"), bits, "variant", most=PLACED_ROWS).select("key", "place", "bits").distinct()
    per = _spans(hits, passage).join(alike.select("key").distinct(), "key", "left_anti")
    named = table.filter("doc_id is not null").select("key", "doc_id").distinct()
    whole = alike.filter("doc_id is not null").select("doc_id", "n_words", "digest").distinct()
    whole = whole.select("doc_id", F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last"))).alias("spans"))
    spans = per.join(named, "key").select("doc_id", "spans").unionByName(whole).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    out = spans.join(table.groupBy("doc_id").agg(F.max("n_words").alias("n_words")), "doc_id")
    return out.select("doc_id", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["last"] - s["first"]).alias("n_repeated"), "n_words")
