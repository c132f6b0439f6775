"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse index, Bloom filter, footer.

A shard holds documents in ascending key order::

    block*  index  bloom  footer

A block is a compressed run of entries ``shared, rest, key tail, count, ids``: how many bytes of
the key are those of the entry before (the first entry of a block shares none), the other key
bytes, the number of ids, and the ids in the shard's fixed width. The index has, for each block,
its first key, place, sizes, entries and ids before it. The Bloom filter holds all keys. The
footer has fixed size, the places of both, the totals, and a checksum.

Keys are document ids as 8 bytes, big-endian with the sign bit turned, so that byte order is
number order; a null id is the empty key, which comes first.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import fresh_path, slices
from millrace.llm.tokenize import default_path, memo

MAGIC = b"MRSST001"
#: Bytes of a block before compression, about.
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 2
_FOOTER = struct.Struct("<QQQQQQBBI8s")  # index at, its size, bloom at, its size, entries, ids, width, hashes, crc32 of index and bloom, magic


def key_of(doc_id: int | None) -> bytes:
    """The key of a document id."""
    return b"" if doc_id is None else struct.pack(">Q", (int(doc_id) + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    """The document id of a key."""
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _key_hash(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    one = np.array([zlib.crc32(k) for k in keys], np.uint64)
    two = np.array([zlib.crc32(k, 0x5BD1E995) | 1 for k in keys], np.uint64)
    return one, two


class Writer:
    """Writes one shard; keys must come in ascending order (equal keys may follow each other)."""

    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.at = self.entries = self.ids = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._start_block()

    def _start_block(self) -> None:
        self.parts: list[bytes] = []
        self.size = self.in_block = self.block_ids = 0
        self.first_key = self.last_key = b""

    def add(self, key: bytes, ids: bytes, count: int) -> None:
        shared = 0
        if self.in_block:
            top = min(len(key), len(self.last_key))
            while shared < top and key[shared] == self.last_key[shared]:
                shared += 1
        else:
            self.first_key = key
        entry = bytes([shared, len(key) - shared]) + key[shared:] + _varint(count)
        self.parts += (entry, ids)
        self.size += len(entry) + len(ids)
        self.in_block += 1
        self.block_ids += count
        self.last_key = key
        self.keys.append(key)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        packed = pa.compress(b"".join(self.parts), codec="zstd", asbytes=True)
        self.sink.write(packed)
        self.index.append(bytes([len(self.first_key)]) + self.first_key + b"".join(map(_varint, (self.at, len(packed), self.size, self.in_block, self.ids))))
        self.at += len(packed)
        self.entries += self.in_block
        self.ids += self.block_ids
        self._start_block()

    def close(self) -> tuple[int, int]:
        """Write index, Bloom filter and footer; entries and ids of the shard."""
        self._flush()
        index = pa.compress(raw := _varint(len(self.index)) + b"".join(self.index), codec="zstd", asbytes=True)
        index = _varint(len(raw)) + index
        bits = max(64, BLOOM_BITS * len(self.keys))
        field = np.zeros((bits + 7) // 8 * 8, bool)
        one, two = _key_hash(self.keys)
        for k in range(BLOOM_HASHES):
            field[(one + np.uint64(k) * two) % np.uint64(len(field))] = True
        bloom = np.packbits(field).tobytes()
        self.sink.write(index + bloom)
        self.sink.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, self.width, BLOOM_HASHES, zlib.crc32(bloom, zlib.crc32(index)), MAGIC))
        return self.entries, self.ids


@dataclass
class Block:
    """One line of the sparse index."""

    key: bytes
    at: int
    packed: int
    size: int
    entries: int
    ids_before: int


class Reader:
    """Looks up and scans one shard through a seekable file; holds index and Bloom filter only."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.entries, self.ids, self.width, self.hashes, crc, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: wrong magic")
        source.seek(index_at)
        index, bloom = source.read(index_size), source.read(bloom_size)
        if zlib.crc32(bloom, zlib.crc32(index)) != crc:
            raise ValueError("damaged shard: index or Bloom filter")
        self.bits = np.unpackbits(np.frombuffer(bloom, np.uint8))
        raw_size, at = _read_varint(index, 0)
        raw = pa.decompress(index[at:], decompressed_size=raw_size, codec="zstd", asbytes=True)
        n, at = _read_varint(raw, 0)
        self.blocks: list[Block] = []
        for _ in range(n):
            key = raw[at + 1 : at + 1 + raw[at]]
            at += 1 + raw[at]
            numbers = []
            for _ in range(5):
                x, at = _read_varint(raw, at)
                numbers.append(x)
            self.blocks.append(Block(key, *numbers))

    def _entries(self, block: Block) -> Iterator[tuple[bytes, np.ndarray]]:
        self.source.seek(block.at)
        raw = pa.decompress(self.source.read(block.packed), decompressed_size=block.size, codec="zstd", asbytes=True)
        at, key, kind = 0, b"", np.dtype("<u2" if self.width == 2 else "<u4")
        for _ in range(block.entries):
            shared, rest = raw[at], raw[at + 1]
            key = key[:shared] + raw[at + 2 : at + 2 + rest]
            count, at = _read_varint(raw, at + 2 + rest)
            yield key, np.frombuffer(raw, kind, count, at)
            at += count * self.width

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        """All entries in order, a block at a time."""
        for block in self.blocks:
            yield from self._entries(block)

    def may_contain(self, key: bytes) -> bool:
        """False only if the key is not in the shard."""
        one, two = _key_hash([key])
        return all(self.bits[int((one[0] + np.uint64(k) * two[0]) % np.uint64(len(self.bits)))] for k in range(self.hashes))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of all entries with a key: Bloom filter, binary search in the index, block scan."""
        if not self.may_contain(key):
            return []
        k = max(bisect_right([b.key for b in self.blocks], key) - 1, 0)
        while k and self.blocks[k].key == key:  # a run of equal keys may begin in an earlier block
            k -= 1
        found = []
        for block in self.blocks[k:]:
            if block.key > key:
                break
            found += [ids for name, ids in self._entries(block) if name == key]
        return found


def open_shard(path: str) -> Reader:
    """Open a shard by its path or URI."""
    store, inner = _store(path)
    return Reader(store.open_input_file(inner))


def _store(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text and write shards in ascending doc_id order; the manifest of the shards.

    Documents are dealt by ranges of (doc_id, text hash), so that one repeated id cannot fill a
    task; each task sorts its range and streams it into one file, which gets its name only when
    it is whole: a lost or repeated task leaves nothing half written. Null text encodes as empty;
    each document ends with ``end_id``; null ids come first; repeated rows are all kept.
    The manifest (one row a shard, ascending) is collected: shard, path, entries, ids, first, last (least and largest doc_id).
    """
    tokenizer = tokenizer or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, inner = _store(folder)
        store.create_dir(inner, recursive=True)
        encoder, writer, sink = memo(tokenizer), None, None
        width = 2 if encoder.vocabulary <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], "<u2" if width == 2 else "<u4").tobytes()
        draft, final = f"{inner}/.draft-{task.partitionId():06d}-{task.taskAttemptId()}", f"{inner}/shard-{task.partitionId():06d}.sst"
        first = last = None
        for part in slices(batches):
            keys = part.column("doc_id").to_pylist()
            if writer is None:
                sink = store.open_output_stream(draft)
                writer, first = Writer(sink, width), keys[0]
            last = keys[-1]
            ids, bounds = encoder.encode_column(part.column("text"))
            raw, at = ids.astype("<u2" if width == 2 else "<u4").tobytes(), (bounds * width).tolist()
            for doc_id, a, b in zip(keys, at, at[1:]):
                writer.add(key_of(doc_id), raw[a:b] + end, (b - a) // width + 1)
        if writer is not None:
            entries, total = writer.close()
            sink.close()
            store.move(draft, final)
            row = [task.partitionId(), f"{folder}/shard-{task.partitionId():06d}.sst", entries, total, first, last]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 4))], names=["shard", "path", "entries", "ids", "first", "last"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    shape = "shard int, path string, entries long, ids long, first long, last long"
    manifest = sorted(map(tuple, rows.mapInArrow(write, shape).collect()), key=lambda r: r[0])
    return docs.sparkSession.createDataFrame(manifest, shape)


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read all shards back: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The starts of the shards are running sums over the manifest, which has a row a shard.
    """
    spark, rows, before = manifest.sparkSession, [], 0
    for r in manifest.orderBy("shard").collect():
        rows.append((r["path"], before))
        before += r["ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                out: list[tuple] = []
                for key, ids in open_shard(path).scan():
                    out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 4096:
                        yield _lines(out)
                        out = []
                if out:
                    yield _lines(out)

    parts = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)))
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def tokens_table(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` and read them back: a row a document, see ``read_shards``.

    Null and empty texts have the end id only; null ids come first; rows that repeat are all kept,
    in the order of their texts' hashes; no documents give no shards and no rows. Other columns are ignored.
    """
    folder = folder or fresh_path(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, folder, tokenizer))


def lookup(manifest: DataFrame, doc_ids: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """The ids of some documents: a binary search for their shards, then each shard's Bloom filter and index.

    A document that is in no shard has no entry in its list; one that repeats has several.
    """
    shards = [(key_of(r["first"]), key_of(r["last"]), r["path"]) for r in manifest.orderBy("shard").collect()]
    lasts, opened, found = [s[1] for s in shards], {}, {}
    for doc_id in doc_ids:
        key, found[doc_id] = key_of(doc_id), []
        for first, _, path in shards[bisect_left(lasts, key) :]:
            if first > key:
                break
            if path not in opened:
                opened[path] = open_shard(path)
            found[doc_id] += opened[path].get(key)
    return found
