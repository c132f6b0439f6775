"""Token counts as delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import slices
from millrace.llm.tokenize import Units, default_path, memo

#: What totals are kept by, and what is added up.
KEYS = ("source", "lang", "tokenizer")
MEASURES = ("n_docs", "n_tokens", "n_chars")
_SCHEMA = T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), *(T.StructField(m, T.LongType()) for m in MEASURES)])


def counted(docs: DataFrame, tokenizers: dict[str, str], text: str = "text", again: str | None = None) -> DataFrame:
    """A row per document row and tokenizer version: doc_id, KEYS, n_tokens, n_chars.

    ``tokenizers`` maps a version to the file of its vocabulary; tokens are those of the whole text by
    it. With a column ``again`` each row also has n_again and chars_again, the counts of the text there, null
    where it is null. Null text has no tokens and no characters; null source or lang are groups
    of their own; rows that repeat an id are counted each. The text is read and cut once for all versions.
    """
    names = ["doc_id", "source", "lang"]
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            old, chars = Units.of(part.column("text")), pc.fill_null(pc.utf8_length(part.column("text")), 0).cast(pa.int64())
            if again:
                new, new_chars = Units.of(part.column("again")), pc.utf8_length(part.column("again")).cast(pa.int64())
                missing = np.asarray(part.column("again").is_null())
            for version, path in tokenizers.items():
                encoder = memo(path)
                columns = [*(part.column(c) for c in names), pa.array([version] * part.num_rows), pa.array(encoder.count_ids(old)), chars]
                if again:
                    columns += [pa.array(encoder.count_ids(new), mask=missing), new_chars]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "tokenizer", "n_tokens", "n_chars", "n_again", "chars_again"][: len(columns)])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), F.col(text).cast("string").alias("text")]
    if again:
        columns.append(F.col(again).cast("string").alias("again"))
    return docs.select(*columns).mapInArrow(count, schema + (", n_again long, chars_again long" if again else ""))


def _signed(rows: DataFrame, sign: int, tokens: Column | str = "n_tokens", chars: Column | str = "n_chars", docs: int | None = None) -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(*KEYS, F.lit(sign if docs is None else docs).cast("long").alias("n_docs"), (sign * as_column(tokens)).cast("long").alias("n_tokens"), (sign * as_column(chars)).cast("long").alias("n_chars"))


def inserts(rows: DataFrame) -> DataFrame:
    """Signed changes of documents that are new."""
    return _signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    """Signed changes of documents that go, with the counts they had."""
    return _signed(rows, -1)


def revisions(rows: DataFrame, new_tokens: str, new_chars: str = "n_chars") -> DataFrame:
    """Signed changes of documents counted anew: the old counts go, the new ones come, documents stay."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col(new_tokens) - F.col("n_tokens")).cast("long").alias("n_tokens"), (F.col(new_chars) - F.col("n_chars")).cast("long").alias("n_chars"))


class Rollup:
    """Totals by KEYS, kept as one small table of summed changes for each committed batch.

    A batch is committed by writing the sums of its changes to a folder of its own name; Spark's
    job commit puts the success mark last, so a batch counts wholly or not at all, and a batch
    whose mark is there is not written again: commits may be repeated after any failure. Several writers may commit batches of
    different names, and compact, at the same time; two that commit one name at once must not have different changes.
    Measures are additive, so batches may come in any order, deletes before the inserts that they undo too. ``compact`` folds all batches into
    one snapshot that lists their names; a batch in a snapshot stays committed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, name: str) -> list[str]:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n for n in found if fs.exists(self._path(name, n, "_SUCCESS")))

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The newest snapshot and the batches that it holds."""
        names = self._children("snapshots")
        if not names:
            return None, set()
        listed = self.spark.read.text(f"{self.folder}/members/{names[-1]}").collect()
        return names[-1], set(json.loads(listed[0][0]))

    def batches(self) -> set[str]:
        """Names of all committed batches."""
        return self._snapshot()[1] | set(self._children("batches"))

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Add up ``changes`` as one batch; False and no work if that batch is committed already."""
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        rows = reduce(DataFrame.unionByName, changes)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        sums.coalesce(8).write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}")
        return True

    def _state(self) -> tuple[str | None, set[str], list[str]]:
        """The newest snapshot, the batches in it, and the committed batches beside it, as of one listing."""
        snapshot, members = self._snapshot()
        return snapshot, members, [b for b in self._children("batches") if b not in members]

    def _sums(self, snapshot: str | None, others: list[str]) -> DataFrame | None:
        """KEYS and MEASURES over a snapshot and the batches beside it, whatever their signs; None without any."""
        paths = [f"{self.folder}/batches/{b}" for b in others]
        paths += [f"{self.folder}/snapshots/{snapshot}"] if snapshot else []
        if not paths:
            return None
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])

    def totals(self) -> DataFrame:
        """KEYS and MEASURES over all committed batches; groups without documents are left out."""
        snapshot, _, others = self._state()
        sums = self._sums(snapshot, others)
        return self.spark.createDataFrame([], _SCHEMA) if sums is None else sums.filter("n_docs > 0")

    def compact(self) -> str | None:
        """Fold all batches into a new snapshot; its name, or None if nothing is committed.

        One listing says both what is summed and what the snapshot names as its members, so a batch that is committed meanwhile
        is beside the snapshot and counts once.
        """
        snapshot, held, others = self._state()
        members = sorted(held | set(others))
        if not members:
            return None
        old = self._children("snapshots")
        name = f"{len(old):08d}-{uuid.uuid4().hex[:8]}"
        self.spark.createDataFrame([(json.dumps(members),)], "value string").coalesce(1).write.text(f"{self.folder}/members/{name}")
        rows = self._sums(snapshot, others).filter(" or ".join(f"{m} <> 0" for m in MEASURES))
        rows.coalesce(8).write.parquet(f"{self.folder}/snapshots/{name}")
        return name


def versions() -> dict[str, str]:
    """The query's two tokenizer versions, and the files of their vocabularies."""
    return {"byte-50k": default_path(), "multi-50k": default_path("byte_bpe_multi_50k.tiktoken")}


#: Characters that a document labelled as poor loses before it is counted anew.
SYMBOLS = "[#*$%&|<>]+"
