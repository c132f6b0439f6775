"""Staged scoring of documents' chunks: one head after the other, each only where it has not been, safe to repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.text import portions

#: Chunks that a model gets at once.
BATCH = 32
_SCORED = "array<struct<label:string,score:double>>"


class HeadStore:
    """Documents with their chunks in one table, and what each head says of them in a table of its own.

    A head adds a table of (key, one label and score a chunk) for the documents that it has not scored; nothing that is there
    is written again, a run that fails leaves no part of it, and one that is repeated finds nothing to do. ``documents`` joins all
    heads by key into nested chunks with stage flags; if two runs have scored a document, one result stands.
    """

    def __init__(self, spark: SparkSession, path: str, heads: tuple[str, ...], key: str = "doc_id"):
        self.spark, self.path, self.heads, self.key = spark, path.rstrip("/"), heads, key

    def _there(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def create(self, documents: DataFrame) -> None:
        """Store ``documents``: the key, ``chunks`` (array of structs with ``text``), and any other columns."""
        documents.write.parquet(f"{self.path}/documents")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def _head(self, head: str) -> DataFrame | None:
        where = f"{self.path}/head={head}"
        if not self._there(where):
            return None
        return self.spark.read.parquet(where).groupBy(self.key).agg(F.min("scored").alias("scored"))

    def pending(self, head: str) -> DataFrame:
        """Documents that the heads before have scored and this one has not; the order of ``heads`` is strict."""
        todo, at = self._stored(), self.heads.index(head)
        if at:
            before = self._head(self.heads[at - 1])
            todo = todo.limit(0) if before is None else todo.join(before.select(self.key), self.key, "left_semi")
        done = self._head(head)
        return todo if done is None else todo.join(done.select(self.key), self.key, "left_anti")

    def run(self, head: str, model: Callable[[pd.Series], pd.DataFrame]) -> int:
        """Score what is pending with ``model`` (texts to label and score), BATCH chunks at a time; the number of documents scored.

        A batch in which the model fails stays without labels; null texts are empty.
        """
        schema = f"`{self.key}` {dict(self._stored().dtypes)[self.key]}, scored {_SCORED}"

        def judged(texts: list[str]) -> list[tuple]:
            out: list[tuple] = []
            for k in range(0, len(texts), BATCH):
                part = pd.Series(texts[k : k + BATCH], dtype=object)
                try:
                    found = model(part)
                    out += [(label, None if pd.isna(score) else float(score)) for label, score in zip(found["label"], found["score"])]
                except RuntimeError:  # the batch did not fit the model
                    out += [(None, None)] * len(part)
            return out

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in portions(batches):
                texts = part.column(1)
                found = judged([t or "" for t in texts.flatten().to_pylist()])
                pairs = pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["label", "score"])
                ends = np.concatenate([[0], np.cumsum(np.asarray(texts.value_lengths().fill_null(0)))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=[part.schema.names[0], "scored"])

        todo = self.pending(head).filter(F.col(self.key).isNotNull()).select(self.key, F.transform("chunks", lambda c: c["text"]).alias("_texts"))
        if todo.isEmpty():
            return 0
        before = self._head(head)
        n = 0 if before is None else before.count()
        todo.mapInArrow(score, schema).write.mode("append").parquet(f"{self.path}/head={head}")
        return self._head(head).count() - n

    def documents(self) -> DataFrame:
        """All documents: chunks with ``<head>_label`` and ``<head>_score``, and a flag ``<head>_analyzed`` for each head."""
        out = self._stored()
        fields = out.schema["chunks"].dataType.elementType.fieldNames()
        for head in self.heads:
            done = self._head(head)
            scored = F.lit(None).cast(_SCORED).alias(f"_{head}")
            out = out.withColumn(f"_{head}", scored) if done is None else out.join(done.select(self.key, F.col("scored").alias(f"_{head}")), self.key, "left")
        merged = F.transform("chunks", lambda c, i: F.struct(*[c[f].alias(f) for f in fields], *[F.get(f"_{h}", i)[k].alias(f"{h}_{k}") for h in self.heads for k in ("label", "score")]))
        return out.withColumn("chunks", merged).select("*", *[F.col(f"_{h}").isNotNull().alias(f"{h}_analyzed") for h in self.heads]).drop(*[f"_{h}" for h in self.heads])
