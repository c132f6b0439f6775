"""A data source for caches of documents: JSON files below a folder, with lineage, error rows and pruning by year."""

from __future__ import annotations

import json
import operator
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

SCHEMA = "pdf_path string, company string, company_id string, year int, language string, chunks array<struct<chunk_id:string,text:string>>, _source_file string, _error string"
_FIELDS = ("pdf_path", "company", "company_id", "year", "language")
_ARROW = pa.schema([("pdf_path", pa.string()), ("company", pa.string()), ("company_id", pa.string()), ("year", pa.int32()), ("language", pa.string()), ("chunks", pa.list_(pa.struct([("chunk_id", pa.string()), ("text", pa.string())]))), ("_source_file", pa.string()), ("_error", pa.string())])
#: A year in a path: ``year=2019`` or ``_2019_``; files of a year that the filter rules out are not opened.
_YEAR = re.compile(r"(?:year=|_)((?:19|20)\d\d)(?=[_/.]|$)")
#: Ends of lines; others that Python knows, as U+2028, may be in the texts.
_LINE = re.compile(r"\r\n?|\n")
#: Bytes of files that one partition reads, about.
PART_BYTES = 32 << 20


def local_path(path: str) -> str:
    """The path that Python opens, for plain paths and file: URLs; other stores are an error."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        raise ValueError(f"{path}: use scan_cache, which reads other stores through Spark")
    return path


def year_of(path: str) -> int | None:
    """The year that a path states, if any."""
    found = _YEAR.findall(path)
    return int(found[-1]) if found else None


def records(content: str) -> Iterator[tuple[dict | None, str | None]]:
    """Documents of a file (one, a list, or one a line), each with its error; a broken line spoils no other, an empty file has none."""
    if not content.strip():
        return
    try:
        whole = json.loads(content)
        found = [(d, None) for d in (whole if isinstance(whole, list) else [whole])]
    except ValueError as error:
        if "\n" not in content.strip():
            yield None, f"{type(error).__name__}: {error}"
            return
        found = []
        for number, line in enumerate(_LINE.split(content), 1):
            if line.strip():
                try:
                    found.append((json.loads(line), None))
                except ValueError as bad:
                    found.append((None, f"line {number}: {bad}"))
    for document, error in found:
        yield (document, error) if error or isinstance(document, dict) else (None, "not an object")


def row(document: dict | None, error: str | None, name: str) -> dict:
    """A row of SCHEMA; a value of the wrong kind is an error row too. Without chunk ids they are ``chunk_000`` and so on."""
    try:
        out = {f: document.get(f) if document else None for f in _FIELDS}
        out = {f: v if v is None else int(v) if f == "year" else str(v) for f, v in out.items()}
        texts = (document or {}).get("chunks")
        ids = (document or {}).get("chunk_ids") or []
        chunks = None if texts is None else [{"chunk_id": t.get("chunk_id") or f"chunk_{k:03d}", "text": t.get("text")} if isinstance(t, dict) else {"chunk_id": ids[k] if k < len(ids) else f"chunk_{k:03d}", "text": t} for k, t in enumerate(texts)]
        return out | {"chunks": chunks, "_source_file": name, "_error": error}
    except (TypeError, ValueError) as bad:
        return dict.fromkeys(_FIELDS) | {"chunks": None, "_source_file": name, "_error": f"{type(bad).__name__}: {bad}"}


_COMPARE = {"EqualTo": operator.eq, "LessThan": operator.lt, "LessThanOrEqual": operator.le, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "In": lambda y, v: y in v}


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = local_path(options["path"]), options.get("suffix", ".json")
        self.tests = [("LessThan", int(options["before"]))] if options.get("before") else []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of the year prune files; Spark applies all of them to the rows as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("year",) and type(f).__name__ in _COMPARE:
                self.tests.append((type(f).__name__, f.value))
            yield f

    def wanted(self, path: str) -> bool:
        year = year_of(path)
        return year is None or all(_COMPARE[kind](year, value) for kind, value in self.tests)

    def partitions(self) -> list[_Files]:
        """Files by name, put together to about PART_BYTES."""
        found = sorted(os.path.join(at, n) for at, _, names in os.walk(self.folder) for n in names if n.endswith(self.suffix) and not n.startswith(("_", ".")))
        out, size = [], PART_BYTES
        for path in found:
            if not self.wanted(path[len(self.folder) :]):
                continue
            if size >= PART_BYTES:
                out.append([])
                size = 0
            out[-1].append(path)
            size += os.path.getsize(path)
        return [_Files(p) for p in out] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            name = os.path.relpath(path, self.folder)
            try:
                with open(path, encoding="utf-8") as file:
                    content = file.read()
                rows = [row(d, e, name) for d, e in records(content)]
            except (OSError, UnicodeDecodeError) as error:
                rows = [row(None, f"{type(error).__name__}: {error}", name)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


class DocumentCache(DataSource):
    """``spark.read.format("document_cache").load(folder)``; option ``suffix`` chooses files by the end of their names.

    A year in a path is that of the documents below it; option ``before`` and filters on ``year`` leave out files by it without opening them.
    """

    @classmethod
    def name(cls) -> str:
        return "document_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan_cache(spark: SparkSession, path: str, suffix: str = ".json", before: int | None = None) -> DataFrame:
    """All documents of a cache, of years before ``before`` or without a year; broken files and lines are rows with ``_error``.

    Folders that executors can open are read by the data source; of other stores Spark reads the files, and the same rows come of them.
    """
    try:
        local_path(path)
        spark.dataSource.register(DocumentCache)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        found = spark.read.format("document_cache").options(suffix=suffix, before="" if before is None else str(before)).load(path)
    except ValueError:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).select("path", "content")

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    try:
                        rows = [row(d, e, name) for d, e in records(content.decode())]
                    except UnicodeDecodeError as error:
                        rows = [row(None, f"{type(error).__name__}: {error}", name)]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)

        root = re.escape(path.rstrip("/")) + "/"
        found = files.mapInArrow(parse, SCHEMA).withColumn("_source_file", F.regexp_replace("_source_file", f"^{root}", ""))
    return found if before is None else found.filter(F.col("year").isNull() | (F.col("year") < before))
