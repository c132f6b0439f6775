"""Readers: typed tables, CSV and JSON folders, nested document caches, binary text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import overlap_share


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; NaN becomes NULL so that aggregates skip it."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns]) if floats else df


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, **options) -> DataFrame:
    """One CSV file or folder under a stated schema; malformed cells become NULL."""
    return spark.read.schema(schema).options(header=header, mode="PERMISSIVE", multiLine=True, escape='"', **options).csv(path)


#: The sheets that analyses read, with their columns.
SHEETS = {
    "panel": "company string, country string, technology string, year int, production double, scope1 double, scope2_location double, scope2_market double",
    "drivers": "country string, year int, carbon_price double, electricity_price double, crude_steel_production double",
    "trend": "year int, co2_intensity_harmonized_tco2_per_t double",
    "transparency": "company string, transparency_score double",
    "technology": "company string, country string, current_tech string, transformation_plan string, tech_score_2019 double, tech_score_2024 double",
    "profile": "company string, country string, founding_year int",
    "clients": "company string, automotive int, construction int, machinery int",
}


def load_sheet(spark: SparkSession, path: str, sheet: str, years: tuple[int, int] | None = None, countries: list[str] | None = None) -> DataFrame:
    """A sheet under its schema, from Parquet, CSV, or a workbook where pandas can read one.

    A workbook is read on the driver, as these are small; its other columns are left out. Columns of the
    schema that the file does not have are left out too; text is trimmed, and apostrophes made plain.
    """
    schema = SHEETS[sheet]
    fields = [f.split() for f in schema.split(", ")]
    if path.endswith((".xlsx", ".xls")):
        frame = pd.read_excel(path, sheet_name=sheet)
        df = spark.createDataFrame(frame[[n for n, _ in fields if n in frame.columns]])
    else:
        df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.options(header=True, escape='"').csv(path)
    have = [(n, k) for n, k in fields if n in df.columns]
    cell = lambda n, k: F.regexp_replace(F.trim(n), "[\u0092\u2019]", "'") if k == "string" else F.col(n).try_cast(k)
    df = df.select(*[cell(n, k).alias(n) for n, k in have])
    if countries and "country" in df.columns:
        df = df.filter(F.col("country").isin(countries))
    return df.filter(F.col("year").between(*years)) if years and "year" in df.columns else df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise if a column is missing; else the frame itself."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def existing(df: DataFrame, names: list[str]) -> DataFrame:
    """Projection to those of ``names`` that exist, in that order."""
    return df.select(*[n for n in names if n in df.columns])


def normal_name(name: str) -> str:
    """A column name with runs of punctuation and blanks as one underscore, stripped, lower case."""
    import re

    return re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z_]+", "_", name)).strip("_").lower()


def normal_label(name):
    """X24 for a column of names."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, "[^0-9A-Za-z_]+", "_"), "_+", "_"), F.lit("_")))


def rename_normal(df: DataFrame) -> DataFrame:
    """X24 over all columns."""
    return df.toDF(*[normal_name(c) for c in df.columns])


def panel(df: DataFrame, countries: list[str] | None = None, country: str = "country", year: str = "year", entity: str = "company", years: tuple[int, int] | None = None) -> DataFrame:
    """Apostrophes made plain, integer years, region and inclusive year filters."""
    out = df.withColumn(entity, F.regexp_replace(entity, "[\u0092’]", "'")).withColumn(year, F.col(year).cast("int"))
    if countries:
        out = out.filter(F.col(country).isin(countries))
    return out.filter(F.col(year).between(*years)) if years else out


def scan_csv_folder(spark: SparkSession, path: str, prefix: str, schema: T.StructType | str, suffix: str = ".csv", text: str | None = None, marker: str = "NO_") -> DataFrame:
    """All files ``prefix*suffix`` of a folder; rows whose text holds ``marker`` go, null text stays.

    Malformed lines become nulls, unreadable files are skipped, files without a header are empty.
    """
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).option("pathGlobFilter", f"{prefix}*{suffix}").option("recursiveFileLookup", True)
    df = reader.csv(path)
    return df if text is None else df.filter(~F.coalesce(F.col(text).contains(marker), F.lit(False)))


def scan_json_folder(spark: SparkSession, path: str, schema: T.StructType | str | None = None, glob: str = "*.json", flatten: str | None = None) -> DataFrame:
    """JSON files with ``_source_file`` lineage; ``flatten`` names an array to make rows of."""
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", glob)
    df = (reader.schema(schema) if schema else reader).json(path).withColumn("_source_file", F.col("_metadata.file_name"))
    if flatten:
        rest = [c for c in df.columns if c != flatten]
        df = df.select(*rest, F.inline(flatten)) if isinstance(df.schema[flatten].dataType.elementType, T.StructType) else df.select(*rest, F.explode(flatten).alias(flatten))
    return df


def scan_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, flatten: str | None = None) -> DataFrame:
    """JSON lines under a schema; ``flatten`` names an array of records to make rows of."""
    df = spark.read.schema(schema).json(path)
    return df.select(*[c for c in df.columns if c != flatten], F.inline(flatten)) if flatten else df


#: A scored document and its chunks.
CHUNK = T.StructType([T.StructField(n, T.StringType()) for n in ("chunk_id", "company", "company_id")] + [T.StructField("year", T.IntegerType()), T.StructField("text", T.StringType())] + [T.StructField(f"{m}_{k}", T.StringType() if k == "label" else T.DoubleType()) for m in ("detector", "specificity", "sentiment", "commitment", "netzero") for k in ("label", "score")])
SCORED = T.StructType([T.StructField(n, T.StringType()) for n in ("pdf_path", "company", "company_id")] + [T.StructField("year", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("translated", T.BooleanType()), T.StructField("total_chunks", T.IntegerType()), T.StructField("climate_chunks", T.IntegerType()), T.StructField("kept_percentage", T.DoubleType()), T.StructField("netzero_count", T.IntegerType()), T.StructField("netzero_pct", T.DoubleType()), T.StructField("netzero_analyzed", T.BooleanType()), T.StructField("chunks", T.ArrayType(CHUNK))])


def scan_scored(spark: SparkSession, path: str, before_year: int | None = None, glob: str = "*_bert.json") -> DataFrame:
    """Typed scored documents; a null year is kept by the year filter."""
    df = scan_json_folder(spark, path, SCORED, glob)
    return df if before_year is None else before(df, before_year)


def before(df: DataFrame, year: int) -> DataFrame:
    """P10: rows before a year; a null year is kept."""
    return df.filter(F.col("year").isNull() | (F.col("year") < year))


def explode_chunks(docs: DataFrame, unknown: str | None = "Unknown") -> DataFrame:
    """A row per chunk with its position; missing ids become ``chunk_000`` and so on.

    Documents without chunks have no rows; missing labels and scores get their defaults, a missing company ``unknown``.
    """
    rows = docs.select("pdf_path", F.coalesce("company", F.lit(unknown)).alias("company"), "company_id", F.coalesce("year", F.lit(0)).alias("year"), F.posexplode("chunks").alias("position", "c"))
    defaults = {"detector_score": 0.0, "specificity_label": "non", "sentiment_label": "neutral", "commitment_label": "no", "netzero_label": "none"}
    fields = [F.coalesce(F.col(f"c.{f.name}"), F.lit(defaults[f.name])).alias(f.name) if f.name in defaults else F.col(f"c.{f.name}").alias(f.name) for f in CHUNK if f.name not in ("chunk_id", "company", "company_id", "year")]
    return rows.select("pdf_path", "company", "company_id", "year", "position", F.coalesce("c.chunk_id", F.format_string("chunk_%03d", "position")).alias("chunk_id"), *fields)


def cache_path(folder: str, **keys) -> str:
    """The folder of one document in a cache that is partitioned by its keys."""
    return "/".join([folder.rstrip("/"), *(f"{k}={v}" for k, v in keys.items())])


def load_cached(spark: SparkSession, folder: str, schema: T.StructType | str, **keys) -> DataFrame | None:
    """One document of a JSON cache by its keys, without a scan of the others; None if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path(folder, **keys))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(schema).json(path.toString())


def block_text(blocks: DataFrame, tables: DataFrame, keys: list[str], least_height: float = 5.0, most_overlap: float = 0.5) -> DataFrame:
    """The text of a page's blocks from top to bottom, left to right, and the number of blocks used.

    ``blocks`` (keys, kind, text, x0, y0, x1, y1) of another kind than text, lower than ``least_height``, or
    with more than ``most_overlap`` of their area in one of the page's ``tables`` (keys, x0..y1) are left out.
    Equal boxes of a page count once; a block is done with at the first that holds it.
    """
    box = ["x0", "y0", "x1", "y1"]
    outer = tables.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *box)]).distinct()
    good = blocks.filter((F.col("kind") == "text") & (F.col("y1") - F.col("y0") >= least_height))
    met = reduce(and_, [F.col(k) == F.col(f"_{k}") for k in keys]) & (overlap_share(*[F.col(c) for c in box], *[F.col(f"_{c}") for c in box]) > most_overlap)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "text"))), lambda b: b["text"])
    return good.join(outer, met, "left_anti").groupBy(*keys).agg(F.array_join(ordered, "\n").alias("text"), F.count(F.lit(1)).alias("n_blocks"))


def scan_binary_text(spark: SparkSession, path: str, extract: Callable[[bytes], tuple[str, int]], glob: str = "*.pdf") -> DataFrame:
    """Files below ``path`` through an extractor of (text, pages); a failing file gets its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, content in zip(frame["path"], frame["content"]):
                try:
                    text, pages = extract(content)
                    rows.append((file, text, pages, None))
                except Exception as error:  # one bad file must not stop the folder
                    rows.append((file, None, 0, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "text", "num_pages", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, num_pages int, error string")


def companies(docs: DataFrame) -> DataFrame:
    """Company ids with their sorted years and number of files."""
    return docs.groupBy("company_id").agg(F.array_sort(F.collect_set("year")).alias("years"), F.count(F.lit(1)).alias("n_files"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name, missing columns as nulls."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
