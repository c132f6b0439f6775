"""Writers: CSV exports, partitioned tables, run folders, run statistics."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


def write_csvs(frames: dict[str, DataFrame], folder: str) -> None:
    """Each frame as a CSV folder of its name, with a header."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_named_csv(df: DataFrame, path: str) -> None:
    """K1: one CSV file of the given name, for tables that one task can write."""
    spark, draft = df.sparkSession, path + ".draft"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(draft)
    fs, p = _fs(spark, draft)
    part = next(s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(p, True)


def write_partitioned(df: DataFrame, path: str, *keys: str, form: str = "parquet") -> None:
    """K3, L3: one folder a key; only the keys in ``df`` are replaced, so runs can resume."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(*keys).format(form).save(path)


def write_json(df: DataFrame, path: str) -> None:
    """K8, K9: JSON lines in UTF-8."""
    df.write.mode("overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def runs(spark: SparkSession, root: str) -> list[str]:
    """K6: names of the run folders, by name."""
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if re.fullmatch(r"run_\d+", n))


def next_run(spark: SparkSession, root: str) -> str:
    """The path of the run folder after the last."""
    last = max((int(n[4:]) for n in runs(spark, root)), default=0)
    return f"{root}/run_{last + 1:02d}"


def free_path(spark: SparkSession, path: str) -> str:
    """The path, or it with _2, _3 and so on if it is taken."""
    fs, p = _fs(spark, path)
    k, found = 1, path
    while fs.exists(p):
        k += 1
        found = f"{path}_{k}"
        p = spark._jvm.org.apache.hadoop.fs.Path(found)
    return found


def write_pairs(frames: dict[str, DataFrame], folder: str, *keys: str) -> None:
    """K3: for each category a CSV and a Parquet table with one folder a key."""
    for name, df in frames.items():
        for form in ("csv", "parquet"):
            write_partitioned(df, f"{folder}/{name}.{form}", *keys, form=form)


def save_vectors(df: DataFrame, folder: str, model: str, category: str) -> None:
    """The vectors of a model and category, in a folder of their names."""
    df.write.mode("overwrite").parquet(f"{folder}/model={model}/category={category}")


def load_vectors(spark: SparkSession, folder: str, model: str, category: str, expected: int | None = None) -> DataFrame | None:
    """Cached vectors, None if there are none or their number is not the expected one."""
    path = f"{folder}/model={model}/category={category}"
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    df = spark.read.parquet(path)
    return df if expected is None or df.count() == expected else None


def cached_vectors(source: DataFrame, folder: str, model: str, category: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached vectors if they fit the source, else computed and saved."""
    spark, n = source.sparkSession, source.count()
    if (found := load_vectors(spark, folder, model, category, n)) is None:
        save_vectors(compute(source), folder, model, category)
        found = load_vectors(spark, folder, model, category)
    return found


@dataclass
class RunState:
    """What a topic run is made of; saved beside its outputs and read again."""

    name: str
    category: str
    parameters: dict = field(default_factory=dict)
    merged: list = field(default_factory=list)

    def with_overrides(self, overrides: dict[str, dict]) -> "RunState":
        """The state with its category's parameters over the general ones."""
        return RunState(self.name, self.category, self.parameters | overrides.get(self.category, {}), self.merged)

    def save(self, spark: SparkSession, folder: str) -> None:
        write_stats(spark, asdict(self), f"{folder}/state")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "RunState":
        return cls(**json.loads(spark.read.text(f"{folder}/state").first()[0]))


def write_stats(spark: SparkSession, stats: dict, path: str) -> None:
    """K4, K7: run configuration and counts as one JSON text."""
    spark.createDataFrame([(json.dumps(stats, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
