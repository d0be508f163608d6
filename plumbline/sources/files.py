"""Scans and sinks: manifests, image files, JSON artifacts, splits, features and submissions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stem_and_suffix
from ..model import IMAGE_EXTENSIONS, MANIFEST, SPLITS, SUBMISSION, SplitConfig
from ..operators.profile import split_type


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label manifest with country and doc_type, read with its schema and not an inferred one."""
    country, doc = split_type("type")
    return spark.read.schema(MANIFEST).option("header", True).csv(path).withColumns({"country": country, "doc_type": doc})


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSION).option("header", True).csv(path)


def image_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length, stem) of image files; contents are not read (only path and length are selected)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    stem, suffix = stem_and_suffix(F.col("path"))
    return files.withColumn("stem", stem).where(F.replace(suffix, F.lit("."), F.lit("")).isin(*IMAGE_EXTENSIONS))


def image_list(spark: SparkSession, folder: str, limit: int | None = None, recursive: bool = True) -> DataFrame:
    files = image_files(spark, folder, recursive).orderBy("path")
    return files.limit(limit) if limit else files


def file_index(files: DataFrame) -> DataFrame:
    """(stem, abs_path): of files that share a stem the greatest path."""
    return files.groupBy("stem").agg(F.max("path").alias("abs_path"))


def resolved(items: DataFrame, index: DataFrame, id_: str = "id") -> DataFrame:
    """Add abs_path and path_exists."""
    found = index.select(F.col("stem").alias(id_), "abs_path")
    return items.join(found, id_, "left").withColumn("path_exists", F.col("abs_path").isNotNull())


def with_files(items: DataFrame, index: DataFrame, id_: str = "id") -> DataFrame:
    return resolved(items, index, id_).where("path_exists").drop("path_exists")


def path_of(index: DataFrame, stem: str) -> str | None:
    row = index.where(F.col("stem") == stem).select("abs_path").first()
    return row and row[0]


def test_frame(files: DataFrame) -> DataFrame:
    """(id, abs_path, label 0) of unlabeled files."""
    return file_index(files).select(F.col("stem").alias("id"), "abs_path", F.lit(0).alias("label"))


def path_labelled(paths: DataFrame, positive: Sequence[str], negative: Sequence[str], path: str = "path") -> DataFrame:
    """(id, label, type, country, is_digital) of root/country/label_dir/file paths whose label folder is known; no match raises."""
    parts = F.split(path, "/")
    n = F.size(parts)
    folder, country = F.lower(F.get(parts, n - 2)), F.get(parts, n - 3)
    label = F.when(folder.isin(*positive), 1).when(folder.isin(*negative), 0)
    stem, _ = stem_and_suffix(F.col(path))
    out = paths.select(stem.alias("id"), label.alias("label"), F.concat(country, F.lit("/"), folder).alias("type"), country.alias("country"), F.lit(True).alias("is_digital")).where("label is not null")
    if out.isEmpty():
        raise ValueError("no path has a known label folder")
    return out


def keyword_label(path: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """1 or 0 if exactly one side's keywords occur in the lower-cased path, else null."""
    has = lambda words: F.lower(path).rlike("|".join(words))
    p, n = has(positive), has(negative)
    return F.when(p & ~n, 1).when(n & ~p, 0)


def keyword_labelled(paths: DataFrame, positive: Sequence[str], negative: Sequence[str], path: str = "path", least: int = 1) -> DataFrame:
    """(id, path, label) with one row per id, the smallest path; fewer than ``least`` rows raise."""
    stem, _ = stem_and_suffix(F.col(path))
    rows = paths.select(stem.alias("id"), F.col(path).alias("path"), keyword_label(F.col(path), positive, negative).alias("label")).where("label is not null")
    out = rows.groupBy("id").agg(F.min_by("label", "path").alias("label"), F.min("path").alias("path"))
    if (n := out.count()) < least:
        raise ValueError(f"{n} labelled files, fewer than {least}")
    return out


def redirected(items: DataFrame, cache: DataFrame, id_: str = "id", path: str = "abs_path") -> DataFrame:
    """Paths replaced by those of cached copies where there are any."""
    found = cache.select(id_, F.col(path).alias("__cached"))
    return items.join(found, id_, "left").withColumn(path, F.coalesce("__cached", path)).drop("__cached")


def pick_source(spark: SparkSession, candidates: Sequence[str], size: Callable[[str], int]) -> str:
    """The first of the largest candidates, by a size function (0: missing); none raises."""
    best = max(candidates, key=size, default=None)
    if best is None or not size(best):
        raise FileNotFoundError(", ".join(candidates))
    return best


# --- artifacts ---


def save_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small report as one JSON file in a folder; numbers that JSON lacks become null."""
    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple | set):
            return [plain(v) for v in x]
        if hasattr(x, "item"):
            x = x.item()
        return None if isinstance(x, float) and (x != x or abs(x) == float("inf")) else x

    spark.createDataFrame([(json.dumps(plain(value)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict | None:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path).first()
    except AnalysisException:
        return None
    return row and json.loads(row[0])


def results(spark: SparkSession, pattern: str, schema: str | T.StructType) -> DataFrame:
    """All readable result files of a pattern; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(pattern)


def save_splits(splits: DataFrame, path: str, manifest: dict | None = None) -> None:
    """Parquet by split, a CSV of all rows and one of each split, and the manifest."""
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{path}/splits.parquet")
    splits.write.mode("overwrite").option("header", True).csv(f"{path}/all.csv")
    for name in SPLITS:
        splits.where(F.col("split") == name).write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
    save_json(splits.sparkSession, manifest or {}, f"{path}/manifest.json")


def load_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Stored splits, pruned to one if named; missing ones raise."""
    df = spark.read.parquet(f"{path}/splits.parquet")
    return df.where(F.col("split") == split) if split else df


def load_config(spark: SparkSession, path: str) -> SplitConfig:
    found = load_json(spark, f"{path}/manifest.json")
    if found is None:
        raise FileNotFoundError(path)
    return SplitConfig.of(found)


def save_submission(df: DataFrame, path: str, id_: str = "id", s: str = "label") -> None:
    df.select(id_, s).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("append").format(kind).save(path)


def optional_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
