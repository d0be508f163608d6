"""Seeded samples, holdouts and shuffles, ordered by MD5 of (seed, id) so that every engine draws the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered


def draw(seed: int, id_: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")))


def cap_sample(df: DataFrame, n: int, seed: int, id_: str = "id") -> DataFrame:
    """At most n rows without replacement; a top-n per partition and then overall, not a global sort."""
    return df.withColumn("__d", draw(seed, id_)).orderBy("__d", id_).limit(n).drop("__d")


def shuffled(df: DataFrame, seed: int, id_: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """Add ``place``: 0, 1, ... in draw order, within each cell of the keys, and ``total``, the cell's rows."""
    return numbered(df.withColumn("__d", draw(seed, id_)), ["__d", id_], keys, "place", "total").drop("__d")


def per_cell(df: DataFrame, n: int, seed: int, keys: Sequence[str], id_: str = "id") -> DataFrame:
    """At most n rows of each cell; each task keeps its first n of a cell before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(draw(seed, id_), id_)
    return df.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= n).drop("__place")


def stratified_sample(df: DataFrame, n: int, seed: int, keys: Sequence[str], id_: str = "id") -> DataFrame:
    """About n rows, equally from each non-empty cell: max(1, n // cells), or all rows of a smaller cell."""
    cells = df.select(*keys).distinct().count()
    return per_cell(df, max(1, n // cells) if cells else 0, seed, keys, id_)


def fraction_holdout(df: DataFrame, fraction: float, seed: int, keys: Sequence[str], id_: str = "id") -> DataFrame:
    """Add ``held``: the first round(fraction * n) rows of each stratum in draw order."""
    return shuffled(df, seed, id_, keys).withColumn("held", F.col("place") < F.floor(F.col("total") * F.lit(fraction) + 0.5)).drop("place", "total")


def validation_carve(df: DataFrame, seed: int, id_: str = "id", most: int = 5000) -> DataFrame:
    """min(most, max(1, n // 10)) rows; not aware of groups."""
    return cap_sample(df, min(most, max(1, df.count() // 10)), seed, id_)


def anti(df: DataFrame, other: DataFrame, id_: str = "id") -> DataFrame:
    return df.join(other.select(id_), id_, "left_anti")


def head_tail(df: DataFrame, tail: int, seed: int, id_: str = "id") -> DataFrame:
    """Add ``part``: a shuffle's last ``tail`` rows are "tail", all others "head"."""
    last = df.select(id_, draw(seed, id_).alias("__d")).orderBy(F.desc("__d"), F.desc(id_)).limit(tail).select(id_, F.lit("tail").alias("part"))
    return df.join(last, id_, "left").withColumn("part", F.coalesce("part", F.lit("head")))


def k_folds(df: DataFrame, k: int, seed: int, label: str = "label", id_: str = "id") -> DataFrame:
    """Add ``fold``: row number mod k within each class; not grouped."""
    return shuffled(df, seed, id_, [label]).withColumn("fold", F.col("place") % k).drop("place", "total")


def train_mask(df: DataFrame, fraction: float, seed: int, id_: str = "id") -> DataFrame:
    """Add ``in_train``: whether the row is among the first floor(fraction * n) in draw order."""
    return shuffled(df, seed, id_).withColumn("in_train", F.col("place") < F.floor(F.col("total") * F.lit(fraction))).drop("place", "total")


# --- pseudo-labels ---


def hard_labels(df: DataFrame, low: float, high: float, score: str = "score") -> DataFrame:
    """Rows with score >= high (label 1) or <= low (label 0); those between go."""
    label = F.when(F.col(score) >= high, 1).when(F.col(score) <= low, 0)
    return df.withColumn("label", label).where(F.col("label").isNotNull())


def soft_label(score: Column, sharpen: float | None = None, eps: float = 1e-4) -> Column:
    """Score clipped to [eps, 1 - eps], and with an exponent sharpened to s^T / (s^T + (1 - s)^T)."""
    s = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), score))
    if sharpen is None:
        return s
    return F.pow(s, F.lit(sharpen)) / (F.pow(s, F.lit(sharpen)) + F.pow(1 - s, F.lit(sharpen)))
