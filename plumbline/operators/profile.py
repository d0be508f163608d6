"""Profiles of manifests, files and numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), null included."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def rate_by(df: DataFrame, *keys: str, label: str = "label") -> DataFrame:
    """(keys, n, rate): rows and share of label 1 in each stratum."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))


def crosstab(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, n0, n1, total), 0 for absent cells, by total descending."""
    out = df.groupBy(key).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    return out.withColumn("total", F.col("n0") + F.col("n1")).orderBy(F.desc("total"), key)


def label_stats(df: DataFrame, id_: str = "id", label: str = "label") -> DataFrame:
    """One row: n, n_fraud, rate, whether ids are unique, and missing labels."""
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == 1).alias("n_fraud"),
        F.avg(label).alias("rate"),
        (F.count(id_) == F.countDistinct(id_)).alias("ids_unique"),
        F.count_if(F.col(label).isNull()).alias("n_missing"),
    )


def table_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, type, n, n_unique, n_null) for every column; n is the table's rows, distinct counts exclude nulls."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    row = df.agg(*[F.struct(distinct(f"`{c}`").alias("u"), F.count_if(F.col(f"`{c}`").isNull()).alias("m")).alias(c) for c in df.columns], F.count("*").alias("__rows"))
    parts = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("__rows").alias("n"), F.col(f"`{c}`.u").alias("n_unique"), F.col(f"`{c}`.m").alias("n_null")) for c, t in df.dtypes]
    return row.select(F.inline(F.array(*parts)))


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows by order (a report)."""
    return df.orderBy(*order).limit(n)


def bytes_by_extension(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """(ext, n, bytes) by bytes descending; files without an extension have the empty one."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy(ext.alias("ext")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).orderBy(F.desc("bytes"), "ext")


def six_numbers(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, min, p25, median, p75, max, mean), quartiles by linear interpolation."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"), F.avg(column).alias("mean"))
    return out.select(*keys, "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max", "mean")


def moments(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mean, std, skew, kurtosis): population deviation, bias-corrected skewness and excess kurtosis; under 4 rows null, no spread 0."""
    x = F.col(column).cast("double")
    out = df.groupBy(*keys).agg(F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n, flat = F.col("n"), F.col("std") <= 1e-9
    skew = F.when(n < 4, None).when(flat, 0.0).otherwise(F.col("g1") * F.try_divide(F.sqrt(n * (n - 1)), n - 2))
    kurt = F.when(n < 4, None).when(flat, 0.0).otherwise(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return out.select(*keys, "mean", "std", skew.alias("skew"), kurt.alias("kurtosis"))


def size_profile(df: DataFrame, column: str, id_: str, n: int, seed: int) -> DataFrame:
    """(n, min, upper_median, max) over a sample of at most n rows; the median is the upper of an even count."""
    from .sampling import cap_sample

    sample = cap_sample(df.where(F.col(column).isNotNull()), n, seed, id_)
    ordered = F.sort_array(F.collect_list(column))  # at most n values
    return sample.agg(F.count("*").alias("n"), ordered.alias("v")).select("n", F.try_element_at("v", F.lit(1)).alias("min"), F.get("v", (F.col("n") / 2).cast("int")).alias("upper_median"), F.try_element_at("v", F.lit(-1)).alias("max"))


def positive_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: max(negatives, 1) / max(positives, 1)."""
    one = F.lit(1)
    return df.agg((F.greatest(F.count_if(F.col(label) == 0), one) / F.greatest(F.count_if(F.col(label) == 1), one)).alias("pos_weight"))


def class_separation(df: DataFrame, score: str, keys: Sequence[str] = (), label: str = "label", tripwire: float = 0.15) -> DataFrame:
    """(keys, mean0, mean1, separation, tripped)."""
    mean = lambda k: F.avg(F.when(F.col(label) == k, F.col(score)))
    out = df.groupBy(*keys).agg(mean(0).alias("mean0"), mean(1).alias("mean1"))
    return out.withColumn("separation", F.col("mean1") - F.col("mean0")).withColumn("tripped", F.col("separation") > tripwire)


# --- projections ---


def split_type(column: Column | str) -> tuple[Column, Column]:
    """Country and document type of "COUNTRY/DOC": the first slash splits, both trimmed, null if absent."""
    parts = F.split(column, "/", 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))


def human_bytes(n: Column) -> Column:
    """1024-based size with one decimal and its unit."""
    out = F.concat(F.format_string("%.1f", n / F.lit(1024.0**5)), F.lit(" PB"))
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(F.abs(n) < 1024.0 ** (power + 1), F.concat(F.format_string("%.1f", n / F.lit(1024.0**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def image_properties(width: Column, height: Column, size: Column) -> dict[str, Column]:
    """Megapixels, aspect ratio, orientation and bytes per pixel; null where a side is zero."""
    pixels = (width * height).cast("double")
    return {
        "megapixels": F.round(pixels / 1e6, 3),
        "aspect": F.round(F.try_divide(width.cast("double"), height), 4),
        "orientation": F.when(width > height, "landscape").when(width < height, "portrait").otherwise("square"),
        "bytes_per_pixel": F.round(F.try_divide(size.cast("double"), pixels), 4),
    }


def label_name(label: Column) -> Column:
    from ..model import LABEL_NAMES

    out = F.lit(None).cast("string")
    for k, v in LABEL_NAMES.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def finite(x: Column, otherwise: float | None = None) -> Column:
    """x, or the replacement where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(otherwise).cast("double")).otherwise(x)


def imputed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing (null, NaN, infinite) values become the column's exact median; all-missing columns become 0."""
    clean = df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    medians = clean.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"__{c}") for c in columns])
    return clean.join(F.broadcast(medians)).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns whose values are not all the same."""
    row = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def stratum(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def category_codes(train: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Add ``code``: place of the value among train's sorted distinct values, 0 for values unseen in train."""
    from pyspark.sql import Window

    codes = train.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.partitionBy().orderBy(column)) - 1)
    return other.join(F.broadcast(codes) if codes.count() <= 100_000 else codes, column, "left").withColumn("code", F.coalesce("code", F.lit(0)).cast("long"))
