"""Stratified bootstrap of curve metrics without materialised resamples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curves import score_bundle
from .ranking import numbered


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the colon-joined parts; the same in any engine."""
    digest = F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def resamples(scored: DataFrame, replicates: int, id_: str = "id", y: str = "y", s: str = "s") -> DataFrame:
    """(replicate, y, s): for each replicate as many draws with replacement within each class as the class has rows.

    Draw j of a class picks its row number floor(u * n) by the hash of
    (replicate, class, j), so it is an equi-join and the same everywhere.
    """
    rows = numbered(scored.select(id_, y, s), [id_], [y], "at", "n").select(y, s, "at", "n")
    reps = scored.sparkSession.range(replicates).select(F.col("id").alias("replicate"))
    draws = rows.select(y, F.col("at").alias("j"), "n").join(F.broadcast(reps))
    picked = draws.select("replicate", y, F.floor(hash_unit("replicate", y, "j") * F.col("n")).cast("long").alias("at"))
    return picked.join(rows.select(y, s, "at"), [y, "at"]).select("replicate", y, s)


def bootstrap_metric(scored: DataFrame, replicates: int = 500, metric: str = "score", alpha: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """(mean, std, lower, upper): population deviation and linear percentiles of the metric over replicates."""
    got = score_bundle(resamples(scored, replicates), ["replicate"])
    return got.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.percentile(metric, F.lit(alpha / 2)).alias("lower"), F.percentile(metric, F.lit(1 - alpha / 2)).alias("upper"))
