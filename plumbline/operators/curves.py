"""Detection-error-tradeoff curves and the metrics read off them, for any number of groups in one job.

Inputs are (keys..., y 0/1, s in [0, 1]); s >= t means "attack". Scores are
aggregated to distinct values first, so a curve runs over distinct scores of
its group and not over rows: in one task, or by ranges if there are many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .ranking import numbered, running

UPPER, LOWER = 1 + 1e-12, -1e-12
#: Distinct scores of a group that one task may order.
MOST_POINTS = 2_000_000


def validated(scored: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """The input unless it is empty or has null or non-binary labels or null scores; those raise."""
    row = scored.agg(F.count("*").alias("n"), F.count_if(F.col(y).isNull() | ~F.col(y).isin(0, 1) | F.col(s).isNull() | F.isnan(s)).alias("bad")).first()
    if not row["n"]:
        raise ValueError("no scores")
    if row["bad"]:
        raise ValueError(f"{row['bad']} rows have no score or no binary label")
    return scored


def error_rates_at(scored: DataFrame, threshold: float | Column, keys: Sequence[str] = (), y: str = "y", s: str = "s") -> DataFrame:
    """(keys, apcer, bpcer) at a threshold; a missing class has rate 0."""
    t = F.lit(threshold) if isinstance(threshold, float | int) else threshold
    rate = lambda hit, cls: F.coalesce(F.try_divide(F.count_if(hit & (F.col(y) == cls)), F.count_if(F.col(y) == cls)), F.lit(0.0))
    return scored.groupBy(*keys).agg(rate(F.col(s) < t, 1).alias("apcer"), rate(F.col(s) >= t, 0).alias("bpcer"))


def _by_score(scored: DataFrame, keys: Sequence[str], y: str, s: str) -> DataFrame:
    """(keys, threshold, n, a, g): rows of each distinct score. The one pass over the rows: all else is made of this table."""
    by = scored.groupBy(*keys, F.col(s).alias("threshold")).agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("a"), F.count_if(F.col(y) == 0).alias("g"))
    return stored(by, "scores")


def _totals(by: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "n"), ("a", "n_att"), ("g", "n_gen"))]
    return by.groupBy(*keys).agg(*sums, F.count("*").alias("points"))


def _points(by: DataFrame, totals: DataFrame, keys: Sequence[str], large: bool) -> DataFrame:
    """(keys, threshold, k, fn, fp, n_att, n_gen): counts at every distinct score and two sentinels (k = 0 above, 2 below).

    The sentinels are points without rows above and below all scores, so the
    sums give their counts too.
    """
    zero = F.lit(0).cast("long")
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold")) for k, t in ((0, UPPER), (2, LOWER))])).alias("e")
    ends = totals.select(*keys, ends).select(*keys, "e.k", "e.threshold", zero.alias("a"), zero.alias("g"))
    rows = by.select(*keys, F.lit(1).alias("k"), "threshold", "a", "g").unionByName(ends).withColumn("__up", -F.col("k"))
    order = ["__up", "threshold"]
    if large:
        run = running(rows, order, F.col("a"), keys, "fn", "n_att")
        run = running(run, order, F.col("g"), keys, "below", "n_gen")
    else:
        whole = Window.partitionBy(*keys)
        before = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        sums = {"fn": F.coalesce(F.sum("a").over(before), F.lit(0)), "below": F.coalesce(F.sum("g").over(before), F.lit(0))}
        run = rows.withColumns({**sums, "n_att": F.sum("a").over(whole), "n_gen": F.sum("g").over(whole)})
    return run.select(*keys, "threshold", "k", "fn", (F.col("n_gen") - F.col("below")).alias("fp"), "n_att", "n_gen")


def _in_order(points: DataFrame, keys: Sequence[str], large: bool) -> DataFrame:
    """Add position (from 1) in curve order: false positives, then sentinel above, data by threshold, sentinel below."""
    names = ["fp", "k", "threshold"]
    if large:
        return numbered(points, names, keys, "position").withColumn("position", F.col("position") + 1)
    return points.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*names)).cast("long"))


def _is_large(totals: DataFrame) -> bool:
    return (totals.agg(F.max("points")).first()[0] or 0) > MOST_POINTS


def det_curve(scored: DataFrame, keys: Sequence[str] = (), y: str = "y", s: str = "s") -> DataFrame:
    """(keys, position, bpcer, apcer, threshold) in curve order: bpcer, then sentinel above, data by threshold, sentinel below."""
    by = _by_score(scored, keys, y, s)
    totals = _totals(by, keys)
    large = _is_large(totals)
    rate = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    ordered = _in_order(_points(by, totals, keys, large), keys, large)
    return ordered.select(*keys, "position", rate("fp", "n_gen").alias("bpcer"), rate("fn", "n_att").alias("apcer"), "threshold")


def score_bundle(scored: DataFrame, keys: Sequence[str] = (), target: float = 0.01, y: str = "y", s: str = "s") -> DataFrame:
    """(keys, n, n_att, n_gen, audet, apcer_at, threshold_at, eer, score), one row per group, from one curve.

    AuDET is an exact integer sum divided once. apcer_at is that of the last
    point with bpcer <= target, EER the mean of both rates at the first
    smallest gap, and score 1 - 2gh/(g + h) with g = 1 - AuDET and
    h = 1 - apcer_at. The metrics of a group with one class or fewer than two
    rows are null. Rows meet once, as counts of distinct scores; groups of
    over MOST_POINTS of these are summed by ranges instead of in one task.
    """
    by = _by_score(scored, keys, y, s)
    totals = _totals(by, keys)
    large = _is_large(totals)
    points = _points(by, totals, keys, large).where("n_att > 0 and n_gen > 0")
    # Between two points the area only grows where false positives do: from the last point of one count of them to the first of the next.
    place = F.struct("k", "threshold")
    steps = points.groupBy(*keys, "fp").agg(F.min_by("fn", place).alias("low"), F.max_by("fn", place).alias("high"), F.first("n_att").alias("n_att"), F.first("n_gen").alias("n_gen"))
    if large:
        steps = numbered(steps, ["fp"], keys, "at")
        before = steps.select(*keys, (F.col("at") + 1).alias("at"), F.col("fp").alias("fp0"), F.col("high").alias("high0"))
        steps = steps.join(before, [*keys, "at"], "left")
    else:
        order = Window.partitionBy(*keys).orderBy("fp")
        steps = steps.withColumns({"fp0": F.lag("fp").over(order), "high0": F.lag("high").over(order)})
    bpcer, apcer = F.col("fp") / F.col("n_gen"), F.col("fn") / F.col("n_att")
    eer = points.groupBy(*keys).agg(F.min_by((bpcer + apcer) / 2, F.struct(F.abs(bpcer - apcer), "fp", "k", "threshold")).alias("eer"))
    top = points.where(bpcer <= target).groupBy(*keys).agg(F.max_by(F.struct(apcer.alias("apcer"), "threshold"), F.struct("fp", "k", "threshold")).alias("at"))
    area = steps.groupBy(*keys).agg(F.coalesce(F.sum((F.col("fp") - F.col("fp0")) * (F.col("low") + F.col("high0"))), F.lit(0)).alias("area"), F.first("n_att").alias("m"), F.first("n_gen").alias("g"))
    join = (lambda a, b: a.join(b, list(keys))) if keys else (lambda a, b: a.join(F.broadcast(b)))  # without keys one row each
    got = join(join(area, eer), top)
    audet = F.when(F.col("m") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("area") / (2 * F.col("m") * F.col("g")))))
    g, h = 1 - F.col("audet"), 1 - F.col("apcer_at")
    got = got.select(*keys, audet.alias("audet"), F.col("at.apcer").alias("apcer_at"), F.col("at.threshold").alias("threshold_at"), "eer")
    got = got.withColumn("score", F.when(g + h <= 0, 1.0).otherwise(1 - 2 * g * h / (g + h)))
    out = totals.join(got, list(keys), "left") if keys else totals.join(F.broadcast(got), F.lit(True), "left")
    return out.select(*keys, "n", "n_att", "n_gen", "audet", "apcer_at", "threshold_at", "eer", "score")


def spread(metrics: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mean, std, min, max, n) of a metric over folds or types; std is of the population."""
    return metrics.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), F.count(column).alias("n"))


def best_epoch(runs: DataFrame, keys: Sequence[str], metric: str, epoch: str) -> DataFrame:
    """The first epoch with the least metric, of each run."""
    return runs.groupBy(*keys).agg(F.min_by(epoch, F.struct(metric, epoch)).alias("best_epoch"), F.min(metric).alias("best_metric"))


def rank_agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, rank_a, rank_b, agree): order of the same models under two measures, least first."""
    ranked = lambda df, name: df.select(key, F.row_number().over(Window.partitionBy().orderBy(F.col(value).asc_nulls_last(), key)).alias(name))
    return ranked(a, "rank_a").join(ranked(b, "rank_b"), key).withColumn("agree", F.col("rank_a") == F.col("rank_b"))
