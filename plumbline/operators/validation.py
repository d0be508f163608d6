"""Reports over holdouts, folds and held types, from scores that models gave elsewhere, and one sanity report of a split.

Scores come as (id, s) or with a key; what a report does not find is a row with
a note, and never left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curves import score_bundle
from .splits import assert_no_leakage, leaking_pairs, split_stats, type_overlap

WHOLE, SUMMARY = "__all__", "__summary__"
_FEW = "too few / single-class"
_METRICS = ("audet", "apcer_at", "threshold_at", "eer", "score")


def _noted(bundles: DataFrame, note: str = _FEW) -> DataFrame:
    return bundles.withColumn("note", F.when(F.col("audet").isNull(), note))


def holdout_report(splits: DataFrame, scores: DataFrame, names: Sequence[str] = ("val", "test"), id_: str = "id", label: str = "label", type_: str = "type") -> DataFrame:
    """(split, type, n, n_att, n_gen, metrics, note) of each named split as a whole and by type.

    A split without rows has one row with the note "empty"; a type with one
    class or one row has null metrics and a note.
    """
    rows = splits.where(F.col("split").isin(*names)).join(scores.select(id_, "s"), id_).select("split", F.col(type_).alias("type"), F.col(label).alias("y"), "s")
    both = rows.withColumn("type", F.explode(F.array(F.lit(WHOLE), "type")))
    got = _noted(score_bundle(both, ["split", "type"]))
    wanted = splits.sparkSession.createDataFrame([(n,) for n in names], "split string")
    empty = wanted.join(got.select("split").distinct(), "split", "left_anti").select("split", F.lit(WHOLE).alias("type"), F.lit(0).cast("long").alias("n"), F.lit("empty").alias("note"))
    return got.unionByName(empty, allowMissingColumns=True)


def cv_report(splits: DataFrame, scores: DataFrame, id_: str = "id", label: str = "label", type_: str = "type") -> DataFrame:
    """(fold, n_train, n_val, metrics, val_types, val_fraud_rate), one row a fold; scores are (id, cv_fold, s) of each fold's own rows.

    Raises if a fold has not exactly one score for each of its rows.
    """
    pool = splits.where("cv_fold >= 0").select(id_, F.col(label).alias("y"), F.col(type_).alias("type"), "cv_fold")
    given = scores.select(id_, F.col("cv_fold").alias("__fold"), "s")
    joined = pool.join(given, (pool[id_] == given[id_]) & (pool["cv_fold"] == given["__fold"]), "left").select(pool[id_], "y", "type", "cv_fold", "s")
    expected = pool.groupBy("cv_fold").agg(F.count("*").alias("n"))
    counts = given.groupBy("__fold").agg(F.count("*").alias("got"))
    unmet = expected.join(counts, expected["cv_fold"] == counts["__fold"], "full").where("n is null or got is null or n <> got").collect()  # a row a fold
    if unmet or joined.where("s is null").limit(1).count():
        raise ValueError("scores and rows differ in folds " + (", ".join(f"{r['cv_fold'] if r['cv_fold'] is not None else r['__fold']}: {r['got'] or 0} for {r['n'] or 0}" for r in unmet) or "by id"))
    got = score_bundle(joined, ["cv_fold"])
    about = pool.groupBy("cv_fold").agg(F.count("*").alias("n_val"), F.avg("y").alias("val_fraud_rate"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("val_types"))
    total = pool.agg(F.count("*").alias("total"))
    out = got.drop("n").join(about, "cv_fold").join(F.broadcast(total))  # one row
    return out.select(F.col("cv_fold").alias("fold"), (F.col("total") - F.col("n_val")).alias("n_train"), "n_val", *_METRICS, "val_types", "val_fraud_rate")


def cv_summary(report: DataFrame) -> DataFrame:
    """One row: mean, population deviation, least and greatest score, mean and deviation of AuDET, and folds."""
    return report.agg(
        F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"), F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.avg("audet").alias("audet_mean"), F.stddev_pop("audet").alias("audet_std"), F.count("score").alias("n_folds"),
    )


def loto_report(sizes: DataFrame, scored: DataFrame, type_: str = "type") -> DataFrame:
    """(type, n_train, n_val, metrics, note) of every held type, and a summary row with mean and deviation of the scores.

    ``sizes`` is that of `splits.loto_sizes`; ``scored`` has (type, y, s) of
    rows that a model of the other types scored. A type with one class or
    without train rows is noted "skipped"; the summary's n_val is the number
    of types that were scored, and without any it is left out.
    """
    got = score_bundle(scored.select(F.col(type_).alias("type"), "y", "s"), ["type"])
    rows = sizes.select(F.col("held_type").alias("type"), "n_train", F.col("n_held").alias("n_val")).join(got.drop("n", "n_att", "n_gen"), "type", "left")
    skipped = (F.col("n_train") == 0) | F.col("audet").isNull()
    rows = rows.select("type", "n_train", "n_val", *[F.when(~skipped, F.col(m)).alias(m) for m in _METRICS], F.when(skipped, "skipped").alias("note"))
    summary = rows.agg(F.avg("score").alias("score"), F.stddev_pop("score").alias("score_std"), F.count("score").alias("n_val")).where("n_val > 0")
    return rows.unionByName(summary.select(F.lit(SUMMARY).alias("type"), "score", "score_std", "n_val"), allowMissingColumns=True)


def sanity_report(splits: DataFrame, links: DataFrame, id_: str = "id", group: str = "split_group") -> DataFrame:
    """(section, key, value) of a split: rows and rates of its parts, groups, the spread of fold rates, leaking links, shared types.

    Raises if a group or an id is in two parts or folds.
    """
    assert_no_leakage(splits, id_, group)
    row = lambda section, key, value: F.struct(F.lit(section).alias("section") if isinstance(section, str) else section.alias("section"), key.alias("key"), value.cast("double").alias("value"))
    parts = split_stats(splits).select(F.inline(F.array(*[row("partitions", F.concat_ws(".", "split", F.lit(c)), F.col(c)) for c in ("n", "n_fraud", "rate", "n_types", "n_groups", "n_countries")])))
    sizes = splits.groupBy(group).agg(F.count("*").alias("n")).agg(F.count("*").alias("all"), F.count_if(F.col("n") > 1).alias("several"))
    groups = sizes.select(F.inline(F.array(row("groups", F.lit("n_groups"), F.col("all")), row("groups", F.lit("n_nontrivial_groups"), F.col("several")))))
    rates = splits.where("cv_fold >= 0").groupBy("cv_fold").agg(F.avg("label").alias("r"))
    spread = rates.agg(F.min("r").alias("min"), F.max("r").alias("max"), F.stddev_pop("r").alias("std"), F.count("r").alias("folds"))
    spread = spread.select(F.inline(F.array(*[row("cv_fraud_rate_spread", F.lit(c), F.col(c)) for c in ("min", "max", "std", "folds")])))
    leaks = leaking_pairs(links, splits, id_).agg(F.count("*").alias("n")).select(F.inline(F.array(row("duplicates", F.lit("leaking"), F.col("n")))))
    out = parts.unionAll(groups).unionAll(spread).unionAll(leaks)
    for a, b in (("train", "val"), ("train", "test"), ("val", "test")):
        out = out.unionAll(type_overlap(splits, a, b).select(F.inline(F.array(row(f"type_overlap.{a}_{b}", F.col("type"), F.lit(1))))))
    return out
