"""Score combination, rank transforms and keyed result assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered, running


def probability_average(scores: DataFrame, id_: str = "id", s: str = "s") -> DataFrame:
    """(id, s): mean over the models (or views) of a long table (id, model, s)."""
    return scores.groupBy(id_).agg(F.avg(s).alias(s))


def position_ranks(scores: DataFrame, keys: Sequence[str] = ("model",), id_: str = "id", s: str = "s") -> DataFrame:
    """Add ``rank``: place by score, ties by id, over max(n - 1, 1)."""
    placed = numbered(scores, [s, id_], keys, "__place", "__n")
    return placed.withColumn("rank", F.col("__place") / F.greatest(F.col("__n") - 1, F.lit(1))).drop("__place", "__n")


def tie_ranks(scores: DataFrame, keys: Sequence[str] = ("model",), s: str = "s") -> DataFrame:
    """Add ``rank``: average rank of equal scores over n, from the counts of distinct scores."""
    by = scores.groupBy(*keys, s).agg(F.count("*").alias("__ties"))
    by = running(by, [s], F.col("__ties"), keys, "__before", "__n")
    rank = (F.col("__before") + (F.col("__ties") + 1) / 2) / F.col("__n")
    return scores.join(by.select(*keys, s, rank.alias("rank")), [*keys, s]).select(*scores.columns, "rank")


def rank_average(scores: DataFrame, ties: bool = False, id_: str = "id", s: str = "s") -> DataFrame:
    ranked = tie_ranks(scores, ("model",), s) if ties else position_ranks(scores, ("model",), id_, s)
    return ranked.groupBy(id_).agg(F.avg("rank").alias(s))


def filled(submission: DataFrame, predicted: DataFrame, default: float | str = 0.5, id_: str = "id", s: str = "s") -> DataFrame:
    """(id, s): every submission row with its prediction, or a constant, or with "median" that of the predictions."""
    got = submission.select(id_).join(predicted.select(id_, s), id_, "left")
    if default == "median":
        value = predicted.agg(F.median(s).alias("__fill"))
        return got.join(F.broadcast(value)).select(id_, F.coalesce(s, "__fill").alias(s))
    return got.withColumn(s, F.coalesce(s, F.lit(default)))


def hits(submission: DataFrame, predicted: DataFrame, id_: str = "id") -> DataFrame:
    """One row: submission rows that have a prediction."""
    return submission.join(predicted.select(id_), id_, "left_semi").agg(F.count("*").alias("n"))


def disjoint(a: DataFrame, b: DataFrame, id_: str = "id") -> None:
    n = a.join(b.select(id_), id_, "left_semi").count()
    if n:
        raise AssertionError(f"{n} ids are in both sets")


def assembled(ids: DataFrame, public: DataFrame, private: DataFrame, default: float = 0.5, id_: str = "id", s: str = "s") -> DataFrame:
    """(id, s, origin): rows of two disjoint sets by membership, all others the default."""
    disjoint(public, private, id_)
    both = public.select(id_, s, F.lit("public").alias("origin")).unionByName(private.select(id_, s, F.lit("private").alias("origin")))
    return ids.select(id_).join(both, id_, "left").select(id_, F.coalesce(s, F.lit(default)).alias(s), F.coalesce("origin", F.lit("fill")).alias("origin"))


def keyed_digest(df: DataFrame, id_: str = "id", s: str = "s", buckets: int = 2) -> DataFrame:
    """One row: n and a SHA-256 of all rows (id, score in whole millionths), whatever their order.

    A row's digest is that of its text; rows are dealt to buckets by the first
    ``buckets`` hexadecimal digits, a bucket's digest is that of its sorted
    row digests, and the result that of the buckets' in order: equal rows
    count, and no task holds more than one bucket.
    """
    row = F.sha2(F.concat_ws(",", F.col(id_).cast("string"), F.floor(F.col(s) * 1e6 + 0.5).cast("long").cast("string")), 256)
    part = df.select(row.alias("d")).groupBy(F.substring("d", 1, buckets).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    ordered = F.array_sort(F.collect_list(F.struct("b", "d")))
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["d"]), ""), 256).alias("sha256"))


def disagreements(scored: DataFrame, s: str = "s", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Add ``wrong``: whether the thresholded score is not the label."""
    return scored.withColumn("wrong", (F.col(s) > threshold) != (F.col(label) == 1))


def union_first(*frames: DataFrame, id_: str = "id") -> DataFrame:
    """Union by name with one row per id, that of the earliest frame (and there the smallest row hash)."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn("__rank", F.lit(i)).withColumn("__tie", F.xxhash64(*f.columns))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    first = Window.partitionBy(id_).orderBy("__rank", "__tie")
    return out.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__rank", "__tie", "__n")


def aligned(a: DataFrame, b: DataFrame, id_: str = "id", check: Sequence[str] = ("label",)) -> DataFrame:
    """Feature blocks of the same items joined by id; raises if ids or the checked columns differ."""
    renamed = b.select(id_, *[F.col(c).alias(f"__{c}") if c in check else F.col(c) for c in b.columns if c != id_])
    out = a.join(renamed, id_, "full")
    differs = F.lit(False)
    for c in check:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    n = out.where(differs).count()
    if n:
        raise ValueError(f"{n} rows don't agree on {', '.join(check)}")
    return out.drop(*[f"__{c}" for c in check])


def common_union(*frames: DataFrame) -> DataFrame:
    """Union over the columns that all frames have."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    out = frames[0].select(*common)
    for f in frames[1:]:
        out = out.unionByName(f.select(*common))
    return out


def cached_features(wanted: DataFrame, cache: DataFrame, compute, id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """(features of the wanted ids, newly computed rows to append): only ids missing from the cache are computed."""
    new = compute(wanted.join(cache.select(id_), id_, "left_anti"))
    return wanted.select(id_).join(cache.unionByName(new), id_), new
