"""Feature probes: rank AUC, robustness, histogram information, correlations, neighbours, silhouettes and MLlib models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered
from .sampling import shuffled


def long_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, feature, value) from wide numeric columns."""
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])))


def auc(df: DataFrame, keys: Sequence[str], value: str = "value", label: str = "label") -> DataFrame:
    """(keys, n_pos, n_neg, auc): rank statistic with average ranks; null if a class is missing. Missing values are left out.

    Values are aggregated to distinct ones first; twice the rank sum is an
    integer, so the only rounding is one division.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    by = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("twice", 2 * F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("n") + 1)
    out = ranked.groupBy(*keys).agg(F.sum(F.col("p") * F.col("twice")).alias("r2"), F.sum("p").alias("n_pos"), F.sum(F.col("n") - F.col("p")).alias("n_neg"))
    return out.select(*keys, "n_pos", "n_neg", F.try_divide(F.col("r2") - F.col("n_pos") * (F.col("n_pos") + 1), 2 * F.col("n_pos") * F.col("n_neg")).alias("auc"))


def agnostic(a: Column) -> Column:
    return F.greatest(a, 1 - a)


def feature_robustness(long: DataFrame, type_: str = "type", flag: float = 0.58) -> DataFrame:
    """(feature, mean_auc, min_auc, max_auc, robust): direction-agnostic AUC over types, by the least, descending."""
    per = auc(long, ["feature", type_]).withColumn("a", agnostic(F.col("auc")))
    out = per.groupBy("feature").agg(F.avg("a").alias("mean_auc"), F.min("a").alias("min_auc"), F.max("a").alias("max_auc"))
    return out.withColumn("robust", F.col("min_auc") >= flag).orderBy(F.desc_nulls_last("min_auc"), "feature")


def top_features(aucs: DataFrame, k: int, value: str = "auc") -> DataFrame:
    return aucs.orderBy(F.desc_nulls_last(F.when(~F.isnan(value), F.col(value))), "feature").limit(k)


def mutual_information(df: DataFrame, value: str, label: str, bins: int = 16, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mi): information in nats between equal-width bins of the value and the label (a histogram estimate)."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    ends = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = rows.join(ends, list(keys)) if keys else rows.join(F.broadcast(ends))  # without keys one row
    width = F.col("hi") - F.col("lo")
    b = F.when(width <= 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width * bins), F.lit(bins - 1))).cast("int")
    cells = joined.select(*keys, b.alias("b"), F.col(label).alias("l")).groupBy(*keys, "b", "l").agg(F.count("*").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*keys, *c))
    shares = cells.select(*keys, "n", over("b").alias("nb"), over("l").alias("nl"), over().alias("nn"))
    return shares.groupBy(*keys).agg(F.sum(F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nb") * F.col("nl")).cast("double"))).alias("mi"))


def mean_vectors(df: DataFrame, vector: str, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, mean): element means, one row per position."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def difference_maps(df: DataFrame, vector: str, type_: str, label: str) -> DataFrame:
    """(type, pos, diff): mean vector of label 1 minus that of label 0; types with one class have none."""
    m = mean_vectors(df, vector, [type_, label])
    of = lambda k: F.max(F.when(F.col(label) == k, F.col("mean")))
    return m.groupBy(type_, "pos").agg((of(1) - of(0)).alias("diff")).where("diff is not null")


def map_correlations(maps: DataFrame, type_: str) -> DataFrame:
    """(a, b, r) for every pair of types' maps, a < b."""
    left, right = (maps.select(F.col(type_).alias(n), "pos", F.col("diff").alias(f"d{n}")) for n in ("a", "b"))
    return left.join(right, "pos").where("a < b").groupBy("a", "b").agg(F.corr("da", "db").alias("r"))


def mean_correlation(pairs: DataFrame) -> DataFrame:
    """One row: mean_off_diagonal of the correlations, and n_pairs."""
    return pairs.agg(F.avg("r").alias("mean_off_diagonal"), F.count("r").alias("n_pairs"))


def cosine(a: Column, b: Column) -> Column:
    from ..functions.kernels import dot, norm

    return dot(a, b) / (norm(a) * norm(b))


def loo_neighbours(df: DataFrame, queries: DataFrame, id_: str, vector: str, label: str, k: int = 3) -> DataFrame:
    """(id, label, vote, correct): majority label (ties to the smaller) of the k nearest others by cosine distance.

    A stated query set is compared with all rows. The rank limit lets Spark
    keep the k best per query and task before the shuffle.
    """
    q = queries.select(F.col(id_).alias("q"), F.col(label).alias("ql"), F.col(vector).alias("qv"))
    r = df.select(F.col(id_).alias("r"), F.col(label).alias("rl"), F.col(vector).alias("rv"))
    near = r.join(q, F.col("q") != F.col("r")).select("q", "ql", "r", "rl", (1 - cosine(F.col("qv"), F.col("rv"))).alias("d"))
    top = near.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("d", "r"))).where(F.col("at") <= k)
    votes = top.groupBy("q", "ql", "rl").agg(F.count("*").alias("n")).groupBy("q", "ql").agg(F.min_by("rl", F.struct(-F.col("n"), "rl")).alias("vote"))
    return votes.select(F.col("q").alias(id_), F.col("ql").alias("label"), "vote", (F.col("ql") == F.col("vote")).alias("correct"))


def cosine_silhouette(df: DataFrame, vector: str, group: str) -> DataFrame:
    """One row: mean silhouette under cosine distance, exactly, without pairs.

    The mean distance of a row to a group is 1 - u . S / n, with u its unit
    vector and S the sum of the group's unit vectors, so one aggregation of
    group sums and a join with the (few) groups give every row's value.
    """
    from ..functions.kernels import dot, normalised

    rows = df.select(F.monotonically_increasing_id().alias("__i"), F.col(group).alias("g"), normalised(F.col(vector)).alias("u"))
    sums = rows.select("g", F.posexplode("u").alias("p", "x")).groupBy("g", "p").agg(F.sum("x").alias("s"))
    sums = sums.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "s"))), lambda z: z["s"]).alias("s"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    groups = sums.join(sizes, "g").select(F.col("g").alias("h"), "s", "n")
    each = rows.join(groups).select("__i", "g", "h", "n", dot(F.col("u"), F.col("s")).alias("t"), dot(F.col("u"), F.col("u")).alias("self"))
    own = F.col("g") == F.col("h")
    a = F.max(F.when(own & (F.col("n") > 1), (F.col("n") - 1 - (F.col("t") - F.col("self"))) / (F.col("n") - 1)))
    b = F.min(F.when(~own, 1 - F.col("t") / F.col("n")))
    s = each.groupBy("__i").agg(a.alias("a"), b.alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return s.agg(F.avg(value).alias("silhouette"))


# --- MLlib ---


def _assembled(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    if len(inputs) == 1 and df.schema[inputs[0]].dataType.typeName() == "array":
        return df.withColumn("features", array_to_vector(F.col(inputs[0]).cast("array<double>")))
    return VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df)


def probe(kind: str, **options):
    """FitPredict: (train, test) -> test with ``score``; kind "linear" (scaled logistic regression) or "boosted"."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    def run(train: DataFrame, test: DataFrame, inputs: Sequence[str], label: str = "label") -> DataFrame:
        if kind == "linear":
            stages = [StandardScaler(withMean=True, inputCol="features", outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol=label, **options)]
        else:
            stages = [GBTClassifier(labelCol=label, seed=0, **options)]
        model = Pipeline(stages=stages).fit(_assembled(train, inputs))
        return model.transform(_assembled(test, inputs)).withColumn("score", vector_to_array("probability")[1]).drop("features", "scaled", "rawPrediction", "probability", "prediction")

    return run


def loto_scores(df: DataFrame, inputs: Sequence[str], fit_predict, type_: str = "type", label: str = "label") -> DataFrame:
    """Scores of each type by a model of all others; types whose train set has one class are left out."""
    classes = df.groupBy(type_).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).collect()
    out = None
    for r in sorted(classes, key=lambda r: r[type_]):
        if all(any(x[c] for x in classes if x[type_] != r[type_]) for c in ("p", "n")):
            part = fit_predict(df.where(F.col(type_) != r[type_]), df.where(F.col(type_) == r[type_]), inputs, label)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else df.limit(0).withColumn("score", F.lit(0.0))


def best_kmeans(df: DataFrame, vector: str, most: int = 8, seed: int = 0) -> tuple[DataFrame, int]:
    """(rows with ``cluster``, k): k from 2 to min(most, n) by the silhouette of centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = _assembled(df, [vector])
    best = (-2.0, 0, None)
    for k in range(2, min(most, df.count()) + 1):
        out = KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows).transform(rows)
        if out.select("cluster").distinct().count() > 1:
            best = max(best, (ClusteringEvaluator(predictionCol="cluster", distanceMeasure="cosine").evaluate(out), -k, out), key=lambda x: x[:2])
    if best[2] is None:
        return df.withColumn("cluster", F.lit(0)), 1
    return best[2].drop("features"), -best[1]


def projected(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """Add ``xy``: the first principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = _assembled(df, [vector])
    return PCA(k=k, inputCol="features", outputCol="pc").fit(rows).transform(rows).withColumn("xy", vector_to_array("pc")).drop("features", "pc")


def permutation_importance(df: DataFrame, columns: Sequence[str], score, label: str = "label", id_: str = "id", seed: int = 0) -> DataFrame:
    """(feature, drop): loss of AUC when a column's values are dealt anew by hash order; ``score`` adds a column "score"."""
    def rated(rows: DataFrame, name: str) -> DataFrame:
        return auc(score(rows).select(F.lit(name).alias("feature"), F.col("score").alias("value"), label), ["feature"], label=label)

    own = numbered(df, [id_], out="__n")
    dealt = shuffled(df.select(id_, *columns), seed, id_).withColumnRenamed("place", "__n")
    base = rated(df, "")
    out = None
    for c in columns:
        rows = own.drop(c).join(dealt.select(c, "__n"), "__n").drop("__n")
        part = rated(rows, c)
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(base.select(F.col("auc").alias("whole")))).select("feature", (F.col("whole") - F.col("auc")).alias("drop"))


