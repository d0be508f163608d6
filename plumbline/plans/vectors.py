"""Queries over array kernels, probes, neighbours and models."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import forensics as fs
from ..functions import kernels as ks
from ..operators import probes as pb
from .registry import query
from .views import SCORES, items, load, micro, micro_sql, scores

#: Boosting rounds of the registered probe; a fit is a chain of jobs, as many as rounds times depth.
BOOSTING_ROUNDS = 20
V = "list_transform(embedding, lambda x: x::DOUBLE)"


def _vectors(spark, sf):
    return load(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


@query("normalised_vectors", f"WITH v AS (SELECT vec_id, {V} AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT vec_id, list_transform(v, lambda x: CAST(floor(x / n * 1e6 + 0.5) AS BIGINT)) AS u FROM n")
def normalised_vectors(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.transform(ks.normalised(F.col("embedding")), micro).alias("u"))


@query("colour_stats", f"WITH v AS (SELECT vec_id, {V} AS v FROM embeddings), m AS (SELECT vec_id, v, list_avg(v) AS m FROM v) SELECT vec_id, {micro_sql('m')} AS mean, {micro_sql('sqrt(list_avg(list_transform(v, lambda x: (x - m) * (x - m))))')} AS std, {micro_sql('list_min(v)')} AS min, {micro_sql('list_max(v)')} AS max, {micro_sql('len(list_filter(v, lambda x: x > m + 1)) / 64.0::DOUBLE')} AS bright, {micro_sql('len(list_filter(v, lambda x: x < m - 1)) / 64.0::DOUBLE')} AS dark FROM m")
def colour_stats(spark, sf):
    s = ks.colour_stats(F.col("embedding"))
    return _vectors(spark, sf).select("vec_id", *[micro(c).alias(n) for n, c in s.items()])


def _dct_sql() -> str:
    rows = ", ".join(f"({k}, {i}, {ks.dct_matrix()[k][i]!r}::DOUBLE)" for k in range(8) for i in range(8))
    return f"""WITH d(k, i, c) AS (VALUES {rows}), p AS (SELECT vec_id, unnest(range(64)) AS ix, unnest({V}) AS x FROM embeddings),
half AS (SELECT vec_id, k, ix % 8 AS j, sum(c * x) AS y FROM p JOIN d ON d.i = ix // 8 GROUP BY ALL),
full_ AS (SELECT vec_id, half.k AS k, d.k AS q, sum(y * d.c) AS z FROM half JOIN d ON d.i = half.j GROUP BY ALL)
SELECT vec_id, CAST(floor(max(z) FILTER (k = 0 AND q = 0) * 1e5 + 0.5) AS BIGINT) AS dc, CAST(floor(sqrt(avg(z * z) FILTER (k + q > 0)) * 1e5 + 0.5) AS BIGINT) AS ac, count(*) FILTER (k + q > 0 AND abs(z) < 0.1) AS near_zero FROM full_ GROUP BY vec_id"""


@query("dct_stats", _dct_sql())
def dct_stats(spark, sf):
    rows = _vectors(spark, sf).withColumn("z", ks.dct2(F.col("embedding")))
    ac = F.slice("z", 2, 63)
    squares = F.aggregate(ac, F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("vec_id", F.floor(F.get("z", F.lit(0)) * 1e5 + 0.5).cast("long").alias("dc"), F.floor(F.sqrt(squares / 63) * 1e5 + 0.5).cast("long").alias("ac"), F.size(F.filter(ac, lambda x: F.abs(x) < 0.1)).cast("long").alias("near_zero"))


@query("npr_stats", f"WITH v AS (SELECT vec_id, {V} AS v FROM embeddings), r AS (SELECT vec_id, list_transform(range(64), lambda p: v[p + 1] - v[((p // 8) // 2) * 16 + ((p % 8) // 2) * 2 + 1]) AS r FROM v) SELECT vec_id, {micro_sql('list_avg(list_transform(r, lambda x: abs(x)))')} AS mean_abs, {micro_sql('list_max(r)')} AS max FROM r")
def npr_stats(spark, sf):
    r = ks.upsampled_residual(F.col("embedding"))
    return _vectors(spark, sf).select("vec_id", micro(ks.mean(F.transform(r, F.abs))).alias("mean_abs"), micro(F.array_max(r)).alias("max"))


_TILES = f"tiles AS (SELECT vec_id, c, avg(x) AS t FROM (SELECT vec_id, (ix // 16) * 4 + (ix % 8) // 2 AS c, x FROM (SELECT vec_id, unnest(range(64)) AS ix, unnest({V}) AS x FROM embeddings)) GROUP BY vec_id, c)"


@query("mad_tiles", f"WITH {_TILES}, m AS (SELECT vec_id, c, t, median(t) OVER (PARTITION BY vec_id) AS m FROM tiles), d AS (SELECT *, median(abs(t - m)) OVER (PARTITION BY vec_id) AS mad FROM m) SELECT vec_id, CAST(floor(max(0.6745::DOUBLE * (t - m) / mad) * 1e5 + 0.5) AS BIGINT) AS max, count(*) FILTER (abs(0.6745::DOUBLE * (t - m) / mad) > 2) AS n_odd FROM d GROUP BY vec_id")
def mad_tiles(spark, sf):
    z = ks.mad_scores(ks.tiles(F.col("embedding")))
    return _vectors(spark, sf).select("vec_id", F.floor(F.array_max(z) * 1e5 + 0.5).cast("long").alias("max"), F.size(F.filter(z, lambda x: F.abs(x) > 2)).cast("long").alias("n_odd"))


@query("neighbour_anomaly", f"WITH {_TILES}, n AS (SELECT a.vec_id, a.c, avg(abs(a.t - b.t)) AS d FROM tiles a JOIN tiles b ON a.vec_id = b.vec_id AND a.c <> b.c AND abs(a.c // 4 - b.c // 4) <= 1 AND abs(a.c % 4 - b.c % 4) <= 1 GROUP BY a.vec_id, a.c), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC) AS ix FROM n) SELECT vec_id, {micro_sql('max(d)')} AS max, {micro_sql('avg(d)')} AS mean, {micro_sql('avg(d) FILTER (ix <= 5)')} AS top5 FROM o GROUP BY vec_id")
def neighbour_anomaly(spark, sf):
    rows = _vectors(spark, sf).withColumn("t", ks.tiles(F.col("embedding"))).withColumn("d", ks.neighbour_distances(F.col("t"), 4))
    return rows.select("vec_id", micro(F.array_max("d")).alias("max"), micro(ks.mean(F.col("d"))).alias("mean"), micro(ks.top_mean(F.col("d"))).alias("top5"))


# --- forensic families, on images made of products of a vector's entries ---

_SIDE = 16
_PIXELS = f"""v AS (SELECT vec_id, {V} AS v FROM embeddings), px AS (SELECT vec_id, i, j, 128 + 4000 * v[i + 1] * v[j + 1] AS r, 128 + 4000 * v[i + 1] * v[64 - j] AS g, 128 + 4000 * v[64 - i] * v[j + 1] AS b FROM v, range({_SIDE}) a(i), range({_SIDE}) b(j)),
grey AS (SELECT *, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS y, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px)"""


def _images(spark, sf, side):
    return _vectors(spark, sf).select("vec_id", "label", fs.outer_image(F.col("embedding"), side).alias("pixels"))


def _named(df, names):
    return df.select("vec_id", *[micro(F.get("x", F.lit(i))).alias(n) for i, n in enumerate(names)])


_MOMENTS = ", ".join(f"{micro_sql(f'{f}({c})')} AS col_{n}_{m}" for c, n in (("r", "r"), ("g", "g"), ("b", "b"), ("y", "gray")) for f, m in (("avg", "mean"), ("stddev_pop", "std"), ("skewness", "skew"), ("kurtosis", "kurt")))


@query("colour_features", f"WITH {_PIXELS}, s AS (SELECT *, CASE WHEN hi > 0 THEN (hi - lo) / (hi + 1e-6) ELSE 0 END AS s FROM grey) SELECT vec_id, {_MOMENTS}, {micro_sql('avg(s)')} AS col_sat_mean, {micro_sql('stddev_pop(s)')} AS col_sat_std, {micro_sql('avg((y > 250)::INTEGER)')} AS col_frac_bright, {micro_sql('avg((y < 5)::INTEGER)')} AS col_frac_dark FROM s GROUP BY vec_id")
def colour_features(spark, sf):
    return _named(fs.with_vector(_images(spark, sf, _SIDE), "x", fs.colour, "pixels", (_SIDE, _SIDE, 3)), fs.COLOUR)


def _dct_families_sql() -> str:
    basis = ", ".join(f"({k}, {i}, {float(fs.dct_basis()[k, i])!r}::DOUBLE)" for k in range(8) for i in range(8))
    law = ", ".join(f"({d + 1}, {float(x)!r}::DOUBLE)" for d, x in enumerate(fs.FIRST_DIGITS))
    return f"""WITH {_PIXELS}, d(k, n, c) AS (VALUES {basis}), law(f, p) AS (VALUES {law}),
half AS (SELECT vec_id, i // 8 AS bi, j // 8 AS bj, k, j % 8 AS jj, sum(c * y) AS h FROM grey JOIN d ON d.n = i % 8 GROUP BY ALL),
ac AS (SELECT vec_id, bi, bj, half.k AS k, d.k AS l, sum(h * d.c) AS z FROM half JOIN d ON d.n = jj GROUP BY ALL HAVING half.k + d.k > 0),
q AS (SELECT vec_id, CAST(substr(CAST(CAST(abs(round_even(z, 0)) AS BIGINT) AS VARCHAR), 1, 1) AS INTEGER) AS f FROM ac WHERE abs(round_even(z, 0)) >= 1),
shares AS (SELECT vec_id, f, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY vec_id) AS s FROM q GROUP BY vec_id, f),
chi AS (SELECT v.vec_id, sum(pow(coalesce(s, 0) - p, 2) / (p + 1e-9)) AS chi2 FROM (SELECT DISTINCT vec_id FROM q) v CROSS JOIN law LEFT JOIN shares ON shares.vec_id = v.vec_id AND shares.f = law.f GROUP BY v.vec_id),
st AS (SELECT vec_id, stddev_pop(z) AS sd, kurtosis(z) AS kurt, avg((abs(z) < 0.5)::INTEGER) AS zero FROM ac GROUP BY vec_id),
dh AS (SELECT a.vec_id, a.i, abs(b.y - a.y) AS x FROM grey a JOIN grey b ON a.vec_id = b.vec_id AND b.i = a.i + 1 AND b.j = a.j),
dv AS (SELECT a.vec_id, a.j, abs(b.y - a.y) AS x FROM grey a JOIN grey b ON a.vec_id = b.vec_id AND b.j = a.j + 1 AND b.i = a.i),
h AS (SELECT vec_id, avg(x) FILTER (i % 8 = 7) AS on_, avg(x) AS off FROM dh GROUP BY vec_id), w AS (SELECT vec_id, avg(x) FILTER (j % 8 = 7) AS on_, avg(x) AS off FROM dv GROUP BY vec_id)
SELECT st.vec_id, {micro_sql('chi2')} AS dct_benford_chi2, {micro_sql('sd')} AS dct_ac_std, {micro_sql('kurt')} AS dct_ac_kurt, {micro_sql('zero')} AS dct_zero_frac, {micro_sql('(h.on_ + w.on_) / 2')} AS jpeg_blockiness, {micro_sql('(h.on_ + w.on_) / 2 / ((h.off + w.off) / 2 + 1e-9)')} AS jpeg_grid_ratio
FROM st JOIN chi USING (vec_id) JOIN h USING (vec_id) JOIN w USING (vec_id)"""


@query("dct_features", _dct_families_sql())
def dct_features(spark, sf):
    rows = fs.with_vector(_images(spark, sf, _SIDE), "x", lambda x: fs.dct(x @ fs.GREY), "pixels", (_SIDE, _SIDE, 3))
    return _named(rows, fs.DCT)


@query("forensic_features")
def forensic_features(spark, sf):
    rows = _images(spark, sf, 64).withColumn("bytes", F.lit(64.0 * 64 * 3))
    return fs.with_vector(rows, "features", fs.feature_vector, "pixels", (64, 64, 3), "bytes").select("vec_id", "features")


@query("spectral_maps")
def spectral_maps(spark, sf):
    rows = fs.with_vector(_images(spark, sf, 64), "x", lambda x: sum(fs.spectral_map(x @ fs.GREY), []), "pixels", (64, 64, 3))
    return rows.select("vec_id", "label", F.slice("x", 1, 64).alias("radial"), F.slice("x", 65, 1024).alias("pooled"))


@query("upsampling_maps")
def upsampling_maps(spark, sf):
    rows = fs.with_vector(_images(spark, sf, 64), "x", lambda x: sum(fs.upsampling_map(x @ fs.GREY), []), "pixels", (64, 64, 3))
    return rows.select("vec_id", F.slice("x", 1, 3).alias("stats"), F.slice("x", 4, 64).alias("radial"), F.slice("x", 68, 1024).alias("pooled"))


@query("region_noise")
def region_noise(spark, sf):
    rows = fs.with_vector(_images(spark, sf, 64), "x", lambda x: fs.region_noise(x @ fs.GREY, 8), "pixels", (64, 64, 3))
    return rows.select("vec_id", F.col("x").alias("features"))


@query("patch_anomaly")
def patch_anomaly(spark, sf):
    return fs.with_vector(_vectors(spark, sf), "x", lambda x: fs.patch_anomaly(x, 4), "embedding", (16, 4)).select("vec_id", F.col("x").alias("features"))


@query("model_scores")
def model_scores(spark, sf):
    def model():
        import numpy as np

        w = np.cos(np.arange(64))
        return lambda x: 1 / (1 + np.exp(-x @ w))

    return ks.predicted(_vectors(spark, sf), model, "embedding").select("vec_id", "score")


# --- probes ---

_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _long(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_linestatus").alias("type"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), *_COLS)
    return pb.long_features(rows, _COLS, ["type", "label"])


_LONG = "long AS (SELECT type, label, feature, value FROM (SELECT l_linestatus AS type, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))"


def _auc_sql(keys: str) -> str:
    return f"ranked AS (SELECT {keys}, label, 2 * rank() OVER (PARTITION BY {keys} ORDER BY value) + count(*) OVER (PARTITION BY {keys}, value) - 1 AS twice FROM long), aucs AS (SELECT {keys}, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, (sum(twice) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1))::DOUBLE / nullif(2 * count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auc FROM ranked GROUP BY {keys})"


@query("auc_by_feature", f"WITH {_LONG}, {_auc_sql('feature')} SELECT feature, n_pos, n_neg, {micro_sql('auc')} AS auc FROM aucs")
def auc_by_feature(spark, sf):
    return pb.auc(_long(spark, sf), ["feature"]).withColumn("auc", micro(F.col("auc")))


@query("feature_robustness", f"WITH {_LONG}, {_auc_sql('feature, type')}, a AS (SELECT feature, greatest(auc, 1 - auc) AS a FROM aucs) SELECT feature, {micro_sql('avg(a)')} AS mean_auc, {micro_sql('min(a)')} AS min_auc, {micro_sql('max(a)')} AS max_auc, min(a) >= 0.58 AS robust FROM a GROUP BY feature")
def feature_robustness(spark, sf):
    got = pb.feature_robustness(_long(spark, sf))
    return got.select("feature", *[micro(F.col(c)).alias(c) for c in ("mean_auc", "min_auc", "max_auc")], "robust")


@query("top_features", f"WITH {_LONG}, {_auc_sql('feature')} SELECT feature, {micro_sql('auc')} AS auc FROM aucs ORDER BY auc DESC, feature LIMIT 2")
def top_features(spark, sf):
    return pb.top_features(pb.auc(_long(spark, sf), ["feature"]), 2).select("feature", micro(F.col("auc")).alias("auc"))


@query("score_auc", f"WITH {SCORES}, long AS (SELECT model, y AS label, s AS value FROM scores), {_auc_sql('model')} SELECT model, n_pos, n_neg, {micro_sql('auc')} AS auc FROM aucs")
def score_auc(spark, sf):
    return pb.auc(scores(spark, sf), ["model"], "s", "y").withColumn("auc", micro(F.col("auc")))


@query("mutual_information", f"WITH {_LONG}, e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature), c AS (SELECT feature, least(floor((value - lo) / (hi - lo) * 16), 15)::INTEGER AS b, label, count(*) AS n FROM long JOIN e USING (feature) GROUP BY ALL), s AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, label) AS nl, sum(n) OVER (PARTITION BY feature) AS nn FROM c) SELECT feature, {micro_sql('sum(n::DOUBLE / nn * ln(n::DOUBLE * nn / (nb::DOUBLE * nl)))')} AS mi FROM s GROUP BY feature")
def mutual_information(spark, sf):
    return pb.mutual_information(_long(spark, sf), "value", "label", keys=["feature"]).withColumn("mi", micro(F.col("mi")))


_HALF = f"h AS (SELECT label % 3 AS type, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END AS y, unnest(range(64)) AS pos, unnest({V}) AS x FROM embeddings), m AS (SELECT type, y, pos, avg(x) AS mean FROM h GROUP BY ALL)"


def _halves(spark, sf):
    return _vectors(spark, sf).select((F.col("label") % 3).alias("type"), F.when(F.col("vec_id") % 2 == 0, 1).otherwise(0).alias("y"), "embedding")


@query("diff_corr_mean", f"WITH {_HALF}, d AS (SELECT type, pos, max(mean) FILTER (y = 1) - max(mean) FILTER (y = 0) AS diff FROM m GROUP BY type, pos), r AS (SELECT corr(a.diff, b.diff) AS r FROM d a JOIN d b ON a.pos = b.pos AND a.type < b.type GROUP BY a.type, b.type) SELECT {micro_sql('avg(r)')} AS mean_off_diagonal, count(*) AS n_pairs FROM r")
def diff_corr_mean(spark, sf):
    got = pb.mean_correlation(pb.map_correlations(pb.difference_maps(_halves(spark, sf), "embedding", "type", "y"), "type"))
    return got.withColumn("mean_off_diagonal", micro(F.col("mean_off_diagonal")))


@query("mean_vectors", f"WITH {_HALF} SELECT type, y, CAST(pos AS INTEGER) AS pos, {micro_sql('mean')} AS mean FROM m")
def mean_vectors(spark, sf):
    return pb.mean_vectors(_halves(spark, sf), "embedding", ["type", "y"]).withColumn("mean", micro(F.col("mean")))


@query("diff_corr", f"WITH {_HALF}, d AS (SELECT type, pos, max(mean) FILTER (y = 1) - max(mean) FILTER (y = 0) AS diff FROM m GROUP BY type, pos) SELECT a.type AS a, b.type AS b, {micro_sql('corr(a.diff, b.diff)')} AS r FROM d a JOIN d b ON a.pos = b.pos AND a.type < b.type GROUP BY a.type, b.type")
def diff_corr(spark, sf):
    return pb.map_correlations(pb.difference_maps(_halves(spark, sf), "embedding", "type", "y"), "type").withColumn("r", micro(F.col("r")))


_UNIT = f"u AS (SELECT vec_id, label, list_transform(v, lambda x: x / n) AS u FROM (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, label, {V} AS v FROM embeddings)))"


@query("knn_loo", f"WITH {_UNIT}, d AS (SELECT a.vec_id, a.label, b.label AS rl, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_dot_product(a.u, b.u), b.vec_id) AS ix FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), v AS (SELECT vec_id, label, rl, count(*) AS n FROM d WHERE ix <= 3 GROUP BY ALL) SELECT vec_id, label, arg_min(rl, row(-n, rl)) AS vote, label = arg_min(rl, row(-n, rl)) AS correct FROM v GROUP BY vec_id, label")
def knn_loo(spark, sf):
    rows = _vectors(spark, sf)
    return pb.loo_neighbours(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", "label")


@query("cosine_silhouette", f"WITH {_UNIT}, d AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_dot_product(a.u, b.u)) AS t, count(*) AS n FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY ALL), s AS (SELECT vec_id, max(t / n) FILTER (label = other) AS a, min(t / n) FILTER (label <> other) AS b FROM d GROUP BY vec_id) SELECT {micro_sql('avg(coalesce((b - a) / greatest(a, b), 0))')} AS silhouette FROM s")
def cosine_silhouette(spark, sf):
    return pb.cosine_silhouette(_vectors(spark, sf), "embedding", "label").select(micro(F.col("silhouette")).alias("silhouette"))


@query("kmeans_silhouette")
def kmeans_silhouette(spark, sf):
    rows, k = pb.best_kmeans(_vectors(spark, sf), "embedding")
    return rows.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("k", F.lit(k))


@query("pca_projection")
def pca_projection(spark, sf):
    return pb.projected(_vectors(spark, sf), "embedding").select("vec_id", "xy")


def _probe_rows(spark, sf):
    x = F.when(F.col("label") == 1, 0.2).otherwise(0.0)
    return items(spark, sf).select("id", "type", "label", F.col("n_chars").cast("double").alias("n"), (x + (F.col("id") % 97) / 97).alias("hint"))


@query("loto_linear_probe")
def loto_linear_probe(spark, sf):
    got = pb.loto_scores(_probe_rows(spark, sf), ["n", "hint"], pb.probe("linear", maxIter=20))
    return pb.auc(got, ["type"], "score")


@query("loto_boosted_probe")
def loto_boosted_probe(spark, sf):
    got = pb.loto_scores(_probe_rows(spark, sf), ["n", "hint"], pb.probe("boosted", maxIter=BOOSTING_ROUNDS))
    return pb.auc(got, ["type"], "score")


@query("permutation_importance")
def permutation_importance(spark, sf):
    return pb.permutation_importance(_probe_rows(spark, sf), ["n", "hint"], lambda d: d.withColumn("score", F.col("hint") - F.col("n") / 1e6))


@query("top_in_row", f"WITH v AS (SELECT vec_id, list_reverse_sort({V}) AS v FROM embeddings) SELECT vec_id, {micro_sql('list_avg(v[1:5])')} AS top5, {micro_sql('v[1]')} AS max, {micro_sql('(v[1] - list_avg(v)) / (list_stddev_samp(v) + 1e-6)')} AS peakiness FROM v")
def top_in_row(spark, sf):
    v = F.col("embedding")
    return _vectors(spark, sf).select("vec_id", micro(ks.top_mean(v)).alias("top5"), micro(F.array_max(v)).alias("max"), micro(ks.peakiness(v)).alias("peakiness"))
