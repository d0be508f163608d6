"""Queries over curves, score combination, folds and bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sigmoid
from ..operators import bootstrap, curves, ensemble, sampling
from ..operators.profile import positive_weight
from .registry import query
from .views import ITEMS, SCORES, items, load, micro, micro_sql, scores, unit_sql


def points_sql(keys: str, base: str) -> str:
    """CTEs by, run, tot, points of a DET curve; keys: comma-separated columns, or empty."""
    k = keys + ", " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""by_s AS (SELECT {k}s AS threshold, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS g FROM {base} GROUP BY {k}s),
run AS (SELECT {k}threshold, a, g, sum(a) OVER ({part} ORDER BY threshold) AS ca, sum(g) OVER ({part} ORDER BY threshold) AS cg, sum(a) OVER ({part}) AS n_att, sum(g) OVER ({part}) AS n_gen FROM by_s),
tot AS (SELECT {k}count(*) AS n, count(*) FILTER (y = 1) AS n_att, count(*) FILTER (y = 0) AS n_gen FROM {base} {group}),
points AS (SELECT {k}threshold, 1 AS k, CAST(ca - a AS BIGINT) AS fn, CAST(n_gen - cg + g AS BIGINT) AS fp, CAST(n_att AS BIGINT) AS n_att, CAST(n_gen AS BIGINT) AS n_gen FROM run
 UNION ALL SELECT {k}1 + 1e-12::DOUBLE, 0, n_att, 0, n_att, n_gen FROM tot UNION ALL SELECT {k}-1e-12::DOUBLE, 2, 0, n_gen, n_att, n_gen FROM tot)"""


def bundle_sql(keys: str, base: str) -> str:
    """CTEs up to bundle (keys, n, n_att, n_gen, audet, apcer_at, threshold_at, eer, score)."""
    k = keys + ", " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    join = "LEFT JOIN got USING (" + keys + ")" if keys else "LEFT JOIN got ON true"
    return points_sql(keys, base) + f""",
ordered AS (SELECT *, lead(fp) OVER w AS next_fp, lead(fn) OVER w AS next_fn, row_number() OVER w AS pos FROM points WINDOW w AS ({part} ORDER BY fp, k, threshold)),
got AS (SELECT {k}sum((next_fp - fp) * (next_fn + fn))::DOUBLE / (2 * max(n_att) * max(n_gen))::DOUBLE AS audet,
 arg_max(fn::DOUBLE / n_att, pos) FILTER (fp::DOUBLE / n_gen <= 0.01::DOUBLE) AS apcer_at, arg_max(threshold, pos) FILTER (fp::DOUBLE / n_gen <= 0.01::DOUBLE) AS threshold_at,
 arg_min((fp::DOUBLE / n_gen + fn::DOUBLE / n_att) / 2, row(abs(fp::DOUBLE / n_gen - fn::DOUBLE / n_att), pos)) AS eer
 FROM ordered WHERE n_att > 0 AND n_gen > 0 {"GROUP BY " + keys if keys else ""}),
bundle AS (SELECT {k}n, tot.n_att, tot.n_gen, audet, apcer_at, threshold_at, eer,
 CASE WHEN audet IS NULL THEN NULL WHEN (1 - audet) + (1 - apcer_at) <= 0 THEN 1.0::DOUBLE ELSE 1 - 2 * (1 - audet) * (1 - apcer_at) / ((1 - audet) + (1 - apcer_at)) END AS score FROM tot {join})"""


_METRICS = ("audet", "apcer_at", "eer", "score")


def _whole(df, *keys):
    return df.select(*keys, "n", "n_att", "n_gen", *[micro(F.col(m)).alias(m) for m in _METRICS], "threshold_at")


_WHOLE = "n, n_att, n_gen, " + ", ".join(f"{micro_sql(m)} AS {m}" for m in _METRICS) + ", threshold_at"
M1 = "m1s AS (SELECT id, type, y, s FROM scores WHERE model = 'm1')"


def m1(spark, sf):
    return scores(spark, sf).where("model = 'm1'").select("id", "type", "y", "s")


@query("det_curve", f"WITH {SCORES}, {points_sql('model', 'scores')} SELECT model, row_number() OVER (PARTITION BY model ORDER BY fp, k, threshold) AS position, fp::DOUBLE / n_gen AS bpcer, fn::DOUBLE / n_att AS apcer, threshold FROM points")
def det_curve(spark, sf):
    return curves.det_curve(scores(spark, sf), ["model"])


@query("score_bundle", f"WITH {SCORES}, {M1}, {bundle_sql('', 'm1s')} SELECT {_WHOLE} FROM bundle")
def score_bundle(spark, sf):
    return _whole(curves.score_bundle(curves.validated(m1(spark, sf))))


@query("score_by_type", f"WITH {SCORES}, {bundle_sql('model, type', 'scores')} SELECT model, type, {_WHOLE} FROM bundle")
def score_by_type(spark, sf):
    return _whole(curves.score_bundle(scores(spark, sf), ["model", "type"]), "model", "type")


@query("score_by_model", f"WITH {SCORES}, {bundle_sql('model', 'scores')} SELECT model, {_WHOLE} FROM bundle")
def score_by_model(spark, sf):
    return _whole(curves.score_bundle(scores(spark, sf), ["model"]), "model")


@query("score_on_lineitem", f"""WITH base AS (SELECT l_shipdate < TIMESTAMP '1995-01-01' AS early, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * 10 AS s FROM lineitem), {bundle_sql('early', 'base')} SELECT early, {_WHOLE} FROM bundle""")
def score_on_lineitem(spark, sf):
    rows = load(spark, sf, "lineitem").select((F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("early"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), (F.col("l_discount") * 10).alias("s"))
    return _whole(curves.score_bundle(rows, ["early"]), "early")


@query("error_rates_at", f"WITH {SCORES} SELECT model, type, coalesce(count(*) FILTER (s < 0.5 AND y = 1)::DOUBLE / nullif(count(*) FILTER (y = 1), 0), 0) AS apcer, coalesce(count(*) FILTER (s >= 0.5 AND y = 0)::DOUBLE / nullif(count(*) FILTER (y = 0), 0), 0) AS bpcer FROM scores GROUP BY model, type")
def error_rates_at(spark, sf):
    return curves.error_rates_at(scores(spark, sf), 0.5, ["model", "type"])


@query("metric_spread", f"WITH {SCORES}, {bundle_sql('model, type', 'scores')} SELECT model, {micro_sql('avg(score)')} AS mean, {micro_sql('stddev_pop(score)')} AS std, {micro_sql('min(score)')} AS min, {micro_sql('max(score)')} AS max, count(score) AS n FROM bundle GROUP BY model")
def metric_spread(spark, sf):
    got = curves.spread(curves.score_bundle(scores(spark, sf), ["model", "type"]), "score", ["model"])
    return got.select("model", *[micro(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")], "n")


@query("loto_worst", f"WITH {SCORES}, {bundle_sql('model, type', 'scores')} SELECT model, arg_max(type, row(score, type)) AS worst_type, {micro_sql('max(score)')} AS worst FROM bundle GROUP BY model")
def loto_worst(spark, sf):
    return curves.score_bundle(scores(spark, sf), ["model", "type"]).groupBy("model").agg(F.max_by("type", F.struct("score", "type")).alias("worst_type"), micro(F.max("score")).alias("worst"))


_FOLDS = "folds AS (SELECT id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('7:' || id), id) - 1) % 5 AS BIGINT) AS fold FROM items)"


@query("score_by_fold", f"WITH {SCORES}, {_FOLDS}, base AS (SELECT fold, y, s FROM scores JOIN folds USING (id) WHERE model = 'm1'), {bundle_sql('fold', 'base')} SELECT fold, {_WHOLE} FROM bundle")
def score_by_fold(spark, sf):
    folds = sampling.k_folds(items(spark, sf).select("id", "label"), 5, 7).select("id", "fold")
    return _whole(curves.score_bundle(m1(spark, sf).join(folds, "id"), ["fold"]), "fold")


@query("paired_conditions", f"WITH {SCORES}, base AS (SELECT type, 'clean' AS condition, y, s FROM scores WHERE model = 'm1' UNION ALL SELECT type, 'degraded', y, s * 0.8 + 0.1 FROM scores WHERE model = 'm1'), {bundle_sql('type, condition', 'base')} SELECT type, max({micro_sql('score')}) FILTER (condition = 'clean') AS clean, max({micro_sql('score')}) FILTER (condition = 'degraded') AS degraded FROM bundle GROUP BY type")
def paired_conditions(spark, sf):
    both = m1(spark, sf).select("type", "y", F.inline(F.array(F.struct(F.lit("clean").alias("condition"), F.col("s").alias("t")), F.struct(F.lit("degraded").alias("condition"), (F.col("s") * 0.8 + 0.1).alias("t"))))).withColumnRenamed("t", "s")
    got = curves.score_bundle(both, ["type", "condition"])
    return got.groupBy("type").agg(*[micro(F.max(F.when(F.col("condition") == c, F.col("score")))).alias(c) for c in ("clean", "degraded")])


@query("ensemble_vs_members", f"""WITH {SCORES}, prob AS (SELECT id, any_value(y) AS y, {micro_sql('avg(s)')} / 1e6 AS s FROM scores GROUP BY id),
ranked AS (SELECT id, y, (rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model) AS r FROM scores),
base AS (SELECT model, y, s FROM scores UNION ALL SELECT 'prob', y, s FROM prob UNION ALL SELECT 'rank', any_value(y), {micro_sql('avg(r)')} / 1e6 FROM ranked GROUP BY id),
{bundle_sql('model', 'base')} SELECT model, {_WHOLE} FROM bundle""")
def ensemble_vs_members(spark, sf):
    s = scores(spark, sf)
    y = items(spark, sf).select("id", F.col("label").alias("y"))
    rounded = lambda df, name: df.join(y, "id").select(F.lit(name).alias("model"), "y", (micro(F.col("s")) / 1e6).alias("s"))
    base = s.select("model", "y", "s").unionByName(rounded(ensemble.probability_average(s), "prob")).unionByName(rounded(ensemble.rank_average(s, ties=True), "rank"))
    return _whole(curves.score_bundle(base, ["model"]), "model")


_B = "rows AS (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY id) - 1 AS ix, count(*) OVER (PARTITION BY y) AS n FROM m1s)"
_BOOT = f"""WITH {SCORES}, {M1}, {_B}, draws AS (SELECT r AS replicate, y, CAST(floor({unit_sql("r || ':' || y || ':' || ix")} * n) AS BIGINT) AS ix FROM rows CROSS JOIN range(500) t(r)),
base AS (SELECT d.replicate, rows.y, rows.s FROM draws d JOIN rows ON d.y = rows.y AND d.ix = rows.ix), {bundle_sql('replicate', 'base')}"""


@query("bootstrap_ci", f"{_BOOT} SELECT {micro_sql('avg(score)')} AS mean, {micro_sql('stddev_pop(score)')} AS std, {micro_sql('quantile_cont(score, 0.025)')} AS lower, {micro_sql('quantile_cont(score, 0.975)')} AS upper FROM bundle")
def bootstrap_ci(spark, sf):
    got = bootstrap.bootstrap_metric(m1(spark, sf), replicates=500)
    return got.select(*[micro(F.col(c)).alias(c) for c in got.columns])


@query("rank_agreement", f"""WITH {SCORES}, a AS (SELECT model, row_number() OVER (ORDER BY avg(s) FILTER (y = 0), model) AS rank_a FROM scores GROUP BY model),
b AS (SELECT model, row_number() OVER (ORDER BY avg(s) FILTER (y = 1), model) AS rank_b FROM scores GROUP BY model)
SELECT model, CAST(rank_a AS INTEGER) AS rank_a, CAST(rank_b AS INTEGER) AS rank_b, rank_a = rank_b AS agree FROM a JOIN b USING (model)""")
def rank_agreement(spark, sf):
    s = scores(spark, sf)
    of = lambda k: s.groupBy("model").agg(F.avg(F.when(F.col("y") == k, F.col("s"))).alias("v"))
    return curves.rank_agreement(of(0), of(1), "model", "v")


@query("best_epoch", "SELECT o_custkey AS run, arg_min(o_orderkey, row(o_totalprice, o_orderkey)) AS best_epoch, min(o_totalprice) AS best_metric FROM orders GROUP BY o_custkey")
def best_epoch(spark, sf):
    return curves.best_epoch(load(spark, sf, "orders").withColumnRenamed("o_custkey", "run"), ["run"], "o_totalprice", "o_orderkey")


# --- combination ---


@query("prob_avg", f"WITH {SCORES} SELECT id, {micro_sql('avg(s)')} AS s FROM scores GROUP BY id")
def prob_avg(spark, sf):
    return ensemble.probability_average(scores(spark, sf)).withColumn("s", micro(F.col("s")))


@query("rank_avg_pos", f"WITH {SCORES}, r AS (SELECT id, (row_number() OVER (PARTITION BY model ORDER BY s, id) - 1) / greatest(count(*) OVER (PARTITION BY model) - 1, 1)::DOUBLE AS r FROM scores) SELECT id, {micro_sql('avg(r)')} AS s FROM r GROUP BY id")
def rank_avg_pos(spark, sf):
    return ensemble.rank_average(scores(spark, sf)).withColumn("s", micro(F.col("s")))


@query("rank_avg_ties", f"WITH {SCORES}, t AS (SELECT id, model, floor(s * 10) AS s FROM scores), r AS (SELECT id, (rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model) AS r FROM t) SELECT id, {micro_sql('avg(r)')} AS s FROM r GROUP BY id")
def rank_avg_ties(spark, sf):
    tied = scores(spark, sf).withColumn("s", F.floor(F.col("s") * 10).cast("double"))
    return ensemble.rank_average(tied, ties=True).withColumn("s", micro(F.col("s")))


_VIEWS = "SELECT id, model, v, s * (1 - v / 10.0::DOUBLE) AS s FROM scores CROSS JOIN range(3) t(v)"


@query("view_mean", f"WITH {SCORES}, views AS ({_VIEWS}) SELECT id, model, {micro_sql('avg(s)')} AS s FROM views GROUP BY id, model")
def view_mean(spark, sf):
    views = scores(spark, sf).withColumn("v", F.explode(F.array(*map(F.lit, range(3))))).withColumn("s", F.col("s") * (1 - F.col("v") / 10))
    return views.groupBy("id", "model").agg(micro(F.avg("s")).alias("s"))


_PRED = "pred AS (SELECT id, s FROM scores WHERE model = 'm1')"


@query("submission_fill", f"WITH {SCORES}, {_PRED} SELECT doc_id AS id, coalesce(s, 0.5) AS s FROM documents LEFT JOIN pred ON doc_id = id")
def submission_fill(spark, sf):
    return ensemble.filled(load(spark, sf, "documents").select(F.col("doc_id").alias("id")), m1(spark, sf))


@query("submission_fill_median", f"WITH {SCORES}, {_PRED} SELECT doc_id AS id, coalesce(s, (SELECT median(s) FROM pred)) AS s FROM documents LEFT JOIN pred ON doc_id = id")
def submission_fill_median(spark, sf):
    return ensemble.filled(load(spark, sf, "documents").select(F.col("doc_id").alias("id")), m1(spark, sf), "median")


@query("prediction_hits", f"WITH {SCORES}, {_PRED} SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT id FROM pred)")
def prediction_hits(spark, sf):
    return ensemble.hits(load(spark, sf, "documents").select(F.col("doc_id").alias("id")), m1(spark, sf))


@query("final_assembly", f"""WITH {SCORES}, {_PRED} SELECT d.doc_id AS id, coalesce(p.s, 0.5) AS s, CASE WHEN p.id IS NULL THEN 'fill' WHEN p.id % 2 = 0 THEN 'public' ELSE 'private' END AS origin
FROM documents d LEFT JOIN pred p ON d.doc_id = p.id""")
def final_assembly(spark, sf):
    p = m1(spark, sf).select("id", "s")
    return ensemble.assembled(load(spark, sf, "documents").select(F.col("doc_id").alias("id")), p.where("id % 2 = 0"), p.where("id % 2 = 1"))


_FINAL = f"""{SCORES}, {_PRED}, final AS (SELECT d.doc_id AS id, coalesce(p.s, 0.5) AS s FROM documents d LEFT JOIN pred p ON d.doc_id = p.id)"""


@query("assembly_digest", f"WITH {_FINAL}, r AS (SELECT sha256(id || ',' || {micro_sql('s')}) AS d FROM final), b AS (SELECT substr(d, 1, 2) AS b, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS d FROM r GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY b)) AS sha256 FROM b")
def assembly_digest(spark, sf):
    return ensemble.keyed_digest(final_assembly(spark, sf))


@query("disagreements", f"WITH {SCORES} SELECT id, model, (s > 0.5) <> (y = 1) AS wrong FROM scores")
def disagreements(spark, sf):
    return ensemble.disagreements(scores(spark, sf), label="y").select("id", "model", "wrong")


@query("sigmoid_scores", f"WITH {SCORES} SELECT id, {micro_sql('1 / (1 + exp(-(s * 8 - 4)))')} AS p FROM scores WHERE model = 'm1'")
def sigmoid_scores(spark, sf):
    return m1(spark, sf).select("id", micro(sigmoid(F.col("s") * 8 - 4)).alias("p"))


@query("pos_weight", f"WITH {ITEMS} SELECT greatest(count(*) FILTER (label = 0), 1) / greatest(count(*) FILTER (label = 1), 1)::DOUBLE AS pos_weight FROM items")
def pos_weight(spark, sf):
    return positive_weight(items(spark, sf))


# --- pseudo-labels and samples ---


@query("pseudo_hard", f"WITH {SCORES} SELECT id, CASE WHEN s >= 0.9 THEN 1 ELSE 0 END AS label FROM scores WHERE model = 'm1' AND (s >= 0.9 OR s <= 0.1)")
def pseudo_hard(spark, sf):
    return sampling.hard_labels(m1(spark, sf), 0.1, 0.9, "s").select("id", "label")


@query("pseudo_soft", f"WITH {SCORES}, c AS (SELECT id, least(0.9999, greatest(0.0001, s)) AS s FROM scores WHERE model = 'm1') SELECT id, {micro_sql('s')} AS soft, {micro_sql('pow(s, 2) / (pow(s, 2) + pow(1 - s, 2))')} AS sharp FROM c")
def pseudo_soft(spark, sf):
    return m1(spark, sf).select("id", micro(sampling.soft_label(F.col("s"))).alias("soft"), micro(sampling.soft_label(F.col("s"), 2.0)).alias("sharp"))


@query("cap_sample", f"WITH {ITEMS} SELECT id FROM items ORDER BY md5('3:' || id), id LIMIT 100")
def cap_sample(spark, sf):
    return sampling.cap_sample(items(spark, sf).select("id"), 100, 3)


_CELLS = "cells AS (SELECT count(*) AS c FROM (SELECT DISTINCT type, label FROM items)), placed AS (SELECT id, type, label, row_number() OVER (PARTITION BY type, label ORDER BY md5('5:' || id), id) - 1 AS place FROM items)"


@query("strat_sample", f"WITH {ITEMS}, {_CELLS} SELECT id, type, label FROM placed, cells WHERE place < greatest(1, 80 // c)")
def strat_sample(spark, sf):
    return sampling.stratified_sample(items(spark, sf).select("id", "type", "label"), 80, 5, ["type", "label"])


@query("per_cell_sample", f"WITH {ITEMS}, {_CELLS} SELECT id, type, label FROM placed WHERE place < 7")
def per_cell_sample(spark, sf):
    return sampling.per_cell(items(spark, sf).select("id", "type", "label"), 7, 5, ["type", "label"])


@query("frac_holdout", f"WITH {ITEMS} SELECT id, row_number() OVER (PARTITION BY label ORDER BY md5('6:' || id), id) - 1 < floor(count(*) OVER (PARTITION BY label) * 0.06::DOUBLE + 0.5) AS held FROM items")
def frac_holdout(spark, sf):
    return sampling.fraction_holdout(items(spark, sf).select("id", "label"), 0.06, 6, ["label"]).select("id", "held")


@query("validation_carve", f"WITH {ITEMS} SELECT id FROM items ORDER BY md5('9:' || id), id LIMIT (SELECT least(5000, greatest(1, count(*) // 10)) FROM items)")
def validation_carve(spark, sf):
    return sampling.validation_carve(items(spark, sf).select("id"), 9)


@query("train_after_carve", f"WITH {ITEMS}, carve AS (SELECT id FROM items ORDER BY md5('9:' || id), id LIMIT (SELECT least(5000, greatest(1, count(*) // 10)) FROM items)) SELECT id, label FROM items WHERE id NOT IN (SELECT id FROM carve)")
def train_after_carve(spark, sf):
    rows = items(spark, sf).select("id", "label")
    return sampling.anti(rows, sampling.validation_carve(rows, 9))


@query("shuffle_tail", f"WITH {ITEMS} SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('11:' || id) DESC, id DESC) <= 50 THEN 'tail' ELSE 'head' END AS part FROM items")
def shuffle_tail(spark, sf):
    return sampling.head_tail(items(spark, sf).select("id"), 50, 11)


@query("strat_kfold", f"WITH {ITEMS}, {_FOLDS} SELECT id, fold FROM folds")
def strat_kfold(spark, sf):
    return sampling.k_folds(items(spark, sf).select("id", "label"), 5, 7).select("id", "fold")


@query("random_split", f"WITH {ITEMS} SELECT id, row_number() OVER (ORDER BY md5('13:' || id), id) <= floor(count(*) OVER () * 0.8::DOUBLE) AS in_train FROM items")
def random_split(spark, sf):
    return sampling.train_mask(items(spark, sf).select("id"), 0.8, 13)
