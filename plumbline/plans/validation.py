"""Queries of the holdout, fold, held-type and sanity reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as sp
from ..operators import validation as va
from .evaluation import bundle_sql, m1
from .registry import query
from .structure import SERPENTINE, _item_links, _splits
from .views import ITEMS, SCORES, items, micro, micro_sql

#: The split table and the scores of one model.
_SCORED = f"WITH RECURSIVE {SERPENTINE}{SCORES[len(ITEMS):]}, m AS (SELECT id, s FROM scores WHERE model = 'm1')"
_NAMES = ("audet", "apcer_at", "eer", "score")
_SQL = ", ".join(f"{micro_sql(n)} AS {n}" for n in _NAMES)


def _micros(df, *keep):
    return df.select(*keep, *[micro(F.col(n)).alias(n) for n in _NAMES])


@query("holdout_report", f"{_SCORED}, rows AS (SELECT split, type, label AS y, s FROM splits JOIN m USING (id) WHERE split IN ('val', 'test')), base AS (SELECT split, type, y, s FROM rows UNION ALL SELECT split, '__all__', y, s FROM rows), {bundle_sql('split, type', 'base')} SELECT split, type, n, CASE WHEN audet IS NULL THEN 'too few / single-class' END AS note, {_SQL} FROM bundle UNION ALL SELECT 'extra', '__all__', 0, 'empty', NULL, NULL, NULL, NULL")
def holdout_report(spark, sf):
    got = va.holdout_report(_splits(spark, sf), m1(spark, sf).select("id", "s"), ("val", "test", "extra"))
    return _micros(got, "split", "type", "n", "note")


_FOLDS = f"{_SCORED}, base AS (SELECT cv_fold, label AS y, s FROM splits JOIN m USING (id) WHERE cv_fold >= 0), {bundle_sql('cv_fold', 'base')}, about AS (SELECT cv_fold, count(*) AS n_val, avg(label) AS rate, string_agg(DISTINCT type, ',' ORDER BY type) AS val_types FROM splits WHERE cv_fold >= 0 GROUP BY cv_fold)"


def _cv(spark, sf):
    splits = _splits(spark, sf)
    return va.cv_report(splits, m1(spark, sf).select("id", "s").join(splits.where("cv_fold >= 0").select("id", "cv_fold"), "id"))


@query("cv_report", f"{_FOLDS} SELECT cv_fold AS fold, CAST((SELECT sum(n_val) FROM about) - n_val AS BIGINT) AS n_train, n_val, val_types, {micro_sql('rate')} AS val_fraud_rate, {_SQL} FROM bundle JOIN about USING (cv_fold)")
def cv_report(spark, sf):
    return _micros(_cv(spark, sf), "fold", "n_train", "n_val", "val_types", micro(F.col("val_fraud_rate")).alias("val_fraud_rate"))


@query("cv_summary", f"{_FOLDS} SELECT {', '.join(f'{micro_sql(f"{f}({c})")} AS {c}_{n}' for c in ('score', 'audet') for f, n in (('avg', 'mean'), ('stddev_pop', 'std')))}, {micro_sql('min(score)')} AS score_min, {micro_sql('max(score)')} AS score_max, count(score) AS n_folds FROM bundle")
def cv_summary(spark, sf):
    got = va.cv_summary(_cv(spark, sf))
    return got.select(*[micro(F.col(c)).alias(c) for c in got.columns if c != "n_folds"], "n_folds")


_LOTO = f"""{_SCORED}, f AS (SELECT id, split_group, type AS held_type FROM splits),
sizes AS (SELECT held_type AS type, count(*) AS n_val, (SELECT count(*) FROM f o WHERE o.held_type <> t.held_type AND o.split_group NOT IN (SELECT split_group FROM f h WHERE h.held_type = t.held_type)) AS n_train FROM f t GROUP BY held_type),
base AS (SELECT type, label AS y, s FROM splits JOIN m USING (id)), {bundle_sql('type', 'base')},
rows AS (SELECT type, n_train, n_val, {", ".join(f"CASE WHEN n_train > 0 THEN {n} END AS {n}" for n in _NAMES)} FROM sizes LEFT JOIN bundle USING (type))
SELECT type, n_train, n_val, {_SQL}, CASE WHEN audet IS NULL THEN 'skipped' END AS note, NULL AS score_std FROM rows
UNION ALL SELECT '__summary__', NULL, count(score), NULL, NULL, NULL, {micro_sql('avg(score)')}, NULL, {micro_sql('stddev_pop(score)')} FROM rows HAVING count(score) > 0"""


@query("loto_report", _LOTO)
def loto_report(spark, sf):
    splits = _splits(spark, sf)
    scored = items(spark, sf).select("id", "type", F.col("label").alias("y")).join(m1(spark, sf).select("id", "s"), "id")
    got = va.loto_report(sp.loto_sizes(splits, "type"), scored)
    return _micros(got, "type", "n_train", "n_val", "note", micro(F.col("score_std")).alias("score_std"))


_PARTS = "(VALUES ('train'), ('val'), ('test')) p(split)"
_SANITY = f"""WITH RECURSIVE {SERPENTINE}, st AS (SELECT p.split, count(id) AS n, count(*) FILTER (label = 1) AS n_fraud, avg(label) AS rate, count(DISTINCT type) AS n_types, count(DISTINCT split_group) AS n_groups, count(DISTINCT country) AS n_countries FROM {_PARTS} LEFT JOIN splits USING (split) GROUP BY p.split),
z AS (SELECT count(*) AS n FROM splits GROUP BY split_group), r AS (SELECT avg(label) AS r FROM splits WHERE cv_fold >= 0 GROUP BY cv_fold),
leaks AS (SELECT count(*) AS n FROM edges JOIN splits x ON edges.a = x.id JOIN splits y ON edges.b = y.id WHERE x.split <> y.split),
out AS (SELECT 'partitions' AS section, split || '.' || k AS key, v::DOUBLE AS value FROM (SELECT split, unnest(['n', 'n_fraud', 'rate', 'n_types', 'n_groups', 'n_countries']) AS k, unnest([n::DOUBLE, n_fraud, rate, n_types, n_groups, n_countries]) AS v FROM st)
UNION ALL SELECT 'groups', 'n_groups', count(*) FROM z UNION ALL SELECT 'groups', 'n_nontrivial_groups', count(*) FILTER (n > 1) FROM z
UNION ALL SELECT 'cv_fraud_rate_spread', unnest(['min', 'max', 'std', 'folds']), unnest([min(r), max(r), stddev_pop(r), count(r)::DOUBLE]) FROM r
UNION ALL SELECT 'duplicates', 'leaking', n FROM leaks
UNION ALL SELECT 'type_overlap.' || a.split || '_' || b.split, a.type, 1 FROM (SELECT DISTINCT split, type FROM splits) a JOIN (SELECT DISTINCT split, type FROM splits) b ON a.type = b.type AND (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test')))
SELECT section, key, {micro_sql('value')} AS value FROM out"""


@query("sanity_report", _SANITY)
def sanity_report(spark, sf):
    return va.sanity_report(_splits(spark, sf), _item_links(spark, sf)).withColumn("value", micro(F.col("value")))
