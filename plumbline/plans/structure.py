"""Queries over duplicates, groups, splits and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SplitConfig
from ..operators import similarity as sim
from ..operators import splits as sp
from ..storage import stored
from .registry import query
from .views import COMPONENTS, DIST, ITEMS, PAIRS, PRINTS, items, load, prints

BITS, T = sim.PRINT_BITS, 10


_PRINT = f"printf('{'%08x' * 8}', {', '.join(f'h{k}' for k in range(8))})"


def _hex(words):
    return F.concat(*[F.lower(F.lpad(F.hex(F.get(words, F.lit(i))), 16, "0")) for i in (3, 2, 1, 0)])


@query("fingerprints", f"WITH {PRINTS} SELECT id, {_PRINT} AS print FROM prints")
def fingerprints(spark, sf):
    return prints(spark, sf).select("id", _hex(F.col("words")).alias("print"))


def _files(spark, sf):
    """Texts as files, of which some are no UTF-8."""
    bad = F.when(F.col("doc_id") % 97 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(bad, F.encode("text", "UTF-8")).alias("content"))


@query("hashed_corpus", f"WITH {PRINTS} SELECT id, md5(text) AS md5, {_PRINT} AS print FROM prints JOIN documents ON id = doc_id WHERE id % 97 <> 0")
def hashed_corpus(spark, sf):
    return sim.readable(sim.hashed(_files(spark, sf))).select("id", "md5", _hex(F.col("words")).alias("print"))


@query("hash_counts", "SELECT count(*) FILTER (doc_id % 97 <> 0) AS n_hashed, count(*) FILTER (doc_id % 97 = 0) AS n_failed FROM documents")
def hash_counts(spark, sf):
    return sim.hash_counts(sim.hashed(_files(spark, sf)))


def _contents(spark, sf):
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("md5"))


@query("exact_groups", "SELECT md5(text) AS md5, list(doc_id ORDER BY doc_id) AS ids, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_groups(spark, sf):
    return sim.exact_groups(_contents(spark, sf))


@query("star_edges", "WITH g AS (SELECT list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY md5(text) HAVING count(*) > 1) SELECT ids[1] AS a, unnest(ids[2:]) AS b FROM g")
def star_edges(spark, sf):
    return sim.star_edges(_contents(spark, sf))


def _prints(spark, sf):
    return stored(prints(spark, sf), "prints")


def _pairs(spark, sf):
    return sim.near_pairs(_prints(spark, sf), BITS, T)


@query("near_pairs", f"WITH {PAIRS} SELECT a, b, dist FROM pairs")
def near_pairs(spark, sf):
    return _pairs(spark, sf)


@query("closest_pairs", f"WITH {PAIRS} SELECT a, b, dist FROM pairs ORDER BY dist, a, b LIMIT 25")
def closest_pairs(spark, sf):
    return sim.closest(_pairs(spark, sf), 25)


def _key(shift: int, width: int) -> str:
    """Bits shift .. shift + width - 1, counted from the lowest, as a number."""
    parts, at = [], 0
    while at < width:
        word, low = divmod(shift + at, 32)
        take = min(width - at, 32 - low)
        parts.append(f"(((h{7 - word} >> {low}) & {(1 << take) - 1}) << {at})")
        at += take
    return " + ".join(parts)


_KEYS = " UNION ALL ".join(f"SELECT id, {i} AS band, {_key(s, w)} AS key FROM prints" for i, (s, w) in enumerate(sim.band_plan(BITS, T)))


@query("lsh_candidates", f"WITH {PRINTS}, bands AS ({_KEYS}), b AS (SELECT band, key, count(*) AS m FROM bands GROUP BY band, key) SELECT CAST(sum(m * (m - 1) // 2) AS BIGINT) AS n_candidates, max(m) AS largest_bucket FROM b")
def lsh_candidates(spark, sf):
    return sim.candidate_counts(sim.banded(prints(spark, sf), BITS, T))


@query("label_conflicts", f"WITH {PAIRS} SELECT p.a, p.b, la.toxic AS label_a, lb.toxic AS label_b, coalesce(la.toxic <> lb.toxic, false) AS label_conflict FROM pairs p LEFT JOIN labels la ON p.a = la.doc_id LEFT JOIN labels lb ON p.b = lb.doc_id")
def label_conflicts(spark, sf):
    labels = load(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return sim.label_conflicts(_pairs(spark, sf).select("a", "b"), labels)


def _components(spark, sf):
    p = _prints(spark, sf)
    return sim.components(p.select("id"), sim.links(p, BITS, T))


@query("components", f"WITH RECURSIVE {COMPONENTS} SELECT id, component FROM comps")
def components(spark, sf):
    return _components(spark, sf)


@query("component_hist", f"WITH RECURSIVE {COMPONENTS}, z AS (SELECT count(*) AS size FROM comps GROUP BY component) SELECT CASE WHEN size <= 2 THEN CAST(size AS VARCHAR) WHEN size <= 5 THEN '3-5' WHEN size <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS n FROM z GROUP BY bucket")
def component_hist(spark, sf):
    return sim.size_histogram(_components(spark, sf))


@query("numbered_components", f"WITH RECURSIVE {COMPONENTS}, z AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS no FROM comps GROUP BY component) SELECT id, 'dup_' || lpad(CAST(no AS VARCHAR), 6, '0') AS name FROM comps JOIN z USING (component)")
def numbered_components(spark, sf):
    return sim.numbered_components(_components(spark, sf))


@query("dedup_summary", f"WITH RECURSIVE {COMPONENTS}, z AS (SELECT count(*) AS size FROM comps GROUP BY component), c AS (SELECT count(*) AS n FROM pairs p JOIN labels a ON p.a = a.doc_id JOIN labels b ON p.b = b.doc_id WHERE a.toxic <> b.toxic) SELECT (SELECT count(*) FROM pairs) AS n_pairs, (SELECT n FROM c) AS n_conflicts, count(*) AS n_components, count(*) FILTER (size > 1) AS n_nontrivial, max(size) AS largest FROM z")
def dedup_summary(spark, sf):
    p = _prints(spark, sf)
    labels = load(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    sizes = sim.components(p.select("id"), sim.links(p, BITS, T)).groupBy("component").agg(F.count("*").alias("size"))
    return sim.pair_counts(p, labels, BITS, T).join(sizes.agg(F.count("*").alias("n_components"), F.count_if(F.col("size") > 1).alias("n_nontrivial"), F.max("size").alias("largest")))


@query("cross_set_leak", f"WITH {PAIRS}, side AS (SELECT d.doc_id AS id, l.doc_id IS NULL AS in_test FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT p.a, p.b, p.dist, x.in_test AS side_a, y.in_test AS side_b FROM pairs p JOIN side x ON p.a = x.id JOIN side y ON p.b = y.id WHERE x.in_test <> y.in_test")
def cross_set_leak(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    labelled = load(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(False).alias("t"))
    side = docs.join(labelled, "id", "left").select("id", F.coalesce("t", F.lit(True)).alias("in_test"))
    return sim.cross_set(_pairs(spark, sf), side)


@query("nearest_rows", f"WITH {PRINTS}, d AS (SELECT a.id, b.id AS nearest, {DIST} AS dist FROM prints a JOIN prints b ON a.id % 50 = 0 AND b.id % 50 <> 0) SELECT id, CASE WHEN min(dist) = 0 THEN 'exact' ELSE 'near' END AS kind, min(dist) AS dist, arg_min(nearest, row(dist, nearest)) AS nearest FROM d WHERE dist <= 24 GROUP BY id")
def nearest_rows(spark, sf):
    p = _prints(spark, sf)
    return sim.nearest_within(p.where("id % 50 = 0"), p.where("id % 50 <> 0"), BITS, 24)


# --- groups and splits ---

#: Components among labelled items only: pairs with both ends there.
ITEM_GROUPS = (
    PAIRS
    + ", "
    + ITEMS
    + """, edges AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM items) AND b IN (SELECT id FROM items)), links AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach AS (SELECT id, id AS r FROM items UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
comps AS (SELECT id, min(r) AS component FROM reach GROUP BY id),
named AS (SELECT component, 'grp_' || lpad(CAST(row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS VARCHAR), 7, '0') AS split_group FROM comps GROUP BY component),
grouped AS (SELECT i.id, i.label, i.type, i.country, split_group FROM items i JOIN comps USING (id) JOIN named USING (component))"""
)


def _item_links(spark, sf):
    """Links among the prints of labelled items alone."""
    labelled = load(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return sim.links(stored(prints(spark, sf).join(labelled, "id", "left_semi"), "prints"), BITS, T)


def _grouped(spark, sf):
    rows = items(spark, sf).select("id", "label", "type", "country")
    return sp.assign_groups(rows, _item_links(spark, sf))


@query("assign_groups", f"WITH RECURSIVE {ITEM_GROUPS} SELECT id, split_group FROM grouped")
def assign_groups(spark, sf):
    return _grouped(spark, sf).select("id", "split_group")


SERPENTINE = (
    ITEM_GROUPS
    + """, cells AS (SELECT split_group, type || '|' || label AS s, count(*) AS n FROM grouped GROUP BY ALL),
g AS (SELECT split_group, CAST(sum(n) AS BIGINT) AS size, arg_min(s, row(-n, s)) AS main FROM cells GROUP BY split_group),
dealt AS (SELECT split_group, row_number() OVER (PARTITION BY main ORDER BY size DESC, md5('42:' || split_group)) - 1 AS ix FROM g),
folds AS (SELECT split_group, CAST(CASE WHEN (ix // 7) % 2 = 0 THEN ix % 7 ELSE 6 - ix % 7 END AS INTEGER) AS fold FROM dealt),
splits AS (SELECT grouped.*, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, CASE WHEN fold = 0 THEN -1 ELSE fold - 1 END AS cv_fold FROM grouped JOIN folds USING (split_group))"""
)


def _splits(spark, sf):
    dealt = sp.serpentine_folds(_grouped(spark, sf), 7, 42)
    fold = F.col("fold")
    out = dealt.withColumn("split", F.when(fold == 0, "test").when(fold == 1, "val").otherwise("train")).withColumn("cv_fold", F.when(fold == 0, -1).otherwise(fold - 1)).drop("fold")
    return stored(out, "splits")


@query("serpentine_splits", f"WITH RECURSIVE {SERPENTINE} SELECT id, split_group, split, cv_fold FROM splits")
def serpentine_splits(spark, sf):
    return _splits(spark, sf).select("id", "split_group", "split", "cv_fold")


@query("split_stats", f"WITH RECURSIVE {SERPENTINE} SELECT split, count(*) AS n, count(*) FILTER (label = 1) AS n_fraud, avg(label) AS rate, count(DISTINCT type) AS n_types, count(DISTINCT split_group) AS n_groups, count(DISTINCT country) AS n_countries FROM splits GROUP BY split")
def split_stats(spark, sf):
    return sp.split_stats(_splits(spark, sf))


@query("fold_stats", f"WITH RECURSIVE {SERPENTINE}, p AS (SELECT * FROM splits WHERE cv_fold >= 0) SELECT cv_fold, count(*) AS n_val, avg(label) AS rate, string_agg(DISTINCT type, ',' ORDER BY type) AS types, CAST((SELECT count(*) FROM p) - count(*) AS BIGINT) AS n_train FROM p GROUP BY cv_fold")
def fold_stats(spark, sf):
    return sp.fold_stats(_splits(spark, sf))


@query("type_splits", f"WITH RECURSIVE {SERPENTINE}, t AS (SELECT DISTINCT type, split, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS r FROM splits) SELECT type, string_agg(split, ',' ORDER BY r) AS splits FROM t GROUP BY type")
def type_splits(spark, sf):
    return sp.type_splits(_splits(spark, sf))


@query("leak_violations", f"WITH RECURSIVE {SERPENTINE} SELECT 'id_unique' AS rule, count(*) AS n FROM (SELECT id FROM splits GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'group_in_one_split', count(*) FROM (SELECT split_group FROM splits GROUP BY split_group HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'group_in_one_fold', count(*) FROM (SELECT split_group FROM splits WHERE cv_fold >= 0 GROUP BY split_group HAVING count(DISTINCT cv_fold) > 1)")
def leak_violations(spark, sf):
    return sp.leak_violations(_splits(spark, sf))


_RANDOM = "random AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'test' WHEN id % 3 = 1 THEN 'val' ELSE 'train' END AS split FROM items)"


@query("leaking_pairs", f"WITH {PAIRS}, {ITEMS}, {_RANDOM} SELECT p.a, p.b, p.dist, x.split AS split_a, y.split AS split_b FROM pairs p JOIN random x ON p.a = x.id JOIN random y ON p.b = y.id WHERE x.split <> y.split")
def leaking_pairs(spark, sf):
    third = F.col("id") % 3
    random = items(spark, sf).select("id", F.when(third == 0, "test").when(third == 1, "val").otherwise("train").alias("split"))
    return sp.leaking_pairs(_pairs(spark, sf), random)


@query("nontrivial_groups", f"WITH RECURSIVE {ITEM_GROUPS}, z AS (SELECT count(*) AS n FROM grouped GROUP BY split_group HAVING count(*) > 1) SELECT count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_items FROM z")
def nontrivial_groups(spark, sf):
    return sp.nontrivial_groups(_grouped(spark, sf))


_FINE = f"WITH RECURSIVE {ITEM_GROUPS}, f AS (SELECT g.id, g.split_group, i.doc_type AS held_type FROM grouped g JOIN items i USING (id))"


@query("loto_sizes", f"{_FINE} SELECT held_type, count(*) AS n_held, (SELECT count(*) FROM f o WHERE o.held_type <> t.held_type AND o.split_group NOT IN (SELECT split_group FROM f h WHERE h.held_type = t.held_type)) AS n_train, (SELECT count(*) FROM f o WHERE o.held_type <> t.held_type AND o.split_group IN (SELECT split_group FROM f h WHERE h.held_type = t.held_type)) AS n_tainted FROM f t GROUP BY held_type")
def loto_sizes(spark, sf):
    rows = sp.assign_groups(items(spark, sf).select("id", "doc_type"), _item_links(spark, sf))
    return sp.loto_sizes(stored(rows, "groups"), "doc_type")


@query("type_overlap", f"WITH {ITEMS}, r AS (SELECT doc_type AS type, CASE WHEN id % 40 < 30 THEN 'train' ELSE 'test' END AS split FROM items) SELECT type FROM r WHERE split = 'train' INTERSECT SELECT type FROM r WHERE split = 'test'")
def type_overlap(spark, sf):
    rows = items(spark, sf).select(F.col("doc_type").alias("type"), F.when(F.col("id") % 40 < 30, "train").otherwise("test").alias("split"))
    return sp.type_overlap(rows, "train", "test")


@query("cv_roles", f"WITH RECURSIVE {SERPENTINE}, p AS (SELECT * FROM splits WHERE cv_fold >= 0) SELECT h.cv_fold AS held_fold, CASE WHEN p.cv_fold = h.cv_fold THEN 'val' ELSE 'train' END AS role, count(*) AS n FROM p CROSS JOIN (SELECT DISTINCT cv_fold FROM p) h GROUP BY ALL")
def cv_roles(spark, sf):
    return sp.cv_roles(_splits(spark, sf)).groupBy("held_fold", "role").agg(F.count("*").alias("n"))


_TYPED = f"""{ITEMS}, sizes AS (SELECT doc_type, count(*) AS n, row_number() OVER (ORDER BY md5('1:' || doc_type), doc_type) AS ix FROM items GROUP BY doc_type),
part AS (SELECT doc_type, n, CASE WHEN ix <= 3 THEN 'val' WHEN ix <= 6 THEN 'test' ELSE 'train' END AS split FROM sizes),
pool AS (SELECT doc_type, n, row_number() OVER (ORDER BY n DESC, doc_type) AS o FROM part WHERE split <> 'test'),
dealt(o, rows_, f) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS HUGEINT), 0, 0, 0, 0], CAST(0 AS BIGINT) UNION ALL SELECT p.o, list_transform(rows_, lambda x, i: x + CASE WHEN i = list_position(rows_, list_min(rows_)) THEN p.n ELSE 0 END), CAST(list_position(rows_, list_min(rows_)) AS BIGINT) FROM dealt d JOIN pool p ON p.o = d.o + 1)"""


@query("type_holdout", f"WITH RECURSIVE {_TYPED} SELECT id, split, CAST(coalesce(f - 1, -1) AS INTEGER) AS cv_fold FROM items JOIN part USING (doc_type) LEFT JOIN pool USING (doc_type) LEFT JOIN dealt USING (o)")
def type_holdout(spark, sf):
    return sp.type_holdout(items(spark, sf).select("id", "doc_type"), 1, type_="doc_type").select("id", "split", "cv_fold")


@query("build_splits")
def build_splits(spark, sf):
    out = sp.build_splits(items(spark, sf).select("id", "label", "type", "country"), _item_links(spark, sf), SplitConfig())
    return sp.split_stats(out)
