"""Queries over profiles, projections, scans, set operations and text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ensemble, profile
from ..sources import files
from .registry import query
from .views import ITEMS, SCORES, items, load, micro, micro_sql, scores


@query("label_stats", f"WITH {ITEMS} SELECT count(*) AS n, count(*) FILTER (label = 1) AS n_fraud, avg(label) AS rate, count(id) = count(DISTINCT id) AS ids_unique, count(*) FILTER (label IS NULL) AS n_missing FROM items")
def label_stats(spark, sf):
    return profile.label_stats(items(spark, sf))


@query("value_counts", "SELECT l.quality AS value, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY l.quality")
def value_counts(spark, sf):
    return profile.value_counts(load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left"), "quality")


@query("rate_by_stratum", f"WITH {ITEMS} SELECT type, is_digital, count(*) AS n, avg(label) AS rate FROM items GROUP BY type, is_digital")
def rate_by_stratum(spark, sf):
    return profile.rate_by(items(spark, sf), "type", "is_digital")


@query("crosstab", f"WITH {ITEMS} SELECT doc_type, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) AS total FROM items GROUP BY doc_type")
def crosstab(spark, sf):
    return profile.crosstab(items(spark, sf), "doc_type")


@query("table_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS n, count(DISTINCT {c}) AS n_unique, count(*) FILTER ({c} IS NULL) AS n_null FROM customer" for c, t in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))))
def table_profile(spark, sf):
    return profile.table_profile(load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query("table_head", "SELECT c_custkey, c_name, c_nationkey FROM customer ORDER BY c_custkey LIMIT 5")
def table_head(spark, sf):
    return profile.head(load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"])


@query("bytes_by_ext", r"SELECT lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS bytes FROM pages GROUP BY ext")
def bytes_by_ext(spark, sf):
    return profile.bytes_by_extension(load(spark, sf, "pages").select(F.col("url").alias("path"), F.length("html").alias("length")))


@query("six_number", f"SELECT l_returnflag, min(l_extendedprice) AS min, {micro_sql('quantile_cont(l_extendedprice, 0.25)')} AS p25, {micro_sql('quantile_cont(l_extendedprice, 0.5)')} AS median, {micro_sql('quantile_cont(l_extendedprice, 0.75)')} AS p75, max(l_extendedprice) AS max, CAST(floor(avg(l_extendedprice) * 100 + 0.5) AS BIGINT) AS mean FROM lineitem GROUP BY l_returnflag")
def six_number(spark, sf):
    got = profile.six_numbers(load(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return got.select("l_returnflag", "min", *[micro(F.col(c)).alias(c) for c in ("p25", "median", "p75")], "max", F.floor(F.col("mean") * 100 + 0.5).cast("long").alias("mean"))


@query("moments", "SELECT l_returnflag, CAST(floor(skewness(l_quantity) * 1e5 + 0.5) AS BIGINT) AS skew, CAST(floor(kurtosis(l_quantity) * 1e5 + 0.5) AS BIGINT) AS kurtosis, CAST(floor(stddev_pop(l_quantity) * 1e5 + 0.5) AS BIGINT) AS std, CAST(floor(avg(l_quantity) * 1e5 + 0.5) AS BIGINT) AS mean FROM lineitem GROUP BY l_returnflag")
def moments(spark, sf):
    got = profile.moments(load(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"])
    return got.select("l_returnflag", *[F.floor(F.col(c) * 1e5 + 0.5).cast("long").alias(c) for c in ("skew", "kurtosis", "std", "mean")])


@query("size_profile", f"WITH {ITEMS}, s AS (SELECT n_chars FROM items ORDER BY md5('2:' || id), id LIMIT 300), o AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS ix, count(*) OVER () AS n FROM s) SELECT max(n) AS n, min(n_chars) AS min, max(n_chars) FILTER (ix = n // 2) AS upper_median, max(n_chars) AS max FROM o")
def size_profile(spark, sf):
    return profile.size_profile(items(spark, sf), "n_chars", "id", 300, 2)


@query("class_separation", f"WITH {SCORES}, m AS (SELECT model, avg(s) FILTER (y = 0) AS a, avg(s) FILTER (y = 1) AS b FROM scores GROUP BY model) SELECT model, {micro_sql('a')} AS mean0, {micro_sql('b')} AS mean1, {micro_sql('b - a')} AS separation, b - a > 0.15 AS tripped FROM m")
def class_separation(spark, sf):
    got = profile.class_separation(scores(spark, sf), "s", ["model"], "y")
    return got.select("model", *[micro(F.col(c)).alias(c) for c in ("mean0", "mean1", "separation")], "tripped")


# --- projections and predicates ---


@query("split_type", f"WITH {ITEMS} SELECT id, trim(str_split(fine_type, '/')[1]) AS country, trim(str_split(fine_type, '/')[2]) AS doc_type FROM items")
def split_type(spark, sf):
    c, d = profile.split_type("fine_type")
    return items(spark, sf).select("id", c.alias("country"), d.alias("doc_type"))


@query("human_bytes", "SELECT doc_id, CASE WHEN n_chars * 1000 + 7 < 1024 THEN format('{:.1f} B', (n_chars * 1000 + 7)::DOUBLE) WHEN n_chars * 1000 + 7 < 1048576 THEN format('{:.1f} KB', (n_chars * 1000 + 7) / 1024.0::DOUBLE) ELSE format('{:.1f} MB', (n_chars * 1000 + 7) / 1048576.0::DOUBLE) END AS size FROM documents")
def human_bytes(spark, sf):
    return load(spark, sf, "documents").select("doc_id", profile.human_bytes((F.col("n_chars") * 1000 + 7).cast("double")).alias("size"))


@query("image_properties", "SELECT p_partkey, CASE WHEN p_size > p_partkey % 50 THEN 'landscape' WHEN p_size < p_partkey % 50 THEN 'portrait' ELSE 'square' END AS orientation, CAST(floor(p_size::DOUBLE / nullif(p_partkey % 50, 0) * 1e4 + 0.5) AS BIGINT) AS aspect FROM part")
def image_properties(spark, sf):
    p = profile.image_properties(F.col("p_size"), F.col("p_partkey") % 50, F.col("p_retailprice"))
    return load(spark, sf, "part").select("p_partkey", p["orientation"].alias("orientation"), F.floor(p["aspect"] * 1e4 + 0.5).cast("long").alias("aspect"))


@query("label_names", f"WITH {ITEMS} SELECT id, CASE label WHEN 0 THEN 'genuine' WHEN 1 THEN 'fraud' END AS name FROM items")
def label_names(spark, sf):
    return items(spark, sf).select("id", profile.label_name(F.col("label")).alias("name"))


_NAN = "CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE WHEN l_linenumber = 5 THEN 'inf'::DOUBLE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity END"


def _gaps(spark, sf):
    n = F.col("l_linenumber")
    x = F.when(n == 3, float("nan")).when(n == 5, float("inf")).when(n == 6, None).otherwise(F.col("l_quantity"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))


@query("finite_filter", f"SELECT l_orderkey, l_linenumber, CASE WHEN isnan({_NAN}) OR isinf({_NAN}) THEN 0 ELSE {_NAN} END AS x FROM lineitem")
def finite_filter(spark, sf):
    return _gaps(spark, sf).withColumn("x", profile.finite(F.col("x"), 0.0))


@query("median_impute", f"WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN isnan({_NAN}) OR isinf({_NAN}) THEN NULL ELSE {_NAN} END AS x FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce(x, (SELECT median(x) FROM c)) AS x FROM c")
def median_impute(spark, sf):
    return profile.imputed(_gaps(spark, sf), ["x"])


@query("varying_columns", "SELECT count(*) AS n, max(l_quantity) - min(l_quantity) > 0 AS l_quantity, max(l_tax - l_tax) - min(l_tax - l_tax) > 0 AS constant FROM lineitem")
def varying_columns(spark, sf):
    rows = load(spark, sf, "lineitem").withColumn("constant", F.col("l_tax") - F.col("l_tax"))
    kept = profile.varying(rows, ["l_quantity", "constant"])
    return rows.agg(F.count("*").alias("n"), *[F.lit(c in kept).alias(c) for c in ("l_quantity", "constant")])


@query("stratum_codes", f"WITH {ITEMS} SELECT id, CAST(dense_rank() OVER (ORDER BY type || '|' || label) - 1 AS INTEGER) AS code FROM items")
def stratum_codes(spark, sf):
    rows = items(spark, sf).select("id", profile.stratum("type", "label").alias("s"))
    from pyspark.sql import Window

    codes = rows.select("s").distinct().withColumn("code", F.row_number().over(Window.partitionBy().orderBy("s")) - 1)
    return rows.join(codes, "s").select("id", "code")


@query("category_codes", f"WITH {ITEMS}, codes AS (SELECT doc_type, row_number() OVER (ORDER BY doc_type) - 1 AS code FROM (SELECT DISTINCT doc_type FROM items WHERE id % 7 < 3 AND label = 1)) SELECT id, coalesce(code, 0) AS code FROM items LEFT JOIN codes USING (doc_type)")
def category_codes(spark, sf):
    rows = items(spark, sf).select("id", "doc_type", "label")
    return profile.category_codes(rows.where("id % 7 < 3 and label = 1"), rows, "doc_type").select("id", "code")


@query("canary_filter", f"WITH {SCORES} SELECT i.id, s.s FROM items i JOIN scores s ON i.id = s.id AND s.model = 'm1' WHERE NOT is_digital AND country <> 'fr' AND doc_type IN ('src1', 'src2', 'src3', 'src4')")
def canary_filter(spark, sf):
    rows = items(spark, sf).where(~F.col("is_digital") & (F.col("country") != "fr") & F.col("doc_type").isin("src1", "src2", "src3", "src4")).select("id")
    return rows.join(scores(spark, sf).where("model = 'm1'").select("id", "s"), "id")


@query("two_masks", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000 AND c_acctbal > 0")
def two_masks(spark, sf):
    a = load(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 150000).alias("keep_a"))
    b = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 0).alias("keep_b"))
    return a.join(b, "o_custkey").where("keep_a and keep_b").select("o_orderkey")


# --- scans over paths ---

_POS, _NEG = ("en", "es"), ("de", "fr")


@query("path_labels", r"""WITH p AS (SELECT url AS path, str_split(url, '/') AS parts, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages),
q AS (SELECT regexp_replace(name, '(.)\.[^.]*$', '\1') AS id, lower(parts[len(parts) - 1]) AS folder, parts[len(parts) - 2] AS country FROM p)
SELECT id, CASE WHEN folder IN ('en', 'es') THEN 1 ELSE 0 END AS label, country || '/' || folder AS type, country, true AS is_digital FROM q WHERE folder IN ('en', 'es', 'de', 'fr')""")
def path_labels(spark, sf):
    return files.path_labelled(load(spark, sf, "pages").select(F.col("url").alias("path")), _POS, _NEG)


@query("keyword_labels", r"""WITH p AS (SELECT url AS path, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS id, regexp_matches(lower(url), 'blog|spam') AS p, regexp_matches(lower(url), 'www|html') AS n FROM pages)
SELECT id, arg_min(CASE WHEN p THEN 1 ELSE 0 END, path) AS label, min(path) AS path FROM p WHERE p <> n GROUP BY id""")
def keyword_labels(spark, sf):
    return files.keyword_labelled(load(spark, sf, "pages").select(F.col("url").alias("path")), ("blog", "spam"), ("www", "html"))


_INDEX = r"idx AS (SELECT id AS stem, max(path) AS abs_path FROM (SELECT url AS path, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS id FROM pages) GROUP BY id)"


def _index(spark, sf):
    stem, _ = tx.stem_and_suffix(F.col("url"))
    return files.file_index(load(spark, sf, "pages").select(F.col("url").alias("path"), stem.alias("stem")))


@query("path_resolution", f"WITH {_INDEX} SELECT CAST(doc_id AS VARCHAR) AS id, abs_path, abs_path IS NOT NULL AS path_exists FROM documents LEFT JOIN idx ON CAST(doc_id AS VARCHAR) = stem")
def path_resolution(spark, sf):
    return files.resolved(load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id")), _index(spark, sf))


@query("with_files", f"WITH {_INDEX} SELECT CAST(doc_id AS VARCHAR) AS id, abs_path FROM documents JOIN idx ON CAST(doc_id AS VARCHAR) = stem")
def with_files(spark, sf):
    return files.with_files(load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id")), _index(spark, sf))


@query("unlabeled_frame", f"WITH {_INDEX} SELECT stem AS id, abs_path, 0 AS label FROM idx")
def unlabeled_frame(spark, sf):
    return _index(spark, sf).select(F.col("stem").alias("id"), "abs_path", F.lit(0).alias("label"))


@query("cache_redirect", "SELECT o_orderkey AS id, coalesce('/cache/' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END, '/raw/' || o_orderkey) AS abs_path FROM orders")
def cache_redirect(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/raw/"), "o_orderkey").alias("abs_path"))
    return files.redirected(rows, rows.where("id % 3 = 0").select("id", F.concat(F.lit("/cache/"), "id").alias("abs_path")))


@query("feature_cache", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal ELSE c_custkey * 2.0::DOUBLE END AS x FROM customer WHERE c_custkey <= 1000")
def feature_cache(spark, sf):
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    wanted = rows.where("id <= 1000").select("id")
    got, _ = ensemble.cached_features(wanted, rows.where("id % 4 = 0"), lambda d: d.select("id", (F.col("id") * 2.0).alias("x")))
    return got


# --- joins and sets ---


@query("lookup_join", f"WITH {ITEMS} SELECT d.doc_id, i.label FROM documents d LEFT JOIN items i ON d.doc_id = i.id")
def lookup_join(spark, sf):
    return load(spark, sf, "documents").select("doc_id").join(items(spark, sf).select(F.col("id").alias("doc_id"), "label"), "doc_id", "left")


@query("default_lookup", "SELECT o_orderkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END, -1) AS balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def default_lookup(spark, sf):
    table = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("balance"))
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey").join(table, "o_custkey", "left").select("o_orderkey", F.coalesce("balance", F.lit(-1.0)).alias("balance"))


@query("labelled_scores", f"WITH {SCORES} SELECT s.id, s.model, i.label, s.s FROM scores s JOIN items i ON s.id = i.id WHERE s.model <> 'm3'")
def labelled_scores(spark, sf):
    return scores(spark, sf).where("model <> 'm3'").select("id", "model", "s").join(items(spark, sf).select("id", "label"), "id")


@query("union_sets", f"WITH {ITEMS} SELECT id, label, 'train' AS origin FROM items UNION ALL SELECT id, 1 - label, 'pseudo' FROM items WHERE is_digital")
def union_sets(spark, sf):
    rows = items(spark, sf)
    a = rows.select("id", "label", F.lit("train").alias("origin"))
    return a.unionByName(rows.where("is_digital").select("id", (1 - F.col("label")).alias("label"), F.lit("pseudo").alias("origin")))


@query("union_first", f"WITH {ITEMS} SELECT id, CASE WHEN id % 2 = 0 THEN label ELSE 9 END AS label FROM items")
def union_first(spark, sf):
    rows = items(spark, sf).select("id", "label")
    return ensemble.union_first(rows.where("id % 2 = 0"), rows.withColumn("label", F.lit(9)))


@query("distinct_cells", f"WITH {ITEMS} SELECT DISTINCT fine_type, label FROM items")
def distinct_cells(spark, sf):
    return items(spark, sf).select("fine_type", "label").distinct()


@query("distinct_paths", "SELECT url FROM pages UNION SELECT regexp_replace(url, '#.*$', '') FROM pages")
def distinct_paths(spark, sf):
    p = load(spark, sf, "pages").select("url")
    return p.unionAll(p.select(F.regexp_replace("url", "#.*$", ""))).distinct().orderBy("url")


@query("key_sets", "SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'left', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 12)")
def key_sets(spark, sf):
    a, b = load(spark, sf, "customer").select("c_nationkey"), load(spark, sf, "supplier").select("s_nationkey")
    both = a.intersect(b).agg(F.lit("both").alias("side"), F.count("*").alias("n"))
    return both.unionAll(a.subtract(b.where("s_nationkey < 12")).agg(F.lit("left").alias("side"), F.count("*").alias("n")))


@query("stacked_features", "SELECT c_custkey, [c_acctbal, n_orders] AS x FROM (SELECT c_custkey, c_acctbal, count(o_orderkey)::DOUBLE AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)")
def stacked_features(spark, sf):
    a = load(spark, sf, "customer").select("c_custkey", F.array("c_acctbal").alias("x"))
    b = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array(F.count("*").cast("double")).alias("y"))
    return a.join(b, "c_custkey").select("c_custkey", F.concat("x", "y").alias("x"))


@query("common_columns", "SELECT nation.n_name AS name, nation.n_regionkey AS key FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def common_columns(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("key"), "n_nationkey")
    return ensemble.common_union(n, load(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")))


@query("runs_summary", "SELECT o_custkey AS run, count(*) AS n, CAST(floor(min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) * 100 + 0.5) AS BIGINT) AS best FROM orders GROUP BY o_custkey")
def runs_summary(spark, sf):
    best = F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("n"), F.floor(best * 100 + 0.5).cast("long").alias("best")).orderBy(F.asc_nulls_last("best"), "run")


@query("scored_report", f"WITH {SCORES} SELECT id, s FROM scores WHERE model = 'm2' ORDER BY s DESC, id LIMIT 25")
def scored_report(spark, sf):
    return scores(spark, sf).where("model = 'm2'").select("id", "s").orderBy(F.desc("s"), "id").limit(25)


# --- text functions ---

_T = "'٤' || turn || '/٠' || (conv_id % 9 + 1) || '/' || (1900 + (conv_id * 7 + turn) % 150) || ' ۱۹۸' || turn % 10 || ' 20' || lpad(CAST(conv_id % 40 AS VARCHAR), 2, '0') || ' ' || text"


def _marked(spark, sf):
    t = F.concat(F.lit("٤"), "turn", F.lit("/٠"), F.col("conv_id") % 9 + 1, F.lit("/"), F.lit(1900) + (F.col("conv_id") * 7 + F.col("turn")) % 150, F.lit(" ۱۹۸"), F.col("turn") % 10, F.lit(" 20"), F.lpad((F.col("conv_id") % 40).cast("string"), 2, "0"), F.lit(" "), F.col("text"))
    return load(spark, sf, "conversations").select("conv_id", "turn", t.alias("t"), "text")


_MARKED = f"marked AS (SELECT conv_id, turn, {_T} AS t, text FROM conversations), ascii AS (SELECT *, translate(t, '{tx.EASTERN_DIGITS}', '{tx.ASCII_DIGITS}') AS a FROM marked)"


@query("digit_features", f"WITH {_MARKED} SELECT conv_id, turn, a, regexp_matches(t, '[\\x{{0600}}-\\x{{06FF}}]') AS arabic, list_transform(regexp_extract_all(a, '\\b((?:19|20)[0-9]{{2}})\\b', 1), lambda y: y::INTEGER) AS years FROM ascii")
def digit_features(spark, sf):
    a = tx.ascii_digits(F.col("t"))
    return _marked(spark, sf).select("conv_id", "turn", a.alias("a"), tx.has_arabic(F.col("t")).alias("arabic"), tx.years(a).alias("years"))


_DMY, _YMD = r"([0-9]{1,2})\s*[/.-]\s*([0-9]{1,2})\s*[/.-]\s*([0-9]{4})", r"([0-9]{4})\s*[/.-]\s*([0-9]{1,2})\s*[/.-]\s*([0-9]{1,2})"


def _parts_sql(text: str) -> str:
    """(y, m, d) of all date-like tokens, day first and then year first."""
    of = lambda p, y, m, d: f"list_transform(list_zip(regexp_extract_all({text}, '{p}', {y}), regexp_extract_all({text}, '{p}', {m}), regexp_extract_all({text}, '{p}', {d})), lambda z: {{'y': z[1]::INTEGER, 'm': z[2]::INTEGER, 'd': z[3]::INTEGER}})"
    return f"list_concat({of(_DMY, 3, 2, 1)}, {of(_YMD, 1, 2, 3)})"


def _valid_sql(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: TRY_CAST(printf('%04d-%02d-%02d', x.y, x.m, x.d) AS DATE)), lambda d: d IS NOT NULL AND year(d) BETWEEN 1900 AND 2035)"


_DATES = _valid_sql(_parts_sql("a"))


@query("date_features", f"WITH {_MARKED}, d AS (SELECT conv_id, turn, {_DATES} AS d FROM ascii) SELECT conv_id, turn, len(d) AS n, list_min(d) AS first, list_max(d) AS last FROM d")
def date_features(spark, sf):
    d = tx.dates(tx.ascii_digits(F.col("t")))
    return _marked(spark, sf).select("conv_id", "turn", F.size(d).cast("long").alias("n"), F.array_min(d).alias("first"), F.array_max(d).alias("last"))


#: Of a list d of dates in text order: how often one is over 20 years of 366 days before the date ahead of it.
_FALLS = "len(list_filter(range(1, greatest(len(d), 1)), lambda i: date_diff('day', d[i + 1], d[i]) > 7320))"
_AGE = "(len(d) >= 2 AND (year(list_max(d)) - year(list_min(d)) > 90 OR year(list_max(d)) - year(list_min(d)) < 15))"
_OUTSIDE = "(len(d) >= 2 AND (year(list_max(d)) > 2032 OR year(list_min(d)) < 1925))"


@query("chronology", f"WITH {_MARKED}, t AS (SELECT conv_id, string_agg(a, ' ' ORDER BY turn) AS a FROM ascii GROUP BY conv_id), d AS (SELECT conv_id, {_DATES} AS d FROM t) SELECT conv_id, {_AGE} AS implausible_age, {_OUTSIDE} AS future_or_ancient, {_AGE} OR {_OUTSIDE} OR {_FALLS} > 0 AS chrono_violation FROM d")
def chronology(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", tx.ascii_digits(F.col("t")).alias("a"))))
    rows = _marked(spark, sf).groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["a"]), " ").alias("a"))
    rows = rows.select("conv_id", tx.dates(F.col("a")).alias("d"))
    return rows.select("conv_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in tx.chronology(F.col("d")).items()])


@query("falling_dates", "WITH d AS (SELECT o_custkey, list(CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS d FROM orders GROUP BY o_custkey) SELECT o_custkey, CAST(CASE WHEN len(d) < 2 THEN 0 ELSE len(list_filter(range(1, len(d)), lambda i: date_diff('day', d[i + 1], d[i]) > 366)) END AS INTEGER) AS falls FROM d")
def falling_dates(spark, sf):
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderdate").cast("date").alias("d")))), lambda x: x["d"]).alias("d"))
    return o.select("o_custkey", tx.falling_steps(F.col("d"), 366).alias("falls"))


def _letters_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\p{{L}}'))"


def _latin_sql(x: str) -> str:
    return f"({_letters_sql(x)} >= 3 AND len(regexp_extract_all({x}, '\\p{{Latin}}')) * 10 >= {_letters_sql(x)} * 6)"


def _odd_sql(x: str) -> str:
    return f"(length({x}) - length(translate({x}, 'ïîìöôòüûùäâàëêèÿ', '')))"


_TOKENS = f"list_filter(regexp_split_to_array(text, '\\s+'), lambda w: {_latin_sql('w')})"


@query("name_anomaly", f"WITH w AS (SELECT conv_id, turn, {_TOKENS} AS w FROM conversations) SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS n_latin, CAST(coalesce(list_sum(list_transform(w, lambda x: {_odd_sql('x')})), 0) AS INTEGER) AS n_odd FROM w")
def name_anomaly(spark, sf):
    latin = F.filter(tx.tokens(F.col("text")), tx.is_latin)
    odd = F.aggregate(F.transform(latin, tx.odd_letters), F.lit(0), lambda a, x: a + x)
    return load(spark, sf, "conversations").select("conv_id", "turn", F.size(latin).alias("n_latin"), odd.alias("n_odd"))


@query("year_mismatch", f"WITH {_MARKED}, y AS (SELECT conv_id, turn, list_transform(regexp_extract_all(t, '\\b((?:19|20)[0-9]{{2}})\\b', 1), lambda v: v::INTEGER) AS l, list_transform(regexp_extract_all(a, '\\b((?:19|20)[0-9]{{2}})\\b', 1), lambda v: v::INTEGER) AS a FROM ascii) SELECT conv_id, turn, CASE WHEN len(l) = 0 OR len(a) = 0 THEN 0 ELSE len(list_filter(l, lambda v: NOT list_contains(list_filter(a, lambda w: w % 2 = 0), v)))::DOUBLE / len(l) END AS share FROM y")
def year_mismatch(spark, sf):
    latin, every = tx.years(F.col("t")), tx.years(tx.ascii_digits(F.col("t")))
    share = F.when((F.size(latin) == 0) | (F.size(every) == 0), 0.0).otherwise(F.size(F.filter(latin, lambda v: ~F.array_contains(F.filter(every, lambda w: w % 2 == 0), v))) / F.size(latin))
    return _marked(spark, sf).select("conv_id", "turn", share.alias("share"))


@query("box_stats", f"WITH h AS (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity) AS h, stddev_pop(l_quantity) / (avg(l_quantity) + 1e-6) AS cv, max(l_quantity) / (median(l_quantity) + 1e-6) AS mm, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN n < 4 THEN 0 ELSE {micro_sql('cv')} END AS cv, CASE WHEN n < 4 THEN 0 ELSE {micro_sql('mm')} END AS mm FROM h")
def box_stats(spark, sf):
    h = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("h"))
    s = tx.box_stats(F.col("h"))
    return h.select("l_orderkey", micro(s["box_h_cv"]).alias("cv"), micro(s["box_h_max_over_med"]).alias("mm"))


#: Recognised items: every other turn in ASCII digits, some without text, score or box.
_RECOGNISED = f"{_MARKED}, items AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 11 = 0 THEN '' WHEN turn % 2 = 0 THEN a ELSE t END AS text, ((conv_id * 7 + turn) % 10) / 10.0::DOUBLE AS score, CASE WHEN turn % 5 = 4 THEN NULL ELSE (10 + (conv_id * 3 + turn * 5) % 17)::DOUBLE END AS h FROM ascii)"
_CONSISTENCY = f"""WITH {_RECOGNISED}, b AS (SELECT *, translate(text, '{tx.EASTERN_DIGITS}', '{tx.ASCII_DIGITS}') AS b FROM items),
p AS (SELECT *, regexp_matches(text, '[٠-٩۰-۹]') AS ar, {_parts_sql('b')} AS parts, list_transform(regexp_extract_all(b, '\\b((?:19|20)[0-9]{{2}})\\b', 1), lambda y: y::INTEGER) AS ys, {_latin_sql('text')} AS latin FROM b),
g AS (SELECT conv_id, count(*) FILTER (text <> '') AS n_tokens, sum(length(text)) AS total_text_len, avg(score) AS mean_conf, min(score) AS min_conf, avg((score < 0.3)::INTEGER) AS frac_conf_lt30, avg((score < 0.5)::INTEGER) AS frac_conf_lt50, stddev_pop(score) AS std_conf,
 coalesce(flatten(list(parts ORDER BY turn) FILTER (NOT ar)), []) AS parts, coalesce(flatten(list(list_concat(list_transform(parts, lambda x: x.y), ys)) FILTER (ar)), []) AS ay, count(*) FILTER (ar AND len(parts) + len(ys) > 0) AS n_arabic_date_tokens,
 coalesce(sum({_odd_sql('text')}) FILTER (latin), 0) AS odd, coalesce(sum({_letters_sql('text')}) FILTER (latin), 0) AS letters, count(*) FILTER (latin) AS n_latin_name_tokens,
 count(h) AS n_h, stddev_pop(h) / (avg(h) + 1e-6) AS cv, max(h) / (median(h) + 1e-6) AS mm FROM p GROUP BY conv_id),
f AS (SELECT *, {_valid_sql('parts')} AS d, list_transform(parts, lambda x: x.y) AS ly FROM g),
m AS (SELECT *, len(list_filter(ly, lambda y: NOT list_contains(ay, y))) AS miss, len(ly) > 0 AND len(ay) > 0 AS dual, list_distinct(list_transform(d, lambda x: year(x))) AS yy FROM f)
SELECT conv_id, {micro_sql('n_tokens')} AS n_tokens, {micro_sql('total_text_len')} AS total_text_len, {micro_sql('mean_conf')} AS mean_conf, {micro_sql('min_conf')} AS min_conf, {micro_sql('frac_conf_lt30')} AS frac_conf_lt30, {micro_sql('frac_conf_lt50')} AS frac_conf_lt50, {micro_sql('std_conf')} AS std_conf,
 {micro_sql('len(parts)')} AS n_latin_dates, {micro_sql('n_arabic_date_tokens')} AS n_arabic_date_tokens, {micro_sql('len(d)')} AS n_valid_dates, {micro_sql('len(yy)')} AS n_distinct_years, {micro_sql('CASE WHEN len(yy) >= 2 THEN list_max(yy) - list_min(yy) ELSE 0 END')} AS year_span,
 {micro_sql(f'(coalesce({_AGE}, false) OR coalesce({_OUTSIDE}, false) OR {_FALLS} > 0)::INTEGER')} AS chrono_violation, {micro_sql(f'coalesce({_AGE}, false)::INTEGER')} AS implausible_age, {micro_sql(f'coalesce({_OUTSIDE}, false)::INTEGER')} AS future_or_ancient, {micro_sql(_FALLS)} AS n_date_pairs_bad_order,
 {micro_sql('dual::INTEGER')} AS has_dual_script, {micro_sql('CASE WHEN dual THEN miss::DOUBLE / len(ly) ELSE 0 END')} AS crossscript_year_mismatch_frac, {micro_sql('(dual AND miss > 0)::INTEGER')} AS crossscript_any_mismatch,
 {micro_sql('odd')} AS name_weird_accent_ct, {micro_sql('CASE WHEN letters > 0 THEN odd::DOUBLE / letters ELSE 0 END')} AS name_weird_accent_frac, {micro_sql('n_latin_name_tokens')} AS n_latin_name_tokens,
 {micro_sql('CASE WHEN n_h >= 4 THEN cv ELSE 0 END')} AS box_h_cv, {micro_sql('CASE WHEN n_h >= 4 THEN mm ELSE 0 END')} AS box_h_max_over_med FROM m"""


@query("consistency_features", _CONSISTENCY)
def consistency_features(spark, sf):
    c, n = F.col("conv_id"), F.col("turn")
    t = F.when((c + n) % 11 == 0, "").when(n % 2 == 0, tx.ascii_digits(F.col("t"))).otherwise(F.col("t"))
    rows = _marked(spark, sf).select("conv_id", n.alias("position"), t.alias("text"), ((c * 7 + n) % 10 / 10).alias("score"), F.when(n % 5 != 4, (10 + (c * 3 + n * 5) % 17).cast("double")).alias("height"))
    got = tx.consistency_features(rows, ("conv_id",))
    return got.select("conv_id", *[micro(F.col(f)).alias(f) for f in tx.FEATURES])


@query("polygon_boxes", "SELECT l_orderkey, min(l_quantity) AS x, min(l_linenumber::DOUBLE) AS y, max(l_quantity) - min(l_quantity) AS w, max(l_linenumber::DOUBLE) - min(l_linenumber::DOUBLE) AS h FROM lineitem GROUP BY l_orderkey")
def polygon_boxes(spark, sf):
    p = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array("l_quantity", F.col("l_linenumber").cast("double"))).alias("p"))
    return p.select("l_orderkey", tx.polygon_box(F.col("p")).alias("b")).select("l_orderkey", "b.*")


@query("stems", r"WITH n AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS n FROM pages) SELECT page_id, regexp_replace(n, '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(n, '.(\.[^.]*)$', 1)) AS suffix FROM n")
def stems(spark, sf):
    stem, suffix = tx.stem_and_suffix(F.col("url"))
    return load(spark, sf, "pages").select("page_id", stem.alias("stem"), suffix.alias("suffix"))


@query("typst_escape", r"SELECT item_id, regexp_replace(text, '([\\#$@*_<>\[\]`])', '\\\1', 'g') AS t FROM benchmark")
def typst_escape(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", tx.typst_escaped(F.col("text")).alias("t"))


@query("guarded_ratios", f"SELECT p_partkey, {micro_sql('log10(p_retailprice + 1)')} AS log_bytes, {micro_sql('p_retailprice * 8 / nullif(p_size * (p_partkey % 3), 0)')} AS bits_per_pixel FROM part")
def guarded_ratios(spark, sf):
    from ..functions.kernels import meta_features

    m = meta_features(F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey") % 3)
    return load(spark, sf, "part").select("p_partkey", micro(m["log_bytes"]).alias("log_bytes"), micro(m["bits_per_pixel"]).alias("bits_per_pixel"))


@query("id_probe", f"WITH {ITEMS} SELECT {micro_sql('''corr(('0x' || substr(md5(id || ''), 1, 8))::BIGINT::DOUBLE, label::DOUBLE)''')} AS r FROM items")
def id_probe(spark, sf):
    return tx.id_probe(items(spark, sf).select(F.md5(F.col("id").cast("string")).alias("id"), "label")).select(micro(F.col("r")).alias("r"))
