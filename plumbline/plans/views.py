"""The engine's logical tables over the star schema and document tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bootstrap import hash_unit
from ..operators.similarity import simhash

MODELS = ("m1", "m2", "m3")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("label"), (F.col("quality") == 1).alias("is_digital"), F.col("lang").alias("country"),
        F.col("source").alias("doc_type"), F.col("lang").alias("type"), F.concat_ws("/", "lang", "source").alias("fine_type"), "n_chars", "text",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.explode(F.array(*map(F.lit, MODELS))).alias("model")
    rows = items(spark, sf_dir).select("id", "type", F.col("label").alias("y"), models)
    return rows.withColumn("s", hash_unit("id", "model"))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, words): a table of few files is dealt out first, as hashing n-grams is the work."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").repartition(spark.sparkContext.defaultParallelism, "id")
    return simhash(docs)


def micro(x):
    """A double as whole millionths, so that last-digit noise of different engines doesn't show."""
    return F.floor(x * 1e6 + 0.5).cast("long")


ITEMS = """items AS (SELECT d.doc_id AS id, l.toxic AS label, l.quality = 1 AS is_digital, d.lang AS country, d.source AS doc_type,
 d.lang AS type, d.lang || '/' || d.source AS fine_type, d.n_chars, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
SCORES = (
    ITEMS
    + """, scores AS (SELECT id, type, label AS y, model, ('0x' || substr(md5(id || ':' || model), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS s
 FROM items CROSS JOIN (VALUES ('m1'), ('m2'), ('m3')) m(model))"""
)


def unit_sql(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def micro_sql(x: str) -> str:
    return f"CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"


_H = [f"h{k}" for k in range(8)]
_BITS = ", ".join(f"sum(({h} >> {31 - b}) & 1) * 2 > count(*) AS {h}_{b}" for h in _H for b in range(32))
_PACK = ", ".join("coalesce(" + " + ".join(f"CASE WHEN {h}_{b} THEN {1 << (31 - b)}::BIGINT ELSE 0 END" for b in range(32)) + f", 0)::BIGINT AS {h}" for h in _H)
#: 256-bit prints as eight 32-bit numbers, the highest first.
PRINTS = f"""words AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE w END) AS g FROM words),
parts AS (SELECT id, {", ".join(f"('0x' || substr(sha256(g), {8 * k + 1}, 8))::BIGINT AS {h}" for k, h in enumerate(_H))} FROM grams),
bits AS (SELECT id, {_BITS} FROM parts GROUP BY id),
prints AS (SELECT d.doc_id AS id, {_PACK} FROM documents d LEFT JOIN bits ON d.doc_id = bits.id)"""
DIST = "(" + " + ".join(f"bit_count(xor(a.{h}, b.{h}))::INTEGER" for h in _H) + ")"
PAIRS = (
    PRINTS
    + f""", pairs AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, {DIST} AS dist FROM prints a JOIN prints b ON a.id < b.id) WHERE dist <= 10)"""
)
#: Components of `pairs` over all documents; needs WITH RECURSIVE.
COMPONENTS = (
    PAIRS
    + """, edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
comps AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""
)
