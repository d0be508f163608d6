"""A training-data pipeline over documents: STAGES, applied in order by run().

Every stage takes the documents that its predecessor kept and returns the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.llm.decontaminate import remove_benchmark
from plumbline.llm.near_copies import without_near_copies
from plumbline.llm.packing import pack
from plumbline.llm.pii import redact
from plumbline.llm.toxicity import without_toxic
from plumbline.storage import stored


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go.

    All columns stay, whatever these are named; null and empty texts are
    scored like any other, repeated rows alike; no documents give none.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in word 5-shingles (SimHash blocks), the one with the smallest id stays.

    Null and empty texts are copies of each other, null ids come last, and of
    rows that agree in id and text one stays; no documents give none.
    """
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; every document stays.

    Null texts stay null (n_chars null too); an empty benchmark changes none.
    """
    return _measured(remove_benchmark(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays, null texts null."""
    return _measured(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token ids in sequences of 1024: a row a piece, with its ids and its place.

    Null and empty texts have the end token alone; no documents give no pieces.
    """
    return pack(docs, with_ids=True, memo_bytes=32 << 20)  # the stage's shuffle of ids needs the memory


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
