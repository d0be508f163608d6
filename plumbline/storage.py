"""Intermediate tables in the folder that driver and executors share.

Iterative and multi-pass operators cut their lineage by writing a table under
``spark.checkpoint.dir`` and reading it back, so that a lost executor costs a
re-read and not a recomputation of every earlier pass.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary one is set only where none is named and all runs on one machine (tests)."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set(_KEY, named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back (lineage ends there).

    The shuffle files of the write go as soon as it ends, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `stored` returned and that no plan still to run reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
