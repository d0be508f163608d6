"""Row numbers and running sums over cells of any size, without a task that holds a whole cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def running(df: DataFrame, order: Sequence[str], value: Column, keys: Sequence[str] = (), out: str = "before", total: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the cell that come before by ``order``; with ``total`` the cell's sum.

    Rows are dealt by ranges of (keys, order) and summed within a range; the
    ranges' sums, a row a cell and range, give what each begins with. The
    dealt table is written first, so that ranges stay the same if a task is
    lost. The order must tell a cell's rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__v", value.cast("long")).repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    cell = Window.partitionBy(*keys)
    sizes = ranged.groupBy(*keys, "__part").agg(F.sum("__v").alias("__n"))
    before = F.coalesce(F.sum("__n").over(cell.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [*keys, "__part"]
    starts = sizes.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], before.alias("__before"), F.sum("__n").over(cell).alias("__all"))
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    done = ranged.withColumn("__local", F.coalesce(F.sum("__v").over(inside), F.lit(0))).join(starts, same)
    more = [F.col("__all").alias(total)] if total else []
    return done.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__local")).alias(out), *more)


def numbered(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), out: str = "place", total: str | None = None) -> DataFrame:
    """Add ``out``: 0, 1, ... by ``order`` within each cell of the keys, and with ``total`` the cell's rows."""
    return running(df, order, F.lit(1), keys, out, total)
