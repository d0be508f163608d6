"""Pairs of a block's members are listed once, and only those with a member outside the block's largest component."""

from plumbline.llm import near_copies as nc
from pyspark.sql import functions as F


def test_a_pair_of_rare_members_is_met_once(spark):
    rows = [(7, fp, c, c != 1, 100, [0] * 8, []) for fp, c in ((1, 1), (2, 1), (3, 3), (4, 4), (5, 5))]
    members = spark.createDataFrame(rows, "key long, fp long, c long, rare boolean, n long, odd array<long>, wide array<long>")
    got = sorted((r.fa, r.fb) for r in nc._all_pairs(members, members.where(F.col("rare")), (4, 5)).collect())
    assert got == [(1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)]
