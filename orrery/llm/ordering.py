"""Ranks and neighbours in ordered groups of any size, without holding a group in one task.

Rows are range-partitioned by group and order, so partitions are of like size and a group larger than one is spread over
several. Windows run within partitions; what crosses a border (running counts, the last rows of the partition before) is
a table of a few rows a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import written

PART = "_part"


def partitioned(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df``, written, with the number of the range partition of each row in ``_part``."""
    return written(df.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def numbered(parts: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``parts`` (from ``partitioned``) with each row's place in its group, from 1, as ``name``. The order must be total
    for the numbers to be definite."""
    counts = parts.groupBy(PART, *group).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*group)
    spread = counts.withColumn("_parts", F.count("*").over(over)).where("_parts > 1")  # at most two groups a partition
    before = spread.withColumn("_before", F.sum("_n").over(over.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)))
    before = F.broadcast(before.where("_before is not null").select(F.col(PART).alias("_p"), *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), "_before"))
    same = (F.col(PART) == F.col("_p")) & F.lit(True)
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    own = F.row_number().over(Window.partitionBy(PART, *group).orderBy(*order))
    return parts.withColumn(name, own.cast("long")).join(before, same, "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_p", "_before", *(f"_g{i}" for i in range(len(group))))


def with_border_rows(parts: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """``parts`` with, in each partition, copies of the ``n`` rows before its first one, marked by ``_ghost``, so that
    windows over ``_part`` see as far back as ``n`` rows. A partition that holds fewer rows hands on what it has and what
    it was handed."""
    used = sorted(r[0] for r in parts.select(PART).distinct().collect())  # one number a partition
    last = F.row_number().over(Window.partitionBy(PART).orderBy(*(F.desc(c) for c in (*group, *order))))
    tails = parts.withColumn("_back", last).where(F.col("_back") <= n)
    sizes = {r[PART]: r["k"] for r in tails.groupBy(PART).agg(F.count("*").alias("k")).collect()}
    moves = []
    for i, p in enumerate(used):
        need, j = n, i - 1
        while need > 0 and j >= 0:
            moves.append((used[j], p, need))
            need -= sizes[used[j]]
            j -= 1
    spark = parts.sparkSession
    if not moves:
        return parts.withColumn("_ghost", F.lit(False))
    to = F.broadcast(spark.createDataFrame(moves, "_from int, _to int, _need int"))
    ghosts = tails.join(to, (F.col(PART) == F.col("_from")) & (F.col("_back") <= F.col("_need"))).withColumn(PART, F.col("_to")).drop("_back", "_from", "_to", "_need")
    return parts.withColumn("_ghost", F.lit(False)).unionByName(ghosts.withColumn("_ghost", F.lit(True)))
