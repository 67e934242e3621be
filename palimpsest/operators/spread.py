"""Ranks and prefix sums within groups of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def prefix_sum(df: DataFrame, group: str, order: str, value: str, out: str, salts: int | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the group before this one.

    Order within a group is (salt, order), salt a hash of `order`; it is fixed but not that of `order` alone. A group is
    split into `salts` windows (as many as there are shuffle partitions, at least 64), whose totals (at most `salts` rows a
    group) give each window its start.
    """
    salts = salts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    before = W.partitionBy(group, "_salt").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(before), F.lit(0)))
    totals = df.groupBy(group, "_salt").agg(F.sum(value).alias("_total"))
    earlier = W.partitionBy(group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col(group).alias("_group"), F.col("_salt").alias("_part"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    both = local.join(starts, local[group].eqNullSafe(starts._group) & (local._salt == starts._part))
    return both.withColumn(out, (F.col("_local") + F.col("_start")).cast("long")).drop("_salt", "_local", "_group", "_part", "_start")


def rank_within(df: DataFrame, group: list[str], order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """Adds `out`: the place (from 1) of each row in its group by `order`, exact though a group may span many tasks.

    Rows are range-partitioned by group and order; each range ranks by itself and starts from the group's counts in the
    ranges before it (at most one row a range and group).
    """
    n = partitions or max(2, df.sparkSession.sparkContext.defaultParallelism)
    ranged = cut(df.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id()))
    local = ranged.withColumn("_local", F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)))
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return local.join(starts, [*group, "_range"]).withColumn(out, (F.col("_local") + F.col("_start")).cast("long")).drop("_range", "_local", "_start")
