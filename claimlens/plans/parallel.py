"""How rows are dealt out to tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from claimlens.sources import shared_dir


#: Bytes from which on the reader itself makes a task of a file, as its default has it.
SPLIT = 4 << 20


def deal_out(df: DataFrame, factor: int = 2) -> DataFrame:
    """``df``, as read from files, over at least one task for each core.

    A small file is one split, which leaves all cores but one idle when the work
    on a row is costly. Only then are the rows dealt out anew, so what moves is
    bounded by ``SPLIT`` for each core; large inputs stay as read. The size is the
    files' own, for which nothing is run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    read = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(read.apply(i).stats().sizeInBytes())) for i in range(read.size()))
    return df.repartition(cores * factor) if size < cores * SPLIT else df


def in_order(df: DataFrame, group: list[str], order: list[str | Column], value: str | None = None) -> DataFrame:
    """``df`` with ``rn``, 1-based by ``order`` within the group, ``n``, its size, and ``running``, the sum of ``value`` so far.

    Rows are range-partitioned by group and order, so a group of a third of all rows
    is many tasks; the place of a row is its place in the partition plus what earlier
    partitions have of the group, for which one row of each partition and group is
    enough. ``order`` should tell all rows of a group apart. Null groups are groups.
    """
    shared_dir(df.sparkSession)
    keys = [*[F.col(c) for c in group], *[F.col(c) if isinstance(c, str) else c for c in order]]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # stored once: the parts are sampled anew each time they are made
    placed = spread.select("*", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().alias("at_")).checkpoint()
    sums = placed.groupBy(*group, "part_").agg(F.min("at_").alias("first_"), F.count("*").alias("c_"), (F.sum(value) if value else F.lit(0)).alias("v_"))
    whole = Window.partitionBy(*(group or [F.lit(1)]))
    along = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)
    known = sums.select(*[F.col(c).alias(f"{c}_g") for c in group], F.col("part_").alias("part_g"), "first_", (F.sum("c_").over(along) - F.col("c_")).alias("before_"), (F.sum("v_").over(along) - F.col("v_")).alias("sum_"), F.sum("c_").over(whole).alias("n"))
    met = F.col("part_") == F.col("part_g")
    for c in group:
        met = met & F.col(c).eqNullSafe(F.col(f"{c}_g"))
    rows = placed.join(known, met).withColumn("rn", F.col("at_") - F.col("first_") + F.col("before_") + 1)
    if value:
        inside = Window.partitionBy(*group, "part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("running", F.sum(value).over(inside) + F.col("sum_"))
    return rows.drop("part_", "at_", "part_g", "first_", "before_", "sum_", *[f"{c}_g" for c in group])
