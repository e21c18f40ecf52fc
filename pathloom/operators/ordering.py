"""Places and running totals over a whole table in order, without gathering it in one task.

Rows are range-partitioned by the order and kept, since bounds are sampled; a row's total is that of its partition up to it plus
the sums of the partitions before, of which there is one number each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pathloom.session import durable


def running_sum(df: DataFrame, value: Column, *order: Column | str, at: str) -> DataFrame:
    """Add ``at``: the sum of ``value`` over the rows up to this one; rows that tie in ``order`` count in any order."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = durable(df.withColumn("__value", value).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ahead = sums.select(F.col("__part").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__ahead"))
    local = F.sum("__value").over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    joined = placed.withColumn("__local", local).join(F.broadcast(ahead), F.col("__part") == F.col("__of"))
    return joined.withColumn(at, F.col("__local") + F.col("__ahead")).drop("__value", "__part", "__of", "__local", "__ahead")


def numbered(df: DataFrame, *order: Column | str, at: str = "position") -> DataFrame:
    """Add ``at``: the place of every row, from 1."""
    return running_sum(df, F.lit(1), *order, at=at)
