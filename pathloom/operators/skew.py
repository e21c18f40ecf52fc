"""Keys that hold a large share of the rows: find them, spread them, and meet them again.

A key is *hot* when it holds more than 1/``share`` of all rows, so there are fewer than ``share``
hot keys whatever the data; that bound is what makes broadcasting them safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/512 of the rows is hot, so at most 511 keys are.
HOT_SHARE = 512
#: Number of slices a hot key's rows are spread over.
SALTS = 64


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """``(key)``: fewer than ``share`` rows. Counts are combined before the shuffle; null keys never join and are left out."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__total"))
    return sizes.where(F.col("__n") * share > total.scalar()).select(key)


def spread(df: DataFrame, hot: DataFrame, key: str, by: Column, salts: int = SALTS, salt: str = "__salt") -> DataFrame:
    """Add ``salt``: a slice of ``salts`` chosen by ``by`` for rows of hot keys, 0 for all others."""
    mark = hot.select(F.col(key).alias("__hot"))
    return (
        df.join(F.broadcast(mark), df[key] == F.col("__hot"), "left")
        .withColumn(salt, F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
        .drop("__hot")
    )


def replicate(df: DataFrame, hot: DataFrame, key: str, salts: int = SALTS, salt: str = "__salt") -> DataFrame:
    """Repeat the rows of hot keys once for each slice, the counterpart of :func:`spread`."""
    mark = hot.select(F.col(key).alias("__hot"))
    slices = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return df.join(F.broadcast(mark), df[key] == F.col("__hot"), "left").withColumn(salt, F.explode(slices)).drop("__hot")
