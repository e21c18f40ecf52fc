"""Quality of rankings and summaries of latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.ranking import is_noise
from pathloom.operators.ordering import running_sum
from pathloom.session import broadcast_if_small


def first_relevant(results: DataFrame, labels: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query, first, noise)`` for every query: rank of its first relevant result, and noisy results before it (0 if none is).

    ``results``: (query, rank, path); ``labels``: (query, path); ``queries``: (query).
    """
    hit = labels.select("query", "path").distinct().withColumn("relevant", F.lit(True))
    seen = results.join(hit, ["query", "path"], "left")
    first = seen.groupBy("query").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    noisy = results.join(first, "query").where(F.col("rank") < F.col("first")).groupBy("query").agg(F.count_if(is_noise(F.lower("path"))).alias("noise"))
    return queries.select("query").distinct().join(first, "query", "left").join(noisy, "query", "left").select("query", "first", F.coalesce("noise", F.lit(0)).alias("noise"))


def noise_before_relevant(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query, first, noise)`` as :func:`first_relevant` over all hits however deep, without ranking them.

    ``hits``: (query, path, at, relevant), ``at`` being what orders a query's hits, ascending, without ties; a path is
    relevant where one of its hits is. All is counts and least values, combined before they move.
    """
    paths = hits.groupBy("query", "path").agg(F.min("at").alias("at"), F.max("relevant").alias("relevant"))
    least = paths.where(F.col("relevant") & F.col("path").isNotNull()).groupBy("query").agg(F.min("at").alias("until"))
    before = hits.join(broadcast_if_small(least), "query").where(F.col("at") <= F.col("until"))
    counts = before.groupBy("query").agg(F.count(F.lit(1)).alias("first"), F.count_if((F.col("at") < F.col("until")) & is_noise(F.lower("path"))).alias("noise"))
    return queries.select("query").distinct().join(counts, "query", "left").select("query", "first", F.coalesce("noise", F.lit(0)).alias("noise"))


def mrr(first: Column, k: int) -> Column:
    return F.avg(F.when(first <= k, F.lit(1.0) / first).otherwise(0.0))


def hit_rate(first: Column, k: int) -> Column:
    return F.avg(F.when(first <= k, 1.0).otherwise(0.0))


def bucket(path: Column) -> Column:
    """The directory under a home, else the first component, else ``unknown``."""
    parts = F.filter(F.split(path, "/"), lambda c: c != "")
    home = (F.size(parts) >= 3) & (F.try_element_at(parts, F.lit(1)) == "Users")
    return F.coalesce(F.when(home, F.try_element_at(parts, F.lit(3))), F.try_element_at(parts, F.lit(1)), F.lit("unknown"))


def diversity(results: DataFrame, k: int = 10) -> DataFrame:
    """``(query, buckets)``: distinct buckets among the first ``k``."""
    return results.where(F.col("rank") <= k).groupBy("query").agg(F.count_distinct(bucket(F.col("path"))).alias("buckets"))


def percentile_of(sorted_values: Column, share: float) -> Column:
    """Nearest rank, halves up, of a sorted array; 0 for an empty one."""
    at = F.floor(F.lit(share) * (F.size(sorted_values) - 1) + F.lit(0.5)).cast("int")
    return F.when(F.size(sorted_values) > 0, F.element_at(sorted_values, at + 1)).otherwise(0)


def latency_summary(samples: DataFrame, *by: str) -> DataFrame:
    """Per group of bench samples (elapsed_us, ok): runs, errors, extremes, percentiles, whole mean and rate per second.

    The percentiles are exact. They come from counts per distinct value and a running sum, so a group is not gathered.
    """
    from pyspark.sql import Window as W

    keys = list(by)
    ok = samples.where("ok and elapsed_us is not null")
    counts = ok.groupBy(*keys, "elapsed_us").agg(F.count(F.lit(1)).alias("c"))
    if keys:
        part = W.partitionBy(*keys)
        upto = counts.withColumns({"hi": F.sum("c").over(part.orderBy("elapsed_us").rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("c").over(part)})
    else:
        upto = running_sum(counts, F.col("c"), "elapsed_us", at="hi").withColumn("n", counts.agg(F.sum("c")).scalar())
    at = lambda p: F.floor(F.lit(p) * (F.col("n") - 1) + F.lit(0.5))
    pick = [F.min(F.when(F.col("hi") > at(p), F.col("elapsed_us"))).alias(name) for name, p in (("p50_us", 0.5), ("p90_us", 0.9), ("p95_us", 0.95), ("p99_us", 0.99))]
    total = F.sum(F.col("elapsed_us") * F.col("c"))
    figures = upto.groupBy(*keys).agg(F.sum("c").alias("ok_runs"), F.min("elapsed_us").alias("min_us"), *pick, F.max("elapsed_us").alias("max_us"), F.floor(total / F.sum("c")).alias("mean_us"), F.round(F.sum("c") * 1e6 / total, 6).alias("qps"))
    errors = samples.groupBy(*keys).agg(F.count_if(~F.coalesce("ok", F.lit(False))).alias("error_runs"))
    return errors.join(figures, keys, "left") if keys else errors.crossJoin(figures)
