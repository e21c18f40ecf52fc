"""Usage memory: an aggregation of usage events, its listing, pruning and forgetting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.paths import basename, in_subtree
from pathloom.functions.ranking import frecency
from pathloom.schema import ACTIONS


def aggregate(events: DataFrame) -> DataFrame:
    """One row per path: counts by action, first use by arrival, and the latest use's time, query and action.

    Events are ordered by ``seq``; of a repeated ``seq`` the later ``ts`` counts as the latest. Unknown actions add
    to the total only; null paths are left out.
    """
    last = F.max(F.struct("seq", "ts", "query", "action"))
    counts = [F.count_if(F.col("action") == a).alias(f"{a}_count") for a in ACTIONS]
    known = events.where("path is not null")
    out = known.groupBy("path").agg(F.count(F.lit(1)).alias("total_count"), *counts, F.min(F.struct("seq", "ts")).alias("f"), last.alias("l"))
    return out.select(
        "path", basename(F.col("path")).alias("name"), "total_count", *[f"{a}_count" for a in ACTIONS], F.col("f.ts").alias("first_used"), F.col("l.ts").alias("last_used"), F.col("l.query").alias("last_query"), F.col("l.action").alias("last_action")
    )


def forget(events: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Events that survive ``forgotten`` (path, seq): an event counts if it came after its path was last forgotten.

    A null path in ``forgotten`` clears everything up to its ``seq``.
    """
    last = forgotten.groupBy("path").agg(F.max("seq").alias("upto"))
    everything = last.where("path is null").agg(F.coalesce(F.max("upto"), F.lit(-(1 << 62))).alias("a"))
    kept = events.where("path is not null").join(last.where("path is not null"), "path", "left").where("upto is null or seq > upto")
    return kept.where(F.col("seq") > everything.scalar()).drop("upto")


def listing(usage: DataFrame, *, now: int, query: str | None = None, scope: str | None = None, limit: int = 20) -> DataFrame:
    """By frecency, then last use, count and path; a query matches path or name, a scope is a subtree."""
    rows = usage
    if scope:
        rows = rows.where(in_subtree(F.col("path"), scope.rstrip("/") or "/"))
    if query and query.strip():
        q = query.strip().lower()
        rows = rows.where(F.lower("path").contains(q) | F.lower("name").contains(q))
    scored = rows.withColumn("frecency", F.round(frecency(F.col("last_used"), F.col("total_count"), now), 6))
    return scored.orderBy(F.desc("frecency"), F.desc("last_used"), F.desc("total_count"), "path").limit(limit)


def prune(usage: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` entries used last; equal ones by count, then path."""
    return usage.orderBy(F.desc("last_used"), F.desc("total_count"), "path").limit(keep)


def as_results(usage: DataFrame) -> DataFrame:
    """Entries as search results: the score is the count up to 100 as a share, the size 0, the time of last use as mtime."""
    score = (F.least(F.col("total_count"), F.lit(100)).cast("float") / F.lit(100.0).cast("float")).cast("float")
    return usage.select("path", "name", score.alias("score"), F.lit(0).cast("bigint").alias("size"), F.col("last_used").alias("mtime"))
