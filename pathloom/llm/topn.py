"""The N best items of every group, by descending score bands.

Scores are cut into bands at their own quantiles. Counting items per group and band, from the top
band down, tells in which band a group fills up: bands above it are taken whole without ranking,
bands below it are dropped, and only the band at the boundary is ranked, ties and all. The counts
are compact states, so no group is ever gathered for them.

Rows move once: they are partitioned by group, and there combined by item, counted, joined to what their
group still needs, and ranked. Two pre-passes over one column each find what must not move like that.
Items delivered again and again are combined before they move. Groups with an outsized share of the rows are
spread over slices throughout; at their boundary band each slice first keeps no more than the group
still needs; where even that may be too much for one task (limits above ``RANK_AT_ONCE``), rows are
range-partitioned by the full order instead and ranked by their place in a partition plus the sizes
of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pathloom.operators.skew import HOT_SHARE, SALTS
from pathloom.session import durable

#: Score bands; any number is correct.
BANDS = 32
#: The largest limit for which a hot group's slices are merged in one task (at most SALTS times as many rows).
RANK_AT_ONCE = 10_000
#: Buckets in which frequent groups and items are looked for.
BUCKETS = 8_192


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), c), F.lit(BUCKETS)).cast("int")


def _heavy(rows: DataFrame, c: str) -> list[int]:
    """Buckets of ``c`` with more than 1/HOT_SHARE of the rows, so fewer than HOT_SHARE numbers; every frequent value is in one."""
    counts = rows.groupBy(_bucket(c).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return [r.b for r in counts.where(F.col("n") * HOT_SHARE > counts.agg(F.sum("n")).scalar()).select("b").collect()]


def _ranked_by_range(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """``__rank`` of every row in its group, without gathering a group."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    # partition bounds are sampled, so they are fixed in files before they are used twice
    placed = durable(rows.repartitionByRange(n, F.col(group), *order).withColumn("__pid", F.spark_partition_id()))
    sizes = placed.groupBy(group, "__pid").agg(F.count(F.lit(1)).alias("__size"))
    ahead = W.partitionBy(group).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("__g"), F.col("__pid").alias("__p"), F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__ahead"))
    local = placed.withColumn("__local", F.row_number().over(W.partitionBy(group, "__pid").orderBy(*order)))
    joined = local.join(offsets, (local[group] == offsets["__g"]) & (local["__pid"] == offsets["__p"]))
    return joined.withColumn("__rank", F.col("__local") + F.col("__ahead")).drop("__g", "__p", "__pid", "__local", "__ahead")


def top_n_per_group(
    items: DataFrame,
    limits: DataFrame,
    *,
    group: str,
    item: str,
    score: str,
    limit: str,
    ties: Mapping[str, str],
    bands: int = BANDS,
    salts: int = SALTS,
    rank_at_once: int = RANK_AT_ONCE,
) -> DataFrame:
    """``(group, item, score, ties...)`` of the first ``limit`` items of each group in ``limits``.

    Order: ``score`` descending, then ``ties`` (column -> "asc" or "desc", nulls last), then ``item``
    ascending. Items without group, id or score, and those whose score is NaN, don't count. An item
    delivered more than once in a group counts once, with its greatest (score, ties...). A group named
    more than once in ``limits`` takes the greatest limit; null, zero and negative limits give nothing.
    Items of other groups are ignored, as are all other columns; empty inputs give no rows.
    """
    scored = items.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"), *[F.col(c).alias(f"t{k}") for k, c in enumerate(ties)])
    number = dict(scored.dtypes)["s"] in ("float", "double")
    valid = scored.where("g is not null and i is not null and s is not null" + (" and not isnan(s)" if number else ""))
    wanted = limits.where(F.col(limit) > 0).groupBy(F.col(group).alias("g")).agg(F.max(limit).alias("n"))
    tie_columns = [f"t{k}" for k in range(len(ties))]
    order = [F.col("s").desc(), *[F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in zip(tie_columns, ties.values())], F.col("i").asc()]
    out = ["g", "i", "s", *tie_columns]
    cuts = valid.agg(F.percentile_approx("s", [k / bands for k in range(1, bands)], 2_000).alias("c"))
    best = F.max(F.struct("s", *tie_columns)).alias("r")
    parts_n = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    # an item delivered as often as a frequent group is large would follow its slice into one task
    again = _heavy(valid, "i")
    if again:
        often = _bucket("i").isin(again)
        combined = valid.where(often).groupBy("g", "i").agg(best).select("g", "i", "r.*")
        valid = valid.where(~often).unionByName(combined.select(valid.columns))

    def first(rows: DataFrame, slices: int) -> DataFrame:
        """Rows of the bands down to where their group fills up, with that band and what the group needs there; groups in so many slices."""
        keys = ["g", "salt"] if slices > 1 else ["g"]
        sliced = rows.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(slices)).cast("int")) if slices > 1 else rows
        once = sliced.repartition(parts_n, *keys).groupBy(*keys, "i").agg(best)
        cut = once.select(*keys, "i", "r.*").withColumn("cuts", cuts.scalar())
        banded = cut.withColumn("band", F.coalesce(F.size(F.filter("cuts", lambda c: c > F.col("s"))), F.lit(0))).drop("cuts")
        # from the top band down: where each group fills up, and how much it needs there
        counts = banded.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("c"))
        if slices > 1:
            counts = counts.groupBy("g", "band").agg(F.sum("c").alias("c"))
        running = counts.join(wanted, "g").withColumn("upto", F.sum("c").over(W.partitionBy("g").orderBy("band").rowsBetween(W.unboundedPreceding, 0)))
        fills = running.groupBy("g").agg(
            F.min(F.when(F.col("upto") >= F.col("n"), F.col("band"))).alias("last"),
            (F.max("n") - F.coalesce(F.max(F.when(F.col("upto") < F.col("n"), F.col("upto"))), F.lit(0))).alias("need"),
        )
        state = fills.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))) if slices > 1 else fills
        # the anti-join against filled groups and the lookup of what is still needed are one join
        return banded.join(state, keys).where(F.col("last").isNull() | (F.col("band") <= F.col("last")))

    def ranked(kept: DataFrame) -> DataFrame:
        """Rows taken whole, and of the boundary band in each slice the first that the group needs; only the latter are ordered."""
        edge = F.coalesce(F.col("band") == F.col("last"), F.lit(False))
        rows = kept.withColumn("edge", edge)
        by = [F.when(F.col("edge"), F.col(c)) for c in ("s", *tie_columns, "i")]
        ways = [by[0].desc(), *[c.desc_nulls_last() if w == "desc" else c.asc_nulls_last() for c, w in zip(by[1:-1], ties.values())], by[-1].asc()]
        keys = [c for c in ("g", "salt") if c in kept.columns]
        rn = F.row_number().over(W.partitionBy(*keys, "edge").orderBy(*ways))
        return rows.withColumn("rn", rn).where("not edge or rn <= need")

    # groups found frequent by their bucket share the slices with their few neighbours there
    large = _heavy(valid, "g")
    hot = _bucket("g").isin(large)
    union = ranked(first(valid.where(~hot) if large else valid, 1)).select(out)
    if large:
        wanted = wanted.where(hot)
        kept = first(valid.where(hot), salts)
        edge = kept.where("band = last")
        most = wanted.agg(F.max("n")).first()[0] or 0
        union = union.unionByName(kept.where("last is null or band < last").select(out))
        if most <= rank_at_once:
            merged = ranked(edge).withColumn("rn", F.row_number().over(W.partitionBy("g").orderBy(*order)))
            union = union.unionByName(merged.where("rn <= need").select(out))
        else:
            union = union.unionByName(_ranked_by_range(edge, "g", order).where("__rank <= need").select(out))
    return union.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), *[F.col(f"t{k}").alias(c) for k, c in enumerate(ties)])
