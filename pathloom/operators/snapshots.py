"""Full snapshots of a table: the rows that count, and what changed from one to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Up to this many snapshot ids become literals of the plan; more are joined.
LITERAL_SNAPSHOTS = 256
_SALTS = 64


def row_hash(columns: Sequence[str | Column]) -> Column:
    """64-bit hash of the columns in which null equals only null.

    The built-in hash passes over nulls, so a bit per column says which ones are null.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    bits = F.concat(*[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in cols])
    return F.xxhash64(*cols, bits)


def live_files(file_meta: DataFrame) -> DataFrame:
    """file_meta without tombstones (``path_len`` 0) and without rows that name no snapshot or path."""
    return file_meta.where("path_offset is not null and snapshot_id is not null and not (path_len <=> 0)")


def _pairs(df: DataFrame, snapshot: str) -> DataFrame:
    """Tag every row as the after side of its own snapshot and the before side of the next one."""
    kind = dict(df.dtypes)[snapshot]
    seen = df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct()
    ids = sorted(r[0] for r in seen.limit(LITERAL_SNAPSHOTS + 1).collect())
    both = lambda first, after: F.filter(
        F.array(
            F.struct(F.when(~first, F.col(snapshot)).alias("pair"), F.lit(True).alias("after")),
            F.struct(after.cast(kind).alias("pair"), F.lit(False).alias("after")),
        ),
        lambda t: t["pair"].isNotNull(),
    )
    if len(ids) <= LITERAL_SNAPSHOTS:
        if len(ids) < 2:
            return df.where("false").withColumns({"__pair": F.lit(None).cast(kind), "__after": F.lit(True)})
        following = F.create_map(*[F.lit(x).cast(kind) for pair in zip(ids, ids[1:]) for x in pair])
        tagged = df.withColumn("__tags", both(F.col(snapshot) == F.lit(ids[0]), F.try_element_at(following, F.col(snapshot))))
    else:  # too many to hold in the plan: a join, salted because each snapshot is a large group
        order = W.orderBy(snapshot)
        steps = seen.select(F.col(snapshot).alias("__s"), F.lead(snapshot).over(order).alias("__next"), (F.lag(snapshot).over(order).isNull()).alias("__first"))
        steps = steps.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS)).cast("int"))
        tagged = salted.join(steps, (salted[snapshot] == steps["__s"]) & (salted["__salt"] == steps["__salt"])).drop("__s", "__salt")
        tagged = tagged.withColumn("__tags", both(F.col("__first"), F.col("__next"))).drop("__first", "__next")
    return tagged.withColumn("__tag", F.explode("__tags")).select("*", F.col("__tag.pair").alias("__pair"), F.col("__tag.after").alias("__after")).drop("__tags", "__tag")


def snapshot_changes(
    df: DataFrame, *, snapshot: str, key: str, version: str, compare: Sequence[str], live: Column | None = None
) -> DataFrame:
    """``(snapshot, key, change_kind)`` for each snapshot but the first, against the one before it by id.

    Both sides of every pair are united under a side tag and grouped by pair and key in one
    aggregation: per side it keeps the row hash of the greatest ``version``, and the two hashes
    classify the key as ``added``, ``removed`` or ``changed``. Equal versions with different contents are
    decided by the greater hash. Rows with a null key, and rows for which ``live`` is not true, stand for
    nothing, though their snapshot still exists; null versions are the lowest. Fewer than two snapshots
    give no rows. Other columns are ignored.
    """
    slim = df.select(F.col(snapshot), F.col(key), F.col(version).alias("__v"), row_hash(compare).alias("__h"), (F.lit(True) if live is None else F.coalesce(live, F.lit(False))).alias("__live"))
    tagged = _pairs(slim, snapshot).where(F.col("__live") & F.col(key).isNotNull())
    state = F.struct("__v", "__h")
    sides = tagged.groupBy("__pair", key).agg(F.max(F.when(F.col("__after"), state)).alias("__new"), F.max(F.when(~F.col("__after"), state)).alias("__old"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__new.__h") != F.col("__old.__h"), "changed")
    return sides.select(F.col("__pair").alias(snapshot), key, change.alias("change_kind")).where("change_kind is not null")
