"""A change feed applied as a signed multiset.

Every deduplicated change removes the image that stood before it (-1) and may add one (+1); the sum of
multiplicities leaves exactly the images that still stand. The image before a change is found
within slices: a path's touches are cut at fixed ranges of the sequence number, so a slice holds at
most two touches for each number in its range however often one path changes, and what a slice
does to the images of earlier slices follows from its last touch alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Sequence numbers per slice; bounds a slice at twice as many rows.
SLICE = 65_536


def latest_deliveries(changes: DataFrame, *, order: Sequence[str], arrived: str, columns: Sequence[str]) -> DataFrame:
    """One row per change: the delivery that arrived last.

    Equal arrival times are decided by the greatest contents, column by column; a null arrival is the
    earliest. Changes whose place in the order is null can't be applied and are left out.
    """
    ordered = changes.where(" and ".join(f"`{c}` is not null" for c in order))
    last = ordered.groupBy(*order).agg(F.max(F.struct(arrived, *columns)).alias("__d"))
    return last.select(*order, *[F.col(f"__d.{c}").alias(c) for c in columns])


def path_touches(changes: DataFrame, *, order: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """``(path, order..., sub, writes, payload)``: what each change does to which path.

    CreateOrModify writes ``path``; Delete removes ``path``; Move removes ``from_path`` and then writes
    ``path``. Null paths and other kinds touch nothing.
    """
    kind = F.col("kind")
    touch = lambda p, writes: F.struct(F.col(p).alias("path"), F.lit(int(writes)).alias("sub"), F.lit(writes).alias("writes"))
    touches = F.when(kind == "CreateOrModify", F.array(touch("path", True))).when(kind == "Delete", F.array(touch("path", False))).when(kind == "Move", F.array(touch("from_path", False), touch("path", True)))
    out = changes.select(*order, F.struct(*payload).alias("__payload") if payload else F.lit(None).cast("int").alias("__payload"), F.explode(touches).alias("__t"))
    return out.select(F.col("__t.path").alias("path"), *order, F.col("__t.sub").alias("sub"), F.col("__t.writes").alias("writes"), "__payload").where("path is not null")


def apply_changes(
    changes: DataFrame,
    *,
    epoch: str = "journal_epoch",
    seq: str = "seq",
    arrived: str = "arrived_at",
    payload: Sequence[str] = (),
    base: DataFrame | None = None,
    slice_width: int = SLICE,
) -> DataFrame:
    """``(path, epoch, seq, payload...)`` of every path that stands after all changes.

    ``base`` holds ``path`` and the payload columns of the state before the first change (one row per
    path; of repeated paths the greatest payload counts); its survivors have a null epoch and seq.
    Empty inputs give empty results; unknown columns are ignored.
    """
    columns = ["kind", "path", "from_path", *[c for c in payload if c not in ("path", "from_path", "kind")]]
    once = latest_deliveries(changes, order=(epoch, seq), arrived=arrived, columns=columns)
    touches = path_touches(once, order=(epoch, seq), payload=payload).withColumn("__base", F.lit(False))
    if base is not None:
        image = F.max(F.struct(*payload)) if payload else F.lit(None).cast("int")
        stock = base.where("path is not null").groupBy("path").agg(image.alias("__payload"), F.lit(0).alias("sub"), F.lit(True).alias("writes"), F.lit(True).alias("__base"))
        stock = stock.withColumns({epoch: F.lit(None).cast(dict(changes.dtypes)[epoch]), seq: F.lit(None).cast(dict(changes.dtypes)[seq])})
        touches = touches.unionByName(stock)
    sliced = touches.withColumn("__slice", F.floor(F.col(seq) / F.lit(slice_width)))

    # within a slice: each touch sends -1 to the image before it and +1 to its own
    in_slice = W.partitionBy("path", epoch, "__slice").orderBy(seq, "sub")
    image = lambda m, s, is_last, keep: F.struct(F.lit(m).alias("m"), s.alias("s"), is_last.alias("last"), keep.alias("p"))
    no = F.lit(None).cast(dict(touches.select("__payload").dtypes)["__payload"])
    before, last = F.lag(F.struct(F.col(seq).alias("s"), F.col("writes").alias("w"))).over(in_slice), F.lead(F.lit(1)).over(in_slice).isNull()
    seen = sliced.withColumns({"__before": before, "__last": last})
    signed = F.array(
        F.when(F.col("writes"), image(1, F.col(seq), F.col("__last"), F.col("__payload"))).otherwise(F.when(F.col("__last"), image(0, F.col(seq), F.lit(True), no))),
        F.when(F.col("__before.w"), image(-1, F.col("__before.s"), F.lit(False), no)),
    )
    parts = seen.select("path", epoch, "__slice", F.explode(F.filter(signed, lambda x: x.isNotNull())).alias("__i"))
    net = parts.groupBy("path", epoch, "__slice", F.col("__i.s").alias("__s")).agg(F.sum("__i.m").alias("__m"), F.max("__i.last").alias("__last"), F.max("__i.p").alias("__p"))
    # what is left of a slice: its last touch, as an image (+1) or as a bare removal (0)
    rest = net.where("__m > 0 or __last")

    # across slices: a slice sends -1 to the image that the slice before it left
    across = W.partitionBy("path").orderBy(F.col(epoch).asc_nulls_first(), F.col("__slice").asc_nulls_first())
    left = F.lag(F.struct(F.col(epoch).alias("e"), F.col("__s").alias("s"), F.col("__m").alias("m"))).over(across)
    carried = rest.withColumn("__left", left)
    signed = F.array(
        F.when(F.col("__m") > 0, F.struct(F.lit(1).alias("m"), F.col(epoch).alias("e"), F.col("__s").alias("s"), F.col("__p").alias("p"))),
        F.when(F.col("__left.m") > 0, F.struct(F.lit(-1).alias("m"), F.col("__left.e").alias("e"), F.col("__left.s").alias("s"), no.alias("p"))),
    )
    parts = carried.select("path", F.explode(F.filter(signed, lambda x: x.isNotNull())).alias("__i"))
    total = parts.groupBy("path", F.col("__i.e").alias(epoch), F.col("__i.s").alias(seq)).agg(F.sum("__i.m").alias("__m"), F.max("__i.p").alias("__p"))
    return total.where("__m > 0").select("path", epoch, seq, *[F.col(f"__p.{c}").alias(c) for c in payload])
