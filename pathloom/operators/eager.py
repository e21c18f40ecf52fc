"""Per-key results over a join without joining rows: eager aggregation.

Both inputs shrink to one compact state per key before they meet, partially on the map side, so a
key with a third of all rows reaches the shuffle as one state per map task. The states join one to
one; counts multiply and sums scale by the other side's count, which gives exactly what aggregating
the joined rows would give, and a roll-up to coarser dimensions only adds states.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.skew import hot_keys, replicate, spread

_BIG = "decimal(38,0)"


@dataclass(frozen=True)
class Side:
    """What one input contributes: a row count, sums, and the first row in an order, per key and ``by``.

    ``sums`` maps an alias to an integer column or expression (nulls count as nothing). ``best`` maps an
    alias to an orderable struct column; the greatest is kept and nulls are ignored, so ties are decided
    by the struct's later fields.
    """

    df: DataFrame
    key: str
    by: Sequence[str] = ()
    count: str = "n"
    sums: Mapping[str, Column] = field(default_factory=dict)
    best: Mapping[str, Column] = field(default_factory=dict)

    def states(self) -> DataFrame:
        """One row per non-null key and value of ``by``. An empty input gives no rows."""
        aggs = [F.count(F.lit(1)).alias(self.count)]
        aggs += [F.coalesce(F.sum(c.cast(_BIG)), F.lit(0)).cast(_BIG).alias(a) for a, c in self.sums.items()]
        aggs += [F.max(c).alias(a) for a, c in self.best.items()]
        return self.df.where(F.col(self.key).isNotNull()).groupBy(self.key, *self.by).agg(*aggs)


def join_states(left: Side, right: Side, *, bridge: DataFrame | None = None, pairs: str = "pairs") -> DataFrame:
    """Join both sides' states by key and combine them algebraically.

    ``bridge`` relates the keys where they differ: it has the columns ``left.key`` and ``right.key``.
    Result: the keys, the dimensions ``by``, both counts, ``pairs`` (the number of joined rows), every sum multiplied
    by the other side's count, and the ``best`` structs. Keys without a partner do not appear. Products are
    decimal(38,0). Column names of the two sides must differ; extra input columns are ignored. Only the right side
    may have ``by``: a key can then have many states there, and those of hot keys are spread over slices that
    each meet a copy of the left side's one state.
    """
    if left.by:
        raise ValueError("only the right side may have dimensions")
    ls, rs = left.states(), right.states()
    if bridge is not None:
        ls = ls.join(bridge.select(left.key, right.key).where(F.col(right.key).isNotNull()), left.key)
    elif left.key != right.key:
        ls = ls.withColumn(right.key, F.col(left.key))
    on = right.key
    if right.by:
        hot = hot_keys(rs, on)
        joined = replicate(ls, hot, on).join(spread(rs, hot, on, F.struct(*right.by)), [on, "__salt"]).drop("__salt")
    else:
        joined = ls.join(rs, on)
    scaled = {a: (F.col(a) * F.col(right.count)).cast(_BIG) for a in left.sums}
    scaled |= {a: (F.col(a) * F.col(left.count)).cast(_BIG) for a in right.sums}
    return joined.withColumns({pairs: (F.col(left.count).cast("decimal(20,0)") * F.col(right.count)).cast(_BIG), **scaled})


def roll_up(states: DataFrame, by: Sequence[str | Column], sums: Sequence[str]) -> DataFrame:
    """Add combined states up to coarser dimensions; a null dimension is a group of its own."""
    return states.groupBy(*by).agg(*[F.sum(c).cast(_BIG).alias(c) for c in sums])
