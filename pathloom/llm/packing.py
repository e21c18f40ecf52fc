"""Fixed-capacity containers filled by the sum-of-squares rule.

An item goes where it makes the sum of N(g)^2 smallest, N(g) being the number of open containers with
exactly g units free; a new container is one of the places, and a container without free units is closed
and counts no more. Ties go to the fullest container. Items are placed largest first.

The rule is sequential, so items are dealt at random (by a hash of their key and place) into lots of about
``lot`` items that are filled independently, a task for each lot and capacity; only keys and sizes travel.
What a lot leaves open is a handful of containers among hundreds, measured in the README.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.session import durable

#: Items per independently filled lot.
LOT = 16_384
#: Most tasks of the filling; more lots than these share tasks evenly.
MOST_TASKS = 20_000


def sum_of_squares_fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, items in the order given; every size is in 1..capacity."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by free units; index 0 stays 0
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for k, s in enumerate(sizes.tolist()):
        # change of the sum when the item goes into a container with g free units, for g = s..capacity - 1
        change = count[: capacity - s] - count[s:capacity]
        change *= 2
        change += 2
        if capacity > s:
            change[0] = 1 - 2 * count[s]  # it fills up and is closed
            change[count[s:capacity] == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())  # the first of equals has the least room
            fresh = 2 * int(count[capacity - s]) + 1
            if change[best] <= fresh and count[s + best]:
                g = s + best
                bin_, rest = open_at[g].pop(), best
                count[g] -= 1
                out[k] = bin_
                if rest:
                    count[rest] += 1
                    open_at[rest].append(bin_)
                continue
        out[k] = made
        if capacity > s:
            count[capacity - s] += 1
            open_at[capacity - s].append(made)
        made += 1
    return out


def pack(
    items: DataFrame, capacities: DataFrame, *, key: str, size: str, pack_key: str, capacity: str, lot: int = LOT
) -> DataFrame:
    """``(pack_key, container, key, piece, first, size)``: for each capacity, every item in its container.

    ``container`` is unique within its ``pack_key``. An item above the capacity is split into pieces that
    fill a container each and a last piece that is placed like any item; ``piece`` numbers them and
    ``first`` is the piece's first unit. No other item is split. Items of null or no size, such as empty
    texts, take no room: they come out with a null container and size 0. Null keys and null or
    non-positive capacities are left out; repeated keys are placed each on their own.
    """
    caps = capacities.where(F.col(capacity) > 0).where(F.col(pack_key).isNotNull()).select(F.col(pack_key).alias("p"), F.col(capacity).cast("bigint").alias("cap")).distinct()
    slim = items.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("n")).where("k is not null")
    key_kind, pack_kind = dict(items.dtypes)[key], dict(capacities.dtypes)[pack_key]
    # sizes are measured once and kept; rows that are read back keep their numbers, so that even rows of one key part ways
    kept = durable(slim)
    lots, ways = max(1, -(-kept.count() // lot)), caps.count()
    dealt = kept.withColumn("lot", F.pmod(F.xxhash64("k", F.monotonically_increasing_id()), F.lit(lots)))
    schema = f"{pack_key} {pack_kind}, container bigint, {key} {key_kind}, piece int, first bigint, size bigint"
    # one task for each lot and capacity: a row that moves is a key, a size and four numbers, too little for partitions by bytes
    listed = caps.agg(F.array_sort(F.collect_list(F.struct("p", "cap"))).alias("c")).scalar()
    each = dealt.select("lot", "k", "n", F.posexplode(listed).alias("way", "c")).withColumn("slot", F.col("lot") * ways + F.col("way"))
    each = each.repartitionById(max(1, min(lots * ways, MOST_TASKS)), F.col("slot").cast("int"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        cap, pack_id, lot_no = int(frame["cap"].iloc[0]), frame["p"].iloc[0], int(frame["lot"].iloc[0])
        frame = frame.sort_values(["n", "k"], kind="stable")
        keys, n = frame["k"].to_numpy(), frame["n"].to_numpy()
        full, rest = n // cap, n % cap
        whole = np.repeat(np.arange(len(n)), full)  # pieces that fill a container each
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        part = np.flatnonzero(rest > 0)
        part = part[np.argsort(-rest[part], kind="stable")]
        bins = sum_of_squares_fill(rest[part], cap)
        none = np.flatnonzero(n == 0)
        who = np.concatenate([whole, part, none])
        piece = np.concatenate([nth, full[part], np.zeros(len(none), np.int64)])
        own = np.concatenate([np.arange(len(whole)), len(whole) + bins])
        # containers of different lots interleave, so their numbers never meet
        number = pd.array(np.concatenate([own * lots + lot_no, np.zeros(len(none), np.int64)]), dtype="Int64")
        number[len(own) :] = pd.NA
        return pd.DataFrame(
            {pack_key: pack_id, "container": number, key: keys[who], "piece": piece.astype(np.int32), "first": piece * cap, "size": np.concatenate([np.full(len(whole), cap), rest[part], np.zeros(len(none), np.int64)]).astype(np.int64)}
        )

    return each.select(F.col("slot").cast("int").alias("slot"), "lot", "k", "n", "c.p", "c.cap").groupBy("slot").applyInPandas(fill, schema)
