"""Hot keys, snapshots and the change feed against plain Python, with awkward inputs."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pathloom.operators.changefeed import apply_changes
from pathloom.operators.eager import Side, join_states, roll_up
from pathloom.operators.skew import hot_keys, replicate, spread
from pathloom.operators.snapshots import row_hash, snapshot_changes

META = "snapshot_id int, path_offset bigint, path_len int, file_id bigint, size bigint, mtime bigint, ino bigint, after boolean, pair string"


def changes_of(df):
    return {tuple(r) for r in snapshot_changes(df, snapshot="snapshot_id", key="path_offset", version="file_id", compare=["size", "mtime", "ino"], live=~F.col("path_len").eqNullSafe(0)).collect()}


def test_snapshot_changes(spark):
    rows = [
        (2, 1, 5, 0, 10, 1, 1), (2, 2, 5, 1, 10, None, 1), (2, 3, 5, 2, 10, 1, 1), (2, 4, 5, 3, 1, 1, 1), (2, 4, 5, 4, 2, 1, 1), (2, 9, 0, 5, 1, 1, 1),
        (5, 1, 5, 0, 10, 1, 1), (5, 2, 5, 1, None, 10, 1), (5, 4, 5, 9, 2, 1, 1), (5, 5, 5, 7, 1, 1, 1), (5, 5, 5, 7, 1, 1, 1), (5, 9, 5, 8, 1, 1, 1), (5, None, 5, 8, 1, 1, 1),
        (7, 9, 0, 0, 1, 1, 1), (None, 1, 5, 0, 1, 1, 1),
    ]
    df = spark.createDataFrame([(*r, True, "x") for r in rows], META)
    assert changes_of(df) == {(5, 2, "changed"), (5, 3, "removed"), (5, 5, "added"), (5, 9, "added"), (7, 1, "removed"), (7, 2, "removed"), (7, 4, "removed"), (7, 5, "removed"), (7, 9, "removed")}
    assert changes_of(df.where("false")) == set()
    assert changes_of(df.where("snapshot_id = 2")) == set()


def test_snapshot_changes_by_join(spark, monkeypatch):
    import pathloom.operators.snapshots as module

    random.seed(1)
    rows = [(s, random.randrange(30), random.choice([0, 4, 4]), k, random.choice([None, 1, 2]), 1, 1, True, "x") for s in (1, 4, 9) for k in range(40)]
    df = spark.createDataFrame(rows, META)
    want = changes_of(df)
    monkeypatch.setattr(module, "LITERAL_SNAPSHOTS", 1)
    assert changes_of(df) == want and want


def test_row_hash_tells_nulls_apart(spark):
    df = spark.createDataFrame([(None, 5), (5, None), (None, None), (5, 5)], "a bigint, b bigint").select(row_hash(["a", "b"]).alias("h"))
    assert len({r.h for r in df.collect()}) == 4


def test_eager_join_equals_join(spark):
    random.seed(2)
    left = [(random.choice(["hot", "hot", "a", "b", None]), random.choice([None, 1, 2, 3]), random.randrange(5)) for _ in range(300)]
    right = [(random.choice(["hot", "a", "c", None]), random.choice([None, 7, 8]), k) for k in range(200)]
    ldf = spark.createDataFrame(left, "k string, x bigint, pairs bigint").withColumn("d", F.lit("same"))
    rdf = spark.createDataFrame(right, "k2 string, y bigint, id bigint")
    out = join_states(Side(ldf, "k", count="ln", sums={"sx": F.col("x")}, best={"bx": F.struct("x", "pairs")}), Side(rdf, "k2", count="rn", sums={"sy": F.col("y")}))
    got = {r.k: (r.pairs, r.sx, r.sy) for r in out.collect()}
    want = {}
    for k, x, _ in left:
        for k2, y, _ in right:
            if k is not None and k == k2:
                p, sx, sy = want.get(k, (0, 0, 0))
                want[k] = (p + 1, sx + (x or 0), sy + (y or 0))
    assert got == {k: tuple(map(Decimal, v)) for k, v in want.items()}
    total = roll_up(out, [F.length("k").alias("n")], ["pairs", "sx"]).collect()
    assert sum(r.pairs for r in total) == sum(v[0] for v in want.values())
    assert join_states(Side(ldf.where("false"), "k"), Side(rdf, "k2", count="m")).count() == 0
    by = join_states(Side(ldf, "k", count="ln"), Side(rdf, "k2", by=("y",), count="rn"))
    rolled = {r.y: r.pairs for r in roll_up(by, ["y"], ["pairs"]).collect()}
    assert rolled == {y: Decimal(sum(k == k2 for k, *_ in left for k2, y2, _ in right if k is not None and y2 == y)) for y in (None, 7, 8)}


def test_spread_and_replicate_meet(spark):
    left = spark.createDataFrame([("hot" if k % 2 else f"k{k}", k) for k in range(2000)], "k string, id bigint")
    right = spark.createDataFrame([("hot", 1), ("k10", 2), ("none", 3)], "k string, v int")
    hot = hot_keys(left, "k", 10)
    assert [r.k for r in hot.collect()] == ["hot"]
    a, b = spread(left, hot, "k", F.col("id"), 8), replicate(right, hot, "k", 8)
    assert a.where("k = 'hot'").select("__salt").distinct().count() > 4
    assert a.join(b, ["k", "__salt"]).count() == 1001


UPDATE = "journal_epoch int, seq bigint, arrived_at timestamp, kind string, path string, from_path string, name string, size bigint, e int, m int, s bigint"
T0 = dt.datetime(2025, 1, 1)


def replay(rows, base=()):
    state = dict(base)
    best = {}
    for r in rows:
        k = (r[0], r[1])
        if None not in k and (k not in best or (r[2] or dt.datetime.min) > (best[k][2] or dt.datetime.min)):
            best[k] = r
    for k in sorted(best):
        _, _, _, kind, path, src, *_ = best[k]
        if kind == "Delete" or kind == "Move":
            state.pop(path if kind == "Delete" else src, None)
        if kind in ("CreateOrModify", "Move") and path is not None:
            state[path] = k
    return {(p, *k) for p, k in state.items()}


@pytest.mark.parametrize("seed,width", [(1, 4), (2, 7), (3, 1 << 16), (4, 1)])
def test_apply_changes(spark, seed, width):
    random.seed(seed)
    paths = [*"abcdef", "hot", "hot", "hot", None, ""]
    rows = []
    for k in range(400):
        kind = random.choice(["CreateOrModify", "CreateOrModify", "Delete", "Move", None, "Odd"])
        r = (random.randrange(3), random.randrange(60), T0 + dt.timedelta(seconds=k), kind, random.choice(paths), random.choice(paths), "n", k, 0, 0, 0)
        rows += [r] * random.choice([1, 1, 2])
    rows += [(None, 1, T0, "CreateOrModify", "x", None, "n", 1, 0, 0, 0), (1, None, T0, "CreateOrModify", "x", None, "n", 1, 0, 0, 0), (9, 1, None, "Move", "self", "self", None, None, 0, 0, 0)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, UPDATE)
    got = apply_changes(df, slice_width=width).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == replay(rows)
    sized = apply_changes(df, slice_width=width, payload=["name", "size"])
    assert {(r.path, r.journal_epoch, r.seq) for r in sized.collect()} == replay(rows)


def test_apply_changes_to_base(spark):
    base = spark.createDataFrame([("kept", 1), ("kept", 2), ("gone", 3), ("moved", 4), ("over", 5), (None, 6)], "path string, size bigint")
    rows = [(0, 1, T0, "Delete", "gone", None, None, None, 0, 0, 0), (0, 2, T0, "Move", "target", "moved", "t", 9, 0, 0, 0), (0, 3, T0, "CreateOrModify", "over", None, "o", 8, 0, 0, 0)]
    out = apply_changes(spark.createDataFrame(rows, UPDATE), base=base, payload=["size"])
    assert {tuple(r) for r in out.collect()} == {("kept", None, None, 2), ("target", 0, 2, 9), ("over", 0, 3, 8)}
    assert apply_changes(spark.createDataFrame([], UPDATE)).count() == 0


def test_latest_delivery_of_equal_arrival_is_the_greatest(spark):
    rows = [(0, 1, T0, "CreateOrModify", p, None, "n", 1, 0, 0, 0) for p in ("b", "a", "c")]
    assert [tuple(r) for r in apply_changes(spark.createDataFrame(rows, UPDATE)).collect()] == [("c", 0, 1)]
