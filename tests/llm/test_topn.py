import math
import random

import pytest
from pyspark.sql import functions as F

from pathloom.llm.topn import top_n_per_group

HITS = "query_id bigint, hit_id bigint, score float, mtime bigint, path string, g int, i int, s int, salt int, band int, r string, n int"
EXTRA = (0, 0, 0, 0, 0, "r", 0)


def brute(hits, limits):
    best = {}
    for q, h, s, m, p in hits:
        if None in (q, h, s) or math.isnan(s):
            continue
        key = (s, m is not None, m or 0, p is not None, p or "")
        if (q, h) not in best or key > best[(q, h)][0]:
            best[(q, h)] = (key, (-s, m is None, -(m or 0), p is None, (p or "").encode(), h))
    n = {}
    for q, k in limits:
        if k is not None and q is not None:
            n[q] = max(k, n.get(q, 0))
    out = set()
    for q, k in n.items():
        ranked = sorted((o, h) for (g, h), (_, o) in best.items() if g == q)
        out |= {(q, h) for _, h in ranked[: max(k, 0)]}
    return out


def make(seed, n=900):
    random.seed(seed)
    hits = []
    for k in range(n):
        q = random.choice([1, 1, 1, 2, 3, 4, 5, None, 77])
        hits.append((q, random.choice([k, k, k, None]), random.choice([0.5, 0.3, 0.3, 1.0, 0.92, None, float("nan"), -1.0, 0.0]), random.choice([None, 1, 2, 3]), random.choice(["/a", "/Z", "/é", "/", None])))
    hits += random.sample(hits, 60)
    limits = [(1, 40), (1, 40), (2, 3), (3, 0), (4, 10_000), (5, None), (6, 5), (None, 3)]
    return hits, limits


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("options", [{}, {"bands": 2, "salts": 3}, {"rank_at_once": 5}, {"bands": 200, "rank_at_once": 0}])
def test_equals_brute_force(spark, seed, options):
    hits, limits = make(seed)
    df = spark.createDataFrame([(*h, *EXTRA) for h in hits], HITS)
    asked = spark.createDataFrame([(*x, "e", 1.0) for x in limits], "query_id bigint, result_limit int, g string, s double")
    got = top_n_per_group(df, asked, group="query_id", item="hit_id", score="score", limit="result_limit", ties={"mtime": "desc", "path": "asc"}, **options)
    assert got.columns == ["query_id", "hit_id", "score", "mtime", "path"]
    rows = [(r.query_id, r.hit_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(hits, limits)


def test_empty(spark):
    df = spark.createDataFrame([], HITS)
    asked = spark.createDataFrame([(1, 5)], "query_id bigint, result_limit int")
    top = lambda a, b: top_n_per_group(a, b, group="query_id", item="hit_id", score="score", limit="result_limit", ties={"path": "asc"})
    assert top(df, asked).count() == 0
    hits = spark.createDataFrame([(1, 1, 0.5, 1, "/a", *EXTRA)], HITS)
    assert top(hits, asked.where("false")).count() == 0
    assert top(hits.withColumn("path", F.lit("x" * 200_000)), asked).count() == 1
