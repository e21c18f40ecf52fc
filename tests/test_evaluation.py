"""Evaluation of rankings."""

from pyspark.sql import functions as F

from pathloom.operators import evaluation


def test_noise_before_a_relevant_hit_past_the_first_hundred(spark):
    rows = [(1, f"/a/{'build' if k % 10 == 0 else 'src'}/{k}", k, k == 250) for k in range(1, 400)] + [(2, "/build/x", 1, False), (3, "/build/y", 1, False), (3, "/build/z", 2, False), (3, "/build/y", 3, True)]
    hits = spark.createDataFrame(rows, "query int, path string, at int, relevant boolean")
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "query int")
    got = {r.query: (r.first, r.noise) for r in evaluation.noise_before_relevant(hits, asked).collect()}
    assert got == {1: (250, 24), 2: (None, 0), 3: (1, 0), 4: (None, 0)}
    ranked = hits.select("query", "path", F.col("at").alias("rank"))
    same = evaluation.first_relevant(ranked, hits.where(F.col("relevant")), asked)
    assert {r.query: (r.first, r.noise) for r in same.collect()} == got
