import random
import re

import numpy as np
import pytest

import pathloom.llm.leakage as module
from pathloom.llm.leakage import leaks, sketch, word_hashes

DOCS, ITEMS = "doc_id bigint, text string, key string, minhash int", "item_id bigint, passage string, stretch string, words int"


def grams(text, run):
    w = re.findall(r"[^\W_]+", (text or "").casefold())
    return {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}


def brute(docs, items, run):
    return {(d, i, len(grams(t, run) & grams(p, run)), len(grams(p, run))) for d, t in docs for i, p in items if d is not None and i is not None and grams(t, run) & grams(p, run)}


def found(spark, docs, items, run, **options):
    ddf = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    idf = spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS)
    return [tuple(r) for r in leaks(ddf, idf, doc_key="doc_id", doc_text="text", item_key="item_id", item_text="passage", run=run, **options).collect()]


def made(seed, vocabulary=6):
    random.seed(seed)
    word = lambda: random.choice([f"w{k}" for k in range(vocabulary)])
    text = lambda n: "".join(word() + random.choice([" ", "  ", "_", ",\n", "-"]) for _ in range(n))
    docs = [(k, text(random.choice([3, 30, 200]))) for k in range(60)] + [(None, text(50)), (100, None), (101, ""), (102, "one")]
    items = [(k, text(random.choice([3, 8, 20, 40]))) for k in range(20)] + [(None, "x"), (50, None), (51, "")]
    for k in range(15):  # planted: a stretch of an item, in other case, inside a document
        w = re.findall(r"[^\W_]+", items[k][1])
        docs.append((200 + k, text(9) + " ".join(w[2:16]).upper() + " " + text(9)))
    return docs, items


@pytest.mark.parametrize("seed,run,part", [(1, 12, 1 << 16), (2, 8, 50), (3, 12, 13)])
def test_equals_brute_force(spark, monkeypatch, seed, run, part):
    monkeypatch.setattr(module, "PART", part)
    docs, items = made(seed)
    got = found(spark, docs, items, run)
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, run)


def test_minimum_share_and_sliced_join(spark):
    docs, items = made(4)
    want = {x for x in brute(docs, items, 12) if x[2] >= 0.5 * x[3]}
    assert set(found(spark, docs, items, 12, min_share=0.5, broadcast_rows=3)) == want  # as if the items were too many
    assert set(found(spark, docs, items, 12, min_share=0.5, broadcast_bytes=10)) == want


def test_a_phrase_of_most_texts_is_spread(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.col("id").alias("doc"), F.lit(7).alias("k"))
    other = spark.createDataFrame([(7, "x"), (8, "y")], "k int, v string")
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        met = module._met(rows, other, "k", F.col("doc"), "inner", False)
        assert met.columns == ["k", "doc", "v"] and met.count() == 3000
        tasks = met.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 1
    finally:
        for k in options:
            spark.conf.unset(k)


def test_common_phrase_and_copies(spark):
    phrase = " ".join(f"a{k}" for k in range(11))  # one word short of a leak
    docs = [(k, phrase + f" d{k}") for k in range(40)] + [(90, phrase + " i1 tail"), (91, phrase + " i1 tail")]
    items = [(k, phrase + f" i{k}") for k in range(10)]
    assert sorted(x[:2] for x in found(spark, docs, items, 12)) == [(90, 1), (91, 1)]


def test_empty(spark):
    assert found(spark, [], [(1, "a " * 20)], 12) == [] == found(spark, [(1, "a " * 20)], [], 12)


def test_long_text_and_sketch():
    h = word_hashes("word" + " Straße STRASSE x_y" * 50_000)
    assert len(h) == 1 + 4 * 50_000 and h[1] == h[2]
    least, exact = sketch(h[:40], 12)
    assert len(least) == len(exact) == 29
    assert len(sketch(h[:5], 12)[0]) == 0
    random.seed(0)
    h = np.array([random.getrandbits(64) for _ in range(5000)], dtype=np.uint64)
    least, _ = sketch(h, 12)
    assert (np.count_nonzero(least[1:] != least[:-1]) + 1) / 5000 < 0.27
    again, _ = sketch(h[100:112], 12)
    assert again[0] == least[100]
