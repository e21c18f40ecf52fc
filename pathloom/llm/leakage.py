"""Held-out passages inside a corpus: window minima of MinHash values as candidates, then exact words.

A word is an unbroken run of letters and digits, its case folded. What is searched for is containment of
a stretch of ``run`` words, the smallest thing that counts as a leak. A passage of forty words has next
to no Jaccard similarity with a document of twenty thousand, and the bands that MinHash would need for
it grow with the larger set; signatures of whole items or of windows of their size miss leaks of a part
(figures in the README). So sizes are levelled first. Documents fall into size classes: those
shorter than ``run`` words can contain nothing and drop out; those of up to ``PART`` words are sketched
as they are; longer ones are cut into parts that overlap by ``run`` - 1 words. Within a part every stretch
of ``run`` words is a set of five-word shingles of exactly the query's size, with the least of their hashes for a
signature. That is MinHash with one permutation over windows, also known as winnowing. Equal stretches
have equal minima for certain, so the search misses nothing; neighbouring stretches mostly share theirs, so a text
keeps about a quarter as many as it has words, in proportion to its size.

Candidates are verified on exact shingles: beside the minimum, a 64-bit hash of all ``run`` words must be equal. The
words themselves are not compared: that would send or read the texts once more, against a chance below one in a
thousand of any false match in 10^9 documents for 400 items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.session import BROADCAST_BYTES, BROADCAST_ROWS, durable, is_small

#: Words per shingle of a MinHash set.
SHINGLE = 5
#: Words of a document sketched at once.
PART = 1 << 16
#: Slices of a join that is too large for a broadcast, so that a phrase of a third of all texts isn't one task's work.
SLICES = 32
_WORD = re.compile(r"[^\W_]+")
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Hashes of words seen by this worker, emptied before it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.casefold())
        return h


_words = _Words()


def word_hashes(text: str) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, _WORD.findall(text)), dtype=np.uint64)


def _rolled(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of every ``width`` consecutive words, all bits well mixed."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
        for k in range(width):
            out = out * base + h[k : k + len(out)]
        out ^= out >> np.uint64(31)
        out *= _B2
        return out ^ (out >> np.uint64(29))


def sketch(h: np.ndarray, run: int, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(MinHash, exact hash) of every stretch of ``run`` words, in order."""
    if len(h) < run:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    small, exact = _rolled(h, shingle, _B1), _rolled(h, run, _B1)
    least = small[: len(exact)].copy()
    for k in range(1, run - shingle + 1):
        np.minimum(least, small[k : k + len(exact)], out=least)
    return least, exact


def sketches(df: DataFrame, key: str, text: str, *, run: int, shingle: int = SHINGLE) -> DataFrame:
    """``(key, minhash, stretches array<bigint>)``: each MinHash once for every place where it holds, with the exact hashes it stands for.

    Texts that are null or shorter than ``run`` words give no rows.
    """
    kind = dict(df.dtypes)[key]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows, mins, runs, lengths = [], [], [], []
            held = 0
            for row, t in enumerate(texts):
                h = word_hashes(t.as_py())
                for at in range(0, max(1, len(h) - run + 1), PART - run + 1):
                    least, exact = sketch(h[at : at + PART], run, shingle)
                    if not len(least):
                        continue
                    edges = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                    rows.append(np.full(len(edges), row))
                    mins.append(least[edges])
                    runs.append(exact)
                    lengths.append(np.diff(np.append(edges, len(exact))))
                    held += len(exact)
                if held > 500_000:
                    yield _sketched(keys, rows, mins, runs, lengths)
                    rows, mins, runs, lengths, held = [], [], [], [], 0
            if rows:
                yield _sketched(keys, rows, mins, runs, lengths)

    slim = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return slim.mapInArrow(parts, f"key {kind}, minhash bigint, stretches array<bigint>")


def _sketched(keys: pa.Array, rows: list, mins: list, runs: list, lengths: list) -> pa.RecordBatch:
    """The parts of several texts as one batch; the lists of exact hashes are cut by offsets, not copied one by one."""
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(runs).view(np.int64)))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(mins).view(np.int64)), lists], ["key", "minhash", "stretches"])


def _met(rows: DataFrame, other: DataFrame, key: str, by: Column, how: str, small: bool) -> DataFrame:
    """``rows`` joined to the smaller ``other`` by ``key``: broadcast if small, else sliced by ``by`` with the other side repeated in each slice."""
    if small:
        return rows.join(F.broadcast(other), key, how)
    sliced = rows.withColumn("__slice", F.pmod(F.xxhash64(by), F.lit(SLICES)).cast("int"))
    repeated = other.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return sliced.join(repeated, [key, "__slice"], how).drop("__slice")


def leaks(
    docs: DataFrame, items: DataFrame, *, doc_key: str, doc_text: str, item_key: str, item_text: str, run: int, min_share: float = 0.0, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``(doc_key, item_key, shared, stretches)``: distinct stretches of the item that are in the document, and that it has.

    A pair appears if at least one stretch and at least ``min_share`` of the item's stretches are shared.
    Null, empty and short texts leak nothing; repeated texts leak each on their own; other columns are
    ignored. Items beyond ``broadcast_rows`` stretches or ``broadcast_bytes`` are met by sliced shuffles, with equal results.
    """
    # items are sketched once and kept
    held = durable(sketches(items, item_key, item_text, run=run)).withColumnRenamed("key", item_key)
    passages = held.select(item_key, F.explode("stretches").alias("stretch")).distinct()
    sizes = passages.groupBy(item_key).agg(F.count(F.lit(1)).alias("stretches"))
    small = is_small(passages, broadcast_rows, broadcast_bytes)
    corpus = sketches(docs, doc_key, doc_text, run=run).withColumnRenamed("key", doc_key)
    # candidates: places of a document whose MinHash some item has; a semi-join, so a common phrase forms no pairs
    near = _met(corpus, held.select("minhash").distinct(), "minhash", F.col(doc_key), "left_semi", small)
    places = near.select(doc_key, F.explode("stretches").alias("stretch"))
    # exact shingles decide; only real matches are joined to their items
    exact = _met(places, passages, "stretch", F.col(doc_key), "inner", small)
    shared = exact.groupBy(doc_key, item_key).agg(F.count_distinct("stretch").alias("shared"))
    both = _met(shared, sizes, item_key, F.col(doc_key), "inner", small)
    return both.where(F.col("shared") >= F.greatest(F.lit(1), F.ceil(F.col("stretches") * F.lit(min_share)))).select(doc_key, item_key, "shared", "stretches")
