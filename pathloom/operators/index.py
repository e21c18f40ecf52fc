"""The searchable table: derived columns, the trigram index and its figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.paths import basename, depth, excluded, extension
from pathloom.functions.ranking import context_score, with_abbreviation_columns


def build(files: DataFrame, exclusions: Sequence[str] = ()) -> DataFrame:
    """``files`` with the columns that searches need; rows without a name, and excluded ones, are left out.

    Lower-case columns are stored because ``lower()`` over a column keeps a predicate from reaching parquet.
    """
    kept = files.where("name <> '' and path is not null")
    if exclusions:
        kept = kept.where(~excluded(F.col("path"), exclusions))
    lowered = with_abbreviation_columns(kept).withColumns({"name_lc": F.lower("name"), "depth": depth(F.col("path")), "ext": extension(basename(F.col("path")))})
    return lowered.withColumn("context", context_score(F.col("path_lc")))


def trigrams(text: Column) -> Column:
    """Every three bytes in a row of the lower-case text as one integer each; empty under three bytes, null for null."""
    digits = F.hex(F.encode(F.lower(text), "utf-8"))
    windows = F.transform(F.sequence(F.lit(1), F.length(digits) - 5, F.lit(2)), lambda i: F.conv(F.substring(digits, i, 6), 16, 10).cast("int"))
    return F.when(F.length(digits) >= 6, windows).otherwise(F.when(text.isNotNull(), F.array().cast("array<int>")))


def trigrams_of(text: str) -> list[int]:
    raw = text.lower().encode()
    return [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]


def grams(files: DataFrame) -> DataFrame:
    """``(trigram, file_id)``, once each: the index as rows, which shuffles on and any posting list size fits."""
    return files.where("name <> ''").select(F.explode(F.array_distinct(trigrams(F.col("name")))).alias("trigram"), "file_id")


def postings(files: DataFrame) -> DataFrame:
    """``(trigram, file_ids)``, ids ascending. For tables where one list fits a row; :func:`grams` has no such limit."""
    return grams(files).groupBy("trigram").agg(F.array_sort(F.collect_set("file_id")).alias("file_ids"))


def candidates(index: DataFrame, term: str, cap: int | None = None) -> DataFrame:
    """``(file_id)`` of names with every trigram of the term (of at least three bytes), the lowest ids first if capped."""
    wanted = sorted(set(trigrams_of(term)))
    if not wanted:
        raise ValueError("a term of fewer than three bytes has no trigram")
    hits = index.where(F.col("trigram").isin(wanted)).groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("file_id")
    return hits.orderBy("file_id").limit(cap) if cap else hits


def has_trigrams(name_lc: Column, term: str) -> Column:
    """The same test without an index, by substrings of the stored name."""
    raw = term.lower()
    if raw.isascii():
        out = F.lit(True)
        for k in range(len(raw) - 2):
            out = out & name_lc.contains(raw[k : k + 3])
        return out
    return F.size(F.array_except(F.array(*[F.lit(t) for t in trigrams_of(raw)]), trigrams(name_lc))) == 0


def status(files: DataFrame) -> DataFrame:
    """One row: counts, bytes of names and paths, bytes per file (whole), and the newest modification time."""
    size = F.sum(F.octet_length("path") + F.octet_length("name"))
    sized = files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if("is_dir").alias("dirs"), F.coalesce(size, F.lit(0)).alias("arena_bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.max("mtime").alias("newest")
    )
    per = lambda c: F.when(F.col("files") > 0, F.floor(F.col(c) / F.col("files"))).otherwise(0)
    return sized.withColumns({"arena_bytes_per_file": per("arena_bytes"), "bytes_per_file": per("total_bytes")})


def trigram_count(files: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct trigrams of all names."""
    return grams(files).agg((F.approx_count_distinct("trigram", 0.01) if approximate else F.count_distinct("trigram")).alias("trigrams"))


def index_sizes(files: DataFrame) -> DataFrame:
    """One row: bytes of names and paths, bytes of postings (four a trigram and file, four a distinct trigram), and postings per byte of text, six places."""
    arena = files.agg(F.coalesce(F.sum(F.octet_length("path") + F.octet_length("name")), F.lit(0)).alias("arena_bytes"))
    each = grams(files).groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))
    held = each.agg((F.coalesce(F.sum("n"), F.lit(0)) * 4 + F.count(F.lit(1)) * 4).alias("index_bytes"))
    a = F.col("arena_bytes")
    return held.withColumn("arena_bytes", arena.scalar()).select("arena_bytes", "index_bytes", F.when(a > 0, F.round(F.col("index_bytes") / a, 6)).otherwise(0.0).alias("index_ratio"))
