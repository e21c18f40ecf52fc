"""Result lists in groups, and listings of directories and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pathloom.functions.paths import parent


def group_runs(results: DataFrame, label: Column) -> DataFrame:
    """Add ``label``, ``header`` (the label differs from the row before) and ``run`` (its number); labels may come again.

    For a ranked, limited list: its rows meet in one task.
    """
    by = W.orderBy("rank")
    marked = results.withColumn("label", label).withColumn("header", ~F.coalesce(F.lag("label").over(by).eqNullSafe(F.col("label")), F.lit(False)) | F.lag("rank").over(by).isNull())
    return marked.withColumn("run", F.sum(F.col("header").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))


def directory_listing(files: DataFrame, directory: str, limit: int = 200) -> DataFrame:
    """``(entry)`` of a directory, directories with a slash, by name, at most ``limit``."""
    inside = files.where(parent(F.col("path")) == (directory.rstrip("/") or "/"))
    return inside.select(F.concat("name", F.when(F.col("is_dir"), "/").otherwise("")).alias("entry")).distinct().orderBy("entry").limit(limit)


def file_preview(lines: DataFrame, path: str, max_lines: int = 4_000) -> DataFrame:
    """The first printable lines of a file."""
    from pathloom.functions.display import printable

    return lines.where((F.col("path") == path) & (F.col("line_number") <= max_lines)).select("line_number", printable(F.col("line")).alias("line")).orderBy("line_number")


def is_binary(text: Column, window: int = 256 * 1024) -> Column:
    """A NUL within the previewed part."""
    return F.contains(F.substring(text, 1, window), F.lit("\0"))


def complete_scope(files: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Directories whose path begins with a prefix in any case, in order."""
    return files.where(F.col("is_dir") & F.startswith(F.lower("path"), F.lit(prefix.lower()))).select("path").distinct().orderBy("path").limit(limit)


def largest(files: DataFrame, limit: int) -> DataFrame:
    return files.select("path", "size").orderBy(F.desc("size"), "path").limit(limit)
