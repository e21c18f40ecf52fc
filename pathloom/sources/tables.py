"""The test tables as the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.snapshots import live_files
from pathloom.session import table

#: A day after the last event of the test tables.
NOW = 1_772_323_200


def files(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot of file_meta: each path's row with the highest file id, with its texts; null sizes and times as 0."""
    meta = table(spark, d, "file_meta")
    last = meta.agg(F.max("snapshot_id").alias("s"))
    rows = live_files(meta).where(F.col("snapshot_id") == last.scalar())
    best = rows.groupBy("path_offset").agg(F.max(F.struct("file_id", "name_offset", "size", "mtime", "dev", "ino", "is_dir")).alias("r")).select("path_offset", "r.*")
    paths = table(spark, d, "arena_paths").select("path_offset", "path")
    names = table(spark, d, "arena_names").select("name_offset", "name")
    joined = best.join(paths, "path_offset").join(names, "name_offset")
    return joined.select("file_id", "path", "name", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mtime", F.lit(0)).alias("mtime"), "dev", "ino", "is_dir")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Files made of the part table: deep paths, some below build and dependency directories."""
    p = table(spark, d, "part")
    mid = F.when(F.col("p_partkey") % 10 == 3, "/target").when(F.col("p_partkey") % 10 == 7, "/node_modules").otherwise("")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".rs"))
    path = F.concat(F.lit("/Projects/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), F.col("p_type"), mid, F.lit("/"), name)
    return p.select(F.col("p_partkey").alias("file_id"), path.alias("path"), name.alias("name"), F.col("p_size").cast("bigint").alias("size"), (F.lit(1_700_000_000) + F.col("p_partkey") * 60).alias("mtime"), F.lit(1).cast("bigint").alias("dev"), F.col("p_partkey").alias("ino"), F.lit(False).alias("is_dir"))


def usage_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as uses of parts: the user and a number in the properties choose the part."""
    n = table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    key = F.pmod(F.col("user_id") * 37 + k, n.scalar())
    action = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "open", "click", "copy", "purchase", "reveal", "signup", "enter", "error", "print")]), F.col("event_type"))
    ev = table(spark, d, "events").select(key.alias("part"), F.col("event_type").alias("query"), action.alias("action"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"))
    paths = parts(spark, d).select(F.col("file_id").alias("part"), "path")
    return ev.join(paths, "part").select("path", "query", "action", "ts", "seq")


def _text_path() -> Column:
    return F.concat(F.lit("/docs/"), F.coalesce(F.trim(F.split("source", "/")[0]), F.lit("none")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as text files."""
    return table(spark, d, "documents").where("text is not null").select(_text_path().alias("path"), "text")


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """The text files' paths with size in bytes and time of creation, 0 where it isn't known."""
    made = F.unix_timestamp(F.col("created_at").cast("timestamp"))
    doc = table(spark, d, "documents").where("text is not null").select(_text_path().alias("path"), F.octet_length("text").cast("bigint").alias("size"), F.coalesce(made, F.lit(0)).cast("bigint").alias("mtime"))
    return doc


def updates(spark: SparkSession, d: str) -> DataFrame:
    """index_updates as prepared updates in one sequence: each update's last delivery."""
    raw = table(spark, d, "index_updates").where("kind is not null")
    last = raw.groupBy("journal_epoch", "seq").agg(F.max(F.struct("arrived_at", "kind", "path", "from_path", "name", "size", "mtime", "dev", "ino")).alias("r")).select("journal_epoch", "seq", "r.*")
    seq = F.col("journal_epoch").cast("bigint") * (1 << 40) + F.col("seq")
    return last.select(seq.alias("seq"), "kind", "path", "from_path", "name", "size", "mtime", "dev", "ino", F.lit(False).alias("is_dir"), F.col("path").isNotNull().alias("present"))
