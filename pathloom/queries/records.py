"""Queries on hot keys, full snapshots and the change feed (problems 1, 3 and 4)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.changefeed import apply_changes
from pathloom.operators.eager import Side, join_states, roll_up
from pathloom.operators.snapshots import live_files, snapshot_changes
from pathloom.session import table

METADATA = ["name", "size", "mtime", "dev", "ino"]


def counting_rows_of_last(file_meta: DataFrame) -> DataFrame:
    """Of the last snapshot, each path's row with the highest ``file_id``; ties go to the greatest contents."""
    last = file_meta.agg(F.max("snapshot_id").alias("s"))
    rows = live_files(file_meta).where(F.col("snapshot_id") == last.scalar())
    best = rows.groupBy("path_offset").agg(F.max(F.struct("file_id", "name_offset", "mtime", "size")).alias("r"))
    return best.select("path_offset", "r.name_offset", "r.mtime", "r.size")


def _sides(spark: SparkSession, d: str, hits: DataFrame) -> tuple[Side, Side, DataFrame]:
    files = counting_rows_of_last(table(spark, d, "file_meta"))
    newest = F.when(F.col("mtime").isNotNull(), F.struct("mtime", (-F.col("path_offset")).alias("p")))
    top = F.when(F.col("score").isNotNull() & ~F.isnan("score"), F.struct("score", (-F.col("hit_id")).alias("h")))
    names = table(spark, d, "arena_names").select("name_offset", "name")
    left = Side(files, "name_offset", count="files", sums={"file_bytes": F.col("size")}, best={"newest": newest})
    return left, Side(hits, "name", count="hits", sums={"hit_bytes": F.col("size")}, best={"top": top}), names


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_results").select("hit_id", "name", "score", "size")
    left, right, names = _sides(spark, d, hits)
    both = join_states(left, right, bridge=names).where("newest is not null and top is not null")
    return both.select("name_offset", (-F.col("newest.p")).alias("path_offset"), (-F.col("top.h")).alias("hit_id"))


def p1_query_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per query: number and bytes of all (file, hit) pairs of the same basename, without forming a pair."""
    once = table(spark, d, "search_results").groupBy("hit_id").agg(F.max(F.struct("query_id", "name", "score", "size")).alias("r"))
    left, right, names = _sides(spark, d, once.select("hit_id", "r.*"))
    both = join_states(left, replace(right, by=("query_id",)), bridge=names)
    return roll_up(both, ["query_id"], ["pairs", "file_bytes", "hit_bytes"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "file_meta")
    return snapshot_changes(
        meta, snapshot="snapshot_id", key="path_offset", version="file_id", compare=["size", "mtime", "ino"], live=~F.col("path_len").eqNullSafe(0)
    )


def p3_change_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many paths each snapshot added, removed and changed."""
    return p3_found(spark, d).groupBy("snapshot_id", "change_kind").agg(F.count(F.lit(1)).alias("paths"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return apply_changes(table(spark, d, "index_updates")).select("path", "journal_epoch", "seq")


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    """The files that exist after the journal, with their last metadata."""
    return apply_changes(table(spark, d, "index_updates"), payload=METADATA)


QUERIES = {f.__name__: f for f in (p1_found, p1_query_totals, p3_found, p3_change_counts, p4_found, p4_state)}

_COUNTING = """counting AS (
  SELECT * FROM file_meta WHERE path_len <> 0 AND path_offset IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, path_offset ORDER BY file_id DESC) = 1)"""

_CHANGES = f"""WITH {_COUNTING},
snaps AS (SELECT s, lead(s) OVER (ORDER BY s) AS following FROM (SELECT DISTINCT snapshot_id AS s FROM file_meta)),
old AS (SELECT following AS snapshot_id, path_offset, size, mtime, ino FROM counting JOIN snaps ON snapshot_id = s WHERE following IS NOT NULL),
fresh AS (SELECT snapshot_id, path_offset, size, mtime, ino FROM counting WHERE snapshot_id > (SELECT min(snapshot_id) FROM file_meta)),
changes AS (
  SELECT coalesce(n.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(n.path_offset, o.path_offset) AS path_offset,
    CASE WHEN o.path_offset IS NULL THEN 'added' WHEN n.path_offset IS NULL THEN 'removed'
         WHEN n.size IS DISTINCT FROM o.size OR n.mtime IS DISTINCT FROM o.mtime OR n.ino IS DISTINCT FROM o.ino THEN 'changed' END AS change_kind
  FROM fresh n FULL JOIN old o ON n.snapshot_id = o.snapshot_id AND n.path_offset = o.path_offset)
"""

_STATE = """WITH once AS (
  SELECT * FROM index_updates QUALIFY row_number() OVER (PARTITION BY journal_epoch, seq ORDER BY arrived_at DESC) = 1),
touches AS (
  SELECT from_path AS path, journal_epoch, seq, 0 AS sub, false AS writes, NULL AS name, NULL AS size, NULL AS mtime, NULL AS dev, NULL AS ino FROM once WHERE kind = 'Move'
  UNION ALL
  SELECT path, journal_epoch, seq, 1, kind <> 'Delete', name, size, mtime, dev, ino FROM once WHERE kind IS NOT NULL),
last AS (SELECT * FROM touches WHERE path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY journal_epoch DESC, seq DESC, sub DESC) = 1)
"""

SQL = {
    "p1_found": f"""WITH {_COUNTING},
newest AS (SELECT name_offset, path_offset FROM counting WHERE mtime IS NOT NULL AND snapshot_id = (SELECT max(snapshot_id) FROM file_meta)
  QUALIFY row_number() OVER (PARTITION BY name_offset ORDER BY mtime DESC, path_offset) = 1),
top AS (SELECT name, hit_id FROM search_results WHERE score IS NOT NULL AND NOT isnan(score)
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, hit_id) = 1)
SELECT name_offset, path_offset, hit_id FROM arena_names JOIN newest USING (name_offset) JOIN top USING (name)""",
    "p1_query_totals": f"""WITH {_COUNTING},
files AS (SELECT name_offset, size FROM counting WHERE snapshot_id = (SELECT max(snapshot_id) FROM file_meta)),
hits AS (SELECT DISTINCT hit_id, query_id, name, score, size FROM search_results)
SELECT h.query_id, CAST(count(*) AS DECIMAL(38,0)) AS pairs,
  CAST(coalesce(sum(f.size), 0) AS DECIMAL(38,0)) AS file_bytes, CAST(coalesce(sum(h.size), 0) AS DECIMAL(38,0)) AS hit_bytes
FROM files f JOIN arena_names a USING (name_offset) JOIN hits h ON h.name = a.name GROUP BY 1""",
    "p3_found": _CHANGES + "SELECT * FROM changes WHERE change_kind IS NOT NULL",
    "p3_change_counts": _CHANGES + "SELECT snapshot_id, change_kind, count(*) AS paths FROM changes WHERE change_kind IS NOT NULL GROUP BY 1, 2",
    "p4_found": _STATE + "SELECT path, journal_epoch, seq FROM last WHERE writes",
    "p4_state": _STATE + "SELECT path, journal_epoch, seq, name, size, mtime, dev, ino FROM last WHERE writes",
}
