"""The change journal as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from pathloom.operators.changes import last_state, last_touches
from pathloom.schema import UPDATES
from pathloom.sources.store import SnapshotStore


def journal_stream(spark: SparkSession, directory: str, schema: str = UPDATES, files_per_trigger: int = 256) -> DataFrame:
    """New batch files of a journal directory, in the order of their names, as prepared updates."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(directory)


def apply_to_store(updates: DataFrame, store: SnapshotStore, checkpoint: str, each: Callable[[int], None] | None = None) -> DataStreamWriter:
    """Write a new version of the store for every micro-batch; updates may come late, and again.

    Beside each version lies the last touch of every path since the stream took the store over, so that an update is
    compared with its path's and not with the newest of all. What the store included when it was taken over is passed over.
    Start with ``.trigger(availableNow=True).start()`` or a processing time.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, version, seq = batch.sparkSession, store.current() or 0, store.journal_seq()
        kept = store.root / "touched" / str(version)
        floor, upto = json.loads((kept / "_floor").read_text()) if (kept / "_floor").exists() else (seq, None)
        known = upto == seq  # else they belong to a version that never became current
        floor = floor if known else seq
        fresh = batch.where(F.col("seq") > floor)
        top = fresh.agg(F.max("seq")).first()[0]
        if top is not None:
            touched = last_touches(fresh.unionByName(spark.read.parquet(str(kept)), allowMissingColumns=True) if known else fresh)
            target = kept.with_name(str(version + 1))
            touched.write.mode("overwrite").parquet(str(target))
            (target / "_floor").write_text(json.dumps([floor, max(seq, top)]))
            # the pointer moves last; until then the touches of the version before count
            store.save(last_state(store.load(spark), spark.read.parquet(str(target))), max(seq, top))
        if each:
            each(batch_id)

    return updates.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


class LatestPath(StatefulProcessor):
    """Per path: the last touch, kept in state, so that late and repeated updates change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, sub int, writes boolean")

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        best = self.last.get() if self.last.exists() else None
        before = best
        for frame in rows:
            for r in frame.itertuples():
                now = (int(r.seq), int(r.sub), bool(r.writes))
                if best is None or now[:2] > tuple(best)[:2]:
                    best = now
        if best is not None and best is not before:
            self.last.update(tuple(best))
            yield pd.DataFrame({"path": [key[0]], "seq": [best[0]], "present": [best[2]]})

    def close(self) -> None:
        pass


def latest_paths(updates: DataFrame) -> DataFrame:
    """``(path, seq, present)`` whenever a path's last touch changes; needs the RocksDB state store.

    A Move is two touches; the state holds one small record per path, never a history.
    """
    gone = F.struct(F.col("from_path").alias("path"), F.lit(0).alias("sub"), F.lit(False).alias("writes"))
    write = F.struct(F.col("path").alias("path"), F.lit(1).alias("sub"), F.lit(True).alias("writes"))
    drop = F.struct(F.col("path").alias("path"), F.lit(0).alias("sub"), F.lit(False).alias("writes"))
    touch = F.when(F.col("kind") == "Delete", F.array(drop)).when(F.col("kind") == "Move", F.when(F.col("present"), F.array(gone, write)).otherwise(F.array(gone))).when(F.col("present"), F.array(write))
    touches = updates.select("seq", F.explode(touch).alias("t")).select("seq", "t.*").where("path is not null")
    out = T.StructType.fromDDL("path string, seq bigint, present boolean")
    return touches.groupBy("path").transformWithStateInPandas(LatestPath(), out, "update", "none")
