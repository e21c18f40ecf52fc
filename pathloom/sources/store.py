"""Versions of a files table, the change journal, usage files and query files on shared storage."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.changes import last_state, parse_journal
from pathloom.schema import USAGE_EVENTS


class SnapshotStore:
    """``versions/<n>`` parquet directories and a pointer file that names the current one.

    A version is written whole before the pointer is replaced in one step, so readers keep the old version meanwhile. Rows
    are stored in path order, which lets subtree searches skip row groups.
    """

    def __init__(self, root: str):
        self.root = Path(root)

    def current(self) -> int | None:
        pointer = self.root / "CURRENT"
        return json.loads(pointer.read_text())["version"] if pointer.exists() else None

    def journal_seq(self) -> int:
        pointer = self.root / "CURRENT"
        return json.loads(pointer.read_text())["seq"] if pointer.exists() else -1

    def save(self, files: DataFrame, seq: int = -1) -> int:
        """Write a new version that includes the journal up to ``seq`` and make it current."""
        version = (self.current() or 0) + 1
        target = self.root / "versions" / str(version)
        files.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").parquet(str(target))
        temporary = self.root / f".CURRENT.{os.getpid()}"
        with temporary.open("w") as f:
            json.dump({"version": version, "seq": seq}, f)
            f.flush()
            os.fsync(f.fileno())
        temporary.replace(self.root / "CURRENT")
        return version

    def load(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(f"{self.root} has no version")
        return spark.read.parquet(str(self.root / "versions" / str(version)))

    def rebuild(self, scanned: DataFrame, journal: Journal, seq_before: int, prepare) -> int:
        """A full rebuild: the scan plus what was journalled since ``seq_before``; then drop the journal it covers.

        ``prepare`` attaches metadata to the parsed updates, such as :func:`pathloom.operators.changes.prepare`.
        """
        upto = journal.last_seq()
        tail = prepare(journal.replay(scanned.sparkSession, seq_before).where(F.col("seq") <= upto))
        version = self.save(last_state(scanned, tail), upto)
        journal.truncate(upto)
        return version


class Journal:
    """A directory of JSON-line batches named by their first sequence number; one file per batch, placed in one step."""

    def __init__(self, root: str):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def _batches(self) -> list[tuple[int, int, Path]]:
        out = []
        for p in sorted(self.root.glob("*.jsonl")):
            first, last = p.stem.split("-")
            out.append((int(first), int(last), p))
        return out

    def append(self, records: list[dict], first_seq: int) -> None:
        """Add records such as ``{"Create": {"path": ...}}`` with sequence numbers from ``first_seq``."""
        if not records:
            return
        lines = "".join(json.dumps({"seq": first_seq + k, "value": json.dumps(r)}) + "\n" for k, r in enumerate(records))
        temporary = self.root / f".{first_seq}.tmp"
        temporary.write_text(lines)
        temporary.replace(self.root / f"{first_seq:020d}-{first_seq + len(records) - 1:020d}.jsonl")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("seq bigint, value string").json(str(self.root))

    def replay(self, spark: SparkSession, after: int = -1) -> DataFrame:
        return parse_journal(self.read(spark), after)

    def last_seq(self) -> int:
        return max((last for _, last, _ in self._batches()), default=-1)

    def truncate(self, upto: int) -> int:
        """Delete the batches that lie wholly at or below ``upto``; returns how many."""
        old = [p for _, last, p in self._batches() if last <= upto]
        for p in old:
            p.unlink()
        return len(old)


class UsageStore:
    """Usage events as JSON lines; a file that can't be read is set aside and reported."""

    def __init__(self, path: str):
        self.path = Path(path)

    def load(self, spark: SparkSession) -> DataFrame:
        """No file: no events. A file with a malformed line is renamed ``*.corrupt.<ns>`` and refused."""
        if not self.path.exists():
            return spark.createDataFrame([], USAGE_EVENTS)
        # the executors read the file; one malformed line is enough
        parsed = F.from_json("value", f"{USAGE_EVENTS}, malformed string", {"columnNameOfCorruptRecord": "malformed"})
        if not spark.read.text(str(self.path)).where(parsed["malformed"].isNotNull() | (F.trim("value") == "")).isEmpty():
            aside = self.path.with_name(f"{self.path.name}.corrupt.{time.time_ns()}")
            self.path.rename(aside)
            raise ValueError(f"unreadable usage file, set aside as {aside}")
        return spark.read.schema(USAGE_EVENTS).json(str(self.path))

    def save(self, events: list[dict]) -> None:
        temporary = self.path.with_name(self.path.name + ".tmp")
        with temporary.open("w", encoding="utf-8") as f:
            f.writelines(json.dumps(e) + "\n" for e in events)
            f.flush()
            os.fsync(f.fileno())
        temporary.replace(self.path)


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """``(query)`` per line of a file, trimmed; blank lines and those that start with # are left out."""
    text = F.trim(F.regexp_replace("value", "^\\s+|\\s+$", ""))
    return spark.read.text(path).select(text.alias("query")).where("query <> '' and not startswith(query, '#')")


def write_results(results: DataFrame, path: str, form: str = "json") -> None:
    """Write ranked results as ``table`` lines, ``plain`` paths or ``json``."""
    from pathloom.functions.display import result_line

    ordered = results.orderBy("rank")
    if form == "json":
        ordered.write.mode("overwrite").json(path)
    elif form == "plain":
        ordered.select("path").write.mode("overwrite").text(path)
    elif form == "table":
        ordered.select(result_line(F.col("rank"), F.col("score"), F.col("mtime"), F.col("path")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(form)
