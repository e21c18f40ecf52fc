"""The engine behind one object: scan, index, views, usage and measurements.

    engine = Engine(spark, files=tables.files(spark, d))
    engine.search("main.rs ext:rs", limit=20).show()
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.config import Config
from pathloom.functions.ranking import matches_text
from pathloom.operators import content, grouping, index, usage
from pathloom.operators.changes import last_state
from pathloom.operators.evaluation import latency_summary
from pathloom.operators.search import Request, scoped, search
from pathloom.plans import dsl
from pathloom.sources import fswalk
from pathloom.sources.store import Journal, SnapshotStore

VIEWS = ("files", "directories", "usage", "content", "recent", "large")
#: Results of an interactive view, and the most that a request may ask for.
VIEW_LIMIT, MOST_RESULTS = 100, 1_000_000


class Engine:
    """Over a files table given or scanned, or, with :meth:`open`, over the index stored at ``config.index_path``."""

    def __init__(self, spark: SparkSession, files: DataFrame | None = None, *, config: Config | None = None, usage_events: DataFrame | None = None, texts: DataFrame | None = None, table: DataFrame | None = None):
        self.spark, self.config = spark, config or Config()
        self.files = files if files is not None else table if table is not None else self.scan()
        self.table = table if table is not None else index.build(self.files, self.config.exclusions)
        self.usage = usage.prune(usage.aggregate(usage_events), self.config.usage.max_entries) if usage_events is not None and self.config.usage.enabled else None
        self.texts = texts

    # --- the stored index ---------------------------------------------------------------------------
    @classmethod
    def open(cls, spark: SparkSession, config: Config, **options) -> Engine:
        """The engine over the current version of the stored index: derived columns are read, not made, in path order."""
        return cls(spark, config=config, table=SnapshotStore(config.index_path).load(spark), **options)

    @property
    def store(self) -> SnapshotStore:
        return SnapshotStore(self.config.index_path)

    @property
    def journal(self) -> Journal:
        return Journal(f"{self.config.index_path}/journal")

    def _reopen(self) -> Engine:
        self.files = self.table = self.store.load(self.spark)
        return self

    def save(self) -> int:
        """Store the searchable table as a new version that covers the journal so far; later searches read it."""
        version = self.store.save(self.table, self.journal.last_seq())
        self._reopen()
        return version

    def catch_up(self, prepare: Callable[[DataFrame], DataFrame]) -> int:
        """Apply what was journalled since the stored version; ``prepare`` attaches metadata to updates. Returns the version."""
        seq, upto = self.store.journal_seq(), self.journal.last_seq()
        if upto > seq:
            tail = prepare(self.journal.replay(self.spark, seq).where(F.col("seq") <= upto))
            self.store.save(self._indexed(last_state(self.store.load(self.spark), tail)), upto)
            self._reopen()
        return self.store.current() or 0

    def rebuild(self, prepare: Callable[[DataFrame], DataFrame], scanned: DataFrame | None = None) -> int:
        """Scan anew, add what was journalled meanwhile, make that the stored version and drop the journal it covers."""
        before = self.journal.last_seq()
        files = self.scan() if scanned is None else scanned
        upto = self.journal.last_seq()
        tail = prepare(self.journal.replay(self.spark, before).where(F.col("seq") <= upto)) if upto > before else None
        version = self.store.save(self._indexed(files if tail is None else last_state(files, tail)), upto)
        self.journal.truncate(upto)
        self._reopen()
        return version

    def _indexed(self, files: DataFrame) -> DataFrame:
        """Files as the searchable table; paths that have no id yet get the next ones, in path order."""
        plain = files.select("path", "name", "size", "mtime", "dev", "ino", "is_dir")
        return index.build(fswalk.with_file_ids(plain), self.config.exclusions)

    def next_rebuild(self, now: datetime) -> datetime:
        """When the daily rebuild is due: the next time of day ``reconcile_hour``, tomorrow if it has struck today."""
        due = now.replace(hour=self.config.reconcile_hour, minute=0, second=0, microsecond=0)
        return due if due > now else due + timedelta(days=1)

    def scan(self) -> DataFrame:
        walked = fswalk.scan(self.spark, list(self.config.index_roots), list(self.config.exclusions), self.config.respect_ignore_files)
        return fswalk.with_file_ids(walked)

    # --- searches -----------------------------------------------------------------------------------
    def request(self, line: str, *, limit: int = VIEW_LIMIT, now: int | None = None, scope: str | None = None, zone: str = "UTC", filter_stage: str = "pre", boost: str | None = None, **options) -> Request:
        """A line of the filter language as a request. ``scope`` filters, and boosts unless ``boost`` names another place; ``options`` are those of :class:`Request`."""
        if not 0 <= limit <= MOST_RESULTS:
            raise ValueError(f"limit is in 0..{MOST_RESULTS}")
        parsed = dsl.parse(line, int(time.time()) if now is None else now, zone)
        given = dict(recent_if_empty=True, filters=tuple(parsed.predicates()), filter_stage=filter_stage) | options
        return Request(parsed.term, limit, scope, scope if boost is None else boost, **given)

    def search(self, line: str, *, view: str = "files", limit: int = VIEW_LIMIT, now: int | None = None, scope: str | None = None, **options) -> DataFrame:
        """A line of the filter language in one of ``VIEWS``; every view keeps to its scope, filters and limit.

        ``exact_first=True`` answers a term that is some file's whole name with just those files. Filters apply to files: in
        the content view to those with a match, in the usage view to those in use.
        """
        now = int(time.time()) if now is None else now
        request = self.request(line, limit=limit, now=now, scope=scope, **options)
        if view in ("files", "directories"):
            return search(self.table, replace(request, dirs_only=view == "directories"), self.usage, now, self.config.usage.max_boost)
        if view == "recent":
            return search(self.table, replace(request, term="", boost_scope=None))
        within = scoped(self.table, replace(request, filter_stage="pre"))
        narrow = scope is not None or bool(request.filters)
        if view == "large":
            named = within.where(matches_text(F.col("name_lc"), F.col("path_lc"), request.term.lower())) if request.term else within
            return grouping.largest(named, limit)
        if view == "usage":
            if self.usage is None:
                raise ValueError("there is no usage memory")
            used = self.usage.join(within.select("path"), "path", "left_semi") if request.filters else self.usage
            return usage.as_results(usage.listing(used, now=now, query=request.term, scope=scope, limit=limit))
        if view == "content":
            if self.texts is None or not self.config.content.enabled:
                raise ValueError("content search is disabled")
            mode = content.engine(self.config.content.engine, allow_slow=self.config.content.allow_slow_fallback, in_work_tree=self.config.content.in_work_tree)
            texts = self.texts.join(within.select("path"), "path", "left_semi") if narrow else self.texts
            return content.as_results(content.search(texts, request.term, mode=mode, scope=scope), limit, self.table)
        raise ValueError(view)

    def status(self) -> DataFrame:
        return index.status(self.table)

    def measure(self, queries: Sequence[str], runs: int = 200, warmup: int = 25, limit: int = 20) -> DataFrame:
        """Latencies of queries asked in turn: the summary of ``runs`` after ``warmup`` that aren't counted."""
        samples = []
        for k in range(warmup + runs):
            began, ok = time.perf_counter(), True
            try:
                search(self.table, Request(queries[k % len(queries)], limit), self.usage, int(time.time())).collect()
            except Exception:
                ok = False
            if k >= warmup:
                samples.append((round((time.perf_counter() - began) * 1e6), ok))
        return latency_summary(self.spark.createDataFrame(samples, "elapsed_us bigint, ok boolean"))

    def watch(self, path: str, times: int, every_s: float = 60.0) -> None:
        """Append the status as a JSON line, ``times`` times."""
        for k in range(times):
            if k:
                time.sleep(every_s)
            row = self.status().withColumn("trigrams", index.trigram_count(self.files).scalar()).first().asDict()
            with Path(path).open("a", encoding="utf-8") as f:
                f.write(json.dumps({"schema_version": 1, "at": int(time.time()), **row}) + "\n")

    def register(self) -> None:
        """Expose the table to SQL as ``files``."""
        self.table.createOrReplaceTempView("files")

    def paths_below(self, scope: str) -> DataFrame:
        from pathloom.functions.paths import in_subtree_range

        return self.table.where(in_subtree_range(F.col("path"), scope.rstrip("/") or "/"))
