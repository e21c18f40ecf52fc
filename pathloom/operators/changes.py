"""Keeping a files table current from a change journal.

Three ways, for three needs: :func:`last_state` for the set of paths, which scales with the changes and
never looks at one path's history in order; :func:`fold` for the exact table including file ids and
inode identity, sequential within a volume; and :mod:`pathloom.streaming.apply` for a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.paths import basename, excluded
from pathloom.operators.ordering import numbered
from pathloom.schema import JOURNAL_LINE

_META = ["name", "size", "mtime", "dev", "ino", "is_dir"]


def parse_journal(lines: DataFrame, after: int = -1) -> DataFrame:
    """``(seq, kind, path, from_path)`` of journal lines ``(seq, value)`` beyond ``after``; blank and malformed lines are skipped."""
    parsed = lines.where(F.col("seq") > after).select("seq", F.from_json("value", JOURNAL_LINE).alias("j"))
    kind = F.lit(None).cast("string")
    for k in ("Move", "Delete", "Modify", "Create"):
        target = "to" if k == "Move" else "path"
        kind = F.when(F.col(f"j.{k}.{target}").isNotNull(), k).otherwise(kind)
    out = parsed.withColumn("kind", kind).where("kind is not null and (kind <> 'Move' or j.Move.from is not null)")
    path = F.coalesce("j.Create.path", "j.Modify.path", "j.Delete.path", "j.Move.to")
    return out.select("seq", "kind", path.alias("path"), F.col("j.Move.from").alias("from_path"))


def events_to_updates(events: DataFrame) -> DataFrame:
    """``(seq, kind, path, from_path)`` of raw events ``(seq, event, mode, paths array, present array<boolean>)``.

    create, remove and modify give one update per path. A rename is a Delete (mode from), a Create (to) or, of two
    paths, a Move: in the given order (both), or towards the path that exists (any, other). Renames with another
    number of paths modify each. Other events give nothing.
    """
    two = F.size("paths") == 2
    swap = F.col("mode").isin("any", "other") & F.col("present")[0] & ~F.col("present")[1]
    move = F.array(F.struct(F.lit("Move").alias("kind"), F.when(swap, F.col("paths")[0]).otherwise(F.col("paths")[1]).alias("path"), F.when(swap, F.col("paths")[1]).otherwise(F.col("paths")[0]).alias("from_path")))
    each = lambda kind: F.transform("paths", lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("path"), F.lit(None).cast("string").alias("from_path")))
    rename = F.when(F.col("mode") == "from", each("Delete")).when(F.col("mode") == "to", each("Create")).when(F.col("mode").isin("both", "any", "other"), F.when(two, move).otherwise(each("Modify"))).otherwise(each("Modify"))
    made = F.when(F.col("event") == "create", each("Create")).when(F.col("event") == "remove", each("Delete")).when(F.col("event") == "rename", rename).when(F.col("event") == "modify", each("Modify"))
    return events.select("seq", F.explode(made).alias("u")).select("seq", "u.*")


def outside(updates: DataFrame, internal: Sequence[str]) -> DataFrame:
    """Updates neither end of which lies in an internal directory."""
    out = updates
    for d in internal:
        for c in ("path", "from_path"):
            under = (F.col(c) == d) | F.startswith(F.col(c), F.lit(d.rstrip("/") + "/"))
            out = out.where(~F.coalesce(under, F.lit(False)))
    return out


def prepare(updates: DataFrame, metadata: DataFrame, exclusions: Sequence[str] = ()) -> DataFrame:
    """Attach the metadata a path had; ``present`` is false where there is none or the path is excluded."""
    joined = updates.join(metadata.drop("file_id").withColumn("__m", F.lit(True)), "path", "left")
    ok = F.coalesce("__m", F.lit(False)) & ~excluded(F.col("path"), exclusions)
    if "name" not in joined.columns:
        joined = joined.withColumn("name", basename(F.col("path")))
    return joined.withColumn("present", ok).drop("__m")


def last_state(files: DataFrame, updates: DataFrame, key: Sequence[str] = ("seq",)) -> DataFrame:
    """The paths that stand after the updates, with their last metadata.

    A Move removes its source and then writes its target. Writes of missing or excluded files don't count: after a
    Move they leave the target as it was removed, otherwise nothing changes. Two writes of one inode are two files here.
    """
    order = [F.col(k) for k in key]
    write = F.struct(F.col("path").alias("path"), F.lit(1).alias("sub"), F.lit(True).alias("writes"))
    gone = lambda c: F.struct(F.col(c).alias("path"), F.lit(0).alias("sub"), F.lit(False).alias("writes"))
    touches = (
        F.when(F.col("kind") == "Delete", F.array(gone("path")))
        .when(F.col("kind") == "Move", F.when(F.col("present"), F.array(gone("from_path"), write)).otherwise(F.array(gone("from_path"))))
        .when(F.col("present"), F.array(write))
    )
    meta = F.struct(*_META)
    changed = updates.select(*key, F.explode(touches).alias("t"), meta.alias("m")).select(*key, "t.*", "m").where("path is not null")
    stock = files.select("path", meta.alias("m"))
    last = changed.groupBy("path").agg(F.max(F.struct(*order, "sub", "writes", "m")).alias("l"))
    both = stock.withColumnRenamed("m", "old").join(last, "path", "full")
    out = both.where("l is null or l.writes").select("path", F.coalesce("l.m", "old").alias("m"))
    return out.select("path", *[F.col(f"m.{c}").alias(c) for c in _META])


def last_touches(updates: DataFrame) -> DataFrame:
    """Updates that do to every path what its last touch does, one row a path: a Delete, or a write that is present.

    Together with later or earlier updates they leave :func:`last_state` as all updates would.
    """
    rest = [F.col(c) for c in _META]
    row = lambda path, sub, kind: F.struct(F.col(path).alias("path"), F.col("seq"), F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), *rest)
    touches = (
        F.when(F.col("kind") == "Delete", F.array(row("path", 0, "Delete")))
        .when(F.col("kind") == "Move", F.when(F.col("present"), F.array(row("from_path", 0, "Delete"), row("path", 1, "CreateOrModify"))).otherwise(F.array(row("from_path", 0, "Delete"))))
        .when(F.col("present"), F.array(row("path", 1, "CreateOrModify")))
    )
    every = updates.select(F.explode(touches).alias("t")).where("t.path is not null")
    last = every.groupBy("t.path").agg(F.max(F.struct("t.seq", "t.sub", "t.kind", *[f"t.{c}" for c in _META])).alias("l"))
    return last.select("path", "l.*").withColumns({"from_path": F.lit(None).cast("string"), "present": F.col("sub") == 1}).drop("sub")


def latest_by(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` per key, such as a file's latest path per (dev, ino); identity (0, 0) is unknown and left out."""
    rows = df.where("not (dev <=> 0 and ino <=> 0)") if list(key) == ["dev", "ino"] else df
    rest = [c for c in df.columns if c not in (*key, seq)]
    return rows.groupBy(*key).agg(F.max(F.struct(seq, *rest)).alias("r")).select(*key, "r.*")


class Table:
    """A files table as one state: rows by path, ids that survive renames, and the latest id per inode."""

    def __init__(self, rows: Sequence[dict], inode_identity: bool = True, cascade: bool = False):
        self.inodes, self.cascade = inode_identity, cascade
        self.by_path = {r["path"]: dict(r) for r in rows}
        self.by_inode = {}
        for r in sorted(self.by_path.values(), key=lambda r: r["file_id"]):
            self._own(r)
        self.next_id = 1 + max((r["file_id"] for r in rows), default=-1)

    def _own(self, r: dict) -> None:
        if r.get("dev") or r.get("ino"):
            self.by_inode[(r["dev"], r["ino"])] = r["path"]

    def _drop(self, path: str) -> dict | None:
        r = self.by_path.pop(path, None)
        if r and self.by_inode.get((r["dev"], r["ino"])) == path:
            del self.by_inode[(r["dev"], r["ino"])]
        return r

    def _put(self, u: dict, file_id: int) -> None:
        self._drop(u["path"])
        row = {"file_id": file_id, "path": u["path"], **{c: u[c] for c in _META}, "update_seq": u["seq"]}
        self.by_path[u["path"]] = row
        self._own(row)

    def _new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def apply(self, u: dict) -> None:
        if u["kind"] == "Delete":
            self._drop(u["path"])
            self._below(u["path"], None, u["seq"])
        elif u["kind"] == "Move":
            mover = self._drop(u["from_path"])
            if u["present"] and u["path"] is not None:
                self._put(u, mover["file_id"] if mover else self._new_id())
            self._below(u["from_path"], u["path"] if u["present"] else None, u["seq"])
        elif u["kind"] in ("Create", "Modify", "CreateOrModify") and u["present"] and u["path"] is not None:
            known = self.by_path.get(u["path"])
            if known is None and self.inodes:
                before = self.by_inode.get((u["dev"], u["ino"])) if (u["dev"] or u["ino"]) else None
                known = self._drop(before) if before is not None else None  # the same inode elsewhere was a rename
            self._put(u, known["file_id"] if known else self._new_id())

    def _below(self, top: str, to: str | None, seq: int) -> None:
        """With ``cascade``, what lay under a removed or moved directory goes with it."""
        if not self.cascade or top is None:
            return
        for path in [p for p in self.by_path if p.startswith(top + "/")]:
            r = self._drop(path)
            if to is not None:
                self._put({**r, "path": to + path[len(top) :], "seq": seq}, r["file_id"])

    def rows(self) -> list[dict]:
        return list(self.by_path.values())


FOLDED = "volume string, file_id bigint, path string, name string, size bigint, mtime bigint, dev bigint, ino bigint, is_dir boolean, update_seq bigint"


def fold(files: DataFrame, updates: DataFrame, volume: Column, *, inode_identity: bool = True, cascade: bool = False) -> DataFrame:
    """The exact table after the updates in order, per volume: ids survive renames, hard links count as renames.

    Ids and inodes tie rows of a volume together, so a volume is one task: the price of exact identity. ``volume`` is
    an expression over ``path``, applied to the target of an update (or its source where it has none).
    """
    keyed = files.withColumn("volume", volume)
    target = updates.withColumn("__p", F.col("path")).withColumn("path", F.coalesce("path", "from_path")).withColumn("volume", volume).withColumn("path", F.col("__p")).drop("__p")

    def run(key: tuple, stock: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        clean = lambda f: f.astype(object).where(f.notna(), None).to_dict("records")
        table = Table([{**r, "update_seq": None} for r in clean(stock)], inode_identity, cascade)
        for u in clean(log.sort_values("seq", kind="stable")):
            table.apply(u)
        out = pd.DataFrame(table.rows(), columns=["file_id", "path", *_META, "update_seq"])
        out.insert(0, "volume", key[0])
        return out.astype({c: "Int64" for c in ("file_id", "size", "mtime", "dev", "ino", "update_seq")})

    return keyed.groupBy("volume").cogroup(target.groupBy("volume")).applyInPandas(run, FOLDED)


def recency(updates: DataFrame, ring: int = 4_096) -> DataFrame:
    """The last ``ring`` paths written, newest first: ``(path, update_seq)``."""
    return updates.where("kind <> 'Delete' and path is not null").groupBy("path").agg(F.max("seq").alias("update_seq")).orderBy(F.desc("update_seq")).limit(ring)


def ordered_union(first: DataFrame, second: DataFrame, item: str, at: str) -> DataFrame:
    """``(item, position)``: the items of ``first`` in their order, then those only in ``second``."""
    both = first.select(item, F.lit(0).alias("side"), at).unionByName(second.select(item, F.lit(1).alias("side"), at))
    once = both.groupBy(item).agg(F.min(F.struct("side", at)).alias("k"))
    return numbered(once, "k", item).select(item, "position")


