"""The filter language: ``term words type:file ext:rs,md path:src mtime:<7d size:>10mb``.

Parsed on the driver into predicates; a token that does not parse is a search word. ``now`` and the time
zone are parameters, so that a query means the same wherever it runs.
"""

from __future__ import annotations

import datetime as dt
import operator
import re
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.paths import extension

OPERATORS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "=": operator.eq}
INVERTED = {">=": "<=", "<=": ">=", ">": "<", "<": ">", "=": "="}
# Seconds of the duration units and bytes of the size units.
SECONDS = {"s": 1, "m": 60, "h": 3_600, "d": 86_400, "w": 604_800}
BYTES = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}
KINDS = {"file": False, "f": False, "dir": True, "d": True, "directory": True}
LONG_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class Compare:
    op: str
    value: int

    def on(self, column: Column) -> Column:
        return OPERATORS[self.op](column, F.lit(min(self.value, LONG_MAX)))


@dataclass(frozen=True)
class Parsed:
    term: str
    is_dir: bool | None = None
    exts: tuple[str, ...] = ()
    paths: tuple[str, ...] = field(default=())
    mtime: Compare | None = None
    size: Compare | None = None

    def predicates(self) -> list[Column]:
        """Conjuncts over a files table with ``path_lc``."""
        out = []
        if self.is_dir is not None:
            out.append(F.col("is_dir") == self.is_dir)
        if self.exts:
            out.append(extension(F.element_at(F.split("path", "/"), -1)).isin(*self.exts))
        out += [F.col("path_lc").contains(p) for p in self.paths]
        if self.mtime:
            out.append(self.mtime.on(F.col("mtime")))
        if self.size:
            out.append(self.size.on(F.col("size")))
        return out


def _split_op(text: str) -> tuple[str, str] | None:
    text = text.strip()
    op = next((o for o in (">=", "<=", ">", "<", "=") if text.startswith(o)), None)
    return (op, text[len(op) :].strip()) if op else None


def parse_size(text: str) -> Compare | None:
    """``>10mb``; units count in 1024s, fractions don't parse, huge values saturate."""
    if (split := _split_op(text)) and (m := re.fullmatch(r"([0-9]+)([^0-9].*)?", split[1].lower())):
        unit = (m[2] or "").strip() if m[2] is None else m[2]
        if unit in BYTES and int(m[1]) < 1 << 64:
            return Compare(split[0], min(int(m[1]) * BYTES[unit], (1 << 64) - 1))
    return None


def parse_mtime(text: str, now: int, zone: str = "UTC") -> Compare | None:
    """An age such as ``<7d`` (younger than a week, so a later time) or a date, which is its local midnight."""
    if not (split := _split_op(text)):
        return None
    op, value = split
    if (m := re.fullmatch(r"([+-]?[0-9]+)([a-z])", value.lower())) and m[2] in SECONDS:
        return Compare(INVERTED[op], now - int(m[1]) * SECONDS[m[2]])
    if re.fullmatch(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", value):
        try:
            day = dt.date(*map(int, value.split("-")))
        except ValueError:
            return None
        return Compare(op, int(dt.datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).timestamp()))
    return None


def parse(raw: str, now: int = 0, zone: str = "UTC") -> Parsed:
    """The last of several type, mtime and size filters counts; extensions add up; every path filter holds."""
    words, exts, paths = [], set(), []
    is_dir = mtime = size = None
    for token in raw.split():
        head, colon, value = token.partition(":")
        if colon and head == "type" and value.strip().lower() in KINDS:
            is_dir = KINDS[value.strip().lower()]
        elif colon and head == "ext" and (new := {e for x in value.split(",") if (e := x.strip().lstrip(".").lower())}):
            exts |= new
        elif colon and head == "path" and value:
            paths.append(value.lower())
        elif colon and head == "mtime" and (c := parse_mtime(value, now, zone)):
            mtime = c
        elif colon and head == "size" and (c := parse_size(value)):
            size = c
        else:
            words.append(token)
    return Parsed(" ".join(words), is_dir, tuple(sorted(exts)), tuple(paths), mtime, size)
