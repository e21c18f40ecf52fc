"""``spark.read.format("fswalk")``: files and directories below roots, walked in parallel by subtree.

Links are not followed and not listed; hidden entries are. Entries that can't be read, or that were last
modified before 1970, are skipped. Excluded entries prune their subtree, and so do the rules of ignore
files (``.gitignore``, ``.ignore``, ``.git/info/exclude``) if asked for.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WALKED = "path string, name string, size bigint, mtime bigint, dev bigint, ino bigint, is_dir boolean"
# Ignore files in the order in which they are consulted, later ones winning.
IGNORE_FILES = (".gitignore", ".ignore", ".git/info/exclude")


def is_excluded(path: str, patterns: list[str]) -> bool:
    """As :func:`pathloom.functions.paths.excluded`, for one path."""
    for component in filter(None, path.split("/")):
        for p in (x.lstrip("/") for x in patterns):
            if p.startswith("*."):
                if component.endswith(p[1:]):
                    return True
            elif p.endswith("*") and len(p) > 1:
                if component.startswith(p[:-1]):
                    return True
            elif p and "*" not in p and component == p:
                return True
    return False


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file as a regular expression over the path relative to its directory."""

    pattern: str
    keep: bool
    dirs_only: bool

    def hits(self, relative: str, is_dir: bool) -> bool:
        return (is_dir or not self.dirs_only) and re.fullmatch(self.pattern, relative, re.S) is not None


def _glob(text: str) -> str:
    out, k = "", 0
    while k < len(text):
        if text.startswith("**/", k) and (k == 0 or text[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif text.startswith("**", k):
            out, k = out + ".*", k + 2
        elif text[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif text[k] == "?":
            out, k = out + "[^/]", k + 1
        elif text[k] == "[" and (end := text.find("]", k + 2)) > 0:
            out, k = out + fnmatch.translate(text[k : end + 1])[4:].split(")")[0], end + 1
        elif text[k] == "\\" and k + 1 < len(text):
            out, k = out + re.escape(text[k + 1]), k + 2
        else:
            out, k = out + re.escape(text[k]), k + 1
    return out


def parse_rules(text: str) -> list[Rule]:
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
        dirs_only, line = line.endswith("/"), line.rstrip("/")
        if line:
            anchored = "/" in line
            rules.append(Rule(("" if anchored else "(?:.*/)?") + _glob(line.lstrip("/")), keep, dirs_only))
    return rules


def rules_of(directory: str) -> list[Rule]:
    out = []
    for name in IGNORE_FILES:
        try:
            with open(os.path.join(directory, name), encoding="utf-8", errors="replace") as f:
                out += parse_rules(f.read())
        except OSError:
            continue
    return out


def is_ignored(path: str, is_dir: bool, root: str, cache: dict[str, list[Rule]] | None = None) -> bool:
    """The last rule that matches the path or a directory above it decides, from the root down to the path's own directory."""
    cache = {} if cache is None else cache
    root = root.rstrip("/") or "/"
    above, d = [], os.path.dirname(path)
    while d == root or d.startswith(root.rstrip("/") + "/"):
        above.append(d)
        if d == root:
            break
        d = os.path.dirname(d)
    ignored = False
    for d in reversed(above):
        if d not in cache:
            cache[d] = rules_of(d)
        if not cache[d]:
            continue
        parts = os.path.relpath(path, d).split("/")
        # the path itself first, then the directories above it; the nearest match counts
        for n in range(len(parts), 0, -1):
            hit = next((r for r in reversed(cache[d]) if r.hits("/".join(parts[:n]), is_dir or n < len(parts))), None)
            if hit:
                ignored = not hit.keep
                break
    return ignored


class _Known(dict):
    """Rules by directory; a directory without any has none."""

    def __contains__(self, directory: object) -> bool:
        return True

    def __missing__(self, directory: str) -> list[Rule]:
        return []


def ignores(files: list[tuple[str, str]]) -> Callable[[str], bool]:
    """Whether the rules of ignore files, given as (path, text), exclude a file's path; no disk is read."""
    known = _Known()
    order = {name: k for k, name in enumerate(IGNORE_FILES)}
    for path, text in sorted(files, key=lambda f: order.get(f[0].rsplit("/", 1)[-1], 0)):
        directory = os.path.dirname(path)
        known[directory] = known[directory] + parse_rules(text)
    return lambda path: is_ignored(path, False, "/", known)


@dataclass
class Subtree(InputPartition):
    root: str
    top: str
    deep: bool


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options.get("roots", "[]")) or [options["path"]]
        self.exclusions = json.loads(options.get("exclusions", "[]"))
        self.ignore = str(options.get("respectignorefiles", options.get("respectIgnoreFiles", "false"))).lower() == "true"

    def partitions(self):
        """A partition for every directory one level below a root, and one for what lies directly in it."""
        out = []
        for root in self.roots:
            root = os.path.abspath(root)
            out.append(Subtree(root, root, False))
            out += [Subtree(root, e.path, True) for e in self._entries(root, root, {}) if e.is_dir(follow_symlinks=False)]
        return out

    def _entries(self, directory: str, root: str, cache: dict) -> Iterator[os.DirEntry]:
        try:
            with os.scandir(directory) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            try:
                is_dir = e.is_dir(follow_symlinks=False)
                if e.is_symlink() or not (is_dir or e.is_file(follow_symlinks=False)):
                    continue
            except OSError:
                continue
            if is_excluded(e.path, self.exclusions) or (self.ignore and is_ignored(e.path, is_dir, root, cache)):
                continue
            yield e

    @staticmethod
    def _row(path: str, is_dir: bool):
        try:
            s = os.stat(path, follow_symlinks=False)
        except OSError:
            return None
        if s.st_mtime < 0:
            return None
        shown = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return shown, os.path.basename(shown), s.st_size, int(s.st_mtime), s.st_dev, s.st_ino, is_dir

    def read(self, partition: Subtree):
        cache: dict[str, list[Rule]] = {}
        stack = [partition.top]
        if row := self._row(partition.top, True):
            if partition.deep or row[1]:
                yield row
        while stack:
            for e in self._entries(stack.pop(), partition.root, cache):
                is_dir = e.is_dir(follow_symlinks=False)
                if is_dir and not partition.deep:
                    continue  # a partition of its own
                if row := self._row(e.path, is_dir):
                    yield row
                if is_dir:
                    stack.append(e.path)


class FsWalk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fswalk"

    def schema(self) -> str:
        return WALKED

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def scan(spark: SparkSession, roots: list[str], exclusions: list[str] | None = None, respect_ignore_files: bool = False) -> DataFrame:
    """All entries below the roots, once per path even where roots nest, without a file id."""
    spark.dataSource.register(FsWalk)
    reader = spark.read.format("fswalk").option("roots", json.dumps(roots)).option("exclusions", json.dumps(exclusions or []))
    return reader.option("respectIgnoreFiles", str(respect_ignore_files).lower()).load().dropDuplicates(["path"])


def with_file_ids(files: DataFrame) -> DataFrame:
    """Dense ids in path order, without gathering the table."""
    from pathloom.operators.ordering import numbered

    return numbered(files, "path", at="__at").select((F.col("__at") - 1).alias("file_id"), *files.columns)
