"""Literal search in lines of text, in the manner of three line searchers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pathloom.functions.display import snippet
from pathloom.functions.paths import basename, in_subtree, scope_of

# What each mode of search does and skips.
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_GREP_FILES = 20_000
IGNORE_FILES = (".gitignore", ".ignore")
SKIPPED_DIRS = (".git", ".hg", ".svn", "target", "node_modules", ".cargo", ".rustup", ".shux", ".venv", "venv", "__pycache__")
ALIASES = {"rg": "ripgrep", "git_grep": "git-grep", "gitgrep": "git-grep"}
MODES = ("ripgrep", "git-grep", "grep")


def engine(name: str = "auto", *, has_ripgrep: bool = True, in_work_tree: bool = False, allow_slow: bool = False) -> str:
    """The mode that a setting selects: ``auto`` takes ripgrep, else git-grep in a work tree, else grep if that is allowed."""
    name = ALIASES.get(name, name)
    if name == "auto":
        name = "ripgrep" if has_ripgrep else "git-grep" if in_work_tree else "grep" if allow_slow else ""
    if name not in MODES or (name == "ripgrep" and not has_ripgrep) or (name == "git-grep" and not in_work_tree):
        raise ValueError("no content search engine is available")
    return name


def lines(texts: DataFrame, path: str = "path", text: str = "text", *carry: str) -> DataFrame:
    """``(path, line_number, line, carry...)``; lines lose a trailing carriage return, a final line break starts no line."""
    parts = F.posexplode(F.split(F.regexp_replace(text, "\n\\z", ""), "\n"))
    rows = texts.where(F.col(text) != "").select(F.col(path).alias("path"), *carry, parts.alias("p", "l"))
    return rows.select("path", (F.col("p") + 1).cast("int").alias("line_number"), F.regexp_replace("l", "\r\\z", "").alias("line"), *carry)


def _under(path: Column, names: tuple[str, ...]) -> Column:
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))


def ignored_by(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Whether the ignore files ``(path, text)`` exclude a file; a bounded list, such as those of one work tree."""
    from pathloom.sources.fswalk import ignores

    listed = [(p, t) for p, t in rules if p.rsplit("/", 1)[-1] in IGNORE_FILES]

    @F.pandas_udf("boolean")
    def test(paths: pd.Series) -> pd.Series:
        known = ignores(listed)
        return pd.Series([p is not None and known(p) for p in paths], dtype=object)

    return test(path)


def search(
    texts: DataFrame, query: str, *, mode: str = "ripgrep", limit: int | None = None, path: str = "path", text: str = "text", scope: str | None = None, cwd: str = "/",
    max_bytes: int = MAX_FILE_BYTES, ignore: Sequence[tuple[str, str]] = (), max_files: int | None = None,
) -> DataFrame:
    """``(path, line_number, column, line)`` of lines that hold the query, once per line, by path and line.

    ripgrep: capitals in the query make it case-sensitive; files above ``max_bytes`` (2 MiB), hidden ones and those excluded by
    the ``ignore`` files (path, text) are skipped. git-grep: case-sensitive. grep: case-sensitive, without columns, and without
    files under directories of tools and builds; ``max_files`` looks at no more than so many, the first by path, as a bounded
    fallback does (``MAX_GREP_FILES``), by default at all. ``scope`` is a file or directory. Texts with a NUL are binary and
    skipped; ``column`` is the 1-based byte where the first match begins. A blank query or limit 0 finds nothing.
    """
    within = scope_of(scope, cwd)
    rows = texts if within is None else texts.where(in_subtree(F.col(path), within))
    rows = rows.where(~F.contains(F.col(text), F.lit("\0")))
    if not query.strip() or limit == 0:
        rows = rows.where("false")
    # names are hidden below the scope, not in it
    below = F.col(path) if within in (None, "/") else F.substring(F.col(path), len(within) + 1, 1 << 30)
    hidden = F.exists(F.split(below, "/"), lambda c: c.startswith(".") & (c != ".") & (c != ".."))
    if mode == "ripgrep":
        rows = rows.where((F.octet_length(text) <= max_bytes) & ~hidden)
        if ignore:
            rows = rows.where(~ignored_by(F.col(path), ignore))
    elif mode == "grep":
        rows = rows.where(~_under(F.col(path), SKIPPED_DIRS))
        if max_files is not None:
            rows = rows.orderBy(path).limit(max_files)
    elif mode != "git-grep":
        raise ValueError(mode)
    fold = mode == "ripgrep" and query == query.lower()
    needle = query.lower() if fold else query
    subject = lambda c: F.lower(c) if fold else c
    # whole texts first: only those with a match are cut into lines
    near = rows.where(F.contains(subject(F.col(text)), F.lit(needle)))
    line = subject(F.col("line"))
    hits = lines(near, path, text).where(F.contains(line, F.lit(needle)))
    column = F.lit(None).cast("int") if mode == "grep" else (F.octet_length(F.substring_index(line, needle, 1)) + 1).cast("int")
    out = hits.select("path", "line_number", column.alias("column"), "line")
    return out.orderBy("path", "line_number").limit(limit) if limit is not None else out


def as_results(hits: DataFrame, limit: int, files: DataFrame | None = None) -> DataFrame:
    """The first hits as ``(rank, path, name, score, size, mtime)``: ``file:line:column  snippet``, scores falling from 1.

    ``size`` and ``mtime`` are those of ``files``, 0 for a file it doesn't have.
    """
    top = hits.orderBy("path", "line_number").limit(limit)
    total = F.greatest(F.count(F.lit(1)).over(W.partitionBy(F.lit(1))), F.lit(1)).cast("float")
    index = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("path", "line_number")) - 1
    score = F.greatest(F.lit(0.01).cast("float"), (F.lit(1.0).cast("float") - (index.cast("float") / total).cast("float") * F.lit(0.25).cast("float")).cast("float"))
    name = F.concat(basename(F.col("path")), F.lit(":"), F.col("line_number").cast("string"), F.lit(":"), F.coalesce("column", F.lit(1)).cast("string"), F.lit("  "), snippet(F.col("line")))
    shown = top.select((index + 1).alias("rank"), "path", name.alias("name"), score.alias("score"))
    if files is None:
        return shown.withColumns({"size": F.lit(0).cast("bigint"), "mtime": F.lit(0).cast("bigint")})
    # the few rows shown decide the join; the files table may be of any size
    known = files.select("path", F.col("size").cast("bigint").alias("size"), F.col("mtime").cast("bigint").alias("mtime"))
    return known.join(F.broadcast(shown), "path", "right").select("rank", "path", "name", "score", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "mtime")])


def parse_match(line: Column) -> Column:
    """``struct<path, line_number, column, line>`` of ``path:line:column:text``, at the first place with two numbers; else null."""
    pattern = r"(?s)^(.*?):(\d+):(\d+):(.*)$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    return F.when(line.rlike(pattern), F.struct(part(1).alias("path"), part(2).cast("int").alias("line_number"), part(3).cast("int").alias("column"), F.regexp_replace(part(4), "[\r\n]+\\z", "").alias("line")))
