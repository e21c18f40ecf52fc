"""Paths: normal forms on the driver and path expressions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lexical(path: str, cwd: str = "/") -> str:
    """Resolve ``.``, ``..`` and doubled slashes without touching a disk; relative paths start at ``cwd``."""
    out: list[str] = []
    for part in (path if path.startswith("/") else f"{cwd}/{path}").split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/" + "/".join(out)


def scope_of(scope: str | None, cwd: str = "/") -> str | None:
    """A scope ready for comparison; blank means none."""
    return lexical(scope.strip(), cwd) if scope and scope.strip() else None


def lexical_column(path: Column, cwd: str = "/") -> Column:
    """:func:`lexical` of a column; only paths that need it are rebuilt."""
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), path))
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.isin("", "."), acc).otherwise(F.concat(acc, F.array(x)))
    parts = F.aggregate(F.split(absolute, "/"), F.array().cast("array<string>"), step)
    odd = path.rlike(r"(^|/)\.{1,2}(/|$)|//") | ~path.startswith("/")
    return F.when(odd, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(path)


def scope_column(scope: Column, cwd: str = "/") -> Column:
    """:func:`scope_of` of a column; null means none."""
    given = F.regexp_replace(scope, r"(?U)^\s+|\s+\z", "")
    # doubled slashes at the end have every scope rebuilt, those with one slash there as well
    return F.when(given != "", lexical_column(F.concat(given, F.lit("//")), cwd))


def in_subtree(path: Column, scope: str | Column) -> Column:
    """``path`` is ``scope`` or below it, by components: ``/repo`` holds ``/repo/x`` and not ``/repo-a``."""
    if isinstance(scope, Column):
        return (path == scope) | path.startswith(F.when(scope == "/", scope).otherwise(F.concat(scope, F.lit("/"))))
    return path.startswith("/") if scope == "/" else (path == scope) | path.startswith(scope + "/")


def in_subtree_range(path: Column, scope: str) -> Column:
    """The same as two ranges, for path-sorted files whose row groups can be skipped; "0" is the byte after "/"."""
    return path.startswith("/") if scope == "/" else (path == scope) | ((path >= scope + "/") & (path < scope + "0"))


def depth(path: Column) -> Column:
    """Number of components: the root counts, empty and inner ``.`` components don't."""
    real = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    first = path.startswith("/") | (path == ".") | path.startswith("./")
    return (F.size(real) + F.when(first, 1).otherwise(0)).cast("int")


def parent(path: Column) -> Column:
    """Everything before the last slash; the root's children have parent ``/``, bare names none (empty)."""
    cut = F.regexp_replace(path, r"/?[^/]*/*\z", "")
    return F.when((cut == "") & path.startswith("/"), "/").otherwise(cut)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"(?s)(?<=.)/+\z", ""), "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension: none (empty) for ``.bashrc``, ``gz`` for ``a.tar.gz``."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)\z", 1))


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    """Some component matches a pattern: ``name``, ``*.ext`` or ``prefix*``. Other uses of ``*`` match nothing."""
    tests = []
    for pattern in patterns:
        p = pattern.lstrip("/")
        if p.startswith("*."):
            tests.append(lambda c, p=p: c.endswith(p[1:]))
        elif p.endswith("*") and len(p) > 1:
            tests.append(lambda c, p=p: c.startswith(p[:-1]))
        elif p and "*" not in p:
            tests.append(lambda c, p=p: c == p)
    if not tests:
        return F.lit(False)

    def any_of(c: Column) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t(c)
        return (c != "") & out

    return F.exists(F.split(path, "/"), any_of)
