"""Texts as they are shown: labels, snippets, shortened paths and printed lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.paths import extension, in_subtree, parent


def directory_label(path: Column, scope: str | None = None) -> Column:
    """``dir: <parent relative to the scope>/``, ``dir: ./`` for the scope itself."""
    up = parent(path)
    if scope and scope != "/":
        up = F.when(up == scope, "").when(in_subtree(up, scope), F.substring(up, len(scope) + 2, 1 << 30)).otherwise(up)
    elif scope:
        up = F.regexp_replace(up, "^/", "")
    return F.when(up.isin("", "."), "dir: ./").otherwise(F.concat(F.lit("dir: "), F.regexp_replace(up, "/+$", ""), F.lit("/")))


def extension_label(path: Column) -> Column:
    ext = extension(F.element_at(F.split(path, "/"), -1))
    return F.when(ext == "", "ext: (none)").otherwise(F.concat(F.lit("ext: "), ext))


def snippet(line: Column, most: int = 96) -> Column:
    """Trimmed, control characters as blanks, cut after ``most`` characters with three dots."""
    text = F.regexp_replace(line, r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")
    shown = F.regexp_replace(F.substring(text, 1, most), r"\p{Cc}", " ")
    return F.when(F.char_length(text) > most, F.concat(shown, F.lit("..."))).otherwise(shown)


def printable(line: Column) -> Column:
    """Tabs as four blanks, no carriage returns, other control characters as U+FFFD."""
    text = F.regexp_replace(F.regexp_replace(line, "\t", "    "), "\r", "")
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n]]", "�")


def middle_ellipsis(path: Column, most: int) -> Column:
    """Both ends of a long path around three dots, ``most`` characters in all."""
    head = most // 2
    tail = most - head - 3
    return F.when(F.char_length(path) <= most, path).otherwise(F.concat(F.substring(path, 1, head), F.lit("..."), F.right(path, F.lit(tail)) if tail > 0 else F.lit("")))


def tilde(path: Column, home: str) -> Column:
    return F.when(path == home, "~").when(path.startswith(home.rstrip("/") + "/"), F.concat(F.lit("~"), F.substring(path, len(home.rstrip("/")) + 1, 1 << 30))).otherwise(path)


def breadcrumbs(parts: list[str], width: int, separator: str = " ▸ ") -> str:
    """Crumbs joined, cut from the front with an ellipsis where they are wider (in bytes) than ``width``."""
    full = separator.join(parts)
    size = lambda s: len(s.encode())
    if size(full) <= width or width < 10:
        return full
    tail = lambda s: "…" + s[-(width - 1) :] if len(s) > width - 1 else None
    if len(parts) <= 2:
        return tail(full) or full
    for skip in range(1, len(parts)):
        shorter = "…" + separator.join(parts[skip:])
        if size(shorter) <= width:
            return shorter
    return tail(parts[-1]) or "…" + parts[-1]


def result_line(rank: Column, score: Column, mtime: Column, path: Column) -> Column:
    """A row of the printed table: rank, score with two places, modification time in UTC, path."""
    when = F.date_format(F.timestamp_seconds(mtime), "yyyy-MM-dd HH:mm")
    return F.format_string("%4d  %5.2f  %s  %s", rank, score.cast("double"), when, path)
