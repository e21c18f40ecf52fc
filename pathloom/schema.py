"""Declared schemas as DDL; nothing is inferred."""

from __future__ import annotations


FILES = "file_id bigint, path string, name string, size bigint, mtime bigint, dev bigint, ino bigint, is_dir boolean"
RESULT = "rank int, path string, name string, score float, size bigint, mtime bigint"
USAGE_EVENTS = "path string, query string, action string, ts bigint, seq bigint"
LINES = "path string, line_number int, line string"
#: One JSON object per journal line, exactly one field of which is set.
JOURNAL_LINE = "`Create` struct<path: string>, `Modify` struct<path: string>, `Delete` struct<path: string>, `Move` struct<`from`: string, `to`: string>"
JOURNAL = "seq bigint, kind string, path string, from_path string"
#: A prepared update: the journal record with the metadata its path had; ``present`` is false for missing or excluded files.
UPDATES = "seq bigint, kind string, path string, from_path string, name string, size bigint, mtime bigint, dev bigint, ino bigint, is_dir boolean, present boolean"

ACTIONS = ("open", "copy", "reveal", "print", "enter")
