"""DuckDB text for the pieces that many queries share."""

from __future__ import annotations

import re

from pathloom.functions.ranking import CONTEXT_PENALTIES, NOISE, is_literal


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def context(path_lc: str = "path_lc") -> str:
    return "-(" + " + ".join(f"CASE WHEN {' OR '.join(f'contains({path_lc}, {quote(p)})' for p in patterns)} THEN {points} ELSE 0 END" for points, patterns in CONTEXT_PENALTIES) + ")"


def noise(path_lc: str) -> str:
    return "(" + " OR ".join(f"contains({path_lc}, {quote(p)})" for p in NOISE) + ")"


def depth(path: str = "path") -> str:
    return f"(len(list_filter(string_split({path}, '/'), lambda x: x <> '' AND x <> '.')) + CASE WHEN starts_with({path}, '/') THEN 1 ELSE 0 END)"


def extension(name: str) -> str:
    return f"lower(regexp_extract({name}, '(?s)^.+\\.([^.]*)$', 1))"


def parent(path: str) -> str:
    return f"CASE WHEN regexp_replace({path}, '/?[^/]*/*$', '') = '' AND starts_with({path}, '/') THEN '/' ELSE regexp_replace({path}, '/?[^/]*/*$', '') END"


#: fx: the files table of pathloom.sources.tables.files with the columns that searches need.
FILES = f"""counting AS (
  SELECT * FROM file_meta WHERE path_len <> 0 AND path_offset IS NOT NULL AND snapshot_id = (SELECT max(snapshot_id) FROM file_meta)
  QUALIFY row_number() OVER (PARTITION BY path_offset ORDER BY file_id DESC) = 1),
f AS (
  SELECT file_id, path, name, coalesce(size, 0) AS size, coalesce(mtime, 0) AS mtime, dev, ino, is_dir
  FROM counting JOIN arena_paths USING (path_offset) JOIN arena_names USING (name_offset)),
fx AS (
  SELECT *, {context()} AS context
  FROM (SELECT *, lower(name) AS name_lc, lower(path) AS path_lc, {depth()} AS depth FROM f WHERE name <> ''))"""

#: px: the same of pathloom.sources.tables.parts.
PARTS = f"""pf AS (
  SELECT p_partkey AS file_id,
    '/Projects/' || replace(p_brand, '#', '-') || '/' || p_type || CASE p_partkey % 10 WHEN 3 THEN '/target' WHEN 7 THEN '/node_modules' ELSE '' END
      || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.rs' AS path,
    replace(p_name, ' ', '_') || '_' || p_partkey || '.rs' AS name, CAST(p_size AS BIGINT) AS size, 1700000000 + p_partkey * 60 AS mtime,
    CAST(1 AS BIGINT) AS dev, p_partkey AS ino, false AS is_dir FROM part),
px AS (
  SELECT *, {context()} AS context FROM (SELECT *, lower(name) AS name_lc, lower(path) AS path_lc, {depth()} AS depth FROM pf WHERE name <> ''))"""

#: uses: usage events; used: their aggregation.
USAGE = """uses AS (
  SELECT pf.path, event_type AS query, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'copy' WHEN 'purchase' THEN 'reveal' WHEN 'signup' THEN 'enter' WHEN 'error' THEN 'print' END AS action,
    CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq
  FROM events JOIN pf ON pf.file_id = (user_id * 37 + CAST(json_extract_string(props, '$.k') AS BIGINT)) % (SELECT count(*) FROM part)),
used AS (
  SELECT path, string_split(path, '/')[-1] AS name, count(*) AS total_count,
    count(*) FILTER (action = 'open') AS open_count, count(*) FILTER (action = 'copy') AS copy_count, count(*) FILTER (action = 'reveal') AS reveal_count,
    count(*) FILTER (action = 'print') AS print_count, count(*) FILTER (action = 'enter') AS enter_count,
    arg_min(ts, seq) AS first_used, arg_max(ts, seq) AS last_used, arg_max(query, seq) AS last_query, arg_max(action, seq) AS last_action
  FROM uses GROUP BY path)"""


def frecency(now: int) -> str:
    return f"""round(least(greatest(0.7 / (1.0 + (CAST(greatest({now} - last_used, 0) AS DOUBLE) / 86400.0) / 7.0)
  + 0.3 * least(greatest(ln(CAST(total_count AS DOUBLE) + 1.0) / ln(CAST(50 AS DOUBLE)), 0.0), 1.0), 0.0), 1.0), 6)"""


def name_score(q: str, quoted: bool = True) -> str:
    """With ``quoted`` off, ``q`` is a column."""
    t = quote(q) if quoted else q
    return f"""CASE WHEN name_lc = {t} THEN CAST(1.0 AS FLOAT)
    WHEN starts_with(name_lc, {t}) THEN CAST(CAST(CAST(strlen({t}) AS FLOAT) / CAST(strlen(name_lc) AS FLOAT) AS FLOAT) * CAST(0.09 AS FLOAT) + CAST(0.9 AS FLOAT) AS FLOAT)
    WHEN contains(name_lc, ' ' || {t}) OR contains(name_lc, '_' || {t}) THEN CAST(0.7 AS FLOAT)
    WHEN contains(name_lc, {t}) THEN CAST(0.5 AS FLOAT) ELSE CAST(0.3 AS FLOAT) END"""


def _re(q: str) -> str:
    return quote("(?s)^" + "".join(f"([^{re.escape(c)}]*){re.escape(c)}" for c in q))


def _skip(text: str, q: str, k: int) -> str:
    return f"length(regexp_extract({text}, {_re(q)}, {k + 1}))"


def _adjacent(text: str, q: str) -> str:
    pairs = " + ".join(f"CASE WHEN {_skip(text, q, k)} = 0 THEN 1 ELSE 0 END" for k in range(1, len(q))) or "0"
    return f"(CAST({pairs} AS DOUBLE) / {len(q)}.0 * CAST(0.05 AS DOUBLE))"


INITIALS = """(CASE WHEN starts_with(path, '/') THEN '/' ELSE '' END || array_to_string(list_transform(list_filter(regexp_split_to_array(path, '[/\\-_.]'), lambda t: t <> ''), lambda t: lower(t[1])), ''))"""
MASK = """array_to_string(list_transform(range(1, length(path) + 1), lambda i: CASE WHEN lower(path[i]) <> path[i] OR (i > 1 AND path[i-1] IN ('_', '-', '/', '.')) THEN lower(path[i]) ELSE chr(1) END), '')"""


def component_score(q: str) -> str:
    return f"CASE WHEN regexp_matches(initials, {_re(q)}) THEN least(CAST(0.95 AS DOUBLE) + {_adjacent('initials', q)} + CAST(0.05 AS DOUBLE) * {len(q)}.0 / length(initials), CAST(0.99 AS DOUBLE)) END"


def camel_score(q: str, given: str = "") -> str:
    """With ``given`` in capitals, 0.05 where every character lies on a capital of the path."""
    bonus = ""
    if given and given.isupper() and given.isalpha():
        at = [" + ".join([_skip("mask", q, j) for j in range(k + 1)] + [str(k + 1)]) for k in range(len(q))]
        bonus = " + CASE WHEN " + " AND ".join(f"lower(path[{a}]) <> path[{a}]" for a in at) + " THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    return f"CASE WHEN regexp_matches(mask, {_re(q)}) THEN least(CAST(0.90 AS DOUBLE) + {_adjacent('mask', q)}{bonus}, CAST(0.96 AS DOUBLE)) END"


def sequential_score(q: str) -> str:
    at = [" + ".join([_skip("path_lc", q, j) for j in range(k + 1)] + [str(k)]) for k in range(len(q))]
    total = " + ".join(f"({a})" for a in at)
    span = f"(({at[-1]}) - ({at[0]}) + 1 - {len(q)})"
    return f"""CASE WHEN regexp_matches(path_lc, {_re(q)}) THEN least(greatest(CAST(0.70 AS DOUBLE) + {_adjacent('path_lc', q)}
      + CAST({total} AS DOUBLE) / {len(q)}.0 / length(path_lc) * CAST(0.10 AS DOUBLE) - CAST({span} AS DOUBLE) / length(path_lc) * CAST(0.10 AS DOUBLE), CAST(0.50 AS DOUBLE)), CAST(0.88 AS DOUBLE)) END"""


def boost(scope: str | None) -> str:
    if scope is None:
        return "0"
    s = quote(scope)
    return f"CASE WHEN path = {s} OR starts_with(path, {s} || '/') THEN 120 - least(greatest(depth - {scope.count('/') + 1}, 0), 20) ELSE 0 END"


def search(q: str, limit: int, *, table: str = "fx", where: str = "true", scope: str | None = None, post: str = "true") -> str:
    """CTEs ``scored`` and ``ranked`` and their result; needs the table's own CTEs before."""
    t = quote(q.lower())
    text = f"(contains(name_lc, {t}) OR contains(path_lc, {t}))"
    if is_literal(q) or not q:
        score = f"CASE WHEN {text} THEN {name_score(q.lower())} END"
    else:
        score = f"CASE WHEN {text} THEN {name_score(q.lower())} ELSE CAST(coalesce({component_score(q.lower())}, {camel_score(q.lower())}, {sequential_score(q.lower())}) AS FLOAT) END"
    return f"""
matched AS (SELECT *, {INITIALS} AS initials, {MASK} AS mask FROM {table} WHERE {where}),
scored AS (SELECT * FROM (SELECT *, {score} AS score, context + {boost(scope)} AS place FROM matched) WHERE score IS NOT NULL),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, place DESC, mtime DESC, depth, path) AS INTEGER) AS rank FROM scored QUALIFY rank <= {limit})
SELECT rank, path, name, round(CAST(score AS DOUBLE), 6) AS score, size, mtime FROM ranked WHERE {post}"""
