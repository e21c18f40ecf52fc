"""Queries on the files table: search, filters, index, recency, usage, content, groups, changes, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pathloom.config import Config
from pathloom.engine import Engine
from pathloom.functions import display
from pathloom.functions.paths import depth, excluded, in_subtree, in_subtree_range
from pathloom.functions.ranking import abbreviation, camel_score, component_score, context_score, is_subsequence, sequential_score
from pathloom.operators import changes, content, evaluation, grouping, index, usage
from pathloom.operators.search import Request, recent, search, search_dsl, search_many, touched
from pathloom.queries import sqltext as q
from pathloom.session import shared_folder, table
from pathloom.sources import fswalk, tables
from pathloom.sources.store import SnapshotStore
from pathloom.streaming.apply import apply_to_store, journal_stream

NOW = 1_706_745_600  # after the last event of the events table
SCOPE = "/vol/amber00/work"
EXCLUSIONS = ["out", "*.po", "cach*", "/vendor", "a*b", "*"]
SIX = "round(CAST(score AS DOUBLE), 6) AS score"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _fx(spark: SparkSession, d: str) -> DataFrame:
    return index.build(tables.files(spark, d))


def _px(spark: SparkSession, d: str) -> DataFrame:
    return index.build(tables.parts(spark, d))


def _six(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round(F.col("score").cast("double"), 6))


def _find(name: str, term: str, limit: int, sql: str, base: str = "fx", **options) -> None:
    """Register a search by keyword options of Request with its SQL."""

    def fn(spark: SparkSession, d: str) -> DataFrame:
        return _six(search(_fx(spark, d) if base == "fx" else _px(spark, d), Request(term, limit, **options)))

    fn.__name__ = name
    query(f"WITH {q.FILES if base == 'fx' else q.PARTS}, {sql}")(fn)


_under = f"(path = '{SCOPE}' OR starts_with(path, '{SCOPE}/'))"

# --- search -------------------------------------------------------------------------------------
_find("search_substring", "chunk", 50, q.search("chunk", 50))
_find("search_literal", "notes.", 50, q.search("notes.", 50))
_find("search_indexed_mode", "umbra", 50, q.search("umbra", 50, where="contains(name_lc, 'umb') AND contains(name_lc, 'mbr') AND contains(name_lc, 'bra')"), mode="indexed")
_find(
    "search_candidate_cap", "layout", 20,
    "capped AS (SELECT * FROM fx WHERE contains(name_lc, 'lay') AND contains(name_lc, 'ayo') AND contains(name_lc, 'you') AND contains(name_lc, 'out') ORDER BY file_id LIMIT 100), " + q.search("layout", 20, table="capped"),
    mode="indexed", candidate_cap=100,
)
_find(
    "search_exact_name", "layout.toml", 20,
    """ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY mtime DESC, depth, path) AS INTEGER) AS rank FROM fx WHERE name_lc = 'layout.toml' QUALIFY rank <= 20)
SELECT rank, path, name, CAST(1.0 AS DOUBLE) AS score, size, mtime FROM ranked""",
    exact_first=True,
)
_find("search_scoped", "strings", 50, q.search("strings", 50, where=_under), filter_scope=SCOPE)
_find("search_scope_boost", "module", 50, q.search("module", 50, scope=SCOPE), boost_scope=SCOPE)
_find("search_blank", "", 50, q.search("", 50))
_find("search_unicode", "Über", 50, q.search("Über", 50))
_find("search_path_only", "archive/", 50, q.search("archive/", 50))
_find("search_context", "small_gear", 50, q.search("small_gear", 50, table="px"), base="px")
_find("search_dirs_only", "models", 50, q.search("models", 50, where="is_dir"), dirs_only=True)


def _bounded(name: str, term: str, limit: int, bounds: tuple[int, int, int]) -> None:
    most, after, empty = bounds
    _find(
        name, term, limit,
        f"""numbered AS (SELECT *, row_number() OVER (ORDER BY file_id) - 1 AS pos FROM fx QUALIFY pos < {most}),
seen AS (SELECT *, coalesce(sum(CASE WHEN contains(name_lc, '{term}') OR contains(path_lc, '{term}') THEN 1 ELSE 0 END) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM numbered),
bounded AS (SELECT * FROM seen QUALIFY NOT bool_or((before >= {limit} AND pos >= {after}) OR (before = 0 AND pos >= {empty})) OVER (ORDER BY file_id)), """ + q.search(term, limit, table="bounded"),
        scan_bounds=bounds,
    )


# bounds small enough to act on the test tables: rows once the limit is reached, rows at all, rows without a match
_bounded("search_short_bounded", "o_", 20, (2_000, 900, 200))
_bounded("search_short_rows", "1", 1_000, (500, 400, 200))
_bounded("search_short_empty", "a.", 20, (2_000, 900, 200))


@query(
    f"""WITH {q.FILES}, asked AS (SELECT query_id, lower(term) AS t, max(result_limit) AS n FROM search_queries WHERE term <> '' AND result_limit > 0 GROUP BY 1, 2),
terms AS (SELECT t, max(n) AS most FROM asked GROUP BY 1),
hits AS (SELECT t, most, path, {q.name_score("t", quoted=False)} AS score, context, mtime, depth FROM fx JOIN terms ON contains(name_lc, t) OR contains(path_lc, t)),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY t ORDER BY score DESC, context DESC, mtime DESC, depth, path) AS INTEGER) AS rank FROM hits QUALIFY rank <= most)
SELECT query_id, rank, path, round(CAST(score AS DOUBLE), 6) AS score FROM asked JOIN best USING (t) WHERE rank <= n"""
)
def search_many_terms(spark: SparkSession, d: str) -> DataFrame:
    """The substring matches alone and without scopes, as the SQL has them; :func:`search_many_requests` answers the whole table."""
    return _six(search_many(_fx(spark, d), table(spark, d, "search_queries"), query_id="query_id", term="term", limit="result_limit", abbreviations=False))


@query(None)
def search_many_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every request with its scopes, and abbreviations; tested against single searches."""
    return _six(search_many(_fx(spark, d), table(spark, d, "search_queries"), query_id="query_id", term="term", limit="result_limit", filter_scope="filter_scope", boost_scope="boost_scope"))


@query(
    f"""WITH {q.FILES}, scopes AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:4], '/') AS s FROM fx)
SELECT s AS scope, count(*) AS files FROM scopes JOIN fx ON path = s OR starts_with(path, s || '/') GROUP BY 1"""
)
def scope_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Files below every third-level directory: an equality on the path's own prefixes stands for the range join."""
    fx = _fx(spark, d).withColumn("parts", F.split("path", "/"))
    prefix = F.array_join(F.slice("parts", 1, 4), "/")
    return fx.select(prefix.alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {q.FILES} SELECT path, size FROM fx WHERE path = '/vol/birch00/work' OR starts_with(path, '/vol/birch00/work/')")
def scope_range(spark: SparkSession, d: str) -> DataFrame:
    return _fx(spark, d).where(in_subtree_range(F.col("path"), "/vol/birch00/work")).select("path", "size")


@query(
    f"""WITH {q.FILES}, p AS (SELECT path FROM fx UNION ALL SELECT replace(path, '/work/', '/work-x/') FROM fx UNION ALL SELECT replace(path, '/work/', '/work.c/') FROM fx)
SELECT path, count(*) AS files FROM p WHERE path = '{SCOPE}' OR starts_with(path, '{SCOPE}/') GROUP BY 1"""
)
def search_sibling_prefix(spark: SparkSession, d: str) -> DataFrame:
    """A subtree among siblings whose names begin with its own and sort between it and what lies below it; tested both ways."""
    fx = _fx(spark, d).select("path")
    siblings = [fx.select(F.replace("path", F.lit("/work/"), F.lit(f"/work{end}/")).alias("path")) for end in ("-x", ".c")]
    rows = fx.unionByName(siblings[0]).unionByName(siblings[1])
    return rows.where(in_subtree(F.col("path"), SCOPE) & in_subtree_range(F.col("path"), SCOPE)).groupBy("path").agg(F.count(F.lit(1)).alias("files"))


# --- abbreviations ------------------------------------------------------------------------------
def _abbr(name: str, term: str, column: str, sql: str, base: str = "fx") -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        fx = _fx(spark, d) if base == "fx" else _px(spark, d)
        score = {"component": lambda: component_score("initials", term), "camel": lambda: camel_score("mask", term.lower(), "path" if term.isupper() else None), "sequential": lambda: sequential_score("path_lc", term)}[column]()
        return fx.select("path", F.round(score, 6).alias("score")).where("score is not null")

    fn.__name__ = name
    query(f"WITH {q.FILES if base == 'fx' else q.PARTS}, m AS (SELECT *, {q.INITIALS} AS initials, {q.MASK} AS mask FROM {base}) SELECT path, round({sql}, 6) AS score FROM m WHERE score IS NOT NULL")(fn)


_abbr("abbr_component_first", "vaw", "component", q.component_score("vaw"))
_abbr("abbr_camel", "vsc", "camel", q.camel_score("vsc"))
_abbr("abbr_camel_capitals", "PB", "camel", q.camel_score("pb", "PB"), base="px")
_abbr("abbr_sequential", "amber", "sequential", q.sequential_score("amber"))


@query(
    f"""WITH {q.FILES}, m AS (SELECT *, {q.INITIALS} AS initials, {q.MASK} AS mask,
  CASE WHEN regexp_matches(name_lc, '(?s)^.+\\.[^.]*$') THEN regexp_extract(name_lc, '(?s)^(.+)\\.[^.]*$', 1) ELSE name_lc END AS stem FROM fx),
s AS (SELECT path, coalesce(CASE WHEN stem = 'mem' THEN 1.0 WHEN starts_with(stem, 'mem') THEN 0.99 WHEN len(list_filter(string_split(path_lc, '/'), lambda c: starts_with(c, 'mem'))) > 0 THEN 0.98 END, -1.0) AS a,
  coalesce({q.component_score("mem")}, -1.0) AS b, coalesce({q.camel_score("mem")}, -1.0) AS c, coalesce({q.sequential_score("mem")}, -1.0) AS e FROM m)
SELECT path, CASE greatest(a, b, c, e) WHEN a THEN 'exact_prefix' WHEN b THEN 'component_first' WHEN c THEN 'camel_case' ELSE 'sequential' END AS strategy, round(CAST(greatest(a, b, c, e) AS DOUBLE), 6) AS score
FROM s WHERE greatest(a, b, c, e) >= 0"""
)
def abbr_best(spark: SparkSession, d: str) -> DataFrame:
    return _fx(spark, d).select("path", abbreviation("mem").alias("a")).where("a is not null").select("path", "a.strategy", F.round("a.score", 6).alias("score"))


@query(f"WITH {q.FILES} SELECT name, count(*) AS files FROM fx WHERE contains(name_lc, 'lto') OR regexp_matches(name_lc, '(?s)l.*t.*o') GROUP BY 1")
def fuzzy_filter(spark: SparkSession, d: str) -> DataFrame:
    return _fx(spark, d).where(is_subsequence(F.col("name_lc"), "lto")).groupBy("name").agg(F.count(F.lit(1)).alias("files"))


# --- filters ------------------------------------------------------------------------------------
def _filtered(name: str, raw: str, where: str) -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        from pathloom.plans.dsl import parse

        out = _fx(spark, d)
        for p in parse(raw, 1_740_000_000).predicates():
            out = out.where(p)
        return out.select("path", "size", "mtime")

    fn.__name__ = name
    query(f"WITH {q.FILES} SELECT path, size, mtime FROM fx WHERE {where}")(fn)


_ext = q.extension("string_split(path, '/')[-1]")
_filtered("filter_ext", "ext:.TOML,po", f"{_ext} IN ('po', 'toml')")
_filtered("filter_path", "path:/Work/ path:out", "contains(path_lc, '/work/') AND contains(path_lc, 'out')")
_filtered("filter_mtime", "mtime:<30d", "mtime > 1740000000 - 2592000")
_filtered("filter_mtime_date", "mtime:>=2024-07-01", "mtime >= 1719792000")
_filtered("filter_size", "size:>10kb", "size > 10240")
_filtered("filter_type", "type:dir", "is_dir")
_LINE = "layout ext:c,toml size:>500 mtime:>2020-01-01"
_WHERE = f"{_ext} IN ('c', 'toml') AND mtime > 1577836800 AND size > 500"


@query(f"WITH {q.FILES}, {q.search('layout', 40, where=_WHERE)}")
def filters_pre_limit(spark: SparkSession, d: str) -> DataFrame:
    return _six(search_dsl(_fx(spark, d), _LINE, now=0, limit=40))


@query(f"WITH {q.FILES}, {q.search('layout', 40, post=_WHERE)}")
def filters_post_limit(spark: SparkSession, d: str) -> DataFrame:
    return _six(search_dsl(_fx(spark, d), _LINE, now=0, limit=40, filter_stage="post"))


# --- index --------------------------------------------------------------------------------------
_GRAMS = f"""WITH {q.FILES}, b AS (SELECT file_id, encode(name_lc) AS raw, strlen(name_lc) AS n FROM fx),
g AS (SELECT DISTINCT file_id, ('0x' || hex(raw[i:i+2]))::INTEGER AS trigram FROM (SELECT file_id, raw, unnest(range(1, n - 1)) AS i FROM b WHERE n >= 3))"""


@query(_GRAMS + " SELECT trigram, count(*) AS files, min(file_id) AS first_id, max(file_id) AS last_id FROM g GROUP BY 1")
def trigram_postings(spark: SparkSession, d: str) -> DataFrame:
    return index.grams(tables.files(spark, d)).groupBy("trigram").agg(F.count(F.lit(1)).alias("files"), F.min("file_id").alias("first_id"), F.max("file_id").alias("last_id"))


@query(f"WITH {q.FILES} SELECT file_id FROM fx WHERE contains(name_lc, 'mod') AND contains(name_lc, 'odu') AND contains(name_lc, 'dul') AND contains(name_lc, 'ule')")
def trigram_intersect(spark: SparkSession, d: str) -> DataFrame:
    return index.candidates(index.grams(tables.files(spark, d)), "module")


@query(_GRAMS + " SELECT count(DISTINCT trigram) AS trigrams FROM g")
def trigram_count(spark: SparkSession, d: str) -> DataFrame:
    return index.trigram_count(tables.files(spark, d))


@query(f"WITH {q.FILES}, {q.PARTS} SELECT context, count(*) AS files FROM (SELECT context FROM fx UNION ALL SELECT context FROM px) GROUP BY 1")
def context_scores(spark: SparkSession, d: str) -> DataFrame:
    both = tables.files(spark, d).select("path", "name").unionByName(tables.parts(spark, d).select("path", "name"))
    return both.where("name <> ''").groupBy(context_score(F.lower("path")).alias("context")).agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {q.FILES} SELECT depth, count(*) AS files FROM fx GROUP BY 1")
def path_depths(spark: SparkSession, d: str) -> DataFrame:
    return tables.files(spark, d).where("name <> ''").groupBy(depth(F.col("path")).alias("depth")).agg(F.count(F.lit(1)).alias("files"))


@query(
    f"""WITH {q.FILES} SELECT path FROM fx
WHERE len(list_filter(string_split(path, '/'), lambda c: c <> '' AND (c = 'out' OR ends_with(c, '.po') OR starts_with(c, 'cach') OR c = 'vendor'))) = 0"""
)
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    return tables.files(spark, d).where("name <> ''").where(~excluded(F.col("path"), EXCLUSIONS)).select("path")


@query(
    f"""WITH {q.FILES}, s AS (SELECT count(*) AS files, count(*) FILTER (is_dir) AS dirs, CAST(sum(strlen(path) + strlen(name)) AS BIGINT) AS arena_bytes, CAST(sum(size) AS BIGINT) AS total_bytes, max(mtime) AS newest FROM fx)
SELECT *, arena_bytes // files AS arena_bytes_per_file, total_bytes // files AS bytes_per_file FROM s"""
)
def status(spark: SparkSession, d: str) -> DataFrame:
    return index.status(tables.files(spark, d).where("name <> ''"))


# --- recency ------------------------------------------------------------------------------------
def _recent_sql(where: str, table_: str = "fx") -> str:
    return f"""ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY mtime DESC, file_id) AS INTEGER) AS rank FROM {table_} WHERE {where} QUALIFY rank <= 100)
SELECT rank, path, name, CAST(0.0 AS DOUBLE) AS score, size, mtime FROM ranked"""


_SHOWN = ("rank", "path", "name", "score", "size", "mtime")


@query(f"WITH {q.FILES}, {_recent_sql('true')}")
def recent_files(spark: SparkSession, d: str) -> DataFrame:
    return _six(search(_fx(spark, d), Request("", 100, recent_if_empty=True)))


@query(f"WITH {q.FILES}, {_recent_sql(_under)}")
def recent_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _six(recent(_fx(spark, d), Request("", 100, filter_scope=SCOPE))).select(*_SHOWN)


@query(
    f"""WITH {q.FILES}, ring AS (SELECT file_id, file_id AS u FROM fx WHERE is_dir ORDER BY u DESC LIMIT 64),
picked AS (SELECT fx.* FROM fx LEFT JOIN ring USING (file_id) ORDER BY u DESC NULLS LAST, mtime DESC, file_id LIMIT 100), {_recent_sql("true", "picked")}"""
)
def recent_touched(spark: SparkSession, d: str) -> DataFrame:
    fx = _fx(spark, d)
    updates = fx.where("is_dir").select("file_id", F.col("file_id").alias("update_seq"))
    return _six(touched(fx, updates, 100, ring=64)).select(*_SHOWN)


# --- usage --------------------------------------------------------------------------------------
_USED = f"WITH {q.PARTS}, {q.USAGE}"
_LISTED = f"listed AS (SELECT *, {q.frecency(NOW)} AS frecency FROM used)"


def _used(spark: SparkSession, d: str) -> DataFrame:
    return usage.aggregate(tables.usage_events(spark, d))


@query(f"{_USED} SELECT * FROM used")
def usage_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _used(spark, d)


@query(f"{_USED}, {_LISTED} SELECT path, total_count, last_used, frecency FROM listed WHERE contains(lower(path), 'small') ORDER BY frecency DESC, last_used DESC, total_count DESC, path LIMIT 50")
def usage_list(spark: SparkSession, d: str) -> DataFrame:
    return usage.listing(_used(spark, d), now=NOW, query=" Small ", limit=50).select("path", "total_count", "last_used", "frecency")


@query(f"{_USED}, {_LISTED} SELECT path, frecency FROM listed WHERE starts_with(path, '/Projects/Brand-4/') ORDER BY frecency DESC, last_used DESC, total_count DESC, path LIMIT 50")
def usage_list_scoped(spark: SparkSession, d: str) -> DataFrame:
    return usage.listing(_used(spark, d), now=NOW, scope="/Projects/Brand-4", limit=50).select("path", "frecency")


@query(f"{_USED} SELECT path, last_used, total_count FROM used ORDER BY last_used DESC, total_count DESC, path LIMIT 500")
def usage_prune(spark: SparkSession, d: str) -> DataFrame:
    return usage.prune(_used(spark, d), 500).select("path", "last_used", "total_count")


@query(
    f"""WITH {q.PARTS}, {q.USAGE}, gone AS (SELECT path, max(seq) AS upto FROM uses WHERE action = 'print' GROUP BY path)
SELECT uses.path, count(*) AS total_count, max(ts) AS latest FROM uses LEFT JOIN gone USING (path) WHERE upto IS NULL OR seq > upto GROUP BY 1"""
)
def usage_forget(spark: SparkSession, d: str) -> DataFrame:
    events = tables.usage_events(spark, d)
    left = usage.forget(events, events.where("action = 'print'").select("path", "seq"))
    return left.groupBy("path").agg(F.count(F.lit(1)).alias("total_count"), F.max("ts").alias("latest"))


@query(f"{_USED} SELECT path, name, round(CAST(CAST(least(total_count, 100) AS FLOAT) / CAST(100 AS FLOAT) AS DOUBLE), 6) AS score, CAST(0 AS BIGINT) AS size, last_used AS mtime FROM used")
def usage_results(spark: SparkSession, d: str) -> DataFrame:
    return _six(usage.as_results(_used(spark, d)))


@query(
    f"""{_USED}, {_LISTED}, {q.search("widget", 80, table="px").split("SELECT rank, path")[0].rstrip()},
gained AS (SELECT r.*, round(CAST(r.score AS DOUBLE) + coalesce(least(greatest(frecency_raw * 0.08, 0.0), 0.08), 0.0), 6) AS b
  FROM ranked r LEFT JOIN (SELECT path, {q.frecency(NOW).replace("round(", "(", 1).rsplit(", 6)", 1)[0]}) AS frecency_raw FROM used) u USING (path)),
final AS (SELECT *, CAST(row_number() OVER (ORDER BY b DESC, rank) AS INTEGER) AS r2 FROM gained QUALIFY r2 <= 20)
SELECT r2 AS rank, path, name, round(least(b, 1.0), 6) AS score, size, mtime FROM final"""
)
def usage_boosted_search(spark: SparkSession, d: str) -> DataFrame:
    return _six(search(_px(spark, d), Request("widget", 20), usage=_used(spark, d), now=NOW))


# --- content ------------------------------------------------------------------------------------
_DIRS = "(" + ", ".join(q.quote(x) for x in content.SKIPPED_DIRS) + ")"
_TEXTS = """texts AS (SELECT '/docs/' || coalesce(trim(string_split(source, '/')[1]), 'none') || '/doc_' || doc_id || '.txt' AS path, text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT path, CAST(i AS INTEGER) AS line_number, regexp_replace(parts[i], '\\r$', '') AS line, text
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS parts FROM texts WHERE text <> '' AND NOT contains(text, chr(0)))))"""


@query(f"WITH {_TEXTS} SELECT path, line_number, CAST(strlen(string_split(lower(line), 'watcher')[1]) + 1 AS INTEGER) AS \"column\", line FROM lines WHERE contains(lower(line), 'watcher') AND strlen(text) <= 4096")
def grep_smart_case(spark: SparkSession, d: str) -> DataFrame:
    return content.search(tables.texts(spark, d), "watcher", max_bytes=4_096)


@query(f"WITH {_TEXTS} SELECT path, line_number, CAST(strlen(string_split(line, 'Nobody expects')[1]) + 1 AS INTEGER) AS \"column\", line FROM lines WHERE contains(line, 'Nobody expects')")
def grep_columns(spark: SparkSession, d: str) -> DataFrame:
    return content.search(tables.texts(spark, d), "Nobody expects", mode="git-grep")


@query(f"WITH {_TEXTS} SELECT path, line_number, CAST(NULL AS INTEGER) AS \"column\", line FROM lines WHERE contains(line, 'The ') AND len(list_filter(string_split(path, '/')[1:-2], lambda c: c IN {_DIRS})) = 0")
def grep_literal(spark: SparkSession, d: str) -> DataFrame:
    return content.search(tables.texts(spark, d), "The ", mode="grep")


@query(
    f"""WITH {_TEXTS}, top AS (SELECT path, line_number, line, text, row_number() OVER (ORDER BY path, line_number) - 1 AS i FROM lines WHERE contains(lower(line), 'trigram') AND strlen(text) <= 2097152 QUALIFY i < 100),
shown AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t, count(*) OVER () AS total FROM top)
SELECT CAST(i + 1 AS INTEGER) AS rank, path, string_split(path, '/')[-1] || ':' || line_number || ':' || (strlen(string_split(lower(line), 'trigram')[1]) + 1) || '  ' ||
  CASE WHEN length(t) > 96 THEN t[1:96] || '...' ELSE t END AS name,
  round(CAST(greatest(CAST(0.01 AS FLOAT), CAST(1.0 AS FLOAT) - CAST(CAST(i AS FLOAT) / CAST(total AS FLOAT) AS FLOAT) * CAST(0.25 AS FLOAT)) AS DOUBLE), 6) AS score,
  CAST(strlen(text) AS BIGINT) AS size, CAST(coalesce(floor(epoch(created_at)), 0) AS BIGINT) AS mtime
FROM shown JOIN (SELECT doc_id, created_at FROM documents) ON path LIKE '%/doc_' || doc_id || '.txt'"""
)
def grep_rows(spark: SparkSession, d: str) -> DataFrame:
    return _six(content.as_results(content.search(tables.texts(spark, d), "trigram"), 100, tables.text_files(spark, d)))


@query(f"WITH {_TEXTS} SELECT path, line_number, CAST(strlen(string_split(lower(line), 'index')[1]) + 1 AS INTEGER) AS \"column\", line FROM lines WHERE contains(lower(line), 'index') AND strlen(text) <= 2097152 AND starts_with(path, '/docs/forum/')")
def grep_scoped(spark: SparkSession, d: str) -> DataFrame:
    return content.search(tables.texts(spark, d), "index", scope="/docs/forum/")


@query(f"WITH {_TEXTS}, few AS (SELECT path FROM texts WHERE NOT contains(text, chr(0)) ORDER BY path LIMIT 300) SELECT path, line_number, CAST(NULL AS INTEGER) AS \"column\", line FROM lines JOIN few USING (path) WHERE contains(line, 'The ')")
def grep_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The bounded fallback, with a bound small enough to act here."""
    return content.search(tables.texts(spark, d), "The ", mode="grep", max_files=300)


@query(
    f"""WITH {_TEXTS} SELECT path, line_number, CAST(strlen(string_split(lower(line), 'index')[1]) + 1 AS INTEGER) AS "column", line FROM lines
WHERE contains(lower(line), 'index') AND strlen(text) <= 2097152 AND NOT starts_with(path, '/docs/mail/') AND NOT (regexp_matches(path, '^/docs/wiki/doc_[^/]*1\\.txt$') AND NOT regexp_matches(path, '11\\.txt$'))"""
)
def grep_ignored(spark: SparkSession, d: str) -> DataFrame:
    """Ignore files of two directories, one with an exception."""
    rules = [("/docs/.gitignore", "mail/\n"), ("/docs/wiki/.ignore", "doc_*1.txt\n!*11.txt\n")]
    return content.search(tables.texts(spark, d), "index", ignore=rules)


@query(f"WITH {_TEXTS} SELECT path, line_number, 7 AS \"column\", line FROM lines")
def grep_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every line written as ``path:line:7:text`` and read again."""
    made = content.lines(tables.texts(spark, d).where(~F.contains("text", F.lit("\0")))).select(F.concat_ws(":", "path", F.col("line_number").cast("string"), F.lit("7"), "line").alias("l"))
    return made.select(content.parse_match(F.col("l")).alias("m")).select("m.*")


# --- groups and display -------------------------------------------------------------------------
def _grouped(name: str, label, sql: str) -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        found = search(_fx(spark, d), Request("clip", 200))
        return grouping.group_runs(found, label(F.col("path"))).select("rank", "path", "label", "header", "run")

    fn.__name__ = name
    found = q.search("clip", 200).split("SELECT rank, path")[0].rstrip()
    query(
        f"""WITH {q.FILES}, {found}, named AS (SELECT rank, path, {sql} AS label FROM ranked), marked AS (SELECT *, coalesce(label <> lag(label) OVER (ORDER BY rank), true) AS header FROM named)
SELECT rank, path, label, header, CAST(sum(CASE WHEN header THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS BIGINT) AS run FROM marked"""
    )(fn)


_grouped("group_by_dir", display.directory_label, f"'dir: ' || regexp_replace({q.parent('path')}, '/+$', '') || '/'")
_grouped("group_by_ext", display.extension_label, f"CASE WHEN {_ext} = '' THEN 'ext: (none)' ELSE 'ext: ' || {_ext} END")


@query(
    f"""WITH {q.FILES} SELECT path, CASE WHEN length(path) <= 40 THEN path ELSE path[1:20] || '...' || right(path, 17) END AS short, CASE WHEN starts_with(path, '/vol/amber00/') THEN '~' || path[13:] ELSE path END AS home,
  {q.parent("path")} AS parent FROM fx"""
)
def display_paths(spark: SparkSession, d: str) -> DataFrame:
    from pathloom.functions.paths import parent

    p = F.col("path")
    return _fx(spark, d).select("path", display.middle_ellipsis(p, 40).alias("short"), display.tilde(p, "/vol/amber00").alias("home"), parent(p).alias("parent"))


@query(f"WITH {q.FILES}, g AS (SELECT DISTINCT {q.parent('path')} AS directory, name || CASE WHEN is_dir THEN '/' ELSE '' END AS entry FROM fx) SELECT directory, count(*) AS entries, min(entry) AS first FROM g GROUP BY 1")
def directory_sizes(spark: SparkSession, d: str) -> DataFrame:
    from pathloom.functions.paths import parent

    entries = tables.files(spark, d).where("name <> ''").select(parent(F.col("path")).alias("directory"), F.concat("name", F.when(F.col("is_dir"), "/").otherwise("")).alias("entry")).distinct()
    return entries.groupBy("directory").agg(F.count(F.lit(1)).alias("entries"), F.min("entry").alias("first"))


@query(f"WITH {q.FILES} SELECT path FROM (SELECT DISTINCT path FROM fx WHERE is_dir AND starts_with(path_lc, '/vol/am')) ORDER BY path LIMIT 10")
def scope_completion(spark: SparkSession, d: str) -> DataFrame:
    return grouping.complete_scope(tables.files(spark, d).where("name <> ''"), "/VOL/am")


@query(f"WITH {q.FILES} SELECT path, size FROM fx ORDER BY size DESC, path LIMIT 100")
def largest_files(spark: SparkSession, d: str) -> DataFrame:
    return grouping.largest(_fx(spark, d), 100)


# --- the engine's views and its stored index ----------------------------------------------------
def _engine(spark: SparkSession, d: str) -> Engine:
    return Engine(spark, tables.files(spark, d), texts=tables.texts(spark, d))


@query(f"WITH {q.FILES} SELECT path, size FROM fx WHERE {_ext} IN ('toml', 'c') AND {_under} ORDER BY size DESC, path LIMIT 50")
def view_large_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).search("ext:toml,c", view="large", scope=SCOPE, limit=50, now=0)


@query(
    f"""WITH {q.FILES}, ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY mtime DESC, depth, path) AS INTEGER) AS rank FROM fx WHERE name_lc = 'layout.toml' AND size > 100 QUALIFY rank <= 20)
SELECT rank, path, name, CAST(1.0 AS DOUBLE) AS score, size, mtime FROM ranked"""
)
def view_exact_first(spark: SparkSession, d: str) -> DataFrame:
    return _six(_engine(spark, d).search("layout.toml size:>100", exact_first=True, limit=20, now=0))


@query(f"WITH {q.FILES}, {q.search('module', 50, where=_ext + chr(61) + q.quote('toml'), scope=SCOPE)}")
def view_boosted(spark: SparkSession, d: str) -> DataFrame:
    """A place that boosts without filtering."""
    return _six(_engine(spark, d).search("module ext:toml", boost=SCOPE, limit=50, now=0))


@query(
    f"""WITH {q.FILES}, s AS (SELECT CAST(sum(strlen(path) + strlen(name)) AS BIGINT) AS arena_bytes FROM fx), {_GRAMS.split(", b AS", 1)[1].join(("b AS", ""))},
i AS (SELECT CAST(count(*) * 4 + count(DISTINCT trigram) * 4 AS BIGINT) AS index_bytes FROM g) SELECT arena_bytes, index_bytes, round(index_bytes / arena_bytes, 6) AS index_ratio FROM s, i"""
)
def index_sizes(spark: SparkSession, d: str) -> DataFrame:
    return index.index_sizes(tables.files(spark, d).where("name <> ''"))


@query(f"WITH {q.FILES}, {q.search('notes.', 50)}")
def stored_search(spark: SparkSession, d: str) -> DataFrame:
    """Save the index, open it again and search what is stored."""
    folder = shared_folder(spark, "index")
    Engine(spark, tables.files(spark, d), config=Config(index_path=folder)).save()
    return _six(Engine.open(spark, Config(index_path=folder)).search("notes.", limit=50, now=0))


@query(f"WITH {q.FILES} SELECT name || CASE WHEN is_dir THEN '/' ELSE '' END AS entry FROM fx WHERE {q.parent('path')} = (SELECT min({q.parent('path')}) FROM fx) GROUP BY 1 ORDER BY 1 LIMIT 5")
def directory_entries(spark: SparkSession, d: str) -> DataFrame:
    from pathloom.functions.paths import parent

    fx = _fx(spark, d)
    return grouping.directory_listing(fx, fx.agg(F.min(parent(F.col("path")))).first()[0] or "/", limit=5)


@query(f"WITH {_TEXTS}, longest AS (SELECT path FROM lines GROUP BY 1 ORDER BY count(*) DESC, path LIMIT 1) SELECT line_number, line AS raw FROM lines JOIN longest USING (path) WHERE line_number <= 50")
def file_preview_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 lines of the text with the most, before they are made printable."""
    rows = content.lines(tables.texts(spark, d).where(~F.contains("text", F.lit("\0"))))
    top = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").first()
    shown = grouping.file_preview(rows, top.path if top else "", 50).select("line_number")
    return rows.where(F.col("path") == (top.path if top else "")).join(shown, "line_number").select("line_number", F.col("line").alias("raw"))


@query("SELECT view_name || '.parquet' AS name FROM duckdb_views() WHERE NOT internal")
def fs_walk(spark: SparkSession, d: str) -> DataFrame:
    """The folder of the tables itself, walked."""
    return fswalk.scan(spark, [d], [], False).where("name like '%.parquet' and name not like 'part-%'").select("name")


# --- changes ------------------------------------------------------------------------------------
_SEQ = "CAST(journal_epoch AS BIGINT) * 1099511627776 + seq"
_ONCE = "once AS (SELECT * FROM index_updates WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY journal_epoch, seq ORDER BY arrived_at DESC) = 1)"


@query(
    f"""WITH {_ONCE} SELECT {_SEQ} AS seq, CASE kind WHEN 'CreateOrModify' THEN 'Create' ELSE kind END AS kind, path, CASE WHEN kind = 'Move' THEN from_path END AS from_path
FROM once WHERE path IS NOT NULL AND (kind <> 'Move' OR from_path IS NOT NULL)"""
)
def journal_parse(spark: SparkSession, d: str) -> DataFrame:
    """The updates written as journal lines, with broken and blank lines between them, and parsed."""
    u = tables.updates(spark, d)
    only = lambda kind, value: F.when(F.col("kind") == kind, value)
    line = F.to_json(F.struct(only("CreateOrModify", F.struct("path")).alias("Create"), only("Delete", F.struct("path")).alias("Delete"), only("Move", F.struct(F.col("from_path").alias("from"), F.col("path").alias("to"))).alias("Move")))
    lines = u.select("seq", F.explode(F.array(line, F.concat(F.lit("{"), line), F.lit(""))).alias("value"))
    return changes.parse_journal(lines)


@query(
    f"""WITH {_ONCE}, touches AS (
  SELECT from_path AS path, {_SEQ} AS seq, 0 AS sub, false AS writes, NULL AS size, NULL AS mtime FROM once WHERE kind = 'Move'
  UNION ALL SELECT path, {_SEQ}, 0, false, NULL, NULL FROM once WHERE kind = 'Delete'
  UNION ALL SELECT path, {_SEQ}, 1, true, size, mtime FROM once WHERE kind <> 'Delete' AND path IS NOT NULL),
last AS (SELECT * FROM touches WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC, sub DESC) = 1)
SELECT path, size, mtime FROM last WHERE writes"""
)
def journal_last_state(spark: SparkSession, d: str) -> DataFrame:
    none = tables.files(spark, d).where("false")
    return changes.last_state(none, tables.updates(spark, d)).select("path", "size", "mtime")


@query(f"WITH {_ONCE} SELECT dev, ino, path, {_SEQ} AS seq FROM once WHERE path IS NOT NULL AND ino IS NOT NULL AND NOT (dev = 0 AND ino = 0) QUALIFY row_number() OVER (PARTITION BY dev, ino ORDER BY {_SEQ} DESC) = 1")
def identity_latest(spark: SparkSession, d: str) -> DataFrame:
    u = tables.updates(spark, d).where("path is not null and ino is not null").select("dev", "ino", "path", "seq")
    return changes.latest_by(u, ["dev", "ino"], "seq")


@query(
    f"""WITH {_ONCE}, e AS (SELECT {_SEQ} AS seq, seq % 4 AS k, path, from_path, kind FROM once)
SELECT seq, 'Create' AS kind, path, NULL AS from_path FROM e WHERE kind = 'CreateOrModify' AND path IS NOT NULL
UNION ALL SELECT seq, 'Delete', path, NULL FROM e WHERE kind = 'Delete'
UNION ALL SELECT seq, 'Move', CASE WHEN k = 1 THEN from_path ELSE path END, CASE WHEN k = 1 THEN path ELSE from_path END FROM e WHERE kind = 'Move' AND path IS NOT NULL AND from_path IS NOT NULL
UNION ALL SELECT seq, CASE WHEN k = 3 THEN 'Delete' ELSE 'Modify' END, from_path, NULL FROM e WHERE kind = 'Move' AND path IS NULL"""
)
def rename_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The updates as raw file-system events of every rename mode, mapped back to updates."""
    u = tables.updates(spark, d)
    k = F.col("seq") % 4
    event = F.when(F.col("kind") == "CreateOrModify", "create").when(F.col("kind") == "Delete", "remove").otherwise("rename")
    ends = F.filter(F.array("from_path", "path"), lambda p: p.isNotNull())
    mode = F.when(F.size(ends) == 2, F.when(k == 0, "both").when(k == 1, "any").otherwise("other")).otherwise(F.when(k == 3, "from").otherwise("any"))
    # an "any" rename whose first path still exists went the other way
    present = F.when((k == 1) & (F.size(ends) == 2), F.array(F.lit(True), F.lit(False))).otherwise(F.transform(ends, lambda p: p == F.col("path")))
    raw = u.select("seq", event.alias("event"), mode.alias("mode"), ends.alias("paths"), present.alias("present"))
    return changes.events_to_updates(raw)


@query(None)
def journal_fold_exact(spark: SparkSession, d: str) -> DataFrame:
    """The exact fold with ids and inode identity, a volume being the second component of a path."""
    files = tables.files(spark, d).where("false")
    volume = F.element_at(F.split("path", "/"), 3)
    ends = tables.updates(spark, d)
    # moves between volumes tie them together, so all of them are one here
    return changes.fold(files, ends, F.when(volume.isNotNull(), "watch").otherwise("watch")).drop("volume")


@query(
    f"""WITH {_ONCE}, r AS (SELECT path, max({_SEQ}) AS update_seq FROM once WHERE kind <> 'Delete' AND path IS NOT NULL GROUP BY 1)
SELECT path, update_seq FROM r ORDER BY update_seq DESC LIMIT 64"""
)
def recency_ring(spark: SparkSession, d: str) -> DataFrame:
    return changes.recency(tables.updates(spark, d), ring=64)


@query(
    f"""WITH {_ONCE}, touches AS (
  SELECT from_path AS path, {_SEQ} AS seq, 0 AS sub, false AS writes, NULL AS size, NULL AS mtime FROM once WHERE kind = 'Move'
  UNION ALL SELECT path, {_SEQ}, 0, false, NULL, NULL FROM once WHERE kind = 'Delete'
  UNION ALL SELECT path, {_SEQ}, 1, true, size, mtime FROM once WHERE kind <> 'Delete' AND path IS NOT NULL),
last AS (SELECT * FROM touches WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC, sub DESC) = 1)
SELECT path, size, mtime, seq AS update_seq FROM last WHERE writes"""
)
def journal_fold_paths(spark: SparkSession, d: str) -> DataFrame:
    """The exact fold without inode identity, where SQL can follow it."""
    files = tables.files(spark, d).where("false")
    return changes.fold(files, tables.updates(spark, d), F.lit("all"), inode_identity=False).select("path", "size", "mtime", "update_seq")


@query(
    f"""WITH {_ONCE}, touches AS (
  SELECT from_path AS path, {_SEQ} AS seq, 0 AS sub, false AS writes, NULL AS size, NULL AS mtime FROM once WHERE kind = 'Move'
  UNION ALL SELECT path, {_SEQ}, 0, false, NULL, NULL FROM once WHERE kind = 'Delete'
  UNION ALL SELECT path, {_SEQ}, 1, true, size, mtime FROM once WHERE kind <> 'Delete' AND path IS NOT NULL),
last AS (SELECT * FROM touches WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC, sub DESC) = 1)
SELECT path, size, mtime FROM last WHERE writes"""
)
def stream_apply(spark: SparkSession, d: str) -> DataFrame:
    """The updates as a stream of three files into the store, whatever order they come in."""
    folder = shared_folder(spark, "stream")
    tables.updates(spark, d).repartition(3).write.json(f"{folder}/journal")
    store = SnapshotStore(f"{folder}/store")
    store.save(tables.files(spark, d).where("false").drop("file_id"))
    stream = apply_to_store(journal_stream(spark, f"{folder}/journal", files_per_trigger=1), store, f"{folder}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()
    return store.load(spark).select("path", "size", "mtime")


@query("WITH a AS (SELECT DISTINCT name AS item FROM arena_names), b AS (SELECT DISTINCT name AS item FROM search_results WHERE name IS NOT NULL), k AS (SELECT item, 0 AS side FROM a UNION ALL SELECT item, 1 FROM b WHERE item NOT IN (SELECT item FROM a)) SELECT item, row_number() OVER (ORDER BY side, item) AS position FROM k")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """Registered names in order, then those that only hits have."""
    own = table(spark, d, "arena_names").select(F.col("name").alias("item"), F.col("name").alias("at"))
    seen = table(spark, d, "search_results").where("name is not null").select(F.col("name").alias("item"), F.col("name").alias("at"))
    return changes.ordered_union(own, seen, "item", "at")


# --- evaluation ---------------------------------------------------------------------------------
EVAL_DEPTH = 100  # fixed: hits of a query that are evaluated, as the reference asks for


_RANKED = """once AS (SELECT DISTINCT hit_id, query_id, path, name, score, mtime FROM search_results WHERE score IS NOT NULL AND NOT isnan(score)),
ranked AS (SELECT query_id AS query, path, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mtime DESC NULLS LAST, path, hit_id) AS rank FROM once QUALIFY rank <= 100),
asked AS (SELECT DISTINCT query_id AS query, lower(term) AS t FROM search_queries),
labels AS (SELECT DISTINCT query, path FROM ranked JOIN asked USING (query) WHERE contains(lower(name), t)),
firsts AS (SELECT query, min(rank) AS first FROM ranked JOIN labels USING (query, path) GROUP BY 1),
judged AS (SELECT query, first FROM (SELECT DISTINCT query FROM asked) LEFT JOIN firsts USING (query))"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_results").where("score is not null and not isnan(score)")
    return hits.groupBy("hit_id").agg(F.max(F.struct("query_id", "score", "mtime", "path", "name")).alias("r")).select("hit_id", "r.*")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_queries").select(F.col("query_id").alias("query"), F.lower("term").alias("t")).distinct()


def _eval(spark: SparkSession, d: str, depth: int = EVAL_DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.col("mtime").desc_nulls_last(), "path", "hit_id")
    ranked = _hits(spark, d).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).select(F.col("query_id").alias("query"), "path", "name", "rank")
    asked = _asked(spark, d)
    labels = ranked.join(asked, "query").where(F.contains(F.lower("name"), F.col("t"))).select("query", "path")
    return ranked, labels, asked


@query(
    f"""WITH {_RANKED} SELECT round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0.0 END), 6) AS mrr10, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1,
  round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit3, count(*) AS queries FROM judged"""
)
def eval_mrr_hit(spark: SparkSession, d: str) -> DataFrame:
    first = evaluation.first_relevant(*_eval(spark, d))
    f = F.col("first")
    return first.agg(F.round(evaluation.mrr(f, 10), 6).alias("mrr10"), F.round(evaluation.hit_rate(f, 1), 6).alias("hit1"), F.round(evaluation.hit_rate(f, 3), 6).alias("hit3"), F.count(F.lit(1)).alias("queries"))


@query(f"WITH {_RANKED} SELECT query, count(*) FILTER (rank < first AND {q.noise('lower(path)')}) AS noise FROM judged LEFT JOIN ranked USING (query) GROUP BY 1")
def eval_noise(spark: SparkSession, d: str) -> DataFrame:
    """Among the first EVAL_DEPTH hits, as the SQL has it; :func:`eval_noise_all` looks at all."""
    return evaluation.first_relevant(*_eval(spark, d)).select("query", "noise")


@query(f"WITH {_RANKED.replace(' QUALIFY rank <= 100', '')} SELECT query, count(*) FILTER (rank < first AND {q.noise('lower(path)')}) AS noise FROM judged LEFT JOIN ranked USING (query) GROUP BY 1")
def eval_noise_all(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d)
    at = F.struct((-F.col("score")).alias("score"), F.col("mtime").isNull().alias("undated"), (-F.col("mtime")).alias("age"), F.col("path").alias("by_path"), "hit_id")
    hits = _hits(spark, d).select(F.col("query_id").alias("query"), "path", "name", at.alias("at"))
    said = asked.groupBy("query").agg(F.collect_set("t").alias("terms"))
    judged = hits.join(said, "query").withColumn("relevant", F.coalesce(F.exists("terms", lambda t: F.contains(F.lower("name"), t)), F.lit(False)))
    return evaluation.noise_before_relevant(judged, asked).select("query", "noise")


@query(f"WITH {_RANKED} SELECT query, count(DISTINCT string_split(path, '/')[2]) AS buckets FROM ranked WHERE rank <= 10 GROUP BY 1")
def eval_diversity(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.diversity(_eval(spark, d)[0])


@query(
    """WITH s AS (SELECT CAST(floor(value * 1000) AS BIGINT) AS us, user_id % 11 <> 0 AS ok FROM events), l AS (SELECT list_sort(list(us)) AS v, count(*) AS ok_runs FROM s WHERE ok)
SELECT ok_runs, v[CAST(floor(0.5 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p50_us, v[CAST(floor(0.99 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p99_us FROM l"""
)
def latency_of_all(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "events").select(F.floor(F.col("value") * 1000).alias("elapsed_us"), (F.col("user_id") % 11 != 0).alias("ok"))
    return evaluation.latency_summary(samples).select("ok_runs", "p50_us", "p99_us")


@query(
    """WITH s AS (SELECT event_type AS view, CAST(floor(value * 1000) AS BIGINT) AS us, user_id % 11 <> 0 AS ok FROM events),
l AS (SELECT view, list_sort(list(us)) AS v, count(*) AS ok_runs, min(us) AS min_us, max(us) AS max_us, sum(us) AS total FROM s WHERE ok GROUP BY 1),
e AS (SELECT view, count(*) FILTER (NOT ok) AS error_runs FROM s GROUP BY 1)
SELECT view, error_runs, ok_runs, min_us, v[CAST(floor(0.5 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p50_us, v[CAST(floor(0.9 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p90_us,
  v[CAST(floor(0.95 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p95_us, v[CAST(floor(0.99 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p99_us, max_us, CAST(total // ok_runs AS BIGINT) AS mean_us, round(ok_runs * 1e6 / total, 6) AS qps
FROM e LEFT JOIN l USING (view)"""
)
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "events").select(F.col("event_type").alias("view"), F.floor(F.col("value") * 1000).alias("elapsed_us"), (F.col("user_id") % 11 != 0).alias("ok"))
    return evaluation.latency_summary(samples, "view")
