"""Ranked search over a table built by :mod:`pathloom.operators.index`.

A request is planned on the driver into one expression over the table: matching, scoring and the order
are columns, so the scan prunes and pushes what it can and the top rows come from a bounded heap in
every task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pathloom.functions.paths import in_subtree, scope_column, scope_of
from pathloom.functions.ranking import LITERAL, frecency, is_exact_name, is_literal, is_match, match_score, matches_text, name_score, scope_boost, usage_boost
from pathloom.operators.abbreviations import abbreviated
from pathloom.operators.index import has_trigrams
from pathloom.operators.requests import KEPT, best_of_blocks, fits
from pathloom.plans import dsl
from pathloom.session import broadcast_if_small

#: The order of results: the best match, the best place, the newest, the shallowest, the path by bytes.
ORDER = (("score", "desc"), ("place", "desc"), ("mtime", "desc"), ("depth", "asc"), ("path", "asc"))
EXACT_ORDER = (("mtime", "desc"), ("depth", "asc"), ("path", "asc"))
RECENT_ORDER = (("mtime", "desc"), ("file_id", "asc"))
#: Distinct requests that go to every task in a pass (a few dozen bytes each).
AT_ONCE = 200_000
#: Passes over the files, of so many requests each, before requests are met by a join; all go to the driver.
PASSES = 4
#: Slices of a piece's files when many terms are answered at once.
SLICES = 16
# The bounds of the compatible modes.
CANDIDATE_CAP, SCAN_BOUND, SCAN_AFTER_LIMIT, SCAN_EMPTY = 10_000, 50_000, 10_000, 1_000


@dataclass(frozen=True)
class Request:
    """``mode`` "uniform" scores every row; "indexed" only names with all trigrams of a term of three bytes and more.

    ``exact_first`` answers a term that is some file's whole name with just those files. ``candidate_cap`` and
    ``scan_bounds`` reproduce bounds of an interactive engine and make results depend on file ids; the latter may also be
    (rows at all, rows once the limit is reached, rows without a match).
    ``filter_stage`` "post" applies the filters to the limited result, as a client would.
    """

    term: str
    limit: int = 20
    filter_scope: str | None = None
    boost_scope: str | None = None
    cwd: str = "/"
    recent_if_empty: bool = False
    exact_first: bool = False
    mode: str = "uniform"
    candidate_cap: int | None = None
    scan_bounds: bool | tuple[int, int, int] = False
    filters: tuple = ()
    filter_stage: str = "pre"
    dirs_only: bool = False


def _order(keys: Sequence[tuple[str, str]]) -> list[Column]:
    return [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in keys]


def _ranked(rows: DataFrame, keys: Sequence[tuple[str, str]], limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank; only they meet in one task."""
    top = rows.orderBy(*_order(keys)).limit(max(limit, 0))
    return top.withColumn("rank", F.row_number().over(W.orderBy(*_order(keys))))


def scoped(files: DataFrame, req: Request) -> DataFrame:
    """The files of the request's scope and, unless they come after the limit, of its filters."""
    scope = scope_of(req.filter_scope, req.cwd)
    out = files if scope is None else files.where(in_subtree(F.col("path"), scope))
    if req.filter_stage == "pre":
        for p in req.filters:
            out = out.where(p)
        if req.dirs_only:
            out = out.where("is_dir")
    return out


def _scored(files: DataFrame, req: Request) -> DataFrame:
    q = req.term.lower()
    # the filter says where there is a score, so that scores are made once and only there
    hits = files.where(is_match(q)).withColumn("score", match_score(q))
    scope = scope_of(req.boost_scope, req.cwd)
    return hits.withColumn("place", F.col("context") if scope is None else F.col("context") + scope_boost(F.col("path"), F.col("depth"), scope))


def _scan_bounded(files: DataFrame, req: Request) -> DataFrame:
    """Rows in id order until the bounds of a short query; never more rows than the first bound meet in the window."""
    most, after_limit, empty = (SCAN_BOUND, SCAN_AFTER_LIMIT, SCAN_EMPTY) if req.scan_bounds is True else req.scan_bounds
    first = files.orderBy("file_id").limit(most)
    by_id = W.orderBy("file_id")
    hit = _scored(first, req).select("file_id").withColumn("hit", F.lit(1))
    seen = first.join(hit, "file_id", "left").withColumns({"at": F.row_number().over(by_id) - 1, "before": F.coalesce(F.sum("hit").over(by_id.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    stop = (F.col("before") >= req.limit) & (F.col("at") >= after_limit)
    if scope_of(req.filter_scope, req.cwd) is None:
        stop = stop | ((F.col("before") == 0) & (F.col("at") >= empty))
    # the scan ends at the first row that stops it, whatever comes after
    ended = F.max(stop).over(by_id.rowsBetween(W.unboundedPreceding, 0))
    return seen.withColumn("ended", ended).where("not ended").drop("hit", "at", "before", "ended")


def plan(files: DataFrame, req: Request) -> DataFrame:
    """The ranked rows of a request, before any usage boost: recents, exact names, or scored matches."""
    inside = scoped(files, req)
    if not req.term.strip() and req.recent_if_empty:
        return recent(files, req)
    q = req.term.lower()
    if req.exact_first and is_exact_name(q):
        whole = files.where(F.col("name_lc") == q)
        if not whole.isEmpty():
            return _ranked(scoped(whole, req).withColumn("score", F.lit(1.0).cast("float")), EXACT_ORDER, req.limit)
    if req.mode == "indexed" and len(q.encode()) >= 3:
        inside = inside.where(has_trigrams(F.col("name_lc"), q))
        if req.candidate_cap:
            inside = inside.orderBy("file_id").limit(req.candidate_cap)
    elif req.scan_bounds and len(q.encode()) < 3:
        inside = _scan_bounded(inside, req)
    return _ranked(_scored(inside, req), ORDER, req.limit)


def recent(files: DataFrame, req: Request) -> DataFrame:
    """The newest files, the lower id first among equals; score 0."""
    return _ranked(scoped(files, req).withColumn("score", F.lit(0.0).cast("float")), RECENT_ORDER, req.limit)


def touched(files: DataFrame, updates: DataFrame, limit: int, ring: int = 4_096) -> DataFrame:
    """Recents that prefer files lately touched in the index.

    ``updates`` has ``(file_id, update_seq)``. The ``ring`` latest updated files, newest update first, then
    all others by modification time; the first ``limit`` of them, shown by modification time.
    """
    last = updates.groupBy("file_id").agg(F.max("update_seq").alias("u")).orderBy(F.desc("u"), "file_id").limit(ring)
    marked = files.join(F.broadcast(last), "file_id", "left")
    picked = marked.orderBy(F.col("u").desc_nulls_last(), F.desc("mtime"), "file_id").limit(limit)
    return _ranked(picked.drop("u").withColumn("score", F.lit(0.0).cast("float")), RECENT_ORDER, limit)


def _present(rows: DataFrame) -> DataFrame:
    return rows.select("rank", "path", "name", F.col("score").cast("float").alias("score"), "size", "mtime")


def search(files: DataFrame, req: Request, usage: DataFrame | None = None, now: int = 0, max_boost: float = 0.08) -> DataFrame:
    """``(rank, path, name, score, size, mtime)``: the answer to a request, re-ranked by usage if there is any.

    With usage and a term, min(4 L, L + 300) rows are fetched, each gains a bounded boost for its
    frecency, and the first L by boosted score, then by first rank, remain; shown scores end at 1.
    """
    post = req.filters if req.filter_stage == "post" else ()
    boosted = usage is not None and req.term.strip() != ""
    wide = min(4 * req.limit, req.limit + 300) if boosted else req.limit
    rows = plan(files, replace(req, limit=wide))
    if boosted:
        gain = usage.select("path", usage_boost(frecency(F.col("last_used"), F.col("total_count"), now), max_boost).alias("gain"))
        # the few rows on the left decide the join; the usage table may be of any size
        joined = gain.join(F.broadcast(rows), "path", "right").withColumn("b", F.round(F.col("score").cast("double") + F.coalesce("gain", F.lit(0.0)), 6))
        by = W.orderBy(F.desc("b"), F.asc("rank"))
        rows = joined.withColumn("r", F.row_number().over(by)).where(F.col("r") <= req.limit).withColumns({"rank": F.col("r"), "score": F.least("b", F.lit(1.0))})
    for p in post:
        rows = rows.where(p)
    if post and req.dirs_only:
        rows = rows.where("is_dir")
    return _present(rows)


def search_dsl(files: DataFrame, raw: str, *, now: int, zone: str = "UTC", **options) -> DataFrame:
    """Search by a line of the filter language."""
    parsed = dsl.parse(raw, now, zone)
    return search(files, Request(term=parsed.term, filters=tuple(parsed.predicates()), **options))


def _pieces(sizes: Sequence[int], *texts: Column) -> Column:
    """Distinct pieces of so many bytes of the texts, in hexadecimal digits, which slice like bytes and compare like texts."""

    def of(text: Column, n: int) -> Column:
        digits = F.hex(F.encode(text, "utf-8"))
        at = F.sequence(F.lit(1), F.length(digits) - 2 * n + 1, F.lit(2))
        return F.when(F.length(digits) >= 2 * n, F.transform(at, lambda i: F.substring(digits, i, 2 * n))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(t, n) for t in texts for n in sizes]))


def _by_rarest_piece(slim: DataFrame, terms: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``slim`` rows with every term ``t`` that their name or path contains, by the term's rarest piece."""
    slice_ = F.pmod(F.xxhash64("file_id"), F.lit(SLICES)).cast("int")
    parts = terms.select("t", F.explode(F.when(F.octet_length("t") >= 3, _pieces([3], F.col("t"))).otherwise(F.array(F.hex(F.encode("t", "utf-8"))))).alias("g"))
    cut = slim.select("file_id", F.explode(_pieces(sizes, F.col("name_lc"), F.col("path_lc"))).alias("g"))
    # partitioned once: counted there and joined there
    grams = cut.join(broadcast_if_small(parts.select("g").distinct()), "g", "left_semi").withColumn("slice", slice_).repartition("g", "slice")
    held = grams.groupBy("g", "slice").agg(F.count(F.lit(1)).alias("files")).groupBy("g").agg(F.sum("files").alias("files"))
    rare = parts.join(held, "g", "left").groupBy("t").agg(F.min(F.struct("files", "g")).alias("r"), F.count_if(F.col("files").isNull()).alias("missing")).where("missing = 0")
    rarest = rare.select("t", F.col("r.g").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    near = grams.join(rarest, ["g", "slice"]).select("t", "file_id").join(slim, "file_id")
    return near.where(matches_text(F.col("name_lc"), F.col("path_lc"), F.col("t")))


def _by_block(files: DataFrame, asked: DataFrame, lots: Sequence[pa.Table], abbreviations: bool) -> DataFrame:
    """``(q, rank, path, score)`` for the requests ``asked``, whose distinct ones come in ``lots``; what leaves a block holds a request's best of it."""
    held = files.select("name_lc", "path_lc", "path", F.col("mtime").cast("bigint").alias("mtime"), "depth", "context", *(("initials", "mask") if abbreviations else ()))
    kept = [held.mapInArrow(best_of_blocks(lot, abbreviations), KEPT).withColumn("lot", F.lit(k)) for k, lot in enumerate(lots)]
    best = reduce(DataFrame.unionByName, kept).withColumn("rank", F.row_number().over(W.partitionBy("lot", "g").orderBy(*_order(ORDER))))
    numbered = pa.concat_tables(lot.select(["t", "within", "near"]).append_column("g", pa.array(range(lot.num_rows), pa.int32())).append_column("lot", pa.array([k] * lot.num_rows, pa.int32())) for k, lot in enumerate(lots))
    of = asked.join(broadcast_if_small(files.sparkSession.createDataFrame(numbered)), ["t", "within", "near"]).select("q", "lot", "g", "n")
    # the limit is a column, so no task sorts its rows before they move; each has few
    answers = best.where(F.col("rank") <= F.col("most")).select("lot", "g", "rank", "path", "score").join(of, ["lot", "g"])
    return answers.where(F.col("rank") <= F.col("n")).select("q", "rank", "path", "score")


def search_many(
    files: DataFrame, queries: DataFrame, *, query_id: str, term: str, limit: str, filter_scope: str | None = None, boost_scope: str | None = None, cwd: str = "/", abbreviations: bool = True, at_once: int = AT_ONCE
) -> DataFrame:
    """Many searches in one job: ``(query_id, rank, path, score)``, what :func:`search` finds in its default mode for each.

    ``filter_scope`` and ``boost_scope`` name the columns of the scopes, if there are any; null and blank scopes are none.
    Without ``abbreviations`` terms are looked for as substrings only.

    Equal terms are matched and scored once, equal (term, filter scope, boost scope) ranked once. These distinct requests go to the
    driver and from there, ``at_once`` in a pass over the files, to every task, which answers all of them over its own files, block by
    block, and lets out no more than a request's limit of each block: matches themselves are neither moved nor sorted. More than four passes, or
    limits beyond a block's memory, are met by an equi-join: a file is cut into pieces of three bytes (or as short as a term is), a
    term meets the files that have its rarest piece, and those are verified; pieces move in slices, so that a common piece is not
    one task's work. There the distinct terms that aren't literal still go to every task, which walks each of its paths once for
    all of them.
    Null and empty terms, and limits below one, find nothing.
    """
    scope = lambda c: F.coalesce(scope_column(F.col(c), cwd), F.lit("")) if c else F.lit("")
    wanted = queries.where(F.col(limit) > 0).where(F.col(term) != "").select(F.col(query_id).alias("q"), F.lower(term).alias("t"), scope(filter_scope).alias("within"), scope(boost_scope).alias("near"), F.col(limit).alias("n"))
    asked = wanted.groupBy("q", "t", "within", "near").agg(F.max("n").alias("n"))
    # few bytes, much work: partitions that suit the bytes would leave it to one task
    wide = files.sparkSession.sparkContext.defaultParallelism
    every = asked.groupBy("t", "within", "near").agg(F.max("n").alias("n")).limit(PASSES * at_once + 1).toArrow()
    if every.num_rows <= PASSES * at_once:
        by_term = every.sort_by("t")
        # taken rather than sliced: a slice would travel with all rows
        lots = [by_term.take(pa.array(range(begin, min(begin + at_once, by_term.num_rows)), pa.int64())) for begin in range(0, max(by_term.num_rows, 1), max(at_once, 1))]
        if all(fits(lot.column("n").to_pylist()) for lot in lots):
            return _by_block(files.repartition(wide, "path"), asked, lots, abbreviations).select(F.col("q").alias(query_id), "rank", "path", "score")
    most, sizes = asked.agg(F.coalesce(F.max("n"), F.lit(0)), F.collect_set(F.least(F.octet_length("t"), F.lit(3)))).first()
    terms = asked.select("t").distinct()
    slim = files.select("file_id", "path", "name_lc", "path_lc", "mtime", "depth", "context")
    found = _by_rarest_piece(slim, terms, sorted(sizes))
    kept = ("t", "path", "mtime", "depth", "context", "score")
    scored = found.withColumn("score", name_score(F.col("name_lc"), F.col("t"))).select(*kept)
    loose = [r.t for r in terms.where(F.translate("t", LITERAL, "") == F.col("t")).collect()] if abbreviations else []
    if loose:
        walked = files.select("name_lc", "path_lc", "initials", "mask", *kept[1:5]).repartition(4 * wide, "path")
        kinds = dict(walked.dtypes)
        scored = scored.unionByName(walked.mapInArrow(abbreviated(loose), ", ".join(["t string", *(f"{c} {kinds[c]}" for c in kept[1:5]), "score float"])))
    requests = asked.select("t", "within", "near").distinct()
    inside = (F.col("within") == "") | in_subtree(F.col("path"), F.col("within"))
    boost = F.when(F.col("near") == "", 0).otherwise(scope_boost(F.col("path"), F.col("depth"), F.col("near")))
    placed = scored.join(broadcast_if_small(requests), "t").where(inside).withColumn("place", F.col("context") + boost)
    best = placed.withColumn("rank", F.row_number().over(W.partitionBy("t", "within", "near").orderBy(*_order(ORDER)))).where(F.col("rank") <= most)
    answers = asked.join(best.select("t", "within", "near", "rank", "path", "score"), ["t", "within", "near"]).where(F.col("rank") <= F.col("n"))
    return answers.select(F.col("q").alias(query_id), "rank", "path", "score")
