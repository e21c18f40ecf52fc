"""Named queries of the text and ranking operators, with the SQL that checks them where SQL can."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.leakage import leaks
from pathloom.llm.lookalike import SCRIPTS, SPELLED, TOGETHER, _tables, look_classes, look_form, same_look_pairs, unified
from pathloom.llm.packing import pack
from pathloom.llm.quality import given_words, not_prose, plain_statistics, text_quality
from pathloom.llm.tokens import token_count
from pathloom.llm.topn import top_n_per_group
from pathloom.operators.skew import hot_keys, replicate, spread
from pathloom.session import table

RUN = 12
#: A hit's path is frequent with more than this part of all hits, so fewer than so many are; a form has a few spellings.
OFTEN = 4_096
_TIES = {"mtime": "desc", "path": "asc"}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    hits, asked = table(spark, d, "search_results"), table(spark, d, "search_queries")
    top = top_n_per_group(hits, asked, group="query_id", item="hit_id", score="score", limit="result_limit", ties=_TIES)
    return top.select("query_id", "hit_id")


def p2_top_of_name(spark: SparkSession, d: str) -> DataFrame:
    """The three best hits of every basename, where a few names hold a large share of the hits."""
    hits = table(spark, d, "search_results")
    three = hits.select("name").distinct().withColumn("n", F.lit(3))
    return top_n_per_group(hits, three, group="name", item="hit_id", score="score", limit="n", ties=_TIES).select("name", "hit_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    names = same_look_pairs(table(spark, d, "arena_names"), "name_offset", "name")
    hits = table(spark, d, "search_results").where("path is not null and name is not null and hit_id is not null")
    # one delivery of a hit is enough, and only its texts matter
    seen = hits.select("hit_id", F.col("path").alias("hp"), F.col("name").alias("hn"))
    # frequent paths are found as they are written, so that forms are made once; there are few of them
    often = hot_keys(seen.select(F.xxhash64("hp").alias("h")), "h", OFTEN)
    texts = seen.select("hp", F.xxhash64("hp").alias("h")).join(F.broadcast(often), "h").select("hp").distinct()
    hot = texts.select(F.xxhash64(look_form(F.col("hp"))).alias("k")).distinct()
    seen = seen.withColumns({"hf": look_form(F.col("hp")), "nf": look_form(F.col("hn"))}).withColumn("k", F.xxhash64("hf"))
    own = table(spark, d, "arena_paths").where("path is not null").select("path_offset", "path", F.element_at(F.split("path", "/"), -1).alias("base"))
    own = own.withColumns({"pf": look_form(F.col("path")), "bf": look_form(F.col("base"))}).withColumn("pk", F.xxhash64("pf"))
    left = spread(seen, hot, "k", F.col("hit_id"))
    right = replicate(own, hot.withColumnRenamed("k", "pk"), "pk").withColumnRenamed("__salt", "__psalt")
    same = left.join(right, (F.col("k") == F.col("pk")) & (F.col("__salt") == F.col("__psalt")) & (F.col("hf") == F.col("pf")) & (F.col("nf") == F.col("bf")))
    found = same.where("hp <> path or hn <> base").select("hit_id", "path_offset").distinct()
    pairs = names.select(F.lit("name").alias("case_kind"), "left_key", "right_key")
    return pairs.unionByName(found.select(F.lit("hit").alias("case_kind"), F.col("hit_id").alias("left_key"), F.col("path_offset").alias("right_key")))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of registered names that look the same: their least name_offset, members and spellings."""
    return look_classes(table(spark, d, "arena_names"), "name_offset", "name").select("class_id", "members", "spellings")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every registered path in its one form, with the marks of mixed-script and whole-script tokens."""
    return unified(table(spark, d, "arena_paths").select("path_offset", "path"), "path")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", token_count(F.col("text")).alias("tokens"))
    return pack(sized, table(spark, d, "pack_sizes"), key="doc_id", size="tokens", pack_key="pack_id", capacity="capacity_tokens")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_key="doc_id", doc_text="text", item_key="item_id", item_text="passage", run=RUN)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What share of each leaked item's 12-word stretches is in the document."""
    return _leaks(spark, d).select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("stretches"), 6).alias("share"))


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item that leaked: into how many documents, and the most of its 12-word stretches that one document has."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("shared").alias("most_shared"), F.max("stretches").alias("stretches"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return not_prose(table(spark, d, "documents"), table(spark, d, "common_words"), key="doc_id", text="text", lang="lang")


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every filling: all documents placed, none above the capacity, nothing split but what exceeds it, no unit lost or doubled."""
    parts = p6_pack(spark, d)
    caps = table(spark, d, "pack_sizes").select("pack_id", F.col("capacity_tokens").alias("cap")).where("cap > 0").distinct()
    loads = parts.where("container is not null").groupBy("pack_id", "container").agg(F.sum("size").alias("load"))
    by_doc = parts.groupBy("pack_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("units"), F.max(F.col("first") + F.col("size")).alias("end"))
    over = loads.join(F.broadcast(caps), "pack_id").groupBy("pack_id").agg(F.count_if(F.expr("load > cap")).alias("overfull"))
    docs = by_doc.join(F.broadcast(caps), "pack_id").groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.expr("pieces > 1 and units <= cap")).alias("split_small"), F.count_if(F.expr("units <> end or pieces <> greatest(1, ceil(units / cap))")).alias("broken"), F.count_if(F.expr("units = 0")).alias("empty")
    )
    return docs.join(over, "pack_id", "left").select("pack_id", "documents", "empty", "split_small", "broken", F.coalesce("overfull", F.lit(0)).alias("overfull"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every whole text as it stands."""
    words = given_words(table(spark, d, "common_words"), "lang", "word")
    return table(spark, d, "documents").select("doc_id", plain_statistics(F.col("text"), words).alias("plain")).select("doc_id", "plain.*")


def p8_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's distance from prose and what each statistic adds to it, beside the plain statistics."""
    return text_quality(table(spark, d, "documents"), table(spark, d, "common_words"), key="doc_id", text="text", lang="lang")


QUERIES = {f.__name__: f for f in (p2_found, p2_top_of_name, p5_found, p5_classes, p5_forms, p6_pack, p6_checks, p7_found, p7_leaked_items, p7_shares, p8_found, p8_statistics, p8_outliers)}

_ONCE = """WITH once AS (
  SELECT DISTINCT hit_id, query_id, path, name, score, mtime FROM search_results WHERE score IS NOT NULL AND NOT isnan(score))
"""
_GRAMS = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
n AS (SELECT item_id, count(*) AS stretches FROM ig GROUP BY 1),
hits AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN ig USING (gram) GROUP BY 1, 2)
"""



def _look_sql() -> str:
    """The generated character map as a table: what a character is drawn as, accents and letter shapes included.

    Where tokens choose a spelling, SQL takes the first of a shape's row for every letter: two texts have one form exactly if
    they have one such skeleton.
    """
    characters, shapes = _tables()
    rows = {}
    for n in [*range(0x80, 0x3000), *characters]:
        c = chr(n)
        made = "".join(next(x for x in shapes[y] if x != "-") if y in shapes else y for y in unicodedata.normalize("NFD", characters.get(n, c)).replace("ɑ", "a").replace("ɡ", "g"))
        if made != c and unicodedata.category(c) not in ("Cn", "Cs"):
            rows[c] = made
    rows |= {c: next(x for x in row if x != "-") for c, row in shapes.items() if ord(c) >= 0x3000}
    rows |= {c: " " for c in "\t\n\r\x0b\x0c"}
    return ", ".join(f"({ord(c)}, [{', '.join(str(ord(x)) for x in r)}]::INT[])" for c, r in sorted(rows.items()))


def _forms_sql() -> str:
    """The operator's rules over tables of characters: scripts as bits, intersected over each token by bit_and."""
    characters, shapes = _tables()
    names = [*SPELLED, *(x for x in [*SCRIPTS.split(), *sorted({x for v in TOGETHER.values() for x in v})] if x not in SPELLED)]
    bits = lambda some: sum(1 << names.index(x) for x in some)
    plain = {}
    for n in [*range(0x80, 0x3000), *characters]:
        made = unicodedata.normalize("NFD", characters.get(n, chr(n))).replace("ɑ", "a").replace("ɡ", "g")
        if made != chr(n) and unicodedata.category(chr(n)) not in ("Cn", "Cs"):
            plain[n] = made
    plain |= {ord(c): " " for c in "\t\n\r\x0b\x0c"}
    listed = ", ".join(f"({n}, [{', '.join(str(ord(x)) for x in r)}]::INT[])" for n, r in sorted(plain.items()))
    could = ", ".join(f"({ord(c)}, {bits(x for x, y in zip(SPELLED, row) if y != '-')})" for c, row in shapes.items())
    spelled = ", ".join(f"({ord(c)}, {k}, {ord(row[k] if row[k] != '-' else next(x for x in row if x != '-'))})" for c, row in shapes.items() for k in range(len(SPELLED)))
    own = " ".join(f"WHEN regexp_matches(chr(c), '\\p{{{x}}}') THEN {bits([x, *TOGETHER.get(x, ())])}" for x in SCRIPTS.split())
    votes = ", ".join(f"sum(CASE WHEN letter AND possible <> -1 THEN (possible >> {k}) & 1 ELSE 0 END) AS v{k}" for k in range(len(SPELLED)))
    most = f"list_position([{', '.join(f'v{k}' for k in range(len(SPELLED)))}], greatest({', '.join(f'v{k}' for k in range(len(SPELLED)))})) - 1"
    lowest = "CASE " + " ".join(f"WHEN (p >> {k}) & 1 = 1 THEN {k}" for k in range(len(SPELLED))) + " END"
    return f"""WITH m(c, r) AS (VALUES {listed}), could(c, w) AS (VALUES {could}), spelled(c, way, s) AS (VALUES {spelled}),
raw AS (SELECT path_offset, unnest(list_transform(string_split(nfc_normalize(path), ''), lambda x: unicode(x))) AS c, generate_subscripts(string_split(nfc_normalize(path), ''), 1) AS k FROM arena_paths WHERE path <> ''),
chars AS (SELECT path_offset, k, unnest(coalesce(r, [c])) AS c, generate_subscripts(coalesce(r, [c]), 1) AS j FROM raw LEFT JOIN m USING (c)),
kinds AS (SELECT c, regexp_matches(chr(c), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]') AS letter, c BETWEEN 768 AND 879 AS mark, CASE WHEN regexp_matches(chr(c), '[\\p{{Common}}\\p{{Inherited}}]') THEN -1 {own} ELSE {1 << 60} END AS own FROM (SELECT DISTINCT c FROM chars)),
run AS (SELECT *, coalesce(w, own) AS possible, sum(CASE WHEN letter OR mark THEN 0 ELSE 1 END) OVER (PARTITION BY path_offset ORDER BY k, j) AS token FROM chars JOIN kinds USING (c) LEFT JOIN could USING (c)),
tokens AS (SELECT path_offset, token, bit_and(CASE WHEN letter THEN own ELSE -1 END) AS o, bit_and(CASE WHEN letter THEN possible ELSE -1 END) AS p, {votes} FROM run GROUP BY 1, 2),
chosen AS (SELECT path_offset, token, o, CASE WHEN p = -1 THEN NULL ELSE {lowest} END AS common, {most} AS most FROM tokens),
marked AS (SELECT path_offset, token, o = 0 AS mixed, o NOT IN (0, -1) AND common IS NOT NULL AND (o >> common) & 1 = 0 AS whole, coalesce(common, most) AS way FROM chosen)
SELECT path_offset, any_value(path) AS path, nfc_normalize(string_agg(chr(coalesce(s, c)), '' ORDER BY k, j)) AS look_form, bool_or(mixed) AS look_mixed, bool_or(coalesce(whole, false)) AS look_whole
FROM run JOIN marked USING (path_offset, token) LEFT JOIN spelled USING (c, way) JOIN arena_paths USING (path_offset) GROUP BY path_offset
UNION ALL SELECT path_offset, path, path, false, false FROM arena_paths WHERE path = ''"""


@lru_cache(maxsize=1)
def _drawn() -> str:
    return f"""WITH m(c, r) AS (VALUES {_look_sql()}),
texts AS (SELECT DISTINCT t FROM (SELECT name AS t FROM arena_names UNION ALL SELECT path FROM arena_paths UNION ALL SELECT string_split(path, '/')[-1] FROM arena_paths
  UNION ALL SELECT path FROM search_results UNION ALL SELECT name FROM search_results) WHERE t IS NOT NULL),
chars AS (SELECT t, unnest(list_transform(string_split(nfc_normalize(t), ''), lambda x: unicode(x))) AS c, generate_subscripts(string_split(nfc_normalize(t), ''), 1) AS k FROM texts WHERE t <> ''),
drawn AS (SELECT t, nfc_normalize(string_agg(coalesce(array_to_string(list_transform(r, lambda x: chr(x)), ''), chr(c)), '' ORDER BY k)) AS f FROM chars LEFT JOIN m USING (c) GROUP BY t UNION ALL SELECT '', '')
"""


SQL = {
    "p2_found": _ONCE
    + """SELECT query_id, hit_id FROM once JOIN (SELECT query_id, max(result_limit) AS n FROM search_queries GROUP BY 1) USING (query_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mtime DESC NULLS LAST, path, hit_id) <= n""",
    "p2_top_of_name": _ONCE
    + """SELECT name, hit_id FROM once WHERE name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, mtime DESC NULLS LAST, path, hit_id) <= 3""",
    "p5_found": _drawn()
    + """SELECT 'name' AS case_kind, a.name_offset AS left_key, b.name_offset AS right_key FROM arena_names a JOIN drawn x ON a.name = x.t JOIN drawn y ON x.f = y.f
JOIN arena_names b ON b.name = y.t AND a.name_offset < b.name_offset AND a.name <> b.name
UNION ALL SELECT DISTINCT 'hit', h.hit_id, p.path_offset FROM search_results h JOIN drawn hp ON h.path = hp.t JOIN drawn hn ON h.name = hn.t JOIN drawn pp ON pp.f = hp.f
JOIN arena_paths p ON p.path = pp.t JOIN drawn bn ON bn.t = string_split(p.path, '/')[-1] AND bn.f = hn.f WHERE h.hit_id IS NOT NULL AND (h.path <> p.path OR h.name <> string_split(p.path, '/')[-1])""",
    "p5_classes": _drawn() + "SELECT min(name_offset) AS class_id, count(*) AS members, count(DISTINCT name) AS spellings FROM arena_names JOIN drawn ON name = t GROUP BY f HAVING count(DISTINCT name) > 1",
    "p5_forms": _forms_sql(),
    "p6_checks": """SELECT pack_id, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS documents, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND coalesce(text, '') = '') AS empty,
0 AS split_small, 0 AS broken, 0 AS overfull FROM (SELECT DISTINCT pack_id FROM pack_sizes WHERE pack_id IS NOT NULL AND capacity_tokens > 0)""",
    "p7_leaked_items": _GRAMS + "SELECT item_id, count(*) AS documents, max(shared) AS most_shared, max(stretches) AS stretches FROM hits JOIN n USING (item_id) GROUP BY 1",
    "p8_statistics": r"""WITH d AS (SELECT doc_id, text AS t, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents),
c AS (SELECT DISTINCT lower(trim(split_part(lang, '-', 1))) AS l, lower(word) AS word FROM common_words WHERE word IS NOT NULL AND lang IS NOT NULL),
k AS (SELECT doc_id, max(n) AS known FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN c USING (word) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT doc_id, t, w, known, len(regexp_extract_all(t, '[^ \t\r\f\n][^\n]*')) AS lines, len(regexp_extract_all(t, '[.?!…]["''”»)\]]*[ \t\r\f]*(?:\n|\z)')) AS stops,
  len(regexp_extract_all(t, '[^\p{L}\p{N} \t\r\f\n]')) AS symbols FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, length(t) AS text_chars, len(w) AS words, CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, '')) / len(w), 6) END AS mean_word_length,
CASE WHEN length(t) > 0 THEN round(symbols / length(t), 6) END AS symbol_ratio, CASE WHEN lines > 0 THEN round(stops / lines, 6) END AS stop_line_share,
CASE WHEN len(w) > 0 THEN round(coalesce(known, 0) / len(w), 6) END AS common_word_share FROM s""",
    "p7_found": _GRAMS + "SELECT doc_id, item_id FROM hits",
    "p7_shares": _GRAMS + "SELECT doc_id, item_id, shared, round(shared / stretches, 6) AS share FROM hits JOIN n USING (item_id)",
}
