"""What a match is worth: name, abbreviation, context and scope scores, and frecency.

Scores are 32-bit floats; every step is cast, since a division of floats is a double in Spark.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.paths import in_subtree

# What a directory of caches, build output or tool state takes from a path's context score; one of a line is enough.
CONTEXT_PENALTIES = (
    (100, ("/go/pkg/mod/",)),
    (90, ("/node_modules/",)),
    (90, ("/.cargo/",)),
    (80, ("/.rustup/",)),
    (80, ("/.gradle/caches/",)),
    (80, ("/.m2/repository/",)),
    (80, ("/.nuget/packages/",)),
    (70, ("/site-packages/",)),
    (70, ("/.venv/", "/venv/")),
    (70, ("/__pycache__/",)),
    (80, ("/library/caches/", "/.cache/")),
    (80, ("/library/developer/xcode/deriveddata/",)),
    (60, ("/target/", "/dist/", "/build/", "/out/")),
    (40, ("/.git/",)),
    (20, ("/.idea/", "/.vscode/")),
)
# Directories whose files count as noise when a ranking is evaluated.
NOISE = ("/go/pkg/mod/", "/library/caches/", "/node_modules/", "/target/", "/dist/", "/build/", "/.git/", "/.idea/")
# Characters that make a query a literal file name, and those of an exact basename.
LITERAL, SEPARATORS = ".-_/\\", "/\\"

SCOPE_BOOST, SCOPE_DEPTHS = 120, 20


def _f(x: float | Column) -> Column:
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("float")


def is_literal(term: str) -> bool:
    return any(c in term for c in LITERAL)


def is_exact_name(term: str) -> bool:
    return any(c in term for c in ".-_") and not any(c in term for c in SEPARATORS)


def matches_text(name_lc: Column, path_lc: Column, q: str | Column) -> Column:
    return F.contains(name_lc, F.lit(q) if isinstance(q, str) else q) | F.contains(path_lc, F.lit(q) if isinstance(q, str) else q)


def name_score(name_lc: Column, q: str | Column) -> Column:
    """1 for the whole name, 0.9 to 0.99 for a prefix, 0.7 after a blank or underscore, 0.5 inside, else 0.3. Lengths are bytes."""
    q = F.lit(q) if isinstance(q, str) else q
    ratio = _f(F.octet_length(q).cast("float") / F.octet_length(name_lc).cast("float"))
    prefix = _f(_f(ratio * _f(0.09)) + _f(0.9))
    whole_word = F.contains(name_lc, F.concat(F.lit(" "), q)) | F.contains(name_lc, F.concat(F.lit("_"), q))
    return F.when(name_lc == q, _f(1.0)).when(F.startswith(name_lc, q), F.when(F.octet_length(name_lc) > 0, prefix).otherwise(_f(0.9))).when(whole_word, _f(0.7)).when(F.contains(name_lc, q), _f(0.5)).otherwise(_f(0.3))


def context_score(path_lc: Column) -> Column:
    total = F.lit(0)
    for points, patterns in CONTEXT_PENALTIES:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | path_lc.contains(p)
        total = total - F.when(hit, points).otherwise(0)
    return total.cast("int")


def is_noise(path_lc: Column) -> Column:
    out = F.lit(False)
    for p in NOISE:
        out = out | path_lc.contains(p)
    return out


def scope_boost(path: Column, path_depth: Column, scope: str | Column | None) -> Column:
    """120 less one for each level below the scope, at most 20; 0 outside."""
    if scope is None:
        return F.lit(0)
    levels = F.when(scope == "/", 0).otherwise(F.length(scope) - F.length(F.replace(scope, F.lit("/")))) if isinstance(scope, Column) else scope.rstrip("/").count("/")
    below = F.greatest(path_depth - (levels + 1), F.lit(0))
    return F.when(in_subtree(path, scope), F.lit(SCOPE_BOOST) - F.least(below, F.lit(SCOPE_DEPTHS))).otherwise(0).cast("int")


# --- abbreviations -------------------------------------------------------------------------------


def token_initials(path: Column, fold: bool = True) -> Column:
    """The first character of every token, lower case unless ``fold`` is off; the root is a token of its own."""
    tokens = F.filter(F.split(path, r"[/\-_.]"), lambda t: t != "")
    letters = F.array_join(F.transform(tokens, lambda t: F.lower(F.substring(t, 1, 1)) if fold else F.substring(t, 1, 1)), "")
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), letters)


def _boundaries(path: Column) -> Column:
    return F.regexp_replace(path, "(?s)(?<![_\\-/.])[^\\p{Lu}]", "\u0001")


def boundary_mask(path: Column) -> Column:
    """The path in lower case with everything but capitals and characters after ``_ - / .`` blanked out, positions kept."""
    return F.lower(_boundaries(path))


def _pattern(q: str) -> str:
    """Matches text that has the characters of ``q`` in order; what is skipped can't hold the next one, so nothing is tried twice."""
    return "(?s)^" + "".join(f"[^{re.escape(c)}]*{re.escape(c)}" for c in q)


def _text(c: str) -> str:
    return "'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _walk(text: str, q: str, score: str, capitals: str | None = None) -> str:
    """SQL of ``score`` (SQL over ``w``) of the greedy leftmost walk of the characters of ``q`` through a column; null where it breaks off.

    ``w`` has the 1-based ``first`` and ``last`` positions, ``total``, the sum of 0-based ones, and ``pairs``, the number of
    adjacent ones, and ``caps``, whether the column ``capitals`` has capitals at all of them. Arrays of one name a value, so
    that it is made once however often it is referred to.
    """
    caps = f"w.caps and substring({capitals}, at, 1) rlike '^\\\\p{{Lu}}'" if capitals else "false"
    step = (
        f"(w, c) -> transform(array(locate(c, {text}, w.last + 1)), at -> named_struct('last', at, 'first', if(w.first = 0, at, w.first), 'total', w.total + at - 1, "
        f"'pairs', w.pairs + if(w.last > 0 and at = w.last + 1, 1, 0), 'ok', w.ok and at > 0, 'caps', {caps}))[0]"
    )
    start = f"named_struct('last', 0, 'first', 0, 'total', 0, 'pairs', 0, 'ok', true, 'caps', {'true' if capitals else 'false'})"
    return f"transform(array(aggregate(array({', '.join(map(_text, q))}), {start}, {step})), w -> case when w.ok then {score} end)[0]"


def is_subsequence(text_lc: Column, q: str) -> Column:
    return text_lc.rlike(_pattern(q))


def _component(initials: str, q: str) -> str:
    return _walk(initials, q, f"least(0.95D + w.pairs / {len(q)}D * 0.05D + {0.05 * len(q)!r}D / char_length({initials}), 0.99D)")


def _camel(mask: str, q: str, capitals: str | None = None) -> str:
    return _walk(mask, q, f"least(0.90D + w.pairs / {len(q)}D * 0.05D + if(w.caps, 0.05D, 0D), 0.96D)", capitals)


def _sequential(path_lc: str, q: str) -> str:
    n, length = len(q), f"char_length({path_lc})"
    return _walk(path_lc, q, f"least(greatest(0.70D + w.pairs / {n}D * 0.05D + w.total / {n}D / {length} * 0.10D - (w.last - w.first + 1 - {n}) / {length} * 0.10D, 0.50D), 0.88D)")


def component_score(initials: str, q: str) -> Column:
    """Initials of tokens (a column's name) in order: 0.95 and more, at most 0.99; null without a match."""
    return F.expr(_component(initials, q))


def camel_score(mask: str, q: str, capitals: str | None = None) -> Column:
    """Capitals and word starts in order: 0.90 and more, at most 0.96; 0.05 of it where every character met a capital of the column ``capitals``."""
    return F.expr(_camel(mask, q, capitals))


def sequential_score(path_lc: str, q: str) -> Column:
    """Characters in order with gaps: 0.70, more near the end and less for gaps, within 0.50 and 0.88."""
    return F.expr(_sequential(path_lc, q))


def prefix_score(name: Column, path: Column, q: str, fold: bool = True) -> Column:
    """1 for the stem, 0.99 for a prefix of it, 0.98 for a prefix of any component."""
    name, text = (F.lower(name), F.lower(path)) if fold else (name, path)
    stem = F.when(name.rlike(r"(?s)^.+\.[^.]*\z"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*\z", 1)).otherwise(name)
    parts = F.concat(F.when(path.startswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")), F.filter(F.split(text, "/"), lambda c: c != ""))
    return F.when(stem == q, 1.0).when(stem.startswith(q), 0.99).when(F.exists(parts, lambda c: c.startswith(q)), 0.98)


#: Strategies in the order in which they win ties.
STRATEGIES = ("exact_prefix", "component_first", "camel_case", "sequential")


def with_abbreviation_columns(df: DataFrame) -> DataFrame:
    """Add ``path_lc``, ``initials`` and ``mask``, which abbreviations are looked up in."""
    return df.withColumns({"path_lc": F.lower("path"), "initials": token_initials(F.col("path")), "mask": boundary_mask(F.col("path"))})


def _best(scores: list[Column]) -> Column:
    """The greatest score with its strategy, the earlier of equals; each score is bound once."""
    bound = F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("k")) for k, s in enumerate(scores)])
    best = F.array(F.array_max(F.filter(bound, lambda b: b["score"].isNotNull())))
    named = F.transform(best, lambda b: F.when(b.isNotNull(), F.struct(F.element_at(F.array(*map(F.lit, STRATEGIES)), 1 - b["k"]).alias("strategy"), b["score"].alias("score"))))
    return named[0]


def abbreviation(q: str, case_sensitive: bool = False) -> Column:
    """``struct<strategy string, score double>`` of the best strategy, null without a match or for an empty query.

    For tables with ``name``, ``path`` and the columns of :func:`with_abbreviation_columns`; a case-sensitive match makes its own from
    ``path``, by :func:`with_case_columns`. A query in capitals earns a bonus where it meets capitals. Positions count
    characters, so a path with characters beyond ASCII can score a little differently from engines that count bytes.
    """
    given, q = q, q if case_sensitive else q.lower()
    if not q:
        return F.lit(None).cast("struct<strategy: string, score: double>")
    name, path, capitals = F.col("name"), F.col("path"), "path" if given.isupper() and given.isalpha() else None
    text, initials, mask = ("path", "initials_cs", "mask_cs") if case_sensitive else ("path_lc", "initials", "mask")
    # every strategy finds the characters in order in the path or in the name, so rows without them cost two patterns
    best = _best([prefix_score(name, path, q, not case_sensitive), component_score(initials, q), camel_score(mask, q, capitals), sequential_score(text, q)])
    return F.when(is_subsequence(F.col(text), q) | is_subsequence(name if case_sensitive else F.lower(name), q), best)


def with_case_columns(df: DataFrame) -> DataFrame:
    """Add ``initials_cs`` and ``mask_cs`` for case-sensitive abbreviations."""
    return df.withColumns({"initials_cs": token_initials(F.col("path"), fold=False), "mask_cs": _boundaries(F.col("path"))})


def match_score(q: str) -> Column:
    """The score of a row of a searchable table for a lower-case term, null without a match: :func:`name_score` where name or path contain it, else, unless it is literal, the best abbreviation.

    One SQL text, since a search on a small table takes longer to build from single expressions than to run. Of a path
    that doesn't contain the term the strategies exclude each other from above: initials reach 0.95, capitals stay below
    it, sequences end at 0.88, so the first that matches is the best. All of them imply a subsequence of ``path_lc``.
    """
    t, real = _text(q), lambda x: f"cast({x} as float)"
    ratio = real(f"{real(f'octet_length({t})')} / {real('octet_length(name_lc)')}")
    prefix = real(f"{real(f'{ratio} * {real(0.09)}')} + {real(0.9)}")
    name = (
        f"case when name_lc = {t} then {real(1.0)} when startswith(name_lc, {t}) then if(octet_length(name_lc) > 0, {prefix}, {real(0.9)}) "
        f"when contains(name_lc, concat(' ', {t})) or contains(name_lc, concat('_', {t})) then {real(0.7)} when contains(name_lc, {t}) then {real(0.5)} else {real(0.3)} end"
    )
    text = f"contains(name_lc, {t}) or contains(path_lc, {t})"
    if is_literal(q) or not q:
        return F.expr(f"case when {text} then {name} end")
    loose = f"coalesce({_component('initials', q)}, {_camel('mask', q)}, {_sequential('path_lc', q)})"
    return F.expr(f"case when {text} then {name} when path_lc rlike {_text(_pattern(q))} then {real(loose)} end")


def is_match(q: str) -> Column:
    """Whether :func:`match_score` isn't null."""
    t = _text(q)
    text = f"contains(name_lc, {t}) or contains(path_lc, {t})"
    return F.expr(text if is_literal(q) or not q else f"{text} or path_lc rlike {_text(_pattern(q))}")


# --- frecency ------------------------------------------------------------------------------------


def frecency(last_used: Column, total: Column, now: int) -> Column:
    """0.7 for recency, which halves in a week, and 0.3 for the count on a logarithmic scale up to 49."""
    days = F.greatest(F.lit(now) - last_used, F.lit(0)) / F.lit(86_400.0)
    recency = F.lit(1.0) / (F.lit(1.0) + days / F.lit(7.0))
    often = F.least(F.greatest(F.log(total + F.lit(1.0)) / F.lit(math.log(50.0)), F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(recency * 0.7 + often * 0.3, F.lit(0.0)), F.lit(1.0))


def usage_boost(score: Column, max_boost: float) -> Column:
    top = min(max(max_boost, 0.0), 1.0) if math.isfinite(max_boost) else 0.0
    return F.least(F.greatest(score * F.lit(top), F.lit(0.0)), F.lit(top))
