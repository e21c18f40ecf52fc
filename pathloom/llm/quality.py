"""Per-document text statistics and how far they lie from running prose of the same language.

A text is cut into blocks: hard-wrapped lines are joined again where they broke for lack of room, and
neighbouring lines of one shape (marked or not, short or long, cells or not) form a block. Every block
has the statistics of ``STATISTICS``, the number of units each was counted over, and a language, which
is told by its common words: those given, and learned ones for declared languages without any.

For each language the mean and covariance of prose are estimated from all blocks, each weighted by the
characters of its running sentences, so that lists and tables weigh nothing; blocks beyond the cutoff
of one estimate are left out of the next. Both are shrunk towards the estimate over all languages by
``PRIOR`` blocks, so a language comes into its own step by step. A block's squared Mahalanobis
distance is taken under that covariance plus what counting so few words or lines adds by chance, and
is the sum of one contribution per statistic. Beyond the chi-square quantile of ``LEVEL`` it is not
prose; a document is not when such blocks hold more than half of its characters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pathloom.session import durable

#: Statistic -> the unit it is counted over.
STATISTICS = {
    "word_length": "words", "common_share": "words", "symbol_share": "tokens", "digit_share": "tokens", "stop_share": "lines", "marked_share": "lines",
    "lines_per_token": "tokens", "separators_per_token": "tokens", "running_share": "pieces", "repeats_per_word": "words",
}
UNITS = ("words", "tokens", "lines", "pieces")
#: Statistics that are means of counts; the others are shares.
COUNTS = ("word_length", "separators_per_token", "repeats_per_word")
#: Chance that a block of prose with normally distributed statistics lies beyond the cutoff.
LEVEL = 1e-5
#: Blocks' worth of the estimate over all languages in the estimate of each.
PRIOR = 50
STEPS = 4
#: Standard deviations of a sentence's share of common words from the language's mean within which a piece without
#: a sentence's capital and stop can be one.
WITHIN = 2.0
#: Share of running words that the learned common words of a language make up, and documents' worth of doubt in them.
COVERAGE, DOUBT = 0.4, 5
#: Words rarer than this in a language are never learned, so there are at most as many as its inverse.
RAREST = 0.001
#: A text with a smaller share of every language's common words is in none of them.
UNKNOWN = 0.05
ANY = "*"

_RUNNING = list(STATISTICS).index("running_share")
_UNIT_OF = [UNITS.index(u) for u in STATISTICS.values()]
_COUNTED = np.array([n in COUNTS for n in STATISTICS])
_WORD = re.compile(r"[^\W\d_]+")
_ASCII_WORDS = {n: " " for n in range(128) if not chr(n).isalpha()}
_MARK = re.compile(r"\s*(?:[-*•+·–]+|\d+[.):]|\[[ xX]?\]|[a-zA-Z][.)]|- \[[ x]\])\s")
_QUOTED = re.compile(r"^[ \t]*(?:[>#]+|//)[ \t]+")
_GAPS = re.compile(r"[ \t]{2,}|\t")
_CELL = re.compile(r"[^\s.?!:;](?: {2,}|\t)(?=\S)|\S,(?=[^\s\d])")
_WIDE = re.compile(r"\S {2,}(?=\S)")
_SENTENCE = re.compile(r"(?<=[.?!])[\"'”»)]*\s+")
_CLOSERS = "\"'”»)] \t"
_BITS = 24
_MASK = (1 << _BITS) - 1


def chi_square_share(x: float, degrees: int) -> float:
    """The distribution function of chi-square, by the series of the incomplete gamma function."""
    a, x = degrees / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 10.0 * degrees + 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, degrees) < share else (low, mid)
    return high


def _lines(text: str) -> Iterator[list[str]]:
    """Paragraphs as lists of logical lines: quotes unquoted, even spacing closed up, hard wraps joined."""
    para: list[str] = []
    for line in text.split("\n"):
        line = line.rstrip()
        if not line:
            if para:
                yield _unwrapped(para)
                para = []
            continue
        if line[0] in "># \t/":
            line = _QUOTED.sub("", line).strip(" ")
        if "  " in line or "\t" in line:
            n = len(line.split())
            if n > 3 and len(_GAPS.findall(line)) >= 0.8 * (n - 1):
                line = " ".join(line.split())
        if line:
            para.append(line)
    if para:
        yield _unwrapped(para)


def _marked(line: str) -> bool:
    return line.lstrip()[:1] in ("|", "+") or _MARK.match(line) is not None


def _unwrapped(para: list[str]) -> list[str]:
    if len(para) == 1:
        return para
    lengths = sorted(map(len, para))
    middle = lengths[len(lengths) // 2]
    width = max(n for n in lengths if n <= 1.3 * middle)
    if not 30 <= width <= 130:
        return para
    out, last = [[para[0]]], para[0]
    for line in para[1:]:
        # a greedy wrap breaks only where the next word had no room
        if len(last) + 1 + len(line.split(None, 1)[0]) > width and not _marked(line):
            out[-1].append(line.lstrip())
        else:
            out.append([line])
        last = line
    return [" ".join(parts) for parts in out]


def _stops(line: str) -> bool:
    return line.rstrip(_CLOSERS)[-1:] in (".", "?", "!", "…")


def _words(piece: str) -> list[str]:
    low = piece.lower()
    return low.translate(_ASCII_WORDS).split() if low.isascii() else _WORD.findall(low)


class Profile:
    """Common words of all languages, packed so that one sum counts them for every language."""

    def __init__(self, common: Mapping[str, Sequence[str]]):
        self.languages = sorted(common)
        self.pack: dict[str, int] = {}
        for k, lang in enumerate(self.languages):
            for w in common[lang]:
                self.pack[w] = self.pack.get(w, 0) | 1 << (_BITS * k)

    def best(self, packed: int) -> tuple[int, int]:
        """(common words, number) of the language with most of them; (0, -1) where there are none."""
        most, at, k = 0, -1, 0
        while packed:
            n = packed & _MASK
            if n > most:
                most, at = n, k
            packed >>= _BITS
            k += 1
        return most, at

    def other(self, packed: int, words: int, now: int) -> tuple[int, int]:
        """(common words, number) of another language with so many more among ``words`` than ``now`` that chance (two deviations of the difference) doesn't explain it, else of ``now``."""
        own = packed >> (_BITS * now) & _MASK if now >= 0 else 0
        if words - own <= 2 * math.sqrt(words + own):
            return own, now
        most, k = self.best(packed)
        return (most, k) if most - own > 2 * math.sqrt(most + own) else (own, now)


def _cells(line: str) -> int:
    """Places where cells of a table row meet: wide gaps, and commas with a text right behind them."""
    if "  " in line or "\t" in line or line.count(",") > line.count(", ") + (line[-1] == ","):
        return len(_CELL.findall(line))
    return 0


def _line_facts(line: str, profile: Profile):
    """Everything the blocks need of one logical line, in one pass over its sentences.

    (line, words, letters, packed counts of common words, pairs of equal words at most four apart, marked, cells, tokens, ends a sentence, pieces, sentence-like pieces)
    """
    like = []
    words_n = letters = packed = again = pieces_n = 0
    cells = _cells(line)
    marked = _marked(line)
    look = profile.pack.get
    for piece in _SENTENCE.split(line):
        words = _words(piece)
        k = len(words)
        if not k:
            continue
        pieces_n += 1
        p = sum(filter(None, map(look, words)))
        words_n += k
        letters += len("".join(words))
        packed += p
        near = 0 if k == len(set(words)) else sum(sum(map(eq, words[n:], words)) for n in range(1, 5))
        again += near
        if k >= 4 and not marked and cells < 2:
            proper = piece[:1].isupper() and _stops(piece)
            if proper or k >= 7 and near < 0.25 * k:
                like.append((len(piece), k, p, proper))
    return line, words_n, letters, packed, again, marked, cells, len(line.split()), _stops(line), pieces_n, like


@dataclass
class Block:
    """A block's language, characters, statistics, units, sums over its proper sentences, and other pieces that may be sentences."""

    language: str | None
    chars: int
    s: list[float]
    u: list[int]
    proper: tuple[float, float, float]
    shares: list[float]
    parts: list[float]


def block_statistics(text: str, profile: Profile) -> list[Block]:
    """The blocks of a text.

    ``running_share`` counts properly written sentences only; ``shares`` and ``parts`` have, of every other
    piece long enough to be a sentence, the share of common words and its part of the block's characters.
    ``proper`` has (words, common words, sum of common words squared by words) over the proper sentences.
    """
    paras = [[_line_facts(u, profile) for u in lines] for lines in _lines(text)]
    most, doc_lang = profile.best(sum(f[3] for p in paras for f in p))
    if most < UNKNOWN * sum(f[1] for p in paras for f in p) or not most:
        doc_lang = -1
    out = []

    def close(block: list) -> None:
        whole = "\n".join([f[0] for f in block])
        k, m, n = sum(f[1] for f in block), len(block), len(whole) - len(block) + 1
        common, lang = profile.other(sum(f[3] for f in block), k, doc_lang)
        proper_n, words, known, squares = 0, 0, 0.0, 0.0
        shares, parts = [], []
        for f in block:
            for size, pk, pp, proper in f[10]:
                # a sentence may be a quotation in another language
                c, other = profile.other(pp, pk, lang)
                if other != lang:
                    common += c - (pp >> (_BITS * lang) & _MASK if lang >= 0 else 0)
                if proper:
                    proper_n += size
                    words, known, squares = words + pk, known + c, squares + c * c / pk
                else:
                    shares.append(c / pk)
                    parts.append(size / n)
        count = whole.count
        letters, tokens = sum(f[2] for f in block), sum(f[7] for f in block)
        solid = n - count(" ") - count("\t")
        digits = sum(map(count, "0123456789"))
        plain = sum(map(count, ".,?!'’;:\""))
        seps = sum(map(count, ",;|\t:=")) + (len(_WIDE.findall(whole)) if "  " in whole else 0)
        kk, tt, ss = max(k, 1), max(tokens, 1), max(solid, 1)
        stats = [
            letters / kk, min(1.0, common / kk), max(0, solid - letters - digits - plain) / ss, min(1.0, digits / ss), sum(f[8] for f in block) / m, sum(f[5] for f in block) / m,
            min(1.0, m / tt), seps / tt, proper_n / max(n, 1), sum(f[4] for f in block) / kk,
        ]
        out.append(Block(profile.languages[lang] if lang >= 0 else None, n, stats, [kk, tt, m, max(1, sum(f[9] for f in block))], (words, known, squares), shares, parts))

    for para in paras:
        block: list = []
        shape = None
        for f in para:
            tokens, cells, marked = f[7], f[6], f[5]
            first = (marked, tokens >= 8, cells >= 2)
            # between clear cases a line keeps the shape of the one before
            now = first if shape is None else (marked, tokens >= 14 or tokens >= 7 and shape[1], cells >= 2 or shape[2] and not (tokens >= 12 and cells == 0))
            if block and now != shape:
                close(block)
                block, now = [], first
            block.append(f)
            shape = now
        if block:
            close(block)
    return out


def plain_language(lang: Column) -> Column:
    """The primary code of an untidy language tag; null where it names none."""
    code = F.lower(F.trim(F.split(lang, "-")[0]))
    return F.when(code.rlike("^[a-z]{2,3}$") & (code != "und"), code)


def given_words(common: DataFrame, word_lang: str, word: str) -> dict[str, list[str]]:
    """Common words by language, lower case and in order; a table of lists is small by its nature."""
    given: dict[str, list[str]] = {}
    for code, w in common.where(F.col(word).isNotNull()).select(plain_language(F.col(word_lang)).alias("l"), F.lower(word).alias("w")).where("l is not null").distinct().collect():
        given.setdefault(code, []).append(w)
    return {k: sorted(v) for k, v in given.items()}


def common_words_of(docs: DataFrame, common: DataFrame, *, text: str, lang: str, word_lang: str, word: str) -> dict[str, list[str]]:
    """Common words by language: those given, and learned ones of declared languages that have none.

    Learned are the words with the greatest mean share in the language's documents that together make up ``COVERAGE``
    of its running words, less for fewer documents: n / (n + ``DOUBT``) of it with n.
    """
    given = given_words(common, word_lang, word)
    rest = docs.select(plain_language(F.col(lang)).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    if given:
        rest = rest.where(~F.col("l").isin(list(given)))
    words = rest.select("l", F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    shares = words.select("l", (F.lit(1.0) / F.size("w")).alias("part"), F.explode("w").alias("w")).groupBy("l", "w").agg(F.sum("part").alias("part"))
    docs_n = shares.groupBy("l").agg(F.sum("part").alias("n"))
    # at most 1 / RAREST words of a language pass, so the window is bounded
    usual = shares.join(docs_n, "l").where(F.col("part") >= F.col("n") * RAREST)
    upto = F.sum("part").over(W.partitionBy("l").orderBy(F.desc(F.round("part", 9)), "w"))
    for code, w in usual.withColumn("upto", upto).where(F.col("upto") <= COVERAGE * F.col("n") * F.col("n") / (F.col("n") + DOUBT)).select("l", "w").collect():
        given.setdefault(code, []).append(w)
    return {k: sorted(v) for k, v in given.items()}


def blocks(docs: DataFrame, words: Mapping[str, Sequence[str]], *, key: str, text: str, carry: Sequence[Column] = ()) -> DataFrame:
    """``(key, language, chars, s, u, proper, shares, parts)`` and the ``carry`` columns, which every block of a document repeats.

    A document without text gives one row of no characters.
    """
    profile = Profile(words)
    d = len(STATISTICS)
    none = Block(None, 0, [0.0] * d, [1] * len(UNITS), (0.0, 0.0, 0.0), [], [])
    names = ["key", "language", "chars", "s", "u", "proper", "shares", "parts"]

    def fixed(rows: list, width: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(np.array(rows, dtype=float).ravel()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for b in (block_statistics(t, profile) if t else None) or [none]:
                    own.append(k)
                    found.append(b)
            take = pa.array(own, pa.int64())
            ends = np.cumsum([0] + [len(b.shares) for b in found]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array([x for b in found for x in getattr(b, c)], pa.float64())) for c in ("shares", "parts")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), pa.array([b.language for b in found], pa.string()), pa.array([b.chars for b in found], pa.int64()),
                    fixed([b.s for b in found], d), fixed([b.u for b in found], len(UNITS)), fixed([b.proper for b in found], 3), *lists, *(c.take(take) for c in batch.columns[2:]),
                ],
                names + batch.schema.names[2:],
            )

    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *carry).where("k is not null")
    kinds = [f"key {dict(docs.dtypes)[key]}", "language string", "chars bigint", *(f"{c} array<double>" for c in names[3:]), *(f"{c} {k}" for c, k in slim.dtypes[2:])]
    return slim.mapInArrow(made, ", ".join(kinds)).withColumnRenamed("key", key)


def with_running_share(rows: DataFrame) -> DataFrame:
    """Add to ``running_share`` the pieces whose share of common words is that of the language's sentences.

    Mean and variance of a sentence's share are those over all proper sentences of the language, shrunk towards
    those of all languages by ``PRIOR`` sentences of twenty words.
    """
    group = F.coalesce("language", F.lit(ANY))
    sums = rows.where(F.col("language").isNotNull()).groupBy("language").agg(*[F.sum(F.col("proper")[k]).alias(f"p{k}") for k in range(3)]).where("p0 > 0").collect()
    if not sums:
        return rows.drop("proper", "shares", "parts")
    p = {r["language"]: np.array([r["p0"], r["p1"], r["p2"]]) for r in sums}
    every = sum(p.values())
    mid = every[1] / every[0]
    usual = {ANY: (mid, max(0.0, every[2] / every[0] - mid * mid))}
    for lang, (n, known, squares) in p.items():
        trust, m = n / (n + 20 * PRIOR), known / n
        var = trust * (squares / n - m * m + (1 - trust) * (m - mid) ** 2) + (1 - trust) * usual[ANY][1]
        usual[lang] = (trust * m + (1 - trust) * mid, max(0.0, var))
    table = F.create_map(*[x for g, (m, v) in usual.items() for x in (F.lit(g), F.array(F.lit(m - WITHIN * math.sqrt(v)), F.lit(m + WITHIN * math.sqrt(v))))])
    bounds = F.coalesce(F.try_element_at(table, group), F.try_element_at(table, F.lit(ANY)))
    inside = F.zip_with("shares", "parts", lambda s, part: F.when((s >= F.col("bounds")[0]) & (s <= F.col("bounds")[1]), part).otherwise(0.0))
    more = F.aggregate(inside, F.lit(0.0), lambda a, v: a + v)
    s = [F.least(F.lit(1.0), F.col("s")[k] + F.col("more")) if k == _RUNNING else F.col("s")[k] for k in range(len(STATISTICS))]
    return rows.withColumn("bounds", bounds).withColumn("more", F.when(F.size("shares") > 0, more).otherwise(0.0)).withColumn("s", F.array(*s)).drop("proper", "shares", "parts", "bounds", "more")


@dataclass
class Fit:
    """Mean and covariance of prose, and the variance that one unit adds to each statistic by chance."""

    mean: np.ndarray
    cov: np.ndarray
    unit: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, cov: np.ndarray, units: np.ndarray) -> Fit:
        """Of ``units`` counted units; by the rule of succession no share is quite 0 or 1. Counts vary as Poisson's, shares as Bernoulli's."""
        n = units[_UNIT_OF]
        p = np.where(_COUNTED, (mean * n + 1) / (n + 1), (np.clip(mean, 0, 1) * n + 1) / (n + 2))
        return cls(mean, cov, np.where(_COUNTED, p, p * (1 - p)))

    def contributions(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        """What each statistic adds to the squared distance of each row."""
        r = x - self.mean
        noise = self.unit / u[:, _UNIT_OF]
        cov = np.broadcast_to(self.cov, (len(x), *self.cov.shape)).copy()
        at = np.arange(len(self.mean))
        cov[:, at, at] += noise
        return r * np.linalg.solve(cov, r[..., None])[..., 0]


def _distances(fits: Mapping[str, Fit], parts: bool):
    """A UDF of (language, statistics, units): the squared distance, or each statistic's contribution to it."""

    def contributions(langs: pd.Series, stats: pd.Series, units: pd.Series) -> np.ndarray:
        x = np.array(stats.tolist(), dtype=float).reshape(len(stats), len(STATISTICS))
        u = np.array(units.tolist(), dtype=float).reshape(len(stats), len(UNITS))
        out = np.full(x.shape, np.nan)
        names = langs.where(langs.isin(list(fits)), ANY).fillna(ANY)
        for lang in names.unique():
            at = (names == lang).to_numpy()
            out[at] = fits[lang].contributions(x[at], u[at])
        return out

    if parts:

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def udf(langs: pd.Series, stats: pd.Series, units: pd.Series) -> pd.Series:
            return pd.Series(list(contributions(langs, stats, units)), dtype=object)
    else:

        @F.pandas_udf(T.DoubleType())
        def udf(langs: pd.Series, stats: pd.Series, units: pd.Series) -> pd.Series:
            return pd.Series(contributions(langs, stats, units).sum(axis=1) if len(stats) else [], dtype=float)

    return udf


def cutoff(level: float = LEVEL) -> float:
    return chi_square_quantile(1 - level, len(STATISTICS))


def fit_prose(blocks_: DataFrame, level: float = LEVEL) -> dict[str, Fit]:
    """The estimate for each language and for all (``ANY``), over every block; empty where nothing runs.

    Only sums come to the driver: weights, moments and units per language.
    """
    d = len(STATISTICS)
    bound = cutoff(level)
    # what leaving out everything beyond the cutoff takes from the variance of normal statistics
    factor = (1 - level) / chi_square_share(bound, d + 2)
    x = [F.col("s")[k] for k in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    w = F.col("chars") * F.col("s")[_RUNNING]
    rows = blocks_.where((F.col("chars") > 0) & (F.col("s")[_RUNNING] > 0)).select(F.coalesce("language", F.lit(ANY)).alias("g"), w.alias("w"), "s", "u")
    fits: dict[str, Fit] = {}
    for _ in range(STEPS):
        kept = rows.where(_distances(fits, False)("g", "s", "u") <= bound) if fits else rows
        sums = kept.groupBy("g").agg(
            F.array(F.sum("w"), F.sum(F.col("w") * F.col("w"))).alias("w"), F.array(*[F.sum(F.col("w") * c) for c in x]).alias("a"), F.array(*[F.sum(F.col("w") * x[i] * x[j]) for i, j in pairs]).alias("b"),
            F.array(*[F.sum(F.col("u")[k]) for k in range(len(UNITS))]).alias("u"),
        ).collect()
        if not sums:
            return fits
        each = {r["g"]: [np.array(r[c]) for c in ("w", "a", "b", "u")] for r in sums}

        def moments(w: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray):
            mean, cov = a / w[0], np.zeros((d, d))
            for (i, j), v in zip(pairs, b / w[0]):
                cov[i, j] = cov[j, i] = v - mean[i] * mean[j]
            return mean, cov * factor, u

        mid, spread_, units = moments(*[sum(v[k] for v in each.values()) for k in range(4)])
        made = {ANY: Fit.of(mid, spread_, units)}
        for g, v in each.items():
            if g != ANY:
                mean, cov, u = moments(*v)
                n = v[0][0] ** 2 / v[0][1]  # as many blocks of one size
                trust = n / (n + PRIOR)
                # counts of units shrink as well, so that a share of 0 is believed as far as the language is
                made[g] = Fit.of(trust * mean + (1 - trust) * mid, trust * cov + (1 - trust) * spread_, u)
        fits = made
    return fits


#: The plain statistics of a text, fields of :func:`plain_statistics`.
PLAIN = ("text_chars", "words", "mean_word_length", "symbol_ratio", "stop_line_share", "common_word_share")


def plain_statistics(text: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """A struct of ``PLAIN``, statistics of the text as it stands, by built-in functions: characters, words, letters a word, shares of symbols, of lines that end in punctuation, and of common words.

    A word is a run of letters. ``common_word_share`` is that of the language of ``words`` with the greatest.
    Shares of nothing are null, and so is everything of a null text.
    """
    count = lambda p: F.regexp_count(text, F.lit(p))
    per = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    every = sorted(set().union(*words.values())) if words else []

    def known(common: Column) -> Column:
        among = lambda listed: F.size(F.filter(common, lambda w: w.isin(listed)))
        return F.greatest(F.lit(0), F.lit(0), *[among(v) for v in words.values()])

    def facts(found: Column) -> Column:
        # texts are taken into words once, and only the common ones of them are looked at for each language
        most = F.transform(F.array(F.filter(found, lambda w: w.isin(every)) if every else F.array().cast("array<string>")), known)[0]
        return F.struct(F.size(found).alias("n"), F.aggregate(found, F.lit(0), lambda a, w: a + F.length(w)).alias("letters"), most.alias("known"))

    def shown(f: Column) -> Column:
        lines, chars = count(r"[^ \t\r\f\n][^\n]*"), F.length(text)
        values = [
            chars, f["n"], per(f["letters"], f["n"]), per(count(r"[^\p{L}\p{N} \t\r\f\n]"), chars),
            per(count(r"""[.?!…]["'”»)\]]*[ \t\r\f]*(?:\n|\z)"""), lines), per(f["known"], f["n"]),
        ]
        return F.struct(*[v.alias(n) for v, n in zip(values, PLAIN)])

    found = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    # arrays of one name a value, so that it is made once however often it is referred to
    return F.when(text.isNotNull(), F.transform(F.transform(F.array(found), facts), shown)[0])


def _measured(docs: DataFrame, common: DataFrame, key: str, text: str, lang: str, word_lang: str, word: str, carry=()) -> tuple[DataFrame, dict[str, Fit]]:
    words = common_words_of(docs, common, text=text, lang=lang, word_lang=word_lang, word=word)
    # measured once: the fit goes over these rows several times
    rows = with_running_share(durable(blocks(docs, words, key=key, text=text, carry=carry)))
    return rows, fit_prose(rows)


def text_quality(docs: DataFrame, common: DataFrame, *, key: str, text: str, lang: str, word_lang: str = "lang", word: str = "word", level: float = LEVEL) -> DataFrame:
    """Per document: its statistics, its distance from prose, what each statistic adds to it, and whether it is prose.

    ``(key, language, chars, plain statistics..., statistics..., distance, contribution of each statistic, outlying_share,
    is_prose)``; statistics of blocks, distance and contributions are means over the document's blocks weighted by
    characters, the plain ones are of the whole text; ``language`` is the one of most characters. Null and empty texts
    have 0 characters and null elsewhere, and are not called prose. Languages are told by words, not by tags. Repeated
    texts are measured each; keys must be unique, and null keys are left out; other columns are ignored.
    """
    given = given_words(common, word_lang, word)
    rows, fits = _measured(docs, common, key, text, lang, word_lang, word, [plain_statistics(F.col(text), given).alias("plain")])
    scored = rows.withColumn("c", _distances(fits, True)("language", "s", "u")) if fits else rows.withColumn("c", F.lit(None).cast("array<double>"))
    w = F.col("chars")
    d2 = F.aggregate("c", F.lit(0.0), lambda a, v: a + v)
    scored = scored.withColumns({"d2": d2, "w": w.cast("double")})
    mean = lambda c: F.when(F.sum("chars") > 0, F.sum(F.col("w") * c) / F.sum("w"))
    out = scored.groupBy(key).agg(
        F.max_by("language", F.struct("w", "language")).alias("language"), F.sum("chars").alias("chars"), *[F.max(f"plain.{n}").alias(n) for n in PLAIN],
        *[mean(F.col("s")[k]).alias(n) for k, n in enumerate(STATISTICS)], mean(F.col("d2")).alias("distance"), *[mean(F.col("c")[k]).alias(f"from_{n}") for k, n in enumerate(STATISTICS)],
        F.when(F.sum("chars") > 0, F.sum(F.when(F.col("d2") > cutoff(level), w).otherwise(0)) / F.sum("chars")).alias("outlying_share"),
    )
    return out.withColumn("is_prose", F.coalesce(F.col("outlying_share") <= 0.5, F.lit(False)))


def not_prose(docs: DataFrame, common: DataFrame, *, key: str, text: str, lang: str, word_lang: str = "lang", word: str = "word", level: float = LEVEL) -> DataFrame:
    """``(key)`` of documents whose text is for more than half of its characters not prose; texts without characters aren't.

    Where no block of any document has a running sentence there is no prose to measure from, and every text with characters comes out.
    """
    rows, fits = _measured(docs, common, key, text, lang, word_lang, word)
    some = rows.where("chars > 0")
    if not fits:
        return some.select(key).distinct()
    scored = some.withColumn("d2", _distances(fits, False)("language", "s", "u"))
    share = scored.groupBy(key).agg((F.sum(F.when(F.col("d2") > cutoff(level), F.col("chars")).otherwise(0)) / F.sum("chars")).alias("share"))
    return share.where("share > 0.5").select(key)
