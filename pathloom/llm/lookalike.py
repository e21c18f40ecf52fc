"""One form for text that looks the same.

Width forms, ligatures and roman numerals become plain letters, characters without width disappear, every
kind of blank becomes a space and every kind of hyphen a hyphen-minus, and accents are composed. Letters
are settled a token at a time. A letter's own scripts are its Unicode script extensions, Common and
Inherited letters being in all, with the joint sets of scripts that are written together (Japanese: Han,
Hiragana, Katakana; Korean: Hangul, Han; Bopomofo with Han). An empty intersection over a token marks it
*mixed*. The scripts in which its shapes can be spelled are intersected as well, and the token is spelled in the first
common one; where that is not one of its own, it is a *whole-script* confusable. Without a common script
it is spelled in the script that spells most of its letters. Letter case and missing accents stay visible.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.skew import hot_keys, replicate, spread
from pathloom.session import durable

SPELLED = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Lisu")
# Letters of the same shape, a line each, in the order of SPELLED; "-" where a script has none.
SHAPES = """
A А Α - Ꭺ ꓮ
B В Β - Ᏼ ꓐ
C С Ϲ - Ꮯ ꓚ
D - - - Ꭰ ꓓ
E Е Ε - Ꭼ ꓰ
F - Ϝ - - ꓝ
G Ԍ - - Ꮐ ꓖ
H Н Η - Ꮋ ꓧ
I І Ι - - ꓲ
J Ј Ϳ - Ꭻ ꓙ
K К Κ - Ꮶ ꓗ
L - - - Ꮮ ꓡ
M М Μ - Ꮇ ꓟ
N - Ν - - ꓠ
O О Ο Օ - ꓳ
P Р Ρ - Ꮲ ꓑ
Q Ԛ - - - -
R - - - Ꭱ ꓣ
S Ѕ - Տ Ꮪ ꓢ
T Т Τ - Ꭲ ꓔ
U - - Ս - ꓴ
V Ѵ - - Ꮩ ꓦ
W Ԝ - - Ꮃ ꓪ
X Х Χ - - ꓫ
Y Ү Υ - - ꓬ
Z - Ζ - Ꮓ ꓜ
a а α - - -
c с ϲ - - -
d ԁ - - - -
e е - - - -
g - - ց - -
h һ - հ - -
i і - - - -
j ј ϳ յ - -
l ӏ - - - -
n - - ո - -
o о ο օ - -
p р ρ - - -
q ԛ - զ - -
s ѕ - - - -
u - - ս - -
v ѵ ν - - -
w ԝ - - - -
x х - - - -
y у - - - -
- Г Γ - - -
- П Π - - -
- Ф Φ - - -
- к κ - - -
"""
# Latin letters that share a shape with a plain one.
LATIN_TWINS = {"ɑ": "a", "ɡ": "g"}
# Scripts in common use, by their Unicode names; letters of others are told by the first word of their names.
SCRIPTS = """
Arabic Armenian Bengali Bopomofo Cherokee Coptic Cyrillic Devanagari Ethiopic Georgian Glagolitic Gothic Greek Gujarati Gurmukhi Han Hangul
Hebrew Hiragana Kannada Katakana Khmer Lao Latin Lisu Malayalam Mongolian Myanmar Nko Oriya Runic Sinhala Syriac Tamil Telugu Thaana Thai Tibetan Tifinagh Yi
"""
# Scripts written together under one name.
TOGETHER = {"Han": ("Japanese", "Korean", "HanBopomofo"), "Hiragana": ("Japanese",), "Katakana": ("Japanese",), "Hangul": ("Korean",), "Bopomofo": ("HanBopomofo",)}
# The kinds of hyphen.
HYPHENS = "‐‑‒–⁃˗−֊᠆﹘﹣－"
# Format characters that are drawn, and characters without width outside category Cf.
DRAWN_FORMATS = "؀؁؂؃؄؅۝܏࣢"
OTHER_ZERO_WIDTH = "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍"

# The long s and its ligature, visibly not an s.
LONG_S = "ſﬅ"

#: Distinct tokens whose spelling a worker remembers.
TOKEN_CACHE = 1 << 16
#: Texts of nothing but these are their own form: plain ASCII and composed Latin letters that have no twin.
PLAIN = r"^[\x20-\x7eÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž]*\z"

_TOKEN = re.compile(r"[^\W\d_][^\W\d_̀-ͯ]*(?:[̀-ͯ]+[^\W\d_]*)*")


def _shapes() -> dict[str, tuple[str, ...]]:
    by = {}
    for line in SHAPES.split("\n"):
        if line:
            row = line.split(" ")
            by |= {c: tuple(row) for c in row if c != "-"}
    return by


def _characters() -> dict[int, str]:
    """What single characters become, by the rules of the Unicode character database; shapes of the table stay as they are."""
    shapes, out = _shapes(), {}
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        kind = unicodedata.category(c)
        if c in shapes or kind in ("Cn", "Co", "Cs"):
            continue
        tag, _, rest = unicodedata.decomposition(c).partition("> ")
        if (kind == "Cf" and c not in DRAWN_FORMATS) or c in OTHER_ZERO_WIDTH or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF:
            out[n] = ""
        elif kind in ("Zs", "Zl", "Zp"):
            out[n] = " "
        elif c in HYPHENS:
            out[n] = "-"
        elif tag in ("<wide", "<narrow"):
            out[n] = unicodedata.normalize("NFKC", c)
        elif tag == "<compat" and c not in LONG_S:
            plain = unicodedata.normalize("NFKC", c)
            # roman numerals, ligatures and digraphs; other letters of their own shape, such as symbols of Greek, stay apart
            if all(unicodedata.category(x)[0] == "L" for x in plain) and (kind == "Nl" or kind in ("Ll", "Lu", "Lt") and len(plain) > 1):
                out[n] = plain
    out |= {ord(c): " " for c in "\t\n\r\x0b\x0c\x85"}
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], dict[str, tuple[str, ...]]]:
    return _characters(), _shapes()


@lru_cache(maxsize=1)
def _patterns() -> dict[str, regex.Pattern]:
    return {s: regex.compile(rf"\p{{scx={s}}}") for s in SCRIPTS.split()}


@lru_cache(maxsize=TOKEN_CACHE)
def scripts_of(letter: str) -> frozenset[str] | None:
    """The letter's own scripts and the names they go by together; None stands for all."""
    if regex.match(r"[\p{script=Common}\p{script=Inherited}]", letter):
        return None
    own = {s for s, p in _patterns().items() if p.match(letter)} or {unicodedata.name(letter, "?").split(" ")[0].title()}
    return frozenset(own.union(*(TOGETHER.get(s, ()) for s in own)))


@lru_cache(maxsize=TOKEN_CACHE)
def settle(token: str) -> tuple[str, bool, bool]:
    """(consistent spelling, mixed script, whole-script confusable) of a decomposed token."""
    shapes = _tables()[1]
    letters = [LATIN_TWINS.get(c, c) for c in token]
    own, possible = None, None
    votes = dict.fromkeys(SPELLED, 0)
    for c in letters:
        if unicodedata.category(c)[0] == "M":
            continue
        scripts, row = scripts_of(c), shapes.get(c)
        could = frozenset(s for s, x in zip(SPELLED, row) if x != "-") if row else scripts
        if scripts is not None:
            own = scripts if own is None else own & scripts
        if could is not None:
            possible = could if possible is None else possible & could
            for s in could & votes.keys():
                votes[s] += 1
    common = [s for s in SPELLED if possible is not None and s in possible]
    # what the shapes allow is the same for all spellings of one look, and so is a vote among them
    chosen = common[0] if common else max(SPELLED, key=lambda s: (votes[s], -SPELLED.index(s)))
    at = SPELLED.index(chosen)
    out = [(row[at] if row[at] != "-" else next(x for x in row if x != "-")) if (row := shapes.get(c)) else c for c in letters]
    mixed = own is not None and not own
    return "".join(out), mixed, bool(not mixed and own is not None and common and chosen not in own)


def unify(text: str) -> tuple[str, bool, bool]:
    """(form, has a mixed-script token, has a whole-script confusable token) of one text."""
    plain = unicodedata.normalize("NFD", text.translate(_tables()[0]))
    mixed = whole = False

    def one(m: re.Match) -> str:
        nonlocal mixed, whole
        t = m.group()
        if t.isascii():
            return t
        spelled, a, b = settle(t)
        mixed, whole = mixed or a, whole or b
        return spelled

    return unicodedata.normalize("NFC", _TOKEN.sub(one, plain)), mixed, whole


@F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("mixed", T.BooleanType()), T.StructField("whole", T.BooleanType())]))
def _unify_udf(texts: pd.Series) -> pd.DataFrame:
    done = [(None, None, None) if t is None else unify(t) for t in texts]
    return pd.DataFrame(done, columns=["form", "mixed", "whole"])


@F.pandas_udf(T.StringType())
def _form_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unify(t)[0] for t in texts], dtype=object)


def look_form(text: Column) -> Column:
    """The one form of a text; null for null, empty for empty. Plain Latin text stays in the JVM: only other texts reach Python."""
    return F.when(text.rlike(PLAIN), text).otherwise(_form_udf(F.when(~text.rlike(PLAIN), text)))


def unified(df: DataFrame, column: str, prefix: str = "look_") -> DataFrame:
    """Add ``look_form``, ``look_mixed`` and ``look_whole`` for ``column``; null texts give nulls. Columns of these names are replaced."""
    text = F.col(column)
    plain = text.rlike(PLAIN)
    parts = "_" + max(df.columns, key=len)  # a name that no column has
    done = df.withColumn(parts, _unify_udf(F.when(~plain, text)))
    return done.withColumns(
        {
            f"{prefix}form": F.when(plain, text).otherwise(F.col(parts)["form"]),
            f"{prefix}mixed": F.when(plain, F.lit(False)).otherwise(F.col(parts)["mixed"]),
            f"{prefix}whole": F.when(plain, F.lit(False)).otherwise(F.col(parts)["whole"]),
        }
    ).drop(parts)


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(look_form, class_id, members, spellings)``: of every form that more than one text has: its least key, its number of keys, and of different texts.

    Texts are compared by form; null texts and null keys are left out. With :func:`unified` giving every key its form,
    classes of any size come out without a row for each pair.
    """
    forms = df.select(F.col(key).alias("k"), F.col(text).alias("t"), look_form(F.col(text)).alias("look_form")).where("look_form is not null and k is not null")
    # equal texts become one state before they meet, so a class is as large as its number of spellings
    spelled = forms.groupBy("look_form", "t").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n"))
    return spelled.groupBy("look_form").agg(F.min("k").alias("class_id"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("spellings")).where("spellings > 1")


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(left_key, right_key)``: every two keys, smaller first, with different texts of one form.

    Keys must be unique; null texts look like nothing. The pairs are the asked-for result, so a class of
    n spellings gives n(n-1)/2 of them, in slices where a form is frequent; :func:`look_classes` gives the classes themselves.
    """
    forms = durable(df.select(F.col(key).alias("k"), F.col(text).alias("t"), look_form(F.col(text)).alias("f")).where("f is not null and k is not null"))
    hot = hot_keys(forms, "f")
    left = spread(forms, hot, "f", F.col("k"), salt="part").select(F.col("k").alias("left_key"), F.col("t").alias("lt"), "f", "part")
    right = replicate(forms, hot, "f", salt="part").select(F.col("k").alias("right_key"), F.col("t").alias("rt"), "f", "part")
    return left.join(right, ["f", "part"]).where("left_key < right_key and lt <> rt").select("left_key", "right_key")
