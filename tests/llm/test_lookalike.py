import random
import re

import pytest
from pyspark.sql import functions as F

from pathloom.llm.lookalike import PLAIN, look_classes, look_form, same_look_pairs, scripts_of, settle, unified, unify

SAME = [
    ("ｒｅａｄｍｅ．ｔｘｔ", "readme.txt"), ("café", "café"), ("re​ad﻿me", "readme"), ("a b　c d", "a b c d"), ("x‐y‑z－w", "x-y-z-w"), ("раураl", "paypal"), ("ρasswοrd", "password"), ("ⅿаіn", "main"),
    ("oтчёт", "отчёт"), ("йогyрт", "йогурт"), ("й", "й"), ("ɡlɑcier", "glacier"), ("ΒΕΤΑ", "BETA"), ("ｶﾞ", "ガ"), ("ﬁle", "file"), ("εικόvα", "εικόνα"), ("고", "고"), ("сору", "copy"), ("­soft", "soft"), ("a️b", "ab"), ("／x", "/x"),
]
DIFFERENT = [("Readme", "readme"), ("cafe", "café"), ("отчет", "отчёт"), ("a_b", "a-b"), ("l", "1"), ("O", "0"), ("x²", "x2"), ("ハ", "パ"), ("a", "b"), ("a b", "a  b"), ("i", "ι"), ("п", "n")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert unify(a)[0] == unify(b)[0]


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert unify(a)[0] != unify(b)[0]


def test_consistent_spelling():
    assert settle("журнaл") == ("журнал", True, False)  # a Latin letter in a Cyrillic word becomes Cyrillic
    assert settle("tіmber") == ("timber", True, False)
    assert settle("сору") == ("copy", False, True)  # wholly Cyrillic, wholly spellable in Latin
    assert settle("список") == ("список", False, False)
    assert unify("naïve café")[0] == "naïve café"
    assert unify("wжο")[0] == unify("wжo")[0]  # no script spells all of it, still one form


def test_script_sets():
    # scripts written together, and letters of no script of their own, mix nothing
    for t in ("日本語のテスト", "データベース", "한국어", "漢字한글", "naïveº", "обʼєкт", "ㄅ漢"):
        assert unify(t)[1:] == (False, False), t
    assert unify("обʼєкт")[0] == "обʼєкт"
    for t in ("日本語сору", "のх한", "адmin", "παypal"):
        assert unify(t)[1], t
    assert scripts_of("日") >= {"Han", "Japanese", "Korean"} and scripts_of("ʼ") is None and scripts_of("º") == {"Latin"}


def test_shapes_before_decomposition():
    assert unify("ϲode")[0] == "code" and unify("ϹAT")[0] == "CAT"
    assert unify("ſun")[0] == "ſun" != unify("sun")[0]
    assert unify("ϑ")[0] != unify("θ")[0]


def test_more_scripts():
    assert unify("ꓮꓐꓚ") == ("ABC", False, True) and unify("ᎪᏴᏟ".replace("Ꮯ", "Ꮯ"))[2]
    assert unify("հօ") == ("ho", False, True) and unify("հայ")[0] == "հայ"
    # no script spells all of it: that of most letters is taken, whatever the spelling was
    assert unify("журналdж")[0] == unify("журналԁж")[0] and unify("дaдaдw")[0] == "дададԝ"


def test_classes(spark):
    rows = [(1, "a"), (2, "ａ"), (3, "а"), (4, "A"), (5, None), (None, "a"), (7, "b"), (8, "b"), (9, ""), (10, "a")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "id bigint, name string, k string, look_form string")
    assert [tuple(r) for r in look_classes(df, "id", "name").collect()] == [("a", 1, 4, 3)]
    assert look_classes(df.where("false"), "id", "name").count() == 0


def test_idempotent_and_long():
    for a, b in SAME:
        assert unify(unify(a)[0])[0] == unify(a)[0]
    text = "Ｗｏｒｄ про​ба " * 20_000
    assert unify(text)[0] == "Word проба " * 20_000
    assert unify("")[0] == "" and unify("​")[0] == ""


def test_plain_text_is_its_own_form():
    plain = re.compile(PLAIN.replace(r"\z", r"\Z"))
    letters = [c for c in map(chr, range(0x20, 0x250)) if plain.match(c)]
    assert len(letters) > 200 and not plain.match("a\n")
    random.seed(1)
    for text in [*letters, "".join(letters), *("".join(random.choices(letters, k=30)) for _ in range(500))]:
        assert unify(text) == (text, False, False)


def test_columns(spark):
    df = spark.createDataFrame([(1, "ｘ", "old"), (2, None, "old"), (3, "", "old"), (4, "tab\there", "old"), (5, "раураl", "old")], "k bigint, t string, look_form string").withColumn("__u", F.lit(1))
    got = {r.k: (r.look_form, r.look_mixed, r.look_whole) for r in unified(df, "t").collect()}
    assert got == {1: ("x", False, False), 2: (None, None, None), 3: ("", False, False), 4: ("tab here", False, False), 5: ("paypal", True, False)}
    assert [r.f for r in df.orderBy("k").select(look_form(F.col("t")).alias("f")).collect()] == ["x", None, "", "tab here", "paypal"]


def test_pairs(spark):
    rows = [(1, "a"), (2, "ａ"), (3, "а"), (4, "A"), (5, None), (6, None), (7, "b"), (8, "b"), (9, "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "id bigint, name string, k string, f string")
    assert {tuple(r) for r in same_look_pairs(df, "id", "name").collect()} == {(1, 2), (1, 3), (2, 3)}
    assert same_look_pairs(df.where("false"), "id", "name").count() == 0


def test_found_query_equals_brute_force(spark, data):
    import duckdb

    from pathloom.llm.queries import p5_found

    con = duckdb.connect()
    read = lambda sql: con.execute(sql.replace("@", data)).fetchall()
    names = read("select name_offset, name from '@/arena_names.parquet'")
    by = {}
    for k, n in names:
        by.setdefault(unify(n)[0], []).append((k, n))
    want = {("name", min(a, b), max(a, b)) for v in by.values() for a, x in v for b, y in v if a < b and x != y}
    paths = {}
    for k, p in read("select path_offset, path from '@/arena_paths.parquet'"):
        paths.setdefault(unify(p)[0], []).append((k, p))
    for h, p, n in read("select distinct hit_id, path, name from '@/search_results.parquet' where path is not null and name is not null"):
        for k, q in paths.get(unify(p)[0], []):
            base = q.split("/")[-1]
            if unify(n)[0] == unify(base)[0] and (p != q or n != base):
                want.add(("hit", h, k))
    got = [tuple(r) for r in p5_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want
