import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import quality
from pathloom.llm.quality import ANY, STATISTICS, UNITS, Fit, Profile, _lines, block_statistics, chi_square_quantile, chi_square_share, cutoff, fit_prose, not_prose, text_quality

PROSE = "The index was rebuilt before the users came back, and it was not clear to them why the search had been slow. We moved the folder to a new disk; that is why it will be found again when you look for it."
LIST = "\n".join(f"- [ ] module_{k}.toml ({k} files);" for k in range(12))
TABLE = "\n".join(f"| {k} | 17 | none | x{k} |" for k in range(12))
JUNK = "kq9X+/7fGh2LmPzQw81vB0aTtYu\n" * 12


def stats(text, common=None):
    p = Profile(common or {"en": ["the", "was", "and", "it", "to", "that", "is", "a", "for", "not", "we", "in", "of"]})
    return [(b.language, b.chars, dict(zip(STATISTICS, b.s)), b) for b in block_statistics(text, p)]


def test_statistics():
    ((lang, n, s, b),) = stats("The cat sat. It was 12 days!")
    assert lang == "en" and n == 28
    assert s["word_length"] == pytest.approx((3 + 3 + 3 + 2 + 3 + 4) / 6) and s["common_share"] == pytest.approx(3 / 6)
    assert s["digit_share"] == pytest.approx(2 / 22) and s["symbol_share"] == 0 and s["stop_share"] == 1 and s["marked_share"] == 0
    assert dict(zip(UNITS, b.u)) == {"words": 6, "tokens": 7, "lines": 1, "pieces": 2}
    ((_, _, s, _),) = stats(LIST)
    assert s["marked_share"] == 1 and s["running_share"] == 0
    ((_, _, s, b),) = stats(PROSE)
    assert s["running_share"] > 0.9 and b.proper[0] == len(PROSE.split()) and not b.shares
    ((_, _, s, b),) = stats("it was not the one that we had in mind")
    assert s["running_share"] == 0 and b.shares == [pytest.approx(7 / 10)] and b.parts == [1.0]
    ((_, _, s, _),) = stats("logs logs logs logs queues logs")
    assert s["repeats_per_word"] == pytest.approx((3 + 2 + 2 + 2) / 6)


def test_a_quotation_in_another_language_counts_there():
    common = {"en": ["the", "was", "and", "it", "to", "that"], "de": ["der", "und", "das", "ist", "nicht", "wir"]}
    (block,) = stats("It was the one that it was and that was the one to it. Der Hund und das ist nicht wir und der.", common)
    assert block[0] == "en" and block[2]["common_share"] > 0.7
    assert stats("xq zz kk", common)[0][0] is None


def test_chi_square():
    # fixed values from published tables
    for share, degrees, x in ((0.95, 10, 18.307), (0.99, 10, 23.209), (0.999, 10, 29.588), (0.95, 1, 3.841), (0.5, 4, 3.357)):
        assert chi_square_quantile(share, degrees) == pytest.approx(x, abs=2e-3)
        assert chi_square_share(x, degrees) == pytest.approx(share, abs=1e-4)
    assert chi_square_share(0, 3) == 0 and cutoff(1e-3) == pytest.approx(29.588, abs=2e-3)


def made(spark, n, scale=1.0, lang="en", seed=0, mean=0.5):
    """Blocks of prose whose statistics spread by ``scale``."""
    rng = np.random.default_rng(seed)
    rows = [(lang, 400, (mean + scale * rng.normal(size=len(STATISTICS)) * 0.02).tolist(), [200.0, 220.0, 8.0, 9.0]) for _ in range(n)]
    return spark.createDataFrame(rows, "language string, chars bigint, s array<double>, u array<double>")


def test_variances_follow_the_data(spark):
    narrow, wide = fit_prose(made(spark, 2000))["en"], fit_prose(made(spark, 2000, 2.0))["en"]
    ratio = np.diag(wide.cov) / np.diag(narrow.cov)
    assert ratio == pytest.approx(np.full(len(STATISTICS), 4.0), rel=0.1)
    assert np.sqrt(np.diag(narrow.cov)) == pytest.approx(np.full(len(STATISTICS), 0.02), rel=0.1)


def test_far_blocks_do_not_spoil_the_estimate(spark):
    clean = fit_prose(made(spark, 2000))["en"]
    mixed = fit_prose(made(spark, 2000).union(made(spark, 20, 30.0, seed=5)))["en"]
    assert mixed.mean == pytest.approx(clean.mean, abs=0.01) and np.diag(mixed.cov) == pytest.approx(np.diag(clean.cov), rel=0.3)


def test_a_language_comes_into_its_own_step_by_step(spark):
    pool = made(spark, 3000, mean=0.5)
    means = []
    for n in (1, 4, 5, 6, 29, 30, 31, 300):
        fits = fit_prose(pool.union(made(spark, n, lang="fi", seed=n, mean=0.53)))
        means.append(fits["fi"].mean.mean() - fits[ANY].mean.mean())
    steps = np.diff(means)
    assert means[0] < 0.002 and means[-1] > 0.02 and (steps[1:3] < 0.002).all() and (np.abs(steps[4:6]) < 0.002).all() and steps[3] > 0.004


def test_every_statistic_counts():
    rng = np.random.default_rng(2)
    d = len(STATISTICS)
    half = rng.normal(size=(d, d)) * 0.05
    fit = Fit.of(np.full(d, 0.4), half @ half.T + np.eye(d) * 0.01, np.full(len(UNITS), 1000.0))
    x, u = fit.mean + rng.normal(size=(20, d)) * 0.2, np.full((20, len(UNITS)), 50.0)
    parts = fit.contributions(x, u)
    for k in range(d):
        moved = x.copy()
        moved[:, k] = fit.mean[k]
        assert (np.abs(fit.contributions(moved, u).sum(axis=1) - parts.sum(axis=1)) > 1e-4).all()
    # what few units may show by chance is nothing unusual
    assert (fit.contributions(x, np.full((20, len(UNITS)), 1.0)).sum(axis=1) < parts.sum(axis=1)).all()


def test_lines_are_unwrapped():
    import textwrap

    wrapped = "\n".join(textwrap.wrap(PROSE, 44))
    assert list(_lines(wrapped)) == [[PROSE]]
    assert list(_lines("> " + wrapped.replace("\n", "\n> "))) == [[PROSE]]
    short = "ties, logs\nusers\nnames, disks\nlogs"
    assert [len(p) for p in _lines(short)] == [4]
    assert list(_lines("")) == [] == list(_lines("\n \n"))
    assert list(_lines("a   b   c   d")) == [["a b c d"]]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "z", 2.0) for r in rows], "doc_id bigint, text string, lang string, k int, s string, chars double")


def commons(spark):
    return spark.createDataFrame([("en", w) for w in ("the", "was", "and", "it", "to", "that", "is", "a", "for", "not", "we", "in", "of", "them", "why", "had", "been", "when", "you")] + [(None, "x"), ("en", None)], "lang string, word string")


def corpus():
    rows = [(k, PROSE.replace("index", f"index{'abcdefghij'[k % 10]}") + (" It was so." * (k % 3)), ["en", "EN ", None, "und"][k % 4]) for k in range(60)]
    rows += [(100, LIST, "en"), (101, TABLE, "en"), (102, JUNK, "en"), (103, PROSE + "\n\n" + LIST[:60], "en"), (104, PROSE[:80] + "\n\n" + TABLE * 3, "xx")]
    rows += [(200, None, "en"), (201, "", None), (202, " \n\n ", "en"), (203, "!!!", "en"), (204, (PROSE + " ") * 2000, "en"), (None, LIST, "en")]
    return rows


def test_not_prose(spark):
    got = {r.doc_id for r in not_prose(docs_of(spark, corpus()), commons(spark), key="doc_id", text="text", lang="lang").collect()}
    assert {100, 101, 102, 104} <= got and not got & {*range(60), 103, 200, 201, 202, 204} and None not in got


def test_contributions_add_up(spark):
    rows = text_quality(docs_of(spark, corpus()), commons(spark), key="doc_id", text="text", lang="lang").collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(by) == 60 + 5 + 5
    for r in rows:
        if r.chars:
            assert sum(r[f"from_{n}"] for n in STATISTICS) == pytest.approx(r.distance, rel=1e-6)
            assert r.is_prose == (r.outlying_share <= 0.5)
        else:
            assert r.distance is None and not r.is_prose and r.word_length is None
    assert by[100].distance > cutoff() and by[101].distance > cutoff()
    assert by[5].language == "en" and by[5].distance < cutoff() < by[102].distance
    assert by[100].words > 0 and by[100].stop_line_share == 0 and by[5].stop_line_share == 1 and by[200].words is None


def test_small_and_empty(spark):
    none = docs_of(spark, [])
    assert not_prose(none, commons(spark), key="doc_id", text="text", lang="lang").count() == 0
    assert text_quality(none, commons(spark), key="doc_id", text="text", lang="lang").count() == 0
    one = docs_of(spark, [(1, "x", "en")])
    assert text_quality(one, commons(spark).where("false"), key="doc_id", text="text", lang="lang").count() == 1


def test_distance_is_the_definition(spark):
    rng = np.random.default_rng(1)
    d = len(STATISTICS)
    fit = Fit.of(rng.uniform(0.2, 0.8, d), np.diag(rng.uniform(1, 2, d)), np.full(len(UNITS), 98.0))
    x, u = rng.normal(size=d), np.array([10.0, 12.0, 2.0, 3.0])
    df = spark.createDataFrame([("en", x.tolist(), u.tolist()), ("zz", x.tolist(), u.tolist()), (None, x.tolist(), u.tolist())], "l string, s array<double>, u array<double>")
    got = [r.d for r in df.select(quality._distances({ANY: fit}, False)("l", "s", "u").alias("d")).collect()]
    units = np.array([u[UNITS.index(n)] for n in STATISTICS.values()])
    r = x - fit.mean
    want = r @ np.linalg.inv(fit.cov + np.diag(fit.unit / units)) @ r
    assert got == pytest.approx([want] * 3)
    parts = df.select(F.explode(quality._distances({ANY: fit}, True)("l", "s", "u")).alias("d")).groupBy().sum("d").first()[0]
    assert parts == pytest.approx(3 * want)
    share = list(STATISTICS).index("stop_share")
    p = (fit.mean[share] * 98 + 1) / 100
    assert fit.unit[share] == pytest.approx(p * (1 - p))


def test_learned_words(spark):
    rows = [(k, "het bestand dat wij hebben gevonden " * 3 + "abcdefgh"[k], "nl-NL") for k in range(8)] + [(9, "one text only", "fi")]
    words = quality.common_words_of(docs_of(spark, rows), commons(spark), text="text", lang="lang", word_lang="lang", word="word")
    assert words["nl"] == ["bestand"] and "fi" not in words and "the" in words["en"]  # 8 of 13 documents' worth of 0.4: one word in six

    def learned(n):
        texts = [(k, "het bestand dat wij hebben gevonden", "nl") for k in range(n)]
        return len(quality.common_words_of(docs_of(spark, texts), commons(spark), text="text", lang="lang", word_lang="lang", word="word").get("nl", []))

    counts = [learned(n) for n in (1, 4, 5, 6, 40)]
    assert counts == sorted(counts) and max(np.diff(counts)) <= 1 and counts[-1] == 2


def test_plain_statistics(spark):
    text = "The cat sat.  It was 12 days!\n\n  - a <b>\nnaïve \u2026\" \n"
    df = docs_of(spark, [(1, text, "en"), (2, "", "en"), (3, None, "en"), (4, "\n \n", "en"), (5, "x" * 100_000, None)])
    got = {r.doc_id: r for r in df.select("doc_id", quality.plain_statistics(F.col("text"), {"en": ["the", "was", "a"], "de": ["it"]}).alias("p")).select("doc_id", "p.*").collect()}
    r = got[1]
    assert (r.text_chars, r.words, r.mean_word_length, r.common_word_share) == (len(text), 9, round((3 * 3 + 2 + 3 + 4 + 1 + 1 + 5) / 9, 6), round(3 / 9, 6))
    assert r.stop_line_share == round(2 / 3, 6) and r.symbol_ratio == round(7 / len(text), 6)
    assert (got[2].words, got[2].mean_word_length, got[2].stop_line_share, got[2].text_chars) == (0, None, None, 0)
    assert got[3].words is None and got[3].text_chars is None and got[4].stop_line_share is None and got[5].words == 1
