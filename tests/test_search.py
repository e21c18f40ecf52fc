"""Matching, scoring, ranking, scopes, filters and the index."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.functions import display, paths, ranking
from pathloom.operators import grouping, index, requests
from pathloom.operators.search import Request, recent, search, search_dsl, search_many
from pathloom.plans import dsl

FILES = "file_id bigint, path string, name string, size bigint, mtime bigint, dev bigint, ino bigint, is_dir boolean"


def files_of(spark, *rows):
    made = [(k, p, p.rsplit("/", 1)[-1] if n is None else n, 1, m, 1, k, False) for k, (p, n, m) in enumerate(rows)]
    return index.build(spark.createDataFrame(made, FILES))


def found(df):
    return [r.path for r in df.orderBy("rank").collect()]


HOME = "/Users/alice/Projects/"
CORPUS = [
    ("/Users/alice/go/pkg/mod/github.com/x/y@v1/server.go", None, 900), ("/Users/alice/go/pkg/mod/github.com/x/z@v2/search.go", None, 900), ("/Users/alice/Library/Caches/app/invoice_2024.pdf", None, 990),
    ("/Users/alice/other/node_modules/p/settings.json", None, 800), (HOME + "rs/target/debug/notes.txt", None, 700), (HOME + "example-app/server.go", None, 500), (HOME + "example-app/handlers/search/search.go", None, 400),
    (HOME + "example-app/settings.json", None, 300), ("/Users/alice/Documents/invoice_2024.pdf", None, 200), ("/Users/alice/Pictures/IMG_0001.JPG", None, 100), ("/Users/alice/Notes/meeting-notes.txt", None, 90),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return files_of(spark, *CORPUS).cache()


def test_useful_files_come_before_noise(corpus):
    assert found(search(corpus, Request("server.go")))[0] == HOME + "example-app/server.go"
    assert found(search(corpus, Request("search.go")))[0].endswith("handlers/search/search.go")
    assert found(search(corpus, Request("invoice")))[0] == "/Users/alice/Documents/invoice_2024.pdf"
    assert found(search(corpus, Request("settings.json", boost_scope=HOME + "example-app")))[0] == HOME + "example-app/settings.json"
    assert found(search(corpus, Request("IMG_0001"))) == ["/Users/alice/Pictures/IMG_0001.JPG"]
    assert len(found(search(corpus, Request("notes")))) >= 2


def test_scores(spark):
    df = spark.createDataFrame([("main.rs",), ("main",), ("my_main.rs",), ("a main",), ("domain",), ("x-main",), ("none",)], "n string")
    got = {r.n: round(r.s, 6) for r in df.select("n", ranking.name_score(F.col("n"), "main").alias("s")).collect()}
    assert got == {"main.rs": 0.951429, "main": 1.0, "my_main.rs": 0.7, "a main": 0.7, "domain": 0.5, "x-main": 0.5, "none": 0.3}


@pytest.mark.parametrize("q,path,strategy,least", [
    ("main", "src/main.rs", "exact_prefix", 0.98), ("src", "src/main.rs", "exact_prefix", 0.98), ("vcs", "vicuna-core/src/main.rs", "component_first", 0.95), ("vcm", "vicuna-core/src/main.rs", "component_first", 0.95),
    ("CT", "Cargo.toml", None, 0.85), ("cargo", "Cargo.toml", "exact_prefix", 0.95), ("abc", "admin/backup/config.toml", None, 0.90), ("xyz", "src/main.rs", None, None), ("test", "日本語/test.txt", "exact_prefix", 0.98), ("", "a", None, None),
    ("main", "admin/main.rs", "exact_prefix", 0.98), ("mn", "/x/domain", "sequential", 0.5), ("a]^", "x/a]^b", None, 0.5), ("q'\\", "a/q-'-\\", None, 0.5),
])
def test_abbreviations(spark, q, path, strategy, least):
    df = spark.createDataFrame([(path, path.rsplit("/", 1)[-1])], "path string, name string")
    a = ranking.with_abbreviation_columns(df).select(ranking.abbreviation(q).alias("a")).first().a
    if least is None:
        assert a is None
    else:
        assert a.score >= least and (strategy is None or a.strategy == strategy)


def test_sequence_positions(spark):
    """main in admin/main.rs: the leftmost greedy positions are 2, 7, 8, 9."""
    s = spark.createDataFrame([("admin/main.rs",)], "p string").select(ranking.sequential_score("p", "main").alias("s")).first().s
    assert s == pytest.approx(0.70 + 2 / 4 * 0.05 + (26 / 4) / 13 * 0.10 - (8 - 4) / 13 * 0.10)


def test_scopes(spark):
    fx = files_of(spark, ("/repo-a/src/query.rs", None, 1), ("/repo-b/query.rs", None, 2), ("/repo-a-x/query.rs", None, 3), ("/repo-a/query", None, 4))
    assert set(found(search(fx, Request("query", filter_scope="/repo-a/")))) == {"/repo-a/src/query.rs", "/repo-a/query"}
    assert set(found(search(fx, Request("query", filter_scope="x/../../repo-b", cwd="/y")))) == {"/repo-b/query.rs"}
    assert found(search(fx, Request("query", filter_scope="  "))) != []
    odd = spark.createDataFrame([("a/./b/../c",), ("/x//y/",), ("/../z",), ("/n/m",)], "p string")
    assert [r.c for r in odd.select(paths.lexical_column(F.col("p"), "/cwd").alias("c")).collect()] == ["/cwd/a/c", "/x/y", "/z", "/n/m"]


def test_exact_name_first_and_empty_in_scope(spark):
    fx = files_of(spark, ("/a/b.rs", None, 1), ("/c/d/b.rs", None, 9), ("/c/ab.rs", None, 3))
    assert found(search(fx, Request("B.rs", exact_first=True))) == ["/c/d/b.rs", "/a/b.rs"]
    assert found(search(fx, Request("b.rs", exact_first=True, filter_scope="/nowhere"))) == []
    assert len(found(search(fx, Request("b.rs")))) == 3


def test_recents_and_blank(spark):
    fx = files_of(spark, ("/a", None, 100), ("/b", None, 300), ("/c", "", 900), ("/d", None, 300))
    assert found(recent(fx, Request("", 10))) == ["/b", "/d", "/a"]
    assert found(search(fx, Request(" ", 1, recent_if_empty=True))) == ["/b"]
    assert {round(r.score, 4) for r in search(fx, Request("")).collect()} == {0.9}
    assert found(search(fx, Request("zzz", 0))) == []


def test_bounded_scan(spark):
    rows = [(k, f"/d/file_{k}.txt", f"file_{k}.txt", 1, k, 1, k, False) for k in range(2000)]
    fx = index.build(spark.createDataFrame(rows, FILES))
    assert found(search(fx, Request("*", 100, scan_bounds=True))) == []
    got = found(search(fx, Request("5", 50, scan_bounds=True)))
    assert len(got) == 50 and all("5" in p for p in got)
    capped = found(search(fx, Request("file", 10, mode="indexed", candidate_cap=30)))
    assert len(capped) == 10 and all(int(p[8:-4]) < 30 for p in capped)


def test_unicode_and_regex_characters(spark):
    fx = files_of(spark, ("/x/Überblick.md", None, 1), ("/x/a[b]*c", None, 2))
    assert found(search(fx, Request("über"))) == ["/x/Überblick.md"]
    assert found(search(fx, Request("[b]*"))) == ["/x/a[b]*c"]


@pytest.mark.parametrize("at_once", [0, 1_000])
def test_search_many_is_many_searches(spark, at_once):
    fx = files_of(spark, *[(f"/d{k % 3}/report_{k}.txt", None, k) for k in range(60)])
    asked = spark.createDataFrame([(1, "Report_1", 5), (1, "Report_1", 5), (2, "x", 3), (3, "nothing", 9), (4, None, 5), (5, "d2/", 4), (6, "port", 0), (7, "", 3)], "query_id bigint, term string, n int")
    many = search_many(fx, asked, query_id="query_id", term="term", limit="n", at_once=at_once).collect()
    for q, t, n in ((1, "report_1", 5), (2, "x", 3), (5, "d2/", 4)):
        single = found(search(fx.where(F.contains("name_lc", F.lit(t)) | F.contains("path_lc", F.lit(t))), Request(t, n)))
        assert [r.path for r in sorted((r for r in many if r.query_id == q), key=lambda r: r.rank)] == single
    assert {r.query_id for r in many} == {1, 2, 5}


@pytest.mark.parametrize("at_once", [0, 1_000])
def test_search_many_answers_whole_requests(spark, at_once):
    """Scopes, boosts and abbreviations: each answer is that of one unfiltered search."""
    paths_ = [f"/repo{'-a' * (k % 2)}/{d}/{n}" for k in range(6) for d, n in (("src", f"main_{k}.rs"), (f"Module{k}/Inner", "Query Plan.md"), ("t/ü", f"mn{k}"), ("lib/target", "maintain"))]
    fx = files_of(spark, *[(p, "alias mn" if k % 7 == 0 else None, k % 5) for k, p in enumerate(dict.fromkeys(paths_))]).cache()
    scopes = [None, " ", "/repo", "/repo-a/", "repo/src", "/repo/x/../lib//", "/", "/nowhere"]
    terms = ["mn", "MAIN", "rsm", "qp", "main_", "ü", "alias", "m 3", "zq", "q'"]
    asked = [(1 + k, t, 1 + 7 * k % 23, scopes[k % 8], scopes[k * 3 // 8 % 8]) for k, t in enumerate(terms * 4)]
    table_ = spark.createDataFrame([*asked, asked[0]], "query_id bigint, term string, n int, f string, b string")
    many = search_many(fx, table_, query_id="query_id", term="term", limit="n", filter_scope="f", boost_scope="b", at_once=at_once).collect()
    got: dict = {}
    for r in sorted(many, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.path, r.score))
    for q, t, n, f, b in asked:
        single = search(fx, Request(t, n, filter_scope=f, boost_scope=b)).orderBy("rank").collect()
        assert got.get(q, []) == [(r.rank, r.path, r.score) for r in single], (t, n, f, b)


def _out_of_python(plan):
    """Rows that the Python operators of an executed plan gave back."""
    kind = plan.getClass().getSimpleName()
    below = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    if below is not None:
        return _out_of_python(below)
    own = plan.metrics().apply("pythonNumRowsReceived").value() if kind == "MapInArrowExec" else 0
    return own + sum(_out_of_python(plan.children().apply(k)) for k in range(plan.children().size()))


def test_search_many_moves_the_best_alone(spark):
    """However many files match, a task lets out no more than the limit of each request."""
    fx = files_of(spark, *[(f"/d{k % 3}/report_{k}.txt", None, k) for k in range(300)])
    asked = spark.createDataFrame([(1, "report", 3, None), (2, "report", 2, "/d1"), (3, "rpt", 3, "/d2"), (4, "txt", 1, None)], "query_id bigint, term string, n int, b string")
    many = search_many(fx, asked, query_id="query_id", term="term", limit="n", boost_scope="b")
    assert len(many.collect()) == 9
    assert 9 <= _out_of_python(many._jdf.queryExecution().executedPlan()) <= 9 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("at_once", [3, 4])
def test_search_many_in_passes(spark, at_once):
    fx = files_of(spark, *[(f"/d{k % 3}/report_{k}.txt", None, k) for k in range(40)])
    asked = spark.createDataFrame([(k, t, 4, b) for k, (t, b) in enumerate((t, b) for t in ("report", "rpt", "txt", "d2/") for b in (None, "/d1", "/d2"))], "query_id bigint, term string, n int, b string")
    ask = lambda n: sorted(map(tuple, search_many(fx, asked, query_id="query_id", term="term", limit="n", boost_scope="b", at_once=n).collect()))
    once = ask(1_000)
    assert len(once) == 48 and ask(at_once) == once
    assert search_many(fx, asked.withColumn("n", F.lit(0)), query_id="query_id", term="term", limit="n", at_once=at_once - 3).collect() == []


def test_best_of_blocks_of_any_size(monkeypatch):
    """Blocks and chunks change what leaves a task, not what is best of it."""
    paths_ = sorted({f"/r{k % 4}{'/é' * (k % 2)}/{'x' * (k % 9)}_main{k % 5}/Mod {k}.rs" for k in range(120)} | {"/r1", "/r1-a/main", "/r1/main", "/m\0n"})
    low = [p.lower() for p in paths_]
    columns = {"name_lc": [p.rsplit("/", 1)[-1] for p in low], "path_lc": low, "path": paths_, "mtime": [k % 6 or None for k in range(len(low))], "depth": [p.count("/") + 1 for p in low], "context": [-60 * (k % 2) for k in range(len(low))], "initials": ["/" + "".join(c[:1] for c in p.split("/")) for p in low], "mask": low}
    types = {"mtime": pa.int64(), "depth": pa.int32(), "context": pa.int32()}
    files = pa.table({c: pa.array(v, types.get(c, pa.string())) for c, v in columns.items()})
    asked = [(t, w, b, n) for t in ("main", "mn", "rm", "é", "/r1", "mod 1", "zz", "m\0") for w in ("", "/r1", "/") for b in ("", "/r2", "/r1") for n in (1, 8, 500)]
    table_ = pa.table(dict(zip(("t", "within", "near", "n"), map(list, zip(*asked)))))

    def best():
        got: dict = {}
        for batch in requests.best_of_blocks(table_, True)(files.to_batches(max_chunksize=11)):
            for r in batch.to_pylist():
                got.setdefault(r["g"], []).append((-r["score"], -r["place"], -(r["mtime"] or 0), r["depth"], r["path"].encode()))
        assert all(len(rows) == len(set(rows)) for rows in got.values())
        return {g: sorted(rows)[: asked[g][3]] for g, rows in got.items()}

    whole = best()
    for block, chunk in ((7, 3), (1, 1), (64, 10)):
        monkeypatch.setattr(requests, "BLOCK", block)
        monkeypatch.setattr(requests, "CHUNK", chunk)
        assert best() == whole
    assert {asked[g][0] for g in whole} == {"main", "mn", "rm", "é", "/r1", "mod 1", "m\0"}


def test_dsl():
    p = dsl.parse("foo ext:rs,.MD type:file path:Src/ bar", 1000)
    assert (p.term, p.exts, p.is_dir, p.paths) == ("foo bar", ("md", "rs"), False, ("src/",))
    assert dsl.parse_size(">10mb") == dsl.Compare(">", 10485760)
    assert dsl.parse_mtime("<7d", 1000) == dsl.Compare(">", 1000 - 604800)
    assert dsl.parse("size:>1mb,<100mb x").term == "size:>1mb,<100mb x"
    assert dsl.parse("size:>1.5mb").size is None and dsl.parse("type:odd ext:, path:").term == "type:odd ext:, path:"
    assert dsl.parse("size:>1 size:<=2k mtime:=2024-02-30 type:d type:f").size == dsl.Compare("<=", 2048)
    assert dsl.parse_mtime(">=1970-01-02", 0) == dsl.Compare(">=", 86400)
    assert dsl.parse_mtime("=1970-01-01", 0, "Europe/Berlin") == dsl.Compare("=", -3600)


def test_filters_before_and_after_the_limit(spark):
    fx = files_of(spark, *[(f"/p/a{k}.{'rs' if k == 9 else 'md'}", None, 10 - k) for k in range(10)])
    assert found(search_dsl(fx, "a ext:rs", now=0, limit=5)) == ["/p/a9.rs"]
    assert found(search_dsl(fx, "a ext:rs", now=0, limit=5, filter_stage="post")) == []


def test_exclusions(spark):
    rows = ["/usr/bin/ls", "/home/examplebinuser/x", "/a/b.tmp", "/a/cache_1/x", "/a/Target/x", "/v", "/a/x~"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    keep = lambda *pats: [r.p for r in df.where(~paths.excluded(F.col("p"), pats)).collect()]
    assert keep("/bin") == [r for r in rows if r != "/usr/bin/ls"]
    assert keep("*.tmp", "cache*", "target", "*", "*~") == ["/usr/bin/ls", "/home/examplebinuser/x", "/a/Target/x", "/v", "/a/x~"]
    assert keep() == rows


def test_paths(spark):
    df = spark.createDataFrame([("/",), ("/a",), ("/a/b.tar.gz",), ("a/./b",), ("./a",), ("x",), ("/a/.bashrc",), ("/a//b/",)], "p string")
    p = F.col("p")
    got = df.select(paths.depth(p), paths.parent(p), paths.extension(paths.basename(p))).collect()
    assert [r[0] for r in got] == [1, 2, 3, 2, 2, 1, 3, 3]
    assert [r[1] for r in got[:3]] == ["/", "/", "/a"] and got[5][1] == ""
    assert [got[k][2] for k in (2, 6)] == ["gz", ""]


def test_display(spark):
    df = spark.createDataFrame([("  x\ty" + "z" * 100,), ("ok",), ("a\x00b",)], "l string")
    l = F.col("l")  # noqa: E741
    got = df.select(display.snippet(l), display.printable(l)).collect()
    assert got[0][0] == "x y" + "z" * 93 + "..." and got[1][0] == "ok" and got[2][0] == "a b"
    assert got[0][1].startswith("  x    y") and got[2][1] == "a�b"
    assert display.breadcrumbs(["home", "alice", "work"], 60) == "home ▸ alice ▸ work"
    assert display.breadcrumbs(["home", "alice", "work"], 14) == "…work"
    line = spark.createDataFrame([(1, 0.95, 0, "/a")], "r int, s double, m bigint, p string").select(display.result_line(F.col("r"), F.col("s"), F.col("m"), F.col("p")).alias("x")).first().x
    assert line.split() == ["1", "0.95", "1970-01-01", "00:00", "/a"]
    label = spark.createDataFrame([("/r/a/x.rs",), ("/r/y",), ("/q/z",)], "p string").select(display.directory_label(F.col("p"), "/r"), display.extension_label(F.col("p"))).collect()
    assert [tuple(r) for r in label] == [("dir: a/", "ext: rs"), ("dir: ./", "ext: (none)"), ("dir: /q/", "ext: (none)")]


def test_groups_and_listings(spark):
    rows = spark.createDataFrame([(1, "/a/x"), (2, "/a/y"), (3, "/b/z"), (4, "/a/w")], "rank int, path string")
    runs = grouping.group_runs(rows, display.directory_label(F.col("path"))).orderBy("rank").collect()
    assert [(r.header, r.run) for r in runs] == [(True, 1), (False, 1), (True, 2), (True, 3)]
    fx = files_of(spark, ("/a/x", None, 1), ("/a/b/y", None, 1))
    assert [r.entry for r in grouping.directory_listing(fx, "/a/").collect()] == ["x"]


def test_trigrams(spark):
    df = spark.createDataFrame([("aBcd",), ("ab",), ("",), (None,), ("é1",)], "n string")
    got = [r.t for r in df.select(index.trigrams(F.col("n")).alias("t")).collect()]
    assert got[0] == index.trigrams_of("abcd") and got[1] == [] and got[2] == [] and got[3] is None and got[4] == index.trigrams_of("é1")
    fx = files_of(spark, ("/abcabc", None, 1), ("/xabc", None, 1), ("/bca", None, 1))
    lists = {r.trigram: r.file_ids for r in index.postings(fx).collect()}
    assert lists[index.trigrams_of("abc")[0]] == [0, 1]
    assert [r.file_id for r in index.candidates(index.grams(fx), "abca").collect()] == [0]
    assert index.trigram_count(fx).first()[0] == index.trigram_count(fx, approximate=True).first()[0]


def test_search_plan_prunes_and_pushes(spark, tmp_path):
    files_of(spark, ("/a/b.rs", None, 1)).write.parquet(str(tmp_path / "fx"))
    fx = spark.read.parquet(str(tmp_path / "fx"))
    scoped = search(fx, Request("b.rs", filter_scope="/a"))
    text = scoped._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in text and "ArrowEval" not in text and "StringStartsWith(path,/a/)" in text


def test_capitals_earn_a_bonus_and_case_may_matter(spark):
    df = ranking.with_case_columns(ranking.with_abbreviation_columns(spark.createDataFrame([("/x/MyClass", "MyClass"), ("/x/my_Class", "my_Class"), ("src/main.rs", "main.rs")], "path string, name string")))
    scores = lambda q, cs=False: [r.s and round(r.s, 6) for r in df.select(ranking.abbreviation(q, cs)["score"].alias("s")).collect()]
    assert scores("MC") == [0.95, 0.99, None] and scores("mc") == [0.9, 0.99, None]
    assert scores("MAIN", True) == [None, None, None] and scores("main", True) == [None, None, 1.0] and scores("MC", True)[:2] == [0.95, None]


def test_bounds_change_what_is_found(spark):
    from pathloom.queries import files as named
    from tests.conftest import DATA

    fx = index.build(named.tables.files(spark, DATA)).cache()
    paths_of = lambda **o: found(search(fx, Request(**o)))
    assert paths_of(term="layout", limit=20, mode="indexed", candidate_cap=5) != paths_of(term="layout", limit=20, mode="indexed")
    free = paths_of(term="1", limit=1_000)
    assert len(free) > len(paths_of(term="1", limit=1_000, scan_bounds=(50, 40, 20)))
    assert paths_of(term="1", limit=3, scan_bounds=(5_000, 10, 200)) != free[:3]
    first = fx.where(F.contains("path_lc", F.lit("a."))).agg(F.min("file_id")).first()[0]
    if first is not None:
        before = fx.where(F.col("file_id") < first).count()
        assert paths_of(term="a.", limit=20, scan_bounds=(5_000, 5_000, before)) == [] != paths_of(term="a.", limit=20, scan_bounds=(5_000, 5_000, before + 1))
    recent_ = lambda ring: found(grouping_touched(fx, ring))
    assert recent_(3) != recent_(4_096)


def grouping_touched(fx, ring):
    from pathloom.operators.search import touched

    # the touched files are the oldest, so that a ring decides which of them are shown
    return touched(fx, fx.select("file_id", (-F.col("mtime")).alias("update_seq")), 10, ring=ring)


def test_numbered(spark):
    from pathloom.operators.ordering import numbered, running_sum

    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit("x").alias("position"))
    got = numbered(df.drop("position"), "k").collect()
    assert sorted((r.k, r.position) for r in got) == [(k, k + 1) for k in range(500)]
    sums = {r.k: r.s for r in running_sum(df, F.col("k"), F.desc("k"), at="s").collect()}
    assert sums[499] == 499 and sums[0] == 499 * 500 / 2
    assert numbered(df.where("false"), "k", at="n").count() == 0
