"""Journal, fold, store, stream, usage, content, evaluation and the file walk."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import changes, content, evaluation, usage
from pathloom.schema import JOURNAL_LINE, UPDATES, USAGE_EVENTS
from pathloom.sources import fswalk
from pathloom.sources.store import Journal, SnapshotStore, UsageStore, query_file, write_results
from pathloom.streaming.apply import apply_to_store, journal_stream, latest_paths

FILES = "file_id bigint, path string, name string, size bigint, mtime bigint, dev bigint, ino bigint, is_dir boolean"


def f(k, path, ino=None):
    return (k, path, path.rsplit("/", 1)[-1], 1, 1, 1, k + 100 if ino is None else ino, False)


def u(seq, kind, path, src=None, ino=0, present=True):
    return (seq, kind, path, src, (path or "").rsplit("/", 1)[-1], seq, seq, 1, ino or 500 + seq, False, present)


def state(table):
    return {r["path"]: r["file_id"] for r in table.rows()}


def run(rows, updates, **options):
    t = changes.Table([dict(zip(("file_id", "path", "name", "size", "mtime", "dev", "ino", "is_dir"), r)) for r in rows], **options)
    names = ("seq", "kind", "path", "from_path", "name", "size", "mtime", "dev", "ino", "is_dir", "present")
    for r in updates:
        t.apply(dict(zip(names, r)))
    return state(t)


def test_fold_vectors():
    assert run([f(0, "/a")], [u(1, "Move", "/b", "/a")]) == {"/b": 0}
    assert run([f(0, "/a"), f(1, "/b")], [u(1, "Move", "/b", "/a")]) == {"/b": 0}
    assert run([], [u(1, "Create", "/x"), u(2, "Modify", "/x"), u(3, "Create", "/no", present=False), u(4, "Delete", "/x")]) == {}
    assert run([f(0, "/a")], [u(1, "Move", "/new", "/unknown"), u(2, "Move", "/cut", "/a", present=False)]) == {"/new": 1}
    assert run([f(0, "/a", 7)], [u(1, "Create", "/link", ino=7)]) == {"/link": 0}
    assert run([f(0, "/a", 7)], [u(1, "Create", "/link", ino=7)], inode_identity=False) == {"/a": 0, "/link": 1}
    assert run([f(0, "/d"), f(1, "/d/x")], [u(1, "Move", "/e", "/d")]) == {"/e": 0, "/d/x": 1}
    assert run([f(0, "/d"), f(1, "/d/x")], [u(1, "Move", "/e", "/d")], cascade=True) == {"/e": 0, "/e/x": 1}
    assert run([f(0, "/d"), f(1, "/d/x")], [u(1, "Delete", "/d")], cascade=True) == {}


def log(seed, n=200):
    random.seed(seed)
    paths = [f"/v/{c}" for c in "abcdefgh"]
    return [u(k, random.choice(["Create", "Modify", "Delete", "Move"]), random.choice(paths), random.choice(paths), present=random.random() < 0.9) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_last_state_has_the_paths_of_the_fold(spark, seed):
    rows, updates = [f(0, "/v/a"), f(1, "/v/z")], log(seed)
    fdf, udf = spark.createDataFrame(rows, FILES), spark.createDataFrame(updates, UPDATES)
    want = run(rows, updates, inode_identity=False)
    assert {r.path for r in changes.last_state(fdf, udf).collect()} == set(want)
    folded = changes.fold(fdf, udf, F.lit("v"), inode_identity=False).collect()
    assert {r.path: r.file_id for r in folded} == want


def test_journal_lines(spark):
    lines = [(0, '{"Create":{"path":"/a"}}'), (1, ""), (2, "{broken"), (3, '{"Move":{"from":"/a","to":"/b"}}'), (4, '{"Delete":{"path":"/b"}}'), (5, '{"Other":1}'), (6, '{"Modify":{"path":"/c"}}')]
    got = changes.parse_journal(spark.createDataFrame(lines, "seq bigint, value string"), after=0).collect()
    assert [tuple(r) for r in got] == [(3, "Move", "/b", "/a"), (4, "Delete", "/b", None), (6, "Modify", "/c", None)]
    assert "Create" in JOURNAL_LINE


def test_event_mapping(spark):
    rows = [
        (1, "create", None, ["/a", "/b"], [True, True]), (2, "rename", "from", ["/a"], [False]), (3, "rename", "to", ["/b"], [True]), (4, "rename", "both", ["/x", "/y"], [True, False]),
        (5, "rename", "any", ["/x", "/y"], [True, False]), (6, "rename", "any", ["/x", "/y"], [False, True]), (7, "rename", "both", ["/x"], [True]), (8, "modify", None, ["/m"], [True]), (9, "remove", None, ["/r"], [False]), (10, "access", None, ["/z"], [True]),
    ]
    got = {(r.seq, r.kind, r.path, r.from_path) for r in changes.events_to_updates(spark.createDataFrame(rows, "seq bigint, event string, mode string, paths array<string>, present array<boolean>")).collect()}
    assert got == {(1, "Create", "/a", None), (1, "Create", "/b", None), (2, "Delete", "/a", None), (3, "Create", "/b", None), (4, "Move", "/y", "/x"), (5, "Move", "/x", "/y"), (6, "Move", "/y", "/x"), (7, "Modify", "/x", None), (8, "Modify", "/m", None), (9, "Delete", "/r", None)}
    inside = spark.createDataFrame([u(1, "Create", "/state/x"), u(2, "Move", "/b", "/state"), u(3, "Create", "/stateful")], UPDATES)
    assert [r.seq for r in changes.outside(inside, ["/state"]).collect()] == [3]


def test_identity_and_ordered_union(spark):
    rows = spark.createDataFrame([(1, 5, "/a", 1), (1, 5, "/b", 2), (0, 0, "/c", 3)], "dev bigint, ino bigint, path string, seq bigint")
    assert [(r.path, r.seq) for r in changes.latest_by(rows, ["dev", "ino"], "seq").collect()] == [("/b", 2)]
    a, b = spark.createDataFrame([("x", 2), ("y", 1)], "i string, at int"), spark.createDataFrame([("y", 0), ("z", 9), ("w", 3)], "i string, at int")
    assert [r.i for r in changes.ordered_union(a, b, "i", "at").orderBy("position").collect()] == ["y", "x", "w", "z"]


def test_store_and_rebuild(spark, tmp_path):
    store, journal = SnapshotStore(str(tmp_path / "s")), Journal(str(tmp_path / "j"))
    with pytest.raises(FileNotFoundError):
        store.load(spark)
    scanned = spark.createDataFrame([f(0, "/a"), f(1, "/b")], FILES)
    assert store.save(scanned) == 1 and store.load(spark).count() == 2
    journal.append([{"Create": {"path": "/old"}}], 0)
    journal.append([{"Delete": {"path": "/a"}}, {"Create": {"path": "/c"}}, {"Create": {"path": "/missing"}}], 1)
    meta = spark.createDataFrame([f(9, "/c"), f(8, "/old")], FILES)
    store.rebuild(scanned, journal, 0, lambda t: changes.prepare(t, meta))
    assert {r.path for r in store.load(spark).collect()} == {"/b", "/c"}
    assert store.journal_seq() == 3 and journal.last_seq() == -1 and store.load(spark, 1).count() == 2


def test_stream_applies_batches_once(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"))
    store.save(spark.createDataFrame([f(0, "/v/a")], FILES))
    batches = tmp_path / "in"
    batches.mkdir()
    names = ("seq", "kind", "path", "from_path", "name", "size", "mtime", "dev", "ino", "is_dir", "present")
    updates = log(3, 60)
    for k in range(0, 60, 20):
        (batches / f"{k:04d}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in updates[k : k + 20]))
    stream = journal_stream(spark, str(batches), files_per_trigger=1)
    for _ in range(2):  # the second start finds nothing new
        q = apply_to_store(stream, store, str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {r.path for r in store.load(spark).collect()} == set(run([f(0, "/v/a")], updates, inode_identity=False))
    assert store.journal_seq() == 59


def test_stream_applies_late_batches(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"))
    store.save(spark.createDataFrame([f(0, "/v/a")], FILES))
    batches = tmp_path / "in"
    batches.mkdir()
    names = ("seq", "kind", "path", "from_path", "name", "size", "mtime", "dev", "ino", "is_dir", "present")
    on = lambda seq, kind, path, source=None: (seq, kind, path, source, path.rsplit("/", 1)[-1], 1, seq, 1, seq, False, kind != "Delete")
    late = [on(8, "CreateOrModify", "/v/b"), on(9, "Delete", "/v/gone")], [on(3, "CreateOrModify", "/v/late"), on(4, "Delete", "/v/b"), on(5, "CreateOrModify", "/v/gone"), on(6, "Move", "/v/to", "/v/a")]
    for k, part in enumerate((*late, late[0])):
        (batches / f"{k:04d}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in part))
        q = apply_to_store(journal_stream(spark, str(batches), files_per_trigger=1), store, str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {(r.path, r.mtime) for r in store.load(spark).collect()} == {("/v/b", 8), ("/v/late", 3), ("/v/to", 6)}
    assert store.journal_seq() == 9


def test_stateful_stream(spark, tmp_path):
    batches = tmp_path / "in"
    batches.mkdir()
    names = ("seq", "kind", "path", "from_path", "name", "size", "mtime", "dev", "ino", "is_dir", "present")
    updates = log(4, 30)
    late = updates[10:] + updates[:10]
    for k in range(0, 30, 15):
        (batches / f"{k:04d}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in late[k : k + 15]))
    seen = latest_paths(journal_stream(spark, str(batches), files_per_trigger=1))
    q = seen.writeStream.format("memory").queryName("seen").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    last = spark.sql("select path, max_by(present, seq) as p from seen group by path").collect()
    assert {r.path for r in last if r.p} == set(run([], updates, inode_identity=False))


def test_usage(spark, tmp_path):
    rows = [("/a", "q1", "open", 100, 1), ("/a", "q2", "copy", 50, 2), ("/b", None, "odd", 10, 3), (None, "x", "open", 1, 4)]
    events = spark.createDataFrame(rows, USAGE_EVENTS)
    a = {r.path: r for r in usage.aggregate(events).collect()}
    assert (a["/a"].total_count, a["/a"].open_count, a["/a"].copy_count, a["/a"].first_used, a["/a"].last_used, a["/a"].last_query) == (2, 1, 1, 100, 50, "q2")
    assert a["/b"].total_count == 1 and len(a) == 2
    left = usage.forget(events, spark.createDataFrame([("/a", 1)], "path string, seq bigint"))
    assert {(r.path, r.seq) for r in left.collect()} == {("/a", 2), ("/b", 3)}
    assert usage.forget(events, spark.createDataFrame([(None, 2)], "path string, seq bigint")).count() == 1
    used = usage.aggregate(events)
    assert [r.path for r in usage.listing(used, now=100, query=" A ").collect()] == ["/a"]
    assert [r.path for r in usage.prune(used, 1).collect()] == ["/a"]
    store = UsageStore(str(tmp_path / "u.json"))
    assert store.load(spark).count() == 0
    store.save([dict(zip(("path", "query", "action", "ts", "seq"), r)) for r in rows])
    assert store.load(spark).count() == 4
    store.path.write_text("{broken\n")
    with pytest.raises(ValueError):
        store.load(spark)
    assert not store.path.exists() and list(tmp_path.glob("u.json.corrupt.*"))


def test_usage_boost(spark):
    from pathloom.functions.ranking import frecency, usage_boost
    from pathloom.operators import index
    from pathloom.operators.search import Request, search

    df = spark.createDataFrame([(100, 1), (0, 49), (0, 0)], "last bigint, n bigint")
    got = [r[0] for r in df.select(usage_boost(frecency(F.col("last"), F.col("n"), 100), 5.0)).collect()]
    assert got[0] > got[2] and all(0 <= g <= 1 for g in got)
    assert [r[0] for r in df.select(usage_boost(frecency(F.col("last"), F.col("n"), 100), float("nan"))).collect()] == [0, 0, 0]
    fx = index.build(spark.createDataFrame([f(0, "/old/note.txt"), (1, "/new/note.txt", "note.txt", 1, 99, 1, 1, False)], FILES))
    used = usage.aggregate(spark.createDataFrame([("/old/note.txt", "n", "open", 100, 1)], USAGE_EVENTS))
    assert [r.path for r in search(fx, Request("note", 2)).orderBy("rank").collect()] == ["/new/note.txt", "/old/note.txt"]
    assert [r.path for r in search(fx, Request("note", 2), usage=used, now=100).orderBy("rank").collect()] == ["/old/note.txt", "/new/note.txt"]
    assert [r.path for r in search(fx, Request("note", 2), usage=used.where("false"), now=100).orderBy("rank").collect()] == ["/new/note.txt", "/old/note.txt"]


def test_content(spark):
    texts = spark.createDataFrame(
        [("/a.txt", "one\n    Needle here\r\nneedle needle\n"), ("/.git/b", "needle"), ("/bin", "needle\0"), ("/target/c", "needle"), ("/e", ""), ("/u", "ü needle")], "path string, text string"
    )
    rows = lambda df: [(r.path, r.line_number, r.column) for r in df.collect()]
    assert rows(content.search(texts, "needle", limit=9)) == [("/a.txt", 2, 5), ("/a.txt", 3, 1), ("/target/c", 1, 1), ("/u", 1, 4)]
    assert rows(content.search(texts, "Needle", limit=9)) == [("/a.txt", 2, 5)]
    assert rows(content.search(texts, "needle", mode="grep", limit=9)) == [("/a.txt", 3, None), ("/u", 1, None)]
    assert rows(content.search(texts, "needle", mode="git-grep", limit=1)) == [("/.git/b", 1, 1)]
    assert rows(content.search(texts, " ")) == [] == rows(content.search(texts, "needle", limit=0))
    parsed = spark.createDataFrame([("src/a:b.rs:12:8:x:y",), ("src/foo:12:bar.rs:5:1:z",), ("none",)], "l string").select(content.parse_match(F.col("l")).alias("m")).collect()
    assert tuple(parsed[0].m) == ("src/a:b.rs", 12, 8, "x:y") and tuple(parsed[1].m) == ("src/foo:12:bar.rs", 5, 1, "z") and parsed[2].m is None
    assert content.engine("rg") == "ripgrep" and content.engine(has_ripgrep=False, in_work_tree=True) == "git-grep" and content.engine(has_ripgrep=False, allow_slow=True) == "grep"
    with pytest.raises(ValueError):
        content.engine(has_ripgrep=False)


def test_evaluation(spark):
    results = spark.createDataFrame([("a", 1, "/x/target/n"), ("a", 2, "/Users/u/P/hit"), ("b", 1, "/Users/u/Q/miss")], "query string, rank int, path string")
    labels = spark.createDataFrame([("a", "/Users/u/P/hit"), ("b", "/gone")], "query string, path string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "query string")
    first = evaluation.first_relevant(results, labels, asked)
    assert {(r.query, r["first"], r.noise) for r in first.collect()} == {("a", 2, 1), ("b", None, 0), ("c", None, 0)}
    m = first.agg(evaluation.mrr(F.col("first"), 10), evaluation.hit_rate(F.col("first"), 1)).first()
    assert (round(m[0], 6), m[1]) == (round(0.5 / 3, 6), 0.0)
    assert {r.query: r.buckets for r in evaluation.diversity(results).collect()} == {"a": 2, "b": 1}
    samples = spark.createDataFrame([(k, True) for k in (4, 1, 3, 2)] + [(None, False)], "elapsed_us bigint, ok boolean")
    s = evaluation.latency_summary(samples).first()
    assert (s.p50_us, s.min_us, s.max_us, s.mean_us, s.ok_runs, s.error_runs) == (3, 1, 4, 2, 4, 1)
    p = spark.createDataFrame([([1, 2, 3, 4],), ([],)], "v array<bigint>").select(evaluation.percentile_of(F.col("v"), 0.5)).collect()
    assert [r[0] for r in p] == [3, 0]


def test_walk(spark, tmp_path):
    for p in ("a.txt", ".hidden", "d/x.rs", "d/.gitignore", "d/skip.log", "d/keep.log", "node_modules/m.js", "d/e/y.tmp", "d/build/out.o"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    (tmp_path / "d/.gitignore").write_text("# c\n*.log\n!keep.log\n/build/\n")
    os.symlink(tmp_path / "a.txt", tmp_path / "link")
    old = tmp_path / "d/e/old"
    old.write_text("x")
    os.utime(old, (-10, -10))
    under = lambda df: {r.path[len(str(tmp_path)) + 1 :] for r in df.collect()}
    got = under(fswalk.scan(spark, [str(tmp_path), str(tmp_path / "d")], ["node_modules", "*.tmp"]))
    assert got == {"", "a.txt", ".hidden", "d", "d/x.rs", "d/.gitignore", "d/skip.log", "d/keep.log", "d/e", "d/build", "d/build/out.o"}
    kept = under(fswalk.scan(spark, [str(tmp_path)], respect_ignore_files=True))
    assert "d/keep.log" in kept and not {"d/skip.log", "d/build", "d/build/out.o"} & kept
    ids = fswalk.with_file_ids(fswalk.scan(spark, [str(tmp_path)])).orderBy("path").collect()
    assert [r.file_id for r in ids] == list(range(len(ids)))
    assert fswalk.is_ignored(str(tmp_path / "d/build/deep/z"), False, str(tmp_path))


def test_query_and_result_files(spark, tmp_path):
    (tmp_path / "q").write_text("one\n\n # no\n  two  \n#x\n")
    assert [r.query for r in query_file(spark, str(tmp_path / "q")).collect()] == ["one", "two"]
    results = spark.createDataFrame([(1, "/a", "a", 0.5, 1, 0)], "rank int, path string, name string, score float, size bigint, mtime bigint")
    for form in ("json", "plain", "table"):
        write_results(results, str(tmp_path / form), form)
    assert spark.read.text(str(tmp_path / "plain")).first().value == "/a"
    assert "1970-01-01 00:00" in spark.read.text(str(tmp_path / "table")).first().value
    with pytest.raises(ValueError):
        write_results(results, str(tmp_path / "z"), "xml")


def test_content_scope_ignore_files_and_bounds(spark):
    texts = spark.createDataFrame([("/w/a.rs", "x needle"), ("/w/sub/b.rs", "needle"), ("/w/sub/keep.log", "needle"), ("/w/sub/c.log", "needle"), ("/w-x/d.rs", "needle"), ("/w/.hid/e.rs", "needle"), (None, "needle")], "path string, text string")
    got = lambda **o: [r.path for r in content.search(texts, "needle", **o).orderBy("path").collect()]
    rules = [("/w/.gitignore", "*.log\nsub/b.rs\n"), ("/w/sub/.ignore", "!keep.log\n"), ("/w/other.txt", "*.rs\n")]
    assert got(scope="/w/") == ["/w/a.rs", "/w/sub/b.rs", "/w/sub/c.log", "/w/sub/keep.log"]
    assert got(scope="/w", ignore=rules) == ["/w/a.rs", "/w/sub/keep.log"]
    assert got(scope="/w/.hid") == ["/w/.hid/e.rs"]  # a hidden folder that is asked for
    assert got(mode="grep", max_files=2, scope="/w") == ["/w/.hid/e.rs", "/w/a.rs"]
    assert got(scope="/w/a.rs") == ["/w/a.rs"] and got(max_bytes=6) == ["/w-x/d.rs", "/w/sub/b.rs", "/w/sub/c.log", "/w/sub/keep.log"]
