import json

import pytest

from pathloom.config import Config
from pathloom.engine import Engine

FILES = "file_id bigint, path string, name string, size bigint, mtime bigint, dev bigint, ino bigint, is_dir boolean"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(0, "/p", "p", 1, 1, 1, 1, True), (1, "/p/main.rs", "main.rs", 9, 3, 1, 2, False), (2, "/p/main.md", "main.md", 5, 2, 1, 3, False), (3, "/q/main.rs", "main.rs", 2, 9, 1, 4, False)]
    events = spark.createDataFrame([("/p/main.rs", "m", "open", 50, 1)], "path string, query string, action string, ts bigint, seq bigint")
    texts = spark.createDataFrame([("/p/main.rs", "fn main() {}\n"), ("/q/main.rs", "// main\n"), ("/p/main.md", "the main page\n")], "path string, text string")
    return Engine(spark, spark.createDataFrame(rows, FILES), usage_events=events, texts=texts)


def paths(df):
    return [r.path for r in df.collect()]


def test_views(engine):
    assert paths(engine.search("main ext:rs", scope="/p", now=60)) == ["/p/main.rs"]
    assert paths(engine.search("main", limit=1, now=60)) == ["/p/main.rs"]  # its use outweighs the newer file
    assert paths(engine.search("", now=60))[0] == "/q/main.rs"
    assert paths(engine.search("p", view="directories", now=60)) == ["/p"]
    assert paths(engine.search("main", view="usage", now=60)) == ["/p/main.rs"]
    rows = engine.search("main", view="content", now=60).orderBy("rank").collect()
    assert [(r.name, r.size, r.mtime) for r in rows] == [("main.md:1:5  the main page", 5, 2), ("main.rs:1:4  fn main() {}", 9, 3), ("main.rs:1:4  // main", 2, 9)]
    assert paths(engine.search("", view="large", limit=2)) == ["/p/main.rs", "/p/main.md"]
    assert paths(engine.search("ext:md", view="recent", limit=2, now=60)) == ["/p/main.md"]
    assert paths(engine.paths_below("/p/")) == ["/p", "/p/main.rs", "/p/main.md"]
    for bad in (dict(view="symbols"), dict(limit=-1)):
        with pytest.raises(ValueError):
            engine.search("x", **bad)


def test_every_view_keeps_to_scope_filters_and_limit(engine):
    ask = lambda line, view, **o: paths(engine.search(line, view=view, now=60, **o))
    assert ask("main", "content", scope="/p") == ["/p/main.md", "/p/main.rs"]
    assert ask("main ext:md", "content") == ["/p/main.md"] and ask("main", "content", limit=1) == ["/p/main.md"]
    assert ask("ext:rs", "large", scope="/q") == ["/q/main.rs"] and ask("md", "large") == ["/p/main.md"]
    assert ask("size:>4", "recent", scope="/p") == ["/p/main.rs", "/p/main.md"]
    assert ask("main ext:md", "usage") == [] and ask("main ext:rs", "usage", scope="/p") == ["/p/main.rs"]
    assert ask("main", "directories", scope="/q") == []


def test_exact_name_first_and_a_boost_apart_from_the_scope(engine):
    assert paths(engine.search("main.rs", exact_first=True, now=60, scope="/p")) == ["/p/main.rs"]
    assert paths(engine.search("main.rs", exact_first=True, now=60, scope="/nowhere")) == []
    plain, boosted = (engine.request("main", boost=b).boost_scope for b in ("", "/q"))
    assert (plain or None, boosted) == (None, "/q") and engine.request("main", scope="/p").boost_scope == "/p"


def test_the_index_is_stored_caught_up_and_rebuilt(spark, tmp_path):
    from pyspark.sql import functions as F

    config = Config(index_path=str(tmp_path / "index"), reconcile_hour=3)
    files = spark.createDataFrame([(0, "/a/x.rs", "x.rs", 1, 5, 1, 1, False), (1, "/a/y.rs", "y.rs", 2, 6, 1, 2, False)], FILES)
    engine = Engine(spark, files, config=config)
    assert engine.save() == 1 and engine.store.journal_seq() == -1

    def prepare(updates):
        meta = {"name": F.element_at(F.split("path", "/"), -1), "size": F.lit(7).cast("bigint"), "mtime": F.lit(8).cast("bigint"), "dev": F.lit(1).cast("bigint"), "ino": F.lit(9).cast("bigint"), "is_dir": F.lit(False)}
        return updates.withColumns(meta | {"present": F.lit(True)})

    again = Engine.open(spark, config)
    assert "initials" in again.table.columns and paths(again.search("rs", now=60)) == ["/a/y.rs", "/a/x.rs"]
    again.journal.append([{"Create": {"path": "/a/z.rs"}}, {"Delete": {"path": "/a/x.rs"}}], 0)
    assert again.catch_up(prepare) == 2 and again.store.journal_seq() == 1
    assert again.catch_up(prepare) == 2  # nothing new
    assert paths(Engine.open(spark, config).search("rs", now=60)) == ["/a/z.rs", "/a/y.rs"]
    again.journal.append([{"Modify": {"path": "/a/late.rs"}}], 2)
    assert again.rebuild(prepare, files) == 3 and again.journal.last_seq() == -1
    assert sorted(r.path for r in again.table.collect()) == ["/a/x.rs", "/a/y.rs"]  # the scan has seen the journal so far
    assert sorted(r.file_id for r in again.table.collect()) == [0, 1]


def test_when_a_rebuild_is_due(engine):
    from datetime import datetime

    assert engine.next_rebuild(datetime(2024, 2, 28, 2, 59)) == datetime(2024, 2, 28, 3)
    assert engine.next_rebuild(datetime(2024, 2, 28, 3)) == datetime(2024, 2, 29, 3) == engine.next_rebuild(datetime(2024, 2, 28, 12, 5))


def test_measure_and_watch(engine, tmp_path):
    assert engine.measure(["main", "x"], runs=2, warmup=0).first().ok_runs == 2
    engine.watch(str(tmp_path / "m.jsonl"), 1)
    assert json.loads((tmp_path / "m.jsonl").read_text())["files"] == 4
    engine.register()
    assert engine.spark.sql("select count(*) from files where name_lc like 'main%'").first()[0] == 3


def test_scan_with_a_config(spark, tmp_path):
    (tmp_path / "root/bin").mkdir(parents=True)
    (tmp_path / "root/keep.rs").write_text("x")
    (tmp_path / "root/bin/drop").write_text("x")
    (tmp_path / "c.toml").write_text(f'index_roots = ["{tmp_path}/root"]\nexclusions = ["bin"]\nunknown = 1\n[usage]\nmax_entries = 5\n[content]\nengine = "rg"\n')
    config = Config.load(str(tmp_path / "c.toml"))
    assert config.usage.max_entries == 5 and config.usage.max_boost == 0.08 and config.content.engine == "rg"
    assert {r.name for r in Engine(spark, config=config).table.collect()} == {"root", "keep.rs"}
    with pytest.raises(ValueError):
        Config(reconcile_hour=24)
