import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.api import Engine
from quern.operators import context, graph, stats, store
from quern.sources.scan import DEFAULT_RULES, ignored, language_of, scan_folder
from quern.streaming.debounce import debounced, reindex_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


CASES = [
    (DEFAULT_RULES, "build/main.o", True), (DEFAULT_RULES, "node_modules/express/index.js", True), (DEFAULT_RULES, ".git/HEAD", True), (DEFAULT_RULES, "lib/libfoo.so", True), (DEFAULT_RULES, "src/main.cpp", False),
    (("*.o",), "build/foo.o", True), (("*.o",), "foo.cpp", False), (("*.o", "!important.o"), "important.o", False), (("*.o", "!important.o"), "other.o", True),
    (("dist/",), "dist/sub/file.js", True), (("dist/",), "distfile.js", False), (("*.log", "custom_dir/"), "build/main.o", False), (("*.log", "custom_dir/"), "custom_dir/file.txt", True),
]


@pytest.mark.parametrize("rules,path,want", CASES)
def test_ignore_rules(spark, rules, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(ignored(F.col("p"), rules)).first()[0] is want


def test_scan_and_engine(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "build").mkdir()
    (tmp_path / "src" / "a.py").write_text("def helper():\n    return 1\n\n\ndef compute(x):\n    return helper()\n")
    (tmp_path / "src" / "b.txt").write_text("no")
    (tmp_path / "src" / "h.h").write_text("#import <F.h>\n@interface X\n@end\n")
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "build" / "x.py").write_text("x = 1\n")
    got = {r.path: (r.language, r.error) for r in scan_folder(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": ("python", None), "src/b.txt": (None, "unsupported extension: .txt"), "src/h.h": ("objc", None), "src/bad.py": ("python", None)}
    e = Engine.of_folder(spark, str(tmp_path))
    assert [(r.direction, r.name) for r in e.get_call_graph("helper").collect()] == [("callers", "compute")]
    assert [(r.direction, r.name) for r in e.get_call_graph("compute").collect()] == [("callees", "helper")]
    assert [r.caller for r in e.get_incoming_callers("helper").collect()] == ["compute"]
    assert "calls: helper" in e.get_function_detail("compute").first().text
    assert e.search_symbols("comp").first().name == "compute"
    assert e.search_hybrid("comp", None).first().provenance == "fts5"
    assert e.get_project_overview().first().n_symbols == 3
    assert e.get_file_summary("src/a.py").first().text.startswith("[FILE] src/a.py (2 symbols)\n  function helper")
    assert spark.createDataFrame([("x/y.rs",)], "p string").select(language_of(F.col("p"))).first()[0] == "rust"


def test_store(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (2, 20, "b")], "id long, file_id long, name string")
    new = spark.createDataFrame([(9, 10, "z")], "id long, file_id long, name string")
    assert rows(store.replace_files(old, new, new)) == [(10, 9, "z"), (20, 2, "b"), (20, 2, "b")]
    gone = spark.createDataFrame([(10,)], "id long")
    assert rows(store.cascade(old, "file_id", gone).select("id")) == [(2,), (2,)]
    assert rows(store.set_null(old, "file_id", gone).select("id", "file_id")) == [(1, None), (2, 20), (2, 20)]
    up = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 1, None)], "k string, v int, c string")
    assert rows(store.upsert_latest(up, ["k"], [F.col("v")])) == [("p", 2, "y"), ("q", 1, None)]
    calls = spark.createDataFrame([(1, 10, "f"), (2, 10, "g")], "id long, file_id long, callee_name string")
    syms = spark.createDataFrame([(5, 10, "f", 1), (6, 10, "f", 9)], "id long, file_id long, name string, line_start int")
    assert rows(store.resolve_names(calls, syms)) == [(1, 6), (2, None)]
    a, b = (spark.createDataFrame(x, "path string, content_hash string") for x in ([("a", "1"), ("b", None), ("c", "1")], [("a", "2"), ("b", None), ("d", "1")]))
    assert rows(store.changed_files(a, b)) == [("a", "changed"), ("c", "removed"), ("d", "added")]


def test_stats(spark):
    v = spark.createDataFrame([(10.0 * i, i) for i in range(1, 6)], "v double, o int")
    assert tuple(stats.latency(v, [F.desc("o")]).first()) == (5, 30.0, 50.0, 50.0)
    many = spark.range(101).select(F.col("id").cast("double").alias("v"), F.col("id").alias("o"))
    assert stats.latency(many, [F.desc("o")]).first().sample_count == 100
    assert stats.latency(v.limit(0), [F.desc("o")]).first().p50 is None
    ids = spark.range(30)
    assert stats.index_health(ids, ids.limit(10)).first().health == "degraded" and stats.index_health(ids, ids.limit(25)).first().health == "ok"


def test_graph_and_context(spark):
    syms = spark.createDataFrame([(1, 7, "Outer", 1, 50), (2, 7, "inner", 10, 20), (3, 7, "bad", 9, 2)], "id long, file_id long, name string, line_start int, line_end int")
    pts = spark.createDataFrame([(1, 7, 15), (2, 7, 99), (3, 8, 1)], "point_id long, file_id long, line int")
    assert [(r.point_id, r.symbol) for r in graph.enclosing(pts, syms).orderBy("point_id").collect()] == [(1, "Outer"), (2, "<unknown>"), (3, "<unknown>")]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert rows(graph.reachable(edges, spark.createDataFrame([(1,)], "node long"), 2)) == [(1, 0), (2, 1), (3, 2)]
    s = spark.createDataFrame([(1, 7, "a.py", "function", "f", "(x)", 2, 3, None), (2, 7, "a.py", "class", "C", None, 1, 9, None)], "symbol_id long, file_id long, path string, kind string, name string, signature string, line_start int, line_end int, documentation string")
    t = spark.createDataFrame([(7, "l1\nl2\nl3\n")], "file_id long, text string")
    assert context.chunks(s, t).first().text == "// a.py\n// function: f(x)\n\nl2\nl3"
    files = spark.createDataFrame([("a.py",), ("empty.py",)], "path string")
    assert [r.text for r in context.condensed(s, files).orderBy("path").collect()] == ["[FILE] a.py (2 symbols)\n  class C\n  function f -- (x)\n", "[FILE] empty.py (0 symbols)\n"]


def test_debounce_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    events = [("a.cpp", t0), ("a.cpp", t0 + dt.timedelta(seconds=1)), ("b.py", t0), ("a.cpp", t0 + dt.timedelta(seconds=10)), ("z", t0 + dt.timedelta(hours=1))]
    df = spark.createDataFrame(events, "path string, ts timestamp")
    batch = rows(debounced(df).select("path", "n_events"))
    assert batch == [("a.cpp", 1), ("a.cpp", 2), ("b.py", 1), ("z", 1)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    seen = []
    q = reindex_stream(debounced(stream), lambda paths: seen.extend(r.path for r in paths.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert set(seen) == {"a.cpp", "b.py"}  # the last burst is still open
