import json

import pytest
from pyspark.sql import functions as F

from quern.api import Engine, as_json
from quern.functions.text import absolute_path, language_id, normal_path, relative_path
from quern.operators import responses, stats, vectors
from quern.operators.fulltext import SearchIndex
from quern.operators.search import parse
from quern.sources import registry
from quern.sources.scan import read_files, scan_folder
from quern.streaming import service


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "a.c").write_text("#include \"b.h\"\nint helper(int x) { if (x > 1) return x; return 0; }\nint run(int n) {\n  int y = helper(n);\n  return helper(y);\n}\n")
    (root / "b.h").write_text("struct box { int n; };\n")
    (root / "c.py").write_text("def parse(t):\n    return helper(t)\n")
    (root / "d.bin").write_bytes(b"\xff\xfe")
    (root / "bad.py").write_bytes(b"def f():\n    return '\xff'\n")
    (root / "build").mkdir()
    (root / "build" / "x.c").write_text("int x;\n")
    return root


@pytest.fixture(scope="module")
def engine(spark, tree):
    return Engine.of_folder(spark, str(tree))


def test_answers_over_a_tree(engine, spark):
    assert {r.path for r in engine.files.collect()} == {"a.c", "b.h", "c.py", "bad.py"}
    assert {(r.node_type, r.condition, r.line, r.depth) for r in engine.get_control_flow("helper").collect()} == {("if_branch", "x > 1", 2, 0), ("early_return", None, 2, 0), ("early_return", None, 2, 1)}
    assert [(r.edge_type, r.lhs, r.rhs_snippet) for r in engine.get_data_flow("run").collect()] == [("parameter", "n", None), ("assignment", "y", "helper(n)"), ("return_value", "return", "helper(y)")]
    one = engine.get_dependencies("a.c").first()
    assert one.found and [(i.line, i.kind, i.target) for i in one.imports] == [(1, "include", "b.h")]
    other = engine.get_dependencies("b.h").first()
    assert [(i.path, i.line) for i in other.imported_by] == [("a.c", 1)]
    none = engine.get_dependencies("none").first()
    assert not none.found and none.imports == [] and none.imported_by == []
    got = engine.get_call_graph("run", depth=2).collect()
    assert [(r.direction, r.name, r.line, r.source, r.depth2) for r in got] == [("callees", "helper", 4, "tree-sitter-approximate", []), ("callees", "helper", 5, "tree-sitter-approximate", [])]
    assert {(r.name, r.path) for r in engine.get_call_graph("helper", "callers").collect()} == {("run", "a.c"), ("parse", "c.py")}
    detail = engine.get_function_detail("helper").first()
    assert detail.found and detail.callers == ["parse", "run", "run"] and detail.callees == []
    assert not engine.get_function_detail("nothing").first().found
    assert {(r.caller, r.source) for r in engine.get_incoming_callers("helper").collect()} == {("run", "tree-sitter-approximate"), ("parse", "tree-sitter-approximate")}
    overview = engine.get_project_overview().first()
    assert overview.n_files == 4 and overview.languages == {"c": 2, "python": 2} and overview.language_support["go"].l2_call_graph and not overview.language_support["go"].l3_cfg
    shaped = json.loads(as_json(engine.get_call_graph("run"), "edges").first().json)
    assert shaped["count"] == 2 and shaped["edges"][0]["line"] == 4
    hybrid = engine.search_hybrid("helper").collect()
    assert hybrid[0].search_mode == "fts5_only" and hybrid[0].provenance == "fts5"


def test_contexts(engine):
    assert [(r.path, r.symbol_count) for r in engine.get_context(["b.h", "c.py", "none"]).orderBy("path").collect()] == [("b.h", 1), ("c.py", 1)]
    assert engine.get_context(mode="diff_aware").count() == 0
    assert [r.path for r in engine.get_context(["a.c"], mode="diff_aware").collect()] == ["a.c"]
    text = engine.get_context(["a.c"], detail=True).first().text
    assert text.startswith("[FILE] a.c (2 symbols)\n") and "called_by: parse, run" in text
    assert engine.get_context(max_symbols=1).count() == 1


def test_tiers_of_language_servers(engine, spark):
    ids = {r["path"]: r["id"] for r in engine.files.collect()}
    item = {"name": "run", "kind": 12, "uri": "file:///w/a.c", "range": {"start": {"line": 2, "character": 0}}}
    answers = spark.createDataFrame([(ids["a.c"], "helper", 2, json.dumps([{"from": item, "fromRanges": [{"start": {"line": 3, "character": 10}}, {"start": {"line": 4, "character": 9}}]}, {"from": item | {"uri": "file:///o.c", "kind": 5}, "fromRanges": []}])), (ids["a.c"], "x", 1, "null"), (ids["a.c"], "y", 1, "{bad")], "callee_file_id long, callee_name string, callee_line int, response string")
    got = responses.incoming_calls(answers, engine.files, "/w").collect()
    assert [(r.caller_kind, r.caller_file_id, r.caller_line, r.caller_col) for r in got] == [("function", ids["a.c"], 4, 10), ("function", ids["a.c"], 5, 9), ("5", None, None, None)]
    full = Engine(engine.symbols, engine.files, engine.calls, hierarchy=responses.incoming_calls(answers, engine.files, "/w"))
    assert {(r.caller, r.line, r.source) for r in full.get_incoming_callers("helper").collect()} == {("run", 4, "lsp-call-hierarchy"), ("run", 5, "lsp-call-hierarchy"), ("run", None, "lsp-call-hierarchy")}
    place = {"uri": "file:///w/b.h", "range": {"start": {"line": 0, "character": 7}}}
    asked = spark.createDataFrame([(1, 1, 2, "a", json.dumps(place)), (1, 2, 2, "b", json.dumps([place, place])), (1, 3, 2, "c", "[]"), (1, 4, 2, "d", None), (1, 5, 2, "e", json.dumps([{"targetUri": "file:///z.h", "targetSelectionRange": place["range"]}]))], "caller_file_id long, call_line int, call_col int, callee_name string, response string")
    rows = {r.callee_name: r for r in responses.definitions(asked, engine.files, "/w").collect()}
    assert set(rows) == {"a", "b", "e"} and rows["a"].def_file_id == ids["b.h"] and rows["a"].def_line == 1 and rows["e"].def_file_id is None and rows["e"].def_file_path == "/z.h"


def test_models_status_and_versions(spark, tmp_path):
    models = spark.createDataFrame([("b", "B", 3, 10, "INT8", False), ("a", "A", 4, 20, "INT8", True)], registry.MODEL_SCHEMA)
    assert registry.default_model(models).first().id == "a" and registry.find_model(models, "b").first().dim == 3 and registry.find_model(models, "x").count() == 0
    assert registry.selected_model('# x\n model = "a b" # c\n') == "a b" and registry.selected_model("other = 1") is None
    at = str(tmp_path / "status.json")
    assert registry.read_status(spark, at).first().state == "stopped"
    registry.write_status(spark, at, state="idle", symbols=3)
    row = registry.read_status(spark, at).first()
    assert (row.state, row.symbols, row.files_total) == ("idle", 3, 0)
    (tmp_path / "broken.json").write_text("{")
    assert registry.read_status(spark, str(tmp_path / "broken.json")).first().state == "stopped"
    versions = spark.createDataFrame([(2,), (4,)], "version int")
    assert registry.schema_version(versions).first().version == 4 and registry.schema_version(versions.limit(0)).first().version == 0
    old = spark.createDataFrame([(1, "a", 5)], "id long, path string, extra int")
    assert registry.upgraded(old, "files").columns == ["id", "path", "extra", "language", "mtime_ns", "content_hash", "indexed_at"]
    assert [t for _, t in registry.migrations(4)] == ["lsp_definitions", "lsp_call_hierarchy_callers", "lsp_dependencies"]


def test_states_memory_and_queues(spark):
    now = [0.0]
    state = service.State(clock=lambda: now[0]).go("initial_scan").go("idle")
    now[0] = 1_799.0
    assert not state.expired()
    now[0] = 1_800.0
    assert state.expired()
    with pytest.raises(ValueError):
        state.go("starting")
    memory, made = service.Remembered(clock=lambda: now[0]), []
    for t in (0, 10, 29, 31):
        now[0] = float(t)
        memory.get("q", lambda: made.append(1))
    assert len(made) == 2
    assert [service.backoff(n) for n in (0, 1, 5, 6, 50)] == [1.0, 2.0, 32.0, 60.0, 60.0]
    pending = spark.sql("SELECT 'a' AS path, timestamp_seconds(100) AS ts UNION ALL SELECT 'b', timestamp_seconds(101)")
    assert service.next_timeout(pending, 101.0).first().seconds == 1.0 and service.next_timeout(pending.limit(0), 101.0).first().seconds == -1.0
    files = spark.createDataFrame([("b.py", "python"), ("a.py", "python"), ("c.go", "go"), ("d", None)], "path string, language string")
    ready = spark.createDataFrame([("python", True), ("go", True), ("lua", False)], "language string, ready boolean")
    assert [(r.tick, r.path) for r in service.cold_start(files, ready).orderBy("tick", "path").collect()] == [(0, "a.py"), (0, "c.go"), (1, "b.py")]
    assert service.cold_start(files, ready.where("language <> 'go'")).count() == 0
    events = spark.createDataFrame([("a.py", "Modified"), ("a.go", "add"), ("build/a.py", "add"), ("a.py", "moved")], "path string, kind string")
    assert service.file_events(events, ("build/",)).count() == 1


def test_reindexing_of_changed_files(spark, tmp_path):
    root, folder = tmp_path / "src", tmp_path / "out"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    two()\n")
    (root / "b.py").write_text("def three(:\n")
    index = SearchIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame([], "symbol_id long, file_id long, name string, signature string, documentation string"))
    run = service.reindexer(spark, str(root), str(folder), index)
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    run(paths("a.py", "b.py", "gone.py"))
    facts, runs = service.stored_facts(spark, str(folder))
    assert {(r.path, r.success, r.symbols_count, r.calls_count) for r in runs.collect()} == {("a.py", True, 1, 1), ("b.py", True, 1, 0), ("gone.py", False, 0, 0)}
    assert {r.error for r in runs.where("NOT success").collect()} == {"file not found: gone.py"}
    (root / "a.py").write_text("def four():\n    pass\n")
    (root / "b.py").unlink()
    run(paths("a.py", "b.py"))
    run(paths("a.py"))
    facts, runs = service.stored_facts(spark, str(folder))
    assert {(r.path, r.name) for r in facts.where("fact = 'symbol'").collect()} == {("a.py", "four"), ("b.py", "three")}
    assert {r.path for r in runs.where("NOT success").collect()} == {"b.py", "gone.py"}
    assert index.bm25(parse("four")).count() == 1 and index.bm25(parse("one")).count() == 0 and index.bm25(parse("three")).count() == 1
    service.reindexer(spark, str(root), str(folder), index, prune_deleted=True)(paths("b.py"))
    facts, _ = service.stored_facts(spark, str(folder))
    assert {r.name for r in facts.where("fact = 'symbol'").collect()} == {"four"} and index.bm25(parse("three")).count() == 0


def test_reading_of_files(spark, tree):
    wanted = spark.createDataFrame([("a.c",), ("zz.c",), ("d.bin",)], "path string")
    assert {(r.path, r.error) for r in read_files(spark, str(tree), wanted).collect()} == {("a.c", None), ("zz.c", "file not found: zz.c"), ("d.bin", "unsupported extension: .bin")}
    (tree / ".quernignore").write_text("*.c\n")
    try:
        assert {r.path for r in scan_folder(spark, str(tree)).where("language = 'c'").collect()} == {"b.h"}
    finally:
        (tree / ".quernignore").unlink()


def test_paths_and_language_ids(spark):
    rows = spark.createDataFrame([("/a/./b/../c",), ("../x//y/..",), ("a/..",), ("/..",), ("b/c.h",)], "p string")
    assert [r.n for r in rows.select(normal_path(F.col("p")).alias("n")).collect()] == ["/a/c", "../x", ".", "/", "b/c.h"]
    assert [r.n for r in rows.select(absolute_path(F.col("p"), "/r/s").alias("n")).collect()] == ["/a/c", "/r/x", "/r/s", "/", "/r/s/b/c.h"]
    assert [r.n for r in rows.select(relative_path(absolute_path(F.col("p"), "/r"), "/r").alias("n")).collect()][-1] == "b/c.h"
    assert [r.n for r in rows.select(language_id(F.col("p")).alias("n")).collect()] == ["plaintext"] * 4 + ["cpp"]


def test_vector_store_and_embedding(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<float>")
    held = vectors.VectorStore(rows, 2).upsert(spark.createDataFrame([(2, [3.0, 3.0]), (3, [5.0, 5.0])], "id long, vec array<float>")).remove(spark.createDataFrame([(1,)], "id long"))
    held.save(str(tmp_path / "v"))
    again = vectors.VectorStore.load(spark, str(tmp_path / "v"), 2)
    assert [(r.id, r.dist) for r in again.search([3.0, 3.0], 5).collect()] == [(2, 0.0), (3, 8.0)]
    with pytest.raises(ValueError):
        again.search([1.0], 1)
    with pytest.raises(Exception, match="entries is wanted"):
        held.upsert(spark.createDataFrame([(9, [1.0])], "id long, vec array<float>")).vectors.collect()
    spark.createDataFrame([(1,)], "other int").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        vectors.VectorStore.load(spark, str(tmp_path / "bad"), 2)
    texts = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, text string")
    assert [(r.id, r.vec) for r in vectors.embedded(texts, lambda ts: [[float(len(t))] for t in ts], "q: ").orderBy("id").collect()] == [(1, [5.0]), (3, [3.0])]
    pooled = vectors.mean_pool(spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 1, [5.0, 6.0]), (1, 0, [99.0, 99.0]), (2, 0, [1.0, 1.0]), (1, 1, None)], "k int, mask int, vec array<double>"), "k")
    assert {r.k: [round(x, 6) for x in r.vec] for r in pooled.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_embedding_statistics(spark):
    rows = spark.createDataFrame([(i, 10_000_000 * (i % 5 + 1)) for i in range(10)], "i int, v long")
    got = stats.embedding_stats(rows, [F.desc("i")]).first()
    assert (got.sample_count, got.p50, got.avg_ms, round(got.throughput, 3), got.health) == (10, 30_000_000, 30.0, 33.333, "slow")
    assert stats.embedding_stats(rows.limit(0), [F.desc("i")]).first().avg_ms == 0.0
    bad = stats.index_health(rows.select(F.col("i").alias("id")).limit(0), rows.crossJoin(rows.select("i").withColumnRenamed("i", "j"))).first()
    assert bad.health == "degraded" and bad.message == "INDEX_INCONSISTENT: faiss=100 sqlite=0 (delta=100)"
