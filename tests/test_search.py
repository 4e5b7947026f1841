import sqlite3

import pytest

from quern.operators import search, vectors
from quern.operators.search import parse, prepare

ROWS = [
    (1, "function", "analyze_file", "(path)", "Analyze a single source file"),
    (2, "function", "parse_source", "(text)", "Parse source text into a tree"),
    (3, "class", "SearchEngine", None, "Full text search engine"),
    (4, "method", "search_text", "(query, limit)", "Run a search over text, search again"),
    (5, "function", "extract_calls", "(tree)", "Extract call edges from a tree"),
    (6, "class", "LanguageRegistry", "", "Élève registry of languages"),
]


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([(i, k, n, s, d, "a.py", i, i + 10) for i, k, n, s, d in ROWS], "symbol_id long, kind string, name string, signature string, documentation string, path string, line_start int, line_end int").cache()


@pytest.mark.parametrize("query", ["search*", "ana*", "analyze_file*", "source file*", "name:search*", "search OR tree", "search NOT tree", "eleve", "text AND search", "{name documentation}: tree"])
def test_bm25_equals_the_embedded_engine(symbols, query):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(name, signature, documentation, prefix='2 3', tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    db.executemany("INSERT INTO t(rowid, name, signature, documentation) VALUES (?, ?, ?, ?)", [(i, n, s or "", d) for i, _, n, s, d in ROWS])
    want = {i: round(r, 6) for i, r in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (query,))}
    got = {r.symbol_id: round(r["rank"], 6) for r in search.bm25(symbols, parse(query)).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_prepare():
    assert prepare(' "ana(" ') == "ana*"
    assert prepare("search and engine") == "search and engine"
    assert prepare("a*") == "a*" and prepare("") == ""


@pytest.mark.parametrize("query", ["operator+*", "foo.bar*", "a-b*", "x:y*", "*", "AND*", "a AND", "{name: b"])
def test_bad_queries_raise(query):
    with pytest.raises(search.QueryError):
        parse(query)


def test_search_symbols(symbols):
    names = lambda df: [r.name for r in df.collect()]
    assert names(search.search_symbols(symbols, "analyze_file"))[0] == "analyze_file"
    assert names(search.search_symbols(symbols, "search", "method")) == ["search_text"]
    assert len(names(search.search_symbols(symbols, "search", "", 1))) == 1
    assert names(search.search_symbols(symbols, "", "class")) == ["SearchEngine", "LanguageRegistry"]
    assert names(search.search_symbols(symbols, "zzz")) == [] and names(search.search_symbols(symbols, "foo.bar")) == []
    assert names(search.search_symbols(symbols, "anguage")) == ["LanguageRegistry"]  # the substring
    assert names(search.search_text(symbols, "edges.from")) == [] and names(search.search_text(symbols, "call edges f%m")) == ["extract_calls"]


def test_nearest_and_fusion(spark):
    vec = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (30, [0.0, 0.0, 1.0]), (40, [1.0, 1.0, 0.0]), (-1, [1.0, 0.0, 0.0]), (50, [1.0]), (60, None)], "id long, vec array<float>")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(vectors.nearest(vec, [1, 0, 0], 2)) == [10, 40]
    assert ids(vectors.nearest(vec, [1, 0, 0], 5, spark.createDataFrame([(10,), (30,)], "id long"))) == [10, 30]
    assert ids(vectors.nearest(vec, [1, 0, 0], 5, spark.createDataFrame([], "id long"))) == []
    a = spark.createDataFrame([(1, 0), (2, 1), (-5, 2)], "symbol_id long, position int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "symbol_id long, position int")
    got = [(r.symbol_id, r.provenance) for r in vectors.fuse(a, b, 10).collect()]
    assert got == [(2, "both"), (1, "fts5"), (3, "vector")]


def test_mean_pool(spark):
    rows = spark.createDataFrame([("a", 1, [1.0, 2.0, 3.0, 4.0]), ("a", 1, [3.0, 4.0, 5.0, 6.0]), ("a", 0, [99.0] * 4), ("z", 0, [1.0] * 4)], "k string, mask int, vec array<float>")
    got = {r.k: r.vec for r in vectors.mean_pool(rows, "k").collect()}
    assert sum(x * x for x in got["a"]) == pytest.approx(1) and got["a"][3] / got["a"][0] == pytest.approx(2.5)
    assert got["z"] == [0.0] * 4
