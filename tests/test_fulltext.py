import pytest

from quern.operators.fulltext import SearchIndex
from quern.operators.search import bm25, parse, search_symbols

ROWS = [
    (1, 10, "analyze_file", "(path)", "Reads a source file and walks its tree."),
    (2, 10, "parse_source", "(text)", "Parses source text into a tree."),
    (3, 10, "SearchEngine", None, "Search over the tree of symbols."),
    (4, 20, "search_text", "(query)", "Full text search."),
    (5, 20, "Überlauf", None, "Größe Ελλάδα がぎ"),
    (6, 30, None, None, None),
]
SCHEMA = "symbol_id long, file_id long, name string, signature string, documentation string"


@pytest.mark.parametrize("query", ["search*", "tree", "search NOT tree", "tree OR text", "source + text", "name : search*", "source file*", "uber*", "Ελλάδα", "がぎ", "nothing"])
def test_index_and_scan_agree(spark, tmp_path, query):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    index = SearchIndex(spark, str(tmp_path / "i")).build(rows)
    asked = parse(query)
    want = {r.symbol_id: round(r["rank"], 9) for r in bm25(rows, asked).collect()}
    assert {r.symbol_id: round(r["rank"], 9) for r in index.bm25(asked).collect()} == want
    assert bool(want) == (query != "nothing")


def test_update_replaces_files_and_compaction_keeps_answers(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    index = SearchIndex(spark, str(tmp_path / "i")).build(rows)
    new = spark.createDataFrame([(7, 10, "walk_tree", None, "Walks."), (4, 40, "other", None, "tree")], SCHEMA)
    index.update(new.where("file_id = 10"), spark.createDataFrame([(10,), (20,)], "file_id long"))
    index.update(new.where("file_id = 40"), spark.createDataFrame([(40,)], "file_id long"))
    want_rows = rows.where("file_id = 30").unionByName(new)
    for held in (index, index.compact(str(tmp_path / "j"))):
        for query in ("tree", "walk*", "search*"):
            want = {r.symbol_id: round(r["rank"], 9) for r in bm25(want_rows, parse(query)).collect()}
            assert {r.symbol_id: round(r["rank"], 9) for r in held.bm25(parse(query)).collect()} == want
    assert held.generations() == [0]


def test_search_with_an_index(spark, tmp_path):
    rows = spark.createDataFrame([(*r, "function", f"f{r[1]}", r[0]) for r in ROWS], SCHEMA + ", kind string, path string, line_start int")
    index = SearchIndex(spark, str(tmp_path / "i")).build(rows.drop("kind", "path", "line_start"))
    assert [r.symbol_id for r in search_symbols(rows, "search", index=index).collect()] == [r.symbol_id for r in search_symbols(rows, "search").collect()]
    assert [r.symbol_id for r in search_symbols(rows, "rch_tex", index=index).collect()] == [4]
    empty = SearchIndex(spark, str(tmp_path / "e")).build(rows.limit(0).select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")))
    assert empty.bm25(parse("tree")).count() == 0
