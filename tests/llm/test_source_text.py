import pytest

from quern.llm import docpairs, handwritten
from quern.llm.docpairs import functions, informative
from quern.llm.winnow import Codes, fingerprints, token_codes

GOOD = {
    "python": "import a\n\n@dec\ndef f(x, *y, z: int = 3, **k) -> int:\n    '''doc (unclosed'''\n    if x > 1 and not y:\n        return [i for i in y if i]\n    elif z: pass\n    else:\n        x = {'a': 1, **k}\n    return -x\n\nclass C(B):\n    a: int = 1\n    async def g(self):\n        await h(x)[0].y\n",
    "javascript": "const a = require(\"./a\");\n// see (\nclass C extends B {\n  f(x, y = 1) {\n    if (x) return `t ${x}`;\n    for (const i of x) { y += i; }\n    return x ? y : { a: 1, b };\n  }\n}\nconst g = (x) => x + 1;\nmodule.exports = { g };\n",
    "typescript": "import * as a from \"./a\";\nexport function f(x: number, y?: string[]): any {\n  const z: number = x + 1;\n  return z;\n}\ninterface I { a: string; }\n",
    "go": "package a\n\nimport (\n\t\"fmt\"\n\t\"b/c\"\n)\n\ntype T struct {\n\tlimit int\n}\n\nfunc (t *T) F(x []string, n int) int {\n\tif n > 1 {\n\t\treturn n\n\t}\n\tfor _, i := range x {\n\t\tfmt.Println(i)\n\t}\n\treturn 0\n}\n",
    "java": "package a.b;\n\nimport java.util.List;\n\npublic class C {\n    /* { */\n    private static int f(List<String> x, int y) {\n        for (var i : x) { y = y + 1; }\n        if (y < 3) { return y; }\n        return (int) y;\n    }\n}\n",
    "c": "#include <stdio.h>\n#define X 1\nstatic int f(int a, char *b) {\n    for (int i = 0; i < a; i++) { g(i, \"(\"); }\n    return a ? 1 : 0;\n}\nstatic const int t[] = { 1, 2, };\n",
    "cpp": "#include <vector>\nclass C {\npublic:\n    int f(std::vector<int> &x) {\n        for (auto &i : x) { g(i); }\n        return 0;\n    }\n};\n",
    "ruby": "require \"a\"\n\nclass C\n  # see (\n  def f(x, y = 1)\n    return x if y == 2\n    x.each do |i|\n      g(i)\n    end\n    if x\n      y = 3\n    end\n    y\n  end\nend\n",
}


def test_functions_and_their_documentation():
    got = functions(GOOD["python"], "python")
    assert [(g[0], g[1], g[5]) for g in got] == [("f", 4, "'''doc (unclosed'''"), ("g", 15, None)]
    assert got[0][4] == "(x, *y, z: int = 3, **k)"
    assert [(g[0], g[5]) for g in functions(GOOD["ruby"], "ruby")] == [("f", "  # see (\n")]
    for lang, name in (("go", "F"), ("java", "f"), ("c", "f"), ("cpp", "f"), ("javascript", "f"), ("typescript", "f")):
        assert name in [g[0] for g in functions(GOOD[lang], lang)]
    assert functions("int a = 1;\n" * 3 + "(" * 5000, "c") == []


@pytest.mark.parametrize(
    "doc,name,tells",
    [
        ("# Returns an empty list when the lease has expired.", "f", True), ("/** Blocks until idle. */", "run", True), ("// Fetch node.", "fetchNode", False), ("// This function scans the tree by key.", "scan_tree_by_key", False),
        ("// TODO: document this", "f", False), ("// TODO: make it fast. Skips old rows when pinned.", "f", True), ("'''   '''", "f", False), ("# -----", "f", False), ("/// @param x the x\n/// @return", "f", False),
        ("// @param seed the place to start from, never negative", "f", True), ("# noqa", "f", False), ("// see above", "f", False), ("// Copyright (c) 2020 the authors. All rights reserved.", "f", False), ("// old = f(x)\n// return old", "f", False),
        ('#include "a.h"\n#include <b.h>', "f", False), ("// Helper.", "f", False), (None, "f", False), ("// 例: 空の配列も可", "f", True), ("n/a", "f", False),
    ],
)
def test_informative(doc, name, tells):
    assert informative(doc, name, "(x)") is tells


def test_documented_functions(spark):
    symbols = spark.createDataFrame([(1, 1, "function", "f", None, 4, None), (1, 1, "function", "f", None, 4, None), (2, 1, "method", "g", None, 15, "Waits for the slow reader."), (3, 1, "class", "C", None, 13, "Waits for the slow reader."), (4, 9, "function", "h", None, 1, None), (5, 1, "function", "k", None, None, "")], "id long, file_id long, kind string, name string, signature string, line_start int, documentation string")
    files = spark.createDataFrame([(1, "a.py")], "id long, path string")
    text = GOOD["python"].replace("doc (unclosed", "Walks rows from oldest to newest.")
    docs = spark.createDataFrame([(1, text), (1, text), (1, None)], "file_id long, text string")
    got = {r.symbol_id: r.description for r in docpairs.documented_functions(symbols, docs, files).collect()}
    assert got == {1: "Walks rows from oldest to newest.", 2: "Waits for the slow reader."}
    assert docpairs.documented_functions(symbols.limit(0), docs, files).count() == 0


def test_marks_of_programs():
    yes = ["// Code generated by x. DO NOT EDIT.\nint a;", "# @generated by x from y.idl\n", "// Automatisch erzeugt mit x, nicht von Hand ändern", "// Archivo creado por x. Los cambios se perderán al regenerar."]
    no = ["// @generated by {tool} from {x}.idl", "// First draft was generated with x, rewritten and kept by hand since.", "s = 'Code generated by x. DO NOT EDIT.'", "// Auto-generated method stub", "# Reads the tables that x generated; edit freely."]
    assert all(map(handwritten.marked, yes)) and not any(map(handwritten.marked, no))


def test_fingerprints_survive_comments_and_numbers():
    x, y = (fingerprints(token_codes(t, Codes())) for t in (GOOD["java"] * 2, ("// new head\n" + GOOD["java"] * 2).replace("y < 3", "y < 99")))
    assert len(set(x) & set(y)) >= 0.9 * len(set(x)) and len(fingerprints(token_codes("a b", Codes()))) == 0


def test_not_handwritten(spark):
    small = "var bx0={q:6};" * 60
    table = "T = [\n" + "    1, 2, 3, 4,\n" * 40 + "]\n"
    docs = [(1, "r", GOOD["java"]), (2, "r", "// patched here\n" + GOOD["go"] * 2), (3, "r", small), (4, "r", table), (5, "r", "# @generated by x from y\nX = 1\n"), (6, "r", None), (7, "r", ""), (4, "r", table), (8, "r", GOOD["python"] + 's = "' + "long text " * 200 + '"\n')]
    df = spark.createDataFrame(docs, "file_id long, repository string, text string")
    lib = spark.createDataFrame([(1, GOOD["go"] * 2), (2, None)], "lib_file_id long, text string")
    got = {r.file_id: r.reasons for r in handwritten.not_handwritten(df, lib).collect()}
    assert set(got) == {2, 3, 4, 5} and got[2] == ["library copy"] and got[5] == ["generated"]
    assert handwritten.not_handwritten(df.limit(0), lib).count() == 0


def test_functions_come_with_their_bodies(spark):
    ends = {"python": "return -x", "ruby": "    y\n  end", "go": "return 0\n}", "java": "return (int) y;\n    }", "c": "1 : 0;\n}", "cpp": "return 0;\n    }", "javascript": "{ a: 1, b };\n  }", "typescript": "return z;\n}"}
    for lang, tail in ends.items():
        code = [GOOD[lang][g[2] : g[3]] for g in functions(GOOD[lang], lang) if g[0] in "fF"]
        assert len(code) == 1 and code[0].endswith(tail), (lang, code)
    symbols = spark.createDataFrame([(1, 1, "function", "f", None, 4, None), (2, 1, "method", "g", None, 15, "Waits for the slow reader."), (3, 9, "function", "h", None, 1, "Waits for the slow reader.")], "id long, file_id long, kind string, name string, signature string, line_start int, documentation string")
    files = spark.createDataFrame([(1, "a.py")], "id long, path string")
    docs = spark.createDataFrame([(1, GOOD["python"].replace("doc (unclosed", "Walks rows from oldest to newest."))], "file_id long, text string")
    got = {r.symbol_id: r.code for r in docpairs.documented_functions(symbols, docs, files).collect()}
    assert set(got) == {1, 2, 3} and got[1].endswith("return -x") and got[2].strip() == "async def g(self):\n        await h(x)[0].y" and got[3] is None


def test_parameters_nested_to_any_depth():
    deep = "def f(a=" + "(" * 3_000 + "1" + ")" * 3_000 + "):\n    '''Adds the widgets of a tray.'''\n    return a\n"
    assert [(g[0], g[5]) for g in functions(deep, "python")] == [("f", "'''Adds the widgets of a tray.'''")]


def test_marks_are_judged_by_their_sentence():
    assert handwritten.marked("# This file was automatically generated. Originally from the tray kit.\nx = 1\n")
    assert not handwritten.marked("# The first draft of this file was generated by a tool.\nx = 1\n")


def test_documents_of_a_file_are_judged_one_by_one(spark):
    body = "\n".join(f"def walk_{i}(tray, size):\n    item{i} = tray.take({i}) + size * {i + 3}\n    return fold(item{i}, size - {i}, tray)[{i}:]" for i in range(40))
    docs = spark.createDataFrame([(1, "r", body), (1, "r", "x = 1\n" * 3), (2, "r", None), (None, "r", "x"), (3, None, "y = 2\n")], "file_id long, repository string, text string")
    library = spark.createDataFrame([(9, body)], "lib_file_id long, text string")
    assert "library copy" in {r.file_id: r.reasons for r in handwritten.not_handwritten(docs, library).collect()}[1]
    assert handwritten.not_handwritten(docs, library.limit(0)).where("array_contains(reasons, 'library copy')").count() == 0
