import textwrap

from quern.functions.facts import imports, python_facts
from quern.operators.extract import facts

TEXT = textwrap.dedent(
    '''
    import os.path
    from a.b import c


    # Says hello.
    def greet(name):
        """Return a greeting message."""
        return hello(name)


    class Calculator:
        def add(self, a: int, b: int):
            total = self.log(a)
            if a > 0:
                for x in b:
                    return x
            elif b:
                total += 1
            else:
                raise ValueError
            try:
                run()
            except OSError:
                return None
            return a + b


    def main():
        x, y = greet("x"), farewell("y")
    '''
)


def test_python_facts():
    got = python_facts(TEXT)
    assert [(s["kind"], s["name"]) for s in got["symbols"]] == [("function", "greet"), ("class", "Calculator"), ("method", "add"), ("function", "main")]
    assert got["symbols"][0]["documentation"] == "Return a greeting message."
    assert got["symbols"][2]["signature"] == "(self, a: int, b: int)"
    # a call inside a class belongs to the outermost symbol
    assert {(o, n) for o, n, _ in got["calls"]} == {("greet", "hello"), ("Calculator", "log"), ("Calculator", "run"), ("main", "greet"), ("main", "farewell")}
    kinds = [k for o, k, *_ in got["cfg"] if o == "Calculator"]
    assert kinds == ["if_branch", "loop", "early_return", "else_branch", "else_branch", "try_catch", "try_catch", "early_return", "early_return"]
    depths = {(k, line): d for _, k, _, line, d in got["cfg"]}
    assert sorted(depths.values())[-1] == 2
    assert [(k, n) for o, k, n, *_ in got["dfg"] if o == "main"] == [("assignment", "x"), ("assignment", "y")]
    assert ("Calculator", "parameter", "self") in {(o, k, n) for o, k, n, *_ in got["dfg"]}


def test_bad_text_gives_an_error():
    assert python_facts("def f(:")["error"].startswith("SyntaxError") and python_facts("")["error"] is None


def test_imports():
    assert imports(TEXT, "python") == [(2, "import", "os.path"), (3, "import", "a.b")]
    assert imports('#include <a.h>\n# include "b.h"\n', "cpp") == [(1, "include", "a.h"), (2, "include", "b.h")]
    assert imports('import x from "./y";\nimport "z";\n', "typescript") == [(1, "import", "./y"), (2, "import", "z")]
    assert imports("use std::io;", "rust") == []


def test_facts_of_a_table(spark):
    rows = spark.createDataFrame([("a.py", "python", TEXT), ("b.py", "python", "def f(:"), ("c.h", "c", "#include <x>\n"), ("d.py", "python", None), ("e.py", "python", "")], "path string, language string, content string")
    got = facts(rows).collect()
    assert {r.path for r in got if r.fact == "error"} == {"b.py"}
    assert sum(r.fact == "symbol" for r in got) == 5 and sum(r.fact == "import" for r in got) == 3
