"""Facts of Python source: symbols, calls, control flow, data flow, imports. Plain Python, one text at a time."""

from __future__ import annotations

import ast
import re

DOC_MOST, CONDITION_MOST, RIGHT_MOST = 1024, 256, 128


def _place(node: ast.AST) -> tuple[int, int]:
    return node.lineno, getattr(node, "end_lineno", node.lineno)


def _source(lines: list[bytes], node: ast.AST) -> str:
    a, b = node.lineno - 1, node.end_lineno - 1
    if a == b:
        return lines[a][node.col_offset : node.end_col_offset].decode("utf-8", "replace")
    parts = [lines[a][node.col_offset :], *lines[a + 1 : b], lines[b][: node.end_col_offset]]
    return b"\n".join(parts).decode("utf-8", "replace")


def _comment_above(lines: list[str], line: int) -> str | None:
    i = line - 2
    while i >= 0 and not lines[i].strip():
        i -= 1
    out = []
    while i >= 0 and lines[i].lstrip().startswith("#"):
        out.append(lines[i].strip())
        i -= 1
    return "\n".join(reversed(out))[:DOC_MOST] or None


class _Walk(ast.NodeVisitor):
    def __init__(self, text: str):
        self.lines, self.raw = text.split("\n"), text.encode("utf-8", "surrogatepass").split(b"\n")
        self.symbols: list[dict] = []
        self.calls: list[tuple[str, str, int]] = []
        self.flow: list[tuple[str, str, str | None, int, int]] = []
        self.data: list[tuple[str, str, str, str | None, int]] = []
        self.outer: list[str] = []  # the outermost symbol owns what lies in it
        self.depth = 0
        self.in_class = False

    def owner(self) -> str:
        return self.outer[0] if self.outer else ""

    def symbol(self, node, kind: str) -> None:
        args = getattr(node, "args", None)
        signature = None
        if args is not None:
            first = min((n.lineno, n.col_offset) for n in ast.walk(args) if hasattr(n, "lineno")) if any(hasattr(n, "lineno") for n in ast.walk(args)) else None
            head = _source(self.raw, node)
            open_ = head.find("(")
            close, level = open_, 0
            for i in range(open_, len(head)):
                level += (head[i] == "(") - (head[i] == ")")
                if level == 0:
                    close = i
                    break
            signature = head[open_ : close + 1] if first or open_ >= 0 else None
        doc = ast.get_docstring(node, clean=False)
        line, end = _place(node)
        self.symbols.append({"kind": kind, "name": node.name, "signature": signature, "line_start": line, "line_end": end, "documentation": (doc[:DOC_MOST] if doc is not None else None) or _comment_above(self.lines, line)})

    def enter(self, node, kind: str) -> None:
        self.symbol(node, kind)
        self.outer.append(node.name)
        depth, self.depth = self.depth, self.depth if len(self.outer) > 1 else 0
        within, self.in_class = self.in_class, kind == "class"
        if kind != "class":
            for a in [*node.args.posonlyargs, *node.args.args]:
                if a.annotation is None:
                    self.data.append((self.owner(), "parameter", a.arg, None, a.lineno))
        for child in ast.iter_child_nodes(node):
            self.visit(child)
        self.in_class, self.depth = within, depth
        self.outer.pop()

    def visit_FunctionDef(self, node):
        self.enter(node, "method" if self.in_class else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self.enter(node, "class")

    def visit_Call(self, node):
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            self.calls.append((self.owner(), name, f.end_lineno if isinstance(f, ast.Attribute) else f.lineno))
        self.generic_visit(node)

    def branch(self, node, kind: str, test: ast.AST | None, bodies: list) -> None:
        condition = _source(self.raw, test)[:CONDITION_MOST] if test is not None else None
        self.flow.append((self.owner(), kind, condition, node.lineno, self.depth))
        if test is not None:
            self.visit(test)
        self.depth += 1
        for body in bodies:
            for child in body:
                self.visit(child)
        self.depth -= 1

    def visit_If(self, node):
        self.branch(node, "if_branch", node.test, [node.body])
        if node.orelse:
            other = node.orelse[0]
            is_elif = len(node.orelse) == 1 and isinstance(other, ast.If) and self.lines[other.lineno - 1].lstrip().startswith("elif")
            if is_elif:
                self.flow.append((self.owner(), "else_branch", _source(self.raw, other.test)[:CONDITION_MOST], other.lineno, self.depth))
                self.depth += 1
                for child in other.body:
                    self.visit(child)
                self.depth -= 1
                if other.orelse:
                    self._else(other.orelse)
            else:
                self._else(node.orelse)

    def _else(self, body: list) -> None:
        line = body[0].lineno - 1
        while line > 0 and not re.match(r"\s*else\b", self.lines[line - 1]):
            line -= 1
        self.flow.append((self.owner(), "else_branch", None, line or body[0].lineno, self.depth))
        self.depth += 1
        for child in body:
            self.visit(child)
        self.depth -= 1

    def visit_While(self, node):
        self.branch(node, "loop", node.test, [node.body, node.orelse])

    def visit_For(self, node):
        self.visit(node.iter)
        self.branch(node, "loop", None, [node.body, node.orelse])

    visit_AsyncFor = visit_For

    def visit_Try(self, node):
        self.branch(node, "try_catch", None, [node.body])
        for h in node.handlers:
            self.branch(h, "try_catch", None, [h.body])
        self.depth += 1
        for child in [*node.orelse, *node.finalbody]:
            self.visit(child)
        self.depth -= 1

    def visit_Return(self, node):
        value = _source(self.raw, node.value) if node.value is not None else None
        self.flow.append((self.owner(), "early_return", None, node.lineno, self.depth))
        if self.outer:
            self.data.append((self.owner(), "return_value", "return", _right(value), node.lineno))
        self.generic_visit(node)

    def assigned(self, target: ast.AST, value: ast.AST | None, line: int) -> None:
        if not self.outer:
            return
        names = [e.id for e in target.elts if isinstance(e, ast.Name)] if isinstance(target, (ast.Tuple, ast.List)) else [target.id if isinstance(target, ast.Name) else _source(self.raw, target)]
        for name in names:
            self.data.append((self.owner(), "assignment", name, _right(_source(self.raw, value) if value is not None else None), line))

    def visit_Assign(self, node):
        for t in node.targets:
            self.assigned(t, node.value, node.lineno)
        self.generic_visit(node)

    def visit_AugAssign(self, node):
        self.assigned(node.target, node.value, node.lineno)
        self.generic_visit(node)


def _right(text: str | None) -> str | None:
    return None if text is None else re.sub(r"[\r\n]", " ", text)[:RIGHT_MOST]


def python_facts(text: str) -> dict:
    """{symbols, calls, cfg, dfg, error}: facts of one Python text. A text that does not parse gives its error and nothing else."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return {"symbols": [], "calls": [], "cfg": [], "dfg": [], "error": f"{type(e).__name__}: {getattr(e, 'msg', e)}"}
    w = _Walk(text)
    try:
        w.visit(tree)
    except RecursionError:
        return {"symbols": [], "calls": [], "cfg": [], "dfg": [], "error": "RecursionError: nested too deeply"}
    w.symbols.sort(key=lambda s: (s["line_start"], -s["line_end"], s["name"]))
    return {"symbols": w.symbols, "calls": w.calls, "cfg": sorted(w.flow, key=lambda x: x[3]), "dfg": sorted(w.data, key=lambda x: x[4]), "error": None}


_IMPORTS = {
    "c": re.compile(r"^[ \t]*#[ \t]*include[ \t]*(?:<([^>\n]+)>|\"([^\"\n]+)\")", re.M),
    "python": re.compile(r"^[ \t]*(?:import[ \t]+([\w.]+)[ \t]*(?=\r?$|,|#)|from[ \t]+([\w.]*\w[\w.]*)[ \t]+import\b)", re.M),
    "javascript": re.compile(r"^[ \t]*import\b[^;\n]*?(?:from[ \t]*)?(?:\"([^\"\n]+)\"|'([^'\n]+)')", re.M),
}
_IMPORTS |= {"cpp": _IMPORTS["c"], "typescript": _IMPORTS["javascript"], "tsx": _IMPORTS["javascript"]}


def imports(text: str, language: str) -> list[tuple[int, str, str]]:
    """(line, kind, target) of the imports of a text; other languages have none."""
    rx = _IMPORTS.get(language)
    kind = "include" if language in ("c", "cpp") else "import"
    return [(text.count("\n", 0, m.start(m.lastindex)) + 1, kind, m.group(m.lastindex)) for m in rx.finditer(text)] if rx else []
