import ast
import glob
import random
import re
import sysconfig
import warnings

import pytest
from test_source_text import GOOD

from quern.llm import syntax
from quern.llm.grammars import grammar, lexer
from quern.llm.parsing import check, permitted

VALID = {
    "python": [
        "if (a):\n    pass\n",
        "while (n := f()) > 3:\n    n\n",
        "match x:\n    case [1, *rest] if rest:\n        pass\n    case {'a': b, **c} | D(e=1):\n        pass\n    case _: pass\n",
        "match = 3\nmatch.a\ncase: int = 3\n",
        "x = lambda a, *b, c=1, **d: a if b else lambda: c\n",
        "def f(a, /, b=1, *, c, **d) -> int: return a; pass\n",
        "async def g():\n    async with a as b, c: await d\n    return [x async for x in y if await x]\n",
        "a, *b = (c.d), e[1:2, ...] = f'{x!r:>{w}} {y[\"k\"]}'\n",
        "try:\n    pass\nexcept* (A, B) as e:\n    raise C from e\nelse:\n    pass\nfinally:\n    pass\n",
        "type X[T: int] = list[T]\nclass C[T](B, metaclass=M): x: int = 1\n",
        "with (open(a) as f, open(b)):\n    print(*a, sep='', **k)\n",
        "x = (\n  1\n  # note\n  + 2)\nif x: y\nelif z: w\nelse: v\n",
    ],
    "javascript": [
        "let x = a\n  ? b\n  : c\nfoo()\n;[1, 2].map(y => y + 1)\n",
        "label: for (;;) { if (a) break label; else continue }\n",
        "const re = /[/\\]]+/g, s = `a ${b ? `${c}` : \"}\"} d`;\n",
        "class A extends (b, C) { static #x = 1; get y() { return this.#x } static { f() } *[Symbol.iterator]() {} async *g() { yield* h }\n}\n",
        "export default function () {}\nimport d, { a as b, default as c } from 'm'\nexport * as n from \"x\";\n",
        "const { a, b: [c = 1, ...d], ...e } = f, g = async ({ x }, y = 2) => ({ ...x }), h = z?.[1]?.(2) ?? 3;\n",
        "switch (a) { case 1: case 2: { b; } break; default: c }\ndo x++; while (x < 3)\nif (a) b\nelse c\n",
        "var i = a ? b ? 1 : 2 : 3, o = { get, set, async f() {}, get x() { return 1 }, 'k': 1, [l]: 2, };\ntry { a } catch { b } finally { c }\n",
        "new Foo\nnew (bar())(1).x\nx = y\n++z\nfor (const [k, v] of m) for (var p in q) ;\n",
    ],
    "typescript": [
        "interface A<T> extends B<C<T>> { readonly a?: string; [k: string]: any; (x: number): void; new (): A; m?<U>(x: U): x is U }\n",
        "type X = { [K in keyof T as `get${K}`]-?: T[K] } & (A | B)[] | ((x: number, ...y: any[]) => void) | typeof z;\n",
        "abstract class C<T extends D = E> implements I, J { private constructor(readonly a: string, public b?: number) { super() } abstract f(): void; declare x: number; static y!: Map<string, Array<number>>; }\n",
        "enum E { A = 1, B, 'C' }\ndeclare module 'm' { export function f(a: string): number; const x: number }\nnamespace N.M { export const y = 1 }\n",
        "let x = <any>y, z = (a as B<C>)!.d, w = f<string>(1) satisfies G;\nfunction g(this: Window, x?: T extends U ? V : W): asserts x is Y {}\n",
        "import type { A } from './a';\nexport type { B } from './b';\nimport fs = require('fs');\nexport = fs;\n",
    ],
    "go": [
        "package a\n\nfunc f[T any, U ~int | string](x []T, m map[string]func(int) error) (n int, err error) {\n\tif v, ok := m[\"a\"]; ok && v != nil {\n\t\treturn\n\t} else if n > 1 {\n\t\tgo func() { x <- 1 }()\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\treturn n, nil\n}\n",
        "package a\n\nvar x = []T{{1, 2}, {a: 3, b: T{}}}\nconst (\n\tA = iota\n\tB\n)\ntype S struct {\n\tA, b int `json:\"a\"`\n\t*T\n\tsync.Mutex\n}\ntype I interface {\n\tF(a int) (b string)\n\tJ\n}\n",
        "package a\n\nfunc (s *S) f() {\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor range c {\n\t}\nouter:\n\tfor {\n\t\tselect {\n\t\tcase v := <-c:\n\t\t\tbreak outer\n\t\tcase d <- 1:\n\t\t}\n\t}\n\tx, y = y, x\n\tdefer s.mu.Unlock()\n}\n",
    ],
    "java": [
        "class A { int f(Object o) { return switch (o) { case Integer i when i > 3 -> i; case P(int x, var y) -> { yield x; } case null, default -> throw new E(); }; } }\n",
        "public sealed interface S<T extends C & D> permits X, Y { int x = 1; default <U> U f(List<? extends U>... a) throws E { return this.<U>g(a)[0]; } }\n",
        "record R(int a, @N String... b) implements I { R { if (a < 0) throw new X(\"\"); } static int c; }\nenum E { A(1) { int g() { return 1; } }, B; E(int... x) {} }\n@interface N { int v() default 1; String[] w() default {\"a\", \"b\"}; }\n",
        "class B { void f() { int[] a = {1, 2,}, b[] = new int[3][]; Function<A, B> g = (x) -> y -> x.z(y), h = String[]::new; for (int i = 0, j = 1; i < 3; i++, j--) ; for (var e : l) { } try (var r = o(); s) { } finally { } do { x++; } while (x < 3); if (a) b(); else if (c) d(); else { } if (o instanceof String s && s.length() > 1) l: while (true) break l; synchronized (this) { assert x > 1 : \"m\"; } } }\n",
    ],
    "c": [
        "typedef struct s { unsigned a : 3, b[4]; struct { int c; }; union { int d; } *e; } S;\nint (*fp)(void), *g(int (*)(const char *, ...), int[]);\n",
        "static const int t[][2] = { [0] = { 1, 2 }, { .x = 3 } };\nint f(a, b) int a; char *b; { return sizeof(int) * sizeof a + (int)b[1] ? a, b : ({ a; }); }\n",
        "__BEGIN_DECLS\nextern int foo(int __a) __THROW __attribute__((pure));\n#ifdef __cplusplus\nextern \"C\" {\n#endif\nvoid h(void);\n#ifdef __cplusplus\n}\n#endif\n",
        "void f(void) { for (int i = 0; i < 3; i++) switch (i) { case 1: case 2 ... 4: break; default: goto end; }\nend: if (a) b(); else do c--; while (c); printf(\"%\" PRIu64 \"\\n\", x); LIST_FOREACH(x, y) { z(); } }\n",
        "#if A\nint x = 1\n#else\nint x = 2\n#endif\n;\n",
    ],
    "cpp": [
        "namespace a::b { template <typename T, int N = 3> class C final : public D<T>, private E { public: explicit C(int x) : D<T>(x), y{x} {} ~C() override = default; C& operator=(const C&) = delete; operator bool() const noexcept { return y; } virtual void f() = 0; private: int y; }; }\n",
        "auto f(const std::map<int, std::vector<T>>& m, T&&... a) -> decltype(g(a...)) { auto h = [&, x = 1](auto&& y) mutable -> int { return y; }; for (auto& [k, v] : m) { if (auto it = m.find(k); it != m.end()) h(v); } return static_cast<int>(x) + new int[3][1]; }\n",
        "enum class E : int { A, B = 2 };\nusing V = std::vector<E>;\ntemplate <class... T> void g(T... t) { (h(t), ...); try { throw X{}; } catch (const Y& e) { } catch (...) { } }\nstd::ostream& operator<<(std::ostream& o, const E& e) { return o << \"a\" << e; }\n",
        "struct S : B { auto f() const -> std::pair<int, T> override; void g() { a.b = { 1, 2 }; p->~V<int>(); } };\n",
        "A::A(int x) : b(x), c{1, 2} { }\nint A::f() const { return this->b ? c.d() : nullptr == e; }\nextern template class std::vector<int>;\nconstexpr auto s = R\"(a\"b)\"sv;\n",
    ],
    "ruby": [
        "x = <<~A + <<-'B'\n  def (\n  A\n  ] end\n  B\nputs x if y unless z\n",
        "def f a, b = 1, *c, d:, e: 2, **g, &h\n  return a if b\n  a.each_with_index { |x, (y, z)| p x }.map(&:to_s)\nrescue A, B => e\n  retry\nensure\n  b ||= [1, :c, \"d#{e ? \"f\" : 1}g\"]\nend\n",
        "class << self\n  attr_reader :a, :b\n  def ==(o) = o.a == a\n  def x=(v); @x = v; end\n  private def q? ; !@x; end\nend\n",
        "case x\nwhen 1..3, /a b/ then y\nwhen String\n  z\nelse w end\ncase {a: 1}\nin {a: Integer => n} if n > 1\n  n\nend\n",
        "while x do y end\nuntil a\n  b += 1\nend\nfor i, j in k do l end\nbegin; m; end while n\nv = if a then b else c end\na, (b, *c) = d, e\nfoo bar, baz: 1 do |q| q end\nloop { break }\n-> (x) { x + 1 }.call(2)\n",
        "a = b\n  .c(1)\n  &.d\nh = { 'a' => 1, b: 2, \"c\": 3, **d }\nputs [1, 2].include?(x) ? 'y' : %w[n o].first, %q(a (b) c), ?z\nyield x, *y\nraise E, \"m\" unless defined?(z)\n",
    ],
}
INVALID = {
    "python": ["1 = x", 'print "a"', "x = (1 2)", "import", "if x = 3:\n    pass", "for x in:\n    pass", "f(a=1, 2)", "from x import", "lambda: = 3", "else:\n    pass", "def f(a=1, b): pass", "x = [1, 2", "if x:\npass", "  x = 1\n y = 2", "class : pass", "a b", "x = 08", "return return", "try:\n    pass\nx = 1", "f() = 2", "x = 'a", "def f(:\n    pass", "with a as 1: pass", "del f()", "@\ndef f(): pass"],
    "javascript": ["let x = 5 6;", "for (let i = 0; i < 3) { }", "var a = {b: 1 c: 2};", "if x { a(); }", "else { }", "const x;", "f(,)", "class { a b }", "function (", "a = = b", "try { }", "x = [1 2]", "catch (e) { }", "return }", "import a form 'b'", '{"a": 1, "b": 2}', "let 1 = x;", "a.1b", "switch (a) { b }", "case 1:", "x => => y"],
    "typescript": ["let x: = 3;", "interface A { b string }", "function f(a: number b: string) {}", "type = 3 4;", "enum { A B }", "class A { x: number y: string }", "let x: Array<number = 1; }", "import { a b } from 'c'"],
    "go": ["package a\nvar x int 5\n", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", "package a\nfunc f( {\n}\n", "func f() {}\n", "package a\nx := 1\n", "package a\nfunc f() { for i := 0; i < 3 { } }\n", "package a\nfunc f() { a b }\n", "package a\nvar x = []int{1\n2}\n", "package a\nfunc f() { return 1 2 }\n", "package a\nfunc f() { x = }\n"],
    "java": ["class A { void f() { if x > 3 {} } }", "class A { void f() { for (int i = 0; i < 3) {} } }", "class A { void f() { x + 1; } }", "class A { int x = 1 }", "class A { void f() { else { } } }", "class A { void f( { } }", "class A { void f() { try { } } }", "class A { int f(int a int b) { } }", "import a.b\nclass A { }", "class A { void f() { return 1 2; } }", "void f() { }", "class A { void f() { catch (E e) { } } }", "public class { }"],
    "c": ["int f(int a int b);", "int x = 1", "void f(void) { if x { } }", "int f(void) { return 1 2; }", "int a[ = 3;", "void f(void) { else { } }", "int x = 5 6;", "void f(void) { for (int i = 0; i < 3) { } }", "struct { int a } x;", "#if A\nint x;", "def f(a):\n    return a", "void f(void) { a b c d; }", "int x = 09a;"],
    "cpp": ["int f(int a int b);", "class A { public int x; };", "template <class T void f();", "int main() { std::vector<int> x = {1 2}; }", "class A { int x }", "namespace { int x = ; }", "void f() { catch (...) { } }", "void f() { for (auto x : ) { } }", "using namespace ;"],
    "ruby": ["def f\n  x =\nend", "def f(a b)\nend", "x = [1 2]", "if x\n  y\n", "end", "class foo\n", "def f\n  if x\n  end\n", "x = {a: 1 b: 2}", "case x\n  y\nend", "foo(1 2)", "x = (1 + )", "elsif x\nend", "def end", "1 = x"],
}


def invalid(text, lang, window=2048):
    pairs, verdict = check(lang, text, window)
    return bool(pairs or verdict)


@pytest.mark.parametrize("lang", GOOD)
def test_good_and_broken_texts(lang):
    text = GOOD[lang]
    assert not invalid(text, lang) and not invalid("", lang) and not invalid(text.replace("\n", "\r\n"), lang)
    half = text[: text.rindex("g(") + 2] if "g(" in text else text[: len(text) // 2].rstrip() + " ("
    for bad in (half, text + "\n)", "<<<<<<< HEAD\n" + text + "=======\n>>>>>>> x\n", '<!DOCTYPE html>\n<html lang="en">\n<body>\n<p>The file could not be served.</p>\n</body>\n</html>', '{"a": 1, "b": null}\n{' if lang == "python" else '{"a": 1,, }', "Notes on the thing\n\nIt walks from here to there.", text + '\nx = "open\n', GOOD["ruby" if lang != "ruby" else "go"]):
        assert invalid(bad, lang), bad[:60]


@pytest.mark.parametrize("lang", VALID)
def test_valid_texts(lang):
    for text in [*VALID[lang], "\n".join(VALID[lang]) if lang not in ("go", "java", "javascript", "typescript") else VALID[lang][0]]:
        assert not invalid(text, lang), (text, [grammar(lang).show(p) for p in check(lang, text)[0]], check(lang, text)[1])


@pytest.mark.parametrize("lang", INVALID)
def test_invalid_texts(lang):
    for text in INVALID[lang]:
        assert invalid(text, lang), text


@pytest.mark.parametrize("lang", VALID)
def test_windows_change_nothing(lang):
    for text in [*VALID[lang], *INVALID[lang]]:
        assert [check(lang, text, w) for w in (1, 7, 50)] == [check(lang, text)] * 3, text


@pytest.mark.parametrize("lang", VALID)
def test_pairs_come_from_the_grammar(lang):
    # every pair of a text the productions accept is permitted: the pairs say nothing the grammar does not
    for text in VALID[lang]:
        assert not check(lang, text)[0]
    if lang == "python":
        assert grammar(lang).char["NAME"] * 2 not in permitted(lang)


def test_python_agrees_with_its_parser():
    warnings.simplefilter("ignore")
    rng = random.Random(4)
    files = sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/*.py"))
    texts = []
    for f in files:
        with open(f, encoding="utf8") as h:
            texts.append(h.read())
    assert sum(invalid(t, "python") for t in texts) == 0
    agree = {True: [0, 0], False: [0, 0]}
    for t in rng.sample([t for t in texts if len(t) < 30_000], 60):
        spans = [m.span() for m in re.finditer(r"\w+|[^\w\s]|\n[ \t]*", t)]
        for _ in range(4):
            (a, b), (c, d), k = rng.choice(spans), rng.choice(spans), rng.random()
            x = t[:a] + t[b:] if k < 0.4 else t[:a] + " " + t[c:d] + " " + t[a:] if k < 0.8 else t[:a] + t[c:d] + t[b:]
            try:
                ast.parse(x)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            agree[ok][invalid(x, "python") is not ok] += 1
    for wrong, right in agree.values():
        assert right >= 0.98 * (right + wrong), agree


def test_lines_of_ruby_and_heredocs():
    assert lexer("ruby")("x = <<A\ny (\nA\n") == lexer("ruby")('x = ""\n')


def test_unparsable(spark):
    files = spark.createDataFrame([(1, "r/a.py"), (2, "r/b.java"), (3, "r/c.py"), (4, "r/d.xyz"), (5, "r/e.go"), (1, "r/a.py"), (6, "r/long.py"), (8, "r/deep.py"), (9, None)], "id long, path string")
    long = "x = [" + "1, (2), " * 20_000
    deep = "x = " + "(" * 5_000 + "1" + ")" * 5_000 + "\n"
    docs = spark.createDataFrame([(1, GOOD["python"], "c"), (2, GOOD["python"], "c"), (3, None, "c"), (4, "((", "c"), (5, "", "c"), (2, GOOD["java"], "c"), (6, long, "c"), (7, "((", "c"), (8, deep, "c"), (9, "((", "c"), (None, "((", "c")], "file_id long, text string, path string")
    got = {r.file_id: r for r in syntax.unparsable(docs, files).collect()}
    assert sorted(got) == [2, 6] and got[6].nesting == 1
    assert syntax.unparsable(docs.limit(0), files).count() == 0
