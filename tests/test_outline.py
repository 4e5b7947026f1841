import pytest

from quern.functions.outline import LANGUAGES, comment_above, outline

SAMPLES = {
    "javascript": ("export async function open(a, b) {\n  return go(a).then(b);\n}\nclass Box extends Base {\n  static #n = 1;\n  get size() { return this.n }\n  async put(x, { y }) { if (x) { new Thing(x); } }\n}\nconst o = { run(z) { return z } };\n", [("function", "open", "(a, b)"), ("class", "Box", None), ("method", "size", "()"), ("method", "put", "(x, { y })"), ("method", "run", "(z)")], {("open", "go"), ("open", "then")}),
    "typescript": ("interface Shape { area(): number }\nexport class Sq<T> implements Shape {\n  constructor(private s: number) {}\n  area(): number { return mul(this.s); }\n}\nexport function make<T>(s: T): Sq<T> { return new Sq(s); }\n", [("interface", "Shape", None), ("class", "Sq", None), ("method", "constructor", "(private s: number)"), ("method", "area", "()"), ("function", "make", "(s: T)")], {("Sq", "mul")}),
    "go": ("package p\n\ntype Box struct {\n\tn int\n}\n\ntype (\n\tA int\n\tB = string\n)\n\nfunc (b *Box) Add(x int) (int, error) {\n\treturn sum(b.n, x), nil\n}\n\nfunc Of[T any](x T) T {\n\treturn x\n}\n", [("class", "Box", None), ("class", "A", None), ("method", "Add", "(b *Box)"), ("function", "Of", "(x T)")], {("Add", "sum")}),
    "java": ("@A(1)\npublic class Box<T> {\n  public Box(int n) { init(n); }\n  /** Adds. */\n  @Override\n  public <U> int add(int x, List<U> y) throws E { return this.sum(x) + new Thing(x).go(); }\n  abstract void none();\n}\ninterface I { int f(int a); }\n", [("class", "Box", None), ("method", "add", "(int x, List<U> y)"), ("method", "none", "()"), ("interface", "I", None), ("method", "f", "(int a)")], {("Box", "init"), ("Box", "sum"), ("Box", "go")}),
    "c": ("#include <a.h>\nstruct box { int n; };\nenum kind { A, B };\nstatic int add(struct box *b, int x)\n{\n    return sum(b->n, x);\n}\nchar *name(void) { return 0; }\n", [("class", "box", None), ("class", "kind", None), ("function", "add", None), ("class", "box", None)], {("add", "sum")}),
    "cpp": ("namespace n {\nclass Box : public Base {\n public:\n  int add(int x) { return sum(x); }\n};\nint Box::sub(int x) const { return util::dif(x) + this->add(x); }\n}\nint main() { Box b; return b.add(1) + run(); }\n", [("class", "Box", None), ("function", "sub", None), ("function", "main", None)], {("Box", "sum"), ("sub", "dif"), ("main", "run")}),
    "rust": ("pub struct Box { n: i32 }\nimpl<T> Show for Box {\n    fn show(&self, x: i32) -> i32 { a::sum(self.n, x); self.go(); println!(\"x\") }\n}\ntrait Show { fn show(&self, x: i32) -> i32; }\nfn main() { run(); }\n", [("class", "Box", None), ("class", "Box", None), ("function", "show", "(&self, x: i32)"), ("interface", "Show", None), ("function", "main", "()")], {("Box", "sum"), ("main", "run")}),
    "kotlin": ("class Box(val n: Int) {\n  fun add(x: Int): Int = sum(n, x)\n  private fun <T> put(y: T) {\n    y.go()\n  }\n}\nfun String.twice() = repeat(2)\n", [("class", "Box", None), ("method", "add", "(x: Int)"), ("method", "put", "(y: T)"), ("function", "twice", "()")], {("Box", "sum")}),
    "swift": ("protocol P { func f() }\nstruct Box {\n  var n: Int\n  func add(_ x: Int) -> Int { return sum(n, x) }\n}\nfunc main() { run(); b.add(1) }\n", [("interface", "P", None), ("class", "Box", None), ("method", "add", None), ("function", "main", None)], {("Box", "sum"), ("main", "run")}),
    "objc": ("#import <F/F.h>\n@protocol P\n- (void)f;\n@end\n@interface Box : NSObject\n@end\n@implementation Box\n- (int)add:(int)x with:(int)y {\n  return [self sum:x] + go(y);\n}\n@end\nint main(void) { return 0; }\n", [("interface", "P", None), ("class", "Box", None), ("method", "add", None), ("function", "main", None)], {("add", "sum"), ("add", "go")}),
    "ruby": ("module A\n  class B::Box\n    def self.make(n) = new(n)\n    def n=(x); @n = x; end\n    def full?\n      puts \"x\" if n > 1\n      list.each do |i| i.go end\n    end\n  end\nend\n", [("class", "A", None), ("class", "Box", None), ("method", "make", None), ("method", "n=", None), ("method", "full?", None)], {("A", "new"), ("A", "puts"), ("A", "each"), ("A", "go")}),
    "lua": ("local function a(x)\n  if x then return b(x) end\nend\nfunction M.c(y) M.d(y) end\nfunction M:e() for i = 1, 2 do print \"x\" end end\n", [("function", "a", "(x)"), ("method", "c", "(y)"), ("method", "e", "()")], {("a", "b"), ("c", "d"), ("e", "print")}),
    "python": ("class Box:\n    def add(self, x):\n        return sum(x\n\ndef main(:\n    run()\n", [("class", "Box", None), ("method", "add", "(self, x)"), ("function", "main", None)], {("Box", "sum")}),
}


@pytest.mark.parametrize("lang", SAMPLES)
def test_symbols_and_calls(lang):
    text, symbols, calls = SAMPLES[lang]
    got = outline(text, lang)
    assert [(s["kind"], s["name"]) for s in got["symbols"]] == [(k, n) for k, n, _ in symbols]
    for s, (_, _, sig) in zip(got["symbols"], symbols):
        assert s["signature"] == sig or lang == "python"
    assert calls <= {c[:2] for c in got["calls"]}
    assert outline("", lang) == {"symbols": [], "calls": [], "cfg": [], "dfg": [], "error": None}


@pytest.mark.parametrize("lang", sorted(LANGUAGES))
def test_broken_texts_still_give_an_outline(lang):
    text = SAMPLES.get(lang, SAMPLES["typescript"])[0]
    for cut in range(0, len(text), 7):
        outline(text[:cut], lang)
        outline(text[cut:] + ")}]" + text[:cut], lang)


def test_flow_of_the_c_family():
    text = "int f(int *a, int n) {\n  for (int i = 0; i < n; i++) {\n    if (a[i]) n += 1;\n    else { return -1; }\n  }\n  switch (n) {\n  case 1: return 2;\n  default: break;\n  }\n  do { n--; } while (n > 3);\n  int b = n * 2, *c = a;\n  b = b + 1;\n  return b;\n}\n"
    got = outline(text, "c")
    assert [(k, t, line, d) for _, k, t, line, d in got["cfg"]] == [
        ("loop", "i < n", 2, 0), ("if_branch", "a[i]", 3, 1), ("else_branch", None, 4, 1), ("early_return", None, 4, 3), ("switch_case", "1", 7, 0), ("early_return", None, 7, 1), ("switch_case", None, 8, 0), ("loop", "n > 3", 10, 0), ("early_return", None, 13, 0),
    ]
    assert [(k, left, right) for _, k, left, right, _ in got["dfg"] if k != "parameter"] == [("assignment", "i", "0"), ("return_value", "return", "-1"), ("return_value", "return", "2"), ("assignment", "b", "n * 2"), ("assignment", "b", "b + 1"), ("return_value", "return", "b")]
    assert [left for _, k, left, _, _ in got["dfg"] if k == "parameter"] == ["a", "n"]


def test_flow_of_javascript():
    text = "function f(a, { b }) {\n  try {\n    for (const x of a) if (x) return x\n  } catch (e) { return g(() => { while (e) break }) }\n  const [c, d] = a, h = a\n  i.j = 3\n}\n"
    got = outline(text, "javascript")
    assert [(k, line, d) for _, k, _, line, d in got["cfg"]] == [("try_catch", 2, 0), ("loop", 3, 1), ("if_branch", 3, 2), ("early_return", 3, 3), ("try_catch", 4, 1), ("early_return", 4, 2), ("loop", 4, 2)]
    assert [(k, left, right) for _, k, left, right, _ in got["dfg"]] == [("parameter", "a", None), ("return_value", "return", "x"), ("return_value", "return", "g(() => { while (e) break })"), ("assignment", "h", "a")]


def test_comments_above():
    assert comment_above("// a\n// b\nf", 10) == "// a\n// b"
    assert comment_above("x /* a\n b */\n\nf", 14) == "/* a\n b */"
    assert comment_above("#include <a>\nf", 13) == "#include <a>"
    assert comment_above("x = 1\nf", 6) is None and comment_above("f", 0) is None
