"""Facts of source in any of fourteen languages, from tokens and their brackets: symbols, calls, control and data flow.

Nothing here needs a text to be valid: a bracket without a partner ends with the text, and what is not understood is
passed over. Lines count from 1.
"""

from __future__ import annotations

import re
from bisect import bisect_right

DOC_MOST, CONDITION_MOST, RIGHT_MOST = 1024, 256, 128

_STRING = r'"(?:[^"\\\n]|\\[\s\S])*"?|' + r"'(?:[^'\\\n]|\\[\s\S])*'?"
_BRACE_NOTE, _HASH_NOTE, _LUA_NOTE = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", r"#[^\n]*", r"--\[\[[\s\S]*?(?:\]\]|\Z)|--[^\n]*"
_TEXT = {
    "python": (_HASH_NOTE, r"[rRbBuUfF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z))|" + _STRING),
    "ruby": (_HASH_NOTE + r"|(?m:^)=begin\b[\s\S]*?(?:(?m:^)=end\b[^\n]*|\Z)", _STRING + r"|`[^`\n]*`|:\w+[?!]?(?!:)|%[wWiIqQ]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})"),
    "lua": (_LUA_NOTE, _STRING + r"|\[\[[\s\S]*?(?:\]\]|\Z)"),
    "rust": (_BRACE_NOTE, r'r#*"[\s\S]*?"#*|"(?:[^"\\]|\\[\s\S])*"?|' + r"'(?:[^'\\\n]|\\[^\n]+?)'|'\w+"),
    "go": (_BRACE_NOTE, _STRING + r"|`[^`]*`?"),
    "c": (_BRACE_NOTE + r"|(?m:^)[ \t]*\#[ \t]*(?!include)\w+(?:[^\n\\]|\\\r?\n|\\[^\n])*", _STRING),
}
_TEXT |= {lang: _TEXT["c"] for lang in ("cpp", "objc")}
_OTHER = (_BRACE_NOTE, r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|" + _STRING + r"|`(?:[^`\\]|\\[\s\S])*`?")
_TOKENS = {
    lang: re.compile(rf"(?P<note>{note})|(?P<text>{text})|(?P<name>[^\W\d][\w$]*{'(?:[?!](?!=))?' if lang == 'ruby' else ''}|[$@#]+[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\.?\d[\w.]*)|(?P<op>=>|->|::|\?\.|&&|\|\||[<>=!:+*/%&|^-]=|\+\+|--|[^\w\s])")
    for lang, (note, text) in {**{x: _OTHER for x in ("javascript", "typescript", "tsx", "java", "kotlin", "swift")}, **_TEXT}.items()
}
_SHUT = {"(": ")", "[": "]", "{": "}"}
#: Words that no call or definition has for a name, in every language and in some.
_EVERY = frozenset(
    "if for while switch catch return else do throw sizeof function func fn fun in typeof delete case unless until and or not elif elsif class struct enum interface protocol trait impl union "
    "namespace template operator try finally with yield import export package super this void synchronized is as lambda end begin module rescue ensure then local nil None True False true false null "
    "static_cast dynamic_cast const_cast reinterpret_cast decltype alignof noexcept constexpr throws goto break continue var let const static public private protected".split()
)
_SOME = {"go": "go defer select range", "swift": "init deinit guard repeat where self", "rust": "match loop where self move", "kotlin": "when where", "javascript": "new of await from default", "typescript": "new of await from default", "tsx": "new of await from default", "java": "new default", "cpp": "new", "python": "def await self", "ruby": "def self", "lua": "repeat"}
_NO_NAMES = {lang: _EVERY | frozenset(_SOME.get(lang, "").split()) for lang in _TOKENS}


def comment_above(text: str, start: int) -> str | None:
    """The comment that ends right above a place: a whole block, or the lines in a row that begin with a mark."""
    head = text[:start].rstrip(" \t\r\n")
    if head.endswith("*/"):
        at = head.rfind("/*", 0, len(head) - 2)
        return head[at:][:DOC_MOST] if at >= 0 else None
    lines: list[str] = []
    for line in reversed(head.split("\n")) if head else ():
        line = line.lstrip(" \t")
        if not line.startswith(("//", "#")):
            break
        lines.append(line)
    return "\n".join(reversed(lines))[:DOC_MOST] or None


class Outline:
    """The tokens of a text with their brackets, and the facts found among them."""

    def __init__(self, text: str, language: str, members: bool = False):
        """members: whether methods defined within a C++ class are symbols of their own."""
        self.text, self.language, self.members = text, language, members
        self.words = _NO_NAMES[language]
        self.kind: list[str] = []
        self.word: list[str] = []
        self.at: list[int] = []
        for m in _TOKENS[language].finditer(text):
            if m.lastgroup != "note":
                self.kind.append(m.lastgroup)
                self.word.append(m.group())
                self.at.append(m.start())
        self.n = len(self.word)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.partner: dict[int, int] = {}
        self.parent: list[int] = []  # the innermost open brace around each token
        stack: list[int] = []
        for i, w in enumerate(self.word):
            if self.kind[i] == "op" and w in _SHUT:
                self.parent.append(next((s for s in reversed(stack) if self.word[s] == "{"), -1))
                stack.append(i)
                continue
            if self.kind[i] == "op" and w in ")]}":
                while stack and _SHUT[self.word[stack[-1]]] != w and any(_SHUT[self.word[s]] == w for s in stack):
                    self.partner[stack.pop()] = i
                if stack and _SHUT[self.word[stack[-1]]] == w:
                    self.partner[stack[-1]] = i
                    stack.pop()
            self.parent.append(next((s for s in reversed(stack) if self.word[s] == "{"), -1))
        for s in stack:
            self.partner[s] = self.n
        self.symbols: list[dict] = []
        self.roots: list[tuple[int, int, str]] | None = None
        self.spans: list[tuple[int, int]] = []  # bodies of functions that are no symbols
        self.lists: list[tuple[int, int]] = []  # parameter lists of functions with a body
        self.named: set[int] = set()  # tokens that name a definition
        self.body: dict[int, str] = {}  # kind of the symbol whose body a brace opens

    # ---- small questions ----

    def w(self, i: int) -> str:
        return self.word[i] if 0 <= i < self.n else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "name"

    def line(self, i: int) -> int:
        return bisect_right(self.breaks, self.at[i] - 1) + 1 if 0 <= i < self.n else len(self.breaks) + 1

    def end(self, i: int) -> int:
        return self.at[i] + len(self.word[i]) if 0 <= i < self.n else len(self.text)

    def close(self, i: int) -> int:
        return self.partner.get(i, i)

    def slice(self, a: int, b: int) -> str:
        return self.text[self.at[a] : self.end(b)] if a <= b and a < self.n else ""

    def angle(self, i: int) -> int:
        """What follows type parameters that begin here, if any do."""
        if self.w(i) != "<":
            return i
        depth = 0
        for j in range(i, min(self.n, i + 200)):
            if self.kind[j] == "op":
                depth += self.word[j].count("<") - (self.word[j].count(">") if self.word[j] not in ("=>", "->", ">=") else 0)
                if self.word[j] in (";", "{"):
                    return i
            if depth <= 0:
                return j + 1
        return i

    def brace(self, i: int, stops: str = ";}") -> int:
        """The next open brace before a stop at this depth, or -1."""
        while i < self.n:
            w = self.word[i]
            if self.kind[i] == "op":
                if w == "{":
                    return i
                if w in stops:
                    return -1
                if w in "([":
                    i = self.close(i)
            i += 1
        return -1

    def add(self, kind: str, name: int, first: int, last: int, params: int = -1, body: int = -1) -> None:
        self.named.add(name)
        if params >= 0 and self.language == "javascript":
            self.lists.append((params, self.close(params)))
        if body >= 0:
            self.body[body] = kind
        last = min(last, self.n - 1)
        self.symbols.append({"kind": kind, "name": self.word[name], "signature": self.slice(params, self.close(params)) if params >= 0 else None, "line_start": self.line(first), "line_end": self.line(last), "documentation": comment_above(self.text, self.at[first]), "start": self.at[first], "end": self.end(last)})

    def first_of(self, i: int, words: frozenset) -> int:
        """Where the modifiers before a token begin."""
        while i > 0 and self.word[i - 1] in words:
            i -= 1
        return i

    # ---- symbols ----

    def find_symbols(self) -> list[dict]:
        getattr(self, f"_{self.language}")()
        seen, kept = set(), []
        for s in self.symbols:
            if (s["start"], s["name"]) not in seen:
                seen.add((s["start"], s["name"]))
                kept.append(s)
        self.symbols = sorted(kept, key=lambda s: s["line_start"])
        return self.symbols

    _MODS = frozenset("public private protected static final abstract native synchronized default strictfp async export override open internal suspend inline data sealed readonly declare pub unsafe extern mutating fileprivate".split())

    def _javascript(self) -> None:
        for i in range(self.n):
            w = self.word[i]
            if self.kind[i] != "name" or self.w(i - 1) in (".", "?."):
                continue
            if w in ("class", "interface") and self.is_name(i + 1) and self.w(i + 1) not in ("extends", "implements"):
                b = self.brace(i + 2)
                if b >= 0 and (w == "class" and (i == 0 or self.w(i - 1) not in ("=", "(", ",", "return", "=>", ":", "?")) or w == "interface" and self.language != "javascript"):
                    self.add(w, i + 1, i, self.close(b), -1, b)
                elif b >= 0:
                    self.body[b] = "class"
            elif w == "class" and self.w(i + 1) in ("{", "extends"):
                self.body[self.brace(i + 1)] = "class"
            elif w == "function":
                k = i + 2 if self.w(i + 1) == "*" else i + 1
                p = self.angle(k + 1)
                b = self.brace(self.close(p) + 1, ";}=") if self.is_name(k) and self.w(p) == "(" else -1
                if b >= 0 and self.w(i - 1) not in ("=", "(", ",", "return", "=>", ":", "?", "&&", "||", "!", "new", "[", "+"):
                    first = i - 1 if self.w(i - 1) == "async" else i
                    self.add("function", k, first, self.close(b), p, b)
            elif w not in self.words or w in ("constructor", "get", "set", "static", "from", "as", "is", "default", "delete", "with"):
                p = self.angle(i + 1)
                if self.w(p) != "(" or self.w(i - 1) in ("function", "new", "*") and self.w(i - 2) == "function":
                    continue
                b = self.close(p) + 1
                if self.w(b) == ":" and self.language != "javascript":
                    b = self.brace(b, ";}=")
                if 0 <= b < self.n and self.w(b) == "{" and self.parent[i] >= 0 and self.w(i - 1) in ("{", "}", ";", ",", "*", "async", "get", "set", *self._MODS, ")", "]") or 0 <= b < self.n and self.w(b) == "{" and self.body.get(self.parent[i]) == "class":
                    self.add("method", i, self.first_of(i, self._MODS | {"get", "set", "*", "async"}), self.close(b), p, b)

    _typescript = _tsx = _javascript

    def _go(self) -> None:
        for i in range(self.n):
            w = self.word[i]
            if w == "func" and self.parent[i] < 0:
                receiver = i + 1 if self.w(i + 1) == "(" else -1
                k = self.close(i + 1) + 1 if receiver >= 0 else i + 1
                p = k + 1
                if self.w(p) == "[":
                    p = self.close(p) + 1
                if self.is_name(k) and self.w(p) == "(":
                    b = self.brace(self.close(p) + 1, ";}")
                    if b >= 0 and self.w(b - 1) in ("interface", "struct"):
                        b = self.brace(self.close(b) + 1)
                    if b >= 0:
                        self.add("method" if receiver >= 0 else "function", k, i, self.close(b), receiver if receiver >= 0 else p, b)
            elif w == "type" and self.kind[i] == "name":
                many = self.w(i + 1) == "("
                j, stop = i + 2 if many else i + 1, self.close(i + 1) if many else -1
                while self.is_name(j) and (not many or j < stop):
                    k, line = j + 1, self.line(j)
                    while k < self.n and (self.line(k) == line or False) and (not many or k < stop):
                        if self.w(k) in _SHUT:
                            k = self.close(k)
                            line = self.line(min(k, self.n - 1))
                        k += 1
                    if self.w(j + 1) != "=":
                        self.add("class", j, i, stop if many else k - 1)
                    j = k
                    if not many:
                        break

    def _c_like(self, keyword: tuple[str, ...]) -> None:
        for i in range(self.n):
            w = self.word[i]
            if self.kind[i] != "name":
                continue
            if w in keyword and self.is_name(i + 1) and self.w(i - 1) not in ("enum", "<", ",") or w in keyword and self.is_name(i + 1) and self.w(i - 1) == "," and self.language == "c":
                b = i + 2
                if self.language == "cpp":
                    b = i + 2 if self.w(i + 2) == "{" else self.brace(i + 2, ";}(=)>,*&") if self.w(i + 2) in (":", "final") else -1
                has = b >= 0 and self.w(b) == "{"
                self.add("class", i + 1, i, self.close(b) if has else i + 1, -1, b if has else -1)
                continue
            p = i + 1
            if w in self.words or self.w(p) != "(" or self.w(i - 1) in (".", "->", "~"):
                continue
            b = self.close(p) + 1
            while self.w(b) in ("const", "noexcept", "override", "final", "volatile") or self.is_name(b) and self.w(b).startswith("__") or self.w(b) == "(" and b > 0 and self.w(b - 1).startswith(("__", "noexcept")):
                b = self.close(b) + 1 if self.w(b) == "(" else b + 1
            if self.w(b) in (":", "->"):
                b = self.brace(b + 1, ";}")
            if not (0 <= b < self.n and self.w(b) == "{"):
                continue
            outer = self.parent[i]
            member = self.body.get(outer) == "class" and self.language == "cpp"
            if member and not self.members:
                self.lists.append((p, self.close(p)))
                self.spans.append((self.at[i], self.end(self.close(b))))
                continue
            if outer >= 0 and not member and not (self.w(outer - 1) == "namespace" or self.w(outer - 2) in ("namespace", "extern") or self.kind[outer - 1] == "text" or self.w(outer - 2) == "::"):
                continue
            first = i
            while self.w(first - 1) == "::" and (self.is_name(first - 2) or self.w(first - 2) == ">"):
                first -= 2
            if self.w(first - 1) in ("*", "&", "&&"):
                continue  # the declarator of a pointer or reference is none of a function
            begin = first
            while begin > 0 and self.word[begin - 1] not in (";", "}", "{", ")", ":") and not self.word[begin - 1].startswith("#") and self.kind[begin - 1] != "text" and self.line(begin - 1) >= self.line(first) - 1:
                begin -= 1
            self.add("method" if member else "function", i, begin, self.close(b), -1, b)
            self.lists.append((p, self.close(p)))

    def _c(self) -> None:
        self._c_like(("struct", "enum"))

    def _cpp(self) -> None:
        self._c_like(("class", "struct"))

    def _java(self) -> None:
        for i in range(self.n):
            w = self.word[i]
            if self.kind[i] != "name" or self.w(i - 1) == ".":
                continue
            if w in ("class", "interface", "enum", "record") and self.is_name(i + 1) and not (w == "interface" and self.w(i - 1) == "@"):
                b = self.brace(i + 2, ";}")
                if b >= 0:
                    self.body[b] = "class"
                    if w in ("class", "interface"):
                        self.add(w, i + 1, self.first_of(i, self._MODS), self.close(b), -1, b)
            elif self.w(i + 1) == "(" and w not in self.words and self.body.get(self.parent[i]) in ("class", "interface"):
                before = self.w(i - 1)
                if before in ("new", ".", "@", "=", "return", ";", "}", "{", "(", ",") or before in self._MODS or not (self.is_name(i - 1) or before in ("]", ">", "void")):
                    continue
                b = self.close(i + 1) + 1
                end = self.brace(b, ";}") if self.w(b) in ("{", "throws") else -1
                if end < 0 and self.w(b) not in (";", "throws", "default"):
                    continue
                first = i
                while first > 0 and self.word[first - 1] not in (";", "}", "{", ")"):
                    first -= 1
                last = self.close(end) if end >= 0 else next((j for j in range(b, self.n) if self.word[j] == ";"), b)
                self.add("method", i, first, last, i + 1, end)

    def _fun(self, word: str, classes: tuple[str, ...], interfaces: tuple[str, ...], promote: bool, signed: bool) -> None:
        for i in range(self.n):
            w = self.word[i]
            if self.kind[i] != "name" or self.w(i - 1) in (".", "::"):
                continue
            if (w in classes or w in interfaces) and self.is_name(i + 1):
                b = self.brace(i + 2, ";}") if self.language == "rust" else self._near_brace(i + 2)
                self.add("interface" if w in interfaces else "class", i + 1, self.first_of(i, self._MODS), self.close(b) if b >= 0 else self._end_of_line(i + 1), -1, b)
            elif w == "impl" and self.language == "rust":
                b = self.brace(i + 1, ";}")
                if b >= 0:
                    j = max((k for k in range(i, b) if self.word[k] == "for"), default=self.angle(i + 1) - 1) + 1
                    self.body[b] = "impl"
                    if self.is_name(j) and self.w(j + 1) in ("{", "where"):
                        self.add("class", j, i, self.close(b), -1, b)
            elif w == word:
                k = self.angle(i + 1)
                while self.w(k + 1) == ".":
                    k += 2
                p = self.angle(k + 1)
                if not self.is_name(k) or self.w(p) != "(":
                    continue
                b = self.brace(self.close(p) + 1, ";}") if self.language == "rust" else self._near_brace(self.close(p) + 1)
                if b < 0 and (self.language in ("rust", "swift") or self.w(self.close(p) + 1) == "{"):
                    continue
                member = promote and self.body.get(self.parent[i]) in ("class", "interface")
                self.add("method" if member else "function", k, self.first_of(i, self._MODS), self.close(b) if b >= 0 else self._end_of_line(self.close(p)), p if signed else -1, b)

    def _near_brace(self, i: int) -> int:
        """An open brace that belongs to the declaration going on here: on its lines, before the next one."""
        line = self.line(i - 1)
        while i < self.n:
            if self.word[i] == "{":
                return i if self.line(i) <= line + 1 else -1
            if self.word[i] in ("=", ";", "}") or self.line(i) > line + 1 or self.word[i] in ("fun", "func", "class") and self.line(i) > line:
                return -1
            if self.word[i] in "([":
                i = self.close(i)
                line = self.line(min(i, self.n - 1))
            elif self.word[i] in (",", ":", "->", "where"):
                line = self.line(i)
            i += 1
        return -1

    def _end_of_line(self, i: int) -> int:
        line = self.line(i)
        while i + 1 < self.n and self.line(i + 1) == line:
            i += 1
            if self.word[i] in _SHUT:
                i = min(self.close(i), self.n - 1)
                line = self.line(i)
        return i

    def _rust(self) -> None:
        self._fun("fn", ("struct", "enum"), ("trait",), False, True)

    def _kotlin(self) -> None:
        self._fun("fun", ("class", "interface"), (), True, True)

    def _swift(self) -> None:
        self._fun("func", ("class", "struct", "enum", "actor"), ("protocol",), True, False)

    def _objc(self) -> None:
        self._c_like(())
        inside = False
        for i in range(self.n):
            w = self.word[i]
            if w in ("@interface", "@protocol") and self.is_name(i + 1):
                last = next((j for j in range(i, self.n) if self.word[j] == "@end"), self.n - 1)
                if self.w(i + 2) != ";":
                    self.add("class" if w == "@interface" else "interface", i + 1, i, last)
            inside = True if w == "@implementation" else False if w == "@end" else inside
            if inside and w in ("-", "+") and self.w(i + 1) == "(" and self.parent[i] < 0 and self.is_name(self.close(i + 1) + 1):
                b = self.brace(self.close(i + 1) + 1)
                if b >= 0:
                    self.add("method", self.close(i + 1) + 1, i, self.close(b), -1, b)

    def _until_end(self, openers: frozenset, begins: frozenset) -> dict[int, int]:
        """Where each word that opens a block meets its end."""
        stack, out, loop = [], {}, -1
        for i, w in enumerate(self.word):
            if self.kind[i] != "name" or self.w(i - 1) in (".", "::", "&."):
                continue
            fresh = i == 0 or self.line(i - 1) < self.line(i) or self.w(i - 1) in ("=", "(", ";", "then", "do", "else", "return", "[", "{", ",")
            if w in openers and (w not in begins or fresh) and not (w == "do" and loop == self.line(i)):
                stack.append(i)
                if w in ("while", "until", "for"):
                    loop = self.line(i)
            elif w == "end" and stack:
                out[stack.pop()] = i
        for s in stack:
            out[s] = self.n - 1
        return out

    def _ruby(self) -> None:
        ends = self._until_end(frozenset("def class module begin case if unless while until for do".split()), frozenset("if unless while until".split()))
        for i, last in ends.items():
            k = i + 1
            if self.w(i) == "def":
                if self.w(k + 1) == "." and self.is_name(k + 2):
                    k += 2
                if self.w(k + 1) == "=" and self.at[k + 1] == self.end(k) and self.w(k + 2) == "(":
                    self.word[k] += "="
                if self.is_name(k):
                    if self.w(k + 1) == "=" or self.w(k + 1) == "(" and self.w(self.close(k + 1) + 1) == "=":
                        last = self._end_of_line(i)
                    self.add("method", k, i, last)
            elif self.w(i) in ("class", "module") and self.is_name(k):
                while self.w(k + 1) == "::" and self.is_name(k + 2):
                    k += 2
                self.add("class", k, i, last)

    def _lua(self) -> None:
        for i, last in self._until_end(frozenset("function if do repeat for while".split()) - {"for", "while", "repeat"}, frozenset()).items():
            if self.w(i) == "function" and self.is_name(i + 1):
                k = i + 1
                while self.w(k + 1) in (".", ":") and self.is_name(k + 2):
                    k += 2
                if self.w(k + 1) == "(":
                    self.add("method" if k > i + 1 else "function", k, i - 1 if self.w(i - 1) == "local" else i, last, k + 1)

    def _python(self) -> None:
        """Definitions by indentation, for texts that do not parse."""
        for i in range(self.n):
            if self.word[i] not in ("def", "class") or not self.is_name(i + 1) or i and self.line(i - 1) == self.line(i) and self.w(i - 1) not in ("async", ":"):
                continue
            column = self.at[i] - (self.text.rfind("\n", 0, self.at[i]) + 1)
            p = i + 2 if self.w(i + 2) == "(" else -1
            j = self.close(p) + 1 if p >= 0 else i + 2
            while j < self.n and not (self.line(j) > self.line(j - 1) and self.at[j] - (self.text.rfind("\n", 0, self.at[j]) + 1) <= column):
                j = max(j + 1, min(self.close(j), self.n)) if self.word[j] in _SHUT else j + 1
            outer = [s for s in self.symbols if s["start"] < self.at[i] < s["end"]]
            kind = "class" if self.word[i] == "class" else "method" if outer and outer[-1]["kind"] == "class" else "function"
            self.add(kind, i + 1, i, j - 1, p if self.word[i] == "def" else -1)

    # ---- calls ----

    def owner(self, at: int) -> str:
        """The outermost symbol around a place: the first in order that holds it."""
        if self.roots is None:
            self.roots, reach = [], -1
            for s in sorted(self.symbols, key=lambda s: (s["start"], -s["end"])):
                if s["end"] > reach:
                    self.roots.append((s["start"], s["end"], s["name"]))
                    reach = s["end"]
        k = bisect_right(self.roots, (at, float("inf"))) - 1
        return self.roots[k][2] if k >= 0 and at < self.roots[k][1] else ""

    def apart(self, a: int, b: int, mark: str) -> list[int]:
        """Where a mark stands between two tokens, not within brackets there."""
        out, j = [], a + 1
        while j < b:
            if self.word[j] == mark and self.kind[j] == "op":
                out.append(j)
            j = self.close(j) + 1 if self.kind[j] == "op" and self.word[j] in _SHUT else j + 1
        return out

    def find_calls(self) -> list[tuple[str, str, int]]:
        out: list[tuple[str, str, int]] = []
        lang = self.language
        through_point = lang in ("python", "javascript", "typescript", "tsx", "go", "java", "ruby", "lua")
        functions = sorted((s["start"], s["end"]) for s in self.symbols if s["kind"] in ("function", "method"))
        functions = sorted([*functions, *self.spans])
        for i in range(self.n):
            if self.kind[i] != "name" or i in self.named or self.word[i][0] in "@#":
                continue
            before, w = self.w(i - 1), self.word[i]
            pointed = before in (".", "?.", "->", "&.") or before == ":" and lang == "lua"
            if lang == "ruby":
                called = pointed and before != "->" or self.w(i + 1) == "(" and self.at[i + 1] == self.end(i) or self._ruby_command(i)
            elif lang == "lua":
                called = self.w(i + 1) in ("(", "{") or i + 1 < self.n and self.kind[i + 1] == "text"
            else:
                called = self.w(i + 1) == "("
            if called and w in self.words and not (pointed and through_point):
                called = False
            if not called and not (lang == "objc" and self._message(i)):
                continue
            if pointed and not through_point or before in ("function", "func", "fn", "fun", "def", "new", "@", "class", "struct", "~"):
                continue
            if lang == "java" and self._created(i) or lang in ("typescript", "tsx") and self.body.get(self.parent[i]) == "interface":
                continue
            if lang in ("c", "cpp", "objc") and not self._within(functions, self.at[i]):
                continue
            if lang in ("c", "cpp") and self.is_name(i - 1) and before not in self.words and self.line(i - 1) == self.line(i):
                continue  # a declaration
            out.append((self.owner(self.at[i]), w, self.line(i)))
        return out

    @staticmethod
    def _within(spans: list[tuple[int, int]], at: int) -> bool:
        k = bisect_right(spans, (at, float("inf"))) - 1
        return k >= 0 and at < spans[k][1]

    def _created(self, i: int) -> bool:
        while self.w(i - 1) == "." and self.is_name(i - 2):
            i -= 2
        return self.w(i - 1) == "new"

    def _message(self, i: int) -> bool:
        if self.w(i + 1) == "]" and self.w(i - 1) not in ("[", ",", ":") and not self.w(i - 1) in ("+", "-", "*", "="):
            return True
        return self.w(i + 1) == ":" and self.w(i - 1) not in ("?", "case", "{", ";", "@", "[") and any(self.word[j] == "[" and self.close(j) > i for j in range(max(0, i - 12), i)) and self.w(i - 1) != "["

    def _ruby_command(self, i: int) -> bool:
        if i + 1 >= self.n or self.line(i + 1) != self.line(i) or self.word[i] in self.words or self.w(i - 1) in ("def", "class", "module", ":", "alias"):
            return False
        fresh = i == 0 or self.line(i - 1) < self.line(i) or self.w(i - 1) in (";", "then", "do", "=", "return", "|", "{")
        follows = self.kind[i + 1] in ("text", "number") or self.is_name(i + 1) and self.w(i + 1) not in ("if", "unless", "while", "until", "and", "or", "do", "rescue", "then", "in", "end")
        return fresh and follows and self.end(i) < self.at[i + 1]

    # ---- control flow ----

    def find_flow(self) -> list[tuple[str, str, str | None, int, int]]:
        """(symbol, kind, condition, line, depth) of branches, loops and returns, for the C family and JavaScript."""
        if self.language not in ("javascript", "c", "cpp"):
            return []
        self.flow: list[tuple[int, str, str | None, int]] = []
        i = 0
        while i < self.n:
            i = self._statement(i, 0)
        outer = {s["start"] for s in self.symbols}
        rows = []
        for i, kind, test, depth in self.flow:
            rows.append((self.owner(self.at[i]), kind, test, self.line(i), depth))
        return sorted(rows, key=lambda r: r[3]) if outer or rows else rows

    def _note(self, i: int, kind: str, depth: int, test: int = -1) -> None:
        text = None
        if test >= 0 and self.w(test) == "(":
            text = self.text[self.at[test] + 1 : self.at[self.close(test)] if self.close(test) < self.n else len(self.text)][:CONDITION_MOST]
        self.flow.append((i, kind, text, depth))

    def _block(self, i: int, depth: int) -> int:
        last = min(self.close(i), self.n)
        j = i + 1
        while j < last:
            j = self._statement(j, depth)
        return last + 1

    def _statement(self, i: int, depth: int) -> int:
        """Notes one statement and what lies in it; what follows it."""
        w = self.w(i) if self.is_name(i) else ""
        if self.w(i) == "{":
            return self._block(i, depth)
        if w in ("if", "while", "for", "switch", "catch"):
            p = i + 1
            while p < self.n and self.w(p) != "(" and self.w(p) not in (";", "{", "}"):
                p += 1
            after = self.close(p) + 1 if self.w(p) == "(" else p
            if w == "switch":
                return self._cases(after, depth) if self.w(after) == "{" else after
            if w == "catch":
                self._note(i, "try_catch", depth)
            elif w == "if":
                self._note(i, "if_branch", depth, p)
            else:
                self._note(i, "loop", depth, p if w == "while" else -1)
                if w == "for" and self.w(p) == "(" and ";" in self.word[p : self.close(p)]:
                    parts = self.apart(p, self.close(p), ";")
                    if len(parts) == 2 and parts[1] > parts[0] + 1:
                        row = self.flow.pop()
                        test = self.text[self.at[parts[0] + 1] : self.at[parts[1]]].rstrip()
                        self.flow.append((row[0], row[1], test[:CONDITION_MOST], row[3]))
            after = self._statement(after, depth + 1) if after < self.n and after > i else after
            if w == "if" and self.w(after) == "else":
                self._note(after, "else_branch", depth)
                after = self._statement(after + 1, depth + 2)
            return max(after, i + 1)
        if w == "do":
            self._note(i, "loop", depth)
            after = self._statement(i + 1, depth + 1)
            if self.w(after) == "while":
                if self.w(after + 1) == "(":
                    row = self.flow[next(k for k in range(len(self.flow) - 1, -1, -1) if self.flow[k][0] == i)]
                    self.flow[self.flow.index(row)] = (row[0], row[1], self.text[self.at[after + 1] + 1 : self.at[min(self.close(after + 1), self.n - 1)]][:CONDITION_MOST], row[3])
                after = self.close(after + 1) + 1
            return max(after, i + 1)
        if w == "try":
            self._note(i, "try_catch", depth)
            after = self._statement(i + 1, depth + 1)
            while self.w(after) in ("catch", "finally"):
                after = self._statement(after, depth + 1) if self.w(after) == "catch" else self._statement(after + 1, depth + 1)
            return max(after, i + 1)
        if w == "return":
            self._note(i, "early_return", depth)
        # an expression or declaration: what stands in its braces is looked into
        j = i
        line = self.line(i)
        while j < self.n:
            t = self.word[j]
            if t == "{":
                j = self._block(j, depth)
                if self.w(j) not in (";", ",", ")", ".", "=", "(", "["):
                    return j
                continue
            if t in "([" and self.kind[j] == "op":
                inner = j + 1
                last = min(self.close(j), self.n)
                while inner < last:
                    if self.word[inner] == "{":
                        inner = self._block(inner, depth)
                    else:
                        inner += 1
                j = last + 1
                continue
            if t == ";" or t == "}":
                return j + 1
            j += 1
            if w == "return" and j < self.n and self.line(j) > line and self.language == "javascript" and self.is_name(j):
                return j
            if j < self.n and self.is_name(j) and self.w(j) in ("if", "for", "while", "do", "switch", "try", "return") and self.w(j - 1) not in (".", "?.", "{", ",") and self.w(j + 1) != ":":
                return j
        return self.n

    def _cases(self, i: int, depth: int) -> int:
        last = min(self.close(i), self.n)
        j, inside = i + 1, 0
        while j < last:
            w = self.w(j)
            if w in ("case", "default") and self.is_name(j) and (w == "case" or self.w(j + 1) == ":"):
                colon = next(iter(self.apart(j, last, ":")), last)
                if w == "case" or self.language != "javascript":
                    test = self.text[self.at[j + 1] : self.at[colon]].strip()[:CONDITION_MOST] if w == "case" and colon < self.n else None
                    self.flow.append((j, "switch_case", test, depth))
                    inside = 1
                else:
                    inside = 0
                j = colon + 1
            else:
                j = self._statement(j, depth + inside)
        return last + 1

    # ---- data flow ----

    def find_data(self) -> list[tuple[str, str, str, str | None, int]]:
        """(symbol, kind, left, right, line) of assignments, bare parameters and returned values within symbols."""
        if self.language not in ("javascript", "c", "cpp"):
            return []
        rows = []

        def note(i: int, kind: str, left: str, right: str | None) -> None:
            who = self.owner(self.at[i])
            if who:
                rows.append((who, kind, left, None if right is None else re.sub(r"[\r\n]", " ", right)[:RIGHT_MOST], self.line(i)))

        found = self._parameters()
        self._sorted = sorted(self.lists)
        for i in range(self.n):
            w = self.word[i]
            if w == "=" and self.is_name(i - 1) and self.w(i - 2) not in (".", "->", "?.", "::"):
                stop = self._value_end(i + 1)
                declared = self.is_name(i - 2) or self.w(i - 2) in ("*", "&", ">", ",")
                simple = self.w(i - 2) in (";", "{", "}", ")", "(", ":", "else", "do", "") or self.w(i - 2) in ("=",) or self.kind[i - 2] == "op"
                if stop > i + 1 and (declared or simple) and not self._in_params(i):
                    if self.w(i - 2) in ("*", "&") and self.language != "javascript":
                        continue  # only plain names are followed
                    note(i - 1, "assignment", self.word[i - 1], self.slice(i + 1, stop - 1))
            elif w == "return" and self.kind[i] == "name" and self.w(i - 1) != ".":
                stop = self._value_end(i + 1)
                if stop > i + 1:
                    note(i, "return_value", "return", self.slice(i + 1, stop - 1))
        for _, name in found:
            note(name, "parameter", self.word[name], None)
        return sorted(rows, key=lambda r: r[4])

    def _value_end(self, i: int) -> int:
        start = i
        while i < self.n:
            w = self.word[i]
            if w in (";", ",", ")", "]", "}"):
                break
            if self.language == "javascript" and i > start and self.line(i) > self.line(i - 1) and (self.is_name(i) or self.kind[i] in ("text", "number")) and (self.kind[i - 1] != "op" or self.w(i - 1) in (")", "]", "}")):
                break
            i = self.close(i) + 1 if w in _SHUT else i + 1
        return min(i, self.n)

    def _in_params(self, i: int) -> bool:
        k = bisect_right(self._sorted, (i, -1)) - 1
        return k >= 0 and self._sorted[k][0] < i < self._sorted[k][1]

    def _parameters(self) -> list[tuple[int, int]]:
        if self.language == "javascript":
            known = set(self.lists)
            self.lists += [(o, c) for o, c in self.partner.items() if self.word[o] == "(" and (self.w(c + 1) == "=>" or self.w(o - 1) == "function" or self.w(o - 2) == "function") and (o, c) not in known]
        out = []
        for a, b in self.lists:
            start = a + 1
            for j in [*self.apart(a, b, ","), b]:
                part = list(range(start, min(j, self.n)))
                start = j + 1
                if self.language == "javascript":
                    if len(part) == 1 and self.is_name(part[0]):
                        out.append((a, part[0]))
                elif len(part) >= 2 and self.is_name(part[-1]) and not any(self.word[k] in ("=", "(", "[") for k in part):
                    stars = sum(self.word[k] in ("*", "&") for k in part)
                    if stars <= 1 and (self.w(part[-2]) != "&" or self.language == "cpp") and self.is_name(part[0]):
                        out.append((a, part[-1]))
        return out


def outline(text: str, language: str, members: bool = False) -> dict:
    """{symbols, calls, cfg, dfg} of a text in one of the languages of this module."""
    o = Outline(text, language, members)
    symbols = o.find_symbols()
    return {"symbols": symbols, "calls": o.find_calls(), "cfg": o.find_flow(), "dfg": o.find_data(), "error": None}


LANGUAGES = frozenset(_TOKENS)
