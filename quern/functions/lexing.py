"""Lexers of eight languages: texts to strings of token classes, one character a token.

Each token is found by one pattern that skips blanks and comments, in one call for a whole text, and its class is
looked up by its text. What a language derives from ends of lines and from the preprocessor is settled on the string
of classes: ends of lines are dropped where they mean nothing, become semicolons, or carry the column of the next line.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Language by the extension of a path.
LANGUAGE_OF = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby"}
#: Character of the end of a line before which the next line starts at column 0, for languages with layout.
COLUMN, MOST_COLUMNS = 0xE000, 4000
#: Lexical classes that are no token of the language itself.
CLASSES = ("NAME", "NUM", "STR", "NL", "BAD", "INDENT", "DEDENT", "MACRO", "LABEL", "DEF", "EDEF", "SYM", "HIF", "HIFCPP", "HELSE", "HEND", "TPL", "NEVER")

_BLANK = r"[ \t\r\f\v﻿\xa0]+|\\\r?\n"
_NAME = r"[^\W\d]\w*"
_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_NUM = r"\.?\d(?:[eEpP][+-]|[\w.])*"
_JS_NUM = r"\.?\d(?:[eE][+-]|[\w]|\.(?!\.))*"


def _nested(level: int) -> str:
    """Code within braces of a string, with strings and braces in it, to a depth."""
    if level == 0:
        return r"[^{}`]"
    return rf"(?>[^{{}}`\"'/]|/|{_DQ}|{_SQ}|[\"']|\{{(?:{_nested(level - 1)})*+\}}|{_template(level - 1)})"


def _template(level: int) -> str:
    return rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{(?:{_nested(level)})*+\}})*+`"


_TEMPLATE = _template(2)
_RUBY_IN = r"(?:[^{}\"]|\"(?:[^\"\\]|\\[\s\S])*\"|\{(?:[^{}]|\{[^{}]*\})*\})*"
_RUBY_DQ = rf'"(?:[^"\\#]|\\[\s\S]|#(?!\{{)|#\{{{_RUBY_IN}\}})*"'
_REGEX = r"/(?![/*])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_RUBY_REGEX = r"/(?! )(?:[^/\\\n]|\\[^\n])+/[a-z]*"


def _ops(tokens: str) -> str:
    return "|".join(re.escape(t) for t in sorted(tokens.split(), key=len, reverse=True))


_C_OPS = "<<= >= <= == != << ... -> ++ -- && || += -= *= /= %= &= |= ^= + - * / % & | ^ < > = ! ~ ? : ; , . ( ) { } [ ]"
OPS = {
    "python": "**= //= <<= >>= ... -> := ** // << >> += -= *= /= %= &= |= ^= @= == != <= >= + - * / % & | ^ < > = ~ : ; , . ( ) { } [ ] @",
    "javascript": "=== !== **= <<= &&= ||= ??= ... => ** ++ -- && || ?? ?. += -= *= /= %= &= |= ^= << <= >= == != + - * / % & | ^ < > = ! ~ ? : ; , . ( ) { } [ ] @",
    "go": "&^= <<= >>= ... &^ := <- ++ -- && || += -= *= /= %= &= |= ^= << >> == != <= >= + - * / % & | ^ < > = ! ~ : ; , . ( ) { } [ ]",
    "java": _C_OPS + " :: @",
    "c": _C_OPS,
    "cpp": _C_OPS + " :: ->* .* <=>",
    "ruby": "**= ||= &&= <=> === ... .. <<= >>= => -> ** && || &. :: += -= *= /= %= |= &= ^= << >> =~ !~ == != <= >= + - * / % & | ^ < > = ! ~ ? : ; , . ( ) { } [ ]",
}
OPS["typescript"] = OPS["javascript"]

WORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
    "javascript": "await async break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new null of return set static using super switch this throw true false try typeof var void while with yield as",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record yield sealed permits when non module",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Noreturn _Static_assert _Atomic _Generic _Alignof _Alignas _Thread_local __attribute__ __extension__ __asm__ asm __restrict __inline __inline__ __const __signed__ __volatile__ __attribute __asm __restrict__ __typeof__ typeof",
    "ruby": "alias and begin case class defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield break BEGIN END def __FILE__ __LINE__ __method__",
}
WORDS["typescript"] = WORDS["javascript"] + " abstract any asserts boolean declare enum implements infer interface is keyof module namespace never number object out override private protected public readonly require satisfies string symbol type unique unknown global accessor undefined bigint"
WORDS["cpp"] = WORDS["c"].replace("restrict ", "", 1) + " alignas alignof bool catch char8_t char16_t char32_t class concept consteval constexpr constinit const_cast co_await co_return co_yield decltype delete dynamic_cast explicit export false friend mutable namespace new noexcept nullptr operator override final private protected public reinterpret_cast requires static_assert static_cast template this thread_local throw true try typeid typename using virtual wchar_t and or not import module"

_PY_IN = r"(?:[^{}\"'\n]|\{[^{}]*\}|\"[^\"\n]*\"|'[^'\n]*')*"
_STRINGS = {
    "python": rf"(?:[rRuUbBfF]{{0,2}})(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!\'\'))*''')|(?:[fF][rR]?|[rR][fF])(?:\"(?:[^\"\\\n{{]|\\[\s\S]|\{{\{{|\{{{_PY_IN}\}})*\"|'(?:[^'\\\n{{]|\\[\s\S]|\{{\{{|\{{{_PY_IN}\}})*')|(?:[rRuUbBfF]{{0,2}})(?:(?!\"\"\"){_DQ}|(?!\'\'\'){_SQ})",
    "go": rf"{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)'",
    "java": rf"\"\"\"[\s\S]*?\"\"\"|{_DQ}|'(?:[^'\\\n]|\\[^\n]+?)'",
    "javascript": rf"{_DQ}|{_SQ}|{_TEMPLATE}",
    "c": rf"(?:u8|[LuU])?(?:{_DQ}|'(?:[^'\\\n]|\\[^\n])+')",
    "cpp": rf"(?:u8|[LuU])?R\"(\w*)\([\s\S]*?\)\2\"\w*|(?:u8|[LuU])?(?:{_DQ}|'(?:[^'\\\n]|\\[^\n])+')\w*",
    "ruby": rf"{_RUBY_DQ}:?(?!:)|{_RUBY_DQ}|{_SQ}:?(?!:)|{_SQ}|`(?:[^`\\]|\\[\s\S])*`|%[qQwWiIrsx]?(?:\((?:[^()]|\([^()]*\))*\)|\[(?:[^\[\]]|\[[^\[\]]*\])*\]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}|<[^>\n]*>|[|!/](?:[^|!/\n])*[|!/])[a-z]*|:{_RUBY_DQ}|\?[^\W\d_](?!\w)",
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_DIRECTIVE = r"\#(?:[^\n\\/]|\\\r?\n|\\[^\n]|/\*[\s\S]*?\*/|//[^\n]*|/)*"
_RUBY_SYMBOL = r":(?:[^\W\d]\w*[?!=]?(?![\w=])|[^\W\d]\w*[?!]?|\[\]=?|<=>|===?|=~|\*\*|[-+]@|<<|>>|<=|>=|!=|[-+*/%<>!&|^~])"
_RUBY_DEF = r"def[ \t]+(?:(?:self|[^\W\d]\w*)\.)?(?:[^\W\d]\w*(?:[?!]|=(?=[ \t]*\(|[ \t]*\w)(?![=~>]))?|\[\]=?|<=>|===?|=~|!=|!~|\*\*|[-+~!]@|<<|>>|<=|>=|[-+*/%<>!&|^~`])"
_NAMES = {
    "python": _NAME,
    "javascript": r"#?(?:[^\W\d]|\$|\\u[\da-fA-F]{4})[\w$‌‍]*",
    "go": _NAME,
    "java": r"[^\W\d][\w$]*|\$[\w$]*",
    "c": r"(?:[^\W\d]|\$)[\w$]*",
    "cpp": r"(?:[^\W\d]|\$)[\w$]*",
    "ruby": r"[^\W\d]\w*[?!]?:(?![:=])(?=[\s\S])|(?:@@?|\$)[^\W\d]\w*|\$(?:[!@&~0-9/\;,.<>_*$?:\"]|-\w)|[^\W\d]\w*[?!](?![=~])|[^\W\d]\w*",
}
_NAMES["typescript"] = _NAMES["javascript"]


def _pattern(lang: str) -> re.Pattern:
    comment = {"python": r"#[^\n]*", "ruby": r"#[^\n]*"}.get(lang, _C_COMMENT)
    skip = f"{_BLANK}|{comment}"
    parts = []
    if lang in ("c", "cpp", "java"):
        skip += r"|\n"
    if lang in ("c", "cpp"):
        parts.append(_DIRECTIVE)
    if lang == "python":
        parts.append(r"\n(?:[ \t\r\f]*(?:#[^\n]*)?\n)*[ \t\f]*")
    elif lang == "ruby":
        skip += r"|(?<=\n)=begin\b[\s\S]*?\n=end[^\n]*"
        parts.append(rf"\n(?:[ \t\r\f\n]|\#[^\n]*|(?<=\n)=begin\b[\s\S]*?\n=end[^\n]*)*+(?:(?<=\n)__END__[\s\S]*)?")
    elif lang in ("go", "javascript", "typescript"):
        parts.append(rf"\n(?:{_BLANK}|\n|{comment})*+")
    if lang in ("javascript", "typescript"):
        parts.append(rf"\A\#![^\n]*|(?:{_ops(OPS[lang].replace(') ', '').replace('} ', '').replace('] ', '').replace('++ -- ', '').replace(' .', ''))}|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|yield|await))(?:{skip}|\n)*+{_REGEX}")
        parts.append(rf"(?:(?<=\))|(?<=\n)|(?<=[;}}]))[ \t]*{_REGEX}(?=[ \t]*(?:\.(?:test|exec|source|match|replace|\[)|[,;)]))")
    if lang == "ruby":
        parts.append(_RUBY_DEF)
        parts.append(rf"(?:{_ops(OPS[lang].replace(') ', '').replace('} ', '').replace('] ', ''))}|\b(?:return|when|if|unless|and|or|not|while|until|then|elsif|in|puts|split|gsub|gsub!|sub|match|scan|match\?|assert_match|grep|yield)\b)(?:[ \t]*)(?:{_RUBY_REGEX})")
    parts.append(_STRINGS[lang])
    if lang == "ruby":
        parts.append(_RUBY_SYMBOL)
    parts.append({"javascript": _JS_NUM, "typescript": _JS_NUM, "ruby": r"\d(?:[eE][+-]?\d|[\w]|\.\d)*", "cpp": r"\.?\d(?:[eEpP][+-]|'\w|[\w.])*"}.get(lang, _NUM))
    parts += [_NAMES[lang], _ops(OPS[lang]), r"[\s\S]", r"\Z"]
    return re.compile(f"(?:{skip})*+({'|'.join(parts)})")


_GOOD_NUMBER = {
    "python": re.compile(r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?(?<!\d)|\d(?:_?\d)*\.(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*|\d(?:_?\d)*(?=[jJ]))[jJ]?"),
    "javascript": re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*)n?|(?:\d[\d_]*\.?[\d_]*|\.[\d_]+)(?:[eE][+-]?\d[\d_]*)?"),
    "go": re.compile(r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.[\d_]+)(?:[eE][+-]?\d[\d_]*)?)i?"),
    "java": re.compile(r"(?:0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.[\d_]+)(?:[eE][+-]?\d[\d_]*)?)[lLfFdD]?"),
    "c": re.compile(r"(?:0[xX][\da-fA-F]*\.?[\da-fA-F]*(?:[pP][+-]?\d+)?|0[bB][01]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]{0,3}|[fFdD]\d+x?|[iIjJ])"),
    "cpp": re.compile(r"(?:0[xX][\da-fA-F']*\.?[\da-fA-F]*(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d+)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]{0,3}|_\w+|[a-z]{1,3})"),
    "ruby": re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)[ri]?"),
}
_GOOD_NUMBER["typescript"] = _GOOD_NUMBER["javascript"]
_HEREDOC = re.compile(r"<<[~-]?(['\"`]?)([A-Za-z_]\w*)\1(?!\w)")
_KNOWN_DIRECTIVE = re.compile(r"#[ \t]*(?:include(?:_next)?[ \t]*(?:<[^>\n]+>|\"[^\"\n]+\"|\w)|(?:define|undef)[ \t]+\w|import\b|(?:pragma|error|warning|line|ident|assert)\b|\d+[ \t]+\"|\Z|[\r\n/])")


def without_heredocs(text: str) -> str:
    """A Ruby text with an empty string in place of each here-document whose end is found below it."""
    lines = text.split("\n")
    last = {line.strip(): i for i, line in enumerate(lines)}
    out, waiting = [], []
    for i, line in enumerate(lines):
        if waiting:
            if line.strip() == waiting[0]:
                waiting.pop(0)
            continue

        def opened(m: re.Match) -> str:
            if last.get(m[2], -1) <= i:
                return m[0]
            waiting.append(m[2])
            return '""'

        out.append(_HEREDOC.sub(opened, line) if "<<" in line else line)
    return "\n".join(out)


class _Classes(dict):
    """Classes of a token by its text; strings and comments are not kept."""

    def __init__(self, lang: str, char: dict[str, str]):
        super().__init__()
        self.lang, self.char = lang, char
        self.fixed = {t: char[t] for t in [*OPS[lang].split(), *WORDS[lang].split()] if t in char}
        self.tokens = frozenset(OPS[lang].split())
        self.update(self.fixed)
        self[""] = ""

    def __missing__(self, t: str) -> str:
        lang, char = self.lang, self.char
        c = t[0]
        if t in self.tokens:
            return char["BAD"]  # a token no production of the language has
        if c == "\n":
            if lang == "python":
                got = chr(COLUMN + min(len(t[t.rfind("\n") + 1 :].expandtabs(8)), MOST_COLUMNS))
            else:
                got = char["NL"]
            return got
        if lang in ("c", "cpp") and c == "#":
            m = re.match(r"#[ \t]*(ifdef|ifndef|if|elifdef|elifndef|elif|else|endif)\b[ \t]*(.*)", t, re.S)
            if m:
                word, rest = m.groups()
                if word == "endif":
                    return char["HEND"]
                if word in ("else", "elif", "elifdef", "elifndef"):
                    return char["HELSE"]
                plus = "__cplusplus" in rest and "!" not in rest
                if word == "if" and re.match(r"0\s*(?:/|\Z)", rest):
                    return char["HIFCPP"] if lang == "c" else char["HIF"] + char["HELSE"]
                if plus and word == "ifndef":
                    return char["HIF"] if lang == "c" else char["HIFCPP"]
                return char["HIFCPP"] if plus and lang == "c" else char["HIF"]
            return "" if _KNOWN_DIRECTIVE.match(t) else char["BAD"]
        if lang == "ruby" and t.startswith("def") and len(t) > 3 and t[3] in " \t":
            return char["DEF"]
        if c == "#" and t[:2] == "#!":
            return ""
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            got = char["NUM"] if _GOOD_NUMBER[lang].fullmatch(t) else char["BAD"]
            self[t] = got
            return got
        if lang == "ruby":
            if t[-1] == ":" and len(t) > 1 and (c.isalpha() or c == "_" or c in "\"'"):
                return char["LABEL"]
            if c == ":" and len(t) > 1 and t != "::":
                return char["STR"] if t[1] in "\"'" else char["SYM"]
            if c in "\"'`%?" and len(t) > 1:
                return char["STR"]
        elif len(t) > 1 and (c in "\"'`" or (t[-1] in "\"'`" and (c.isalpha()))) or (lang == "cpp" and '"' in t):
            return char["TPL" if c == "`" and lang in ("javascript", "typescript") else "STR"]
        if (c.isalpha() or c in "_$@#\\") and t not in ("@", "#", "\\") and not re.search(r"\s|/", t):
            if len(self) > 100_000:
                self.clear()
                self.update(self.fixed)
                self[""] = ""
            got = char["NAME"]
            if lang in ("c", "cpp") and (re.fullmatch(r"[A-Z_][A-Z0-9_]+|__\w+|[A-Z]\w*_[A-Z][A-Z0-9_]+|PRI\w+|\w*(?:for_?each|FOR_?EACH|foreach)\w*", t)):
                got = char["MACRO"]
            self[t] = got
            return got
        if "/" in t and len(t) > 2:
            m = re.match(r"[a-z?!]+|[^\w\s/]+|", t)  # a token before a regular expression
            head = m.group()
            if t.lstrip().startswith("/"):
                return char["STR"]
            if head in self.fixed:
                return self.fixed[head] + char["STR"]
            if lang == "ruby" and head and (head[0].isalpha()):
                return char["NAME"] + char["STR"]
            head = t[: len(head)]
            for n in range(len(head), 0, -1):
                if head[:n] in self.fixed:
                    return self.fixed[head[:n]] + char["STR"]
        return char["BAD"]


class Lexer:
    """Texts of one language to strings of classes, given the characters of a grammar."""

    def __init__(self, lang: str, char: dict[str, str]):
        self.lang, self.char = lang, char
        self.pattern = _pattern(lang)
        self.classes = _Classes(lang, char)
        self.settle: Callable[[str], str] = getattr(self, f"_{lang}", lambda s: s)
        one = lambda *ts: "".join(char[t] for t in ts if t in char)
        words = [w for w in WORDS[lang].split()]
        self._round, self._close = one("(", "["), one(")", "]")
        self._curly, self._uncurly = one("{"), one("}")
        nl = char["NL"]
        if lang == "python":
            self._breaks = re.compile(f"[{one('(', '[', '{', ')', ']', '}')}{chr(COLUMN)}-{chr(COLUMN + MOST_COLUMNS)}]")
        if lang == "go":
            ends = one("NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")
            self._keep, self._semi = re.compile(f"(?<![{ends}]){nl}"), one(";")
        if lang in ("javascript", "typescript"):
            ends = one("NAME", "NUM", "STR", "TPL", ")", "]", "}", "++", "--", *[w for w in words if w not in ("case", "catch", "const", "delete", "do", "else", "extends", "if", "in", "instanceof", "new", "switch", "throw", "try", "typeof", "var", "void", "while", "with", "finally", "for", "function", "implements", "keyof", "infer", "class", "export", "import")]) + (one("!") if lang == "typescript" else "") + one(">", "?", "void") * (lang == "typescript")
            starts = one("NAME", "NUM", "STR", "TPL", "{", "++", "--", "!", "~", "@", "...", *(("(", "[", "<") if lang == "typescript" else ()), *[w for w in words if w not in ("in", "instanceof", "catch", "finally", "extends", "implements", "of")])
            self._keep = re.compile(f"(?<![{ends}]){nl}|{nl}(?![{starts}])")
        if lang == "ruby":
            ends = one("NAME", "NUM", "STR", "SYM", "LABEL", "DEF", ")", "]", "}", "|", *[w for w in words if w not in ("and", "or", "not")]) + one("..", "...")
            self._keep = re.compile(f"(?<![{ends}{one(';')}]){nl}|{nl}(?=[{one('&.', ')', ']', '.')}])|{nl}(?={one('..')}(?!.))|(?<=[{one('and', 'or', 'not')}]){nl}")
            self._dotted = re.compile(f"(?<=[{one('.', '&.')}])[{one(*words)}]")
        if lang in ("javascript", "typescript", "ruby"):
            self._breaks = re.compile(f"[{self._round}{self._close}{self._curly}{self._uncurly}{nl}]")
        if lang in ("c", "cpp"):
            h, hc, e, x = one("HIF"), one("HIFCPP"), one("HELSE"), one("HEND")
            self._branch = re.compile(f"{h}([^{h}{hc}{e}{x}]*)(?:{e}[^{h}{hc}{e}{x}]*)*{x}|{hc}[^{h}{hc}{e}{x}]*(?:{e}([^{h}{hc}{e}{x}]*))?(?:{e}[^{h}{hc}{e}{x}]*)*{x}")
            self._has_branch = re.compile(f"[{h}{hc}{e}{x}]")

    def __call__(self, text: str) -> str:
        """Classes of the tokens of a text."""
        if self.lang == "python":
            text = "\n" + text
        elif self.lang == "ruby":
            text = "\n" + text
            if "<<" in text:
                text = without_heredocs(text)
        found = self.pattern.findall(text)
        if self.lang == "cpp":
            found = [t for t, _ in found]
        return self.settle("".join(map(self.classes.__getitem__, found)))

    def _python(self, s: str) -> str:
        """Without the ends of lines between brackets."""
        out, at, depth = [], 0, 0
        opens = self._round + self._curly
        for m in self._breaks.finditer(s):
            c = m.group()
            if c >= chr(COLUMN):
                if depth > 0:
                    out.append(s[at : m.start()])
                    at = m.end()
            elif c in opens:
                depth += 1
            else:
                depth -= 1
        return "".join([*out, s[at:]])

    def _go(self, s: str) -> str:
        s = self._keep.sub("", s).replace(self.char["NL"], self._semi)
        return s if s.endswith(self._semi) or not s else s + self._semi

    def _outside(self, s: str) -> str:
        """Without the ends of lines whose innermost bracket is a round or square one."""
        nl = self.char["NL"]
        out, at, stack = [], 0, []
        for m in self._breaks.finditer(s):
            c = m.group()
            if c == nl:
                if stack and stack[-1] in self._round:
                    out.append(s[at : m.start()])
                    at = m.end()
            elif c in self._round or c in self._curly:
                stack.append(c)
            elif stack:
                stack.pop()
        return "".join([*out, s[at:]])

    def _javascript(self, s: str) -> str:
        return self._outside(self._keep.sub("", s)).strip(self.char["NL"])

    _typescript = _javascript

    def _c(self, s: str) -> str:
        """Without all but one branch of each conditional of the preprocessor; what has no partner stays."""
        if self._has_branch.search(s):
            n = 1
            while n:
                s, n = self._branch.subn(lambda m: (m.group(1) or "") + (m.group(2) or ""), s)
        return s

    _cpp = _c

    def _ruby(self, s: str) -> str:
        c = self.char
        nl = c["NL"]
        s = self._keep.sub("", s)
        # what follows a point is a name
        s = self._dotted.sub(c["NAME"], s)
        # a word that opens a block where a statement or operand may start, and is a modifier elsewhere
        before = "".join(c[t] for t in ["NUM", "STR", "SYM", "NAME", ")", "]", "}", "end", "self", "nil", "true", "false", "super", "yield", "break", "next", "redo", "retry", "return", "__FILE__", "__method__", "REGEX"] if t in c)
        for word in ("if", "unless", "while", "until", "rescue"):
            s = re.sub(f"(?<=[{before}]){c[word]}", c[word + "_mod"], s)
        # the do of a loop opens nothing
        s = re.sub(f"([{c['while']}{c['until']}{c['for']}][^{nl}{c[';']}{c['do']}]*){c['do']}", rf"\1{c['then']}", s)
        # a definition without an end
        s = re.sub(f"{c['DEF']}(?=(?:\\{c['(']}[^{c['(']}{c[')']}]*{c[')']})?{c['=']})", c["EDEF"], s)
        return self._outside_ruby(s)

    def _outside_ruby(self, s: str) -> str:
        nl = self.char["NL"]
        return re.sub(f"{nl}+", nl, s).strip(nl)
