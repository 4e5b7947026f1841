"""Functions paired with their documentation (problem 7)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.arrow import by_slices
from quern.llm.peg import Parse, Rule, balanced, first, many, maybe, seq, take, term

# ---- grammars -------------------------------------------------------------------------------------------

_STRING = r'"(?:[^"\\\n]|\\.)*"|' r"'(?:[^'\\\n]|\\.)*'"
_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|else|do|new|throw|sizeof|function|func|def|in|of|await|typeof|delete|case|unless|until|and|or|not|print)\b)"


def _grammar(language: str) -> Rule:
    """file <- unit*; unit <- definition with its comment / comment / string / line.

    A definition is a header, parameters nested to any depth, and what marks its body. Comments above it may be
    followed by blank lines and by decorators or annotations.
    """
    hashes = language in ("python", "ruby")
    nested = balanced((_STRING if hashes else _STRING + r"|//[^\n]*|/\*[\s\S]*?\*/") + r"|[^()\"'/\n]+")
    params = Rule("params", lambda t, a, b, got: (("params", a, b),))
    params.expr = nested
    if language == "python":
        body = first(take(r"[^\n:]*:[ \t]*(?:#[^\n]*)?(?:\r?\n[ \t]*)*[rRuU]?(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')[ \t]*(?:;|#|\r|\n|\Z)", "docstring"), term(r"[^\n]*"))
        head = seq(term(r"[ \t]*(?:async[ \t]+)?"), take(r"(def)[ \t]+", "def"), take(r"\w+", "name"), term(r"\s*"), params, body)
    elif language == "ruby":
        head = seq(term(r"[ \t]*(?:(?:private|public|protected|module_function)[ \t]+)?"), take(r"(def)[ \t]+(?:[\w.]+\.)?", "def"), take(r"\w+[?!=]?|[-+*/<=>\[\]%!~^&|]+", "name"), maybe(params))
    elif language == "go":
        head = seq(take(r"(func)[ \t]+", "def"), maybe(seq(nested, term(r"[ \t]*"))), take(r"\w+", "name"), term(r"(?:\[[^\]\n]*\])?"), params, term(r"[^\n{;]*\{"))
    elif language in ("javascript", "typescript"):
        mods = r"[ \t]*(?:(?:export|default|async|static|public|private|protected|readonly|override|abstract|get|set)[ \t]+)*"
        head = seq(term(mods), take(r"(?:function\b[ \t]*\*?[ \t]*|\*[ \t]*)?", "def"), take(_NOT_NAMES + r"#?[\w$]+", "name"), term(r"(?:<[^>\n]*>)?\s*"), params, term(r"[^\n{;=]*\{"))
    else:  # c, cpp, java
        # types and modifiers, each followed by a space, a star or an ampersand; possessive, so never read twice
        word = term(r"(?!(?:return|else|new|throw|case|goto|delete)\b)(?:[A-Za-z_][\w:]*+(?:[ \t]*<[^;{}()\n]*>)?(?:\[\])*+(?:[ \t]+|[ \t]*[*&]++[ \t]*)|\[\[[^\]\n]*\]\][ \t]*|[*&]++[ \t]*)")
        head = seq(term(r"[ \t]*+(?=[^\n(;=]*\()"), take(r"(?=[\w*&~\[])", "def"), many(word), take(_NOT_NAMES + r"(?:[A-Za-z_]\w*::)*(~?[A-Za-z_]\w*)", "name"), term(r"[ \t]*"), params, term(r"[^\n{;=()]*(?:\n[ \t]*)?\{"))
    blank = term(r"[ \t\r]*\n")
    line_note = term(r"[ \t]*#[^\n]*\n?") if hashes else term(r"[ \t]*(?://[^\n]*|#[^\n]*)\n?")
    comment = Rule("comment", lambda t, a, b, got: (("comment", a, b),))
    runs = many(line_note, 1)
    if language == "ruby":
        comment.expr = first(term(r"=begin\b[\s\S]*?^=end[^\n]*\n?", re.M), runs)
    else:
        comment.expr = runs if hashes else first(term(r"[ \t]*/\*[\s\S]*?\*/[ \t\r]*\n?"), runs)
    attribute = term(r"[ \t]*@[\w.]+(?:\([^\n]*\))?[ \t\r]*\n")
    definition = Rule("definition", lambda t, a, b, got: (("function", a, b, got),))
    definition.expr = first(seq(comment, many(blank), many(attribute), head), seq(many(attribute), head))
    strings = []
    if language == "python":
        strings = [term(r"[ \t]*[^\s#\"'][^\n#\"']*(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')[^\n]*\n?"), term(r"[ \t]*[rRuUbBfF]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')[^\n]*\n?")]
    line = term(r"[^\n]*\n|[^\n]+")
    quiet = Rule("quiet", lambda t, a, b, got: ())
    quiet.expr = first(comment, *strings, line)
    plain = term(r"[ \t]*(?:[})\];,]|return\b|if\b|for\b|end\b|else\b)[^\n]*\n") if language != "python" else term(r"[ \t]*(?:return|if|for|else)\b[^\n\"']*\n")
    file = Rule("file")
    file.expr = many(first(blank, plain, definition, quiet))
    return file


GRAMMARS = {name: _grammar(name) for name in ("python", "ruby", "go", "javascript", "typescript", "c", "cpp", "java")}
#: Language by the extension of the path.
LANGUAGE = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby"}


_PY_PIECE = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|" + _STRING + r"|#[^\n]*|\\\r?\n|[()\[\]{}]|\n|[^\s()\[\]{}\"'#\\]+|[\"'\\]")
_BRACE_PIECE = re.compile(_STRING + r"|`(?:[^`\\]|\\[\s\S])*`|//[^\n]*|/\*[\s\S]*?\*/|[{}]")


def body_end(text: str, language: str, begin: int, head: int) -> int:
    """Where the definition that begins at ``begin`` ends: by indentation in Python, by its end in Ruby, by braces elsewhere. head: the end of its head."""
    line = text.rfind("\n", 0, begin) + 1
    indent = len(text[line:begin]) - len(text[line:begin].lstrip(" \t"))
    if language == "ruby":
        stop = text.find("\n", begin)
        stop = len(text) if stop < 0 else stop
        if re.match(r"[ \t]*=[ \t]|[^\n]*\bend[ \t\r]*$", text[head:stop]):
            return stop
        m = re.compile(r"^" + re.escape(text[line : line + indent]) + r"end\b", re.M).search(text, stop)
        return m.end() if m else len(text)
    if language == "python":
        depth, last, fresh = 0, begin, False
        for m in _PY_PIECE.finditer(text, begin):
            t = m.group()
            if t == "\n":
                fresh = fresh or depth == 0
                continue
            if t[0] == "#" or t[0] == "\\":
                continue
            if fresh and m.start() - text.rfind("\n", 0, m.start()) - 1 <= indent:
                break
            fresh = False
            depth = max(0, depth + (t in "([{") - (t in ")]}"))
            last = m.end()
        return last
    depth = 1
    for m in _BRACE_PIECE.finditer(text, head):
        depth += (m.group() == "{") - (m.group() == "}")
        if depth == 0:
            return m.end()
    return len(text)


def functions(text: str, language: str) -> list[tuple[str, int, int, int, str | None, str | None]]:
    """(name, line, start, end, params, doc) of each function and method; offsets in characters, from its comment to the end of its body, lines from 1."""
    got = GRAMMARS[language](Parse(text), 0)
    out, line, at = [], 1, 0
    for kind, start, end, parts in got[1] if got else ():
        if kind != "function":
            continue
        named = {p[0]: (p[1], p[2]) for p in parts}
        begins = named["def"][0]
        if language in ("c", "cpp", "java", "javascript", "typescript"):
            begins = named["name"][0]
        line += text.count("\n", at, begins)
        at = begins
        doc = named.get("docstring") or named.get("comment")
        end = body_end(text, language, named["def"][0], end)
        out.append((text[slice(*named["name"])], line, start, end, text[slice(*named["params"])] if "params" in named else None, text[slice(*doc)] if doc else None))
    return out


# ---- what a description tells ---------------------------------------------------------------------------

_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!/)|///?!?|#+!?|=begin|=end)?[ \t]*|[ \t]*\*+/[ \t]*$")
_QUOTES = re.compile(r"^\s*[rRuU]?(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')\s*$")
#: What says nothing about a function. Whole lines or sentences, lower case, without marks around.
_EMPTY_LINES = re.compile(
    r"(?:todo|fixme|xxx|hack)\b[ :,-]*(?:document\b.*|write docs?|docs?|docstring|add (?:docs?|description)|describe.*)?"
    r"|tbd|tba|n/?a|none|wip|\.{2,}|…|undocumented|(?:no|missing) (?:docs?|description|documentation)|not documented(?: yet)?|documentation pending"
    r"|(?:add|insert|write)(?: an?)?(?: short)? (?:description|summary|docs?|documentation|comment)(?: here)?|(?:description|summary|docs?|documentation|text)(?: goes| to come)? here|lorem ipsum.*"
    r"|auto-?generated (?:method|function|constructor)? ?(?:stub|code)|(?:method|function|constructor) stub|placeholder|coming soon"
    r"|(?:see|cf\.?|siehe|vgl\.?|voir|véase|ver|vea)(?: also| auch| aussi| también)? (?:above|below|there|the docs?|docs?|readme|wiki|oben|unten|dort|plus haut|plus bas|ci-dessus|ci-dessous|là|arriba|abajo|allí)"
    r"|same(?: as (?:above|before|below))?|as above|ditto|dito|ibid\.?|idem|lo mismo|wie oben"
    r"|(?:pylint|eslint|rubocop|nolint|noqa|mypy|pragma|flake8|clang-format|clang-tidy|istanbul|tslint|ts-ignore|ts-expect-error|ts-nocheck|type:|fmt:|isort|yapf|prettier-ignore|jshint|jslint|nosec|coverage|cspell|spdx|@ts-\w+|@?suppress\w*|codacy|sonar|lint|shellcheck|go:\w+|\+build|-\*-|frozen_string_literal|vim:|region|endregion)(?:[-:=( ].*)?"
    r"|(?:todo|fixme|xxx)"
)
_LICENCE = re.compile(r"copyright\b|\(c\)|©|all rights reserved|\blicen[sc]ed?\b.*(?:under|terms|file|free|see)|see the file licen[sc]e|spdx-|permission is hereby|without warrant|apache license|mit license|\bgpl\b|redistribution and use|lizenz|tous droits|todos los derechos", re.I)
_CODE = re.compile(
    r"#?\s*(?:include|import|require|require_relative|using|package|define|pragma|ifn?def|endif)\b[ \t]*(?:[<\"'(].*|[\w.:]+;?)?$"
    r"|(?:return|raise|throw|yield|break|continue|pass|goto|end|else|elsif|elif)\b\s*(?:[\w.\[\]()\"'+*/,&|<>=!-]+)?(?:\s*[-+*/%&|<>=]+\s*[\w.\[\]()\"']+)*\s*;?$"
    r"|(?:(?:const|let|var|auto|int|long|float|double|bool|char|string|final|static|public|private|void)\s+)?[\w.\[\]*&>-]+\s*(?::?=|\+=|-=|\*=|/=|<<=|\|=|&=)\s*\S.*$"
    r"|(?:if|for|while|switch|unless|until|def|func|function|class|print|printf|console\.\w+)\b\s*[\w (].*[({:;]\s*\)?$"
    r"|(?:if|while|for|switch)\s*\(.*\).*$|[\w.:>-]+\([^()]*\)\s*[;{]$|[{}()\[\];,]+$|.*[;{}]\s*$"
)
_TAG = re.compile(r"[@\\:](\w+):?\b\s*(.*)$", re.S)
#: Words that add nothing to a name.
_GENERIC = frozenset(
    "a an the this that these those it its is are be was does do done did of to in on at by for from with and or as if not no s "
    "function method class procedure routine subroutine constructor destructor member operation call func fn def helper helpers utility util utilities internal internals private public protected static "
    "getter setter accessor mutator get set main wrapper implementation impl stub misc other stuff thing things simple basic default new old test temp tmp "
    "param parameter parameters params arg args argument arguments return returns value values result results given object instance type void null none name named called "
    "der die das ein eine einer eines diese dieser funktion methode le la les un une des du de cette fonction méthode el los las una unos del esta este función método "
    "self cls todo fixme xxx hack note".split()
)
_WORD = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-zß-ÿ]+|[A-Z]+|\d+|[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def _stem(word: str) -> str:
    for end in ("ings", "ing", "ies", "es", "ed", "s", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)]
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def _words(text: str) -> list[str]:
    return [w.lower() for part in _WORD.findall(text) for w in _CAMEL.findall(part)]


def description(doc: str | None) -> list[str]:
    """The lines of a raw comment or docstring without marks."""
    if doc is None:
        return []
    t = doc.strip()
    if not re.match(r"/\*|//|#|=begin", t):
        t = _QUOTES.sub("", t)
    lines = []
    for raw in re.split(r"\r\n|\r|\n", t):
        # an include is code, not a comment of one mark
        lines.append(raw.strip() if re.match(r"\s*#\s*(?:include|define|pragma|ifn?def|endif|if|else|undef)\b", raw) else _MARKS.sub("", _MARKS.sub("", raw), count=1).strip())
    return lines


def informative(doc: str | None, name: str | None, params: str | None = None) -> bool:
    """Whether a documentation says something that the name and the parameters don't.

    Lines that are separators, placeholders, notes to tools, pointers elsewhere, licence notices, code or
    includes are dropped, and so are sentences of a to-do. Of the rest at least two words must remain that are
    neither generic nor part of the name or a parameter's name. A tag tells something if its text does, the
    parameter's own name aside.
    """
    known = {_stem(w) for w in _words(name or "")} | {_stem(w) for w in _words(params or "")}
    lines = description(doc)
    kept: list[str] = []
    licence = False
    for line in lines:
        low = line.strip(" \t.!:;*-=#~_+/<>|").lower()
        if not line or not re.search(r"\w", line):
            licence = licence and bool(line)
            continue
        if licence or _LICENCE.search(line):
            licence = True
            continue
        if _EMPTY_LINES.fullmatch(low) or _EMPTY_LINES.fullmatch(line.lower().strip(" .")):
            continue
        if _CODE.match(line):
            continue
        kept.append(line)
    text: list[str] = []
    for line in kept:
        tag = _TAG.match(line)
        if tag:
            # the word after @param is the parameter's name
            rest = tag.group(2)
            if tag.group(1) in ("param", "arg", "argument", "type", "tparam", "property"):
                own = re.match(r"(?:\{[^}]*\}\s*|\[[^\]]*\]\s*)?[$\w.]+", rest)
                ignore = known | {_stem(w) for w in _words(own.group() if own else "")}
                rest = rest[own.end() :] if own else rest
            else:
                ignore = known
            if _tells(rest, ignore):
                return True
            continue
        text.append(line)
    body = " ".join(text)
    sentences = [s for s in _SENTENCE.split(body) if not re.match(r"(?:todo|fixme|xxx|hack)\b", s.strip(), re.I) and not _EMPTY_LINES.fullmatch(s.lower().strip(" .!"))]
    return _tells(" ".join(sentences), known)


def _tells(text: str, known: set[str]) -> bool:
    if len(_WIDE.findall(text)) >= 4:
        return True
    if len(_WORD.findall(text)) < 2:
        return False
    rest = {w for w in _words(text) if w not in _GENERIC and not w.isdigit() and len(w) > 1 and _stem(w) not in known}
    return len(rest) >= 2


# ---- operators ------------------------------------------------------------------------------------------


def extract_functions(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, name, line, start_char, end_char, params, doc, code): each function of each source document.

    documents: (file_id, text); files: (id, path). The language is that of the path's extension; other files, null
    and empty texts give no rows. Documents of unknown files are left out. Repeated texts of a file repeat rows.
    Files are joined by their id; texts are parsed whole where they lie.
    """
    paths = files.select(F.col("id").alias("file_id"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("ext")).where(F.col("ext").isin(list(LANGUAGE))).dropDuplicates(["file_id"])
    rows = documents.select("file_id", "text").where("text IS NOT NULL AND text <> ''").join(paths, "file_id").select("file_id", "ext", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for fid, ext, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for name, line, start, end, params, doc in functions(text, LANGUAGE[ext]):
                    out.append((fid, name, line, start, end, params, doc, text[start:end]))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file_id", "name", "line", "start_char", "end_char", "params", "doc", "code"])

        yield from by_slices(one, batches, 2)

    return rows.mapInArrow(run, "file_id bigint, name string, line int, start_char int, end_char int, params string, doc string, code string")


def documented_functions(symbols: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, name, signature, description, code): functions and methods whose documentation tells something.

    The documentation is that of the symbol, or where it is null the docstring or comment of the definition of
    that name nearest to the symbol's line in its file's text. The code is the whole of that definition, with its comment and
    body, null where the file has no text or no such definition. Symbols without either are dropped, and so are
    those whose documentation is trivial. Repeated symbols count once; empty tables give no rows.
    """
    rows = symbols.where(F.col("kind").isin("function", "method")).select("id", "file_id", "name", "signature", "line_start", "documentation").dropDuplicates(["id"])
    found = extract_functions(documents, files).select("file_id", F.col("name").alias("_name"), "line", "params", "doc", "code")
    near = Window.partitionBy("id").orderBy(F.abs(F.col("line") - F.coalesce("line_start", "line")), F.desc(F.col("doc").isNotNull()), "line", "doc", "code")
    met = rows.join(found, (rows["file_id"] == found["file_id"]) & (rows["name"] == found["_name"]), "left").withColumn("_r", F.row_number().over(near)).where("_r = 1")
    pairs = met.select("id", "name", F.when(F.col("documentation").isNull(), F.coalesce("signature", "params")).otherwise(F.col("signature")).alias("signature"), F.coalesce("documentation", "doc").alias("documentation"), "code").where("documentation IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [informative(d, n, s) for n, s, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
            text = ["\n".join(description(d)) for d in b.column(3).to_pylist()]
            out = pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(text, pa.string()), b.column(4)], ["symbol_id", "name", "signature", "description", "code"])
            yield out.filter(pa.array(keep))

    return pairs.mapInArrow(run, "symbol_id bigint, name string, signature string, description string, code string")
