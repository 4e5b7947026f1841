"""Whether a text is a sentence of its language: window by window, then as a whole."""

from __future__ import annotations

import re

from quern.functions.lexing import COLUMN, MOST_COLUMNS
from quern.llm.grammars import grammar, lexer

#: Tokens of one window.
WINDOW = 2048
_LINES = re.compile(f"[{chr(COLUMN)}-{chr(COLUMN + MOST_COLUMNS)}]")


def neighbours(lang: str, classes: str) -> set[str]:
    """Pairs of classes side by side; the column of a line is no part of its end."""
    if lang == "python":
        classes = _LINES.sub(grammar(lang).char["NL"], classes).strip(grammar(lang).char["NL"])
    return set(map("".join, zip(classes, classes[1:])))


def laid_out(classes: str) -> str | None:
    """Classes of a text with columns as classes with ends of lines and blocks; None if a line returns to no column open before.

    What stands behind the colon of a compound statement becomes a block of one line.
    """
    g = grammar("python").char
    nl, into, outof, colon, lambda_, decide = g["NL"], g["INDENT"], g["DEDENT"], g[":"], g["lambda"], g["case"]
    heads = {g[w] for w in ("if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class", "async", "case")}
    out: list[str] = []
    open_ = [0]
    at, column = 0, 0
    for m in [*_LINES.finditer(classes), None]:
        line = classes[at : m.start() if m else len(classes)]
        if line:
            if column > open_[-1]:
                open_.append(column)
                out.append(into)
            while column < open_[-1]:
                open_.pop()
                out.append(outof)
            if column != open_[-1]:
                return None
            if line[0] in heads and line[-1] != colon and not (line[0] == decide and line[1:2] in (colon, g["="], g["."], g[","])):
                k = line.find(colon)
                while k >= 0 and line.count(lambda_, 0, k) > line.count(colon, 0, k):
                    k = line.find(colon, k + 1)
                out += [line[: k + 1], into, line[k + 1 :], nl, outof] if k >= 0 else [line, nl]
            else:
                out += [line, nl]
        if m:
            at, column = m.end(), ord(m.group()) - COLUMN
    return "".join(out) + outof * (len(open_) - 1)


def window_rest(lang: str, classes: str) -> str:
    """What a window leaves when its complete brackets are reduced by the productions."""
    return grammar(lang).spell(grammar(lang).reduce(classes))


def verdict(lang: str, rest: str) -> str:
    """'' for the reduced rests of a valid text, else 'nesting' or 'statement'."""
    g = grammar(lang)
    rest = g.reduce(g.unspell(rest))
    if lang == "python":
        if g.bracket.search(rest):
            return "nesting"
        lines = laid_out(rest)
        if lines is None:
            return "nesting"
        rest = g.reduce(lines)
    if g.bracket.search(rest):
        return "nesting"
    return "" if g.whole(rest) else "statement"


def check(lang: str, text: str, window: int = WINDOW) -> tuple[set[str], str]:
    """(pairs no production allows, verdict on nesting and statements) of a text."""
    classes = lexer(lang)(text)
    rests = "".join(window_rest(lang, classes[i : i + window]) for i in range(0, len(classes), window))
    return neighbours(lang, classes) - permitted(lang), verdict(lang, rests)


_PERMITTED: dict[str, set[str]] = {}


def permitted(lang: str) -> set[str]:
    """The pairs of neighbours the grammar of a language allows."""
    if lang not in _PERMITTED:
        _PERMITTED[lang] = grammar(lang).pairs()
    return _PERMITTED[lang]
