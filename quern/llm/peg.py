"""A small packrat parser: parsing expressions over text, with memoised rules and source offsets.

Expressions are built from terminals (regular expressions matched at a position), sequences, ordered choices,
repetitions, options and rule references. A rule's result at a position is computed once. The result of a rule is
what its action makes of (start, end, parts); parts are the results of the rules it read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Match = tuple[int, tuple]  # end, results
Expr = Callable[["Parse", int], "Match | None"]


class Parse:
    """One text with the memo of its rules."""

    __slots__ = ("text", "memo", "depth")

    def __init__(self, text: str):
        self.text, self.memo, self.depth = text, {}, 0


def term(pattern: str, flags: int = 0) -> Expr:
    """Text that matches the pattern; gives no result."""
    match = re.compile(pattern, flags).match

    def run(p: Parse, at: int):
        m = match(p.text, at)
        return None if m is None else (m.end(), ())

    return run


def take(pattern: str, name: str, flags: int = 0) -> Expr:
    """Like term, but gives (name, start, end) of the pattern's first group, or of all of it."""
    rx = re.compile(pattern, flags)
    match, group = rx.match, 1 if rx.groups else 0

    def run(p: Parse, at: int):
        m = match(p.text, at)
        return None if m is None else (m.end(), ((name, m.start(group), m.end(group)),))

    return run


def seq(*parts: Expr) -> Expr:
    """All parts one after the other."""

    def run(p: Parse, at: int):
        got: tuple = ()
        for part in parts:
            r = part(p, at)
            if r is None:
                return None
            at = r[0]
            got += r[1]
        return at, got

    return run


def first(*choices: Expr) -> Expr:
    """The first choice that matches."""

    def run(p: Parse, at: int):
        for c in choices:
            r = c(p, at)
            if r is not None:
                return r
        return None

    return run


def many(part: Expr, least: int = 0) -> Expr:
    """The part as often as it matches and moves on."""

    def run(p: Parse, at: int):
        got: list = []
        n = 0
        while True:
            r = part(p, at)
            if r is None or r[0] == at:
                break
            at = r[0]
            got.extend(r[1])
            n += 1
        return None if n < least else (at, tuple(got))

    return run


def balanced(pieces: str, opens: str = "(", closes: str = ")") -> Expr:
    """What lies between an opening bracket and its partner, nested to any depth, without recursion. pieces: strings, comments and other text that is passed over whole."""
    rx = re.compile(f"{pieces}|[\\s\\S]")

    def run(p: Parse, at: int):
        if not p.text.startswith(opens, at):
            return None
        depth = 0
        for m in rx.finditer(p.text, at):
            t = m.group()
            depth += (t == opens) - (t == closes)
            if depth == 0:
                return m.end(), ()
        return None

    return run


def maybe(part: Expr) -> Expr:
    """The part, or nothing."""

    def run(p: Parse, at: int):
        r = part(p, at)
        return (at, ()) if r is None else r

    return run


class Rule:
    """A named, memoised expression. Nesting beyond ``most`` levels does not match."""

    most = 100

    def __init__(self, name: str, action: Callable[[str, int, int, tuple], tuple] | None = None):
        self.name, self.action, self.expr = name, action, None

    def __call__(self, p: Parse, at: int):
        key = (self.name, at)
        if key in p.memo:
            return p.memo[key]
        if p.depth >= self.most:
            return None
        p.depth += 1
        r = self.expr(p, at)
        p.depth -= 1
        if r is not None and self.action is not None:
            r = (r[0], self.action(p.text, at, r[0], r[1]))
        p.memo[key] = r
        return r
