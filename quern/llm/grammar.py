"""Grammars over token classes: pairs of neighbours that can occur, and reduction of brackets by productions.

A grammar is written in a small notation: quoted tokens, NAMES of lexical classes, names of other productions,
``| * + ?`` and parentheses, ``x % y`` for x separated by y, ``$`` for the end of what stands between the brackets,
and ``ANY`` for anything. Productions refer to each other freely, to themselves only through brackets.

A text is checked from the inside out: the content of the innermost pair of brackets is run through one automaton for
all productions the grammar has for that pair, and the pair is replaced by a mark that names those that accept it.
Reducing a part of a text first changes nothing, so windows of a text are reduced on their own and their rests are
reduced again in order. The automata are made deterministic as they are used, so each token costs one look-up.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

_NOTATION = re.compile(r"\s*(?:('(?:[^'\\]|\\.)+')|(\w+)|([()|*+?$%]))")
#: Marks of reduced brackets: one character each within a process, spelt out between these where they leave it.
_MARK, _UNMARK, _FIRST_MARK = "‹", "›", 0xF0000
#: Ends of lines with the column of the next line, for languages with layout.
COLUMN = 0xE000
_END = "\0"


class Grammar:
    """One language: classes of tokens, productions, and what they imply."""

    def __init__(self, text: str, start: str, brackets: dict[str, str], words: Iterable[str], classes: Iterable[str], unseen: Iterable[str] = ()):
        """text: the productions; start: that of a whole file; brackets: closing by opening token; words: tokens
        that are words; classes: names of lexical classes; unseen: opening tokens that leave no character."""
        self.char: dict[str, str] = {}
        self.words = list(dict.fromkeys(words))
        for t in [*self.words, *classes]:
            self._char(t)
        self.brackets = brackets
        self.unseen = set(unseen)
        self.rules: dict[str, list[str]] = {}
        for part in re.split(r"^(\w+):", text, flags=re.M)[1:]:
            self.rules.setdefault("", []).append(part)
        flat = self.rules.pop("")
        self.rules = {n: [m.group().strip() for m in _NOTATION.finditer(b)] for n, b in zip(flat[::2], flat[1::2])}
        for body in self.rules.values():
            for t in body:
                if t[0] == "'":
                    self._char(t[1:-1])
        self._trees: dict[str, tuple] = {}
        self._pending: list[str] = []
        self.groups: list[tuple[str, tuple]] = []  # opening character, tree of the content
        self._group_no: dict[tuple[str, str], int] = {}
        self._bodies: list[tuple[str, list[str]]] = []
        self.tree = self._rule(start)
        while len(self.groups) < len(self._bodies):
            opener, body = self._bodies[len(self.groups)]
            self.groups.append((opener, self._alternatives(body, 0)[0] if body else ("end",)))
        self.open = {self.char[o]: self.char[c] for o, c in brackets.items()}
        self.close = {c: o for o, c in self.open.items()}
        self.kind = {c: i for i, c in enumerate(self.open)}
        self.bracket = re.compile("[" + "".join([*self.open, *self.close]) + "]")
        self._automata: dict[str, _Automaton] = {}
        self._marks: dict[tuple[str, frozenset[int]], str] = {}
        self.meaning: dict[str, tuple[str, frozenset[int]]] = {}
        self._memo: dict[tuple[str, str], str] = {}
        self.graph = _Graph(self._trees)

    def _char(self, token: str) -> str:
        if token not in self.char:
            self.char[token] = chr(0xA1 + len(self.char))
        return self.char[token]

    # ---- notation -> tree ----

    def _rule(self, name: str) -> tuple:
        if name not in self._trees:
            if name == "word":
                self._trees[name] = ("in", "".join(self.char[w] for w in self.words) + self.char["NAME"])
            elif name in self.char and name.isupper():
                self._trees[name] = ("in", self.char[name])
            else:
                tokens = self.rules[name]
                tree, at = self._alternatives(tokens, 0)
                if at != len(tokens):
                    raise ValueError(f"production {name}: {tokens[at:]}")
                self._trees[name] = tree
        return self._trees[name]

    def _reference(self, name: str) -> tuple:
        """A class of tokens as such, any other production by its name."""
        if name == "word" or (name in self.char and name.isupper()) or (name in self._trees and self._trees[name][0] == "in"):
            return self._rule(name)
        if name not in self._trees:
            if name not in self._pending:
                self._pending.append(name)
                self._rule(name)
        tree = self._trees.get(name)
        return tree if tree is not None and tree[0] == "in" else ("ref", name)

    def _alternatives(self, t: list[str], at: int, closer: str = "") -> tuple[tuple, int]:
        options = []
        while True:
            parts = []
            while at < len(t) and t[at] not in (")", "|", closer):
                node, at = self._item(t, at)
                if at < len(t) and t[at] == "%":
                    sep, at = self._item(t, at + 1)
                    node = ("list", node, sep)
                parts.append(node)
            options.append(parts[0] if len(parts) == 1 else ("seq", tuple(parts)))
            if at < len(t) and t[at] == "|":
                at += 1
            else:
                break
        if len(options) > 1 and all(o[0] == "in" for o in options):
            return ("in", "".join(o[1] for o in options)), at
        return (options[0] if len(options) == 1 else ("alt", tuple(options))), at

    def _item(self, t: list[str], at: int) -> tuple[tuple, int]:
        x = t[at]
        if x == "$":
            return ("end",), at + 1
        if x == "(":
            node, at = self._alternatives(t, at + 1)
            at += 1
        elif x[0] == "'":
            token = x[1:-1]
            if token in self.brackets:
                opener, closer, depth, end = x, f"'{self.brackets[token]}'", 1, at + 1
                while depth:
                    depth += (t[end] == opener) - (t[end] == closer)
                    end += 1
                body = t[at + 1 : end - 1]
                node, at = (("any-group", self.char[token]) if body == ["ANY"] else ("group", self._group(self.char[token], body))), end
            else:
                node, at = ("in", self.char[token]), at + 1
        elif x == "ANY":
            node, at = ("any",), at + 1
        else:
            node, at = self._reference(x), at + 1
        while at < len(t) and t[at] in ("*", "+", "?"):
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[t[at]]
            node, at = ("rep", node, low, high), at + 1
        return node, at

    def _group(self, opener: str, body: list[str]) -> int:
        """Number of a pair of brackets with a content; productions refer to each other through these numbers only."""
        key = (opener, " ".join(body))
        if key not in self._group_no:
            self._group_no[key] = len(self._bodies)
            self._bodies.append((opener, body))
        return self._group_no[key]

    # ---- tree -> pairs of neighbours ----

    def pairs(self) -> set[str]:
        """Every two classes that can stand side by side: last of one part with first of the next, brackets included."""
        found: set[str] = set()
        memo: dict[int, tuple[bool, frozenset, frozenset]] = {}
        unseen = {self.char[t] for t in self.unseen}
        known: dict[str, tuple[bool, frozenset, frozenset]] = {}
        inner = [(False, frozenset(), frozenset()) for _ in self.groups]

        def join(last: Iterable[str], first: Iterable[str]) -> None:
            found.update(a + b for a in last for b in first)

        def walk(n: tuple) -> tuple[bool, frozenset, frozenset]:
            kind = n[0]
            if kind == "ref":
                return known.get(n[1], (False, frozenset(), frozenset()))
            if id(n) in memo:
                return memo[id(n)]
            if kind == "in":
                got = (False, frozenset(n[1]), frozenset(n[1]))
            elif kind == "end":
                got = (False, frozenset(_END), frozenset(_END))
            elif kind == "any":
                got = (True, frozenset(), frozenset())
            elif kind == "any-group":
                got = (False, frozenset(n[1]), frozenset(self.open[n[1]]))
            elif kind == "group":
                opener = self.groups[n[1]][0]
                got = inner[n[1]] if opener in unseen else (False, frozenset(opener), frozenset(self.open[opener]))
            elif kind == "rep":
                empty, first, last = walk(n[1])
                if n[3] is None:
                    join(last, first)
                got = (empty or n[2] == 0, first, last)
            elif kind == "list":
                empty, first, last = walk(n[1])
                none, then, till = walk(n[2])
                join(last, then)
                join(till, first)
                if none:
                    join(last, first)
                if empty:
                    join(till, then)
                    first, last = first | then, last | till
                got = (empty, first, last)
            elif kind == "alt":
                parts = [walk(x) for x in n[1]]
                got = (any(p[0] for p in parts), frozenset().union(*(p[1] for p in parts)), frozenset().union(*(p[2] for p in parts)))
            else:
                empty, first, last = True, frozenset(), frozenset()
                for x in n[1]:
                    e, f, la = walk(x)
                    join(last, f)
                    if empty:
                        first |= f
                    last = last | la if e else la
                    empty = empty and e
                got = (empty, first, last)
            memo[id(n)] = got
            return got

        before = None
        while before != (before := (len(found), sum(e + len(f) + len(x) for e, f, x in [*known.values(), *inner]))):
            memo.clear()
            for name, tree in self._trees.items():
                known[name] = walk(tree)
            walk(self.tree)
            for i, (opener, body) in enumerate(self.groups):
                inner[i] = empty, first, last = walk(body)
                if opener not in unseen:
                    join(opener, first)
                    join(last, self.open[opener])
                    if empty or _END in first:
                        found.add(opener + self.open[opener])
        # what may stand at the end of a content may stand before a closing bracket
        ends = [p[0] for p in found if p[1] == _END]
        found.update(x + c for x in ends for c in self.close if x in self.char.values())
        return {p for p in found if _END not in p}

    # ---- tree -> automaton ----

    def _automaton(self, opener: str) -> _Automaton:
        """All productions of a pair of brackets, or of a file for ''."""
        if opener not in self._automata:
            a = _Automaton(self)
            for i, (o, body) in enumerate(self.groups):
                if o == opener:
                    a.add_production(i, body)
            if not opener:
                a.add_production(-1, self.tree)
            self._automata[opener] = a
        return self._automata[opener]

    def _mark_of(self, opener: str, held: frozenset[int]) -> str:
        got = self._marks.get((opener, held))
        if got is None:
            got = self._marks[opener, held] = chr(_FIRST_MARK + len(self._marks))
            self.meaning[got] = (opener, held)
        return got

    def mark(self, opener: str, body: str) -> str:
        """What stands for a pair of brackets with a reduced content: its kind and the productions that accept it."""
        key = (opener, body)
        got = self._memo.get(key)
        if got is None:
            got = self._mark_of(opener, self._automaton(opener).accepted(body))
            if len(body) < 100:
                if len(self._memo) > 200_000:
                    self._memo.clear()
                self._memo[key] = got
        return got

    def spell(self, s: str) -> str:
        """Reduced classes with marks spelt out, fit for another process."""
        for c in set(s) & self.meaning.keys():
            opener, held = self.meaning[c]
            s = s.replace(c, f"{_MARK}{opener}{','.join(map(str, sorted(held)))}{_UNMARK}")
        return s

    def unspell(self, s: str) -> str:
        """What ``spell`` was given."""
        return _SPELT.sub(lambda m: self._mark_of(m[1], frozenset(map(int, m[2].split(","))) if m[2] else frozenset()), s)

    def reduce(self, s: str) -> str:
        """The classes with every complete pair of brackets replaced by its mark; brackets without a partner stay."""
        parts: list[list[str]] = [[]]
        opens: list[str] = []
        at = 0
        pair, mark = self.open, self.mark
        for m in self.bracket.finditer(s):
            i = m.start()
            c = s[i]
            if i > at:
                parts[-1].append(s[at:i])
            at = i + 1
            if c in pair:
                parts.append([])
                opens.append(c)
            elif opens and pair[opens[-1]] == c:
                body = "".join(parts.pop())
                parts[-1].append(mark(opens.pop(), body))
            else:
                # no partner here: what is open before it cannot be closed across it
                parts, opens = [_flat(parts, opens)], []
                parts[0].append(c)
        parts[-1].append(s[at:])
        return "".join(_flat(parts, opens))

    def whole(self, s: str) -> bool:
        """Whether reduced classes are a whole file."""
        return -1 in self._automaton("").accepted(s)

    def show(self, s: str) -> str:
        """Classes as tokens, for messages and tests."""
        back = {c: t for t, c in self.char.items()}
        return " ".join(back.get(c) or (back[self.meaning[c][0]] + ".." if c in self.meaning else "NL" if ord(c) >= COLUMN else c) for c in s)


def _flat(parts: list[list[str]], opens: list[str]) -> list[str]:
    out = parts[0]
    for opener, part in zip(opens, parts[1:]):
        out.append(opener)
        out += part
    return out


_SPELT = re.compile(f"{_MARK}(.)([\\d,-]*){_UNMARK}", re.S)


class _State(dict):
    """A state of the deterministic automaton; the next state of a class is worked out when first asked for."""

    __slots__ = ("automaton", "held")

    def __init__(self, automaton: _Automaton, held: frozenset[int]):
        super().__init__()
        self.automaton, self.held = automaton, held

    def __missing__(self, c: str) -> _State:
        self[c] = got = self.automaton.step(self.held, c)
        return got


class _Graph:
    """The productions of a grammar as graphs of states with silent steps; a production met in another is called."""

    def __init__(self, trees: dict[str, tuple]):
        self.trees = trees
        self.silent: list[list[int]] = []
        self.symbol: list = []
        self.target: list[int] = []
        self.bounds: dict[str, tuple[int, int]] = {}

    def new(self) -> int:
        self.silent.append([])
        self.symbol.append(None)
        self.target.append(-1)
        return len(self.silent) - 1

    def production(self, name: str) -> tuple[int, int]:
        if name not in self.bounds:
            self.bounds[name] = self.new(), self.new()
            self.add(self.trees[name], *self.bounds[name])
        return self.bounds[name]

    def _edge(self, a: int, b: int, symbol: object) -> None:
        s = self.new()
        self.silent[a].append(s)
        self.symbol[s], self.target[s] = symbol, b

    def add(self, n: tuple, a: int, b: int) -> None:
        kind = n[0]
        if kind == "ref":
            self.production(n[1])
            self._edge(a, b, n)
        elif kind == "in":
            self._edge(a, b, frozenset(n[1]))
        elif kind == "group":
            self._edge(a, b, n[1])
        elif kind == "any-group":
            self._edge(a, b, n)
        elif kind == "end":
            self._edge(a, b, frozenset(_END))
        elif kind == "any":
            s = self.new()
            self.silent[a].append(s)
            self._edge(s, s, "any")
            self.silent[s].append(b)
        elif kind == "alt":
            for x in n[1]:
                self.add(x, a, b)
        elif kind == "seq":
            for x in n[1][:-1]:
                c = self.new()
                self.add(x, a, c)
                a = c
            if n[1]:
                self.add(n[1][-1], a, b)
            else:
                self.silent[a].append(b)
        else:
            s, t = self.new(), self.new()
            self.silent[a].append(s)
            self.add(n[1], s, t)
            self.silent[t].append(b)
            if kind == "list":
                self.add(n[2], t, s)
            else:
                if n[3] is None:
                    self.silent[t].append(s)
                if n[2] == 0:
                    self.silent[a].append(b)


class _Automaton:
    """Productions side by side. A place is a state of the graph and where the production it lies in was called from."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.graph = grammar.graph
        self.final: dict[int, int] = {}
        self.starts: list[int] = []
        self.states: dict[frozenset[int], _State] = {}
        self._calls: list[tuple[int, int]] = [(-1, -1)]
        self._call_no: dict[tuple[int, int], int] = {}
        self._places: list[tuple[int, int]] = []
        self._place_no: dict[tuple[int, int], int] = {}
        self._closed: dict[tuple[int, int], frozenset[int]] = {}
        self._ends = {}
        self._start: _State | None = None

    def add_production(self, number: int, tree: tuple) -> None:
        a, b = self.graph.new(), self.graph.new()
        self.graph.add(tree, a, b)
        self.starts.append(a)
        self.final[b] = number

    def _reach(self, start: tuple[int, int]) -> frozenset[int]:
        """Places with a symbol or an end that are reached silently from a place."""
        got = self._closed.get(start)
        if got is not None:
            return got
        graph, out = self.graph, set()
        if not self._ends:
            self._ends = {b for _, b in graph.bounds.values()}
        seen, todo = {start}, [start]
        while todo:
            q, call = todo.pop()
            symbol = graph.symbol[q]
            more = [(r, call) for r in graph.silent[q]]
            if symbol is None:
                if q in self._ends and call:
                    more.append(self._calls[call])
                elif q not in self.final:
                    symbol = ()
            elif isinstance(symbol, tuple) and symbol[0] == "ref":
                key = (graph.target[q], call)
                if key not in self._call_no:
                    self._call_no[key] = len(self._calls)
                    self._calls.append(key)
                more.append((graph.bounds[symbol[1]][0], self._call_no[key]))
                symbol = ()
            if symbol != () and (symbol is not None or q in self.final):
                if (q, call) not in self._place_no:
                    self._place_no[q, call] = len(self._places)
                    self._places.append((q, call))
                out.add(self._place_no[q, call])
            for x in more:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        got = self._closed[start] = frozenset(out)
        return got

    def _state(self, held: frozenset[int]) -> _State:
        if held not in self.states:
            self.states[held] = _State(self, held)
        return self.states[held]

    def step(self, held: frozenset[int], c: str) -> _State:
        opener, matching = self.grammar.meaning.get(c, ("", frozenset()))
        symbols, target, out = self.graph.symbol, self.graph.target, set()
        for place in held:
            q, call = self._places[place]
            s = symbols[q]
            if isinstance(s, frozenset):
                fits = c in s
            elif isinstance(s, int):
                fits = s in matching
            elif s is None:
                continue
            else:
                fits = c != _END if s == "any" else s[1] == opener
            if fits:
                out |= self._reach((target[q], call))
        return self._state(frozenset(out))

    def accepted(self, body: str) -> frozenset[int]:
        """The productions that accept a content."""
        if self._start is None:
            self._start = self._state(frozenset().union(*(self._reach((a, 0)) for a in self.starts)))
        state = self._start
        for c in body:
            state = state[c]
        return frozenset(self.final[q] for q in (self._places[p][0] for p in state.held | state[_END].held) if q in self.final)
