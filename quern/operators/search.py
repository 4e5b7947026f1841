"""Full-text search over symbols: query language, BM25, substring fallback."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import FOLD_FROM, FOLD_TO, like_anywhere, tokens

if TYPE_CHECKING:
    from quern.operators.fulltext import SearchIndex

COLUMNS = ("name", "signature", "documentation")
K1, B = 1.2, 0.75


class QueryError(ValueError):
    """The query is not of the query language."""


@dataclass
class Phrase:
    """Words in a row, the last possibly a prefix, in some of the columns."""

    words: list[str]
    prefix: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass
class Node:
    """AND, OR or NOT of two queries."""

    op: str
    parts: list = field(default_factory=list)


def prepare(query: str) -> str:
    """The user's text without quotes, brackets and carets; a prefix search unless it holds a star, a brace or an operator word."""
    text = re.sub(r'["()^]', "", query).strip(" \t\n\r")
    if not text:
        return ""
    upper = f"{text.upper()}"
    if any(c in text for c in "*{}") or (" " in text and any(f" {w} " in upper for w in ("AND", "OR", "NOT"))):
        return text
    return text + "*"


_LEX = re.compile(r'\s+|(?P<str>"(?:[^"]|"")*")|(?P<word>[\w\x80-\U0010ffff]+)|(?P<mark>[{}:*+])')


def parse(query: str) -> Node | Phrase:
    """Parses a prepared query: words are joined by AND, NOT binds tighter than AND, AND tighter than OR.

    word*, word + word, column: ..., {column column}: ... are understood; anything else raises QueryError.
    """
    items: list[tuple[str, str]] = []
    at = 0
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise QueryError(query)
        if m.lastgroup:
            items.append((m.lastgroup, m.group()))
        at = m.end()
    pos = 0

    def peek(k: int = 0) -> tuple[str, str]:
        return items[pos + k] if pos + k < len(items) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal pos
        pos += 1
        return items[pos - 1]

    def word() -> str:
        if peek()[0] not in ("word", "str") or peek() in (("word", "AND"), ("word", "OR"), ("word", "NOT")):
            raise QueryError(query)
        return take()[1]

    def phrase(columns: tuple[str, ...]) -> Phrase:
        words = _split(word())
        while peek() == ("mark", "+"):
            take()
            words += _split(word())
        prefix = peek() == ("mark", "*")
        if prefix:
            take()
        if not words:
            raise QueryError(query)
        return Phrase(words, prefix, columns)

    def unit() -> Phrase:
        columns = COLUMNS
        if peek()[0] == "word" and peek(1) == ("mark", ":"):
            columns = (take()[1].lower(),)
            take()
        elif peek() == ("mark", "{"):
            take()
            names = []
            while peek()[0] == "word":
                names.append(take()[1].lower())
            if peek() != ("mark", "}"):
                raise QueryError(query)
            take()
            if peek() != ("mark", ":"):
                raise QueryError(query)
            take()
            columns = tuple(names)
        if not set(columns) <= set(COLUMNS):
            raise QueryError(query)
        return phrase(columns)

    def negated() -> Node | Phrase:
        left: Node | Phrase = unit()
        while peek() == ("word", "NOT"):
            take()
            left = Node("NOT", [left, unit()])
        return left

    def conjunction() -> Node | Phrase:
        parts = [negated()]
        while peek()[0] != "end" and peek() != ("word", "OR"):
            if peek() == ("word", "AND"):
                take()
            parts.append(negated())
        return parts[0] if len(parts) == 1 else Node("AND", parts)

    parts = [conjunction()]
    while peek() == ("word", "OR"):
        take()
        parts.append(conjunction())
    if pos < len(items) or not items:
        raise QueryError(query)
    return parts[0] if len(parts) == 1 else Node("OR", parts)


def _split(text: str) -> list[str]:
    """The words of a query text, folded as stored texts are."""
    return re.findall(r"(?:[^\W_]|[\ue000-\uf8ff])+", text.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO)))


def _phrases(q: Node | Phrase, scored: bool = True) -> list[tuple[Phrase, bool]]:
    if isinstance(q, Phrase):
        return [(q, scored)]
    if q.op == "NOT":
        return _phrases(q.parts[0], scored) + _phrases(q.parts[1], False)
    return [x for p in q.parts for x in _phrases(p, scored)]


def _count(p: Phrase) -> Column:
    """How often the phrase stands in its columns of a row with token arrays."""
    out = F.lit(0)
    for c in p.columns:
        toks = F.col(f"t_{c}")

        def hit(i: Column, toks: Column = toks) -> Column:
            test = F.lit(True)
            for k, w in enumerate(p.words):
                t = F.get(toks, i + k)
                last = k == len(p.words) - 1
                test = test & F.coalesce(t.startswith(w) if last and p.prefix else t == w, F.lit(False))
            return test

        if len(p.words) == 1:
            w = p.words[0]
            out = out + F.size(F.filter(toks, (lambda t: t.startswith(w)) if p.prefix else (lambda t: t == w)))
        else:
            places = F.when(F.size(toks) > 0, F.sequence(F.lit(0), F.size(toks) - 1)).otherwise(F.array().cast("array<int>"))
            out = out + F.size(F.filter(places, lambda i: hit(i)))
    return out


def _match(q: Node | Phrase, index: dict[int, int]) -> Column:
    if isinstance(q, Phrase):
        return F.col(f"tf{index[id(q)]}") > 0
    if q.op == "NOT":
        return _match(q.parts[0], index) & ~_match(q.parts[1], index)
    op = (lambda a, b: a & b) if q.op == "AND" else (lambda a, b: a | b)
    return reduce(op, [_match(p, index) for p in q.parts])


def bm25(symbols: DataFrame, query: Node | Phrase) -> DataFrame:
    """(symbol_id, rank) of the symbols that match; smaller (more negative) ranks are better.

    symbols: (symbol_id, name, signature, documentation), one row each. One scan gives the number of rows, their
    mean length and the rows of each phrase as a single row; a second one scores. Nothing else is shuffled.
    """
    phrases = _phrases(query)
    index = {id(p): k for k, (p, _) in enumerate(phrases)}
    rows = symbols.select("symbol_id", *[tokens(F.col(c)).alias(f"t_{c}") for c in COLUMNS])
    rows = rows.select("symbol_id", sum((F.size(f"t_{c}") for c in COLUMNS), F.lit(0)).alias("dl"), *[_count(p).alias(f"tf{k}") for k, (p, _) in enumerate(phrases)])
    stats = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(f"tf{k}") > 0, 1)).alias(f"df{k}") for k in range(len(phrases))])
    rows = rows.where(_match(query, index)).crossJoin(F.broadcast(stats))  # one row
    from quern.operators.fulltext import score

    return rows.select("symbol_id", (-score([s for _, s in phrases])).alias("rank"))


def _ranked(symbols: DataFrame, query: Node | Phrase, index: SearchIndex | None) -> DataFrame:
    """Ranks by the index if there is one, else by a scan of the symbols."""
    return bm25(symbols, query) if index is None else index.bm25(query)


def limited(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows of an order; a negative limit is none."""
    return df.orderBy(*order) if limit < 0 else df.orderBy(*order).limit(limit)


def search_symbols(symbols: DataFrame, query: str, kind: str = "", limit: int = 20, index: SearchIndex | None = None) -> DataFrame:
    """The best matches with rank; an empty query lists a kind; without a match, names that contain the text.

    symbols: (symbol_id, kind, name, signature, documentation, path, line_start). A query that does not parse
    finds nothing. The substring fallback is part of the same plan and gives rows only if the search has none.
    """
    held = symbols.where(F.col("kind") == kind) if kind else symbols
    text = prepare(query)
    if not text:
        return limited(held.withColumn("rank", F.lit(0.0)), ["path", "line_start", "symbol_id"], limit) if kind else held.withColumn("rank", F.lit(0.0)).limit(0)
    try:
        parsed = parse(text)
    except QueryError:
        return held.withColumn("rank", F.lit(0.0)).limit(0)
    best = limited(held.join(_ranked(symbols, parsed, index), "symbol_id"), ["rank", "symbol_id"], limit)
    none = best.agg(F.count(F.lit(1)).alias("hits")).where("hits = 0").select(F.lit(1).alias("_none"))
    other = held.where(like_anywhere(F.col("name"), query)).crossJoin(F.broadcast(none)).drop("_none")  # one row or none
    return best.unionByName(limited(other.withColumn("rank", F.lit(0.0)), ["name", "symbol_id"], limit))


def search_text(symbols: DataFrame, query: str, limit: int = 20, index: SearchIndex | None = None) -> DataFrame:
    """As search_symbols without a kind, but the fallback, also of a query that does not parse, looks into names and documentation."""
    text = prepare(query)
    nothing = symbols.withColumn("rank", F.lit(0.0)).limit(0)
    try:
        best = limited(symbols.join(_ranked(symbols, parse(text), index), "symbol_id"), ["rank", "symbol_id"], limit) if text else nothing
    except QueryError:
        best = nothing
    none = best.agg(F.count(F.lit(1)).alias("hits")).where("hits = 0").select(F.lit(1).alias("_none"))
    held = symbols.where(like_anywhere(F.col("name"), query) | F.coalesce(like_anywhere(F.col("documentation"), query), F.lit(False)))
    other = held.crossJoin(F.broadcast(none)).drop("_none")  # one row or none
    return best.unionByName(limited(other.withColumn("rank", F.lit(0.0)), ["name", "symbol_id"], limit))


def postings(symbols: DataFrame) -> DataFrame:
    """(term, symbol_id, tf): the inverted index, for tables that are searched often; write it sorted by term."""
    every = F.concat(*[tokens(F.col(c)) for c in COLUMNS])
    return symbols.select("symbol_id", F.explode(every).alias("term")).groupBy("term", "symbol_id").agg(F.count(F.lit(1)).alias("tf"))
