"""Personal information in free text (problem 10): recognisers and a skip-chain conditional random field."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Set
from functools import lru_cache
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import by_slices
from quern.plans.tables import cut_lineage

# ---- spans of a fixed form ------------------------------------------------------------------------------

_AT = r"(?:[@＠]|[ \t]?(?:\[at\]|\(at\)|\{at\}|\(a\))[ \t]?|[ \t]at[ \t](?=[\w-]+[ \t](?:dot|\[dot\]|\(dot\))))"
_DOT = r"(?:\.|[ \t]?(?:\[dot\]|\(dot\)|\{dot\})[ \t]?|[ \t]dot[ \t])"
EMAIL = re.compile(rf"(?<![\w.+@/-])(?!git@)[A-Za-z0-9_][\w.+%-]*{_AT}[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,}}(?![\w@]|:[\w/]|-\w)", re.I)
PHONE = re.compile(
    r"(?<![\w.+/-])(?:\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,8}){1,5}|00\d{2}[ .-]?(?:\(0\)[ ]?)?\d{2,4}(?:[ ./-]?\d{2,8}){1,4}"
    r"|\(0?\d{2,4}\)[ ]?\d{3,4}[ .-]\d{3,4}|0\d{2,4}/\d{3,6}(?:-\d{1,4})?|0\d(?:([ .-])\d{2})(?:\1\d{2}){3}|0\d{2,3}[ -]\d{3,4}[ -]\d{3,4}|[2-9]?\d{2}([.-])\d{3}\2\d{4})(?![\w/]|[.-]\d)"
)
ID_NUMBER = re.compile(
    r"(?<![\w.+/-])(?:\d{3}([- ])\d{2}\1\d{4}|[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]\d{7}[A-Z]|[A-Z]\d{8}|\d{2} \d{3} \d{3} \d{3})(?![\w/]|[.-]\d)"
)
#: Words for streets by language.
_STREET_EN = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Way|Crescent|Cres\.?|Drive|Dr\.|Court|Ct\.|Place|Pl\.|Square|Sq\.|Terrace|Close|Row|Hill|Gardens|Boulevard|Blvd\.?|Mews|Walk|Grove|Parade)"
_STREET_FR = r"(?:rue|avenue|boulevard|bd|impasse|place|all[ée]e|chemin|quai|cours|square|passage|route|sentier)"
_STREET_ES = r"(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|P\.º|Camino|Ronda|Carrer|Traves[ií]a)"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_TOWN = rf"(?:,[ ]?(?:\d{{4,5}}[ ])?{_CAP}(?:[ ](?:am|an|auf|im|in|sur|de|del|la|le|les|der|dem|upon)(?:[ ](?:la|le|les|der|dem|los))?[ ]{_CAP}|[ ]{_CAP}){{0,2}})?"
ADDRESS = re.compile(
    rf"(?<![\w.,/-])(?:\d{{1,4}}[a-z]?[ ](?:{_CAP}[ ]){{1,3}}{_STREET_EN}(?!\w)(?:,[ ]?(?:Flat|Apt\.?|Unit|Suite|No\.)[ ]\w+)?{_TOWN}"
    rf"|\d{{1,4}}(?:[ ]?(?:bis|ter|quater))?,?[ ]{_STREET_FR}[ ](?:(?:du|de|des|de la|de l'|d'|aux?)[ ]?)?{_CAP}(?:[ -]{_CAP})*{_TOWN}"
    rf"|(?:{_CAP}(?:stra(?:ß|ss)e|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig|graben|pfad|hof|markt)|(?:Am|An der|Auf der|Im|In der|Zum|Zur|Unter den|Hinter der)[ ]{_CAP}(?:[ -]{_CAP})?|{_CAP}[ -](?:Stra(?:ß|ss)e|Allee|Platz|Weg|Gasse))[ ]\d{{1,4}}(?:[ ]?[a-f](?!\w))?{_TOWN}"
    rf"|{_STREET_ES}[ ](?:(?:del|de la|de los|de las|de|la|el)[ ])?{_CAP}(?:[ ]{_CAP})*,?[ ](?:n\.?º[ ])?\d{{1,4}}(?:,[ ]?\d{{1,2}}\.?º[ ]?\w{{0,4}})?{_TOWN})"
)
_FORMS = (("email", EMAIL), ("address", ADDRESS), ("id_number", ID_NUMBER), ("phone", PHONE))
#: What may be a mention of a kind though its form alone does not say so; the field decides.
_LOOSE = (
    ("email", re.compile(r"(?<![\w.@/-])[\w.+-]+[ ]?(?:@|\(at\)|\[at\])[ ]?[\w-]+(?:\.[\w-]+)+(?![\w@:/-])", re.I)),
    ("address", re.compile(rf"(?<![\w.,/-])(?:\d{{1,4}}[a-z]?,?[ ](?:{_CAP}[ ]){{1,2}}{_CAP}|{_CAP}(?:[ ]{_CAP}){{0,2}}[ ]\d{{1,4}}[a-f]?),[ ]?(?:\d{{4,5}}[ ])?{_CAP}")),
    ("id_number", re.compile(r"(?<![\w.+/-])(?:\d{3}[ .-]\d{2}[ .-]\d{4}|[A-Z]{1,2}[ -]?\d{6,9}[ -]?[A-Z]?|\d{2,3}(?:[ .-]\d{3}){2,3}(?:-?[A-Z])?)(?![\w/]|[.-]\d)")),
    ("phone", re.compile(r"(?<![\w.+/-])(?:\+|\(?0)\d[\d ()./-]{5,17}\d(?![\w/]|[.-]\d)")),
)


#: What a line must hold for a mention of a kind: no form of that kind can match without it.
_NEEDS_AT = re.compile(r"@(?:(?<=[\w.+%-]@)|(?<=[\w.+-] @))|＠|\([aA][tT]?\)|\[[aA][tT]\]|\{[aA][tT]\}")
_NEEDS_SPELLED_AT = re.compile(r"[ \t][aA][tT][ \t][\w-]+[ \t][(\[]?[dD][oO][tT]")
#: Eight digits with nothing but what may stand within a number between them, or six behind a capital.
_NEEDS_DIGITS = re.compile(r"\d(?:[ ./()-]*\d){7}|[A-Z][ -]?\d(?:[ -]?\d){5}")
_NEEDS_PLACE = re.compile(rf"\d(?:[a-z]|[ ]?(?:bis|ter|quater))?,?[ ](?:[A-ZÀ-ÖØ-Þ]|{_STREET_FR})|{_CAP}[.,]?[ ](?:n\.?º[ ])?\d")
_DIGIT = re.compile(r"\d")
#: The first alternative of ``_NEEDS_PLACE``, from its digit.
_BEFORE_PLACE = re.compile(rf"\d(?:[a-z]|[ ]?(?:bis|ter|quater))?,?[ ](?:[A-ZÀ-ÖØ-Þ]|{_STREET_FR})")


def _table(some: str, *more: tuple[str, str]) -> bytes:
    """A table over Latin-1, in which all other characters are question marks: 1 for the given characters and ranges."""
    return bytes(c in map(ord, some) or any(ord(a) <= c <= ord(b) for a, b in more) for c in range(256))


_CAPITALS = (("A", "Z"), ("À", "Ö"), ("Ø", "Þ"))
_WORD = bytes(chr(c).isalnum() or chr(c) in "_?" for c in range(256))
#: Tables for arrays of some characters: what may stand before an at sign, before the space before one, within a number, and before the space before a number.
_BEFORE_AT, _BEFORE_SPACE_AT, _WITHIN, _BEFORE_SPACE = (np.frombuffer(t, bool) for t in (bytes(map(max, _WORD, _table(".+%-"))), bytes(map(max, _WORD, _table(".+-"))), _table(" ./()-"), bytes(map(max, _WORD, _table("'-.,º")))))
_AZ, _SMALL, _CAPITAL = (np.frombuffer(_table("", *r), bool) for r in ((("A", "Z"),), (("a", "z"),), _CAPITALS))
#: What opens a place behind a number: a capital, or the first two letters of a word for streets, or of bis, ter and quater.
_OPENS_PLACE, _SECOND = np.frombuffer(_table("rabipcqst", *_CAPITALS), bool), np.frombuffer(_table("uvoldmahqei"), bool)
_BTQ, _IEU = np.frombuffer(_table("btq"), bool), np.frombuffer(_table("ieu"), bool)
#: Tables for whole texts: small letters and spaces for tabs, capitals and the sign for "number", ends of words.
_PLAIN, _IS_CAPITAL, _IS_GAP = bytes(range(256)).lower().replace(b"\t", b" "), _table("º", *_CAPITALS), _table(" \n")
_ASCII = bytes(range(128))


def possible(text: str) -> set[str]:
    """The kinds of which a line may hold a mention."""
    may = {"email"} if _NEEDS_AT.search(text) or _NEEDS_SPELLED_AT.search(text) else set()
    if _DIGIT.search(text):
        if _NEEDS_DIGITS.search(text):
            may |= {"id_number", "phone"}
        if _NEEDS_PLACE.search(text):
            may.add("address")
    return may


def _all_at(text: bytes | str, some: bytes | str) -> Iterator[int]:
    at = text.find(some)
    while at >= 0:
        yield at
        at = text.find(some, at + 1)


#: Bits for kinds, for lines that may hold a mention of them.
_EMAIL, _NUMBER, _PLACE = 1, 2, 4
_KINDS = [frozenset(k for bit, some in ((_EMAIL, ["email"]), (_NUMBER, ["id_number", "phone"]), (_PLACE, ["address"])) if bits & bit for k in some) for bits in range(8)]


def _lines_by_kind(text: str) -> list[tuple[int, int, int]]:
    """(start, end, bits for kinds) of the lines that may hold a mention, in order; no other line, or kind, has a candidate."""
    raw = text.encode("latin-1", "replace")
    padded = b"\n\n" + raw + b"\n" * 6
    marks = np.frombuffer(padded, np.uint8)
    found: list[tuple[int, np.ndarray]] = []
    hits: list[int] = []
    plain = raw.translate(_PLAIN)
    for some in (b"(a)", b"(at)", b"[at]", b"{at}"):
        hits += _all_at(plain, some)
    hits += _all_at(text, "＠")
    if b"dot" in plain:
        hits += (at for at in _all_at(plain, b" at ") if _NEEDS_SPELLED_AT.match(text, at))
    at = np.flatnonzero(marks == 64)
    before = marks[at - 1]
    found += [(_EMAIL, np.array(hits, np.int64) + 2), (_EMAIL, at[_BEFORE_AT[before] | (before == 32) & _BEFORE_SPACE_AT[marks[at - 2]]])]
    if not text.isascii() and _DIGIT.search(text.encode("utf-8", "replace").translate(None, _ASCII).decode("utf-8", "replace")):
        # digits of other scripts
        found += [(bit, np.array([m.start() + 2 for m in rx.finditer(text)], np.int64)) for bit, rx in ((_NUMBER, _NEEDS_DIGITS), (_PLACE, _NEEDS_PLACE))]
    digits = np.flatnonzero(marks - np.uint8(48) < 10)
    if len(digits):
        a, before = marks[digits + 1], marks[digits - 1]
        # numbers: digits side by side or, as it seems, with nothing between them but what may stand within a number
        apart = np.ones(len(digits), np.int32)
        apart[1:] = (np.diff(digits) > 1) & ~(_WITHIN[a[:-1]] & _WITHIN[before[1:]])
        run = np.cumsum(apart)
        found.append((_NUMBER, digits[:-7][run[7:] == run[:-7]]))
        six = np.flatnonzero(run[5:] == run[:-5])
        b, c = before[six], marks[digits[six] - 2]
        found.append((_NUMBER, digits[six[_AZ[b] | ((b == 32) | (b == 45)) & _AZ[c]]]))
        # a number behind a word with a capital
        ends = digits[before == 32] - 1
        ends = ends[_BEFORE_SPACE[marks[ends - 1]]]
        if len(ends):
            capitals, gaps = (np.flatnonzero(np.frombuffer(padded.translate(t), bool)) for t in (_IS_CAPITAL, _IS_GAP))
            at = np.searchsorted(capitals, ends) - 1
            ends, at = ends[at >= 0], at[at >= 0]
            found.append((_PLACE, ends[capitals[at] > gaps[np.searchsorted(gaps, ends) - 1]]))
        # a number before a capital or a word for streets
        near = digits[(a == 32) | (a == 44) | _SMALL[a]]
        a, b, c, d, e = (marks[near + k] for k in range(1, 6))
        opens = lambda x, y: _OPENS_PLACE[x] & (_CAPITAL[x] | _SECOND[y])
        may = (a == 32) & opens(b, c) | (a == 44) & (b == 32) & opens(c, d) | _SMALL[a] & ((b == 32) & opens(c, d) | (b == 44) & (c == 32) & opens(d, e)) | _BTQ[a] & _IEU[b]
        found.append((_PLACE, np.array([at for at in near[may].tolist() if _BEFORE_PLACE.match(text, at - 2)], np.int64)))
    ends = np.flatnonzero(marks == 10)
    bits: dict[int, int] = defaultdict(int)
    for bit, at in found:
        for line in np.unique(np.searchsorted(ends, at)).tolist():
            bits[line] |= bit
    if not bits:
        return []
    lines = sorted(bits)
    at = np.array(lines)
    return list(zip((ends[at - 1] - 1).tolist(), (ends[at] - 2).tolist(), map(bits.get, lines)))


def lines_with_forms(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines of a text that may hold a mention, in order; no other line has a candidate."""
    return [(s, e) for s, e, _ in _lines_by_kind(text)]


def candidates(text: str, may: Set[str] | None = None) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, whether its form alone is that of the kind) of what may be a mention, in order, none overlapping; forms come before loose ones, the earlier kind first."""
    taken: list[tuple[int, int, str, bool]] = []
    may = possible(text) if may is None else may
    if "phone" in may and not _NEEDS_DIGITS.search(text):
        may = may - _KINDS[_NUMBER]
    if not may:
        return taken
    for sure, forms in ((True, _FORMS), (False, _LOOSE)):
        for kind, rx in forms:
            if kind not in may:
                continue
            for m in rx.finditer(text):
                if kind == "phone" and not 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    continue
                if all(m.end() <= s or m.start() >= e for s, e, _, _ in taken):
                    taken.append((m.start(), m.end(), kind, sure))
    return sorted(taken)


#: Lines of source texts repeat.
_remembered = lru_cache(20_000)(candidates)


def spans_of_form(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of spans recognised by their form, in order, none overlapping; the earlier kind wins."""
    return [(s, e, k) for s, e, k, sure in candidates(text) if sure]


_LEFT, _RIGHT = re.compile(r"([^\W\d_]+)[^\w\n]*\Z"), re.compile(r"[^\w\n]*([^\W\d_]+)")


def around(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a span in its line, lower case; ^ and $ where the line has none."""
    a, b = _LEFT.search(text, max(0, start - 40), start), _RIGHT.match(text, end, end + 40)
    return (a.group(1).lower() if a else "^"), (b.group(1).lower() if b else "$")


# ---- potentials for names -------------------------------------------------------------------------------

#: A final point stays with an initial only.
_TOKEN = re.compile(r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*|[^\W\d_](?:(?:['’-][^\W\d_]+)+|\.?)|\d+|[^\w\s]")


def is_initial(w: str) -> bool:
    return len(w) == 2 and w[1] == "." and w[0].isalpha()


#: Titles that stand before a name and are not part of it.
TITLES = frozenset("mr mrs ms miss dr prof herr frau fräulein mme mlle monsieur madame señor señora sr sra don doña sir".split())


class Memo(dict):
    """What a function gives, remembered; all is forgotten when there are too many."""

    def __init__(self, f: Callable, most: int = 100_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        got = self[key] = self.f(key)
        return got


class Potentials:
    """Log-odds that a token belongs to a person's name, given the lexicon, its shape and its neighbours."""

    def __init__(self, given: Iterable[str], family: Iterable[str]):
        self.role: dict[str, str] = {w.lower(): "family" for w in family} | {w.lower(): "given" for w in given}
        self.before: dict[str, float] = {}
        self.after: dict[str, float] = {}
        self.ordinary: frozenset[str] = frozenset()
        #: Words met so often that they would be names by now if they were.
        self.refused: frozenset[str] = frozenset()

        #: Weights of the features of a word, of a form by kind, and of the edges; ``train`` sets them.
        self.word: list[float] = [-2.6, 4.2, 1.6, 0.4, -4.5, -1.0, 0.8, 0.56, 0.0, -1.0]
        self.form: dict[str, list[float]] = {}
        self.loose: dict[str, float] = {}
        self.cues: dict[str, tuple[dict[str, float], dict[str, float]]] = {}
        self.chain: dict[str, float] = {"sure": 4.0, "space": 2.2, "comma": 1.0}
        self.skip: dict[str, float] = {"same": 1.2, "similar": 0.5, "form": 2.0}
        self.forget()

    def forget(self) -> None:
        """To be called when the lexicon or the weights have changed: what follows from them is remembered."""
        self.known_lines: dict[str, list[tuple[str, int, int, float]]] = {}
        #: By line of source: whether it may hold names.
        self.named = Memo(lambda line: _source_name_line(line, self), 20_000)
        #: By word: how it may be part of a name beside others; its score, where it is fixed, and its features without those of cues; the same, as written by ``count_labels``.
        self.parts, self.looks, self.written = Memo(self._part), Memo(self._look), Memo(self._write)

    def state(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known_lines", "named", "parts", "looks", "written")}

    @classmethod
    def of(cls, state: dict) -> Potentials:
        p = cls((), ())
        p.__dict__.update(state)
        return p

    def fit(self, texts: list[str], sources: Iterable[str] = (), rounds: int = 2) -> Potentials:
        """Estimates from texts at hand, see ``learn``."""
        lines: Counter = Counter()
        facts: Tally = defaultdict(lambda: [0] * WIDTH)
        for t, source, parts in all_parts([*((t, False) for t in texts), *((t, True) for t in sources)]):
            count_text(t, source, parts, lines, facts)
        return self.learn(Counts(lines, facts), rounds)

    def learn(self, counts: Counts, rounds: int = 2) -> Potentials:
        """Piecewise estimates from the counts of all texts, in which the known names are the labels.

        The weight of a neighbour is the log-odds ratio of standing beside a known name against standing beside
        another capitalised word. Words that score as names again and again by their neighbours join the lexicon
        with the role of their place, and the weights are estimated once more.
        """
        self.forget()
        words = counts.words()
        self.ordinary = frozenset(w for w, (low, up, *_) in words.items() if low >= 3 and up and w not in self.role and low > 0.5 * up)
        for _ in range(rounds):
            beside = counts.over(count_neighbours, self, "n0 + n1 >= 3 OR key = ''")
            pos, neg = beside.pop(("",), (0, 0))[:2]
            base = math.log((pos + 1) / (neg + 1))
            weigh = lambda side: {k[1]: steps(max(-2.0, min(4.0, math.log((p + 0.3) / (n + 1.0)) - base))) for k, (p, n, *_) in beside.items() if k[0] == side and p + n >= 3}  # noqa: B023, E731
            self.before, self.after = weigh("b"), weigh("a")
            self.forget()
            votes = counts.over(count_votes, self, "n0 >= 3 AND n2 >= 0.6 * n0")
            for (w,), (n, least, more, family, given) in votes.items():
                # the upper median of the scores is at least 1
                if n >= 3 and least >= n - n // 2 and family + given >= 0.2 * n and more >= 0.6 * n:
                    self.role[w] = "family" if family >= given else "given"
            self.forget()
        self.refused = frozenset(w for w, (_, _, n, *_) in words.items() if n >= 3 and w not in self.role)
        self.forget()
        self.train_forms(counts)
        self.train_words(counts.over(count_labels, self, "true", everywhere=True))
        self.forget()
        return self

    def train_forms(self, counts: Counts) -> None:
        """Weights of forms: what has the form of a kind against what only may be one, by their neighbours.

        The form itself is hidden from a third of the rows, so that the words around get weights of their own.
        """
        sides, pairs = counts.form_sides()
        total = {k[0]: n for k, n in sides.items() if len(k) == 1}
        for kind, (good, bad, *_) in total.items():
            base = math.log((good + 1) / (bad + 1))
            cues = [{k[2]: steps(max(-3.0, min(3.0, math.log((g + 0.5) / (b + 0.5)) - base))) for k, (g, b, *_) in sides.items() if len(k) == 3 and k[:2] == (kind, side) and g + b >= 3} for side in "ba"]
            self.cues[kind] = (cues[0], cues[1])
        rows: dict[str, list[tuple[list[float], float, float]]] = defaultdict(list)
        for (kind, left, right), (good, bad, *_) in counts.form_rows(self).items():
            cue = [float(left), float(right)]
            rows[kind] += [([1.0, 1.0, *cue], 1.0, good * 2 / 3), ([1.0, 0.0, *cue], 1.0, good / 3), ([1.0, 0.0, *cue], 0.0, float(bad))]
        for kind, got in sorted(rows.items()):
            x, y, n = (np.array(v, float) for v in zip(*sorted(r for r in got if r[2])))
            self.form[kind] = logistic(x, y, n)
            # what only may be of the kind starts from how often it is met, not from the rows whose form was hidden
            self.loose[kind] = -math.log(2 * total[kind][1] + 1)
        self.skip["form"] = max(0.5, min(3.0, math.log((pairs[0] + 1) / (pairs[1] + 1))))

    def train_words(self, got: dict[tuple[str, ...], list[int]]) -> None:
        """Weights of words and edges from the counts of lines in which the words of the lexicon are the labels."""
        rows = sorted(([float(v) for v in k[2:]], float(k[1]), float(n[0])) for k, n in got.items() if k[0] == "x")
        if sum(r[2] for r in rows) < 200 or len({r[1] for r in rows}) < 2:
            return
        x, y, n = (np.array(v, float) for v in zip(*rows))
        self.word = logistic(x, y, n)
        for gap in ("space", "comma"):
            n = lambda a, b: got.get((gap, str(a), str(b)), [0])[0] + 0.5  # noqa: B023, E731
            # half of the log-odds ratio: both words see the same cues, so each tells the other little more
            self.chain[gap] = max(0.3, min(4.0, 0.5 * math.log(n(1, 1) * n(0, 0) / (n(1, 0) * n(0, 1)))))
        self.chain["sure"] = max(self.chain["space"], min(5.0, 2.0 * self.chain["space"]))
        alike, apart = ([got.get((k, "1"), [0])[0] + 1, got.get((k, "0"), [0])[0] + 1] for k in ("alike", "apart"))
        self.skip["same"] = max(0.3, min(1.5, 0.5 * math.log(alike[0] / alike[1])))
        self.skip["similar"] = max(0.0, min(self.skip["same"], 0.25 * math.log(apart[0] / apart[1])))

    def shape(self, w: str, hidden: bool = False) -> tuple[list[float], list[float]]:
        """The features of a word without those of its cues: bias, known, known in lower case, initial, ordinary word, other word; all in capitals, met often and no name."""
        low = w.lower()
        known = low in self.role and not hidden
        large = self.looks_like(w)
        initial = is_initial(w) and large
        ordinary = not known and not initial and low.rstrip(".") in self.ordinary
        refused = not known and not hidden and low in self.refused
        other = not known and not initial and not ordinary and not refused
        return [1.0, float(known and large), float(known and not large), float(initial and not known), float(ordinary), float(other)], [float(len(w) > 3 and w.isupper() and not known), float(refused)]

    def _write(self, w: str) -> tuple[list[str], list[str]]:
        head, tail = self.shape(w, hidden=zlib.crc32(w.lower().encode()) % 2 == 0)
        return list(map(str, head)), list(map(str, tail))

    def cues_of(self, toks: list[str], i: int) -> tuple[float, float]:
        """The features of a word that come between those of its shape: cue before, cue after."""
        b, a = self.context(toks, i)
        return max(-2.0, min(4.5, self.before.get(b, -0.5))), max(-2.0, min(4.5, self.after.get(a, 0.0)))

    def form_score(self, text: str, start: int, end: int, kind: str, sure: bool) -> float:
        """Log-odds that a candidate is a mention of its kind."""
        if kind not in self.form:
            return 3.0 if sure else -3.0
        b, a = around(text, start, end)
        before, after = self.cues[kind]
        bias, form, left, right = self.form[kind]
        return (bias + form if sure else self.loose[kind]) + left * before.get(b, 0.0) + right * after.get(a, 0.0)

    @staticmethod
    def looks_like(w: str) -> bool:
        return w[0].isupper() and (len(w) > 1 or w.isalpha())

    def context(self, toks: list[str], i: int) -> tuple[str, str]:
        """What stands before and after; parts of the same name are skipped, so that all its words see the cue.

        An unknown capitalised word is skipped too unless it opens a sentence.
        """

        parts = self.parts
        b = i - 1
        while b >= 0 and i - b < 4 and (how := parts[toks[b]]) and (how == 1 or self._joins(toks, b, how)):
            b -= 1
        a = i + 1
        while a < len(toks) and a - i < 4 and toks[a] != "," and (how := parts[toks[a]]) and (how == 1 or self._joins(toks, a, how)):
            a += 1
        left = toks[b].lower() if b >= 0 else "^"
        if left in (",", ":", "(") and b > 0:
            left = toks[b - 1].lower() + left
        return left, (toks[a].lower() if a < len(toks) else "$")

    def _part(self, w: str) -> int:
        """Whether a word is part of a name beside others: 0 never, 1 always, 2 a comma behind a family name, 3 behind a word."""
        low = w.lower()
        if low in self.role or is_initial(w):
            return 1
        if w == ",":
            return 2
        return 3 if self.looks_like(w) and low.rstrip(".") not in TITLES and self.before.get(low, 0.0) < 1.5 else 0

    def _joins(self, toks: list[str], k: int, how: int) -> bool:
        if how == 2:
            return 0 < k < len(toks) - 1 and self.role.get(toks[k - 1].lower()) == "family"
        return k > 0 and toks[k - 1][0].isalpha()

    def nodes(self, line: str) -> list[tuple[str, int, int, float]]:
        """(word, start, end, score) of the words of a line that may be of a name; an empty word where a chain of them ends. Lines met again are remembered."""
        got = self.known_lines.get(line)
        if got is None:
            words = _TOKEN.findall(line)
            got = []
            after = at = k = 0
            looks = self.looks
            for i in [i for i, w in enumerate(words) if looks[w] is not None]:
                # between two tokens there is nothing that a token may hold
                while k < i:
                    at = line.index(words[k], at) + len(words[k])
                    k += 1
                w = words[i]
                a = line.index(w, at)
                u = self.unary(words, i)
                if got and got[-1][0] and (u <= -8.0 or any(x != "," for x in words[after:i])):
                    got.append(("", a, a, u))
                if u > -8.0:
                    got.append((w, a, a + len(w), u))
                    after = i + 1
            if len(self.known_lines) >= 20_000:
                self.known_lines.clear()
            if len(line) < 1000:
                self.known_lines[line] = got
        return got

    def _look(self, w: str) -> tuple[float | None, list[float], list[float]] | None:
        """None for a word that can't be of a name. Else its score if that is fixed, and its shape."""
        low = w.lower()
        if low not in self.role:
            if not w[0].isupper():
                return None
            if not self.looks_like(w) or low.rstrip(".") in TITLES:
                return -9.0, [], []
            if max(self.before.get(low + end, 0.0) for end in ("", ",", ":")) >= 2.0:
                return -7.0, [], []  # a word that announces names is none
        return None, *self.shape(w)

    def unary(self, toks: list[str], i: int) -> float:
        score, head, tail = self.looks[toks[i]] or (-9.0, [], [])
        return float(sum(map(mul, self.word, [*head, *self.cues_of(toks, i), *tail]))) if score is None else score


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, ridge: float = 1e-5, rounds: int = 60) -> list[float]:
    """Weights of a logistic regression by Newton's method, with a small ridge; each row counts n times."""
    w = np.zeros(x.shape[1])
    n = np.ones(len(y)) if n is None else n
    ridge *= n.sum()
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def value_of(kind: str, span: str) -> str:
    """What makes two mentions the same: digits, or letters in lower case, without what stands between."""
    return re.sub(r"\D", "", span)[-8:] if kind == "phone" else re.sub(r"[\W_]", "", span.lower())


def stem_of(low: str) -> str:
    """Words of one stem are similar: their first letters agree, six of long words and four of others; what follows an apostrophe is no matter."""
    head = re.split(r"['’]", low)[0]
    return head[:6] if len(head) > 6 else head[:4]


def hide(line: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """The line with a mark and blanks in place of the spans, of the same length."""
    for s, e, _ in spans:
        line = line[:s] + "\x01" + " " * (e - s - 1) + line[e:]
    return line


def infer(unary: list[float], edges: list[tuple[int, int, float, bool]], rounds: int = 12) -> list[float]:
    """Loopy belief propagation on binary labels: log-odds of each node.

    An edge (i, j, weight, both) of the chain rewards the labels being both 1; a skip edge (both false) rewards
    equal labels.
    """
    near: list[list[int]] = [[] for _ in unary]
    for k, (i, j, _, _) in enumerate(edges):
        near[i].append(k)
        near[j].append(k)
    to_j, to_i = [0.0] * len(edges), [0.0] * len(edges)
    belief = list(unary)
    soft = lambda x: x if x > 30 else (math.exp(x) if x < -30 else math.log1p(math.exp(x)))
    for _ in range(rounds):
        moved = 0.0
        for k, (i, j, w, both) in enumerate(edges):
            for src, out, back in ((i, to_j, to_i), (j, to_i, to_j)):
                h = belief[src] - back[k]
                # equal labels: log (e^(h+w) + 1) / (e^h + e^w), from the label of src to the other end
                m = soft(h + w) - soft(h) if both else soft(h + w) - (max(h, w) + math.log1p(math.exp(-abs(h - w))))
                dst = j if src == i else i
                belief[dst] += m - out[k]
                moved = max(moved, abs(m - out[k]))
                out[k] = m
        if moved < 1e-3:
            break
    return belief


def shown(text: str, lines: list[tuple[int, int]], found: list[tuple[int, int, str, bool]]) -> Iterator[tuple[int, str]]:
    """Start and text of each of the lines. A span of a fixed form is no word: what it covers is hidden behind one mark."""
    taken = [x for x in found if x[3]]
    if not taken:
        yield from ((s, text[s:e]) for s, e in lines)
        return
    at = 0
    for s, e in lines:
        line = text[s:e]
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        k = at
        while k < len(taken) and taken[k][0] < e:
            line = hide(line, [(max(taken[k][0], s) - s, min(taken[k][1], e) - s, "")])
            k += 1
        yield s, line


_SPACE = re.compile(r"[ \t]+\Z")


def mentions(text: str, lines: list[tuple[int, int]], found: list[tuple[int, int, str, bool]], p: Potentials) -> list[tuple[int, int, str]]:
    """Mentions of all kinds in a text, by one field over its candidates and the words of the given lines.

    Words side by side share an edge of the chain. Equal and similar words anywhere in the text share a skip edge, with
    the first and with the last one before, and so do candidates of one value, so that what is sure in one place decides elsewhere.
    """
    toks: list[tuple[str, int, int]] = []
    unary: list[float] = []
    edges: list[tuple[int, int, float, bool]] = []
    values: dict[tuple[str, str], list[int]] = {}
    for s, e, kind, sure in found:
        n = len(toks)
        toks.append(("", s, e))
        unary.append(p.form_score(text, s, e, kind, sure))
        held = values.setdefault((kind, value_of(kind, text[s:e])), [])
        edges += [(m, n, p.skip["form"], False) for m in {*held[:1], *held[-1:]}]
        held.append(n)
    n_forms = len(toks)
    where: dict[str, list[tuple[int, str]]] = {}
    for s, line in shown(text, lines, found):
        base = -1
        for w, a, b, u in p.nodes(line):
            if not w:
                base = -1
                continue
            n = len(toks)
            toks.append((w, s + a, s + b))
            unary.append(u)
            if base >= 0:
                gap = text[toks[base][2] : s + a]
                if _SPACE.fullmatch(gap):
                    sure = all(x.lower() in p.role or is_initial(x) for x in (toks[base][0], w))
                    edges.append((base, n, p.chain["sure" if sure else "space"], True))
                elif re.fullmatch(r",[ \t]+", gap):
                    turned = p.role.get(toks[base][0].lower(), "family") == "family" and p.role.get(w.lower(), "given") == "given"
                    edges.append((base, n, p.chain["comma"] if turned else 0.3, True))
            base = n
            low = w.lower()
            if len(w) > 2:
                held = where.setdefault(stem_of(low), [])
                edges += [(m, n, p.skip["same" if other == low else "similar"], False) for m, other in dict.fromkeys([*held[:1], *held[-1:]])]
                held.append((n, low))
    if not toks:
        return []
    belief = infer(unary, edges)
    forms = [(s, e, kind) for (s, e, kind, _), b in zip(found, belief) if b > 0]
    out: list[tuple[int, int, str]] = []
    last, role = -1, ""
    for n, (w, s, e) in enumerate(toks):
        if n < n_forms or belief[n] <= 0:
            continue
        mine = p.role.get(w.lower(), "given" if is_initial(w) else "")
        gap = text[toks[last][2] : s] if last >= 0 else "\n"
        joined = last == n - 1 and last >= n_forms and (_SPACE.fullmatch(gap) or (re.fullmatch(r",[ \t]+", gap) and role in ("family", "") and mine != "family" and w.lower() != toks[last][0].lower()))
        if joined and out:
            out[-1] = (out[-1][0], e, "name")
        elif not (is_initial(w) and len(w) == 2 and (n + 1 >= len(toks) or belief[n + 1] <= 0 or not _SPACE.fullmatch(text[e : toks[n + 1][1]]))):
            out.append((s, e, "name"))  # an initial alone is no name
        else:
            continue
        last, role = n, mine
    sure = {x[:3] for x in found if x[3]}
    loose = [x for x in forms if x not in sure]
    return sorted(forms + [x for x in out if all(x[1] <= s or x[0] >= e for s, e, _ in loose)])


#: Comments, docstrings and string literals of any of the languages. What is left open ends with its line.
_WORDING = re.compile(
    r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|/\*[\s\S]*?\*/|=(?m:(?<=^=))begin\b[\s\S]*?(?m:^)=end\b|<!--[\s\S]*?-->|`[^`]*`"
    r"|//[^\n]*|#[^\n]*|--[^\n]*|;;[^\n]*|/\*[^\n]*|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"
)


Parts = tuple[list[tuple[int, int, str, bool]], list[tuple[int, int]]]


def forms_of(texts: list[str], piece: int = 1 << 20) -> list[list[tuple[int, int, str, bool]]]:
    """The candidates of every line of each text. Lines are looked at as one text, cut into pieces at line ends: no mention goes over a line."""
    out: list[list[tuple[int, int, str, bool]]] = [[] for _ in texts]
    whole = "\n".join(texts)
    own, begin, end = -1, 0, -1
    at = 0
    while at < len(whole):
        to = whole.find("\n", at + piece)
        to = len(whole) if to < 0 else to
        part = whole[at:to]
        for s, e, bits in _lines_by_kind(part):
            if got := (candidates if e - s > 500 else _remembered)(part[s:e], _KINDS[bits]):
                s += at
                while s > end:  # the text that has the line
                    own += 1
                    begin, end = end + 1, end + 1 + len(texts[own])
                out[own] += [(s - begin + a, s - begin + b, k, sure) for a, b, k, sure in got]
        at = to + 1
    return out


def name_lines(text: str, source: bool) -> list[tuple[int, int]]:
    """(start, end) of the lines to be read for names: all of prose, what is not only code of source."""
    lines = []
    for start, end in (m.span() for m in _WORDING.finditer(text)) if source else ((0, len(text)),):
        to = text.find("\n", start, end)
        while to >= 0:
            if start < to and not text[start:to].isspace():
                lines.append((start, to))
            start = to + 1
            to = text.find("\n", start, end)
        if start < end and not text[start:end].isspace():
            lines.append((start, end))
    return lines


def all_parts(texts: Iterable[tuple[str, bool]], most: int = 1 << 20) -> Iterator[tuple[str, bool, Parts]]:
    """Each text with its parts, as ``parts_of`` has them; texts of about ``most`` characters are taken together."""
    held: list[tuple[str, bool]] = []
    size = 0

    def given() -> Iterator[tuple[str, bool, Parts]]:
        for (t, source), forms in zip(held, forms_of([t for t, _ in held])):
            yield t, source, (forms, name_lines(t, source))

    for x in texts:
        held.append(x)
        size += len(x[0])
        if size >= most:
            yield from given()
            held, size = [], 0
    yield from given()


def parts_of(text: str, source: bool) -> Parts:
    """The candidates of every line of a text, and the lines to be read for names."""
    return forms_of([text])[0], name_lines(text, source)


def find(text: str, source: bool, p: Potentials, parts: Parts | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal information of a text, in order."""
    forms, lines = parts or parts_of(text, source)
    if source:
        lines = [x for x in lines if (p.named[text[x[0] : x[1]]] if x[1] - x[0] < 1000 else _source_name_line(text[x[0] : x[1]], p))]
    return mentions(text, lines, forms, p)


_SOURCE_WORD = re.compile(r"[^\W\d_][\w'-]+")


def _source_name_line(line: str, p: Potentials) -> bool:
    if line.islower() or line.isascii() and line == line.lower():
        return not p.role.keys().isdisjoint(_SOURCE_WORD.findall(line))
    return any(w[0].isupper() or w.lower() in p.role for w in _SOURCE_WORD.findall(line))


# ---- counts of all texts --------------------------------------------------------------------------------

#: Sums by key; a key is a tuple of strings.
Tally = dict[tuple[str, ...], list[int]]
WIDTH, _SEP = 5, "\x1f"


def steps(weight: float) -> float:
    """A weight in steps of 1/32: however many texts there are, few pairs of weights differ, and their sums are exact."""
    return round(weight * 32) / 32


def count_text(text: str, source: bool, parts: Parts, seen_lines: Counter, out: Tally) -> None:
    """Adds what a text tells regardless of any model: its lines as they are shown, and the neighbours of candidates."""
    forms, lines = parts
    seen_lines.update(line for _, line in shown(text, lines, forms))
    if source:
        return
    seen: dict[tuple, bool] = {}
    for s, e, kind, sure in forms:
        start, end = text.rfind("\n", 0, s) + 1, text.find("\n", e)
        line = text[start : len(text) if end < 0 else end]
        out["f", kind, *around(line, s - start, e - start)][0 if sure else 1] += 1
        same = (kind, value_of(kind, text[s:e]))
        if same in seen:
            out["p",][0 if seen[same] == sure else 1] += 1
        seen[same] = sure


def count_tokens(line: str, n: int, words: Counter) -> tuple[str, list[str]] | None:
    """Adds the words of a line as they are written; gives the line as the places of its capitalised words, and tokens: L if it holds such a word, else l."""
    toks = _TOKEN.findall(line)
    if not toks:
        return None
    if n == 1:
        words.update(toks)
    else:
        for w in toks:
            words[w] += n
    large = large_words(toks) if line != line.lower() or not line.isascii() else []
    return "L" if large else "l", [" ".join(map(str, large)), *toks]


def count_words(words: Counter, out: Tally) -> None:
    """Adds how often words stand in small letters, in others, and capitalised."""
    for w, n in words.items():
        if len(w) > 1 and w[0].isalpha():
            v = out["w", w.lower().rstrip(".")]
            if w[0].islower():
                v[0] += n
            else:
                v[1] += n
                v[2] += n * (w[0].isupper() and len(w) > 2)
    words.clear()


def large_words(toks: list[str]) -> list[int]:
    return [i for i, w in enumerate(toks) if w[0].isupper() and (len(w) > 1 or w.isalpha())]


def count_neighbours(p: Potentials, toks: list[str], large: list[int], n: int, out: Tally) -> None:
    """How often a word stands before or after a known name, and another capitalised word."""
    total = out["",]
    for i in large:
        w = toks[i]
        if is_initial(w):
            continue
        side = 0 if w.lower() in p.role else 1
        b, a = p.context(toks, i)
        out["b", b][side] += n
        out["a", a][side] += n
        total[side] += n


def count_votes(p: Potentials, toks: list[str], large: list[int], n: int, out: Tally) -> None:
    """Of each unknown capitalised word: times met, with a score of at least 1, of more, beside a given name and beside a family name."""
    for i in large:
        w = toks[i]
        low = w.lower()
        if len(w) < 3 or low in p.role or low in p.ordinary or is_initial(w):
            continue
        b, a = p.context(toks, i)
        score = p.before.get(b, 0.0) + p.after.get(a, 0.0)
        v = out[low,]
        v[0] += n
        v[1] += n * (score >= 1.0)
        v[2] += n * (score > 1.0)
        nxt, prv = (toks[i + 1] if i + 1 < len(toks) else ""), (toks[i - 1] if i else "")
        if p.role.get(prv.lower()) == "given" or is_initial(prv):
            v[3] += n
        elif p.role.get(nxt.lower()) == "family" or (is_initial(nxt) and i + 2 < len(toks) and p.role.get(toks[i + 2].lower()) == "family"):
            v[4] += n


def count_labels(p: Potentials, toks: list[str], large: list[int], n: int, out: Tally) -> None:
    """Features and labels of words, labels of words side by side and of similar words of a line.

    Half of the lexicon is hidden from the features, so that the words around and the shape get weights of their own.
    """
    lows = list(map(str.lower, toks))
    if not large and p.role.keys().isdisjoint(lows):
        return
    roles = list(map(p.role.get, lows))
    big = set(large)
    # a known name in lower case is one beside a name of the other role
    labels = [r is not None and (i in big or any(0 <= j < len(roles) and roles[j] is not None and roles[j] != r for j in (i - 1, i + 1))) for i, r in enumerate(roles)]
    for i, r in enumerate(roles):
        if i not in big and r is None:
            continue
        w = toks[i]
        # an initial beside a name is part of it
        name = labels[i] = labels[i] or is_initial(w) and (i > 0 and labels[i - 1] or i + 1 < len(toks) and labels[i + 1])
        if r is not None or lows[i].rstrip(".") not in TITLES:
            head, tail = p.written[w]
            out["x", "1" if name else "0", *head, *map(str, p.cues_of(toks, i)), *tail][0] += n
    stems: dict[str, tuple[str, bool]] = {}
    for i in large:
        if i + 1 in big:
            out["space", str(int(labels[i])), str(int(labels[i + 1]))][0] += n
        elif i + 2 in big and toks[i + 1] == ",":
            out["comma", str(int(labels[i] and roles[i] == "family")), str(int(labels[i + 2] and roles[i + 2] == "given"))][0] += n
        low = toks[i].lower()
        if len(toks[i]) > 3:
            stem = stem_of(low)
            if stem in stems:
                other, was = stems[stem]
                out["alike" if other == low else "apart", str(int(was == labels[i]))][0] += n
            stems[stem] = (low, labels[i])


class Counts:
    """The counts of texts at hand."""

    def __init__(self, lines: Counter, facts: Tally):
        self.facts = facts
        words: Counter = Counter()
        for line, n in lines.items():
            if row := count_tokens(line, n, words):
                facts[row[0], *row[1]][0] += n
        count_words(words, facts)

    def words(self) -> Tally:
        return {k[1]: n for k, n in self.facts.items() if k[0] == "w"}

    def over(self, count: Callable, p: Potentials, keep: str, everywhere: bool = False) -> Tally:
        """Sums of what ``count`` adds for each line that holds a capital, or each line; ``keep`` tells which sums are of use."""
        out: Tally = defaultdict(lambda: [0] * WIDTH)
        for k, n in self.facts.items():
            if k[0] == "L" or everywhere and k[0] == "l":
                count(p, k[2:], list(map(int, k[1].split())), n[0], out)
        return out

    def form_sides(self) -> tuple[Tally, list[int]]:
        """By (kind), and by (kind, side, word): how often what stands there has the form, and only may have it; and the pairs of one value that agree, and not."""
        out: Tally = defaultdict(lambda: [0] * WIDTH)
        for k, n in self.facts.items():
            if k[0] == "f":
                for key in ((k[1],), (k[1], "b", k[2]), (k[1], "a", k[3])):
                    out[key][0] += n[0]
                    out[key][1] += n[1]
        return out, self.facts.get(("p",), [0, 0])[:2]

    def form_rows(self, p: Potentials) -> Tally:
        """The same by (kind, cue before, cue after)."""
        out: Tally = defaultdict(lambda: [0] * WIDTH)
        for k, n in self.facts.items():
            if k[0] == "f":
                got = out[k[1], str(p.cues[k[1]][0].get(k[2], 0.0)), str(p.cues[k[1]][1].get(k[3], 0.0))]
                got[0] += n[0]
                got[1] += n[1]
        return out


_SUMS = [f"n{i}" for i in range(WIDTH)]
_ROW = "tag string, key string, " + ", ".join(f"{c} bigint" for c in _SUMS)


def _batches(out: Tally, tagged: bool) -> Iterator[pa.RecordBatch]:
    """The sums as rows, and none is left: of a tagged key the first part is a column of its own."""
    keys = list(out)
    for at in range(0, len(keys), 20_000):
        some = keys[at : at + 20_000]
        sums = list(zip(*(out[k] for k in some)))
        tags = [k[0] if tagged else "" for k in some]
        names = [_SEP.join(k[1:] if tagged else k) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), pa.array(names, pa.string()), *(pa.array(s, pa.int64()) for s in sums)], ["tag", "key", *_SUMS])
    out.clear()


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tag", "key").agg(*(F.sum(c).alias(c) for c in _SUMS))


class SharedCounts(Counts):
    """The counts of a table of texts: added up by Spark; only sums over words and weights come to the driver."""

    def __init__(self, documents: DataFrame):
        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            out: Tally = defaultdict(lambda: [0] * WIDTH)

            def met() -> Iterator[pa.RecordBatch]:
                keys, none = list(seen), [0] * len(seen)
                for at in range(0, len(keys), 20_000):
                    some = keys[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(["l"] * len(some)), pa.array(some, pa.string()), pa.array([seen[k] for k in some]), *[pa.array(none[: len(some)], pa.int64())] * (WIDTH - 1)], ["tag", "key", *_SUMS])
                seen.clear()
                yield from _batches(out, True)

            size = 0
            for b in batches:
                rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for t, source, parts in all_parts((t, bool(source)) for source, t in rows if t):
                    count_text(t, source, parts, seen, out)
                    size += len(t)
                    if len(seen) + len(out) > 100_000 or size > 32 << 20:
                        yield from met()
                        size = 0
            yield from met()

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: Tally = defaultdict(lambda: [0] * WIDTH)
            words: Counter = Counter()
            none = [0] * (WIDTH - 1)
            for b in batches:
                rows = []
                for tag, k, *n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(b.column(2 + i).to_numpy().tolist() for i in range(WIDTH))):
                    if tag != "l":
                        out[tag, *k.split(_SEP)] = n
                    elif row := count_tokens(k, n[0], words):
                        rows.append((row[0], _SEP.join(row[1]), n[0], *none))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["tag", "key", *_SUMS])
                if len(out) > 100_000:
                    yield from _batches(out, True)
                if len(words) > 200_000:
                    count_words(words, out)
            count_words(words, out)
            yield from _batches(out, True)

        once = _summed(documents.select((F.col("kind") == "source").alias("source"), "text").mapInArrow(texts, _ROW))
        self.facts = cut_lineage(_summed(once.mapInArrow(lines, _ROW)))

    @staticmethod
    def _collected(rows: DataFrame) -> Tally:
        return {tuple(r[0].split(_SEP)): list(r[1:]) for r in rows.select("key", *_SUMS).collect()}

    def words(self) -> Tally:
        return {k[0]: n for k, n in self._collected(self.facts.where("tag = 'w' AND (n0 >= 3 AND n1 > 0 AND n0 > 0.5 * n1 OR n2 >= 3)")).items()}

    def _mapped(self, rows: DataFrame, p: Potentials, count: Callable) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(p.state())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Potentials.of(shared.value)
            out: Tally = defaultdict(lambda: [0] * WIDTH)
            for b in batches:
                for k, *n in zip(b.column(0).to_pylist(), b.column(1).to_numpy().tolist(), b.column(2).to_numpy().tolist()):
                    count(mine, k.split(_SEP), n, out)
                    if len(out) > 200_000:
                        yield from _batches(out, False)
            yield from _batches(out, False)

        return _summed(rows.select("key", "n0", "n1").mapInArrow(run, _ROW))

    def over(self, count: Callable, p: Potentials, keep: str, everywhere: bool = False) -> Tally:
        lines = self.facts.where("tag IN ('L', 'l')" if everywhere else "tag = 'L'")
        return self._collected(self._mapped(lines, p, lambda mine, key, n, out: count(mine, key[1:], list(map(int, key[0].split())), n[0], out)).where(keep))

    def form_sides(self) -> tuple[Tally, list[int]]:
        def count(mine: Potentials, key: list[str], n: list[int], out: Tally) -> None:
            for k in ((key[0],), (key[0], "b", key[1]), (key[0], "a", key[2])):
                out[k][0] += n[0]
                out[k][1] += n[1]

        pairs = self.facts.where("tag = 'p'").first()
        sides = self._mapped(self.facts.where("tag = 'f'"), Potentials((), ()), count).where(f"n0 + n1 >= 3 OR NOT contains(key, '{_SEP}')")
        return self._collected(sides), [pairs.n0, pairs.n1] if pairs else [0, 0]

    def form_rows(self, p: Potentials) -> Tally:
        def count(mine: Potentials, key: list[str], n: list[int], out: Tally) -> None:
            before, after = mine.cues[key[0]]
            got = out[key[0], str(before.get(key[1], 0.0)), str(after.get(key[2], 0.0))]
            got[0] += n[0]
            got[1] += n[1]

        return self._collected(self._mapped(self.facts.where("tag = 'f'"), p, count))


# ---- operators ------------------------------------------------------------------------------------------


def fit_potentials(documents: DataFrame, known_names: DataFrame) -> Potentials:
    """Potentials from all texts and the list of known names."""
    known = known_names.select("person_name", "name_role").where("person_name IS NOT NULL").distinct().collect()  # the lexicon of the caller
    p = Potentials([r.person_name for r in known if r.name_role != "family"], [r.person_name for r in known if r.name_role == "family"])
    return p.learn(SharedCounts(documents))


def _search(documents: DataFrame, p: Potentials, redact: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(p.state())  # the lexicon and the weights of words met three times or more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Potentials.of(shared.value)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, kinds, starts, texts = [], [], [], []
            sources = map(bool, b.column(1).to_pylist())
            rows = all_parts(zip((t or "" for t in b.column(2).to_pylist()), sources))
            for doc, t, (_, source, parts) in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), rows):
                found = find(t, source, mine, parts) if t else []
                if redact:
                    out, at = [], 0
                    for s, e, k in found:
                        out += [t[at:s], f"[{k.upper()}]"]
                        at = e
                    ids.append(doc)
                    texts.append(None if t is None else "".join([*out, t[at:]]))
                else:
                    ids += [doc] * len(found)
                    kinds += [k for _, _, k in found]
                    starts += [s for s, _, _ in found]
            if redact:
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(starts, pa.int64())], ["doc_id", "kind", "start_char"])

        yield from by_slices(one, batches, 2)

    rows = documents.select("doc_id", (F.col("kind") == "source").alias("source"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text string" if redact else "doc_id bigint, kind string, start_char bigint")


def personal_information(documents: DataFrame, known_names: DataFrame) -> DataFrame:
    """(doc_id, kind, start_char): each mention of personal information, starts counted in code points from 0.

    documents: (doc_id, kind, text). Null and empty texts give no row; a repeated document repeats its rows. Texts
    are read whole where they lie, nothing is shuffled.
    """
    return _search(documents, fit_potentials(documents, known_names), False)


def redacted(documents: DataFrame, known_names: DataFrame) -> DataFrame:
    """(doc_id, text): the texts with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of what was found; null stays null."""
    return _search(documents, fit_potentials(documents, known_names), True)
