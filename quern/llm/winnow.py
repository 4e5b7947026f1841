"""Fingerprints of normalised token streams by winnowing."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Tokens of one fingerprint, and the run of them of which at least one is kept.
GRAM, WINDOW = 16, 8
NAME, NUMBER, STRING, MARK, COMMENT = range(5)
TOKENS = re.compile(
    r"[^\W\d]\w*|[(){}\[\],;:.=<>!&|*%^~?@$\\+-]|\d[\w.]*"
    r"|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
    r"|//[^\n]*|/\*[\s\S]*?\*/|#(?![ \t]*(?:include|define|if|ifdef|ifndef|endif|else|pragma)\b)[^\n]*|[^\w\s]"
)
_HASH_C = "#"


def _kind(token: str) -> int:
    c = token[0]
    if c.isalpha() or c == "_":
        return NAME
    if c in "\"'`":
        return COMMENT if token[:3] in ('"""', "'''") else STRING
    if len(token) > 1 and (token[:2] in ("//", "/*") or c == _HASH_C):
        return COMMENT
    if c.isdigit():
        return NUMBER
    return COMMENT if c == _HASH_C else MARK


class Codes(dict):
    """Token -> a hash of its normal form times 8 plus its kind; numbers are alike, and so are strings."""

    most = 200_000

    def __missing__(self, token: str) -> int:
        kind = _kind(token)
        form = "0" if kind == NUMBER else '"' if kind == STRING else "/" if kind == COMMENT else token
        raw = form.encode("utf-8", "surrogatepass")
        code = ((zlib.crc32(raw) << 25) ^ (zlib.adler32(raw) * 0x9E3779B1)) & ((1 << 60) - 1)
        if len(self) >= self.most:
            self.clear()
        self[token] = code = code << 3 | kind
        return code


def token_codes(text: str, codes: Codes) -> np.ndarray:
    """Codes of the tokens of a text in order."""
    return np.fromiter(map(codes.__getitem__, TOKENS.findall(text)), np.uint64)


def runs(x: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` codes."""
    n = len(x) - gram + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    h = np.zeros(n, np.uint64)
    for i in range(gram):
        h = h * np.uint64(0x100000001B3) ^ x[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The least hash of each window, once each: any run of gram + window - 1 equal tokens shares one."""
    if len(h) <= window:
        return h.min(keepdims=True) if len(h) else h
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, window).min(1))


def fingerprints(x: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Fingerprints of token codes, comments aside; a stream shorter than a gram has none. Signed 64-bit integers."""
    return winnow(runs(x[(x & np.uint64(7)) != COMMENT], gram), window).view(np.int64)


def self_repetition(x: np.ndarray, gram: int = 16, block: int = 1000) -> float:
    """Share of the runs of ``gram`` tokens, names being alike, that occur more than once in their block.

    Blocks of ``block`` tokens are weighed by their size, so a long file is judged like a short one.
    """
    kind = x & np.uint64(7)
    h = runs(np.where(kind == NAME, np.uint64(1), x)[kind != COMMENT], gram)
    if len(h) < gram:
        return 0.0
    parts = np.array_split(h, max(1, round(len(h) / block)))
    return 1.0 - sum(len(np.unique(p)) for p in parts) / len(h)
