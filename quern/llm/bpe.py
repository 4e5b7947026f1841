"""Byte-pair encoding by a deterministic automaton built from merge gadgets.

The automaton reads tokens. It starts with one state in which every byte is allowed. Each merge (u, v) adds a
gadget: the state entered by u becomes a copy of itself without the arc v (the pair must from now on be read
as the new token), and the new token's arc leads where the arc of v led. The state after a token is thus given
by the token, and two tokens may follow each other unless a gadget removed that arc *before* either side had
been merged further: the arcs a state lacks are those removed along the right spine of its token, an arc stands
for the tokens along the left spine of its label. So the table holds one entry per merge, and a transition is
decided by walking two short spines and remembered.

The labels of the arcs are compiled into one table of transitions over bytes: its state after a byte is the longest
end of the text that begins a label, and names the tokens that end there, longest first. A word is encoded by the
tables in one pass over its bytes: the last token of each prefix is the one token that ends there and may follow the
last token of the prefix before it. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import regex

#: Splits text into words before any merge (the tokenizer's fixed pattern, white space spelled out).
_WS = r"\t-\r \x85\xa0  -     　"
_ASCII_WS = r"\t-\r "
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
ASCII_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^{_ASCII_WS}A-Za-z0-9]+|[{_ASCII_WS}]+(?![^{_ASCII_WS}])|[{_ASCII_WS}]+")
#: Words remembered per worker; a memory bound, the automaton runs again for what was forgotten.
CACHE_WORDS = 200_000


def split_words(text: str) -> list[str]:
    """The words of a text in order; joined they give the text back."""
    return (ASCII_WORDS if text.isascii() else WORDS).findall(text)


class MergeAutomaton:
    """labels: the bytes of each token id. Tokens of more than one byte are added in the order of their ids' ranks."""

    def __init__(self, labels: list[bytes], left: np.ndarray | None = None, right: np.ndarray | None = None, steps: tuple | None = None):
        self.labels = labels
        self.ids = {b: i for i, b in enumerate(labels)}
        self.longest = max(map(len, labels), default=1)
        self.pairs: dict[tuple[int, int], int] = {}
        self.allowed: dict[tuple[int, int], bool] = {}
        if left is not None:
            self.left, self.right = left.tolist(), right.tolist()
            self.pairs = {(u, v): t for t, (u, v) in enumerate(zip(self.left, self.right)) if u >= 0}
            keys, nodes, back, ending, shorter = steps if steps is not None else self._compiled()
            self.goto = dict(zip(keys.tolist(), nodes.tolist()))
            self.back, self.ending, self.shorter = back.tolist(), ending.tolist(), shorter.tolist()
            return
        self.left, self.right = [-1] * len(labels), [-1] * len(labels)
        ids, self.ids = self.ids, {b: i for b, i in self.ids.items() if len(b) == 1}
        for t, label in enumerate(labels):
            if len(label) > 1:
                parts = self._parts(label)
                if len(parts) != 2:
                    raise ValueError(f"token {t} is not made by one merge")
                self.left[t], self.right[t] = parts
                self.pairs[parts[0], parts[1]] = t
                self.ids[label] = t
                self.allowed.clear() if len(self.allowed) > 100_000 else self.allowed.pop((parts[0], parts[1]), None)
        self.allowed.clear()
        self.ids = ids
        keys, nodes, back, ending, shorter = self._compiled()
        self.goto = dict(zip(keys.tolist(), nodes.tolist()))
        self.back, self.ending, self.shorter = back.tolist(), ending.tolist(), shorter.tolist()

    def tables(self) -> tuple:
        """What another process needs to run the automaton without building it."""
        return self.labels, np.array(self.left, np.int32), np.array(self.right, np.int32), self._compiled()

    def _compiled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Transitions (node and byte to node), the node to go back to, the longest token that ends in a node, and of each token the next shorter one that ends where it does."""
        goto: dict[int, int] = {}
        own, last = [-1], {}
        for t, label in enumerate(self.labels):
            node = 0
            for byte in label:
                node_, key = len(own), node << 8 | byte
                node = goto.setdefault(key, node_)
                if node == node_:
                    own.append(-1)
            if label and own[node] < 0:
                own[node], last[t] = t, node
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in goto.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        back, ending = [0] * len(own), list(own)
        level = [0]
        while level:
            onward = []
            for node in level:
                for byte, child in children.get(node, ()):
                    at = back[node]
                    while node and at and (at << 8 | byte) not in goto:
                        at = back[at]
                    back[child] = goto.get(at << 8 | byte, 0) if node else 0
                    if ending[child] < 0:
                        ending[child] = ending[back[child]]
                    onward.append(child)
            level = onward
        shorter = [ending[back[last[t]]] if t in last else -1 for t in range(len(self.labels))]
        return np.fromiter(goto, np.int64, len(goto)), np.fromiter(goto.values(), np.int32, len(goto)), np.array(back, np.int32), np.array(ending, np.int32), np.array(shorter, np.int32)

    def follows(self, a: int, b: int) -> bool:
        """Whether the state after token a has an arc b."""
        known = self.allowed.get((a, b))
        if known is None:
            known = self.allowed[a, b] = self._follows(a, b)
        return known

    def _follows(self, a: int, b: int) -> bool:
        pairs, left, right = self.pairs, self.left, self.right
        never = len(self.labels)
        x, x_until = a, never
        while x >= 0:
            y, y_until = b, never
            while y >= 0:
                made = pairs.get((x, y))
                if made is not None and made < x_until and made <= y_until:
                    return False
                y, y_until = left[y], y
            x, x_until = right[x], x
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one word, by the tables."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        goto, back, ending, shorter, labels = self.goto, self.back, self.ending, self.shorter, self.labels
        last = [-1] * (len(word) + 1)
        node = 0
        for end, byte in enumerate(word, 1):
            while (step := goto.get(node << 8 | byte)) is None and node:
                node = back[node]
            node = step or 0
            t = ending[node]
            while t >= 0:
                start = end - len(labels[t])
                if start == 0 or last[start] >= 0 and self.follows(last[start], t):
                    last[end] = t
                    break
                t = shorter[t]
        return self._read(last)

    def _parts(self, word: bytes) -> list[int]:
        """Token ids of a word by the tokens known so far, while the automaton is built."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        n, ids, longest = len(word), self.ids, self.longest
        last = [-1] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                t = ids.get(word[start:end])
                if t is not None and (start == 0 or (last[start] >= 0 and self.follows(last[start], t))):
                    last[end] = t
                    break
        return self._read(last)

    def _read(self, last: list[int]) -> list[int]:
        """The tokens of a word from the last token of each of its prefixes."""
        n = len(last) - 1
        out, end = [], n
        while end > 0:
            t = last[end]
            out.append(t)
            end -= len(self.labels[t])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, joined."""
        return b"".join(self.labels[i] for i in ids)


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> MergeAutomaton:
    """The automaton of a rank file (base64 label, rank)."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    labels: list[bytes] = [b""] * (1 + max(int(r) for _, r in rows))
    for label, rank in rows:
        labels[int(rank)] = base64.b64decode(label)
    return MergeAutomaton(labels)


class WordCodes(dict):
    """Word -> its ids as packed little-endian int32; filled by the automaton."""

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.automaton.encode_word(word.encode("utf-8", "surrogatepass")), "<i4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids


class WordCounts(dict):
    """Word -> the number of its ids."""

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = len(self.automaton.encode_word(word.encode("utf-8", "surrogatepass")))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n
        return n
