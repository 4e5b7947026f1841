"""Additive quantisation: full-dimensional residual codebooks, beam-search encoding, lookup-table scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centres; an empty centre is put on a random row. Many centres are found in two steps, each near a first centre."""
    if k > 1024:
        first = _kmeans(x, int(k**0.5), rounds, rng)
        near = np.argmax(x @ first.T - 0.5 * (first**2).sum(1), axis=1)
        parts = [x[near == i] for i in range(len(first))]
        return np.concatenate([_kmeans(p, max(1, round(k * len(p) / len(x))), rounds, rng) for p in parts if len(p)])
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


@dataclass
class AdditiveQuantiser:
    """A vector is approximated by its cell's centre plus one entry of each codebook, all of full dimension."""

    centres: np.ndarray  # cells x dim
    codebooks: np.ndarray  # books x entries x dim
    beam: int = 4

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, books: int = 4, entries: int = 256, beam: int = 4, rounds: int = 8, seed: int = 5) -> AdditiveQuantiser:
        """Codebooks of the residuals of a bounded sample of unit vectors, one after the other."""
        rng = np.random.default_rng(seed)
        sample = np.ascontiguousarray(sample, np.float32)
        cells = max(1, min(cells, len(sample)))
        centres = _kmeans(sample, cells, rounds, rng)
        rest = sample - centres[np.argmax(sample @ centres.T - 0.5 * (centres**2).sum(1), axis=1)]
        made = []
        for _ in range(books):
            book = _kmeans(rest, min(entries, len(sample)), rounds, rng)
            if len(book) < entries:
                book = np.vstack([book, np.repeat(book[:1], entries - len(book), 0)])
            made.append(book)
            rest = rest - book[np.argmax(rest @ book.T - 0.5 * (book**2).sum(1), axis=1)]
        return cls(centres, np.stack(made).astype(np.float32), beam)

    def cells_of(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each row, nearest first."""
        score = x @ self.centres.T - 0.5 * (self.centres**2).sum(1)
        n = min(n, len(self.centres))
        if n == 1:
            return np.argmax(score, axis=1)[:, None]
        some = np.argpartition(-score, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (rows x books, uint8), the norm of each approximation and its distance from the vector, by beam search over all codebooks."""
        n, books, beam = len(x), len(self.codebooks), self.beam
        rest = (x - self.centres[cell])[:, None, :]  # rows x beam x dim
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.codebooks:
            # |rest - entry|^2 for every kept path and entry
            cost = (rest**2).sum(2)[:, :, None] - 2.0 * rest @ book.T + (book**2).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            path, entry = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, path[:, :, None], 1) - book[entry]
            codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), entry[:, :, None].astype(np.uint8)], 2)
        left = (rest**2).sum(2)
        best = np.argmin(left, axis=1)
        row = np.arange(n)
        norms = np.linalg.norm(x - rest[row, best], axis=1)
        return codes[row, best].reshape(n, books), np.maximum(norms, 1e-6).astype(np.float32), np.sqrt(left[row, best]).astype(np.float32)

    def products(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of rows' approximations with queries (rows x queries): sums of looked-up ones. codes: books x rows."""
        tables = [np.ascontiguousarray(book @ q.T) for book in self.codebooks]
        tables[0] += self.centres[cell] @ q.T
        out = np.empty((codes.shape[1], len(q)), np.float32)
        held = np.empty((512, len(q)), np.float32)
        for at in range(0, len(out), 512):
            part = out[at : at + 512]
            np.take(tables[0], codes[0, at : at + 512], axis=0, out=part, mode="clip")
            for table, code in zip(tables[1:], codes[1:]):
                part += np.take(table, code[at : at + 512], axis=0, out=held[: len(part)], mode="clip")
        return out

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosines (queries x rows): sums of looked-up inner products over stored norms."""
        return (self.products(q, cell, codes.T.astype(np.intp)) / norms[:, None]).T
