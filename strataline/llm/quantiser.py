"""Additive quantisation of unit vectors: training, encoding, scoring (numpy only).

A vector is coded as the sum of one coarse centre and one word of each of several residual
codebooks; all of them have the full dimension. Encoding keeps the best few partial sums
(beam search). The norm of the sum is stored, so a score is a look-up for each codebook,
added up and divided by that norm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BOOKS = 8
WORDS = 64
BEAM = 4
LLOYD = 8
#: Error that single precision may leave in a score, and the norm of a code's sum under which it may leave more.
SLACK, WEAK = 1e-4, 0.05


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = np.argmax(x[k : k + 4096] @ centres.T - half, axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = LLOYD) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        count = np.bincount(own, minlength=k)
        edges = np.concatenate([[0], np.cumsum(count)])
        some = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], edges[some], axis=0)
        centres[some] = sums / count[some, None]
        bare = np.flatnonzero(count == 0)
        if len(bare):
            centres[bare] = x[rng.choice(len(x), len(bare))]
    return centres


@dataclass
class Quantiser:
    coarse: np.ndarray  # centres x dim
    books: np.ndarray  # BOOKS x words x dim
    #: Residual books that cells are split by: a cell is a coarse centre and the nearest word of each of them in turn.
    deep: int = 0

    @classmethod
    def train(cls, x: np.ndarray, cells: int, deep: int = 0, seed: int = 7) -> Quantiser:
        rng = np.random.default_rng(seed)
        coarse = kmeans(x, cells, rng)
        left = x - coarse[_nearest(x, coarse)]
        books = []
        for _ in range(BOOKS):
            words = kmeans(left, WORDS, rng)
            if len(words) < WORDS:  # a small sample: the rest are zero words
                words = np.concatenate([words, np.zeros((WORDS - len(words), x.shape[1]), x.dtype)])
            left = left - words[_nearest(left, words)]
            books.append(words)
        return cls(coarse, np.stack(books), deep)

    def centre_of(self, cell: np.ndarray) -> np.ndarray:
        """The coarse centre of a cell."""
        return cell // WORDS**self.deep

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, words (BOOKS each) and norm of the sum for every row."""
        cell = _nearest(x, self.coarse)
        codes = np.empty((len(x), BOOKS), np.uint8)
        norms = np.empty(len(x), np.float32)
        for k in range(0, len(x), 2048):
            part = slice(k, k + 2048)
            base = self.coarse[cell[part]]
            left = (x[part] - base)[:, None, :]  # rows x beam x dim
            words = np.empty((len(base), 1, 0), np.uint8)
            for book in self.books:
                half = (book * book).sum(1)
                error = (left * left).sum(2)[:, :, None] - 2 * (left @ book.T) + half
                flat = error.reshape(len(base), -1)
                keep = min(BEAM, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                beam, word = np.divmod(best, WORDS)
                row = np.arange(len(base))[:, None]
                left = left[row, beam] - book[word]
                words = np.concatenate([words[row, beam], word[:, :, None].astype(np.uint8)], axis=2)
            at = np.argmin((left * left).sum(2), axis=1)
            row = np.arange(len(base))
            codes[part] = words[row, at]
            norms[part] = np.maximum(np.linalg.norm(x[part] - left[row, at], axis=1), 1e-6)
        if self.deep:
            left = x - self.coarse[cell]
            for book in self.books[: self.deep]:
                word = _nearest(left, book)
                left = left - book[word]
                cell = cell * WORDS + word
        return cell, codes, norms

    def fits(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Cosines of unit rows and their codes' sums."""
        out = np.empty(len(x))
        for k in range(0, len(x), 2048):
            part = slice(k, k + 2048)
            near = self.coarse[self.centre_of(cell[part])].astype(np.float64)
            for b in range(BOOKS):
                near += self.books[b][codes[part, b]]
            out[part] = (x[part] * near).sum(1) / np.maximum(np.linalg.norm(near, axis=1), 1e-6)
        return np.clip(out, -1, 1)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row; in deep cells, of those that split the n nearest cells of the level above."""
        out = np.empty((len(x), min(n, len(self.coarse) * WORDS**self.deep)), np.int64)
        step = 4096 if not self.deep else 256
        for k in range(0, len(x), step):
            part = x[k : k + step]
            far = (self.coarse * self.coarse).sum(1) - 2 * (part @ self.coarse.T)
            cells = np.argpartition(far, min(n, far.shape[1]) - 1, axis=1)[:, :n]
            centre = self.coarse[cells] if self.deep else None
            for book in self.books[: self.deep]:
                ends = centre[:, :, None, :] + book  # rows x cells x words x dim
                far = ((ends - part[:, None, None, :]) ** 2).sum(3).reshape(len(part), -1)
                best = np.argpartition(far, min(n, far.shape[1]) - 1, axis=1)[:, :n]
                row = np.arange(len(part))[:, None]
                cells = cells[row, best // WORDS] * WORDS + best % WORDS
                centre = ends.reshape(len(part), -1, part.shape[1])[row, best]
            out[k : k + step] = cells
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Look-up tables: BOOKS x words x queries, so that a look-up is one row for all queries."""
        return (self.books.reshape(-1, q.shape[1]) @ np.ascontiguousarray(q.T)).reshape(*self.books.shape[:2], len(q))

    def scores(self, tables: np.ndarray, on_coarse: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosines, members x queries. on_coarse: the members' centres' products with the queries; it is overwritten."""
        for b in range(BOOKS):
            on_coarse += tables[b][codes[:, b]]
        on_coarse /= norms[:, None]
        return on_coarse


def may_reach(scores: np.ndarray, norms: np.ndarray, fits: np.ndarray, goals: np.ndarray) -> np.ndarray:
    """Members x queries: whether the exact cosine may be the query's goal or more.

    The angle to a member is at least the one to its code less the one between both, so the
    score must be cos(arccos(goal) + arccos(fit)) or more. Where that says nothing all members are open.
    """
    t = np.clip(goals, -1, 1)
    least = np.stack([fits, -np.sqrt(1 - fits * fits)], axis=1).astype(np.float32) @ np.stack([t, np.sqrt(1 - t * t)]).astype(np.float32)
    least -= SLACK
    found = scores >= least
    found[norms < WEAK] = True
    found[:, t < -fits.min()] = True
    return found
