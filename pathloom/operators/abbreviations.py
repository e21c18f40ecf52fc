"""Many terms at once: which terms' characters lie in order in a path, and what that is worth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


class Terms:
    """Terms as columns of character codes, so that one walk through a text is made for all of them together."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        self.codes = {c: k for k, c in enumerate(sorted(set("".join(self.terms))))}
        self.n = np.array([len(t) for t in self.terms], dtype=np.int64)
        # one code more, for what lies behind a term's end; there a walk stands still
        self.steps = np.full((int(self.n.max(initial=0)), len(self.terms)), len(self.codes), dtype=np.int64)
        self.needs = np.zeros(len(self.terms), dtype=np.uint64)
        for k, t in enumerate(self.terms):
            self.steps[: len(t), k] = [self.codes[c] for c in t]
            self.needs[k] = self._bits(self.codes[c] for c in t)

    @staticmethod
    def _bits(codes) -> np.uint64:
        out = 0
        for c in codes:
            out |= 1 << (c & 63)
        return np.uint64(out)

    def walk(self, text: str, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The terms (``among`` these) whose characters lie in ``text`` in order, and the leftmost 1-based positions, a row each step."""
        at = [self.codes.get(c, -1) for c in text]
        has = self._bits(c for c in set(at) if c >= 0)
        k = np.flatnonzero(self.needs & ~has == 0) if among is None else among[self.needs[among] & ~has == 0]
        size, width = len(text), len(self.codes) + 1
        # behind[p, c]: the first position after p that has c; size + 1 where there is none, from where nothing leads on
        behind = np.full((size + 2, width), size + 1, dtype=np.int64)
        row = behind[size].copy()
        for p in range(size - 1, -1, -1):
            if at[p] >= 0:
                row[at[p]] = p + 1
            behind[p] = row
        behind[:, -1] = np.arange(size + 2)
        flat = behind.ravel()
        pos, made = np.zeros(len(k), dtype=np.int64), []
        for j in range(int(self.n[k].max(initial=0))):
            pos = flat[pos * width + self.steps[j, k]]
            made.append(pos)
        ok = pos <= size
        return k[ok], np.array(made, dtype=np.int64).reshape(len(made), len(k))[:, ok]

    def scores(self, path_lc: str, initials: str, mask: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order in ``path_lc`` with :func:`~pathloom.functions.ranking.match_score`, where the path lacks the term, step by step the same."""
        k, pos = self.walk(path_lc)
        if not len(k):
            return k, np.zeros(0)
        n, first, last, length = self.n[k], pos[0], pos[-1], len(path_lc)
        total = np.where(np.arange(len(pos))[:, None] < n, pos - 1, 0).sum(axis=0)
        span = (last - first + 1 - n) / length
        score = np.clip(0.70 + self._pairs(pos) / n * 0.05 + total / n / length * 0.10 - span * 0.10, 0.50, 0.88)
        at = np.empty(len(self.terms), dtype=np.int64)
        at[k] = np.arange(len(k))
        for text, worth in ((mask, self._camel), (initials, self._component)):
            some, steps = self.walk(text, k)
            if len(some):
                score[at[some]] = worth(self._pairs(steps), self.n[some], len(text))
        return k, score

    @staticmethod
    def _pairs(pos: np.ndarray) -> np.ndarray:
        return (pos[1:] == pos[:-1] + 1).sum(axis=0)

    @staticmethod
    def _camel(pairs: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        return np.minimum(0.90 + pairs / n * 0.05, 0.96)

    @staticmethod
    def _component(pairs: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        return np.minimum(0.95 + pairs / n * 0.05 + 0.05 * n / size, 0.99)


def abbreviated(terms: Sequence[str]):
    """For ``mapInArrow`` over (name_lc, path_lc, initials, mask, path, mtime, depth, context): a row for each term that the file abbreviates and doesn't contain."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Terms(terms)
        texts = pa.array(made.terms, pa.string())
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                own, which, scores = [], [], []
                for r, (name, path, initials, mask) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                    k, score = made.scores(path, initials, mask)
                    keep = np.fromiter((t not in path and t not in name for t in map(made.terms.__getitem__, k.tolist())), dtype=bool, count=len(k))
                    own.append(np.full(int(keep.sum()), r))
                    which.append(k[keep])
                    scores.append(score[keep])
                take = pa.array(np.concatenate(own))
                yield pa.RecordBatch.from_arrays(
                    [texts.take(pa.array(np.concatenate(which))), *(batch.column(c).take(take) for c in range(4, 8)), pa.array(np.concatenate(scores).astype(np.float32))], ["t", "path", "mtime", "depth", "context", "score"]
                )

    return rows
