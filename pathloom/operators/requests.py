"""Many requests over the same files: each task keeps the best files of every request in its own blocks, and only those leave it."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pathloom.functions.ranking import SCOPE_BOOST, SCOPE_DEPTHS, is_literal

#: Files and bytes of a block, for which every request keeps its best; a batch more may come in.
BLOCK, BLOCK_BYTES = 1 << 18, 128 << 20
#: Files walked at once, and characters of theirs with the longest path counting for all.
CHUNK, CHUNK_CELLS = 1 << 14, 1 << 21
# A candidate is one positive number that compares like the order of results: 30 bits of the score, 13 of the place (within 1,211 points), 20 of the file's turn among equals.
TURN, PLACE = 20, 13
LAST, MIDDLE = (1 << TURN) - 1, 1 << (PLACE - 1)
KEPT = "g int, most int, score float, place int, mtime bigint, depth int, path string"


class Walk:
    """One text of every file of a chunk, in which terms are walked from left to right; terms with a common beginning share its steps."""

    def __init__(self, texts: list[str], alphabet: np.ndarray):
        self.n = len(texts)
        self.sizes = np.fromiter(map(len, texts), dtype=np.int32, count=self.n)
        self.end = int(self.sizes.max(initial=0))
        codes = np.array(texts, dtype=f"U{max(self.end, 1)}").view(np.uint32).reshape(self.n, -1)
        self.codes = np.ascontiguousarray(alphabet[codes].T)
        if alphabet[0]:
            self.codes[np.arange(len(self.codes))[:, None] >= self.sizes] = 0
        self.present = set(np.flatnonzero(np.bincount(self.codes.ravel())).tolist())
        self.alphabet, self.tables, self.at, self.steps = alphabet, {}, "", []

    def _behind(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        """The files that have a character, and for each position the next 1-based one that has it, or one past the end."""
        code = int(self.alphabet[ord(c)])
        if c not in self.tables:
            met = self.codes == code if code in self.present else np.zeros((len(self.codes), 0), dtype=bool)
            rows = np.flatnonzero(met.any(axis=0))
            met = met[:, rows]
            table = np.empty((self.end + 1, len(rows)), dtype=np.min_scalar_type(self.end + 1))
            row = table[self.end] = np.full(len(rows), self.end + 1, dtype=table.dtype)
            for p in range(self.end - 1, -1, -1):
                row = table[p] = np.where(met[p], table.dtype.type(p + 1), row)
            self.tables[c] = rows, table
        return self.tables[c]

    def _step(self, before: tuple | None, c: str) -> tuple:
        rows, table = self._behind(c)
        if before is None:
            pos = table[0].astype(np.int64)
            return rows, pos, pos, pos - 1, np.zeros(len(rows), dtype=np.int64)
        files, pos = before[:2]
        if not len(files) or not len(rows):
            return tuple(x[:0] for x in before)
        at = files if len(rows) == self.n else np.minimum(np.searchsorted(rows, files), len(rows) - 1)
        to = table.ravel().take(pos * len(rows) + at)
        ok = np.flatnonzero((to <= self.end) & (rows[at] == files))
        to, pos = to[ok].astype(np.int64), pos[ok]
        return files[ok], to, before[2][ok], before[3][ok] + to - 1, before[4][ok] + (to == pos + 1)

    def to(self, term: str) -> tuple:
        """Files with the characters of the term in order; last and first of the leftmost 1-based positions, the sum of 0-based ones, adjacent pairs."""
        del self.steps[len(commonprefix((self.at, term))) :]
        for c in term[len(self.steps) :]:
            self.steps.append(self._step(self.steps[-1] if self.steps else None, c))
        self.at = term
        return self.steps[-1]


def _abbreviations(term: str, path: Walk, initials: Walk, mask: Walk) -> np.ndarray:
    """Every file's score for a term that its path lacks, 0 without a match; step by step that of :func:`~pathloom.functions.ranking.match_score`."""
    score, n = np.zeros(path.n), len(term)
    files, last, first, total, pairs = path.to(term)
    if len(files):
        length = path.sizes[files]
        span = (last - first + 1 - n) / length
        score[files] = np.clip(0.70 + pairs / n * 0.05 + total / n / length * 0.10 - span * 0.10, 0.50, 0.88)
        found = score > 0
        files, *_, pairs = mask.to(term)
        score[files] = np.where(found[files], np.minimum(0.90 + pairs / n * 0.05, 0.96), 0)
        files, *_, pairs = initials.to(term)
        score[files] = np.where(found[files], np.minimum(0.95 + pairs / n * 0.05 + 0.05 * n / initials.sizes[files], 0.99), 0)
    return score.astype(np.float32)


def _name_score(name: str, term: str) -> np.float32:
    """:func:`~pathloom.functions.ranking.name_score` of a name that contains the term."""
    if name == term:
        return np.float32(1.0)
    if name.startswith(term):
        ratio = np.float32(len(term.encode()) / len(name.encode()))
        return np.float32(ratio * np.float32(0.09)) + np.float32(0.9)
    return np.float32(0.7 if f" {term}" in name or f"_{term}" in name else 0.5)


class Requests:
    """Requests (t, within, near, n) by number, to be answered block by block."""

    def __init__(self, asked: pa.Table, abbreviations: bool):
        t, within, near = (asked.column(c).to_pylist() for c in ("t", "within", "near"))
        self.most = np.minimum(asked.column("n").to_numpy(), np.iinfo(np.int32).max).astype(np.int64)
        self.terms = sorted(set(t))
        number = {x: k for k, x in enumerate(self.terms)}
        self.scopes = sorted({*within, *near} - {""})
        place = {x: k for k, x in enumerate(self.scopes)} | {"": -1}
        self.of: list[list[tuple[int, int, int]]] = [[] for _ in self.terms]
        for g, (x, w, b) in enumerate(zip(t, within, near)):
            self.of[number[x]].append((g, place[w], place[b]))
        self.loose = [k for k, x in enumerate(self.terms) if abbreviations and not is_literal(x)]
        letters = sorted(set("".join(self.terms[k] for k in self.loose)))
        self.alphabet = np.zeros(0x110000, dtype=np.min_scalar_type(len(letters)))
        self.alphabet[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)

        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, x in enumerate(self.terms):
            self.automaton.add_word(x, k)
        self.automaton.make_automaton()

    def _contained(self, names: list[str], paths: list[str], known: dict[str, dict[int, np.float32]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For every term that some name or path contains, the files in order and their scores."""
        which, own, scores, low = [], [], [], np.float32(0.3)
        for r, (name, path) in enumerate(zip(names, paths)):
            if name not in known:
                known[name] = {k: _name_score(name, self.terms[k]) for k in {k for _, k in self.automaton.iter(name)}}
            worth = known[name]
            found = {k for _, k in self.automaton.iter(path)}.union(worth)
            which += found
            own += [r] * len(found)
            scores += [worth.get(k, low) for k in found]
        term, file, score = np.array(which, dtype=np.int64), np.array(own, dtype=np.int64), np.array(scores, dtype=np.float32)
        by = np.argsort(term, kind="stable")
        term, file, score = term[by], file[by], score[by]
        at = np.flatnonzero(np.diff(term, prepend=-1))
        return {int(term[a]): (file[a:b], score[a:b]) for a, b in zip(at, [*at[1:], len(term)])}

    def block(self, files: pa.Table) -> Iterator[pa.RecordBatch]:
        files = files.take(pc.sort_indices(files.column("path"))).combine_chunks()
        paths = files.column("path").cast(pa.binary()).to_pylist()
        depth = files.column("depth").to_numpy().astype(np.int64)
        mtime = pc.fill_null(files.column("mtime"), np.iinfo(np.int64).min).to_numpy()
        turns = np.lexsort((np.arange(len(paths)), depth, ~mtime))
        base = np.empty(len(paths), dtype=np.int64)
        base[turns] = LAST - np.arange(len(paths))
        base += (files.column("context").to_numpy().astype(np.int64) + MIDDLE) << TURN
        # a scope is its own path and what begins with it and a slash; "0" is the byte after "/"
        bounds = np.zeros((len(self.scopes), 4), dtype=np.int64)
        for k, s in enumerate(x.encode() for x in self.scopes):
            below = s.rstrip(b"/")
            bounds[k] = *((bisect_left(paths, s), bisect_right(paths, s)) if below else (0, 0)), bisect_left(paths, below + b"/"), bisect_left(paths, below + b"0")
        levels = [s.rstrip("/").count("/") for s in self.scopes]
        kept: dict[int, np.ndarray] = {}
        least = np.zeros(len(self.most), dtype=np.int64)

        def offer(k: int, at: np.ndarray, score: np.ndarray) -> None:
            """Files with their scores to all requests of a term."""
            keys = (score.view(np.int32).astype(np.int64) << (TURN + PLACE)) + base[at]
            asked = self.of[k]
            worth = np.flatnonzero(keys + ((SCOPE_BOOST + 1) << TURN) > least[[g for g, _, _ in asked]].min())
            at, keys = at[worth], keys[worth]
            if not len(at):
                return
            cuts = {s: np.searchsorted(at, bounds[s]).tolist() for s in {s for _, w, b in asked for s in (w, b) if s >= 0}}
            gains = {}
            for g, w, b in asked:
                for lo, hi in ((0, len(at)),) if w < 0 else (cuts[w][:2], cuts[w][2:]):
                    if lo >= hi:
                        continue
                    own = keys[lo:hi]
                    if b >= 0:
                        if b not in gains:
                            gain = gains[b] = np.zeros(len(at), dtype=np.int64)
                            for x, y in (cuts[b][:2], cuts[b][2:]):
                                below = np.maximum(depth[at[x:y]] - (levels[b] + 1), 0)
                                gain[x:y] = (SCOPE_BOOST - np.minimum(below, SCOPE_DEPTHS)) << TURN
                        own = own + gains[b][lo:hi]
                    own = own[own > least[g]]
                    if not len(own):
                        continue
                    both = np.concatenate((kept[g], own)) if g in kept else own
                    if (over := len(both) - int(self.most[g])) >= 0:
                        both = np.partition(both, over)[over:]
                        least[g] = both[0]
                    kept[g] = both

        names, lower = files.column("name_lc").to_pylist(), files.column("path_lc").to_pylist()
        known: dict[str, dict[int, np.float32]] = {}
        begin = 0
        while begin < len(paths):
            end, longest = begin, 0
            while end < min(begin + CHUNK, len(paths)) and (end == begin or (end - begin + 1) * max(longest, len(lower[end])) <= CHUNK_CELLS):
                longest = max(longest, len(lower[end]))
                end += 1
            contained = self._contained(names[begin:end], lower[begin:end], known)
            if self.loose:
                walks = [Walk(x, self.alphabet) for x in (lower[begin:end], *(files.column(c).slice(begin, end - begin).to_pylist() for c in ("initials", "mask")))]
                for k in self.loose:
                    score = _abbreviations(self.terms[k], *walks)
                    if k in contained:
                        at, worth = contained.pop(k)
                        score[at] = worth
                    if len(at := np.flatnonzero(score)):
                        offer(k, at + begin, score[at])
            for k, (at, worth) in contained.items():
                offer(k, at + begin, worth)
            begin = end
        some: list[tuple[int, np.ndarray]] = []
        rows = 0
        for own in kept.items():
            some.append(own)
            rows += len(own[1])
            if rows >= 1 << 16:
                yield self._rows(files, turns, some)
                some, rows = [], 0
        if some:
            yield self._rows(files, turns, some)

    def _rows(self, files: pa.Table, turns: np.ndarray, kept: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        g = np.repeat(np.array([g for g, _ in kept], dtype=np.int32), [len(x) for _, x in kept])
        keys = np.concatenate([x for _, x in kept])
        take = pa.array(turns[LAST - (keys & LAST)])
        score = (keys >> (TURN + PLACE)).astype(np.int32).view(np.float32)
        place = ((keys >> TURN & (1 << PLACE) - 1) - MIDDLE).astype(np.int32)
        whole = [files.column(c).take(take).combine_chunks() for c in ("mtime", "depth", "path")]
        whole = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in whole]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (g, self.most[g].astype(np.int32), score, place)] + whole, ["g", "most", "score", "place", "mtime", "depth", "path"])


def best_of_blocks(asked: pa.Table, abbreviations: bool):
    """For ``mapInArrow`` over (name_lc, path_lc, path, mtime, depth, context) and, for abbreviations, (initials, mask): for each request, by
    its place in ``asked``, its best files of every block of files, in no order, as :data:`KEPT`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not asked.num_rows:
            return
        requests, held = Requests(asked, abbreviations), []
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                held.append(whole.slice(begin, BLOCK))
                if sum(x.num_rows for x in held) >= BLOCK or sum(x.nbytes for x in held) >= BLOCK_BYTES:
                    yield from requests.block(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from requests.block(pa.Table.from_batches(held))

    return rows


def fits(limits: Sequence[int]) -> bool:
    """Whether so many results of all requests fit a block's memory."""
    return sum(min(n, BLOCK) for n in limits) <= 1 << 24
