"""NumPy kernels that run inside a Spark task on one bounded block of vectors.

A block is held in float32 only: as it came and scaled to unit length. Products are taken in
float32; whatever lies within ``margin`` of a decision is decided again in float64, for the
rows concerned alone, so results are those of float64 arithmetic at float32 speed and memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, cached_property, partial

import numpy as np
import pyarrow as pa

TILE = 2048
# Components put into float64 at a time.
EXACT = 1 << 20


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column -> float64 matrix of unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width, rest = divmod(len(flat), len(column))
    if rest or not (np.diff(column.offsets.to_numpy()) == width).all():
        raise ValueError("vectors of unequal length in one column")
    matrix = flat.reshape(len(column), width)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


class Vectors:
    """The rows of a block. A matrix without ``norms`` holds unit rows already."""

    def __init__(self, raw: np.ndarray, norms: np.ndarray | None = None):
        self.raw, self.norms = raw, norms
        self._tails: dict[int, np.ndarray] = {}

    @staticmethod
    def of(column: pa.Array | pa.ChunkedArray, order: np.ndarray | None = None) -> Vectors:
        """Rows of a list column, those at ``order`` in this order or all; one copy at most."""
        chunks = [c for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
        if not chunks:
            return Vectors(np.zeros((0, 0), np.float32), np.zeros(0))
        width = len(chunks[0][0])
        parts = []
        for chunk in chunks:
            if not (np.diff(chunk.offsets.to_numpy()) == width).all():
                raise ValueError("vectors of unequal length in one column")
            parts.append(chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), width))
        if order is None:
            raw = parts[0] if len(parts) == 1 else np.concatenate(parts)
        else:
            raw = np.empty((len(order), width), parts[0].dtype)
            start = 0
            for part in parts:
                here = np.flatnonzero((order >= start) & (order < start + len(part)))
                raw[here] = part[order[here] - start]
                start += len(part)
        step = max(1, EXACT // max(width, 1))
        norms = [np.linalg.norm(raw[s : s + step].astype(np.float64), axis=1) for s in range(0, len(raw), step)]
        return Vectors(raw, np.concatenate(norms) if norms else np.zeros(0))

    def __len__(self) -> int:
        return len(self.raw)

    @property
    def width(self) -> int:
        return self.raw.shape[1]

    def exact(self, at: slice | np.ndarray) -> np.ndarray:
        """Unit rows in float64."""
        rows = self.raw[at].astype(np.float64)
        if self.norms is not None:
            rows /= self.norms[at][:, None]
        return rows

    @cached_property
    def unit(self) -> np.ndarray:
        """All unit rows in float32; the rows as they came where those are no farther from it than ``margin`` leaves room for."""
        if self.raw.dtype == np.float32 and (self.norms is None or (np.abs(self.norms - 1) <= margin(self.width) / 8).all()):
            return self.raw
        out = np.empty(self.raw.shape, np.float32)
        step = max(1, EXACT // max(self.width, 1))
        for s in range(0, len(out), step):
            out[s : s + step] = self.exact(slice(s, s + step))
        return out


    def tails(self, k: int) -> np.ndarray:
        """Of every unit row the length of what comes after its first ``k`` components."""
        if k not in self._tails:
            step = max(1, EXACT // max(self.width, 1))
            self._tails[k] = np.concatenate([tail_lengths(self.unit[s : s + step], k) for s in range(0, len(self), step)] or [np.zeros(0, np.float32)])
        return self._tails[k]


def tail_lengths(rows: np.ndarray, k: int) -> np.ndarray:
    """Rounded up."""
    rest = rows[:, k:].astype(np.float64)
    return (np.sqrt(np.einsum("nd,nd->n", rest, rest)) * (1 + 1e-6)).astype(np.float32)


def heads(width: int) -> list[int]:
    """Numbers of leading components by which pairs may be told apart before whole products are taken."""
    return [width // 8, width // 4, 3 * width // 8, width // 2] if width >= 64 else []


def head_for(width: int, bars: np.ndarray) -> np.ndarray:
    """For each similarity the place in ``heads`` of the fewest components that mostly tell rows apart which do not reach it, or their number."""
    return np.searchsorted(heads(width), width * (1.12 - bars))


# Lengths of the tails of some rows, by the number of components before them.
Tails = Callable[[int], np.ndarray]


class Bounded:
    """Pairs that may reach a similarity, by products of heads.

    A product is at most that of the heads plus that of the lengths of the tails (Cauchy and
    Schwarz). Where that leaves too many pairs open, more components are taken in the end.
    """

    def __init__(self, width: int):
        self.heads = heads(width)
        self.tries, self.misses = [0] * len(self.heads), [0] * len(self.heads)

    def pairs(self, level: int, left: np.ndarray, left_tails: Tails, right: np.ndarray, right_tails: Tails, bar: np.ndarray | float) -> tuple[np.ndarray, ...] | None:
        """(i, j, product in float32) of all pairs that reach ``bar``, one for all or a column; None where whole products are cheaper."""
        while level < len(self.heads) and self.misses[level] > 2 and 2 * self.misses[level] > self.tries[level]:
            level += 1
        if level == len(self.heads):
            return None
        k = self.heads[level]
        self.tries[level] += 1
        most = np.c_[left[:, :k], left_tails(k)] @ np.c_[right[:, :k], right_tails(k)].T
        i, j = at_least(most, bar)
        if len(i) * 256 > most.size:
            self.misses[level] += 1
            return None
        sims = np.empty(len(i), np.float32)
        step = max(1, EXACT // left.shape[1])
        for s in range(0, len(i), step):
            sims[s : s + step] = np.einsum("nd,nd->n", left[i[s : s + step]], right[j[s : s + step]])
        keep = sims >= (bar[i, 0] if isinstance(bar, np.ndarray) else bar)
        return i[keep], j[keep], sims[keep]


def at_least(sims: np.ndarray, bar: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Where a matrix reaches ``bar``. NumPy searches a flat mask several times faster than one of two dimensions."""
    return np.divmod(np.flatnonzero(sims >= bar), max(sims.shape[1], 1))


def _vectors(rows: Vectors | np.ndarray) -> Vectors:
    return rows if isinstance(rows, Vectors) else Vectors(rows)


def margin(width: int) -> float:
    """Twice the error bound of a float32 product of unit vectors: one rounding per component, and those of the inputs."""
    return 2 * (width + 4) * 2.0**-24


def exact_dots(left: Vectors | np.ndarray, right: Vectors | np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    left, right = _vectors(left), _vectors(right)
    out = np.empty(len(i))
    step = max(1, EXACT // max(left.width, 1))
    for s in range(0, len(i), step):
        part = slice(s, s + step)
        out[part] = np.einsum("nd,nd->n", left.exact(i[part]), right.exact(j[part]))
    return out


class Segments:
    """Rows of two blocks in runs of one pivot and at most ``TILE`` rows, and which runs can hold a match."""

    def __init__(self, left: int, right: int, left_pivots: np.ndarray | None = None, right_pivots: np.ndarray | None = None, reach: np.ndarray | None = None):
        self.left, self.right, self.reach = _runs(left, left_pivots), _runs(right, right_pivots), reach

    def pairs(self, same: bool) -> Iterator[tuple[int, int, int, int]]:
        """Tiles that cover all pairs of runs in reach. Neighbouring runs go together up to ``TILE`` rows, on the
        left those that reach the same, as many small tiles cost more than their products."""
        k = 0
        while k < len(self.left):
            near = self._near(k)
            a, b, _ = self.left[k]
            k += 1
            while k < len(self.left) and self.left[k][1] - a <= TILE and (self._near(k) == near).all():
                b = self.left[k][1]
                k += 1
            if same:
                yield a, b, a, b
            c = d = -1
            for at in range(k if same else 0, len(self.right)):
                begin, end, _ = self.right[at]
                if not near[at]:
                    continue
                if begin == d and end - c <= TILE:
                    d = end
                    continue
                if c >= 0:
                    yield a, b, c, d
                c, d = begin, end
            if c >= 0:
                yield a, b, c, d

    def _near(self, k: int) -> np.ndarray:
        """Which runs on the right the run ``k`` on the left reaches."""
        if self.reach is None:
            return np.ones(len(self.right), bool)
        return self.reach[self.left[k][2], [q for _, _, q in self.right]]


def _runs(n: int, pivots: np.ndarray | None) -> list[tuple[int, int, int]]:
    starts = [0] if pivots is None else np.flatnonzero(np.r_[True, pivots[1:] != pivots[:-1]]).tolist()
    out = []
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        out += [(s, min(s + TILE, b), 0 if pivots is None else int(pivots[a])) for s in range(a, b, TILE)]
    return out


# Of the rows r to r_end on the left and c to c_end on the right: two masks.
Settled = Callable[[int, int, int, int], tuple[np.ndarray, np.ndarray]]


def similar_tiles(
    left: Vectors | np.ndarray,
    right: Vectors | np.ndarray,
    min_similarity: float,
    same: bool,
    segments: Segments | None = None,
    settled: Settled | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows at least ``min_similarity`` apart, one tile at a time.

    With ``same`` the two sides are one block and only i < j is given. ``settled`` is asked before each
    tile, knowing what was given so far, which of its rows need not meet one another any more;
    pairs of which one row at least is not settled are all given.
    """
    left, right = _vectors(left), _vectors(right)
    left32, right32 = left.unit, right.unit
    doubt = margin(left.width)
    head, bounded = int(head_for(left.width, min_similarity)), Bounded(left.width)
    for r, r_end, c, c_end in (segments or Segments(len(left), len(right))).pairs(same):
        parts = [(slice(r, r_end), slice(c, c_end))]
        if settled is not None:
            done_left, done_right = settled(r, r_end, c, c_end)
            if done_left.all() and done_right.all():
                continue
            if not (same and r == c) and done_left.mean() + done_right.mean() > 1:
                open_left, open_right = np.flatnonzero(~done_left) + r, np.flatnonzero(~done_right) + c
                parts = [(open_left, slice(c, c_end)), (np.flatnonzero(done_left) + r, open_right)]
        for rows, columns in parts:
            a, b = left32[rows], right32[columns]
            if not (len(a) and len(b)):
                continue
            found = bounded.pairs(head, a, lambda k, at=rows: left.tails(k)[at], b, lambda k, at=columns: right.tails(k)[at], min_similarity - doubt)
            if found is None:
                whole = a @ b.T
                i, j = at_least(whole, min_similarity - doubt)
                found = i, j, whole[i, j]
                del whole
            i, j, sims = found
            if same and r == c:
                upper = i < j
                i, j, sims = i[upper], j[upper], sims[upper]
            if len(i) == 0:
                continue
            close = np.flatnonzero(sims < min_similarity + doubt)
            i, j = (at.start + k if isinstance(at, slice) else at[k] for at, k in ((rows, i), (columns, j)))
            if len(close):
                keep = np.ones(len(i), dtype=bool)
                keep[close] = exact_dots(left, right, i[close], j[close]) >= min_similarity
                i, j = i[keep], j[keep]
            if len(i):
                yield i, j


def best_match(left: Vectors | np.ndarray, right: Vectors | np.ndarray, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each left row the most similar right row (the first of equals) and its similarity.

    ``floor`` is a similarity per left row that it has found elsewhere: a row without any that is as near gets -1.
    Without it the right rows are gone through by their heads first, and what each left row has in
    the most likely one is a floor: rows that have a near match need not meet the others in full.
    """
    left, right = _vectors(left), _vectors(right)
    best = np.full(len(left), -np.inf)
    arg = np.full(len(left), -1, dtype=np.int64)
    right32, doubt, bounded = right.unit, margin(left.width), Bounded(left.width)
    for r in range(0, len(left), TILE):
        rows = left.exact(slice(r, r + TILE)).astype(np.float32)
        tails = cache(partial(tail_lengths, rows))
        bar = _likely(left, right, rows, r) if floor is None else floor[r : r + TILE].astype(np.float64)
        for c in range(0, len(right), TILE):
            levels = head_for(left.width, bar)
            for level in np.unique(levels).tolist():
                some = np.flatnonzero(levels == level)
                a, b = (rows if len(some) == len(rows) else rows[some]), right32[c : c + TILE]
                low = (bar[some] - doubt).astype(np.float32)[:, None]
                found = bounded.pairs(level, a, lambda k: tails(k)[some], b, lambda k: right.tails(k)[c : c + TILE], low)
                if found is None:
                    whole = a @ b.T
                    top = whole.max(axis=1)
                    hit = np.flatnonzero(top >= bar[some] - doubt)
                    i, j = at_least(whole[hit], (top[hit] - doubt)[:, None])
                    i = hit[i]
                    found = i, j, whole[i, j]
                    del whole
                i, j, sims = found
                top = bar[some]
                np.maximum.at(top, i, sims)
                near = sims >= top[i] - doubt
                i, j = some[i[near]], j[near]
                if len(i) == 0:
                    continue
                exact = exact_dots(left, right, i + r, j + c)
                order = np.lexsort((j, -exact, i))
                first = order[np.unique(i[order], return_index=True)[1]]
                at = i[first] + r
                better = exact[first] > best[at]
                best[at[better]] = exact[first][better]
                arg[at[better]] = j[first][better] + c
            bar = np.maximum(bar, best[r : r + TILE])
    if floor is not None:
        arg[best < floor] = -1
    return arg, best


def _likely(left: Vectors, right: Vectors, rows: np.ndarray, r: int) -> np.ndarray:
    """For each of ``rows``, those from ``r`` on, its similarity to the right row that by their heads may be the nearest."""
    k = left.width // 8
    if left.width < 64 or len(right) <= 2 * TILE:
        return np.full(len(rows), -np.inf)
    lead, which = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
    own = np.c_[rows[:, :k], tail_lengths(rows, k)]
    for c in range(0, len(right), TILE):
        most = own @ np.c_[right.unit[c : c + TILE, :k], right.tails(k)[c : c + TILE]].T
        at = most.argmax(axis=1)
        top = most[np.arange(len(at)), at]
        better = top > lead
        lead[better], which[better] = top[better], at[better] + c
    return exact_dots(left, right, np.arange(len(rows)) + r, which)


class Forest:
    """Smallest reachable index per row, kept while pairs stream in."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            open_pairs = a != b
            if not open_pairs.any():
                return
            i, j, a, b = i[open_pairs], j[open_pairs], a[open_pairs], b[open_pairs]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                shorter = self.root[self.root]
                if (shorter == self.root).all():
                    break
                self.root = shorter

    def joined(self, shift: int, among: np.ndarray | None = None) -> Settled:
        """Rows that are in one part already, the most frequent one of the left tile; those not ``among`` never are.

        ``shift`` is where the right rows begin.
        """

        def settled(r: int, r_end: int, c: int, c_end: int) -> tuple[np.ndarray, np.ndarray]:
            sides = slice(r, r_end), slice(c + shift, c_end + shift)
            free = [np.ones(s.stop - s.start, bool) if among is None else among[s] for s in sides]
            roots, count = np.unique(self.root[sides[0]][free[0]], return_counts=True)
            if not len(roots):
                return ~np.ones(r_end - r, bool), ~np.ones(c_end - c, bool)
            part = roots[count.argmax()]
            return tuple((self.root[s] == part) & f for s, f in zip(sides, free, strict=True))

        return settled
