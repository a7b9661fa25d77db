"""Exact k nearest by inner product over blocks of sparse rows: bounds, then single products, then doubles.

Rows of a block are grouped around a few centres and looked at in chunks, over
the columns that a chunk has.  Centres, chunks and single products only say
which pairs are worth a sum in doubles; that sum goes over a row's entries in
their order, so equal rows score equally and ties are ties.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Rows looked at together, centres, cells of the sample that centres are fitted on, pairs summed in doubles at once; none affects results.
CHUNK, CENTRES, SAMPLE_CELLS, PAIRS = 1024, 16, 1 << 20, 1 << 14

#: Share of a product of lengths that single precision may be off by: of the leading products, and of each entry.
HEAD_SLACK, ENTRY_SLACK = 1e-5, 2.0**-23

NONE = np.iinfo(np.int64).max


class Sparse(NamedTuple):
    """Rows one after another: where each starts, columns and values of the entries."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of ``rows``, and which of ``rows`` each belongs to."""
        n = self.start[rows + 1] - self.start[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return np.arange(len(of)) + np.repeat(self.start[rows] - (np.cumsum(n) - n), n), of

    def take(self, rows: np.ndarray) -> Sparse:
        at, of = self.entries(rows)
        return Sparse(np.r_[0, np.cumsum(np.bincount(of, minlength=len(rows)))], self.index[at], self.value[at])

    def dense(self, rows: np.ndarray, width: int, dtype=np.float64, place: np.ndarray | None = None) -> np.ndarray:
        """``rows`` as a matrix, columns renumbered by ``place`` where it is given."""
        at, of = self.entries(rows)
        out = np.zeros((len(rows), width), dtype=dtype)
        out[of, self.index[at] if place is None else place[self.index[at]]] = self.value[at]
        return out

    def lengths(self) -> np.ndarray:
        return np.sqrt(np.bincount(np.repeat(np.arange(len(self)), np.diff(self.start)), weights=self.value**2, minlength=len(self)))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    start = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return start - start[0], column.flatten().to_numpy(zero_copy_only=False)


def sparse(index: pa.Array | pa.ChunkedArray, value: pa.Array | pa.ChunkedArray) -> Sparse:
    start, columns = flat(index)
    return Sparse(start, columns.astype(np.int32), flat(value)[1].astype(np.float64))


def centres(rows: Sparse, width: int) -> np.ndarray:
    """Directions around which rows lie: spherical k-means over a bounded sample."""
    n = min(len(rows), max(CENTRES, SAMPLE_CELLS // max(1, width)))
    x = rows.dense(np.linspace(0, len(rows) - 1, n).astype(np.int64), width)
    found = x[np.linspace(0, n - 1, CENTRES).astype(np.int64)]
    for _ in range(8):
        near = np.argmax(x @ found.T, axis=1)
        for j in range(CENTRES):
            mean = x[near == j].sum(axis=0)
            if mean.any():
                found[j] = mean / np.linalg.norm(mean)
    return found


def heads(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates in ``basis`` and, last, the length of what is left: products of two heads bound products of rows."""
    lead = x @ basis
    rest = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1) - (lead * lead).sum(axis=1)))
    return np.c_[lead, rest].astype(np.float32)


class Block(NamedTuple):
    """Rows to be found, grouped around ``centres``."""

    rows: Sparse
    ids: np.ndarray
    labels: np.ndarray
    heads: np.ndarray
    centres: np.ndarray
    basis: np.ndarray
    width: int
    length: float
    plain: bool


def block_of(rows: Sparse, ids: np.ndarray, labels: np.ndarray, width: int) -> Block:
    around = centres(rows, width)
    basis = np.linalg.qr(around.T)[0]
    group, head = np.zeros(len(rows), dtype=np.int64), np.zeros((len(rows), basis.shape[1] + 1), dtype=np.float32)
    few = CHUNK // 4
    for at in range(0, len(rows), few):
        x = rows.dense(np.arange(at, min(at + few, len(rows))), width)
        group[at : at + few], head[at : at + few] = np.argmax(x @ around.T, axis=1), heads(x, basis)
    order = np.lexsort((ids, group))
    return Block(rows.take(order), ids[order], labels[order], head[order], around, basis, width, rows.lengths().max(initial=0.0), plain(rows.value))


def plain(values: np.ndarray) -> bool:
    """Whether a product of such values that is 0 in single precision is 0: no signs to cancel, nothing to underflow."""
    return bool(((values == 0) | (values > 1e-15)).all())


class Best:
    """The k best of each asked row: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.near, self.label = np.full((n, k), -np.inf), np.full((n, k), NONE), np.full((n, k), np.nan)

    @classmethod
    def read(cls, score: pa.Array, near: pa.Array, label: pa.Array, k: int) -> Best:
        out = cls(len(score), k)
        start, values = flat(score)
        of = np.repeat(np.arange(len(score)), np.diff(start))
        at = of, np.arange(len(of)) - start[of]
        out.score[at], out.near[at], out.label[at] = values, flat(near)[1], flat(label)[1]
        return out

    def lists(self) -> list[pa.Array]:
        there = self.near != NONE
        start = pa.array(np.r_[0, np.cumsum(there.sum(axis=1))], pa.int32())
        return [pa.ListArray.from_arrays(start, pa.array(x[there])) for x in (self.score, self.near, self.label)]

    def put(self, rows: np.ndarray, of: np.ndarray, score: np.ndarray, near: np.ndarray, label: np.ndarray) -> None:
        """Found pairs; ``of`` says for which of ``rows``."""
        q = np.r_[np.repeat(np.arange(len(rows)), self.k), of]
        s, n, y = np.r_[self.score[rows].ravel(), score], np.r_[self.near[rows].ravel(), near], np.r_[self.label[rows].ravel(), label]
        order = np.lexsort((y, n, -s, q))
        many = np.bincount(q, minlength=len(rows))
        first = (np.cumsum(many) - many)[:, None] + np.arange(self.k)
        top = order[first]
        self.score[rows], self.near[rows], self.label[rows] = s[top], n[top], y[top]


def _sums(q: np.ndarray, i: np.ndarray, rows: Sparse, j: np.ndarray) -> np.ndarray:
    """Products in doubles of pairs, each summed over the entries of its row in their order."""
    out = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        place, of = rows.entries(j[at : at + PAIRS])
        out[at : at + PAIRS] = np.bincount(of, weights=q[i[at : at + PAIRS][of], rows.index[place]] * rows.value[place], minlength=len(out[at : at + PAIRS]))
    return out


def look(asked: Sparse, best: Best, block: Block, together: int) -> None:
    """Puts those rows of ``block`` into ``best`` that belong there; asked rows near one centre go ``together``."""
    chunks = [np.arange(at, min(at + CHUNK, len(block.rows))) for at in range(0, len(block.rows), CHUNK)]
    lead = np.stack([block.heads[c, :-1].mean(axis=0) for c in chunks])
    columns = [np.unique(block.rows.index[block.rows.start[c[0]] : block.rows.start[c[-1] + 1]]) for c in chunks]
    group = np.zeros(len(asked), dtype=np.int64)
    for at in range(0, len(asked), together):
        group[at : at + together] = np.argmax(asked.dense(np.arange(at, min(at + together, len(asked))), block.width) @ block.centres.T, axis=1)
    order = np.argsort(group, kind="stable")
    place = np.zeros(block.width, dtype=np.int64)
    for at in range(0, len(order), together):
        rows = order[at : at + together]
        q = asked.dense(rows, block.width)
        single, head = q.astype(np.float32), heads(q, block.basis)
        reach = np.sqrt((q * q).sum(axis=1)) * block.length
        margin = reach * ENTRY_SLACK * (8 + (asked.start[rows + 1] - asked.start[rows]))
        exact_zeros = block.plain and plain(q)
        for number in np.argsort(-(lead @ head[:, :-1].mean(axis=0)), kind="stable"):
            chunk, used = chunks[number], columns[number]
            least = best.score[rows, -1]
            may = head @ block.heads[chunk].T >= np.nextafter((least - HEAD_SLACK * reach).astype(np.float32), np.float32(-np.inf))[:, None]
            some, there = np.nonzero(may.any(axis=1))[0], np.nonzero(may.any(axis=0))[0]
            if not len(some):
                continue
            place[used] = np.arange(len(used))
            s = single[np.ix_(some, used)] @ block.rows.dense(chunk[there], len(used), np.float32, place).T
            floor = least[some] - margin[some]
            hit = s >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None]
            full = np.nonzero(hit.sum(axis=1) > 4 * best.k)[0]
            if len(full):
                kth = -np.partition(-s[full], best.k - 1, axis=1)[:, best.k - 1] - 2 * margin[some[full]]
                hit[full] &= s[full] >= np.nextafter(kth.astype(np.float32), np.float32(-np.inf))[:, None]
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            score = np.zeros(len(i))
            summed = s[i, j] != 0 if exact_zeros else np.ones(len(i), dtype=bool)
            found = chunk[there[j]]
            score[summed] = _sums(q, some[i[summed]], block.rows, found[summed])
            best.put(rows, some[i], score, block.ids[found], block.labels[found])
