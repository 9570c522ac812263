"""Nearest vectors in numpy, inside tasks: a product of matrices proposes candidates, and each candidate's own distance decides.

Products differ in their last bits by where a row stands, distances of single pairs don't: copies of a vector are equally far, and ties go by id.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: numbers of a product at once
CELLS = 1 << 22
#: ranks are by nine decimals; what may round to the same is compared by itself
SAME = 2e-9


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors of a list column, without null and empty ones; null parts are NaN."""
    column = column.cast(pa.list_(pa.float64()))
    size = np.asarray(column.value_lengths().fill_null(0))
    flat, end = column.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False), np.cumsum(size)
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        yield rows, flat[(end[rows] - dim)[:, None] + np.arange(dim)]


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    size = norms(x) * norms(y)
    return np.divide(np.einsum("ij,ij->i", x, y), size, out=np.zeros(len(x)), where=size != 0)


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of x the row of c of largest cosine by nine decimals, ties to the first; a norm of 0 makes it 0, and what isn't a number counts for most."""
    out = np.zeros(len(x), np.int64)
    with np.errstate(invalid="ignore", over="ignore"):
        unit = lambda m: np.divide(m, norms(m)[:, None], out=np.zeros_like(m), where=norms(m)[:, None] != 0)
        cu = unit(c).T
        odd = np.flatnonzero(np.isnan(cu).any(axis=0))
        rows = np.flatnonzero(np.isfinite(x).all(axis=1) & (x != 0).any(axis=1))
        if len(odd):
            out[:] = odd[0]
            return out
        step = max(1, CELLS // max(1, len(c)))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            s = unit(x[part]) @ cu
            out[part] = s.argmax(axis=1)
            close = s >= s.max(axis=1, keepdims=True) - SAME
            several = np.flatnonzero(close.sum(axis=1) > 1)
            r, j = np.nonzero(close[several])
            for at in np.array_split(np.arange(len(several)), max(1, -(-len(r) * c.shape[1] // CELLS))):
                own = (r >= at[0]) & (r <= at[-1]) if len(at) else np.zeros(len(r), bool)
                ro, jo = r[own], j[own]
                if len(ro):
                    sim = np.round(_cosines(x[part[several[ro]]], c[jo]), 9)
                    first = np.lexsort((jo, -sim, ro))
                    first = first[np.searchsorted(ro[first], np.unique(ro))]
                    out[part[several[ro[first]]]] = jo[first]
    return out


class Nearest:
    """The k nearest of each of some points among the vectors that are told, by L2 or (cosine) by cosines with their sign turned; ties by id.

    A point's k-th distance so far is the bar for further candidates. What waits to be sorted is bounded, as is what is kept: k of each point.
    """

    def __init__(self, ids: pa.Array, points: list[np.ndarray], k: int, cosine: bool = False):
        self.ids, self.k, self.cosine = ids, k, cosine
        self.groups = {}
        for dim in {len(p) for p in points}:
            at = np.array([i for i, p in enumerate(points) if len(p) == dim], np.int64)
            x = np.array([points[i] for i in at], np.float64).reshape(len(at), dim)
            fine = np.isfinite(x).all(axis=1)
            self.groups[dim] = at[fine], x[fine]
        self.place = np.full(len(points), -1, np.int64)
        for at, _ in self.groups.values():
            self.place[at] = np.arange(len(at))
        self.bar = np.full(len(points), np.inf)
        self.kept: pa.Table | None = None
        self.wait: list[pa.Table] = []
        self.waiting = 0

    def add(self, x: np.ndarray, ids: pa.Array, asked: np.ndarray | None = None) -> None:
        """Tell vectors of one length to the points `asked` (None: all)."""
        at, q = self.groups.get(x.shape[1], (np.zeros(0, np.int64), None))
        if asked is not None:
            if not len(at):
                return
            own = asked[(self.place[asked] >= 0)]
            own = own[np.isin(own, at, assume_unique=True)] if len(self.groups) > 1 else own
            at, q = own, q[self.place[own]]
        rows = np.flatnonzero(np.isfinite(x).all(axis=1))
        for i in range(0, len(rows) if len(at) else 0, 2048):
            part = rows[i : i + 2048]
            step = max(1, CELLS // len(part))
            for j in range(0, len(at), step):
                self._some(x[part], ids, part, at[j : j + step], q[j : j + step])

    def _some(self, x: np.ndarray, ids: pa.Array, rows: np.ndarray, at: np.ndarray, q: np.ndarray) -> None:
        if self.cosine:
            unit = lambda m: np.divide(m, norms(m)[:, None], out=np.zeros_like(m), where=norms(m)[:, None] != 0)
            low = -(unit(q) @ unit(x).T) - 1e-12
            over = lambda d: d + SAME
        else:
            # squared distances, lowered by more than a product may be wrong
            x2, q2 = (np.einsum("ij,ij->i", m, m) * (1 - 1e-12) for m in (x, q))
            low = np.column_stack((-2 * q, q2, np.ones(len(q)))) @ np.column_stack((x, np.ones(len(x)), x2)).T
            over = lambda d: (d + SAME) ** 2
        near = low <= over(self.bar[at])[:, None]
        if np.count_nonzero(near) > 4 * self.k * len(at) and len(x) > self.k:
            # no more than what these rows alone leave; their k-th is only known as exactly as products are
            kth = np.partition(low, self.k - 1, axis=1)[:, self.k - 1]
            if self.cosine:
                most = kth + 2e-12 + SAME
            else:
                most = (np.sqrt(np.maximum(kth + 4e-12 * (q2 + x2.max()), 0)) + SAME) ** 2
            near &= low <= most[:, None]
        p, r = np.nonzero(near)
        for i in range(0, len(p), max(1, CELLS // x.shape[1])):
            a, b = p[i : i + CELLS // x.shape[1]], r[i : i + CELLS // x.shape[1]]
            if self.cosine:
                d = -_cosines(x[b], q[a])
            else:
                away = x[b] - q[a]
                d = norms(away)
            own = np.round(d, 9) <= self.bar[at[a]]
            a, b, d = a[own], b[own], d[own]
            self.wait.append(pa.table({"place": at[a], "r": np.round(d, 9), "id": ids.take(pa.array(rows[b])), "distance": d}))
            self.waiting += len(a)
            if self.waiting > 100_000 + 2 * self.k * len(self.bar):
                self._sort()
        if self.kept is None:
            self._sort()

    def _sort(self) -> None:
        t = pa.concat_tables([*([self.kept] if self.kept is not None else []), *self.wait]).combine_chunks() if self.wait or self.kept is not None else None
        self.wait, self.waiting = [], 0
        if t is None:
            return
        t = t.take(pc.sort_indices(t, [("place", "ascending"), ("r", "ascending"), ("id", "ascending")]))
        p = t["place"].to_numpy()
        rank = np.arange(len(p)) - np.searchsorted(p, p)
        t = t.filter(pa.array(rank < self.k)).combine_chunks()
        rank = rank[rank < self.k]
        last = np.flatnonzero(rank == self.k - 1)
        self.bar[t["place"].to_numpy()[last]] = t["r"].to_numpy()[last]
        self.kept = t

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(query_id, id, distance) of what was found."""
        self._sort()
        if self.kept is not None and self.kept.num_rows:
            t = self.kept
            yield from pa.table({"query_id": self.ids.take(t["place"].combine_chunks()), "id": t["id"], "distance": t["distance"]}).to_batches(max_chunksize=10_000)


def leading(x: np.ndarray, c: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of c): for each row of x its m rows of c of largest cosine by nine decimals, ties to the first."""
    if m >= len(c):
        return np.repeat(np.arange(len(x)), len(c)), np.tile(np.arange(len(c)), len(x))
    unit = lambda v: np.divide(v, norms(v)[:, None], out=np.zeros_like(v), where=norms(v)[:, None] != 0)
    cu, found = unit(c).T, []
    step = max(1, CELLS // max(len(c), m * c.shape[1]))
    for i in range(0, len(x), step):
        s = unit(x[i : i + step]) @ cu
        r, j = np.nonzero(s >= np.partition(s, len(c) - m, axis=1)[:, len(c) - m, None] - SAME)
        sim = np.round(_cosines(x[i + r], c[j]), 9)
        order = np.lexsort((j, -sim, r))
        r, j = r[order], j[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < m
        found.append((i + r[first], j[first]))
    r, j = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return r, j


class Asked:
    """Which points ask for which clusters. Clusters that the same points ask for are one group, so that what goes to every task is bounded by the different
    sets of points."""

    def __init__(self, ids: pa.Array, points: list[np.ndarray]):
        self.ids, self.points = ids, points
        self.number, self.group, self.sets, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), [], {}

    def _set(self, points: np.ndarray) -> int:
        at = self.known.setdefault(points.astype(np.int32).tobytes(), len(self.sets))
        if at == len(self.sets):
            self.sets.append(points)
        return at

    def _add(self, number: np.ndarray, group: np.ndarray) -> None:
        self.number, self.group = np.append(self.number, number), np.append(self.group, group)

    def tell(self, number: np.ndarray, points: np.ndarray) -> None:
        """All these clusters are asked for by these points (in order); a cluster is told once."""
        if len(number) and len(points):
            self._add(number, np.full(len(number), self._set(points)))

    def tell_pairs(self, points: np.ndarray, number: np.ndarray) -> None:
        """Each point asks for the cluster beside it."""
        order = np.lexsort((points, number))
        each, at = np.unique(number[order], return_index=True)
        self._add(each, np.array([self._set(own) for own in np.split(points[order], at[1:])] if len(each) else [], np.int64))

    def done(self) -> tuple:
        order = np.argsort(self.number)
        return self.ids, self.points, self.number[order], self.group[order], self.sets


def probing(shared, k: int):
    """Rows (id, vector, cluster_id): each task's k nearest of each point among the clusters that it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, number, group, sets = shared.value
        near = Nearest(ids, points, k)
        for batch in batches:
            if not batch.num_rows or not len(number):
                continue
            cluster = batch["cluster_id"].to_numpy()
            at = np.minimum(np.searchsorted(number, cluster), len(number) - 1)
            own = np.where(number[at] == cluster, group[at], -1)
            for g in np.unique(own[own >= 0]).tolist():
                part = batch.take(pa.array(np.flatnonzero(own == g)))
                for rows, x in by_length(part["vector"]):
                    near.add(x, part["id"].take(pa.array(rows)), sets[g])
        yield from near.batches()

    return run
