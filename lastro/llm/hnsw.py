"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Vectors of one label are dealt into shards. Each shard's graph is built once, in numpy and
many points at a time, audited and written; links are added until paths of the lowest layer
lead from the entry to every point. Any two shards, or a shard with itself, then meet in one
task, and either side is looked up in the other's graph; what one direction finds holds for
both. Of two shards, only points that may have a link in the other are looked up: a quarter of
the components, turned at random, bounds every cosine from above. A lookup is greedy descent through the upper layers, a beam in the lowest, then all
that hangs together above a slack below the limit, so that a group larger than the beam is
found whole.

A graph's audit takes vectors drawn from its points and vectors made to have a link at a
drawn point, finds all their links by brute force, and passes if the graph finds them too;
beam and slack widen until a fresh audit passes. A beam of more than one in EVERY points of
the shard costs more than one that holds them all, which needs no audit. What the passing
audits tested is logged.

Links are those whose cosine in double precision reaches the limit. A task returns counts
and a spanning forest of its links, never all pairs. Vectors that are equal, or equal but for
a power of two as their factor, are one point, whatever the number of such copies.
"""

from __future__ import annotations

import io
import logging
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import checkpoint, importable, join_spread
from lastro.llm.graph import components

#: Links of a point in upper layers (twice as many in the lowest); beam while building.
LINKS, BUILD_BEAM = 12, 48
#: Points of a shard; queries or points at a time, a multiple of 8.
SHARD_POINTS, TOGETHER = 16384, 128
FIRST_BEAM, FIRST_SLACK = 32, 0.02
#: Points of the layer above from which a query enters the lowest.
STARTS = 16
#: Drawn points, and made vectors, that an audit takes; see the module's text.
AUDITED, EVERY = 384, 16
#: Turned components that bound cosines: one in SHARE, LEAST_SHORT at least; what rounding may take from the bound.
SHARE, LEAST_SHORT, ROUNDING = 4, 16, 1e-4
#: Links by which a point may lead to one that no path led to.
EXTRA = 8
LOG = logging.getLogger(__name__)


class Graph:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, points: np.ndarray, seed: int = 1):
        self.points = points.astype(np.float32)
        n = len(points)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(np.int64), 5)
        order = np.argsort(-self.level, kind="stable")
        self.links = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int64) for k in range(int(self.level.max()) + 1)] if n else []
        self.entry = int(order[0]) if n else -1
        for a in range(1, n, TOGETHER):
            self._insert(order[a : a + TOGETHER])
        if n:
            self._connect()

    def dump(self) -> bytes:
        """The links; with the same points in the same order, load() gives the graph again."""
        out, upper = io.BytesIO(), [np.flatnonzero((held >= 0).any(axis=1)) for held in self.links[1:]]
        arrays = {"entry": np.array(self.entry), "layers": np.array(len(self.links)), "low": self.links[0].astype(np.int32)}
        for k, rows in enumerate(upper, 1):
            arrays |= {f"rows{k}": rows.astype(np.int32), f"held{k}": self.links[k][rows].astype(np.int32)}
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, points: np.ndarray, data: bytes) -> Graph:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as held:
            self.points, self.entry = points.astype(np.float32), int(held["entry"])
            self.links = [held["low"].astype(np.int64)]
            for k in range(1, int(held["layers"])):
                self.links.append(np.full((len(points), LINKS), -1, np.int64))
                self.links[k][held[f"rows{k}"]] = held[f"held{k}"]
        return self

    @cached_property
    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """Which points paths of the lowest layer lead to from the entry, and from which ones they lead to it."""
        n = len(self.points)
        if not n:
            return np.zeros(0, bool), np.zeros(0, bool)
        start, k = np.nonzero(self.links[0] >= 0)
        end = self.links[0][start, k]
        out = []
        for a, b in ((start, end), (end, start)):
            by = np.argsort(a, kind="stable")
            b, first = b[by], np.searchsorted(a[by], np.arange(n + 1))
            seen = np.zeros(n, bool)
            seen[self.entry] = True
            edge = np.array([self.entry])
            while len(edge):
                size = first[edge + 1] - first[edge]
                at = np.repeat(first[edge] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                edge = np.unique(b[at])
                edge = edge[~seen[edge]]
                seen[edge] = True
            out.append(seen)
        return out[0], out[1]

    def _connect(self) -> None:
        """Adds links, EXTRA from a point at most, until paths lead from the entry to every point."""
        while not self.paths[0].all():
            width = 2 * LINKS
            if self.links[0].shape[1] == width:
                self.links[0] = np.concatenate((self.links[0], np.full((len(self.points), EXTRA), -1, np.int64)), axis=1)
            more = self.links[0][:, width:]
            lost = np.flatnonzero(~self.paths[0])[:4096]  # the rest in a later round
            free = np.flatnonzero(self.paths[0] & (more[:, -1] < 0))
            near, sims = np.empty(len(lost), np.int64), np.empty(len(lost))
            for a in range(0, len(lost), TOGETHER):
                s = self.points[lost[a : a + TOGETHER]] @ self.points[free].T
                best = s.argmax(axis=1)
                near[a : a + TOGETHER], sims[a : a + TOGETHER] = free[best], s[np.arange(len(s)), best]
            # One link from each point in a round; what it leads to may lead to the others.
            _, first = np.unique(near[np.argsort(-sims, kind="stable")], return_index=True)
            taken = np.argsort(-sims, kind="stable")[first]
            slot = (more[near[taken]] >= 0).sum(axis=1)
            more[near[taken], slot] = lost[taken]
            del self.paths

    def _insert(self, new: np.ndarray) -> None:
        at = np.full((len(new), BUILD_BEAM), -1, np.int64)
        at[:, 0] = self.entry
        inside = self.points[new] @ self.points[new].T
        for layer in range(len(self.links) - 1, -1, -1):
            here = self.level[new] >= layer
            if not here.all():
                lower = np.flatnonzero(~here)
                at[lower, 0] = self._greedy(self.points[new[lower]], at[lower, 0], layer)
            mine = np.flatnonzero(here)
            if not len(mine):
                continue
            ids, sims = self._beam(self.points[new[mine]], at[mine], layer, BUILD_BEAM)
            at[mine] = ids
            # Points that come together see each other too.
            own = inside[np.ix_(mine, mine)].copy()
            np.fill_diagonal(own, -2)
            ids = np.concatenate((ids, np.broadcast_to(new[mine], own.shape)), axis=1)
            sims = np.concatenate((sims, own), axis=1)
            near = self._choose(ids, sims, LINKS)
            self.links[layer][new[mine], :LINKS] = near
            self._link_back(new[mine], near, layer)

    def _link_back(self, new: np.ndarray, near: np.ndarray, layer: int) -> None:
        """Links the points `near` to those that have linked to them; a full list is chosen anew."""
        links, width = self.links[layer], self.links[layer].shape[1]
        row, k = np.nonzero(near >= 0)
        to, what = near[row, k], new[row]
        sims = np.einsum("ij,ij->i", self.points[to], self.points[what])
        by = np.lexsort((-sims, to))
        to, what = to[by], what[by]
        targets, first, group = np.unique(to, return_index=True, return_inverse=True)
        place = np.arange(len(to)) - first[group]
        keep = place < width  # of those that come at once, the nearest
        come = np.full((len(targets), width), -1, np.int64)
        come[group[keep], place[keep]] = what[keep]
        for a in range(0, len(targets), TOGETHER):
            t, c = targets[a : a + TOGETHER], come[a : a + TOGETHER]
            held = links[t]
            c = np.where((held[:, :, None] == c[:, None, :]).any(axis=1), -1, c)
            every = np.concatenate((held, c), axis=1)
            over = (every >= 0).sum(axis=1) > width
            packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable")[:, :width], axis=1)
            if over.any():
                x = every[over]
                packed[over] = self._choose(x, np.where(x >= 0, np.einsum("ikj,ij->ik", self.points[x], self.points[t[over]]), -2), width)
            links[t] = packed

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row of candidates (-1 for none), near points in different directions first, then the nearest of the rest."""
        by = np.argsort(ids, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, by, axis=1), np.take_along_axis(sims, by, axis=1)
        sims = np.where(ids < 0, -3, sims)
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -3
        by = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, by, axis=1), np.take_along_axis(sims, by, axis=1)
        there = sims > -1.5
        ids, sims, there = (x[:, : max(most, int(there.sum(axis=1).max()))] for x in (ids, sims, there))
        x = self.points[ids]
        between = x @ x.transpose(0, 2, 1)
        chosen, count, nearest = np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64), np.full(ids.shape, -2, np.float32)
        for i in range(ids.shape[1]):
            take = there[:, i] & (nearest[:, i] < sims[:, i]) & (count < most)
            chosen[:, i] = take
            count += take
            nearest[take] = np.maximum(nearest[take], between[take, i])
        rank = np.where(chosen, 0, np.where(there, 1, 2))
        by = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(rank, by, axis=1) < 2, np.take_along_axis(ids, by, axis=1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _greedy(self, q: np.ndarray, at: np.ndarray, layer: int) -> np.ndarray:
        best = np.einsum("ij,ij->i", self.points[at], q)
        live = np.arange(len(q))
        at = at.copy()
        while len(live):
            near = self.links[layer][at[live]]
            sims = np.where(near >= 0, np.einsum("ikj,ij->ik", self.points[near], q[live]), -2)
            k = sims.argmax(axis=1)
            top = sims[np.arange(len(live)), k]
            better = top > best[live]
            live, near, k, top = live[better], near[better], k[better], top[better]
            at[live], best[live] = near[np.arange(len(live)), k], top
        return at

    def _beam(self, q: np.ndarray, at: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's points and similarities, best first; unused places are -1 and -2. at: a start for each, or several in a row, -1 for none."""
        n = len(q)
        seen = np.zeros((n, len(self.points)), bool)
        ids, sims = np.full((n, beam), -1, np.int64), np.full((n, beam), -2, np.float32)
        for start in at.reshape(n, -1).T[:beam]:
            k = np.flatnonzero(start >= 0)
            k = k[~seen[k, start[k]]]
            free = (ids[k] >= 0).sum(axis=1)
            ids[k, free], sims[k, free] = start[k], np.einsum("ij,ij->i", self.points[start[k]], q[k])
            seen[k, start[k]] = True
        fresh = ids >= 0
        while True:
            live = np.flatnonzero(fresh.any(axis=1))
            if not len(live):
                return ids, sims
            k = np.where(fresh[live], sims[live], -3).argmax(axis=1)
            node = ids[live, k]
            fresh[live, k] = False
            near = self.links[layer][node]
            new = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(near >= 0, near, node[:, None])] = True
            s = np.where(new, np.einsum("ikj,ij->ik", self.points[near], q[live]), -2)
            all_ids = np.concatenate((ids[live], np.where(new, near, -1)), axis=1)
            all_sims = np.concatenate((sims[live], s), axis=1)
            all_fresh = np.concatenate((fresh[live], new), axis=1)
            by = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live], fresh[live] = (np.take_along_axis(x, by, axis=1) for x in (all_ids, all_sims, all_fresh))

    def near(self, q: np.ndarray, beam: int, least: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) of similarity about `least` or more: the beam, and what hangs together with it.

        own: the points that the queries themselves are; the beam starts there too.
        """
        q = q.astype(np.float32)
        if not len(self.points):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.full(len(q), self.entry, np.int64)
        for layer in range(len(self.links) - 1, 1, -1):
            at = self._greedy(q, at, layer)
        if len(self.links) > 1:
            at = self._beam(q, at, 1, min(STARTS, beam))[0]
        at = at.reshape(len(q), -1)
        # What the entry reaches is within reach of every query then.
        at[~(self.paths[1][at] & (at >= 0)).any(axis=1), -1] = self.entry
        if own is not None:
            at = np.concatenate((own[:, None], at), axis=1)
        ids, sims = self._beam(q, at, 0, min(beam, len(self.points)))
        row, col = np.nonzero(sims >= least)
        point = ids[row, col]
        # What the beam saw but had no room for counts as new here.
        seen = np.zeros((len(q), len(self.points)), bool)
        seen[row, point] = True
        found = [(row, point)]
        while len(row):
            near = self.links[0][point]
            r, p = np.repeat(row, near.shape[1]), near.reshape(-1)
            ok = p >= 0
            r, p = r[ok], p[ok]
            ok = ~seen[r, p]
            both = np.unique(r[ok] * len(self.points) + p[ok])
            r, p = both // len(self.points), both % len(self.points)
            seen[r, p] = True
            good = np.concatenate([np.einsum("ij,ij->i", self.points[p[k : k + 65536]], q[r[k : k + 65536]]) >= least for k in range(0, len(r), 65536)] or [np.empty(0, bool)])
            row, point = r[good], p[good]
            found.append((row, point))
        return np.concatenate([r for r, _ in found]), np.concatenate([p for _, p in found])


def compare(queries: np.ndarray, points: np.ndarray, least: float) -> np.ndarray:
    return queries @ points.T >= least


class Lookup:
    """Finds a graph's points with a cosine of `least` or more in double precision; rows are unit vectors."""

    def __init__(self, points: np.ndarray, graph: Graph, least: float, beam: int = FIRST_BEAM, slack: float = FIRST_SLACK):
        self.points, self.graph, self.least, self.beam, self.slack = points, graph, least, beam, slack

    @property
    def whole(self) -> bool:
        """Whether the beam holds every point; its similarities are then one product."""
        return self.beam >= len(self.points)

    def widen(self, seed: int = 2, audited: int = AUDITED) -> int:
        """Widens beam and slack until a fresh audit finds every link; returns the links that it tested."""
        draw = np.random.default_rng(seed)
        while not self.whole:
            tested, missed = self.audit(draw, audited)
            if not missed:
                return tested
            wider = 2 * self.beam
            self.beam, self.slack = wider if wider * EVERY < len(self.points) else len(self.points), 2 * self.slack
        return 0

    def audit(self, draw: np.random.Generator, audited: int) -> tuple[int, int]:
        """Links of drawn points and of made vectors, and how many of them the graph doesn't find."""
        n, size = self.points.shape
        own = draw.permutation(n)[:audited]
        centres = self.points[draw.integers(0, n, audited)]
        aside = draw.normal(size=(audited, size))
        aside -= (aside * centres).sum(axis=1, keepdims=True) * centres
        aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-300)
        cosine = draw.uniform(self.least, 1, (audited, 1))
        made = cosine * centres + np.sqrt(1 - cosine**2) * aside
        made /= np.sqrt((made * made).sum(axis=1, keepdims=True))
        tested = missed = 0
        for queries, of in ((self.points[own], own), (made, None)):
            for a in range(0, len(queries), TOGETHER):
                q, k = queries[a : a + TOGETHER], None if of is None else of[a : a + TOGETHER]
                truth = compare(q, self.points, self.least)
                if k is not None:
                    truth[np.arange(len(q)), k] = False
                i, j = np.nonzero(truth & ~self.search(q, k))
                # Products of blocks and of pairs may differ in the last bit.
                missed += int((np.einsum("ij,ij->i", q[i], self.points[j]) >= self.least).sum())
                tested += int(truth.sum())
        return tested, missed

    def search(self, q: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """For each query, which points it is linked to. own: the points that the queries are."""
        if self.whole:
            return compare(q, self.points, self.least)
        out = np.zeros((len(q), len(self.points)), bool)
        r, p = self.graph.near(q, self.beam, self.least - self.slack, own)
        for k in range(0, len(r), 65536):
            i, j = r[k : k + 65536], p[k : k + 65536]
            out[i, j] = np.einsum("ij,ij->i", q[i], self.points[j]) >= self.least
        return out

    def blocks(self, queries: np.ndarray, same: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """The first of TOGETHER queries or less, and for each of them which points it is linked to. same: they are the points."""
        for a in range(0, len(queries), TOGETHER):
            own = np.arange(a, min(a + TOGETHER, len(queries)))
            yield a, self.search(queries[own], own if same else None)


def shortened(points: np.ndarray) -> np.ndarray:
    """Rows whose products are no less than those of the points, which are unit vectors: some turned components, and the length of the rest."""
    size = points.shape[1]
    kept = max(-(-size // SHARE), min(size, LEAST_SHORT))
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(size, size)))[0][:, :kept]
    x = points @ turn
    rest = np.sqrt(np.maximum(1 - (x * x).sum(axis=1, keepdims=True), 0))
    return np.concatenate((x, rest), axis=1).astype(np.float32)


def may_link(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the points of x, and of y, that may have a cosine of `least` or more with one of the other side; no other has one."""
    a, b = shortened(x), shortened(y).T
    left, right = np.zeros(len(x), bool), np.zeros(len(y), bool)
    for k in range(0, len(x), TOGETHER):
        near = a[k : k + TOGETHER] @ b >= least - ROUNDING
        left[k : k + TOGETHER] = near.any(axis=1)
        if left[k : k + TOGETHER].any():
            right |= near.any(axis=0)
    return np.flatnonzero(left), np.flatnonzero(right)


def pairs(x: Lookup, y: Lookup | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some points of x, TOGETHER at most, and for each of them which points of y (of x, if y is None) it is linked to; points without links may be left out.

    Either side is looked up in the other's graph, and what one direction finds holds for
    both. Links are held as bits, so that a shard linked throughout takes 32 MB a direction.
    """
    same = y is None
    if same:
        rows = cols = np.arange(len(x.points))
        there = np.concatenate([np.packbits(m, axis=1) for _, m in x.blocks(x.points, True)])
        back = there
    else:
        rows, cols = may_link(x.points, y.points, x.least)
        if not len(rows):
            return
        there = np.concatenate([np.packbits(m, axis=1) for _, m in y.blocks(x.points[rows])])
        back = np.concatenate([np.packbits(m[:, rows], axis=1) for _, m in x.blocks(y.points[cols])])
    width = len(x.points) if same else len(y.points)
    for a in range(0, len(rows), TOGETHER):
        n = min(TOGETHER, len(rows) - a)
        both = np.unpackbits(there[a : a + n], axis=1, count=width).view(bool)
        turned = np.unpackbits(back[:, a // 8 : (a + n + 7) // 8], axis=1, count=n).view(bool).T
        if same:
            both |= turned
            both[np.arange(n), a + np.arange(n)] = False
        else:
            both[:, cols] |= turned
        yield rows[a : a + n], both


class Forest:
    """Which links join what earlier ones don't, among n points."""

    def __init__(self, n: int):
        self.tree, self.kept = np.arange(n), []

    def add(self, row: int, cols: np.ndarray) -> None:
        trees, first = np.unique(self.tree[cols], return_index=True)
        other = trees != self.tree[row]
        if other.any():
            self.kept += [(row, c) for c in cols[first[other]].tolist()]
            into = np.arange(len(self.tree))
            into[trees] = self.tree[row]
            self.tree = into[self.tree]


def _unit(column) -> np.ndarray:
    flat = np.array(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten(), np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


BUILT = "label long, size int, shard long, points long, tested long, beam int, slack double, links binary"


def _build(least: float):
    """A shard's graph and what its audits tell."""

    def run(key, rows):
        rows = rows.sort_by("point")
        x = _unit(rows.column("embedding"))
        found = Lookup(x, Graph(x), least)
        tested = found.widen()
        links = b"" if found.whole else found.graph.dump()
        return pa.table({"label": [key[0].as_py()], "size": pa.array([key[1].as_py()], pa.int32()), "shard": [key[2].as_py()], "points": [len(x)], "tested": [tested], "beam": pa.array([found.beam], pa.int32()), "slack": [found.slack], "links": pa.array([links], pa.binary())})

    return run


def _loaded(x: np.ndarray, least: float, row: dict) -> Lookup:
    graph = Graph.load(x, row["links"]) if row["links"] else None
    return Lookup(x, graph, least, row["beam"], row["slack"])


def _meet(least: float):
    """Link counts and a forest of links of two shards, or of one."""

    def run(key, rows, graphs):
        rows = rows.sort_by("point")
        second = np.array(rows.column("second"), bool)
        order = np.concatenate((np.flatnonzero(~second), np.flatnonzero(second)))
        ids, copies = rows.column("point").to_numpy()[order], rows.column("copies").to_numpy()[order]
        x = _unit(rows.column("embedding"))[order]
        k, one = int((~second).sum()), key[2].as_py() == key[3].as_py()
        n, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        shift = 0 if one else k
        row = {r["second"]: r for r in graphs.to_pylist()}
        both = (_loaded(x[:k], least, row[False]), None if one else _loaded(x[k:], least, row[True])) if k and (one or k < len(ids)) else None
        for own, block in pairs(*both) if both else ():
            r, c = np.nonzero(block)
            begin = np.searchsorted(r, np.arange(len(block) + 1))
            r, c = own[r], shift + c
            n += np.bincount(r, copies[c], len(ids)).astype(np.int64)
            if not one:
                n += np.bincount(c, copies[r], len(ids)).astype(np.int64)
            for i, j, point in zip(begin[:-1].tolist(), begin[1:].tolist(), own.tolist(), strict=True):
                if i < j:
                    forest.add(point, c[i:j])
        kept = ids[np.array(forest.kept, np.int64).reshape(-1, 2)]
        return pa.table({"point": pa.array(np.concatenate((ids, kept[:, 0])), pa.int64()), "n": pa.array([*n.tolist(), *[None] * len(kept)], pa.int64()), "other": pa.array([*[None] * len(ids), *kept[:, 1].tolist()], pa.int64())})

    return run


def _meetings(shards: DataFrame, own: str) -> DataFrame:
    """Each row once for every shard of its label: low and high number the two that meet."""
    met = shards.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    return met.withColumns({"low": F.least(own, "met"), "high": F.greatest(own, "met"), "second": F.col(own) > F.col("met")}).drop("met", own, "shards")


def scaled(rows: DataFrame) -> DataFrame:
    """rows with each embedding's largest component brought to 1 or more and below 2 by a power of two, which leaves its cosines as they are."""
    kind = "float" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    top = F.array_max(F.transform("embedding", lambda v: F.abs(v).cast("double")))
    factor = F.when(F.col("good"), F.pow(F.lit(2.0), F.greatest(F.least(-F.floor(F.log2(top)), F.lit(1000)), F.lit(-1000))))
    # In an array of its own the factor is computed once and not for each component.
    turned = F.transform(F.array(factor), lambda f: F.transform("embedding", lambda v: (v.cast("double") * f).cast(kind)))
    return rows.withColumn("embedding", turned[0])


def near_duplicates(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Links vectors of equal labels whose cosine is `least` or more.

    Returns one row per row of vectors: vec_id, n_links (other rows linked directly,
    copies included), component_id (smallest vec_id reachable, itself included), kept
    (vec_id = component_id). Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing, nor do rows without a label or an id; a
    row without an id has null component_id and kept. Vectors of different lengths link
    with nothing in common. Repeated rows link with each other; rows that share an id alone
    don't. Other columns are ignored.
    """
    importable(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = checkpoint(scaled(rows.withColumn("good", good)))
    # A point's number is its own: rows of one id may be several points.
    points = rows.filter("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    points = checkpoint(points.withColumns({"size": F.size("embedding"), "point": F.monotonically_increasing_id()}))
    counts = points.groupBy("label", "size").count().select("label", "size", F.ceil(F.col("count") / SHARD_POINTS).alias("shards"), F.monotonically_increasing_id().alias("class"))
    counts = checkpoint(counts)  # class stands for a label and a length, whatever the label's type
    dealt = join_spread(points, counts, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("embedding"), "shards"))
    dealt = dealt.select(F.col("class").alias("label"), "size", "shards", "shard", "point", "copies", "embedding")
    graphs = checkpoint(dealt.groupBy("label", "size", "shard").applyInArrow(_build(least), BUILT))
    told = graphs.agg(F.count(F.lit(1)).alias("n"), F.sum("tested").alias("tested"), F.max("beam").alias("beam"), F.count_if(F.col("beam") >= F.col("points")).alias("whole")).first()
    LOG.info("%s graphs, the last audits found all of %s links; widest beam %s; in %s shards the beam holds every point", told.n, told.tested, told.beam, told.whole)
    graphs = graphs.join(counts.select(F.col("class").alias("label"), "shards"), "label")
    meet = ["label", "size", "low", "high"]
    found = _meetings(dealt, "shard").groupBy(*meet).cogroup(_meetings(graphs.drop("points", "tested"), "shard").groupBy(*meet))
    found = checkpoint(found.applyInArrow(_meet(least), "point long, n long, other long"))
    label_of = components(found.filter("other is not null").select(F.col("point").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "point")
    n = found.filter("n is not null").groupBy("point").agg(F.sum("n").alias("n"))
    named = checkpoint(points.join(n, "point").join(label_of, "point", "left").withColumn("component", F.coalesce("component", "point")))
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = join_spread(named, least_id, ["component"]).select("label", "embedding", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = join_spread(rows.filter("good"), facts, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
