"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Equal vectors of a label are taken together first. The rest is dealt into shards of bounded size;
each shard's graph is built once, and every vector of the label queries every shard's graph.
Searches run for many queries at a time: a step expands each query's best open candidate with one
gather and one product. Beams are widened, shard by shard, until an audit of some queries
against brute force finds enough and no beam ends inside the wanted range. Each pair found is
verified by its cosine in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, by_sorted_group, materialize, small_batches
from .components import connected_components

SHARD = 2_000
LINKS = 16
BEAM = 48
AUDIT = 64
RECALL = 0.99
#: Nearest nodes of an audited query that its beam must hold, and the share of them that must be found.
NEAREST, NEAR_RECALL = 5, 0.95


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """A hierarchy of neighbour graphs over unit vectors, built in batches that double in size."""

    def __init__(self, x: np.ndarray, near: list[np.ndarray], levels: list[np.ndarray]):
        self.x, self.near, self.levels = x.astype(np.float32), near, levels

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, beam: int = BEAM, seed: int = 5) -> Graph:
        n = len(x)
        draw = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - draw.random(n)) / np.log(links)).astype(int), 4)
        # Higher levels hold fewer nodes; a node is on all levels up to its own.
        levels = [np.flatnonzero(level >= k).astype(np.int32) for k in range(level.max(initial=0) + 1)]
        near = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(len(levels))]
        out = cls(x, near, levels)
        for k in range(len(levels) - 1, -1, -1):
            out._fill(k, links, beam)
        return out

    def pack(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels), *(a.shape[1] for a in self.near)], np.int32)
        return b"".join([sizes.tobytes(), *(a.tobytes() for a in self.levels), *(a.tobytes() for a in self.near)])

    @classmethod
    def unpack(cls, x: np.ndarray, data: bytes) -> Graph:
        flat = np.frombuffer(data, np.int32)
        k = int(flat[0])
        sizes, widths = flat[1 : 1 + k], flat[1 + k : 1 + 2 * k]
        parts = np.split(flat[1 + 2 * k :], np.cumsum([*sizes, *(len(x) * w for w in widths)])[:-1])
        return cls(x, [a.reshape(len(x), w) for a, w in zip(parts[k:], widths)], parts[:k])

    def _fill(self, k: int, links: int, beam: int) -> None:
        nodes, near = self.levels[k], self.near[k]
        order = np.concatenate([self.levels[k + 1], np.setdiff1d(nodes, self.levels[k + 1])]) if k + 1 < len(self.levels) else nodes
        done = 0
        while done < len(order):
            size = min(max(64, done // 2), 512, len(order) - done)
            new = order[done : done + size]
            inner = self.x[new] @ self.x[new].T
            np.fill_diagonal(inner, -2)
            some = new[np.argsort(-inner, axis=1)[:, : min(links, size - 1)]]
            found = self._at(k, self.x[new], beam, order[:done]) if done else some[:, :0]
            chosen = self._select(new, np.concatenate([found, some], axis=1), links)
            near[new, :links] = chosen
            # Links back: what each node is offered, the nearest first, with what it has.
            r, c = np.nonzero(chosen >= 0)
            to, by = chosen[r, c], new[r]
            s = np.einsum("ij,ij->i", self.x[to], self.x[by])
            sort = np.lexsort((-s, to))
            to, by = to[sort], by[sort]
            rank = np.arange(len(to)) - np.searchsorted(to, to)
            kept = rank < near.shape[1]
            ids, at = np.unique(to[kept], return_inverse=True)
            offers = np.full((len(ids), near.shape[1]), -1, np.int32)
            offers[at, rank[kept]] = by[kept]
            if len(ids):
                near[ids] = self._select(ids, np.concatenate([near[ids], offers], axis=1), near.shape[1])
            done += size

    def _select(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates those nearer to it than to any kept before; the nearest others fill up."""
        out = np.full((len(nodes), most), -1, np.int32)
        if not candidates.shape[1]:
            return out
        c = np.sort(np.where(candidates == nodes[:, None], -1, candidates), axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        s = np.where(c >= 0, np.einsum("ij,ikj->ik", self.x[nodes], self.x[c]), -3)
        top = np.argsort(-s, axis=1, kind="stable")[:, : 3 * most]
        c, s = np.take_along_axis(c, top, 1), np.take_along_axis(s, top, 1)
        x = self.x[c]
        among = x @ x.transpose(0, 2, 1)
        kept = np.zeros(c.shape, bool)
        count = np.zeros(len(nodes), int)
        for i in range(c.shape[1]):
            kept[:, i] = (c[:, i] >= 0) & (count < most) & ~((among[:, i] > s[:, i, None]) & kept).any(axis=1)
            count += kept[:, i]
        first = np.argsort(np.where(c >= 0, np.where(kept, 0, 1), 2), axis=1, kind="stable")[:, :most]
        out[:, : first.shape[1]] = np.take_along_axis(c, first, 1)
        return out

    def _at(self, k: int, queries: np.ndarray, beam: int, entries: np.ndarray) -> np.ndarray:
        """Of each query, the ``beam`` best nodes found on level k (-1 fills up)."""
        entry = entries[np.linspace(0, len(entries) - 1, min(len(entries), 8)).astype(int)]
        start = np.unique(entry)
        if k + 1 < len(self.levels) and len(self.levels[k + 1]):
            top = self.levels[k + 1]
            best = top[np.argmax(queries @ self.x[top].T, axis=1)] if len(top) <= 256 else self._at(k + 1, queries, 4, top)[:, 0]
            start = np.concatenate([np.tile(start, (len(queries), 1)), best[:, None]], axis=1)
        else:
            start = np.tile(start, (len(queries), 1))
        return self._beam(self.near[k], queries, start, beam)

    def _beam(self, near: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> np.ndarray:
        q = len(queries)
        seen = np.zeros((q, len(self.x)), bool)
        rows = np.arange(q)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -np.inf, np.float32)
        open_ = np.zeros((q, beam), bool)

        def add(live: np.ndarray, new: np.ndarray) -> None:
            known = (new < 0) | seen[live[:, None], new]
            # A node twice in one row counts once.
            order = np.sort(np.where(known, -1, new), axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            new = order
            r, c = np.nonzero(new >= 0)
            seen[live[r], new[r, c]] = True
            s = np.full(new.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", queries[live[r]], self.x[new[r, c]])
            i = np.concatenate([ids[live], new], axis=1)
            t = np.concatenate([sims[live], s], axis=1)
            o = np.concatenate([open_[live], new >= 0], axis=1)
            top = np.argpartition(-t, beam - 1, axis=1)[:, :beam] if t.shape[1] > beam else np.tile(np.arange(t.shape[1]), (len(live), 1))
            ids[live] = np.take_along_axis(i, top, 1)
            sims[live] = np.take_along_axis(t, top, 1)
            open_[live] = np.take_along_axis(o, top, 1) & (ids[live] >= 0)

        add(rows, start)
        live = rows
        while len(live):
            s = np.where(open_[live], sims[live], -np.inf)
            # The two best open candidates of each query are expanded together.
            pick = np.argpartition(-s, 1, axis=1)[:, :2] if beam > 2 else np.argmax(s, axis=1)[:, None]
            good = np.take_along_axis(s, pick, 1) > -np.inf
            going = good.any(axis=1)
            live, pick, good = live[going], pick[going], good[going]
            if not len(live):
                break
            node = np.where(good, ids[live[:, None], pick], -1)
            open_[live[:, None], pick] = False
            new = np.where((node >= 0)[:, :, None], near[node], -1).reshape(len(live), -1)
            add(live, new)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(np.where(sims > -np.inf, ids, -1), order, 1)

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Of each query, the ``beam`` best nodes found from the top of the hierarchy down."""
        return self._at(0, queries, beam, self.levels[0])


def pairs_above(graph: Graph, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of cosine ``least`` and more.

    At each width an audit of AUDIT queries against brute force must find RECALL of what there
    is in range, and NEAR_RECALL of the NEAREST nodes of each query whatever their cosine, so that it has
    something to find in every shard; else the beam is doubled. Queries whose whole beam lies in range have more to find: they are
    left out of the first count and asked again, with a wider beam, until theirs is not full. The widest beam is the
    whole shard, which is compared as such; shards of BEAM vectors and less come to that at once.
    """
    n = len(graph.x)
    # Searches run in single precision with room for its error; who calls verifies in double.
    queries, least = queries.astype(np.float32), least - 1e-4
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def ask(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = graph.search(queries[part], beam)
        s = np.where(found >= 0, np.einsum("ij,ikj->ik", queries[part], graph.x[found]), -2)
        return found, s >= least, (s >= least).all(axis=1)

    beam, todo = BEAM, np.arange(len(queries))
    while len(todo) and beam < n:
        some = todo[np.linspace(0, len(todo) - 1, min(AUDIT, len(todo))).astype(int)]
        found, good, full = ask(some)
        true = queries[some] @ graph.x.T
        there = (true >= least).sum(axis=1)
        near = np.argpartition(-true, NEAREST - 1, axis=1)[:, :NEAREST]
        hit = (found[:, :, None] == near[:, None, :]).any(axis=1).sum()
        if good.sum(axis=1)[~full].sum() < RECALL * there[~full].sum() or hit < NEAR_RECALL * near.size:
            beam *= 2
            continue
        again = []
        for a in range(0, len(todo), 512):
            part = todo[a : a + 512]
            found, good, full = ask(part)
            r, c = np.nonzero(good & ~full[:, None])
            out.append((part[r], found[r, c]))
            again.append(part[full])
        todo = np.concatenate(again)
        beam *= 4
    for a in range(0, len(todo), 512):
        r, c = np.nonzero(queries[todo[a : a + 512]] @ graph.x.T >= least)
        out.append((todo[a : a + 512][r], c))
    return np.concatenate([a for a, _ in out] or [todo]), np.concatenate([b for _, b in out] or [todo])


_CELL = "rep long, links long, other long"


def near_duplicates(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of (vec_id, embedding, label).

    Rows are compared where labels are equal and not null. Vectors that are null, empty, zero or
    hold null or non-finite parts link with nothing, nor do vectors of other lengths than each
    other. Rows that repeat a vector link with each other like any two rows; a null vec_id links
    with nothing and has a null component. An empty table gives none; other columns are ignored.

    Equal vectors are grouped (map side first), so copies, however many, enter a shard once and
    their links are counted, not listed. A shard holds about ``shard`` vectors; shards are packed
    into single rows, and a cell of the work is one shard's graph with one shard's queries. Each
    unordered pair of shards is one cell, and of its links the cell returns counts and a spanning
    forest, so what leaves it grows with its vectors.
    """
    small_batches(vectors.sparkSession)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    sane = F.coalesce(
        (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False)
    )
    fit = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sane)
    classes = materialize(fit.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    shards = classes.withColumn("kind", F.concat_ws(":", F.size("e").cast("string"), "label"))
    many = shards.groupBy("kind").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = shards.join(many, "kind").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame.e.tolist(), np.float64)
        big = np.abs(x).max(axis=1, keepdims=True)
        return pd.DataFrame({
            "kind": frame.kind.iloc[:1], "shards": frame.shards.iloc[:1], "shard": frame.shard.iloc[:1], "dim": [x.shape[1]],
            "graph": [Graph.build(_unit(x / big)).pack()], "reps": [frame.rep.to_numpy(np.int64).tobytes()], "copies": [frame.copies.to_numpy(np.int64).tobytes()], "data": [_unit(x / big).tobytes()],
        })

    packed = materialize(by_sorted_group(
        dealt.select("kind", "shards", "shard", "rep", "copies", "e"), ["kind", "shard"], pack,
        "kind string, shards int, shard int, dim int, graph binary, reps binary, copies binary, data binary",
    ))
    low = packed.withColumn("a", F.col("shard")).withColumn("b", F.explode(F.expr("sequence(shard, shards - 1)")))
    high = packed.withColumn("b", F.col("shard")).withColumn("a", F.explode(F.expr("sequence(0, shard)")))

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame.shard == frame.a].iloc[0]
        mine = frame.a.iloc[0] == frame.b.iloc[0]
        other = own if mine else frame[frame.shard == frame.b].iloc[0] if (frame.shard == frame.b).any() else None
        if other is None:
            return pd.DataFrame({"rep": [], "links": [], "other": []})
        x = np.frombuffer(own.data, np.float64).reshape(-1, own.dim)
        y = np.frombuffer(other.data, np.float64).reshape(-1, own.dim)
        rx, ry = np.frombuffer(own.reps, np.int64), np.frombuffer(other.reps, np.int64)
        cx, cy = np.frombuffer(own.copies, np.int64), np.frombuffer(other.copies, np.int64)
        q, k = pairs_above(Graph.unpack(x, own.graph), y, least)
        if mine:
            low, up = np.minimum(q, k), np.maximum(q, k)
            both = np.unique(np.stack([low, up], 1)[low < up], axis=0)
            q, k = both[:, 1], both[:, 0]
        good = np.einsum("ij,ij->i", y[q], x[k]) >= least
        q, k = q[good], k[good]
        nx, ny = np.bincount(k, cy[q], len(x)), np.bincount(q, cx[k], len(y))
        ids = np.unique(np.concatenate([rx, ry]))
        at_x, at_y = np.searchsorted(ids, rx), np.searchsorted(ids, ry)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, at_x, nx.astype(np.int64))
        np.add.at(links, at_y, ny.astype(np.int64))
        trees = Forest(len(ids))
        for a, b in zip(at_x[k].tolist(), at_y[q].tolist()):
            trees.join(a, b)
        root = ids[[trees.root(i) for i in range(len(ids))]]
        some = links > 0
        return pd.DataFrame({"rep": ids[some], "links": links[some], "other": root[some]})

    cells = low.union(high.select(*low.columns).where("a < b")).select("kind", "a", "b", "shard", "dim", F.expr("if(shard = a, graph, null)").alias("graph"), "reps", "copies", "data")
    found = materialize(by_sorted_group(cells, ["kind", "a", "b"], cell, _CELL))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        classes.join(counted, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return v.withColumn("id", F.when(sane, F.col("vec_id"))).join(
        known.withColumnRenamed("label", "l").withColumnRenamed("e", "x"), (F.col("label") == F.col("l")) & (F.col("e") == F.col("x")) & F.col("id").isNotNull(), "left"
    ).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )
