"""Exact near-duplicate vectors by dual traversal of cover trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.components import components
from loomwork.llm.steps import materialize

SAMPLE = 4096  # vectors the cells' centres are chosen from
LEAST_BLOCKS = 16
BLOCK_BYTES = 4 << 20  # of vectors in one block
ROOTS = 1024  # blocks of one part that meet all others by their roots
MOST_TASKS = 1 << 16  # the pairs of blocks are dealt over
TILE = 1 << 20  # pairs of vectors compared at once
FEW = 20  # a level prunes if it leaves at most one in so many node pairs
LOOK = 64  # rows of a matrix of node pairs that tell whether its level prunes
NARROW = 1e-6  # the least radius a node is split at
MATRIX = 1024  # pairs of children from which on they are tested as a matrix
SLACK = 1e-4  # bounds and first looks are in single precision; closer ones are summed in double


class Tree:
    """A cover tree over unit vectors.

    Level 0 is one node of radius 2, which covers the sphere; each level halves the
    radius. A node's children are centres that are further than the child radius
    apart and cover its points; the first is the node's own centre, so levels are
    nested. Nodes are kept in one array each: centre, true covering radius, and the
    range of points below, which lie next to each other in ``order``.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.centre, self.radius, self.begin, self.end = [], [], [], []
        self.children: list[np.ndarray] = []
        if len(points):
            self._add(0, 0, len(points))
            todo = [(0, 1.0)]
            while todo:
                node, radius = todo.pop()
                # below that, rounding tells points no longer apart: they stay one leaf
                if self.end[node] - self.begin[node] > 1 and self.radius[node] > 0 \
                        and radius > NARROW:
                    todo += [(c, radius / 2) for c in self._split(node, radius)]
        self._finish()

    def _finish(self) -> None:
        self.centres = self.points[self.centre]
        self.rough, self.rough_centres = (a.astype(np.float32) for a in (self.points, self.centres))
        self.radii = np.array(self.radius)
        self.begin, self.end = np.array(self.begin, np.int64), np.array(self.end, np.int64)
        self.sizes = self.end - self.begin
        # the children of a node were added one after another
        self.kids = np.array([len(k) for k in self.children], np.int64)
        self.first_kid = np.array([k[0] if len(k) else 0 for k in self.children], np.int64)

    def _add(self, centre: int, begin: int, end: int) -> int:
        radius = 0.0
        if end - begin > 1:
            far = self.points[self.order[begin:end]] - self.points[centre]
            radius = float(np.sqrt((far * far).sum(1).max()))
        self.centre.append(centre)
        self.radius.append(radius)
        self.begin.append(begin)
        self.end.append(end)
        self.children.append(np.zeros(0, np.int64))
        return len(self.centre) - 1

    def _split(self, node: int, radius: float) -> list[int]:
        begin, end = self.begin[node], self.end[node]
        # the node's own centre comes first: levels are nested
        own = self.order[begin:end]
        own = np.concatenate(([self.centre[node]], own[own != self.centre[node]]))
        points, least = self.points[own], 1 - radius * radius / 2
        head = np.full(len(own), -1)
        for k in range(0, len(own), 256):
            near = points[k:k + 256] @ points.T >= least
            for i in np.flatnonzero(head[k:k + 256] < 0):
                if head[k + i] < 0:
                    near[i, k + i] = True
                    head[near[i] & (head < 0)] = k + i
        ranked = np.argsort(head, kind="stable")
        self.order[begin:end] = own[ranked]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(head[ranked])) + 1, [len(own)]))
        made = [self._add(int(own[head[ranked[i]]]), begin + int(i), begin + int(j))
                for i, j in zip(cuts[:-1], cuts[1:])]
        self.children[node] = np.array(made)
        return made

    def pack(self) -> bytes:
        """All but the points."""
        return pickle.dumps((self.order, self.centre, self.radius, self.begin, self.end,
                             self.children))

    @classmethod
    def unpack(cls, points: np.ndarray, packed: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.points = points
        (tree.order, tree.centre, tree.radius, tree.begin, tree.end,
         tree.children) = pickle.loads(packed)
        tree._finish()
        return tree


def _below(tree: Tree, nodes: np.ndarray) -> np.ndarray:
    """The nodes with each one that has children replaced by them."""
    lone = tree.kids[nodes] == 0
    times = np.where(lone, 1, tree.kids[nodes])
    first = np.where(lone, nodes, tree.first_kid[nodes])
    ends = np.cumsum(times)
    return np.repeat(first, times) + np.arange(times.sum()) - np.repeat(ends - times, times)


def dual(x: Tree, y: Tree, w_x: np.ndarray, w_y: np.ndarray, least: float,
         counts: dict[str, int] | None = None):
    """Links between the points of two trees with cosine ``least`` or more.

    Node pairs further apart than the threshold distance and both covering radii
    are pruned; node pairs as close, radii included, are linked whole; of the rest
    the children meet. Many children on both sides are tested as a matrix, few ones
    of many node pairs as one list. Where the bounds of a matrix leave more than one
    in twenty pairs, its loose nodes give way to their children, level by level; only
    nodes much narrower than the threshold that still do not come apart are compared
    point by point. ``y`` is ``x``: all pairs within the tree, once.

    Returns the weight linked to each point on both sides, and links that span the
    same components. ``counts`` receives the number of point pairs ``pruned`` by
    bounds, linked ``whole`` and ``compared``.
    """
    same = x is y
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    n_x, n_y = np.zeros(len(x.points), np.int64), np.zeros(len(y.points), np.int64)
    edges: list[tuple[int, int]] = []
    counts = {} if counts is None else counts
    counts.update({k: counts.get(k, 0) for k in ("pruned", "whole", "compared")})
    if not len(x.points) or not len(y.points):
        return n_x, n_y, edges
    # one forest over the points of both sides
    shift = 0 if same else len(x.points)
    parent = np.arange(shift + len(y.points))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    def span(i: int, j: int) -> None:
        a, b = root(i), root(shift + j)
        if a != b:
            parent[a] = b
            edges.append((i, j))

    def link(us: np.ndarray, vs: np.ndarray, both: bool) -> None:
        """Count linked points; ``both``: a pair is listed once and counts on both sides."""
        n_x[:] += np.bincount(us, w_y[vs], len(n_x)).astype(np.int64)
        if both:
            n_y[:] += np.bincount(vs, w_x[us], len(n_y)).astype(np.int64)
        # one hit of every point joins most of them; the rest is looked up
        for k in {*np.unique(us, return_index=True)[1].tolist(),
                  *np.unique(vs, return_index=True)[1].tolist()}:
            span(int(us[k]), int(vs[k]))
        top, place = np.unique(us, return_inverse=True)
        low, spot = np.unique(vs, return_inverse=True)
        roots = np.array([root(int(v)) for v in top])[place]
        others = np.array([root(shift + int(v)) for v in low])[spot]
        for k in np.flatnonzero(roots != others).tolist():
            span(int(us[k]), int(vs[k]))

    def exact(us: np.ndarray, vs: np.ndarray, cos: np.ndarray, both: bool) -> None:
        """Link the point pairs whose rough cosine holds; close ones are summed in double."""
        us, vs, cos = (v[cos >= least - SLACK] for v in (us, vs, cos))
        near = np.flatnonzero(cos < least + SLACK)
        if len(near):
            gone = near[(x.points[us[near]] * y.points[vs[near]]).sum(1) < least]
            us, vs = np.delete(us, gone), np.delete(vs, gone)
        if len(us):
            link(us, vs, both)

    def compare(p: np.ndarray, q: np.ndarray, own: bool) -> None:
        """All pairs of two lists of points; ``own``: of one list, seen from each side."""
        counts["compared"] += len(p) * (len(p) - 1) // 2 if own else len(p) * len(q)
        rows = max(1, TILE // len(q))
        for k in range(0, len(p), rows):
            part = p[k:k + rows]
            cos = (x.rough[part] @ y.rough[q].T).ravel()
            at = np.flatnonzero(cos >= np.float32(least - SLACK))
            us, vs = part[at // len(q)], q[at % len(q)]
            if own:
                at, us, vs = (v[us != vs] for v in (at, us, vs))
            exact(us, vs, cos[at], not own)

    def whole(u: int, v: int) -> None:
        own = same and u == v
        p, q = x.order[x.begin[u]:x.end[u]], y.order[y.begin[v]:y.end[v]]
        counts["whole"] += len(p) * (len(p) - 1) // 2 if own else len(p) * len(q)
        if own:
            n_x[p] += w_x[p].sum() - w_x[p]
        else:
            n_x[p] += w_y[q].sum()
            n_y[q] += w_x[p].sum()
        for i in p:
            if not own or i != q[0]:
                span(int(i), int(q[0]))
        for j in q if not own else ():
            span(int(p[0]), int(j))

    def kept(us: np.ndarray, vs: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a list of node pairs leaves: pruned, whole and single pairs are done with."""
        radii = x.radii[us] + y.radii[vs]
        mine = same & (us == vs)
        bound, inside = reach + SLACK + radii, reach - SLACK - radii
        cos = np.where(mine, 1.0, cos)
        far = cos < 1 - bound * bound / 2 - SLACK
        counts["pruned"] += int((x.sizes[us[far]] * y.sizes[vs[far]]).sum())
        done = far | (mine & (x.sizes[us] == 1))
        single = ~done & (x.sizes[us] == 1) & (y.sizes[vs] == 1)
        p, q = x.order[x.begin[us[single]]], y.order[y.begin[vs[single]]]
        counts["compared"] += len(p)
        exact(p, q, cos[single], True)
        done |= single
        close = ~done & (inside > 0) & (cos >= 1 - np.square(np.maximum(inside, 0)) / 2 + SLACK)
        close |= ~done & mine & (inside > 0)
        for u, v in zip(us[close].tolist(), vs[close].tolist()):
            whole(u, v)
        done |= close
        stuck = ~done & (x.kids[us] == 0) & (y.kids[vs] == 0)  # points as close as equal ones
        for u, v in zip(us[stuck].tolist(), vs[stuck].tolist()):
            compare(x.order[x.begin[u]:x.end[u]], y.order[y.begin[v]:y.end[v]], same and u == v)
        done |= stuck
        return us[~done], vs[~done]

    def tiles(a: np.ndarray, b: np.ndarray, own: bool):
        """Node pairs of a matrix that no bound prunes, tile by tile, with their cosines."""
        loose = reach + SLACK + x.radii[a] + y.radii[b].max()
        floor = np.maximum(-2, 1 - loose * loose / 2 - SLACK).astype(np.float32)
        rows = max(1, TILE // len(b))
        for k in range(0, len(a), rows):
            cos = x.rough_centres[a[k:k + rows]] @ y.rough_centres[b].T
            at = np.flatnonzero((cos >= floor[k:k + rows, None]).ravel())
            i, j = k + at // len(b), at % len(b)
            cos = cos.ravel()[at]
            left = i <= j if own else np.full(len(i), True)
            size = x.sizes[a[k:k + rows]]
            if own:  # pairs above the diagonal: what follows each row
                after = np.concatenate((np.cumsum(y.sizes[b][::-1])[::-1][1:], [0]))
                total = int((size * after[k:k + rows]).sum())
                seen = (left & (i < j))
            else:
                total, seen = int(size.sum() * y.sizes[b].sum()), left
            counts["pruned"] += total - int((x.sizes[a[i[seen]]] * y.sizes[b[j[seen]]]).sum())
            yield a[i[left]], b[j[left]], cos[left]

    def matrix(a: np.ndarray, b: np.ndarray, own: bool) -> None:
        while True:
            # some rows tell whether the bounds prune at this level
            some = a[::max(1, len(a) // LOOK)]
            bound = reach + SLACK + x.radii[some][:, None] + y.radii[b][None, :]
            cos = x.rough_centres[some] @ y.rough_centres[b].T
            if (cos >= 1 - bound * bound / 2 - SLACK).mean() * FEW <= 1:
                break
            widest = max(x.radii[a].max(), y.radii[b].max())
            wide_x, wide_y = (t.kids[n] * (t.radii[n] > widest / 2) > 0 for t, n in ((x, a), (y, b)))
            if widest <= reach / 8 or not (wide_x.any() or wide_y.any()):
                under = lambda t, n: np.concatenate(
                    [t.order[t.begin[k]:t.end[k]] for k in n.tolist()])
                compare(under(x, a), under(y, b), own)
                return
            a = np.concatenate((a[~wide_x], _below(x, a[wide_x])))
            b = a if own else np.concatenate((b[~wide_y], _below(y, b[wide_y])))
        for us, vs, cos in tiles(a, b, own):
            push(*kept(us, vs, cos))

    def push(us: np.ndarray, vs: np.ndarray) -> None:
        """Put node pairs aside in lists whose children fit a tile."""
        if not len(us):
            return
        times = np.maximum(x.kids[us], 1) * np.maximum(y.kids[vs], 1)
        many = times >= MATRIX
        for u, v in zip(us[many].tolist(), vs[many].tolist()):
            a = _below(x, np.array([u]))
            own = same and u == v
            todo.append((a, a if own else _below(y, np.array([v])), own))
        us, vs, times = us[~many], vs[~many], times[~many]
        part = np.cumsum(times) // (TILE // 4)
        for k in np.unique(part).tolist():
            todo.append((us[part == k], vs[part == k], None))

    todo: list[tuple] = []
    push(*kept(np.zeros(1, np.int64), np.zeros(1, np.int64),
               np.array([float(x.centres[0] @ y.centres[0])])))
    while todo:
        us, vs, own = todo.pop()
        if own is not None:
            matrix(us, vs, own)
            continue
        # the children of every pair, each with each
        m_x, m_y = np.maximum(x.kids[us], 1), np.maximum(y.kids[vs], 1)
        times = m_x * m_y
        pair = np.repeat(np.arange(len(us)), times)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
        first = lambda t, n: np.where(t.kids[n] > 0, t.first_kid[n], n)
        i = first(x, us)[pair] + nth // m_y[pair]
        j = first(y, vs)[pair] + nth % m_y[pair]
        once = ~(same & (us == vs)[pair]) | (i <= j)
        i, j = i[once], j[once]
        cos = np.einsum("ij,ij->i", x.rough_centres[i], y.rough_centres[j])
        push(*kept(i, j, cos))
    return n_x, n_y, edges


def _points(raw: bytes, dim: int) -> np.ndarray:
    points = np.frombuffer(raw, np.float64).reshape(-1, dim)
    points = points / np.abs(points).max(1, keepdims=True)
    return points / np.sqrt((points * points).sum(1, keepdims=True))


def _traverse(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                x = Tree.unpack(_points(r["vectors_x"], r["dim"]), r["tree_x"])
                y = x if r["x"] == r["y"] else Tree.unpack(
                    _points(r["vectors_y"], r["dim"]), r["tree_y"])
                ids_x, ids_y, w_x, w_y = (np.frombuffer(r[n], np.int64) for n in (
                    "nodes_x", "nodes_y", "copies_x", "copies_y"))
                n_x, n_y, edges = dual(x, y, w_x, w_y, least)
                if y is x:
                    n_x, n_y = n_x + n_y, n_y[:0]
                node = np.concatenate((ids_x[n_x > 0], ids_y[:len(n_y)][n_y > 0]))
                links = np.concatenate((n_x[n_x > 0], n_y[n_y > 0]))
                a = ids_x[[i for i, _ in edges]] if edges else ids_x[:0]
                b = ids_y[[j for _, j in edges]] if edges else ids_y[:0]
                none, zero = pa.nulls(len(a), pa.int64()), pa.nulls(len(node), pa.int64())
                columns = [(node, none), (links, none), (zero, a), (zero, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in c])
                     for c in columns], ["node", "links", "a", "b"])
    return run


def _nearest(shared):
    """Number of the nearest centre of the same dimension, -1 if there is none."""
    def cell(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), -1, np.int32)
        for dim, centres in shared.value.items():
            at = [i for i, v in enumerate(vectors) if len(v) == dim]
            if at:
                points = np.stack([vectors.iloc[i] for i in at]).astype(float)
                out[at] = (_points(points.tobytes(), dim) @ centres.T).argmax(1)
        return pd.Series(out)
    return F.pandas_udf(cell, "int")


def _centres(sample: list[list[float]], count: int) -> dict[int, np.ndarray]:
    """Far-apart centres per dimension: each next one is furthest from those before."""
    out = {}
    for dim in sorted({len(v) for v in sample}):
        points = _points(np.array([v for v in sample if len(v) == dim], float).tobytes(), dim)
        chosen, best = [0], points @ points[0]
        while len(chosen) < min(count, len(points)):
            chosen.append(int(best.argmin()))
            best = np.maximum(best, points @ points[chosen[-1]])
        out[dim] = points[chosen]
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per block: vectors, nodes, copies and cover tree as bytes, a centre, its radius."""
    pdf = pdf.sort_values("node")
    points = np.stack(pdf["vector"].to_numpy()).astype(float)
    units = _points(points.tobytes(), points.shape[1])
    centre = units.mean(0)
    return pd.DataFrame({
        "block": [pdf["block"].iloc[0]], "dim": [points.shape[1]], "centre": [centre.tolist()],
        "radius": [float(np.sqrt(((units - centre) ** 2).sum(1).max()))],
        "vectors": [points.tobytes()], "nodes": [pdf["node"].to_numpy(np.int64).tobytes()],
        "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "tree": [Tree(units).pack()]})


def similar_vectors(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """Vectors linked by cosine ``least`` or more, exactly, in double precision.

    Equal vectors are one node with a weight. Nodes are dealt to the nearest of some
    centres, chosen from a sample of at most 4096 vectors: the top of the cover
    tree. A cell of more than its share of nodes is cut into blocks of at most 4 MB,
    so a hot direction is many blocks. Every block builds its cover tree; every pair
    of blocks is one row that walks both trees together. In high dimensions, where random
    vectors are all equally far apart, no bound prunes pairs of far blocks: the bounds of
    single vectors do, and the work grows with the square of the number of different ones.

    ``rows`` needs ``vec_id, embedding``; other columns are ignored. Returns a row
    per row: ``vec_id, n_links`` (other rows linked directly), ``component_id``
    (smallest ``vec_id`` reachable, itself included), ``kept`` (it is that one).
    Vectors that are null, empty, zero or hold null or non-finite numbers link with
    nothing; vectors of different lengths do not link; rows that repeat an
    identifier stay rows of their own, null identifiers are passed over if there
    are others; no rows give no rows.
    """
    spark = rows.sparkSession
    plain = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(
        F.forall("vector", fine) & F.exists("vector", lambda x: x != 0), F.lit(False))
    named = plain.select("vec_id", F.when(usable, F.col("vector")).alias("vector")).withColumns(
        {"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector", F.lit(7))})
    good = named.where("vector IS NOT NULL")
    nodes = materialize(
        good.groupBy("vector", "h1", "h2").agg(
            F.count("*").alias("copies"), F.min("vec_id").alias("low"))
        .withColumn("node", F.monotonically_increasing_id()), "vectors")

    total = nodes.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("numbers")).first()
    n, numbers = total["n"], total["numbers"] or 0
    count = max(LEAST_BLOCKS, -(-8 * numbers // BLOCK_BYTES))
    draw = F.pmod(F.col("h1"), F.lit(1 << 20)) < (1 << 20) * min(1.0, SAMPLE / 2 / max(1, n))
    sample = nodes.where(draw).orderBy("node").limit(SAMPLE).select("vector").collect()
    centres = _centres([r["vector"] for r in sample], min(count, 256))
    cells = materialize(nodes.withColumn("cell", _nearest(
        spark.sparkContext.broadcast(centres))("vector")), "cells")
    share = max(1, -(-n // count))
    sizes = cells.groupBy(F.size("vector").alias("dim"), "cell").agg(
        F.ceil(F.count("*") / share).alias("cuts"))
    cut = cells.withColumn("dim", F.size("vector")).join(sizes, ["dim", "cell"]).withColumn(
        "block", F.xxhash64("dim", "cell", F.pmod("h1", F.col("cuts"))))
    packed = materialize(
        cut.select("block", "node", "copies", "vector").groupBy("block").applyInPandas(
            _pack, "block long, dim int, centre array<double>, radius double, vectors binary, "
            "nodes binary, copies binary, tree binary"),
        "blocks")

    # pairs of blocks of the same dimension that the bound of their roots does not prune;
    # the first side is dealt over parts, the second, without its points, goes to each
    parts = -(-count // ROOTS)
    root = lambda k, part: packed.select("dim", part.alias("part"), *[
        F.col(c).alias(n) for c, n in (("block", k), ("centre", f"c_{k}"), ("radius", f"r_{k}"))])
    dealt, everywhere = F.pmod("block", F.lit(parts)), F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    gap = F.aggregate(F.zip_with("c_x", "c_y", lambda p, q: (p - q) * (p - q)), F.lit(0.0),
                      lambda s, v: s + v)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    pairs = root("x", dealt).join(root("y", everywhere), ["dim", "part"]).where("x <= y").where(
        F.sqrt(gap) <= F.col("r_x") + F.col("r_y") + reach).select("x", "y", "dim")
    side = lambda k: packed.select(*[
        F.col(c).alias(k if c == "block" else f"{c}_{k}")
        for c in ("block", "vectors", "nodes", "copies", "tree")])
    loaded = (pairs.repartition(max(LEAST_BLOCKS, min(count * count // 8, MOST_TASKS)), "x", "y")
              .join(side("x"), "x").join(side("y"), "y"))
    met = materialize(loaded.mapInArrow(
        _traverse(least), "node long, links long, a long, b long"), "met")

    comps = components(met.where("a IS NOT NULL"), "a", "b")
    linked = met.where("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    member = (nodes.select("node", "h1", "h2", "copies", "low")
              .join(linked, "node", "left").join(comps, "node", "left")
              .withColumn("comp", F.coalesce("component", "node")))
    lowest = member.groupBy("comp").agg(F.min("low").alias("component_id"))
    outcome = member.join(lowest, "comp").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id")
    done = good.select("vec_id", "h1", "h2").join(outcome, ["h1", "h2"]).select(
        "vec_id", "n_links", "component_id")
    alone = named.where("vector IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
