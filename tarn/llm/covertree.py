"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Equal vectors collapse first. Above, a label's vectors are split into cells by nearest pivot
until each cell has at most LEAF of them; the tree of cells (centre, covering radius) is
traversed against itself level by level as joins, keeping only pairs of cells whose covering
balls come within the threshold. Below, each pair of leaf cells is one task's work: cover
trees with halving radii are built over both and traversed together; a pair of nodes is dropped
if its balls are too far apart, and counted whole if all of it is near enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import connected_components, local_components, maybe_broadcast, packed, stage, unpacked

#: Vectors in a leaf cell; pivots by which a larger one is split, at most (about; they are drawn by hash).
LEAF, PIVOTS = 8192, 64
#: Rows of a cell that one task deals to its pivots.
SLICE = 16384
#: Centres that are tried at once; pairs of children from which on they are compared by one matrix product.
CENTRES, DENSE = 256, 4096
#: Slack of all bounds on distances, far above rounding and far below any distance that matters.
SLACK = 1e-6
VECTOR = "array<double>"


class CoverTree:
    """Nested covers of unit vectors, each with half the radius of the one above; nodes in arrays.

    Node k has point[k], radius[k] (the distance to its farthest descendant), children
    first[k]:last[k] (none: it holds just its point), and descends to items lo[k]:hi[k] of order.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        point, radius, first, last, lo, hi = [0], [0.0], [0], [0], [0], [len(x)]
        order = np.arange(len(x))
        level, scale = [0], 2.0
        while level:
            below = []
            for k in level:
                mine = order[lo[k] : hi[k]]
                far = self.distances(x[mine], x[point[k]])
                radius[k] = float(far.max()) if len(mine) > 1 else 0.0
                if len(mine) == 1:
                    continue
                step = scale
                while step >= radius[k] > 0:
                    step /= 2
                # vectors as near as rounding can tell are children by themselves
                groups = self.cover(mine, point[k], step) if radius[k] > 0 else [(i, np.array([i])) for i in mine]
                first[k], at = len(point), lo[k]
                for centre, members in groups:
                    order[at : at + len(members)] = members
                    point.append(int(centre))
                    radius.append(0.0)
                    first.append(0)
                    last.append(0)
                    lo.append(at)
                    hi.append(at + len(members))
                    below.append(len(point) - 1)
                    at += len(members)
                last[k] = len(point)
            level = [k for k in below if hi[k] - lo[k] > 1]
            scale /= 2
        self.order = order
        self.point, self.first, self.last, self.lo, self.hi = (np.array(v, np.int64) for v in (point, first, last, lo, hi))
        self.radius = np.array(radius)
        self.leaf = self.first == self.last

    def cover(self, mine: np.ndarray, centre: int, step: float) -> list[tuple[int, np.ndarray]]:
        """(centre, its members, itself first): every item is within `step` of the first centre that takes it, and no centre of another."""
        rest = np.concatenate(([centre], mine[mine != centre]))
        x, groups = self.x[rest], []
        while len(rest):
            near = self.distances(x, x[:CENTRES].T) <= step
            alive = np.ones(len(rest), bool)
            for c in range(near.shape[1]):
                if alive[c]:
                    taken = near[:, c] & alive
                    taken[c] = True
                    alive &= ~taken
                    taken[c] = False
                    groups.append((rest[c], np.concatenate(([rest[c]], rest[taken]))))
            rest, x = rest[alive], x[alive]
        return groups

    @staticmethod
    def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return CoverTree.lengths(x @ y)

    @staticmethod
    def lengths(dot: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * dot))


def dual(a: CoverTree, b: CoverTree, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole node pairs (i, j) that link, and single point pairs (p, q) that do, each pair of points once.

    same: a is b; then pairs of a point with itself are left out, and node pairs are taken once.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * least))
    left, right = np.array([0]), np.array([0])
    nodes, points = [], []
    while len(left):
        next_left, next_right = [], []
        for at in range(0, len(left), 1 << 18):
            i, j = left[at : at + (1 << 18)], right[at : at + (1 << 18)]
            dot = _dots(a, b, i, j)
            far = np.sqrt(np.maximum(0.0, 2 - 2 * dot))
            both = a.radius[i] + b.radius[j]
            single = a.leaf[i] & b.leaf[j]
            hit = single & (dot >= least)
            if same:
                hit &= i != j
            points.append((a.point[i[hit]], b.point[j[hit]]))
            whole = ~single & (far + both <= reach - SLACK)
            if same:
                whole &= i != j
            nodes.append((i[whole], j[whole]))
            go = ~single & ~whole & (far - both <= reach + SLACK)
            i, j = i[go], j[go]
            dense = ~a.leaf[i] & ~b.leaf[j] & ((a.last[i] - a.first[i]) * (b.last[j] - b.first[j]) >= DENSE)
            for k, m in zip(i[dense].tolist(), j[dense].tolist()):
                found, whole, (u, v) = children(a, b, k, m, least, reach, same and k == m)
                points.append(found)
                nodes.append(whole)
                next_left.append(u)
                next_right.append(v)
            i, j = i[~dense], j[~dense]
            if same:  # a node against itself: each pair of its children once
                own = i == j
                for k in i[own]:
                    c = np.arange(a.first[k], a.last[k])
                    u, v = np.triu_indices(len(c))
                    next_left.append(c[u])
                    next_right.append(c[v])
                i, j = i[~own], j[~own]
            open_left = ~a.leaf[i] & (b.leaf[j] | (a.radius[i] >= b.radius[j]))
            for tree, flip, k, other in ((a, False, i[open_left], j[open_left]), (b, True, j[~open_left], i[~open_left])):
                n = tree.last[k] - tree.first[k]
                child = np.repeat(tree.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pair = np.repeat(other, n), child
                next_left.append(pair[0] if flip else pair[1])
                next_right.append(pair[1] if flip else pair[0])
        left = np.concatenate(next_left) if next_left else np.empty(0, np.int64)
        right = np.concatenate(next_right) if next_right else np.empty(0, np.int64)
    join = lambda pairs: tuple(np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1))
    return *join(nodes), *join(points)


Pairs = tuple[np.ndarray, np.ndarray]


def children(a: CoverTree, b: CoverTree, k: int, m: int, least: float, reach: float, same: bool) -> tuple[Pairs, Pairs, Pairs]:
    """All children of node k against those of m: single point pairs that link, node pairs that link whole, node pairs still open."""
    u, v = np.arange(a.first[k], a.last[k]), np.arange(b.first[m], b.last[m])
    points, nodes, open_ = [], [], []
    y = b.x[b.point[v]].T
    for lo in range(0, len(u), 1024):
        c = u[lo : lo + 1024]
        dot = a.x[a.point[c]] @ y
        both = a.radius[c][:, None] + b.radius[v][None, :]
        near = dot >= 1 - (reach + SLACK + both) ** 2 / 2 - SLACK  # their balls come within reach, with room for rounding
        i, j = np.nonzero(near)
        if same:
            i, j = i[c[i] <= v[j]], j[c[i] <= v[j]]
        dot, both = dot[i, j], both[i, j]
        i, j = c[i], v[j]
        far = np.sqrt(np.maximum(0.0, 2 - 2 * dot))
        single, itself = a.leaf[i] & b.leaf[j], same & (i == j)
        hit = single & (dot >= least) & ~itself
        whole = ~single & (far + both <= reach - SLACK) & ~itself
        rest = ~single & ~whole
        points.append((a.point[i[hit]], b.point[j[hit]]))
        nodes.append((i[whole], j[whole]))
        open_.append((i[rest], j[rest]))
    return tuple(tuple(np.concatenate(x) for x in zip(*found)) for found in (points, nodes, open_))


def _dots(a: CoverTree, b: CoverTree, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of the centres of node pairs, through one matrix product where the pairs are dense in it."""
    p, q = a.point[i], b.point[j]
    u, pu = np.unique(p, return_inverse=True)
    v, qv = np.unique(q, return_inverse=True)
    if len(u) * len(v) <= 16 * len(p) and len(u) * len(v) <= 1 << 22:
        return (a.x[u] @ b.x[v].T)[pu, qv]
    return np.concatenate([np.einsum("nd,nd->n", a.x[p[k : k + 8192]], b.x[q[k : k + 8192]]) for k in range(0, len(p), 8192)])


def link_counts(x: np.ndarray, w: np.ndarray, y: np.ndarray | None, wy: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of each x, links of each y, edges u, v of a spanning forest over x then y); w: vectors in each class."""
    a = CoverTree(x)
    same = y is None
    b, wb = (a, w) if same else (CoverTree(y), wy)
    i, j, p, q = dual(a, b, least, same)
    nx, ny = np.zeros(len(x)), np.zeros(len(wb))
    np.add.at(nx, p, wb[q])
    np.add.at(ny, q, w[p])
    u, v = [p], [q + (0 if same else len(x))]
    for k, m in zip(i, j):
        s, t = a.order[a.lo[k] : a.hi[k]], b.order[b.lo[m] : b.hi[m]]
        nx[s] += wb[t].sum()
        ny[t] += w[s].sum()
        off = 0 if same else len(x)
        u += [s, np.full(len(t), s[0])]
        v += [np.full(len(s), t[0] + off), t + off]
    u, v = np.concatenate(u), np.concatenate(v)
    n = len(x) if same else len(x) + len(wb)
    label = local_components(n, u, v)
    child = np.flatnonzero(label != np.arange(n))
    return (nx + ny, np.zeros(0), label[child], child) if same else (nx, ny, label[child], child)


def unit(vector: Column) -> Column:
    """The vector scaled to length one in double precision; null if null, empty, zero or with null or non-finite components.

    It is scaled by a power of two first, so that no square is too large or too small.
    """

    @F.arrow_udf(VECTOR)
    def apply(v: pa.Array) -> pa.Array:
        length = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = v.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(float)  # a null component comes as not a number
        out, fine = np.zeros(len(x)), np.zeros(len(length), bool)
        some, first = np.flatnonzero(length), (np.cumsum(length) - length)
        if len(some):
            n, at = length[some], first[some]
            largest = np.maximum.reduceat(np.abs(x), at)
            ok = np.isfinite(largest) & (largest > 0)
            _, exponent = np.frexp(np.where(ok, largest, 1.0))
            y = np.ldexp(np.where(np.repeat(ok, n), x, 0.0), -np.repeat(exponent, n))
            norm = np.sqrt(np.add.reduceat(y * y, at))
            out, fine[some] = y / np.repeat(np.where(ok, norm, 1.0), n), ok
        offsets = pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out), mask=pa.array(~fine))

    return apply(vector.cast(VECTOR))


def distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))


def nearest(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """(parent, cell, id, size, x, far): rows(cell, n, id, size, x) in the cells of their nearest pivots, and how far these are; pivots(cell, n, child, x).

    A cell is dealt out in slices of about SLICE rows, and its pivots go to each of them once.
    """
    slices = F.ceil(F.col("n") / SLICE).cast("long")
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(11)), slices))
    centres = pivots.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))

    def deal(rows: pa.Table, centres: pa.Table) -> pa.Table:
        if not rows.num_rows or not centres.num_rows:
            return kind.empty_table()
        centres = centres.sort_by("child")
        dot = matrix(rows.column("x").combine_chunks()) @ matrix(centres.column("x").combine_chunks()).T
        best = np.argmax(dot, axis=1)
        far = CoverTree.lengths(dot[np.arange(len(best)), best])
        columns = [rows.column("cell"), centres.column("child").take(pa.array(best)), *(rows.column(c) for c in ("id", "size", "x")), pa.array(far)]
        return pa.table(columns, schema=kind)

    kind = pa.schema([("parent", pa.int64()), ("cell", pa.int64()), ("id", pa.int64()), ("size", pa.int64()), ("x", pa.list_(pa.float64())), ("far", pa.float64())])
    pairs = dealt.groupBy("cell", "slice").cogroup(centres.groupBy("cell", "slice"))
    return pairs.applyInArrow(deal, f"parent long, cell long, id long, size long, x {VECTOR}, far double")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def cells(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(rows in their leaf cells, levels of the tree of cells): rows(cell, id, size, x), level(parent, cell, n, radius, centre)."""
    levels, done, depth = [], None, 0
    while True:
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
        large = stage(sizes.where(F.col("n") > LEAF), "cells")
        if large.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            return done, levels
        depth += 1
        small = rows.join(large.select("cell"), "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        open_ = rows.join(maybe_broadcast(large), "cell")
        chance = F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(1 << 40)) / float(1 << 40)
        wanted = F.least(F.lit(float(PIVOTS)), F.greatest(F.lit(4.0), F.col("n") * (2.0 / LEAF)))
        picked = open_.where(chance < wanted / F.col("n")).select("cell", "n", F.xxhash64("cell", "id", F.lit(depth)).alias("child"), "x")
        pivots = stage(picked, "pivots")
        moved = stage(nearest(open_, pivots), "cell-rows")
        unsplit = open_.join(maybe_broadcast(pivots.select("cell").distinct()), "cell", "left_anti")  # no pivot was drawn: tried again with another hash
        level = moved.groupBy("parent", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        level = level.join(pivots.select(F.col("child").alias("cell"), F.col("x").alias("centre")), "cell").select("parent", "cell", "n", "radius", "centre")
        levels.append(stage(level, "cell-level"))
        rows = stage(moved.drop("parent", "far").unionByName(unsplit.select("cell", "id", "size", "x")), "cell-rows")


def cell_pairs(roots: DataFrame, levels: list[DataFrame], reach: float) -> DataFrame:
    """(a, b), each pair once: pairs of leaf cells whose balls come within reach, from each root against itself downwards."""
    pairs = roots.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    pairs = pairs.withColumns({"ca": F.lit(None).cast(VECTOR), "cb": F.lit(None).cast(VECTOR), "ra": F.lit(None).cast("double"), "rb": F.lit(None).cast("double")})
    for level in levels:
        pairs = pairs.withColumn("own", F.col("a") == F.col("b"))  # a cell against itself: each pair of its children once
        for s, o in (("a", "b"), ("b", "a")):
            child = level.select(F.col("parent").alias(s), F.col("cell").alias("new"), F.col("centre").alias("centre"), F.col("radius").alias("radius"))
            kept = {"new": F.coalesce("new", s), "c": F.coalesce("centre", f"c{s}"), "r": F.coalesce("radius", f"r{s}")}
            pairs = pairs.join(child, s, "left").select(kept["new"].alias(f"{s}_"), kept["c"].alias(f"c{s}_"), kept["r"].alias(f"r{s}_"), o, f"c{o}", f"r{o}", "own")
            pairs = pairs.withColumnsRenamed({f"{s}_": s, f"c{s}_": f"c{s}", f"r{s}_": f"r{s}"})
        near = F.col("ca").isNull() | F.col("cb").isNull() | (distance(F.col("ca"), F.col("cb")) - F.col("ra") - F.col("rb") <= reach + SLACK)
        pairs = stage(pairs.where((~F.col("own") | (F.col("a") <= F.col("b"))) & near).drop("own"), "cell-pairs")
    return pairs.select("a", "b")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """vectors with n_links (other rows of the label linked directly), component_id and kept.

    Two rows link if their labels are equal and not null and their cosine, in double precision,
    is `least` or more. Rows without a label, or whose vector is null, empty, zero or holds null
    or non-finite components, link with nothing; nor do vectors of different lengths. Ids are
    whole numbers, null links like others and is larger than all; rows that repeat are separate
    vectors. component_id is the smallest id reachable, the row's own included; kept: it is the
    row's own. An empty table gives an empty one. Columns of vectors with these names are replaced.
    """
    x = unit(F.col(vector_col))
    rows = vectors.select(packed(vectors), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    rows = rows.withColumn("class", F.when(F.col("label").isNotNull() & F.col("x").isNotNull(), F.struct(F.xxhash64("label", F.size("x")).alias("cell"), F.xxhash64("x").alias("h"), F.xxhash64(F.lit(7), F.reverse("x")).alias("h2"))))
    rows = stage(rows.drop("label"), "vectors")
    valid = rows.where("class is not null")
    classes = valid.groupBy("class").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.first("x").alias("x"))
    classes = stage(classes.select("class", F.xxhash64("class.cell", "class.h", "class.h2").alias("id"), "low", "size", "x"), "classes")

    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    start = classes.select(F.col("class.cell").alias("cell"), "id", "size", "x")
    held, levels = cells(start)
    held = stage(held, "leaves") if levels else held
    pairs = cell_pairs(start.select("cell").distinct(), levels, reach)
    pairs = stage(pairs, "leaf-pairs")
    one = pairs.join(held.select(F.col("cell").alias("a"), "id", "size", "x"), "a").select("a", "b", F.lit(0).alias("side"), "id", "size", "x")
    two = pairs.where("a <> b").join(held.select(F.col("cell").alias("b"), "id", "size", "x"), "b").select("a", "b", F.lit(1).alias("side"), "id", "size", "x")

    def traverse(_: tuple, table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, w, x = table.column("id").to_numpy(), table.column("size").to_numpy().astype(float), matrix(table.column("x").combine_chunks())
        s, t = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        other = (None, None) if table.column("a")[0] == table.column("b")[0] else (x[t], w[t])
        if not len(s) or (other[0] is not None and not len(t)):
            u = v = counts = np.zeros(0, np.int64)
            names = np.zeros(0, np.int64)
        else:
            nx, ny, u, v = link_counts(x[s], w[s], *other, least)
            names = np.concatenate((ids[s], ids[t]))
            counts = np.concatenate((nx, ny)).astype(np.int64)
        some = np.flatnonzero(counts)
        none = lambda n: pa.nulls(n, pa.int64())
        counted, linked = (pa.array(names[some]), pa.array(counts[some])), (pa.array(names[u]), pa.array(names[v]))
        columns = [*(pa.concat_arrays([x, none(len(u))]) for x in counted), *(pa.concat_arrays([none(len(some)), x]) for x in linked)]
        return pa.table(columns, names=["id", "links", "u", "v"])

    found = stage(one.unionByName(two).groupBy("a", "b").applyInArrow(traverse, "id long, links long, u long, v long"), "links")
    links = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    nodes = connected_components(found.where("u is not null").select("u", "v"))
    whole = classes.select("class", "id", "size", "low").join(links, "id", "left").join(nodes.withColumnRenamed("node", "id"), "id", "left")
    whole = stage(whole.select("class", "low", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "classes")
    lows = stage(whole.groupBy("component").agg(F.min("low").alias("component_id")), "lows")  # written, so that Spark can split a hot component
    whole = whole.join(lows, "component").select("class", "n_links", "component_id")
    out = rows.join(stage(whole, "classes"), "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return unpacked(out, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
