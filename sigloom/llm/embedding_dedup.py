"""All pairs of embeddings above a cosine, by traversing pairs of cover trees.

Vectors are scaled to length 1, where cosine >= c is distance <= sqrt(2 - 2c).
Equal vectors form a class of which one takes part.  The tree's top is built on
the driver from a bounded sample: centres in farthest-first order, whose
covering radii halve as centres are added.  Each vector joins its nearest
centre's cell; cells are dealt into blocks of bounded size.  Each block is a
cover tree, built once: nested levels whose radii halve, with separated centres
that cover every point (see ``CoverTree``).

Two cells, two blocks or two nodes are compared only if their centres are no
farther apart than both covering radii and the threshold.  Where nodes can't be
pruned, their leaves are compared by matrix products; the sample and the cells
steer the work only, every vector is indexed and every pair above the
threshold is found.  Tasks return counts of links and a spanning forest of
them, never all pairs of a group.

Vectors without near neighbours, all about equally far from each other, can't
be pruned by any metric tree; their blocks are compared pair by pair, so for
such data the work grows with the square of the number of distinct vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.components import components, roots
from sigloom.llm.storage import Workspace

#: Most vectors that are sampled for the top of the tree, most cells, rows of a block, points of a leaf.
SAMPLE, CELLS, BLOCK, LEAF = 4096, 512, 4096, 128
#: Single precision decides beyond this distance from the threshold, double within it.
SLACK = 1e-4


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def farthest_first(x: np.ndarray, count: int, stop: float = 0.0) -> list[int]:
    """Places of up to ``count`` centres: each is the point farthest from those before, as long as it is farther than ``stop``."""
    picked, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(count, len(x)):
        k = int(far.argmax())
        if far[k] <= stop:
            break
        picked.append(k)
        np.minimum(far, np.linalg.norm(x - x[k], axis=1), out=far)
    return picked


NODE = np.dtype([("level", "<i4"), ("centre", "<i4"), ("radius", "<f8"), ("start", "<i4"), ("end", "<i4"), ("first", "<i4"), ("children", "<i4")])


def greedy(x: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """Points in farthest-first order from point 0, as far as they are farther than ``stop`` from all before, and those distances."""
    order, far, apart = [0], np.linalg.norm(x - x[0], axis=1), [math.inf]
    while True:
        k = int(far.argmax())
        if far[k] <= stop:
            return np.array(order), np.array(apart)
        order.append(k)
        apart.append(float(far[k]))
        np.minimum(far, np.linalg.norm(x - x[k], axis=1), out=far)


class CoverTree:
    """The cover tree of a block of vectors of length 1.

    Level ``i`` has the radius ``2 ** (1 - i)``.  Its centres are the points that
    farthest-first order reaches before that radius: they are farther than the
    radius from each other (separation), every point is within the radius of
    one (covering), and they are centres of all levels below (nesting).  A
    centre's parent is the nearest centre of the level above, itself if it is
    one.  Points are ordered so that every node is a run of them; levels at
    which a node has one child only are left out; a node whose children would be
    too small to be worth a matrix product is a leaf.  ``radius`` of a node is
    the measured distance to its farthest point, at most twice its level's.
    """

    def __init__(self, x: np.ndarray, nodes: np.ndarray, order: np.ndarray | None = None) -> None:
        self.x, self.nodes, self.order = x, nodes, order
        self.kids = [range(n["first"], n["first"] + n["children"]) for n in nodes]
        self.radius = nodes["radius"].tolist()
        self.run = list(zip(nodes["start"].tolist(), nodes["end"].tolist(), strict=True))

    @staticmethod
    def levels(x: np.ndarray, finest: float) -> tuple[np.ndarray, list[int]]:
        """The greedy order, and how many of its first points are the centres of each level, down to the radius ``finest``."""
        order, apart = greedy(x, finest)
        counts, radius = [], 2.0
        while radius > finest / 2:
            counts.append(int((apart > max(radius, finest)).sum()))
            radius /= 2
        return order, counts

    @classmethod
    def of(cls, x: np.ndarray, finest: float = 0.1, leaf: int = LEAF) -> CoverTree:
        order, counts = cls.levels(x, finest)
        # The centre of every point at every level, from the finest up: places in the greedy order.
        own = (x @ x[order].T).argmax(axis=1)
        own[order] = np.arange(len(order))
        above = [own]
        for more, fewer in zip(counts[:0:-1], counts[-2::-1], strict=True):
            up = np.arange(more)
            if more > fewer:
                up[fewer:] = (x[order[fewer:more]] @ x[order[:fewer]].T).argmax(axis=1)
            above.append(up[above[-1]])
        paths = np.stack(above[::-1])  # a row a level
        rows = np.lexsort(paths[::-1])
        x, paths = x[rows], paths[:, rows]
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        nodes, todo = [[0, 0, 0.0, 0, len(x), 0, 0]], [0]
        for k in todo:  # grows while it is gone through: a node's children lie side by side
            level, _, _, start, end, _, _ = nodes[k]
            level = next((i for i in range(level, len(paths)) if (paths[i, start:end] != paths[i, start]).any()), len(paths)) - 1
            centre = int(place[order[paths[max(level, 0), start]]])
            nodes[k][:3] = [level, centre, float(np.linalg.norm(x[start:end] - x[centre], axis=1).max())]
            if end - start <= leaf or level + 1 >= len(paths):
                continue
            edges = start + 1 + np.flatnonzero(np.diff(paths[level + 1, start:end]))
            if (len(edges) + 1) * (leaf // 4) > end - start:
                continue
            nodes[k][5:] = [len(nodes), len(edges) + 1]
            for a, b in zip([start, *edges.tolist()], [*edges.tolist(), end], strict=True):
                todo.append(len(nodes))
                nodes.append([level + 1, 0, 0.0, a, b, 0, 0])
        return cls(x, np.array([tuple(n) for n in nodes], NODE), rows)


def near_nodes(a: CoverTree, b: CoverTree, reach: float) -> Iterator[tuple[int, int]]:
    """Pairs of leaves that may hold points within ``reach``; of one tree with itself, each pair once."""
    same, todo = a is b, [(0, 0)]
    ca, cb = a.x[a.nodes["centre"]], b.x[b.nodes["centre"]]
    while todo:
        i, j = todo.pop()
        if not (same and i == j) and np.linalg.norm(ca[i] - cb[j]) > a.radius[i] + b.radius[j] + reach + 1e-9:
            continue
        left, right = a.kids[i], b.kids[j]
        if not left and not right:
            yield i, j
        elif same and i == j:
            todo.extend((p, q) for k, p in enumerate(left) for q in left[k:])
        elif left and (not right or a.radius[i] >= b.radius[j]):
            todo.extend((p, j) for p in left)
        else:
            todo.extend((i, q) for q in right)


def links(a: CoverTree, b: CoverTree, cosine: float, weight_a: np.ndarray, weight_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between (or within) blocks: weighted counts for the rows of both, and a spanning forest over rows (those of ``b`` come after ``a``'s)."""
    same, reach = a is b, math.sqrt(max(0.0, 2 - 2 * cosine))
    count_a, count_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    fa, fb = a.x.astype(np.float32), b.x.astype(np.float32)
    base = 0 if same else len(a.x)
    forest = (np.empty(0, np.int64), np.empty(0, np.int64))
    for i, j in near_nodes(a, b, reach):
        (p, q), (r, s) = a.run[i], b.run[j]
        found = fa[p:q] @ fb[r:s].T >= cosine - SLACK
        if same and i == j:
            found = np.triu(found, 1)
        u, v = np.nonzero(found)
        if not len(u):
            continue
        sure = (a.x[p + u] * b.x[r + v]).sum(axis=1) >= cosine
        u, v = u[sure] + p, v[sure] + r
        np.add.at(count_a, u, weight_b[v])
        np.add.at(count_b, v, weight_a[u])
        nodes, least = roots(np.concatenate([forest[0], u]), np.concatenate([forest[1], v + base]))
        own = nodes != least
        forest = (nodes[own], least[own])
    return count_a, count_b, *forest


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def embedding_dedup(spark: SparkSession, vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding).

    Null vectors, empty or zero ones, and those with a null or non-finite
    component link with nothing; vectors of different lengths don't link.
    ``n_links`` counts the other rows linked directly, equal ones too.  A null
    vec_id links with nothing and is kept, with a null component; ``vec_id`` is
    a key, rows repeated with it count as rows.  Other columns are ignored; no
    rows give none.
    """
    space = Workspace(spark, "embeddings")
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists(v, lambda c: c != 0)).select("vec_id", v.alias("x"))
    classes = space.cut(good.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")

    # The top of the tree: a bounded sample by hash, a number of cells that follows the rows.
    lengths = classes.groupBy(F.size("x").alias("d")).count().orderBy("d").collect()
    centres: dict[int, np.ndarray] = {}
    for d, count in lengths:
        sample = [r.x for r in classes.where(F.size("x") == d).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("x").collect()]
        picked = unit(np.array(sample))
        centres[d] = picked[farthest_first(picked, max(1, min(CELLS, count // BLOCK)))]
    sent = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            for d, part in rows.groupby(rows.x.map(len)):
                x = unit(np.stack(part.x.to_numpy()))
                near = x @ sent.value[d].T
                cell = near.argmax(axis=1)
                far = np.linalg.norm(x - sent.value[d][cell], axis=1)
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"d": d, "cell": cell, "far": far, "rep": part.rep.to_numpy(), "n": part.n.to_numpy(), "x": [_packed(r) for r in x]}).astype({"d": "int32", "cell": "int32"}), preserve_index=False
                )

    placed = space.cut(classes.mapInArrow(place, "d int, cell int, far double, rep long, n long, x binary"), "placed")
    # A row a cell, at most CELLS of them for a length.
    cells = placed.groupBy("d", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("rows")).orderBy("d", "cell").collect()
    reach, pairs = math.sqrt(max(0.0, 2 - 2 * cosine)), []
    for k, a in enumerate(cells):
        for b in cells[k:]:
            if a.d == b.d and (a.cell == b.cell or np.linalg.norm(centres[a.d][a.cell] - centres[a.d][b.cell]) <= a.radius + b.radius + reach + 1e-9):
                pairs.append((a.d, a.cell, b.cell))
    parts = spark.createDataFrame([(c.d, c.cell, -(-c.rows // BLOCK)) for c in cells], "d int, cell int, parts int")

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")  # the same tree however rows arrive
        tree = CoverTree.of(np.frombuffer(b"".join(rows.x), np.float64).reshape(len(rows), -1), reach / 4)
        reps, ns = (rows[c].to_numpy(np.int64)[tree.order] for c in ("rep", "n"))
        root = tree.nodes[0]
        return pd.DataFrame({"d": [key[0]], "cell": [key[1]], "part": [key[2]], "centre": [_packed(tree.x[root["centre"]])], "radius": [float(root["radius"])], "reps": [_packed(reps)], "ns": [_packed(ns)], "xs": [_packed(tree.x)], "nodes": [tree.nodes.tobytes()]})

    # Blocks are bounded: a cell of many vectors is dealt into as many blocks as it needs.
    dealt = placed.join(F.broadcast(parts), ["d", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    blocks = space.cut(
        dealt.groupBy("d", "cell", "part").applyInPandas(block, "d int, cell int, part int, centre binary, radius double, reps binary, ns binary, xs binary, nodes binary"), "blocks"
    )
    near = spark.createDataFrame(pairs, "d int, ca int, cb int")
    mine = blocks.select("d", F.col("cell").alias("ca"), F.col("part").alias("pa"), F.struct("centre", "radius", "reps", "ns", "xs", "nodes").alias("a"))
    theirs = blocks.select("d", F.col("cell").alias("cb"), F.col("part").alias("pb"), F.struct("centre", "radius", "reps", "ns", "xs", "nodes").alias("b"))
    once = (F.col("ca") != F.col("cb")) | (F.col("pa") <= F.col("pb"))
    # Blocks meet by keys of their own first, the vectors follow by the pair of keys.
    which = near.join(mine.select("d", "ca", "pa"), ["d", "ca"]).join(theirs.select("d", "cb", "pb"), ["d", "cb"]).where(once)
    tasks = which.join(mine, ["d", "ca", "pa"]).join(theirs, ["d", "cb", "pb"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                ca, cb = np.frombuffer(a["centre"]), np.frombuffer(b["centre"])
                if np.linalg.norm(ca - cb) > a["radius"] + b["radius"] + reach + 1e-9:
                    continue
                ids, ns, trees = [], [], []
                for side in (a, b):
                    own = np.frombuffer(side["reps"], np.int64)
                    ids.append(own)
                    ns.append(np.frombuffer(side["ns"], np.int64))
                    trees.append(CoverTree(np.frombuffer(side["xs"], np.float64).reshape(len(own), -1), np.frombuffer(side["nodes"], NODE)))
                    if a["reps"] == b["reps"]:
                        trees, ids, ns = trees * 2, ids * 2, ns * 2
                        break
                count_a, count_b, u, w = links(*trees, cosine, *ns)
                every = ids[0] if trees[0] is trees[1] else np.concatenate(ids)
                out_id = np.concatenate([ids[0][count_a > 0], ids[1][count_b > 0], every[u]])
                other = np.concatenate([np.full(int((count_a > 0).sum() + (count_b > 0).sum()), -1), every[w]])
                n = np.concatenate([count_a[count_a > 0], count_b[count_b > 0], np.zeros(len(u), np.int64)])
                yield pa.record_batch([pa.array(out_id), pa.array(n), pa.array(other), pa.array(n == 0)], names=["rep", "links", "other", "is_link"])

    found = space.cut(tasks.select("a", "b").mapInArrow(compare, "rep long, links long, other long, is_link boolean"), "found")
    groups = components(found.where("is_link").select("rep", "other"), space)
    counts = found.where("NOT is_link").groupBy("rep").agg(F.sum("links").alias("links"))
    classed = (
        classes.join(counts, "rep", "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select("x", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    # Rows that can't link get a key that no class has.
    every = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists(v, lambda c: c != 0), v).alias("x"))
    out = every.join(classed, "x", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
