"""Connected components of a graph of links, without ever holding the graph in one place.

Each task first joins its own links with union-find and passes on one link a
node.  The rest are turned into stars by alternating two steps (each node links
its larger neighbours to the smallest one; then its smaller ones likewise),
which converges in a logarithmic number of rounds.  A round groups with
partial sums and joins on the node; a node with very many larger neighbours is
dealt to parts (see ``hot_keys``); smaller ones it has few of, at first one a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.hot_keys import copied, dealt, hot_keys
from sigloom.llm.storage import Workspace, trimmed


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links of arbitrary numbers: the nodes, and each node's smallest reachable one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        open_ = low < high
        if not open_.any():
            return nodes, nodes[parent]
        np.minimum.at(parent, high[open_], low[open_])
        x, y = x[open_], y[open_]
        while True:  # halve the paths until all are flat
            flat = parent[parent]
            if (flat == parent).all():
                break
            parent = flat


@trimmed
def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def join() -> tuple[np.ndarray, np.ndarray]:
        nodes, root = roots(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        own = nodes != root
        return nodes[own], root[own]

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(h[0]) for h in held) > 500_000:
            held = [join()]
            if len(held[0][0]) > 250_000:  # memory stays bounded; the stars do the rest
                yield pa.record_batch([pa.array(held[0][0]), pa.array(held[0][1])], names=["u", "v"])
                held = []
    if held:
        u, v = join()
        yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def _star(links: DataFrame, large: bool, total: int = 0) -> DataFrame:
    """``links`` has u > v, so has the result; ``total`` is at least the number of links."""
    if large:
        # A node's larger neighbours go to its smallest one, or stay if it has none that is smaller.
        hot = hot_keys(links.groupBy("v").agg(F.count("*").alias("n")), "v", total)
        least = links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        out = dealt(links, hot, "v", "u").join(copied(least, hot, "v"), ["v", "part"], "left").select("u", F.coalesce("m", "v").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = joined.unionByName(least.withColumnRenamed("m", "v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame, space: Workspace, name: str = "components") -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node with a link.

    ``links`` holds two long columns, in any order and direction, repeated or
    not; links of a node to itself, or to null, are of no account.  No links, no rows.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    # Both ends of a link first, so that those of one group tend to meet in a task.
    clean = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b))
    edges = space.cut(clean.mapInArrow(_local, "u long, v long"), f"{name}-0")
    before, k = None, 0
    while True:
        at = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long") * 31 + F.hash("v", "u"))).first()
        if at == before or not at[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, k = at, k + 1
        edges = space.cut(_star(_star(edges, True, at[0]), False), f"{name}-{k}")
        if k > 1:
            space.drop(f"{name}-{k - 2}")
