"""Connected components by alternating large-star and small-star rounds.

First every partition reduces its edges to stars, so that a dense graph has at most
a node's number of edges in each partition before anything is shuffled. Each round is two shuffles over the edge table and is written to the shared
folder, so a lost executor costs one round. A hub is never collected: minima are
pre-aggregated per partition and the join back is one row per node on one side,
which adaptive execution splits where a node is hot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutworks.runtime import staged

#: Edges that a partition gathers before it reduces them.
_HELD = 1 << 20


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs that connect what the links connect; the root is the smallest node."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _local_stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars, for nodes of any type."""
    held: list[pa.RecordBatch] = []

    def reduced() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).drop_null()
        u, v = (table.column(c).combine_chunks() for c in ("u", "v"))
        coded = pa.concat_arrays([u, v]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        names, place = coded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        codes = place[coded.indices.to_numpy()]
        # stars around the smallest node, so that those of different partitions often are the same
        node, root = spanning_forest(codes[: len(u)], codes[len(u) :])
        return pa.RecordBatch.from_arrays([names.take(pa.array(node)), names.take(pa.array(root))], schema=held[0].schema)

    for batch in batches:
        held.append(batch)
        if len(held) > 1 and sum(b.num_rows for b in held) > max(_HELD, 2 * held[0].num_rows):
            held = [reduced()]
    if held:
        yield reduced()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # stored, so that the join shuffles both sides itself and can split a hub's partition
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one parent, which has none: the stars are the components."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its smallest node.

    Loops, repeated and null edges are ignored. Nodes without an edge to another
    node aren't listed.
    """
    given = edges.select("u", "v").where("u <> v")
    now = staged(given.mapInArrow(_local_stars, given.schema).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = staged(_small_star(_large_star(now)), "stars")
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
