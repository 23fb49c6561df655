"""Connected components of an edge table: tasks contract the edges that they hold, and every node jumps over its parent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import Scratch, lean

HELD_EDGES = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes, each other node of a component with its smallest one, in the order of nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    hangs = root != np.arange(len(nodes))
    return nodes[hangs], nodes[root[hangs]]


@lean
def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, HELD_EDGES at a time, as stars."""

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))], names=["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append([np.asarray(batch.column(k), dtype=np.int64) for k in (0, 1)])
        size += batch.num_rows
        if size > HELD_EDGES:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _dealt(edges: DataFrame) -> DataFrame:
    """Stars of stars: a node's edges, one at most from each task before, meet in one task. A hub is the smaller end, by which nothing is dealt."""
    contract = lambda df: df.mapInArrow(_contracted, "a long, b long")
    return contract(contract(edges.select("a", "b")).repartition("a"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one smaller node that hangs on none: then that is the smallest of its component, and no step would change anything."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)")
    return odd.agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """edges: a, b (long). Returns node, root: the smallest node reachable. Nodes without edges aren't returned.

    In a round each edge of a node goes to the least parent of the parent that it names. The least parents of a node's ancestors are a path down to a
    node without parents; its nodes stay connected as each of them jumps over one, so the components stay as they are. It is a join of two written
    tables, which adaptive execution splits where a node is a hub. Paths are halved at least, and what tasks hold is contracted before and after.
    """
    current = tmp.save(_dealt(edges.filter("a <> b")), f"{name}-0")
    k = 0
    while not _stars(current):
        k += 1
        least = tmp.save(current.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("_up")), f"{name}-{k}-least")
        current = tmp.save(_dealt(current.join(least, "b", "left").select("a", F.coalesce("_up", "b").alias("b"))), f"{name}-{k}")
        tmp.drop(f"{name}-{k}-least", f"{name}-{k - 1}")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
