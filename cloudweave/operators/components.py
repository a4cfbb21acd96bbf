"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins, so no task gathers the neighbours of a node, and the
number of rounds grows with the logarithm of the component size. A round's edges never outnumber
those of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.operators.iteration import cut


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node reached.

    Nodes without such an edge do not appear: a left join with ``coalesce(component, node)`` adds them.
    Null ends and self loops are ignored.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    # An edge is held once, as (a, b) with b < a: b is a's candidate for a smaller label.
    star = cut(pairs.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    seen = _summary(star)
    if not seen[0]:
        return star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        # Large star: every larger neighbour of u moves to the smallest neighbour of u (or u itself).
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).union(star.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every smaller neighbour of u, and u, moves to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        star = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = _summary(star)
        if now == seen:
            named = star.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return named.unionByName(named.select(F.col("component").alias("node"), "component").distinct())
        seen = now


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the edges u, v."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        root[u] = v
        while (root[root] != root).any():
            root = root[root]
    return root


def stars(edges: DataFrame, src: str, dst: str, rows: int = 1 << 20) -> DataFrame:
    """(src, dst) as longs with the same components and no more rows a task than it has nodes: each task links nodes to their smallest."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [np.zeros((2, 0), dtype=np.int64)], 0

        def folded() -> list[np.ndarray]:
            both = np.concatenate(kept, axis=1)
            ids, of = np.unique(both, return_inverse=True)
            of = of.reshape(both.shape)
            root = roots(of[0], of[1], len(ids))
            return [np.stack([ids, ids[root]])[:, root != np.arange(len(ids))]]

        for b in batches:
            kept.append(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
            held += b.num_rows
            if held >= rows:
                kept, held = folded(), 0
        u, v = folded()[0]
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=[src, dst])

    ends = edges.select(F.col(src).cast("long").alias(src), F.col(dst).cast("long").alias(dst)).where(F.col(src) != F.col(dst))
    return ends.mapInArrow(reduce, f"{src} long, {dst} long")
