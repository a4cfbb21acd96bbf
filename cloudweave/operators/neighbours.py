"""Range joins and nearest neighbours on a grid.

A distance predicate alone would plan as a Cartesian product. Here one side is copied to the cells around each
of its points and the other stays in its own cell, so the join is an equality on cell indices that Catalyst hashes or
sorts, with the distance as a residual filter. Cells are a hair wider than the radius, so rounding loses no pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudweave.functions.geometry import XYZ, cell, squared_distance
from cloudweave.operators.iteration import cut

_WIDER = 1 + 1e-9


def _celled(df: DataFrame, id_col: str, dims: Sequence[str], size: float, to: str, spread: int) -> DataFrame:
    """id and coordinates under prefixed names with cell columns k0..; spread copies each row to the cells around."""
    keys = [cell(F.col(d), size) for d in dims]
    out = df.select(F.col(id_col).alias(f"{to}"), *[F.col(d).cast("double").alias(f"_{to}{n}") for n, d in enumerate(dims)], *[k.alias(f"_c{n}") for n, k in enumerate(keys)])
    if spread:
        offsets = F.array(*[F.struct(*[F.lit(o).cast("long").alias(f"o{n}") for n, o in enumerate(c)]) for c in itertools.product(range(-spread, spread + 1), repeat=len(dims))])
        out = out.withColumn("_o", F.explode(offsets))
        return out.select(to, *[f"_{to}{n}" for n in range(len(dims))], *[(F.col(f"_c{n}") + F.col(f"_o.o{n}")).alias(f"k{n}") for n in range(len(dims))])
    return out.select(to, *[f"_{to}{n}" for n in range(len(dims))], *[F.col(f"_c{n}").alias(f"k{n}") for n in range(len(dims))])


def range_join(
    left: DataFrame, right: DataFrame, radius: float, dims: Sequence[str] = XYZ, left_id: str = "pid", right_id: str = "pid",
    strict: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """(i, j, d2) of all pairs at most ``radius`` apart (below it with ``strict``). ``keep``: columns of right carried along.

    The left side is the one that is copied to the surrounding cells.
    """
    size = radius * _WIDER
    a = _celled(left, left_id, dims, size, "i", 1)
    b = _celled(right, right_id, dims, size, "j", 0)
    if keep:
        extra = right.select(F.col(right_id).alias("j"), *[F.col(c) for c in keep])
    d2 = squared_distance([F.col(f"_i{n}") for n in range(len(dims))], [F.col(f"_j{n}") for n in range(len(dims))])
    limit = F.lit(float(radius)) * F.lit(float(radius))
    pairs = a.join(b, [f"k{n}" for n in range(len(dims))]).select("i", "j", d2.alias("d2")).where(F.col("d2") < limit if strict else F.col("d2") <= limit)
    return pairs.join(extra, "j") if keep else pairs


def neighbours(points: DataFrame, radius: float, dims: Sequence[str] = XYZ, strict: bool = False) -> DataFrame:
    """(i, j, d2) of a cloud with itself; a point is left out by its id, so exact duplicates stay neighbours."""
    return range_join(points, points, radius, dims, strict=strict).where("i <> j")


def neighbours_by(points: DataFrame, radius: float, metric: Column | None = None, dims: Sequence[str] = XYZ) -> DataFrame:
    """(i, j, d) with a pluggable metric: a column over _i0.. and _j0.. that is at least the Chebyshev distance."""
    size = radius * _WIDER
    a, b = _celled(points, "pid", dims, size, "i", 1), _celled(points, "pid", dims, size, "j", 0)
    if metric is None:
        metric = F.sqrt(squared_distance([F.col(f"_i{n}") for n in range(len(dims))], [F.col(f"_j{n}") for n in range(len(dims))]))
    return a.join(b, [f"k{n}" for n in range(len(dims))]).select("i", "j", metric.alias("d")).where((F.col("d") <= float(radius)) & (F.col("i") != F.col("j")))


def bounds(points: DataFrame, dims: Sequence[str] = XYZ) -> DataFrame:
    """One row: the true minimum and maximum of every dimension."""
    return points.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])


def knn(queries: DataFrame, points: DataFrame, k: int, dims: Sequence[str] = XYZ, same: bool = True, start: float | None = None) -> DataFrame:
    """(i, j, d2, rank) of the k nearest points of every query, ties by id; ``same``: a point is not its own neighbour.

    A query is finished once k neighbours lie within the radius; the unfinished go on with twice the radius, up to the
    diagonal of everything. The first radius is that of a ball which holds a few times k points on average.
    """
    box = bounds(points.select(*dims).unionByName(queries.select(*dims)), dims).first()
    n = points.count()
    if not n or box[0] is None:
        return queries.select(F.col("pid").alias("i"), F.col("pid").alias("j"), F.lit(0.0).alias("d2"), F.lit(1).alias("rank")).limit(0)
    sides = [float(box[2 * m + 1]) - float(box[2 * m]) for m in range(len(dims))]
    diagonal = max(math.sqrt(sum(s * s for s in sides)), 1e-12)
    wide = [s for s in sides if s > 0]
    radius = start or (min(diagonal, (math.prod(wide) * 2 * (k + 1) / n) ** (1 / len(wide))) if wide else diagonal)
    best = Window.partitionBy("i").orderBy("d2", "j")
    todo, done = queries, []
    while True:
        radius = min(radius, diagonal * (1 + 1e-6))
        last = radius >= diagonal
        pairs = range_join(todo, points, radius, dims)
        pairs = pairs.where("i <> j") if same else pairs
        ranked = cut(pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        if last:
            done.append(ranked)
            break
        full = ranked.where(F.col("rank") == k).select("i")
        done.append(ranked.join(full, "i", "left_semi"))
        todo = cut(todo.join(full, todo["pid"] == full["i"], "left_anti"))
        if todo.isEmpty():
            break
        radius *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("i", "j", "d2", "rank")


def nearest_within(queries: DataFrame, points: DataFrame, radius: float, dims: Sequence[str] = XYZ) -> DataFrame:
    """(i, j, d2): the closest point no farther than the radius, ties by id."""
    pairs = range_join(queries, points, radius, dims)
    return pairs.groupBy("i").agg(F.min(F.struct("d2", "j")).alias("m")).select("i", F.col("m.j").alias("j"), F.col("m.d2").alias("d2"))


def nearest_vertex(queries: DataFrame, points: DataFrame, dims: Sequence[str] = XYZ) -> DataFrame:
    """(i, j, d2): the closest point however far."""
    return knn(queries, points, 1, dims, same=False).select("i", "j", "d2")
