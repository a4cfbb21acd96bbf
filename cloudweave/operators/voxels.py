"""Voxel grids. A point's voxel is a set of key columns, so the inverse index is the point table itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.functions.geometry import XYZ, cell


def with_voxels(points: DataFrame, size: Sequence[float]) -> DataFrame:
    """Points with their voxel's indices vx, vy, vz."""
    return points.withColumns({f"v{d}": cell(F.col(d), s) for d, s in zip(XYZ, size, strict=True)})


def voxel_centroids(points: DataFrame, size: Sequence[float]) -> DataFrame:
    """vx, vy, vz, x, y, z, n: mean position and number of the points of every voxel."""
    return with_voxels(points, size).groupBy("vx", "vy", "vz").agg(*[F.avg(d).alias(d) for d in XYZ], F.count("*").alias("n"))


def in_box(points: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Points of a closed box. Plain comparisons, so they reach the Parquet scan."""
    for d, a, b in zip(XYZ, low, high, strict=True):
        points = points.where(F.col(d).between(F.lit(a), F.lit(b)))
    return points


def voxel_adjacency(points: DataFrame, size: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the occupied voxels; an edge joins voxels that touch, corners included. Edges run from the smaller id.

    Vertex ids are the voxel's indices as one struct, so no numbering job is needed.
    """
    vertices = voxel_centroids(points, size).withColumn("vid", F.struct("vx", "vy", "vz"))
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    near = vertices.select("vid", F.explode(F.array(*[F.struct(*[F.lit(o).cast("long").alias(f"o{d}") for o, d in zip(s, XYZ, strict=True)]) for s in steps])).alias("o"))
    near = near.select(F.col("vid").alias("src"), *[(F.col(f"vid.v{d}") + F.col(f"o.o{d}")).alias(f"v{d}") for d in XYZ])
    edges = near.join(vertices.select(F.col("vid").alias("dst"), "vx", "vy", "vz"), ["vx", "vy", "vz"]).select("src", "dst")
    return vertices, edges
