"""Filters, projections and cleaning of point clouds. Every operator takes and returns rows with a ``pid``."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudweave.functions.geometry import XYZ, squared_distance, transformed
from cloudweave.operators.neighbours import bounds, knn, range_join


def remove_duplicates(points: DataFrame, dims: Sequence[str] = XYZ) -> DataFrame:
    """One row for each distinct position: the smallest pid."""
    return points.groupBy(*dims).agg(F.min("pid").alias("pid")).select("pid", *dims)


def remove_close_duplicates(points: DataFrame, tolerance: float = 1e-6, dims: Sequence[str] = XYZ) -> DataFrame:
    """Points in descending order, without those within the tolerance of the last kept one on every axis.

    Depends on that order by definition; the order is cut into ranges of x, so a pair across a range border may both stay.
    """
    first, *rest = dims
    order = [F.desc(first), *[F.desc(d) for d in rest], "pid"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for p in parts:
            keep = []
            for row in p[list(dims)].itertuples(index=False):
                new = last is None or any(abs(a - b) >= tolerance for a, b in zip(row, last, strict=True))
                last = row if new else last
                keep.append(new)
            yield p[keep]

    rows = points.select("pid", *dims)
    return rows.repartitionByRange(F.desc(first)).sortWithinPartitions(*order).mapInPandas(run, rows.schema)


def ordered(points: DataFrame) -> DataFrame:
    """Positions from large to small, x before y before z."""
    return points.orderBy(F.desc("x"), F.desc("y"), F.desc("z"), "pid")


def height_slices(points: DataFrame, thickness: float, more_than: int = 10) -> DataFrame:
    """Points with the index of their horizontal slab, counted from the top; slabs of ``more_than`` points or fewer are dropped.

    Slabs are half open; the lowest point belongs to the last slab.
    """
    top = points.agg(F.max("z").alias("_top"), F.min("z").alias("_low"))
    last = F.greatest(F.ceil((F.col("_top") - F.col("_low")) / thickness) - 1, F.lit(0))
    sliced = points.join(F.broadcast(top)).withColumn("slice", F.least(F.floor((F.col("_top") - F.col("z")) / thickness), last).cast("long")).drop("_top", "_low")
    # Slab counts are pre-aggregated: a slab may hold a third of all points.
    sizes = sliced.groupBy("slice").agg(F.count("*").alias("_n")).where(F.col("_n") > more_than).select("slice")
    return sliced.join(sizes, "slice", "left_semi")


def bounding_box(points: DataFrame) -> DataFrame:
    return bounds(points)


def overlap(points: DataFrame, reference: DataFrame, radius: float) -> DataFrame:
    """The points within the radius of any reference point, each once."""
    near = range_join(points, reference, radius).select(F.col("i").alias("pid")).distinct()
    return points.join(near, "pid", "left_semi")


def voxel_sample(points: DataFrame, size: Sequence[float], at_least: int, samples: int) -> DataFrame:
    """(vx, vy, vz, pid, rank): around each voxel's centroid the nearest min(samples, at_least) points within the longest side.

    Only voxels with ``at_least`` points in that ball count. A point may be sampled by several voxels.
    """
    from cloudweave.operators.voxels import voxel_centroids

    # Means of doubles depend on the order of rows: rounded, equal distances stay ties in every run.
    centres = voxel_centroids(points, size).withColumns({d: F.round(d, 9) for d in XYZ}).withColumn("pid", F.struct("vx", "vy", "vz"))
    pairs = range_join(centres.select("pid", "x", "y", "z"), points, max(size)).withColumn("d2", F.round("d2", 9))
    n = min(samples, at_least)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d2", "j")))
    full = pairs.groupBy("i").agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least).select("i")
    return ranked.where(F.col("rank") <= n).join(full, "i", "left_semi").select("i.vx", "i.vy", "i.vz", F.col("j").alias("pid"), "rank")


def statistical_outliers(points: DataFrame, k: int, multiplier: float, negative: bool = False) -> DataFrame:
    """Points whose mean distance to their k nearest is at most mean + multiplier * deviation over all; negative: the others."""
    mean = knn(points, points, k).groupBy(F.col("i").alias("pid")).agg(F.avg(F.sqrt("d2")).alias("mean_distance"))
    # Sums of doubles depend on their order: the threshold is rounded, so a recomputed plan decides alike.
    limit = mean.agg(F.round(F.avg("mean_distance") + multiplier * F.stddev_samp("mean_distance"), 9).alias("_limit"))
    inside = F.col("mean_distance") <= F.col("_limit")
    return mean.join(F.broadcast(limit)).where(~inside if negative else inside).select("pid", "mean_distance")


def facade_or_ground(normals: DataFrame, facade_degrees: float = 85.0, ground_degrees: float = 15.0, ground_above: float | None = None) -> DataFrame:
    """Normals that are near horizontal ('facade') or near vertical ('ground'); ground_above: least z of ground points."""
    up = F.abs(F.col("nz"))
    ground = up > F.lit(math.cos(math.radians(ground_degrees)))
    if ground_above is not None:
        ground = ground & (F.col("z") > ground_above)
    kind = F.when(up < F.lit(math.cos(math.radians(facade_degrees))), "facade").when(ground, "ground")
    return normals.withColumn("surface", kind).where("surface is not null")


def integer_offset(points: DataFrame, least: float = 10_000.0) -> DataFrame:
    """One row (ox, oy, oz): the rounded position of the point of smallest pid, 0 where that is below ``least``."""
    first = points.agg(F.min(F.struct("pid", "x", "y", "z")).alias("p"))
    return first.select(*[F.when(F.abs(F.col(f"p.{d}")) >= least, F.round(F.col(f"p.{d}"))).otherwise(F.lit(0.0)).alias(f"o{d}") for d in XYZ])


def shifted(points: DataFrame, offset: DataFrame, sign: int = -1) -> DataFrame:
    """Points with the offset taken away (or, with sign 1, put back)."""
    both = points.join(F.broadcast(offset))
    return both.select(*[(F.col(c) + sign * F.col(f"o{c}")).alias(c) if c in XYZ else F.col(c) for c in points.columns])


def projected(points: DataFrame, dims: int = 2) -> DataFrame:
    """pid with two or three coordinates as single-precision numbers."""
    return points.select("pid", *[F.col(d).cast("float").alias(d) for d in XYZ[:dims]])


def merge_overlap(points: DataFrame, reference: DataFrame, radius: float, keep: Sequence[str] = ("pid", "x", "y", "z")) -> DataFrame:
    """All reference points and those of ``points`` within the radius of one."""
    near = overlap(points, reference, radius)
    return reference.select(*keep, F.lit("reference").alias("origin")).unionByName(near.select(*keep, F.lit("target").alias("origin")))


def rigid_transform(points: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Points under a 4x4 transform; all other columns are kept."""
    moved = dict(zip(XYZ, transformed(matrix, [F.col(d) for d in XYZ]), strict=True))
    return points.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in points.columns])


def by_indices(points: DataFrame, indices: DataFrame) -> DataFrame:
    return points.join(indices.select("pid"), "pid", "left_semi")


def in_radius_of(points: DataFrame, centre: Sequence[float], radius: float) -> DataFrame:
    """Points no farther than the radius from one position; a box predicate reaches the scan first."""
    boxed = points
    for d, c in zip(XYZ, centre, strict=True):
        boxed = boxed.where(F.col(d).between(c - radius, c + radius))
    return boxed.where(squared_distance([F.col(d) for d in XYZ], [F.lit(float(c)) for c in centre]) <= radius * radius)
