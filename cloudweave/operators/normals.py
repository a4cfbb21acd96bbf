"""Normals, curvature and oriented boxes from neighbourhood moments.

Spark sums the ten moments of every neighbourhood; only these reach Python, where numpy solves all 3x3 eigenproblems of
an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from cloudweave.functions.geometry import XYZ, dot
from cloudweave.operators.neighbours import knn, neighbours, range_join
from cloudweave.operators.voxels import voxel_centroids

_PAIRS = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))


def moments(prefix: str = "") -> list[Column]:
    """Count, sums and sums of products of coordinates, as aggregates m_n, m_x.., m_xx.."""
    c = {d: F.col(prefix + d) for d in XYZ}
    return [F.count("*").alias("m_n"), *[F.sum(c[d]).alias(f"m_{d}") for d in XYZ], *[F.sum(c[a] * c[b]).alias(f"m_{a}{b}") for a, b in _PAIRS]]


MOMENTS = ["m_n", "m_x", "m_y", "m_z", *[f"m_{a}{b}" for a, b in _PAIRS]]


def covariances(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, covariance matrices) of rows of moments."""
    n = np.maximum(m[:, 0], 1)
    mean = m[:, 1:4] / n[:, None]
    raw = np.empty((len(m), 3, 3))
    for k, (a, b) in enumerate(_PAIRS):
        i, j = XYZ.index(a), XYZ.index(b)
        raw[:, i, j] = raw[:, j, i] = m[:, 4 + k] / n - mean[:, i] * mean[:, j]
    return mean, raw


PLANE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("nx", "ny", "nz", "curvature")])


@pandas_udf(PLANE)
def _plane(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for columns in parts:
        m = np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1)
        values, vectors = np.linalg.eigh(covariances(m)[1]) if len(m) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
        n = vectors[:, :, 0]
        # A direction has two signs: the largest component is made positive.
        lead = np.take_along_axis(n, np.abs(n).argmax(axis=1)[:, None], axis=1)
        n = n * np.where(lead < 0, -1.0, 1.0)
        total = np.maximum(values.sum(axis=1), 1e-300)
        yield pd.DataFrame({"nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "curvature": np.maximum(values[:, 0], 0) / total})


def _with_planes(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Normals of points from (i, j) pairs; a point belongs to its own neighbourhood. Offsets from the point keep sums small."""
    near = pairs.select("i", "j").join(points.select(F.col("pid").alias("j"), *[F.col(d).alias(f"j{d}") for d in XYZ]), "j")
    near = near.join(points.select(F.col("pid").alias("i"), *[F.col(d).alias(f"i{d}") for d in XYZ]), "i")
    near = near.select("i", *[(F.col(f"j{d}") - F.col(f"i{d}")).alias(d) for d in XYZ])
    summed = near.groupBy("i").agg(*moments())
    # The point itself adds a zero offset: one to the count.
    solved = summed.select("i", (F.col("m_n") + 1).alias("k"), _plane((F.col("m_n") + 1), *[F.col(c) for c in MOMENTS[1:]]).alias("p"))
    solved = solved.where("k >= 3").select(F.col("i").alias("pid"), "k", "p.*")
    return points.join(solved, "pid")


def normals_knn(points: DataFrame, k: int) -> DataFrame:
    """Points with k, nx, ny, nz, curvature from their k nearest points, themselves counted."""
    return _with_planes(points, knn(points, points, k - 1))


def normals_radius(points: DataFrame, radius: float) -> DataFrame:
    return _with_planes(points, neighbours(points, radius))


def signed_curvature(with_normals: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pid, signed_curvature): negative where the neighbours lie, on average, on the side that the normal points to."""
    a = with_normals.select(F.col("pid").alias("i"), *[F.col(c).alias(f"i_{c}") for c in (*XYZ, "nx", "ny", "nz", "curvature")])
    b = with_normals.select(F.col("pid").alias("j"), *[F.col(c).alias(f"j_{c}") for c in XYZ])
    offset = [F.col(f"j_{d}") - F.col(f"i_{d}") for d in XYZ]
    both = pairs.select("i", "j").join(a, "i").join(b, "j").withColumn("side", dot(offset, [F.col("i_nx"), F.col("i_ny"), F.col("i_nz")]))
    found = both.groupBy("i").agg(F.avg("side").alias("s"), F.min("i_curvature").alias("c"))
    return found.select(F.col("i").alias("pid"), F.when(F.col("s") > 0, -F.col("c")).otherwise(F.col("c")).alias("signed_curvature"))


def oriented_box(points: DataFrame, leaf: tuple[float, float, float]) -> dict[str, list]:
    """Centre, axes (rows) and least and largest coordinates along them of a box around the voxels of a cloud.

    Every voxel centroid counts with both corners one leaf away. Ten sums, then six, reach the driver.
    """
    centres = voxel_centroids(points, leaf)
    corners = centres.select(F.explode(F.array(*[F.struct(*[(F.col(d) + s * v).alias(d) for d, v in zip(XYZ, leaf, strict=True)]) for s in (-1, 1)])).alias("p")).select("p.*")
    m = np.array([[float(v or 0) for v in corners.agg(*moments()).first()]])
    mean, cov = covariances(m)
    _, vectors = np.linalg.eigh(cov[0])
    axes = vectors.T[::-1]
    along = [dot([F.col(d) - float(c) for d, c in zip(XYZ, mean[0], strict=True)], [F.lit(float(v)) for v in axis]) for axis in axes]
    ends = corners.agg(*[f(a).alias(f"{n}{k}") for k, a in enumerate(along) for n, f in (("low", F.min), ("high", F.max))]).first()
    return {"centre": mean[0].tolist(), "axes": axes.tolist(), "low": [ends[f"low{k}"] for k in range(3)], "high": [ends[f"high{k}"] for k in range(3)]}


def normals_within(points: DataFrame, reference: DataFrame, radius: float) -> DataFrame:
    """Normals of points from the reference points around them (which may be another cloud)."""
    pairs = range_join(points, reference, radius)
    near = pairs.join(reference.select(F.col("pid").alias("j"), *XYZ), "j")
    solved = near.groupBy("i").agg(*moments()).where("m_n >= 3").select(F.col("i").alias("pid"), _plane(*[F.col(c) for c in MOMENTS]).alias("p"))
    return solved.select("pid", "p.*")
