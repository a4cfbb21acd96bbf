"""Rigid registration. Every iteration is one job that returns a few sums; the driver solves 3x3 or 6x6 systems."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.functions.geometry import XYZ, dot
from cloudweave.operators import cleaning
from cloudweave.operators.iteration import cut
from cloudweave.operators.neighbours import nearest_within
from cloudweave.operators.normals import normals_knn


@dataclass
class Registration:
    matrix: np.ndarray
    score: float
    iterations: int
    pairs: DataFrame | None = None


def correspondences(source: DataFrame, target: DataFrame, max_distance: float) -> DataFrame:
    """(i, j, d2): the closest target point of each source point within the distance."""
    return nearest_within(source, target, max_distance)


def _paired(source: DataFrame, target: DataFrame, pairs: DataFrame, normals: bool) -> DataFrame:
    columns = (*XYZ, "nx", "ny", "nz") if normals else XYZ
    a = source.select(F.col("pid").alias("i"), *[F.col(c).alias("s" + c) for c in columns])
    b = target.select(F.col("pid").alias("j"), *[F.col(c).alias("t" + c) for c in columns])
    return pairs.join(a, "i").join(b, "j")


def _moved(source: DataFrame, matrix: np.ndarray) -> DataFrame:
    out = cleaning.rigid_transform(source, matrix.tolist())
    if "nx" in source.columns:
        turned = [dot([F.lit(float(v)) for v in matrix[k, :3]], [F.col(c) for c in ("nx", "ny", "nz")]) for k in range(3)]
        out = out.withColumns(dict(zip(("nx", "ny", "nz"), turned, strict=True)))
    return out


def icp(source: DataFrame, target: DataFrame, max_distance: float, max_iterations: int = 50, epsilon: float = 1e-8, fitness_epsilon: float = 1e-12) -> Registration:
    """Point-to-point alignment of source to target; score is the mean squared distance of the pairs within the distance."""
    matrix, last, score = np.eye(4), np.inf, np.inf
    source, target = cut(source.select("pid", *XYZ)), cut(target.select("pid", *XYZ))
    done = 0
    for done in range(1, max_iterations + 1):
        at = _moved(source, matrix)
        both = _paired(at, target, correspondences(at, target, max_distance), False)
        sums = both.agg(F.count("*"), *[F.sum(a + d) for a in "st" for d in XYZ], *[F.sum(F.col("s" + a) * F.col("t" + b)) for a in XYZ for b in XYZ], F.avg("d2")).first()
        n = sums[0]
        if n < 3:
            break
        p, q = np.array(sums[1:4]) / n, np.array(sums[4:7]) / n
        u, _, vt = np.linalg.svd(np.array(sums[7:16]).reshape(3, 3) / n - np.outer(p, q))
        turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = turn, q - turn @ p
        matrix, score = step @ matrix, float(sums[16])
        if np.abs(step - np.eye(4)).max() ** 2 < epsilon or abs(last - score) < fitness_epsilon:
            break
        last = score
    at = _moved(source, matrix)
    pairs = correspondences(at, target, max_distance)
    mean = pairs.agg(F.avg("d2")).first()[0]
    return Registration(matrix, float(mean) if mean is not None else score, done, pairs)


#: The nonlinear variant has the same fixed points for rigid motions.
icp_nonlinear = icp


def _trimmed_ratio(distances: list[float]) -> float:
    """The share of closest pairs that minimises the mean squared distance over the share cubed, among shares of 0.05 to 0.95."""
    d = np.array(distances)
    if not len(d):
        return 1.0
    shares = np.arange(1, len(d) + 1) / len(d)
    value = np.cumsum(d) / np.arange(1, len(d) + 1) / shares**3
    usable = (shares >= 0.05) & (shares <= 0.95)
    return float(shares[np.where(usable, value, np.inf).argmin()]) if usable.any() else 1.0


def rejected(both: DataFrame, degrees: float, factor: float, quantiles: int = 200) -> DataFrame:
    """Pairs that survive three tests in turn: the angle of the normals, the median distance times a factor, and the trimmed share of smallest variance.

    The last looks at ``quantiles`` quantiles of the squared distances, not at all of them.
    """
    aligned = both.where(dot([F.col("snx"), F.col("sny"), F.col("snz")], [F.col("tnx"), F.col("tny"), F.col("tnz")]) >= float(np.cos(np.radians(degrees))))
    median = aligned.agg(F.percentile_approx("d2", 0.5, 10_000)).first()[0]
    if median is None:
        return aligned
    near = aligned.where(F.sqrt("d2") <= float(np.sqrt(median)) * factor)
    steps = [k / quantiles for k in range(1, quantiles + 1)]
    d = near.agg(F.percentile_approx("d2", steps, 10_000)).first()[0]
    if not d:
        return near
    most = d[max(0, int(round(_trimmed_ratio(d) * quantiles)) - 1)]
    return near.where(F.col("d2") <= float(most))


def icp_planes(source: DataFrame, target: DataFrame, max_distance: float, max_iterations: int = 100, epsilon: float = 1e-10, degrees: float = 15.0, factor: float = 1.3) -> Registration:
    """Point-to-plane alignment of clouds with normals, with rejection of unlikely pairs. The 6x6 system comes from 27 sums."""
    matrix, done, score = np.eye(4), 0, np.inf
    columns = ("pid", *XYZ, "nx", "ny", "nz")
    source, target = cut(source.select(*columns)), cut(target.select(*columns))
    for done in range(1, max_iterations + 1):
        at = cut(_moved(source, matrix))
        both = cut(rejected(_paired(at, target, correspondences(at, target, max_distance), True), degrees, factor))
        s, n = [F.col("s" + d) for d in XYZ], [F.col("tn" + d) for d in XYZ]
        row = [s[1] * n[2] - s[2] * n[1], s[2] * n[0] - s[0] * n[2], s[0] * n[1] - s[1] * n[0], *n]
        gap = dot([F.col("t" + d) - F.col("s" + d) for d in XYZ], n)
        sums = both.agg(F.count("*"), F.avg("d2"), *[F.sum(row[a] * row[b]) for a in range(6) for b in range(a, 6)], *[F.sum(r * gap) for r in row]).first()
        if sums[0] < 6:
            break
        left = np.zeros((6, 6))
        left[np.triu_indices(6)] = sums[2:23]
        left = left + left.T - np.diag(np.diag(left))
        x = np.linalg.lstsq(left, np.array(sums[23:29]), rcond=None)[0]
        step = np.eye(4)
        angle = np.linalg.norm(x[:3])
        if angle > 0:
            k = x[:3] / angle
            cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
            step[:3, :3] = np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
        step[:3, 3] = x[3:]
        matrix, score = step @ matrix, float(sums[1])
        if np.abs(step - np.eye(4)).max() ** 2 < epsilon:
            break
    at = cut(_moved(source, matrix))
    pairs = cut(rejected(_paired(at, target, correspondences(at, target, max_distance), True), degrees, factor).select("i", "j", "d2"))
    return Registration(matrix, score, done, pairs)


def residuals(source: DataFrame, target: DataFrame, pairs: DataFrame, matrix: np.ndarray | None = None) -> DataFrame:
    """(i, j, residual): distances of given pairs, after a transform of the source if one is given."""
    at = source if matrix is None else cleaning.rigid_transform(source, np.asarray(matrix).tolist())
    both = _paired(at, target, pairs.select("i", "j"), False)
    gap: list[Column] = [F.col("s" + d) - F.col("t" + d) for d in XYZ]
    return both.select("i", "j", F.sqrt(dot(gap, gap)).alias("residual"))


def rms(found: DataFrame) -> DataFrame:
    """One row (n, rms) of residuals."""
    return found.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"))


def register_scans(air: DataFrame, mobile: DataFrame, overlap: float = 3.0, air_k: int = 15, mobile_k: int = 100, ground_above: float | None = 62.0,
                   voxel: float = 1.0, air_voxel: tuple[int, int] = (5, 1), mobile_voxel: tuple[int, int] = (30, 3), max_distance: float = 1.0, max_iterations: int = 100) -> Registration:
    """The transform of the airborne scan to the mobile one: overlapping part, normals, facades and thinned ground of both, then icp_planes."""

    def prepared(points: DataFrame, k: int, above: float | None, at_least: int, samples: int) -> DataFrame:
        kinds = cut(cleaning.facade_or_ground(normals_knn(points.select("pid", *XYZ), k), ground_above=above))
        ground = kinds.where("surface = 'ground'")
        thin = cleaning.voxel_sample(ground, (voxel,) * 3, at_least, samples).select("pid").distinct()
        return kinds.where("surface = 'facade'").unionByName(ground.join(thin, "pid", "left_semi"))

    near = cut(cleaning.overlap(air, mobile, overlap))
    source = prepared(near, air_k, None, *air_voxel)
    target = prepared(mobile, mobile_k, ground_above, *mobile_voxel)
    return icp_planes(source, target, max_distance, max_iterations)


def register_and_apply(air: DataFrame, mobile: DataFrame, **options) -> tuple[DataFrame, Registration]:
    found = register_scans(air, mobile, **options)
    return cleaning.rigid_transform(air, found.matrix.tolist()), found
