"""Queries of models, registration, CHAMELEON and graph segmentations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudweave.functions.geometry import XYZ
from cloudweave.operators import chameleon, cleaning, graphs, models, registration
from cloudweave.operators.iteration import cut
from cloudweave.operators.normals import normals_knn
from cloudweave.plans.cleaning import D2, D3, MATRIX, R2, RADIUS
from cloudweave.plans.registry import query
from cloudweave.sources.views import CLOUD_SQL, cloud

PLANES = [(0.0, 0.0, 1.0, 0.0), (0.0, 1.0, 0.0, 0.05), (0.6, 0.8, 0.0, -0.1)]
#: A small turn about z with a shift: what registration has to undo.
NUDGE = ((0.9998000066665778, -0.01999866669333308, 0.0, 0.004), (0.01999866669333308, 0.9998000066665778, 0.0, -0.003), (0.0, 0.0, 1.0, 0.002), (0.0, 0.0, 0.0, 1.0))


@query("plane_scores", f"""WITH {CLOUD_SQL}, h(h, a, b, c, d) AS (VALUES (0, 0.0, 0.0, 1.0, 0.0), (1, 0.0, 1.0, 0.0, 0.05), (2, 0.6, 0.8, 0.0, -0.1))
SELECT h, count(*) AS n FROM pc, h WHERE abs(x * a + y * b + z * c + d) <= 0.02 GROUP BY h""")
def _(spark, sf):
    return models.plane_scores(cloud(spark, sf), PLANES, 0.02)


def _fit(spark, sf, kind):
    coefficients, inliers = models.fit_model(cloud(spark, sf), kind, 0.03, 100)
    return inliers.select("pid", F.array(*[F.lit(round(c, 6)) for c in coefficients]).alias("coefficients"))


@query("plane_fit")
def _(spark, sf):
    return _fit(spark, sf, "plane")


@query("line_fit")
def _(spark, sf):
    return _fit(spark, sf, "line")


@query("j_linkage")
def _(spark, sf):
    return models.j_linkage(cloud(spark, sf), "plane", 0.01, 60)


def _nudged(spark, sf):
    pc = cloud(spark, sf).select("pid", *XYZ)
    return cleaning.rigid_transform(pc, NUDGE), pc


def _matrix(spark, found):
    return spark.createDataFrame([(k, *[round(float(v), 5) for v in found.matrix[k]], round(found.score, 6)) for k in range(4)], "row int, c0 double, c1 double, c2 double, c3 double, score double")


@query("icp")
def _(spark, sf):
    return _matrix(spark, registration.icp(*_nudged(spark, sf), 0.05, 15))


@query("icp_planes")
def _(spark, sf):
    source, target = _nudged(spark, sf)
    return _matrix(spark, registration.icp_planes(normals_knn(source, 10), normals_knn(target, 10), 0.05, 5, degrees=60.0))


_GIVEN = f"""{CLOUD_SQL}, s AS (SELECT pid, 0.9998000066665778 * x - 0.01999866669333308 * y + 0.004 AS x, 0.01999866669333308 * x + 0.9998000066665778 * y - 0.003 AS y, z + 0.002 AS z FROM pc),
p AS (SELECT a.pid AS i, b.pid AS j, {D3} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D3}, b.pid) AS k FROM s a, pc b WHERE {D3} <= 0.05::DOUBLE * 0.05::DOUBLE)"""


@query("registration_pairs", f"WITH {_GIVEN} SELECT i, j, round(sqrt(d2), 6) AS residual FROM p WHERE k = 1")
def _(spark, sf):
    source, target = _nudged(spark, sf)
    pairs = registration.correspondences(source, target, 0.05)
    return registration.residuals(source, target, pairs).withColumn("residual", F.round("residual", 6))


@query("registration_rms", f"WITH {_GIVEN} SELECT count(*) AS n, round(sqrt(avg(d2)), 6) AS rms FROM p WHERE k = 1")
def _(spark, sf):
    source, target = _nudged(spark, sf)
    return registration.rms(registration.residuals(source, target, registration.correspondences(source, target, 0.05))).withColumn("rms", F.round("rms", 6))


@query("register_scans")
def _(spark, sf):
    source, target = _nudged(spark, sf)
    found = registration.register_scans(source, target, 0.1, 10, 10, None, 0.1, (2, 1), (2, 2), 0.08, 3)
    return _matrix(spark, found)


@query("rectified_cloud", f"WITH {CLOUD_SQL} SELECT pid, round(-y + 1.5, 6) AS x, round(x - 2.0, 6) AS y, round(z + 0.25, 6) AS z FROM pc")
def _(spark, sf):
    return cleaning.rigid_transform(cloud(spark, sf), MATRIX).select("pid", *[F.round(d, 6).alias(d) for d in XYZ])


_KNN15 = f"k AS (SELECT a.pid AS i, b.pid AS j, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS r FROM pc a, pc b WHERE a.pid <> b.pid), g AS (SELECT least(i, j) AS i, greatest(i, j) AS j, (1.0 - sqrt(min(d2))) / 1.0 AS similarity FROM k WHERE r <= 15 GROUP BY 1, 2)"


@query("similarity_graph", f"WITH {CLOUD_SQL}, {_KNN15} SELECT i, j, round(similarity, 6) AS similarity FROM g")
def _(spark, sf):
    return chameleon.similarity_graph(cloud(spark, sf), 15, 1.0).withColumn("similarity", F.round("similarity", 6))


@query("group_closeness", f"""WITH {CLOUD_SQL}, {_KNN15} SELECT least(a.label, b.label)::VARCHAR AS g1, greatest(a.label, b.label)::VARCHAR AS g2, round(sum(similarity), 6) AS aic, round(avg(similarity), 6) AS ac
FROM g JOIN pc a ON a.pid = g.i JOIN pc b ON b.pid = g.j WHERE a.label <> b.label GROUP BY 1, 2""")
def _(spark, sf):
    pc = cloud(spark, sf)
    groups = pc.select("pid", F.col("label").cast("string").alias("path"))
    found = chameleon.closeness(chameleon.similarity_graph(pc, 15, 1.0), groups)
    return found.select("g1", "g2", F.round("aic", 6).alias("aic"), F.round("ac", 6).alias("ac"))


@query("chameleon_partition")
def _(spark, sf):
    pc = cloud(spark, sf)
    return chameleon.partition(pc, cut(chameleon.similarity_graph(pc, 15, 1.0)), 0.2)


@query("chameleon")
def _(spark, sf):
    return chameleon.chameleon(cloud(spark, sf), 5, 15, 1.0, 0.2)


@query("random_walker")
def _(spark, sf):
    pc = cloud(spark, sf)
    vertices, edges = graphs.graph_knn(pc.select("pid", *XYZ), 8)
    seeds = pc.where("pid in (3, 50, 120)").select(*XYZ, "label")
    clusters, _ = graphs.random_walker(vertices, graphs.weighted(vertices, edges), seeds, rounds=20)
    return clusters


@query("graph_radius", f"""WITH {CLOUD_SQL}, k AS (SELECT a.pid AS i, b.pid AS j, {D3} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D3}, b.pid) AS r FROM pc a, pc b WHERE a.pid <> b.pid AND {D3} <= {R2}),
g AS (SELECT least(i, j) AS src, greatest(i, j) AS dst, min(d2) AS d2 FROM k WHERE r <= 10 GROUP BY 1, 2) SELECT src, dst, round(exp(-d2 / (SELECT avg(d2) FROM g) / 3.0), 6) AS w FROM g""")
def _(spark, sf):
    vertices, edges = graphs.graph_radius(cloud(spark, sf).select("pid", *XYZ), RADIUS)
    return graphs.weighted(vertices, edges).withColumn("w", F.round("w", 6))


@query("graph_voxels", f"""WITH {CLOUD_SQL}, v AS (SELECT floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pc GROUP BY 1, 2, 3),
g AS (SELECT a.vx, a.vy, a.vz, b.vx AS wx, b.vy AS wy, b.vz AS wz, {D3} AS d2 FROM v a, v b WHERE (a.vx, a.vy, a.vz) < (b.vx, b.vy, b.vz) AND abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1)
SELECT vx, vy, vz, wx, wy, wz, round(exp(-d2 / (SELECT avg(d2) FROM g) / 3.0), 6) AS w FROM g""")
def _(spark, sf):
    vertices, edges = graphs.graph_voxels(cloud(spark, sf), 0.1)
    return graphs.weighted(vertices, edges).select("src.*", F.col("dst.vx").alias("wx"), F.col("dst.vy").alias("wy"), F.col("dst.vz").alias("wz"), F.round("w", 6).alias("w"))


@query("min_cut")
def _(spark, sf):
    return graphs.min_cut(cloud(spark, sf), (0.0, 0.0, 0.0), 0.05, 0.2)


@query("supervoxels")
def _(spark, sf):
    return graphs.supervoxels(cloud(spark, sf), 0.05, 0.2)
