"""Queries of cleaning, neighbourhoods, densities, voxels and normals."""

from __future__ import annotations


from pyspark.sql import functions as F

from cloudweave.functions import geometry
from cloudweave.operators import cleaning, density, neighbours, normals, voxels
from cloudweave.plans.registry import query
from cloudweave.sources.views import CLOUD_SQL, LATTICE_SQL, cloud, lattice

RADIUS = 0.06
LEAF = (0.1, 0.1, 0.1)
#: A quarter turn about z with a shift.
MATRIX = ((0.0, -1.0, 0.0, 1.5), (1.0, 0.0, 0.0, -2.0), (0.0, 0.0, 1.0, 0.25), (0.0, 0.0, 0.0, 1.0))

D3 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
R2 = f"{RADIUS}::DOUBLE * {RADIUS}::DOUBLE"


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _reference(spark, sf):
    """Half of the cloud, to stand for a second scan."""
    return cloud(spark, sf).where("label < 5")


@query("remove_duplicates", f"WITH {LATTICE_SQL} SELECT x, y, z, count(*) AS n FROM lat GROUP BY x, y, z")
def _(spark, sf):
    # The lattice has no key: a position's number of rows stands for what is removed.
    return lattice(spark, sf).groupBy("x", "y", "z").agg(F.count("*").alias("n"))


@query("remove_duplicates_cloud", f"""WITH {CLOUD_SQL}, twice AS (SELECT pid, x, y, z FROM pc UNION ALL SELECT pid + 1000000, x, y, z FROM pc)
SELECT min(pid) AS pid, x, y, z FROM twice GROUP BY x, y, z""")
def _(spark, sf):
    pc = cloud(spark, sf).select("pid", "x", "y", "z")
    return cleaning.remove_duplicates(pc.unionByName(pc.withColumn("pid", F.col("pid") + 1_000_000)))


@query("order_points", f"""WITH {CLOUD_SQL} SELECT pid, row_number() OVER (PARTITION BY floor(x / 0.1)::BIGINT ORDER BY x DESC, y DESC, z DESC, pid)::INT AS rank, floor(x / 0.1)::BIGINT AS band FROM pc""")
def _(spark, sf):
    from pyspark.sql import Window

    banded = cloud(spark, sf).withColumn("band", geometry.cell(F.col("x"), 0.1))
    order = Window.partitionBy("band").orderBy(F.desc("x"), F.desc("y"), F.desc("z"), "pid")
    return banded.select("pid", F.row_number().over(order).alias("rank"), "band")


@query("height_slices", f"""WITH {CLOUD_SQL}, t AS (SELECT max(z) AS top, min(z) AS low FROM pc),
s AS (SELECT pid, least(floor((top - z) / 0.05), greatest(ceil((top - low) / 0.05) - 1, 0))::BIGINT AS slice FROM pc, t)
SELECT pid, slice FROM s WHERE slice IN (SELECT slice FROM s GROUP BY slice HAVING count(*) > 10)""")
def _(spark, sf):
    return cleaning.height_slices(cloud(spark, sf), 0.05).select("pid", "slice")


@query("height_slice_sizes", f"""WITH {LATTICE_SQL}, t AS (SELECT max(z) AS top, min(z) AS low FROM lat),
s AS (SELECT least(floor((top - z) / 2.0), greatest(ceil((top - low) / 2.0) - 1, 0))::BIGINT AS slice FROM lat, t)
SELECT slice, count(*) AS n FROM s GROUP BY slice HAVING count(*) > 10""")
def _(spark, sf):
    return cleaning.height_slices(lattice(spark, sf), 2.0).groupBy("slice").agg(F.count("*").alias("n"))


@query("bounding_box", f"WITH {CLOUD_SQL} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pc")
def _(spark, sf):
    return cleaning.bounding_box(cloud(spark, sf))


@query("box_search", f"WITH {LATTICE_SQL} SELECT x, y, z, count(*) AS n FROM lat WHERE x BETWEEN 10 AND 20 AND y BETWEEN 2 AND 5 AND z BETWEEN 1 AND 6 GROUP BY x, y, z")
def _(spark, sf):
    return voxels.in_box(lattice(spark, sf), (10, 2, 1), (20, 5, 6)).groupBy("x", "y", "z").agg(F.count("*").alias("n"))


@query("overlap_clipping", f"""WITH {CLOUD_SQL}, r AS (SELECT * FROM pc WHERE label < 5), t AS (SELECT * FROM pc WHERE label >= 5)
SELECT a.pid FROM t a WHERE EXISTS (SELECT 1 FROM r b WHERE {D3} <= {R2})""")
def _(spark, sf):
    return cleaning.overlap(cloud(spark, sf).where("label >= 5"), _reference(spark, sf), RADIUS).select("pid")


@query("voxel_sample", f"""WITH {CLOUD_SQL}, v AS (
SELECT floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM pc GROUP BY 1, 2, 3),
p AS (SELECT a.vx, a.vy, a.vz, b.pid, {D3} AS d2 FROM v a, pc b WHERE {D3} <= 0.1::DOUBLE * 0.1::DOUBLE),
r AS (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY round(d2, 9), pid) AS rank, count(*) OVER (PARTITION BY vx, vy, vz) AS n FROM p)
SELECT vx, vy, vz, pid, rank::INT AS rank FROM r WHERE n >= 5 AND rank <= 3""")
def _(spark, sf):
    return cleaning.voxel_sample(cloud(spark, sf), LEAF, 5, 3)


@query("statistical_outliers", f"""WITH {CLOUD_SQL}, p AS (SELECT a.pid, sqrt({D3}) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {D3}, b.pid) AS r FROM pc a, pc b WHERE a.pid <> b.pid),
m AS (SELECT pid, avg(d) AS mean_distance FROM p WHERE r <= 8 GROUP BY pid), l AS (SELECT round(avg(mean_distance) + 1.0 * stddev_samp(mean_distance), 9) AS lim FROM m)
SELECT pid, round(mean_distance, 6) AS mean_distance FROM m, l WHERE mean_distance <= lim""")
def _(spark, sf):
    return _rounded(cleaning.statistical_outliers(cloud(spark, sf), 8, 1.0), "mean_distance")


@query("integer_offset", f"""WITH {CLOUD_SQL}, far AS (SELECT pid, x + 20000 AS x, y, z + 30000 AS z FROM pc),
f AS (SELECT arg_min(x, pid) AS x, arg_min(y, pid) AS y, arg_min(z, pid) AS z FROM far),
o AS (SELECT CASE WHEN abs(x) >= 10000 THEN round(x) ELSE 0 END AS ox, CASE WHEN abs(y) >= 10000 THEN round(y) ELSE 0 END AS oy, CASE WHEN abs(z) >= 10000 THEN round(z) ELSE 0 END AS oz FROM f)
SELECT pid, round(x - ox, 6) AS x, round(y - oy, 6) AS y, round(z - oz, 6) AS z FROM far, o""")
def _(spark, sf):
    far = cloud(spark, sf).select("pid", (F.col("x") + 20000).alias("x"), "y", (F.col("z") + 30000).alias("z"))
    return _rounded(cleaning.shifted(far, cleaning.integer_offset(far)), "x", "y", "z")


@query("project_to_plane", f"WITH {CLOUD_SQL} SELECT pid, x::FLOAT AS x, y::FLOAT AS y FROM pc")
def _(spark, sf):
    return cleaning.projected(cloud(spark, sf), 2)


@query("merge_overlap", f"""WITH {CLOUD_SQL}, r AS (SELECT * FROM pc WHERE label < 5), t AS (SELECT * FROM pc WHERE label >= 5)
SELECT pid, x, y, z, 'reference' AS origin FROM r UNION ALL SELECT a.pid, a.x, a.y, a.z, 'target' FROM t a WHERE EXISTS (SELECT 1 FROM r b WHERE {D3} <= {R2})""")
def _(spark, sf):
    return cleaning.merge_overlap(cloud(spark, sf).where("label >= 5"), _reference(spark, sf), RADIUS)


@query("rigid_transform", f"WITH {CLOUD_SQL} SELECT pid, round(-y + 1.5, 6) AS x, round(x - 2.0, 6) AS y, round(z + 0.25, 6) AS z, label FROM pc")
def _(spark, sf):
    return _rounded(cleaning.rigid_transform(cloud(spark, sf), MATRIX), "x", "y", "z")


@query("copy_by_indices", f"WITH {CLOUD_SQL} SELECT * FROM pc WHERE pid % 3 = 0")
def _(spark, sf):
    pc = cloud(spark, sf)
    return cleaning.by_indices(pc, pc.where("pid % 3 = 0"))


@query("range_join_3d", f"WITH {CLOUD_SQL} SELECT a.pid AS i, b.pid AS j, round({D3}, 9) AS d2 FROM pc a, pc b WHERE a.pid <> b.pid AND {D3} <= {R2}")
def _(spark, sf):
    return _rounded(neighbours.neighbours(cloud(spark, sf), RADIUS), "d2", digits=9)


@query("range_join_2d", f"WITH {CLOUD_SQL} SELECT a.pid AS i, b.pid AS j, round({D2}, 9) AS d2 FROM pc a, pc b WHERE a.pid <> b.pid AND {D2} <= 0.03::DOUBLE * 0.03::DOUBLE")
def _(spark, sf):
    return _rounded(neighbours.neighbours(cloud(spark, sf), 0.03, geometry.XY), "d2", digits=9)


@query("epsilon_neighbours_metric", f"WITH {CLOUD_SQL} SELECT a.pid AS i, b.pid AS j, round(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z), 9) AS d FROM pc a, pc b WHERE a.pid <> b.pid AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 0.08")
def _(spark, sf):
    metric = F.abs(F.col("_i0") - F.col("_j0")) + F.abs(F.col("_i1") - F.col("_j1")) + F.abs(F.col("_i2") - F.col("_j2"))
    return _rounded(neighbours.neighbours_by(cloud(spark, sf), 0.08, metric), "d", digits=9)


@query("knn", f"""WITH {CLOUD_SQL}, p AS (SELECT a.pid AS i, b.pid AS j, {D3} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D3}, b.pid) AS rank FROM pc a, pc b WHERE a.pid <> b.pid)
SELECT i, j, round(d2, 9) AS d2, rank::INT AS rank FROM p WHERE rank <= 15""")
def _(spark, sf):
    pc = cloud(spark, sf)
    return _rounded(neighbours.knn(pc, pc, 15), "d2", digits=9)


@query("nearest_within", f"""WITH {CLOUD_SQL}, r AS (SELECT * FROM pc WHERE label < 5), t AS (SELECT * FROM pc WHERE label >= 5),
p AS (SELECT a.pid AS i, b.pid AS j, {D3} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D3}, b.pid) AS k FROM t a, r b WHERE {D3} <= {R2})
SELECT i, j, round(d2, 9) AS d2 FROM p WHERE k = 1""")
def _(spark, sf):
    return _rounded(neighbours.nearest_within(cloud(spark, sf).where("label >= 5"), _reference(spark, sf), RADIUS), "d2", digits=9)


@query("nearest_vertex", f"""WITH {CLOUD_SQL}, r AS (SELECT * FROM pc WHERE label < 5), t AS (SELECT * FROM pc WHERE label >= 5),
p AS (SELECT a.pid AS i, b.pid AS j, {D3} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D3}, b.pid) AS k FROM t a, r b)
SELECT i, j, round(d2, 9) AS d2 FROM p WHERE k = 1""")
def _(spark, sf):
    return _rounded(neighbours.nearest_vertex(cloud(spark, sf).where("label >= 5"), _reference(spark, sf)), "d2", digits=9)


@query("voxel_centroids", f"""WITH {CLOUD_SQL} SELECT floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz,
round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM pc GROUP BY 1, 2, 3""")
def _(spark, sf):
    return _rounded(voxels.voxel_centroids(cloud(spark, sf), LEAF), "x", "y", "z")


@query("voxel_centroids_lattice", f"""WITH {LATTICE_SQL} SELECT floor(x / 5.0)::BIGINT AS vx, floor(y / 2.0)::BIGINT AS vy, floor(z / 2.0)::BIGINT AS vz,
round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM lat GROUP BY 1, 2, 3""")
def _(spark, sf):
    return _rounded(voxels.voxel_centroids(lattice(spark, sf), (5.0, 2.0, 2.0)), "x", "y", "z")


@query("point_to_voxel", f"WITH {CLOUD_SQL} SELECT pid, floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz FROM pc")
def _(spark, sf):
    return voxels.with_voxels(cloud(spark, sf), LEAF).select("pid", "vx", "vy", "vz")


@query("projection_density_ratio", f"""WITH {CLOUD_SQL} SELECT a.pid, round(coalesce(CASE WHEN sum(sqrt({D2})) > 0 THEN (count(b.pid) + 1) / sum(sqrt({D2})) END, 0), 6) AS density
FROM pc a LEFT JOIN pc b ON a.pid <> b.pid AND {D2} <= 0.03::DOUBLE * 0.03::DOUBLE GROUP BY a.pid""")
def _(spark, sf):
    return _rounded(density.projection_ratio(cloud(spark, sf), 0.03), "density")


@query("projection_density_count", f"WITH {CLOUD_SQL} SELECT a.pid, count(b.pid) AS density FROM pc a LEFT JOIN pc b ON a.pid <> b.pid AND {D2} <= 0.03::DOUBLE * 0.03::DOUBLE GROUP BY a.pid")
def _(spark, sf):
    return density.projection_count(cloud(spark, sf), 0.03)


@query("projection_density_gaussian", f"""WITH {CLOUD_SQL} SELECT a.pid, round(coalesce(sum(exp(-({D2}) / (0.03::DOUBLE * 0.03::DOUBLE))), 0), 6) AS density
FROM pc a LEFT JOIN pc b ON a.pid <> b.pid AND {D2} <= 0.03::DOUBLE * 0.03::DOUBLE GROUP BY a.pid""")
def _(spark, sf):
    return _rounded(density.projection_gaussian(cloud(spark, sf), 0.03), "density")


@query("density_raster", f"""WITH {CLOUD_SQL}, t AS (SELECT min(x) - 0.05 / 2 AS x0, max(y) + 0.04 / 2 AS y1, ceil((max(y) - min(y) + 0.04) / 0.04)::INT AS rows, ceil((max(x) - min(x) + 0.05) / 0.05)::INT AS cols FROM pc),
a AS (SELECT r.i::INT AS row, c.i::INT AS col, x0 + c.i * 0.05 AS x, y1 - r.i * 0.04 AS y FROM t, range(0, 1000) r(i), range(0, 1000) c(i) WHERE r.i < rows AND c.i < cols)
SELECT a.row, a.col, round(a.x, 6) AS x, round(a.y, 6) AS y, round(coalesce(sum(exp(-({D2}) / (0.025::DOUBLE * 0.025::DOUBLE))), 0), 6) AS density
FROM a LEFT JOIN pc b ON {D2} <= 0.025::DOUBLE * 0.025::DOUBLE GROUP BY ALL""")
def _(spark, sf):
    return _rounded(density.density_raster(cloud(spark, sf), 0.05, 0.04), "x", "y", "density")


@query("local_density_count", f"WITH {CLOUD_SQL} SELECT a.pid, count(b.pid) AS density FROM pc a LEFT JOIN pc b ON a.pid <> b.pid AND {D3} < {R2} GROUP BY a.pid")
def _(spark, sf):
    return density.local_count(cloud(spark, sf), RADIUS)


@query("local_density_gaussian", f"WITH {CLOUD_SQL} SELECT a.pid, round(coalesce(sum(exp(-({D3}) / ({R2}))), 0), 6) AS density FROM pc a LEFT JOIN pc b ON a.pid <> b.pid AND {D3} < {R2} GROUP BY a.pid")
def _(spark, sf):
    return _rounded(density.local_gaussian(cloud(spark, sf), RADIUS), "density")


@query("mean_knn_distance", f"""WITH {CLOUD_SQL}, p AS (SELECT a.pid, sqrt({D3}) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {D3}, b.pid) AS r FROM pc a, pc b WHERE a.pid <> b.pid)
SELECT pid, round(avg(d), 6) AS density FROM p WHERE r <= (SELECT floor(count(*) * 0.015) - 1 FROM pc) GROUP BY pid""")
def _(spark, sf):
    return _rounded(density.mean_knn_distance(cloud(spark, sf)), "density")


@query("cutoff_distance", f"""WITH {CLOUD_SQL}, p AS (SELECT sqrt({D3}) AS d FROM pc a, pc b WHERE a.pid < b.pid AND {D3} <= 0.1::DOUBLE * 0.1::DOUBLE),
r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM p) SELECT round(d, 9) AS dc FROM r WHERE k = floor(n * 0.02 + 0.5)""")
def _(spark, sf):
    return _rounded(density.cutoff_distance(cloud(spark, sf), 0.1), "dc", digits=9)


@query("normals_knn_size", f"WITH {CLOUD_SQL} SELECT pid, 15::BIGINT AS k, 1.0::DOUBLE AS length FROM pc")
def _(spark, sf):
    n = normals.normals_knn(cloud(spark, sf), 15)
    return n.select("pid", "k", F.round(geometry.dot([F.col(c) for c in ("nx", "ny", "nz")], [F.col(c) for c in ("nx", "ny", "nz")]), 6).alias("length"))


# Curvature is the smallest eigenvalue over the trace: a closed form of the symmetric 3x3 eigenproblem checks it in SQL.
@query("normals_radius", f"""WITH {CLOUD_SQL}, m AS (SELECT a.pid, count(*) AS k,
 avg(b.x - a.x) AS mx, avg(b.y - a.y) AS my, avg(b.z - a.z) AS mz, avg((b.x - a.x) ** 2) AS xx, avg((b.y - a.y) ** 2) AS yy, avg((b.z - a.z) ** 2) AS zz,
 avg((b.x - a.x) * (b.y - a.y)) AS xy, avg((b.x - a.x) * (b.z - a.z)) AS xz, avg((b.y - a.y) * (b.z - a.z)) AS yz
 FROM pc a, pc b WHERE {D3} <= 0.1::DOUBLE * 0.1::DOUBLE GROUP BY a.pid HAVING count(*) >= 4),
c AS (SELECT pid, k, xx - mx * mx AS a, yy - my * my AS b, zz - mz * mz AS c, xy - mx * my AS d, xz - mx * mz AS e, yz - my * mz AS f FROM m),
q AS (SELECT *, (a + b + c) / 3 AS q, d * d + e * e + f * f AS p1 FROM c),
p AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * p1) / 6) AS p FROM q),
r AS (SELECT *, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p) AS r FROM p)
SELECT pid, k, round((q + 2 * p * cos(acos(least(greatest(r, -1), 1)) / 3 + 2 * pi() / 3)) / (a + b + c), 5) AS curvature FROM r""")
def _(spark, sf):
    n = normals.normals_radius(cloud(spark, sf), 0.1).where("k >= 4")
    return n.select("pid", "k", F.round("curvature", 5).alias("curvature"))


#: Moments, least eigenvalue and adjugate of (covariance - eigenvalue) of the 14 nearest points and the point itself: the adjugate is a
#: multiple of the outer product of the normal with itself, whose sign doesn't matter.
NORMALS15 = f"""nb AS (SELECT a.pid, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z, row_number() OVER (PARTITION BY a.pid ORDER BY {D3}, b.pid) AS r FROM pc a, pc b WHERE a.pid <> b.pid),
nm AS (SELECT pid, sum(x) / 15 AS mx, sum(y) / 15 AS my, sum(z) / 15 AS mz, sum(x * x) / 15 AS xx, sum(y * y) / 15 AS yy, sum(z * z) / 15 AS zz, sum(x * y) / 15 AS xy, sum(x * z) / 15 AS xz, sum(y * z) / 15 AS yz FROM nb WHERE r <= 14 GROUP BY pid),
nc AS (SELECT pid, xx - mx * mx AS a, yy - my * my AS b, zz - mz * mz AS c, xy - mx * my AS d, xz - mx * mz AS e, yz - my * mz AS f FROM nm),
np AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM nc),
nr AS (SELECT *, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p) AS r FROM np),
nl AS (SELECT pid, a, b, c, d, e, f, q + 2 * p * cos(acos(least(greatest(r, -1), 1)) / 3 + 2 * pi() / 3) AS l FROM nr),
nt AS (SELECT pid, (b - l) * (c - l) - f * f AS p11, (a - l) * (c - l) - e * e AS p22, (a - l) * (b - l) - d * d AS p33, e * f - d * (c - l) AS p12, d * f - e * (b - l) AS p13, d * e - (a - l) * f AS p23 FROM nl),
nv AS (SELECT *, p11 + p22 + p33 AS tr FROM nt)"""


@query("facade_ground", f"""WITH {CLOUD_SQL}, {NORMALS15}, up AS (SELECT pid, sqrt(greatest(p33 / tr, 0)) AS up FROM nv)
SELECT pid, CASE WHEN up < cos(radians(85)) THEN 'facade' ELSE 'ground' END AS surface FROM up WHERE up < cos(radians(85)) OR up > cos(radians(15))""")
def _(spark, sf):
    return cleaning.facade_or_ground(normals.normals_knn(cloud(spark, sf), 15)).select("pid", "surface")


@query("signed_curvature")
def _(spark, sf):
    pc = cloud(spark, sf)
    n = normals.normals_radius(pc, 0.1)
    return _rounded(normals.signed_curvature(n, neighbours.neighbours(pc, 0.1)), "signed_curvature")


@query("oriented_box")
def _(spark, sf):
    box = normals.oriented_box(cloud(spark, sf), LEAF)
    rows = [(k, *[float(v) for v in box["axes"][k]], float(box["low"][k]), float(box["high"][k])) for k in range(3)]
    return spark.createDataFrame(rows, "axis int, ax double, ay double, az double, low double, high double")


@query("remove_close_duplicates")
def _(spark, sf):
    pc = cloud(spark, sf).select("pid", "x", "y", "z")
    return cleaning.remove_close_duplicates(pc.unionByName(pc.withColumn("pid", F.col("pid") + 1_000_000).withColumn("x", F.col("x") + 1e-7)))


