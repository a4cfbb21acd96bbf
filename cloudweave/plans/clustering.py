"""Queries of clusterings and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudweave.operators import clustering
from cloudweave.operators.components import connected_components
from cloudweave.operators.neighbours import neighbours
from cloudweave.plans.cleaning import D3, LEAF, NORMALS15, R2, RADIUS
from cloudweave.plans.registry import query
from cloudweave.sources.views import CLOUD_SQL, LATTICE_SQL, cloud, lattice

_EDGES = f"e AS (SELECT a.pid AS i, b.pid AS j FROM pc a, pc b WHERE a.pid <> b.pid AND {D3} <= {R2})"
#: Components of an edge table g(i, j) over nodes v(pid): comp(pid, c), c the smallest pid reached.
_REACH = "reach AS (SELECT pid, pid AS c FROM v UNION SELECT g.j, r.c FROM reach r JOIN g ON g.i = r.pid), comp AS (SELECT pid, min(c) AS c FROM reach GROUP BY pid)"


@query("connected_components", f"WITH RECURSIVE {CLOUD_SQL}, {_EDGES}, v AS (SELECT pid FROM pc), g AS (SELECT * FROM e), {_REACH} SELECT pid AS node, c AS component FROM comp WHERE pid IN (SELECT i FROM e)")
def _(spark, sf):
    return connected_components(neighbours(cloud(spark, sf), RADIUS), "i", "j")


@query("dbscan", f"""WITH RECURSIVE {CLOUD_SQL}, {_EDGES}, v AS (SELECT i AS pid FROM e GROUP BY i HAVING count(*) >= 4), g AS (SELECT i, j FROM e WHERE i IN (SELECT pid FROM v) AND j IN (SELECT pid FROM v)), {_REACH},
h AS (SELECT c, row_number() OVER (ORDER BY c) AS cluster FROM (SELECT DISTINCT c FROM comp)), m AS (SELECT comp.pid, h.cluster, comp.c FROM comp JOIN h ON h.c = comp.c),
b AS (SELECT e.i, max(CASE WHEN m.pid = m.c THEN m.cluster END) AS s, min(m.cluster) AS k FROM e JOIN m ON m.pid = e.j GROUP BY e.i)
SELECT pc.pid, coalesce(m.cluster, b.s, b.k, 0)::BIGINT AS cluster FROM pc LEFT JOIN m ON m.pid = pc.pid LEFT JOIN b ON b.i = pc.pid""")
def _(spark, sf):
    return clustering.dbscan(cloud(spark, sf), RADIUS, 4)


@query("euclidean_clusters", f"""WITH RECURSIVE {CLOUD_SQL}, {_EDGES}, v AS (SELECT pid FROM pc), g AS (SELECT * FROM e), {_REACH},
h AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) AS cluster FROM comp GROUP BY c HAVING count(*) BETWEEN 2 AND 1000)
SELECT comp.pid, coalesce(h.cluster, 0)::BIGINT AS cluster FROM comp LEFT JOIN h ON h.c = comp.c""")
def _(spark, sf):
    return clustering.euclidean_clusters(cloud(spark, sf), RADIUS, 2, 1000)


def _with_intensity(spark, sf):
    return cloud(spark, sf).select("pid", "x", "y", "z", (F.col("label") * 2).cast("double").alias("intensity"))


@query("conditional_clusters", f"""WITH RECURSIVE {CLOUD_SQL}, n AS (SELECT pid, (label * 2)::DOUBLE AS intensity FROM pc), {_EDGES}, v AS (SELECT pid FROM pc),
g AS (SELECT e.i, e.j FROM e JOIN n a ON a.pid = e.i JOIN n b ON b.pid = e.j WHERE abs(a.intensity - b.intensity) < 5), {_REACH},
s AS (SELECT c, count(*) AS n FROM comp GROUP BY c), t AS (SELECT count(*) AS total FROM pc)
SELECT comp.pid, (CASE WHEN s.n < floor(total * 0.004) THEN -2 WHEN s.n > floor(total * 0.05) THEN 10 ELSE comp.c % 8 END)::BIGINT AS cluster FROM comp JOIN s ON s.c = comp.c, t""")
def _(spark, sf):
    return clustering.conditional_clusters(_with_intensity(spark, sf), RADIUS, clustering.similar_intensity(), 0.004, 0.05)


@query("voxel_components", f"""WITH RECURSIVE {CLOUD_SQL}, w AS (SELECT floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz, count(*) AS n FROM pc GROUP BY 1, 2, 3),
u AS (SELECT *, row_number() OVER (ORDER BY vx, vy, vz) AS pid FROM w), v AS (SELECT pid FROM u),
g AS (SELECT a.pid AS i, b.pid AS j FROM u a, u b WHERE a.pid <> b.pid AND abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1), {_REACH},
h AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) AS cluster FROM comp GROUP BY c)
SELECT u.vx, u.vy, u.vz, u.n, h.cluster::BIGINT AS cluster FROM u JOIN comp ON comp.pid = u.pid JOIN h ON h.c = comp.c""")
def _(spark, sf):
    return clustering.voxel_components(cloud(spark, sf), LEAF)


@query("voxel_components_lattice")
def _(spark, sf):
    return clustering.voxel_components(lattice(spark, sf), (1.0, 1.0, 1.0))


@query("voxel_graph_sizes", f"""WITH {CLOUD_SQL}, u AS (SELECT DISTINCT floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz FROM pc)
SELECT a.vx, a.vy, a.vz, count(b.vx) AS degree FROM u a JOIN u b ON (a.vx, a.vy, a.vz) <> (b.vx, b.vy, b.vz) AND abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1 GROUP BY ALL""")
def _(spark, sf):
    from cloudweave.operators.voxels import voxel_adjacency

    _, edges = voxel_adjacency(cloud(spark, sf), LEAF)
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return both.groupBy("src").agg(F.count("*").alias("degree")).select("src.vx", "src.vy", "src.vz", "degree")


@query("region_growing")
def _(spark, sf):
    from cloudweave.operators.normals import normals_knn

    pc = cloud(spark, sf)
    return clustering.region_growing(normals_knn(pc, 15), neighbours(pc, 0.08).drop("d2"), 0.35, 0.1)


def _by_normals(intensity: float, across: float) -> str:
    """Components of neighbours of similar intensity or normals at right angles, named as conditional_clusters names them."""
    product = "a.p11 * b.p11 + a.p22 * b.p22 + a.p33 * b.p33 + 2 * (a.p12 * b.p12 + a.p13 * b.p13 + a.p23 * b.p23)"
    return f"""WITH RECURSIVE {CLOUD_SQL}, {NORMALS15}, {_EDGES}, v AS (SELECT pid FROM pc),
g AS (SELECT e.i, e.j FROM e JOIN pc m ON m.pid = e.i JOIN pc n ON n.pid = e.j JOIN nv a ON a.pid = e.i JOIN nv b ON b.pid = e.j WHERE abs(m.label * 2 - n.label * 2) < {intensity} OR sqrt(greatest(({product}) / (a.tr * b.tr), 0)) < {across}), {_REACH},
s AS (SELECT c, count(*) AS n FROM comp GROUP BY c), t AS (SELECT count(*) AS total FROM pc)
SELECT comp.pid, (CASE WHEN s.n < floor(total * 0.001) THEN -2 WHEN s.n > floor(total * 0.2) THEN 10 ELSE comp.c % 8 END)::BIGINT AS cluster FROM comp JOIN s ON s.c = comp.c, t"""


@query("region_growing_rule", _by_normals(8, 0.06))
def _(spark, sf):
    from cloudweave.operators.normals import normals_knn

    pc = normals_knn(_with_intensity(spark, sf), 15)
    return clustering.conditional_clusters(pc, RADIUS, clustering.region_growing_rule())


@query("curvature_or_intensity", _by_normals(5, 0.05))
def _(spark, sf):
    from cloudweave.operators.normals import normals_knn

    pc = normals_knn(_with_intensity(spark, sf), 15)
    return clustering.conditional_clusters(pc, RADIUS, clustering.similar_curvature_or_intensity())
