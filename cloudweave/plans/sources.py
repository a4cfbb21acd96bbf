"""Queries of text formats and windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudweave.functions.geometry import XYZ
from cloudweave.operators import voxels
from cloudweave.plans.registry import query
from cloudweave.sources import text
from cloudweave.sources.views import CLOUD_SQL, LATTICE_SQL, cloud, lattice
from cloudweave.streaming.occupancy import scan_counts


@query("cluster_matrices", f"WITH {CLOUD_SQL} SELECT label + 1 AS cluster, 'cluster' || (label + 1) || ' = [' || string_agg(printf('%f %f', x, y), '; ' ORDER BY pid) || '];' AS value FROM pc GROUP BY 1, label")
def _(spark, sf):
    pc = cloud(spark, sf)
    return text.cluster_matrices(pc.select("pid", "x", "y"), pc.select("pid", (F.col("label") + 1).alias("cluster")), 10)


@query("residual_lines", f"WITH {CLOUD_SQL} SELECT 0::BIGINT AS n, printf('%d %.4f', count(*), sqrt(avg(x * x))) AS value FROM pc UNION ALL SELECT row_number() OVER (ORDER BY pid), printf('%.4f', abs(x)) FROM pc")
def _(spark, sf):
    found = cloud(spark, sf).select(F.col("pid").alias("i"), F.col("pid").alias("j"), F.abs("x").alias("residual"))
    return text.residual_lines(found)


@query("voxel_mesh", f"""WITH {LATTICE_SQL}, v AS (SELECT floor(x / 10.0)::BIGINT AS vx, floor(y / 5.0)::BIGINT AS vy, floor(z / 5.0)::BIGINT AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lat GROUP BY 1, 2, 3)
SELECT vx, vy, vz, k::INT AS corner, round(x + CASE WHEN k & 1 = 1 THEN 1.0 ELSE -1.0 END, 6) AS x, round(y + CASE WHEN k & 2 = 2 THEN 1.0 ELSE -1.0 END, 6) AS y, round(z + CASE WHEN k & 4 = 4 THEN 1.0 ELSE -1.0 END, 6) AS z FROM v, range(0, 8) r(k)""")
def _(spark, sf):
    mesh = text.voxel_mesh(voxels.voxel_centroids(lattice(spark, sf), (10.0, 5.0, 5.0)), 2.0)
    return mesh.select("vx", "vy", "vz", F.posexplode("corners").alias("corner", "c")).select("vx", "vy", "vz", "corner", *[F.round(f"c.{d}", 6).alias(d) for d in XYZ])


@query("event_windows", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def _(spark, sf):
    # The stream's plan over a finished table.
    return scan_counts(spark.read.parquet(f"{sf}/events.parquet")).withColumn("mean_value", F.round("mean_value", 6))
