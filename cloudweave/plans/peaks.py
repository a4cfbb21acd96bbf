"""Queries of clustering by density peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudweave.operators import density_peaks
from cloudweave.plans.cleaning import D3, R2, RADIUS
from cloudweave.plans.clustering import _REACH
from cloudweave.plans.registry import query
from cloudweave.sources.views import CLOUD_SQL, cloud

DC, SHARE = 0.04, 0.05

_MEASURED = f"""e AS (SELECT a.pid AS i, b.pid AS j, {D3} AS d2 FROM pc a, pc b WHERE a.pid <> b.pid AND {D3} <= {R2}),
rho AS (SELECT pc.pid, round(coalesce(sum(CASE WHEN e.d2 < {DC}::DOUBLE * {DC}::DOUBLE THEN exp(-e.d2 / ({DC}::DOUBLE * {DC}::DOUBLE)) END), 0), 9) AS rho FROM pc LEFT JOIN e ON e.i = pc.pid GROUP BY pc.pid),
n AS (SELECT e.i, e.j, e.d2, b.rho >= a.rho AS up FROM e JOIN rho a ON a.pid = e.i JOIN rho b ON b.pid = e.j),
u AS (SELECT i, j, d2 FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS k FROM n WHERE up) WHERE k = 1),
f AS (SELECT i, j, d2 FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2 DESC, j) AS k FROM n) WHERE k = 1),
m AS (SELECT rho.pid, rho.rho, CASE WHEN u.i IS NOT NULL THEN sqrt(u.d2) WHEN f.i IS NOT NULL THEN sqrt(f.d2) ELSE 0 END AS delta, coalesce(u.j, f.j, -1) AS parent, u.i IS NULL AS peak
 FROM rho LEFT JOIN u ON u.i = rho.pid LEFT JOIN f ON f.i = rho.pid)"""


@query("distance_to_higher_density", f"WITH {CLOUD_SQL}, {_MEASURED} SELECT pid, round(rho, 6) AS rho, round(delta, 6) AS delta, parent::BIGINT AS parent, peak FROM m")
def _(spark, sf):
    _, found = density_peaks.measured(cloud(spark, sf), RADIUS, DC)
    return found.select("pid", F.round("rho", 6).alias("rho"), F.round("delta", 6).alias("delta"), F.col("parent").cast("long").alias("parent"), "peak")


@query("density_peaks", f"""WITH RECURSIVE {CLOUD_SQL}, {_MEASURED},
g AS (SELECT *, row_number() OVER (ORDER BY round(rho * delta, 9) DESC, pid) AS k FROM m), c AS (SELECT pid, row_number() OVER (ORDER BY k) AS cluster FROM g WHERE k <= floor((SELECT count(*) FROM pc) * {SHARE}) AND (peak OR delta > {DC})),
l AS (SELECT m.pid, CASE WHEN c.pid IS NULL AND NOT m.peak AND m.delta < {DC} AND (pc2.pid IS NOT NULL OR p.rho > m.rho OR (p.rho = m.rho AND p.pid < m.pid)) THEN m.parent END AS up
 FROM m LEFT JOIN c ON c.pid = m.pid LEFT JOIN m p ON p.pid = m.parent LEFT JOIN c pc2 ON pc2.pid = m.parent),
w AS (SELECT pid, pid AS at FROM m UNION ALL SELECT w.pid, l.up FROM w JOIN l ON l.pid = w.at WHERE l.up IS NOT NULL)
SELECT w.pid, coalesce(max(c.cluster), 0)::BIGINT AS cluster FROM w LEFT JOIN c ON c.pid = w.at GROUP BY w.pid""")
def _(spark, sf):
    return density_peaks.density_peaks(cloud(spark, sf), RADIUS, DC, SHARE)


#: Components of cores in order of their first centre; a centre beside none that started before it takes a number of its own.
_REACHED = f"""gm AS (SELECT *, row_number() OVER (ORDER BY round(rho * delta, 9) DESC, pid) AS k FROM m), h AS (SELECT pid, row_number() OVER (ORDER BY k) AS rank FROM gm WHERE k <= floor((SELECT count(*) FROM pc) * {SHARE}) AND (peak OR delta > {DC})),
nr AS (SELECT i, j FROM e WHERE d2 <= {DC}::DOUBLE * {DC}::DOUBLE), v AS (SELECT i AS pid FROM nr GROUP BY i HAVING count(*) >= 3), g AS (SELECT i, j FROM nr WHERE i IN (SELECT pid FROM v) AND j IN (SELECT pid FROM v)), {_REACH},
st AS (SELECT comp.c, min(h.rank) AS rank FROM h JOIN comp ON comp.pid = h.pid GROUP BY comp.c),
bu AS (SELECT h.rank FROM h LEFT JOIN nr ON nr.i = h.pid LEFT JOIN comp ON comp.pid = nr.j LEFT JOIN st ON st.c = comp.c WHERE h.pid NOT IN (SELECT pid FROM v) GROUP BY h.rank HAVING coalesce(min(st.rank), h.rank) >= h.rank),
nu AS (SELECT rank, c, row_number() OVER (ORDER BY rank) AS cluster FROM (SELECT rank, c FROM st UNION ALL SELECT rank, NULL FROM bu)),
mem AS (SELECT comp.pid, coalesce(nu.cluster, 0) AS cluster FROM comp LEFT JOIN nu ON nu.c = comp.c), sta AS (SELECT h.pid, nu.cluster FROM nu JOIN h ON h.rank = nu.rank WHERE nu.c IS NOT NULL),
bo AS (SELECT nr.i, max(sta.cluster) AS s, min(CASE WHEN mem.cluster > 0 THEN mem.cluster END) AS k FROM nr JOIN mem ON mem.pid = nr.j LEFT JOIN sta ON sta.pid = nr.j GROUP BY nr.i),
reached AS (SELECT pc.pid, coalesce(mem.cluster, bo.s, bo.k, 0)::BIGINT AS cluster FROM pc LEFT JOIN mem ON mem.pid = pc.pid LEFT JOIN bo ON bo.i = pc.pid)"""


@query("density_peaks_modified", f"""WITH RECURSIVE {CLOUD_SQL}, {_MEASURED}, {_REACHED}, c AS (SELECT h.pid, reached.cluster FROM h JOIN reached ON reached.pid = h.pid),
l AS (SELECT m.pid, CASE WHEN c.pid IS NULL AND NOT m.peak AND (pc2.pid IS NOT NULL OR p.rho > m.rho OR (p.rho = m.rho AND p.pid < m.pid)) THEN m.parent END AS up
 FROM m LEFT JOIN c ON c.pid = m.pid LEFT JOIN m p ON p.pid = m.parent LEFT JOIN c pc2 ON pc2.pid = m.parent),
w AS (SELECT pid, pid AS at FROM m UNION ALL SELECT w.pid, l.up FROM w JOIN l ON l.pid = w.at WHERE l.up IS NOT NULL)
SELECT w.pid, coalesce(max(c.cluster), 0)::BIGINT AS cluster FROM w LEFT JOIN c ON c.pid = w.at GROUP BY w.pid""")
def _(spark, sf):
    return density_peaks.density_peaks_modified(cloud(spark, sf), RADIUS, DC, SHARE, 3)


@query("density_reachable", f"WITH RECURSIVE {CLOUD_SQL}, {_MEASURED}, {_REACHED} SELECT * FROM reached")
def _(spark, sf):
    pc = cloud(spark, sf)
    edges, found = density_peaks.measured(pc, RADIUS, DC)
    return density_peaks.density_reachable(pc, edges, density_peaks.centres(found, DC, SHARE), DC, 3)
