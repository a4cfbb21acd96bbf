"""Queries of labelling energies and assignments. Sites are the cloud's points, labels the ten classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudweave.operators import assignment, labelling
from cloudweave.operators.iteration import cut
from cloudweave.operators.neighbours import neighbours
from cloudweave.plans.cleaning import D3, R2, RADIUS
from cloudweave.plans.registry import query
from cloudweave.sources.views import CLOUD_SQL, cloud

LABELS = 6
_COST = "(abs(pid * 7 + l * 13) % 17 + CASE WHEN label % 6 + 1 = l THEN 0 ELSE 5 END)"
TABLES = f"""{CLOUD_SQL}, lab AS (SELECT l FROM range(1, {LABELS + 1}) r(l)), dc AS (SELECT pid + 1 AS site, l AS label, {_COST}::BIGINT AS cost FROM pc, lab),
nb AS (SELECT a.pid + 1 AS p, b.pid + 1 AS q, 2::BIGINT AS w FROM pc a, pc b WHERE a.pid < b.pid AND {D3} <= {R2}),
sm AS (SELECT a.l AS l1, b.l AS l2, least(abs(a.l - b.l), 3)::BIGINT AS cost FROM lab a, lab b), lc AS (SELECT l AS set_id, l AS label, (l * 4)::BIGINT AS cost FROM lab)"""


def problem(spark, sf, smooth=True):
    pc = cloud(spark, sf)
    rows = pc.withColumn("l", F.explode(F.sequence(F.lit(1), F.lit(LABELS))))
    data = rows.select((F.col("pid") + 1).cast("int").alias("site"), F.col("l").alias("label"), F.expr(_COST).cast("long").alias("cost"))
    p = labelling.Labelling(spark, pc.count(), LABELS)
    p.data_cost = data
    if smooth:
        p.neighbors = cut(neighbours(pc, RADIUS).where("i < j").select((F.col("i") + 1).cast("int").alias("p"), (F.col("j") + 1).cast("int").alias("q"), F.lit(2).cast("long").alias("w")))
        p.smooth = spark.createDataFrame([(a, b, min(abs(a - b), 3)) for a in range(1, LABELS + 1) for b in range(1, LABELS + 1)], "l1 int, l2 int, cost long")
    return p


def given(spark, sf):
    return cloud(spark, sf).select((F.col("pid") + 1).cast("int").alias("site"), (F.col("label") % LABELS + 1).cast("int").alias("label"))


@query("labelling_energy", f"""WITH {TABLES}, lb AS (SELECT pid + 1 AS site, label % {LABELS} + 1 AS label FROM pc),
d AS (SELECT sum(cost)::BIGINT AS v FROM lb JOIN dc USING (site, label)), s AS (SELECT sum(w * sm.cost)::BIGINT AS v FROM nb JOIN lb a ON a.site = p JOIN lb b ON b.site = q JOIN sm ON l1 = a.label AND l2 = b.label),
c AS (SELECT sum(cost)::BIGINT AS v FROM lc WHERE label IN (SELECT label FROM lb)) SELECT (d.v + s.v + c.v)::BIGINT AS energy, d.v AS data, s.v AS smooth, c.v AS label FROM d, s, c""")
def _(spark, sf):
    p = problem(spark, sf)
    p.set_label_cost([4 * k for k in range(1, LABELS + 1)])
    return p.energy(given(spark, sf))


@query("labelling_cheapest", f"WITH {TABLES} SELECT site::INT AS site, arg_min(label, cost * 100 + label)::INT AS label FROM dc GROUP BY site")
def _(spark, sf):
    return problem(spark, sf, smooth=False).expansion()


@query("labelling_expansion")
def _(spark, sf):
    return problem(spark, sf).expansion(given(spark, sf))


@query("labelling_expand_on_label")
def _(spark, sf):
    return problem(spark, sf).expansion(given(spark, sf), only=3)


@query("labelling_swap")
def _(spark, sf):
    return problem(spark, sf).expansion(given(spark, sf), swap=True)


@query("grid_neighbors", "SELECT p::INT AS p, q::INT AS q, 1 AS w FROM (SELECT i + 1 AS p, i + 2 AS q FROM range(0, 64 * 48) r(i) WHERE i % 64 < 63 UNION ALL SELECT i + 1, i + 65 FROM range(0, 64 * 48) r(i) WHERE i < 64 * 47)")
def _(spark, sf):
    return labelling.grid_neighbors(spark, 64, 48)


@query("segmentation_evaluation")
def _(spark, sf):
    pc = cloud(spark, sf)
    return assignment.evaluate_segmentation(pc.select(F.col("label"), ((F.col("label") * 3 + F.when(F.col("pid") % 5 == 0, 1).otherwise(0)) % 10).alias("truth")))
