"""Clustering by density peaks.

Every point's density is the Gaussian sum over its neighbours below the cutoff; its parent is the closest neighbour that is at
least as dense. Points of large density times parent distance are centres; the others follow their parents. That
single descending pass becomes pointer jumping: links go only to centres or to points earlier in (density
descending, pid), so they have no cycles, and every round doubles the length of the jumps.

Densities are rounded to 9 digits: sums of doubles depend on the order of rows, and equal densities decide parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.operators.clustering import _with_borders, core_graph
from cloudweave.operators.density import local_gaussian
from cloudweave.operators.iteration import cut
from cloudweave.operators.neighbours import neighbours
from cloudweave.operators.ranking import ranked


def parents(points: DataFrame, edges: DataFrame, rho: DataFrame) -> DataFrame:
    """(pid, rho, delta, parent, peak) from neighbour pairs (i, j, d2) and densities (pid, rho).

    With a neighbour of equal or higher density: delta is the distance to the closest such, the parent. Else a peak: delta is the
    distance to the farthest neighbour, also its parent; without neighbours 0 and -1.
    """
    near = edges.join(rho.select(F.col("pid").alias("i"), F.col("rho").alias("ri")), "i").join(rho.select(F.col("pid").alias("j"), F.col("rho").alias("rj")), "j")
    found = near.groupBy("i").agg(
        F.min(F.when(F.col("rj") >= F.col("ri"), F.struct("d2", "j"))).alias("up"),
        F.min(F.struct((-F.col("d2")).alias("d2"), F.col("j"))).alias("far"),
    )
    out = rho.join(found, rho["pid"] == found["i"], "left")
    peak = F.col("up").isNull()
    delta = F.when(~peak, F.sqrt("up.d2")).when(F.col("far").isNotNull(), F.sqrt(-F.col("far.d2"))).otherwise(F.lit(0.0))
    parent = F.when(~peak, F.col("up.j")).when(F.col("far").isNotNull(), F.col("far.j")).otherwise(F.lit(-1))
    return out.select("pid", "rho", delta.alias("delta"), parent.alias("parent"), peak.alias("peak"))


def centres(found: DataFrame, dc: float, share: float) -> DataFrame:
    """(pid, rank) of the centres in order of gamma = rho * delta: of the top share of points those that are peaks or farther than dc from their parent."""
    n = int(found.count() * share)
    gamma = F.round(F.col("rho") * F.col("delta"), 9)
    top = ranked(found.select("pid", "peak", "delta", gamma.alias("gamma")), [F.desc("gamma"), F.col("pid")], "place").where(F.col("place") <= n)
    return ranked(top.where(F.col("peak") | (F.col("delta") > dc)).select("pid", "place"), [F.col("place")], "rank").select("pid", "rank")


def _follow(found: DataFrame, labelled: DataFrame, only_below: float | None) -> DataFrame:
    """(pid, cluster): labels of centres (pid, cluster) handed down the parent links; 0 without one."""
    marked = found.join(labelled, "pid", "left").withColumn("centre", F.col("cluster").isNotNull())
    up = marked.select(F.col("pid").alias("parent"), F.col("rho").alias("parent_rho"), F.col("centre").alias("parent_centre"))
    linked = marked.join(up, "parent", "left")
    earlier = (F.col("parent_rho") > F.col("rho")) | ((F.col("parent_rho") == F.col("rho")) & (F.col("parent") < F.col("pid")))
    follows = ~F.col("centre") & ~F.col("peak") & F.coalesce(F.col("parent_centre") | earlier, F.lit(False))
    if only_below is not None:
        follows = follows & (F.col("delta") < only_below)
    jumps = cut(linked.select("pid", F.when(follows, F.col("parent")).alias("to")))
    while True:
        open_ = jumps.where("to is not null")
        ahead = jumps.select(F.col("pid").alias("to"), F.col("to").alias("next"))
        jumped = cut(jumps.join(ahead, "to", "left").select("pid", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if open_.isEmpty() or not jumped.where("moved").count():
            break
        jumps = jumped.select("pid", "to")
    roots = jumps.select("pid", F.coalesce("to", "pid").alias("root"))
    return roots.join(labelled.select(F.col("pid").alias("root"), "cluster"), "root", "left").select("pid", F.coalesce("cluster", F.lit(0)).cast("long").alias("cluster"))


def measured(points: DataFrame, radius: float, dc: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, points with rho, delta, parent, peak)."""
    edges = cut(neighbours(points, radius))
    rho = cut(local_gaussian(points, dc).select("pid", F.round("density", 9).alias("rho")))
    return edges, cut(parents(points, edges, rho))


def density_peaks(points: DataFrame, radius: float, dc: float, share: float) -> DataFrame:
    """(pid, cluster): centres count from 1 in order of gamma; a point farther than dc from its parent stays 0."""
    _, found = measured(points, radius, dc)
    return _follow(found, centres(found, dc, share).select("pid", F.col("rank").alias("cluster")), dc)


def density_reachable(points: DataFrame, edges: DataFrame, heads: DataFrame, dc: float, min_points: int) -> DataFrame:
    """(pid, cluster) of all points by density expansion from the centres (pid, rank) only.

    A core centre of a component that no earlier centre started takes the next number. A centre that is no core burns a number
    unless it lies next to a component that started before it. A component starts at its first core centre, so numbers are ranks of the
    starts and burns together.
    """
    near = cut(edges.where(F.col("d2") <= dc * dc).select("i", "j"))
    _, parts = core_graph(points, near, min_points)
    parts = cut(parts)
    starts = cut(heads.join(parts, "pid").groupBy("component").agg(F.min(F.struct("rank", "pid")).alias("s")).select("component", "s.rank", F.col("s.pid").alias("start")))
    beside = near.join(parts.select(F.col("pid").alias("j"), "component"), "j").join(starts.select("component", F.col("rank").alias("began")), "component")
    first = beside.groupBy(F.col("i").alias("pid")).agg(F.min("began").alias("began"))
    loose = heads.join(parts, "pid", "left_anti").join(first, "pid", "left").where(F.col("began").isNull() | (F.col("began") > F.col("rank")))
    events = starts.select("rank", "component", "start").unionByName(loose.select("rank"), allowMissingColumns=True)
    table = cut(ranked(events, [F.col("rank")], "cluster").where("component is not null"))
    members = parts.join(table.select("component", "cluster"), "component", "left").select("pid", F.coalesce("cluster", F.lit(0)).alias("cluster"))
    return _with_borders(points, near, members, table.select(F.col("start").alias("pid"), "cluster"))


def density_peaks_modified(points: DataFrame, radius: float, dc: float, share: float, min_points: int) -> DataFrame:
    """(pid, cluster): as density_peaks, but reachable centres share a label and labels are handed down at any distance."""
    edges, found = measured(points, radius, dc)
    heads = cut(centres(found, dc, share))
    reached = density_reachable(points, edges, heads, dc, min_points)
    return _follow(found, heads.join(reached, "pid").select("pid", "cluster"), None)
