"""Clusterings as connected components of filtered neighbour graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.functions.geometry import XYZ
from cloudweave.operators.components import connected_components
from cloudweave.operators.iteration import cut
from cloudweave.operators.neighbours import neighbours, neighbours_by
from cloudweave.operators.ranking import ranked
from cloudweave.operators.voxels import voxel_adjacency


def _numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Nodes with a cluster number counted from 1 in the given order. Every isolated point may be a cluster, so ranges are ranked apart."""
    return ranked(nodes, order, "cluster")


def core_graph(points: DataFrame, edges: DataFrame, min_points: int) -> tuple[DataFrame, DataFrame]:
    """(cores, core components): points with at least min_points neighbours, and (pid, component) of them."""
    cores = edges.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select(F.col("i").alias("pid"))
    cores = cut(cores)
    a, b = cores.select(F.col("pid").alias("i")), cores.select(F.col("pid").alias("j"))
    linked = connected_components(edges.join(a, "i", "left_semi").join(b, "j", "left_semi"), "i", "j")
    return cores, cores.join(linked, cores["pid"] == linked["node"], "left").select("pid", F.coalesce("component", "pid").alias("component"))


def _with_borders(points: DataFrame, edges: DataFrame, members: DataFrame, starts: DataFrame) -> DataFrame:
    """(pid, cluster) of all points from core members (pid, cluster) and cluster starts (pid, cluster).

    A border point goes to the largest cluster whose start is its neighbour, else to the smallest of its neighbours' clusters, else to 0.
    """
    near = edges.join(members.select(F.col("pid").alias("j"), F.col("cluster").alias("jc")), "j").join(starts.select(F.col("pid").alias("j"), F.col("cluster").alias("sc")), "j", "left")
    border = near.groupBy("i").agg(F.max("sc").alias("by_start"), F.min(F.when(F.col("jc") > 0, F.col("jc"))).alias("by_core"))
    out = points.select("pid").join(members, "pid", "left").join(border, points["pid"] == border["i"], "left")
    return out.select("pid", F.coalesce("cluster", "by_start", "by_core", F.lit(0)).cast("long").alias("cluster"))


def dbscan(points: DataFrame, radius: float, min_points: int, metric: Column | None = None) -> DataFrame:
    """(pid, cluster): 0 is noise, clusters count from 1 by their smallest core.

    The radius is inclusive and a point is not its own neighbour. ``metric``: a distance column over _i0.. and _j0...
    """
    edges = neighbours(points, radius) if metric is None else neighbours_by(points, radius, metric)
    edges = cut(edges.select("i", "j"))
    _, parts = core_graph(points, edges, min_points)
    parts = cut(parts)
    heads = _numbered(parts.select("component").distinct(), [F.col("component")])
    members = parts.join(heads, "component").select("pid", "cluster")
    return _with_borders(points, edges, members, heads.select(F.col("component").alias("pid"), "cluster"))


def euclidean_clusters(points: DataFrame, tolerance: float, least: int = 1, most: int | None = None) -> DataFrame:
    """(pid, cluster): components at the tolerance; 1 is the largest, ties by smallest pid; other sizes than [least, most] get 0."""
    return components_by(points, neighbours(points, tolerance), least, most)


def components_by(points: DataFrame, edges: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """As euclidean_clusters, over any edge table (i, j)."""
    linked = connected_components(edges, "i", "j")
    named = points.select("pid").join(linked, points["pid"] == linked["node"], "left").select("pid", F.coalesce("component", "pid").alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n").between(least, most if most is not None else 2**62))
    heads = _numbered(sizes, [F.desc("n"), F.col("component")])
    return named.join(heads, "component", "left").select("pid", F.coalesce("cluster", F.lit(0)).cast("long").alias("cluster"))


def similar_intensity(limit: float = 5.0) -> Column:
    return F.abs(F.col("i_intensity") - F.col("j_intensity")) < limit


def _across() -> Column:
    return F.abs(F.col("i_nx") * F.col("j_nx") + F.col("i_ny") * F.col("j_ny") + F.col("i_nz") * F.col("j_nz"))


def similar_curvature_or_intensity() -> Column:
    return similar_intensity(5.0) | (_across() < 0.05)


def region_growing_rule() -> Column:
    return F.when(F.col("d2") < 10_000, similar_intensity(8.0) | (_across() < 0.06)).otherwise(similar_intensity(3.0))


def attributed_edges(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with every other column of both ends, prefixed i_ and j_."""
    rest = [c for c in points.columns if c not in ("pid", *XYZ)]
    a = points.select(F.col("pid").alias("i"), *[F.col(c).alias(f"i_{c}") for c in rest])
    b = points.select(F.col("pid").alias("j"), *[F.col(c).alias(f"j_{c}") for c in rest])
    return edges.join(a, "i").join(b, "j")


def conditional_clusters(points: DataFrame, radius: float, rule: Column, least_share: float = 0.001, most_share: float = 0.2) -> DataFrame:
    """(pid, cluster): components of the neighbours that satisfy the rule.

    Components of fewer than n * least_share points get -2, of more than n * most_share 10, the others the smallest pid modulo 8.
    """
    edges = attributed_edges(points, neighbours(points, radius)).where(rule)
    linked = connected_components(edges, "i", "j")
    named = points.select("pid").join(linked, points["pid"] == linked["node"], "left").select("pid", F.coalesce("component", "pid").alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("n"))
    total = named.agg(F.count("*").alias("all"))
    label = F.when(F.col("n") < F.floor(F.col("all") * least_share), -2).when(F.col("n") > F.floor(F.col("all") * most_share), 10).otherwise(F.pmod(F.col("component"), F.lit(8)))
    labels = sizes.join(F.broadcast(total)).select("component", label.cast("long").alias("cluster"))
    return named.join(labels, "component").select("pid", "cluster")


def region_growing(points: DataFrame, edges: DataFrame, smoothness: float, curvature: float, least: int = 1, most: int | None = None) -> DataFrame:
    """(pid, cluster) of points with normals: a region passes from i to its neighbour j where the normals' angle is at most ``smoothness``
    (radians), and only points of curvature at most ``curvature`` pass it on. Seeds are taken by (curvature, pid).

    A region is the set of points that the smallest seed reaches: flat points form components; any other point joins the
    region of the flat neighbour that comes first.
    """
    import math

    aligned = attributed_edges(points, edges).where(_across() >= math.cos(smoothness))
    aligned = cut(aligned.select("i", "j", "i_curvature", "j_curvature"))
    flat = F.col("i_curvature") <= curvature
    cores = connected_components(aligned.where(flat & (F.col("j_curvature") <= curvature)), "i", "j")
    order = points.select("pid", "curvature")
    named = order.join(cores, order["pid"] == cores["node"], "left").select("pid", "curvature", F.when(F.col("curvature") <= curvature, F.coalesce("component", "pid")).alias("component"))
    first = named.where("component is not null").groupBy("component").agg(F.min(F.struct("curvature", "pid")).alias("seed"))
    given = named.join(first, "component", "left")
    rough = aligned.where(flat).select(F.col("i").alias("pid"), "j").join(given.select("pid", "seed", "component"), "pid").groupBy("j").agg(F.min(F.struct("seed", "component")).alias("m"))
    out = given.join(rough, given["pid"] == rough["j"], "left").select(given["pid"], F.coalesce(given["component"], F.col("m.component"), given["pid"]).alias("component"))
    sizes = out.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n").between(least, most if most is not None else 2**62))
    heads = _numbered(sizes, [F.desc("n"), F.col("component")])
    return out.join(heads, "component", "left").select("pid", F.coalesce("cluster", F.lit(0)).cast("long").alias("cluster"))


def voxel_components(points: DataFrame, size: tuple[float, float, float]) -> DataFrame:
    """(vx, vy, vz, n, cluster): components of touching voxels, 1 the one with most voxels, ties by smallest voxel."""
    vertices, edges = voxel_adjacency(points, size)
    vertices = cut(vertices)
    linked = connected_components(edges, "src", "dst")
    named = vertices.join(linked, vertices["vid"] == linked["node"], "left").select("vid", "vx", "vy", "vz", "n", F.coalesce("component", "vid").alias("component"))
    heads = by_vertex_count(named)
    return named.join(heads, "component").select("vx", "vy", "vz", "n", "cluster")


def by_vertex_count(vertices: DataFrame) -> DataFrame:
    """Components numbered from 1 by number of vertices, largest first."""
    return _numbered(vertices.groupBy("component").agg(F.count("*").alias("_n")), [F.desc("_n"), F.col("component")]).select("component", "cluster")
