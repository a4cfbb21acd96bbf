"""Segmentations on weighted graphs: random walks to seeds, minimum cuts and supervoxels."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudweave.functions.geometry import XYZ, dot
from cloudweave.operators.components import connected_components
from cloudweave.operators.flow import FlowNetwork
from cloudweave.operators.iteration import cut
from cloudweave.operators.neighbours import knn, nearest_vertex, neighbours
from cloudweave.operators.voxels import voxel_adjacency, voxel_centroids


def graph_voxels(points: DataFrame, resolution: float) -> tuple[DataFrame, DataFrame]:
    """(vertices pid, x, y, z; edges src, dst) of occupied voxels that touch. A vertex id is its voxel's indices."""
    vertices, edges = voxel_adjacency(points, (resolution,) * 3)
    return vertices.select(F.col("vid").alias("pid"), *XYZ), edges


def graph_knn(points: DataFrame, k: int = 15) -> tuple[DataFrame, DataFrame]:
    pairs = knn(points, points, k)
    return points, pairs.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).distinct()


def graph_radius(points: DataFrame, radius: float, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Edges to the closest ``most`` neighbours within the radius."""
    near = neighbours(points, radius).withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))).where(F.col("r") <= most)
    return points, near.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).distinct()


def weighted(vertices: DataFrame, edges: DataFrame, xyz: float | None = 3.0, normal: float | None = None, curvature: float | None = None, colour: float | None = None, concave_only: bool = False) -> DataFrame:
    """Edges with w = exp(-sum of terms): mean-scaled squared distance, normal angle, curvature product and colour distance, each over its influence.

    concave_only drops the normal term where the edge is convex.
    """
    rest = [c for c in vertices.columns if c != "pid"]
    both = edges.join(vertices.select(F.col("pid").alias("src"), *[F.col(c).alias("a_" + c) for c in rest]), "src").join(vertices.select(F.col("pid").alias("dst"), *[F.col(c).alias("b_" + c) for c in rest]), "dst")

    def gap(names: Sequence[str]) -> Column:
        d = [F.col("a_" + c) - F.col("b_" + c) for c in names]
        return dot(d, d)

    terms = [F.lit(0.0)]
    if xyz:
        scale = both.agg(F.avg(gap(XYZ)).alias("m"))
        both = both.join(F.broadcast(scale))
        terms.append(F.when(F.col("m") > 0, gap(XYZ) / F.when(F.col("m") > 0, F.col("m"))).otherwise(0.0) / xyz)
    if normal:
        angle = 1 - F.abs(dot([F.col("a_" + c) for c in ("nx", "ny", "nz")], [F.col("b_" + c) for c in ("nx", "ny", "nz")]))
        side = dot([F.col("b_" + c) - F.col("a_" + c) for c in XYZ], [F.col("a_" + c) for c in ("nx", "ny", "nz")])
        terms.append((F.when(side > 0, angle).otherwise(0.0) if concave_only else angle) / normal)
    if curvature:
        terms.append(F.abs(F.col("a_curvature") * F.col("b_curvature")) / curvature)
    if colour:
        terms.append(gap(("r", "g", "b")) / (255.0 * 255.0 * 3) / colour)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return both.select("src", "dst", F.exp(-total).alias("w"))


def random_walker(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = 200, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(clusters pid, cluster; potentials pid, label, p) from weighted edges and seeds (x, y, z, label).

    Seeds snap to their closest vertex. The potential of a label is the probability that a walk first meets a seed of it; each round replaces
    every free vertex's potentials by the weighted mean of its neighbours'. Clusters count from 1 by label; vertices no seed reaches form the last.
    """
    numbered = seeds.withColumn("pid", F.monotonically_increasing_id())
    numbered = cut(numbered)
    snapped = nearest_vertex(numbered.select("pid", *XYZ), vertices.select("pid", *XYZ)).join(numbered.select(F.col("pid").alias("i"), "label"), "i")
    fixed = cut(snapped.groupBy(F.col("j").alias("pid")).agg(F.min("label").alias("label")))
    both = cut(edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    degree = cut(both.groupBy("src").agg(F.sum("w").alias("total")).where("total > 0"))
    free = both.join(fixed, both["src"] == fixed["pid"], "left_anti").join(degree, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share"))
    free = cut(free)
    held = fixed.select("pid", "label", F.lit(1.0).alias("p"))
    now = cut(held)
    for n in range(1, rounds + 1):
        moved = free.join(now, free["dst"] == now["pid"]).groupBy(F.col("src").alias("pid"), "label").agg(F.sum(F.col("share") * F.col("p")).alias("p"))
        new = cut(held.unionByName(moved))
        if n % 10 == 0:
            change = new.withColumnRenamed("p", "q").join(now, ["pid", "label"], "full").agg(F.max(F.abs(F.coalesce("q", F.lit(0.0)) - F.coalesce("p", F.lit(0.0))))).first()[0]
            if change is None or change < tolerance:
                now = new
                break
        now = new
    best = now.groupBy("pid").agg(F.max(F.struct(F.round("p", 9).alias("p"), (-F.col("label")).alias("n"))).alias("b")).select("pid", (-F.col("b.n")).alias("label"))
    labels = fixed.select("label").distinct()
    ranks = labels.withColumn("cluster", F.row_number().over(Window.orderBy("label")).cast("long"))
    last = labels.count() + 1
    named = vertices.select("pid").join(best, "pid", "left").join(ranks, "label", "left").select("pid", F.coalesce("cluster", F.lit(last)).cast("long").alias("cluster"))
    return named, now


def min_cut(points: DataFrame, seed: Sequence[float] = (68.97, -18.55, 0.57), sigma: float = 0.25, radius: float = 3.0433856, k: int = 14, source_weight: float = 0.8) -> DataFrame:
    """(pid, foreground): the side of the point closest to ``seed`` in a minimum cut of the nearest-neighbour graph.

    Neighbours are tied by exp(-d^2 / sigma^2), every point to the foreground by source_weight and to the background by its horizontal distance from the seed
    over the radius. Each connected component is cut apart; only components with a point inside the radius can hold foreground.
    """
    pairs = cut(knn(points, points, k).groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("d2").alias("d2")))
    linked = connected_components(pairs, "i", "j")
    named = points.select("pid", *XYZ).join(linked, points["pid"] == linked["node"], "left").select("pid", *XYZ, F.coalesce("component", "pid").alias("part"))
    flat = F.sqrt((F.col("x") - float(seed[0])) ** 2 + (F.col("y") - float(seed[1])) ** 2)
    near = F.sqrt((F.col("x") - float(seed[0])) ** 2 + (F.col("y") - float(seed[1])) ** 2 + (F.col("z") - float(seed[2])) ** 2)
    start = named.agg(F.min(F.struct(near.alias("d"), "pid")).alias("m")).select(F.col("m.pid").alias("start"))
    unary = named.join(F.broadcast(start)).select("part", F.lit(0).alias("kind"), F.col("pid").alias("a"), F.col("pid").alias("b"), (flat / radius).alias("c"), (F.col("pid") == F.col("start")).alias("fixed"))
    inside = unary.where("c < 1 or fixed").select("part").distinct()
    ties = pairs.join(named.select(F.col("pid").alias("i"), "part"), "i").select("part", F.lit(1).alias("kind"), F.col("i").alias("a"), F.col("j").alias("b"), F.exp(-F.col("d2") / (sigma * sigma)).alias("c"), F.lit(False).alias("fixed"))
    kind = points.schema["pid"].dataType.simpleString()

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        u, e = p[p.kind == 0], p[p.kind == 1]
        place = {a: n for n, a in enumerate(u.a.tolist())}
        net = FlowNetwork(len(place) + 2)
        source, sink = len(place), len(place) + 1
        for a, c, fixed in zip(u.a.tolist(), u.c.tolist(), u.fixed.tolist(), strict=True):
            net.edge(source, place[a], 1e9 if fixed else source_weight)
            net.edge(place[a], sink, c)
        for a, b, c in zip(e.a.tolist(), e.b.tolist(), e.c.tolist(), strict=True):
            net.edge(place[a], place[b], c, c)
        net.run(source, sink)
        side = net.cut_side(source)
        return pd.DataFrame({"pid": list(place), "foreground": [side[n] for n in place.values()]})

    cutted = unary.unionByName(ties).join(inside, "part", "left_semi").groupBy("part").applyInPandas(solve, f"pid {kind}, foreground boolean")
    return points.select("pid").join(cutted, "pid", "left").select("pid", F.coalesce("foreground", F.lit(False)).alias("foreground"))


def supervoxels(points: DataFrame, voxel: float = 0.008, seed: float = 0.1, rounds: int = 5, spatial: float = 0.4) -> DataFrame:
    """(pid, label): voxels start in the seed cell they lie in and, in each round, take the closest centre among their own and their touching voxels' labels.

    Labels are numbered by (size descending, seed cell); points get the label of their voxel, not of a row position.
    """
    size = (voxel,) * 3
    vertices, edges = voxel_adjacency(points, size)
    v = cut(vertices.select("vid", *XYZ))
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")))
    start = F.struct(*[F.floor(F.col(d) / seed).cast("long").alias("s" + d) for d in XYZ])
    now = cut(v.select("vid", start.alias("s")))
    for _ in range(rounds):
        centres = v.join(now, "vid").groupBy("s").agg(*[F.round(F.avg(d), 9).alias("c" + d) for d in XYZ])
        near = both.join(now.select(F.col("vid").alias("dst"), "s"), "dst").select(F.col("src").alias("vid"), "s")
        choices = near.unionByName(now).distinct().join(v, "vid").join(centres, "s")
        gap = [F.col(d) - F.col("c" + d) for d in XYZ]
        ranked = choices.groupBy("vid").agg(F.min(F.struct(F.round(dot(gap, gap) * spatial / (seed * seed), 9).alias("d"), "s")).alias("m"))
        now = cut(ranked.select("vid", F.col("m.s").alias("s")))
    numbers = now.groupBy("s").agg(F.count("*").alias("n")).withColumn("label", F.row_number().over(Window.orderBy(F.desc("n"), "s")).cast("long"))
    named = now.join(numbers, "s").select("vid.*", "label")
    from cloudweave.operators.voxels import with_voxels

    return with_voxels(points.select("pid", *XYZ), size).join(named, ["vx", "vy", "vz"]).select("pid", "label")


def voxel_cloud(points: DataFrame, resolution: float) -> DataFrame:
    return voxel_centroids(points, (resolution,) * 3)
