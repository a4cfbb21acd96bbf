"""CHAMELEON: a nearest-neighbour graph is bisected into small groups, which are merged by closeness and interconnectivity.

Graph, bisections (all groups of a level in one job) and the tables of crossing edges are distributed; at most a hundred groups are
merged on the driver. Bisections are balanced cuts improved by single moves of best gain.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.operators.iteration import cut
from cloudweave.operators.neighbours import knn

MOST_GROUPS = 99


def similarity_graph(points: DataFrame, k: int = 15, scale: float = 860.0, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(i, j, similarity) with i < j: every pair of which one is among the other's k nearest, once."""
    pairs = knn(points, points, k, dims)
    kept = pairs.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("d2").alias("d2"))
    return kept.select("i", "j", ((F.lit(scale) - F.sqrt("d2")) / scale).alias("similarity"))


def bisect(nodes: list, edges: list[tuple], imbalance: float, rounds: int = 8) -> dict:
    """0 or 1 for each node: a two-way cut of small weight, no side above half plus ``imbalance`` percent.

    Starts from a breadth-first half and, in each round, moves every node once in order of gain, keeping the best prefix.
    """
    near: dict = {n: {} for n in nodes}
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    order, seen = [], set()
    for start in sorted(nodes):
        if start in seen:
            continue
        seen.add(start)
        queue = [start]
        for u in queue:
            order.append(u)
            for v in sorted(near[u]):
                if v not in seen:
                    seen.add(v)
                    queue.append(v)
    half = len(order) // 2
    side = {n: int(k >= half) for k, n in enumerate(order)}
    most = max(math.ceil(len(nodes) / 2), math.floor(len(nodes) * (50 + imbalance) / 100))
    for _ in range(rounds):
        import heapq

        now, size = dict(side), [sum(s == 0 for s in side.values()), sum(s == 1 for s in side.values())]
        gain = {n: sum(w if now[m] != now[n] else -w for m, w in near[n].items()) for n in nodes}
        heap = [(-g, n) for n, g in gain.items()]
        heapq.heapify(heap)
        locked, moves, total, best, best_at = set(), [], 0.0, 0.0, 0
        waiting: list = []
        while heap:
            g, n = heapq.heappop(heap)
            if n in locked or -g != gain[n]:
                continue
            to = 1 - now[n]
            if size[to] + 1 > most:
                waiting.append(n)
                continue
            locked.add(n)
            size[to] += 1
            size[1 - to] -= 1
            now[n] = to
            total += gain[n]
            moves.append(n)
            if total > best + 1e-12:
                best, best_at = total, len(moves)
            for m, w in near[n].items():
                if m not in locked:
                    gain[m] += 2 * w if now[m] != to else -2 * w
                    heapq.heappush(heap, (-gain[m], m))
            for m in waiting:
                heapq.heappush(heap, (-gain[m], m))
            waiting = []
        if best <= 1e-12:
            break
        for n in moves[:best_at]:
            side[n] = 1 - side[n]
    return side


def split_groups(groups: DataFrame, edges: DataFrame, imbalance: float) -> DataFrame:
    """(pid, path, half) of members (pid, path): one bisection for each path, over the edges inside it."""
    a, b = groups.select(F.col("pid").alias("i"), "path"), groups.select(F.col("pid").alias("j"), F.col("path").alias("p2"))
    inside = edges.join(a, "i").join(b, "j").where("path = p2").select("path", "i", "j", F.col("similarity").alias("w"))
    rows = groups.select("path", F.col("pid").alias("i"), F.col("pid").alias("j"), F.lit(-1.0).alias("w")).unionByName(inside)
    kind = groups.schema["pid"].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        nodes = p.loc[p.w < 0, "i"].tolist()
        e = p[p.w >= 0]
        # Weights as whole numbers, as a graph partitioner takes them.
        side = bisect(nodes, list(zip(e.i.tolist(), e.j.tolist(), (e.w * 860).astype(int).tolist(), strict=True)), imbalance)
        return pd.DataFrame({"pid": list(side), "path": p["path"].iloc[0], "half": list(side.values())}).astype({"half": "int32"})

    return rows.groupBy("path").applyInPandas(run, f"pid {kind}, path string, half int")


def partition(points: DataFrame, edges: DataFrame, share: float = 0.04) -> DataFrame:
    """(pid, path): groups no larger than the share of all points, as paths of bisections; at most MOST_GROUPS of them."""
    limit = int(points.count() * share)
    if limit < 1:
        raise ValueError("too few points for that share")
    groups = cut(points.select("pid", F.lit("r").alias("path")))
    while True:
        sizes = {r["path"]: r["n"] for r in groups.groupBy("path").agg(F.count("*").alias("n")).collect()}
        large = sorted((p for p, n in sizes.items() if n > limit), key=lambda p: (-sizes[p], p))[: max(0, MOST_GROUPS - len(sizes))]
        if not large:
            return groups
        split = split_groups(groups.where(F.col("path").isin(large)), edges, 25)
        done = split.select("pid", F.concat("path", F.col("half").cast("string")).alias("path"))
        groups = cut(groups.where(~F.col("path").isin(large)).unionByName(done))


def closeness(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(g1, g2, aic, ac) with g1 < g2: sum and mean of the similarities that cross two groups."""
    a, b = groups.select(F.col("pid").alias("i"), F.col("path").alias("a")), groups.select(F.col("pid").alias("j"), F.col("path").alias("b"))
    across = edges.join(a, "i").join(b, "j").where("a <> b")
    return across.groupBy(F.least("a", "b").alias("g1"), F.greatest("a", "b").alias("g2")).agg(F.sum("similarity").alias("aic"), F.avg("similarity").alias("ac"))


def goodness(aic: float, ac: float, inner: tuple[tuple[float, float], tuple[float, float]], sizes: tuple[int, int], power: float = 300.0) -> float:
    """log(RI) + power * log(RC) of merging two groups; a group that can't be bisected has no inner closeness and counts as 0."""
    (aic0, ac0), (aic1, ac1) = inner
    ri = 2 * aic / (aic0 + aic1) if aic0 + aic1 > 0 else 0.0
    weighted = sizes[0] * ac0 + sizes[1] * ac1
    rc = ac * (sizes[0] + sizes[1]) / weighted if weighted > 0 else 0.0
    if ri > 10_000 or rc > 10_000:
        raise ValueError("closeness out of range")
    return math.log(ri) + power * math.log(rc) if ri > 0 and rc > 0 else -math.inf


def merge(points: DataFrame, edges: DataFrame, groups: DataFrame, clusters: int) -> DataFrame:
    """(pid, cluster) after merging the best pair of groups until the wanted number is left or no pair is connected."""
    edges, groups = cut(edges), cut(groups)
    sizes = {r["path"]: r["n"] for r in groups.groupBy("path").agg(F.count("*").alias("n")).collect()}

    def inner_of(some: DataFrame) -> dict:
        halves = split_groups(some, edges, 6).select("pid", F.concat("path", F.lit("|"), F.col("half").cast("string")).alias("path"))
        rows = closeness(edges, halves).where(F.split("g1", r"\|")[0] == F.split("g2", r"\|")[0]).collect()
        return {r["g1"].split("|")[0]: (r["aic"], r["ac"]) for r in rows}

    inner = inner_of(groups)
    into = {p: p for p in sizes}
    while len(sizes) > clusters:
        named = groups.replace(into, subset="path")
        best = None
        for r in closeness(edges, named).collect():
            pair = (r["g1"], r["g2"])
            value = goodness(r["aic"], r["ac"], tuple(inner.get(p, (0.0, 0.0)) for p in pair), tuple(sizes[p] for p in pair))
            if value > -math.inf and (best is None or (value, pair) > best):
                best = (value, pair)
        if best is None:
            break
        keep, gone = best[1]
        into = {p: keep if q == gone else q for p, q in into.items()}
        sizes[keep] += sizes.pop(gone)
        inner.pop(gone, None)
        inner.update(inner_of(groups.replace(into, subset="path").where(F.col("path") == keep)))
    numbers = {p: n + 1 for n, p in enumerate(sorted(sizes, key=lambda p: (-sizes[p], p)))}
    table = points.sparkSession.createDataFrame([(p, numbers[q]) for p, q in into.items()], "path string, cluster long")
    return groups.join(F.broadcast(table), "path").select("pid", "cluster")


def chameleon(points: DataFrame, clusters: int, k: int = 15, scale: float = 860.0, share: float = 0.04, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    edges = cut(similarity_graph(points, k, scale, dims))
    return merge(points, edges, partition(points, edges, share), clusters)


def members(groups: DataFrame, path: str, wanted: DataFrame) -> DataFrame:
    """The wanted pids that belong to a group."""
    return wanted.join(groups.where(F.col("path") == path), "pid", "left_semi")
