"""Clusterings against sequential versions on random clouds with duplicates and ties."""

import numpy as np
import pytest

from cloudweave.operators import cleaning, clustering, components, density_peaks, neighbours

KIND = "pid long, x double, y double, z double"


def random_cloud(seed, n=60):
    rng = np.random.default_rng(seed)
    # A coarse lattice makes ties in distances and densities, and exact duplicates.
    p = rng.integers(0, 6, size=(n, 3)) * 0.5
    p[:, 2] = rng.integers(0, 2, n) * 0.5
    return p


def frame(spark, p):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(p)], KIND)


def sequential_dbscan(p, eps, least):
    near = [[j for j in range(len(p)) if j != i and ((p[i] - p[j]) ** 2).sum() <= eps * eps] for i in range(len(p))]
    label, cluster = [-1] * len(p), 0
    for i in range(len(p)):
        if label[i] != -1:
            continue
        if len(near[i]) < least:
            label[i] = 0
            continue
        cluster += 1
        label[i] = cluster
        queue = list(near[i])
        for j in near[i]:
            label[j] = cluster
        while queue:
            j = queue.pop(0)
            if len(near[j]) >= least:
                for k in near[j]:
                    if label[k] in (-1, 0):
                        label[k] = cluster
                        queue.append(k)
    return label


@pytest.mark.parametrize("seed", range(4))
def test_dbscan(spark, seed):
    p = random_cloud(seed)
    got = {r["pid"]: r["cluster"] for r in clustering.dbscan(frame(spark, p), 0.5, 3).collect()}
    assert [got[k] for k in range(len(p))] == sequential_dbscan(p, 0.5, 3)


def sequential_peaks(p, radius, dc, share):
    n = len(p)
    d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
    near = [[j for j in range(n) if j != i and d2[i, j] <= radius * radius] for i in range(n)]
    rho = [round(sum(np.exp(-d2[i, j] / (dc * dc)) for j in near[i] if d2[i, j] < dc * dc), 9) for i in range(n)]
    delta, parent, peak = [0.0] * n, [-1] * n, [False] * n
    for i in range(n):
        up = [j for j in near[i] if rho[j] >= rho[i]]
        if up:
            parent[i] = min(up, key=lambda j: (d2[i, j], j))
        else:
            peak[i] = True
            if near[i]:
                parent[i] = min(near[i], key=lambda j: (-d2[i, j], j))
        delta[i] = np.sqrt(d2[i, parent[i]]) if parent[i] >= 0 else 0.0
    order = sorted(range(n), key=lambda i: (-round(rho[i] * delta[i], 9), i))[: int(n * share)]
    label = [0] * n
    for k, i in enumerate([i for i in order if peak[i] or delta[i] > dc]):
        label[i] = k + 1
    centres = {i for i in range(n) if label[i]}
    for i in sorted(range(n), key=lambda i: (-rho[i], i)):
        if i not in centres and not peak[i] and delta[i] < dc:
            label[i] = label[parent[i]]
    return label


@pytest.mark.parametrize("seed", range(3))
def test_density_peaks(spark, seed):
    p = np.unique(random_cloud(seed, 50), axis=0)
    got = {r["pid"]: r["cluster"] for r in density_peaks.density_peaks(frame(spark, p), 1.2, 0.8, 0.2).collect()}
    assert [got[k] for k in range(len(p))] == sequential_peaks(p, 1.2, 0.8, 0.2)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in got} == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1400)}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_range_join_on_the_radius_and_below_zero(spark):
    p = frame(spark, [(-1.0, -1.0, -1.0), (-1.0, -1.0, -0.5), (-1.0, -1.0, -1.0), (3.0, 3.0, 3.0)])
    got = {(r["i"], r["j"]) for r in neighbours.neighbours(p, 0.5).collect()}
    assert got == {(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)}
    assert {(r["i"], r["j"]) for r in neighbours.neighbours(p, 0.5, strict=True).collect()} == {(0, 2), (2, 0)}


def test_knn_of_duplicates_and_single_points(spark):
    same = frame(spark, [(1.0, 1.0, 1.0)] * 4)
    assert sorted((r["i"], r["j"]) for r in neighbours.knn(same, same, 2).collect()) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)]
    one = frame(spark, [(1.0, 1.0, 1.0)])
    assert neighbours.knn(one, one, 3).count() == 0
    assert neighbours.knn(one.limit(0), one.limit(0), 3).count() == 0


def test_slices_of_negative_heights(spark):
    p = frame(spark, [(0.0, 0.0, -5.0 - k * 0.01) for k in range(12)] + [(0.0, 0.0, -9.0)])
    got = cleaning.height_slices(p, 1.0).collect()
    assert len(got) == 12 and {r["slice"] for r in got} == {0}


def test_outliers_split_the_cloud(spark):
    p = frame(spark, np.concatenate([random_cloud(1), [[50.0, 50.0, 50.0]]]))
    kept, dropped = (cleaning.statistical_outliers(p, 4, 2.0, negative=n) for n in (False, True))
    assert {r["pid"] for r in dropped.collect()} == {60}
    assert kept.count() + dropped.count() == p.count()


def test_voxel_components_of_a_sparse_lattice(spark):
    """Components of touching voxels, numbered by size, against a sequential search."""
    p = [(x, y, z) for x in range(9) for y in range(9) for z in range(9) if (x + y * 3 + z * 5) % 7 == 0 or x == 4 and y == 4]
    left, found = set(p), []
    while left:
        queue, part = [left.pop()], set()
        while queue:
            v = queue.pop()
            part.add(v)
            near = {w for w in left if max(abs(a - b) for a, b in zip(v, w)) <= 1}
            left -= near
            queue += near
        found.append(part)
    found.sort(key=lambda c: (-len(c), min(c)))
    want = {v: n for n, c in enumerate(found, 1) for v in c}
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], KIND)
    got = clustering.voxel_components(df, (1.0, 1.0, 1.0)).collect()
    assert {(r["vx"], r["vy"], r["vz"]): r["cluster"] for r in got} == want


def sequential_reachable(p, ranked_centres, dc, least):
    """Clusters of the centres' components, started in order of rank; a loose centre beside none that started takes a number."""
    n = len(p)
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    near = (d2 <= dc * dc) & ~np.eye(n, dtype=bool)
    core = near.sum(axis=1) >= least
    cluster, number = np.zeros(n, dtype=int), 0
    for c in ranked_centres:
        if not core[c]:
            number += not (near[c] & core & (cluster > 0)).any()
        elif not cluster[c]:
            number += 1
            stack = [c]
            cluster[c] = number
            while stack:
                q = stack.pop()
                for j in np.flatnonzero(near[q] & core & (cluster == 0)):
                    cluster[j] = number
                    stack.append(j)
    return core, cluster


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_density_reachable_cores(spark, seed):
    p = random_cloud(seed)
    pc = frame(spark, p)
    order = [int(k) for k in np.random.default_rng(seed).permutation(len(p))[:14]]
    heads = spark.createDataFrame([(c, k + 1) for k, c in enumerate(order)], "pid long, rank long")
    got = {r["pid"]: r["cluster"] for r in density_peaks.density_reachable(pc, neighbours.neighbours(pc, 0.8), heads, 0.5, 4).collect()}
    core, wanted = sequential_reachable(p, order, 0.5, 4)
    assert len(got) == len(p) and all(got[k] == wanted[k] for k in np.flatnonzero(core))


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_ranks_over_ranges(spark, n):
    from pyspark.sql import functions as F

    from cloudweave.operators.ranking import ranked

    rows = spark.range(n).select(F.col("id"), (F.col("id") * 7919 % 13).alias("v"))
    got = [(r["v"], r["id"]) for r in ranked(rows, [F.desc("v"), F.col("id")], "r").orderBy("r").collect()]
    assert got == sorted(((k * 7919 % 13, k) for k in range(n)), key=lambda t: (-t[0], t[1]))
    assert sorted(r["r"] for r in ranked(rows, [F.desc("v"), F.col("id")], "r").collect()) == list(range(1, n + 1))
