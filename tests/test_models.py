"""Models, registration, CHAMELEON and graph segmentations on small shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudweave.operators import chameleon, cleaning, graphs, models, registration
from cloudweave.operators.normals import normals_knn

KIND = "pid long, x double, y double, z double"


def frame(spark, p):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(p)], KIND)


@pytest.fixture(scope="module")
def two_blobs(spark):
    rng = np.random.default_rng(2)
    return frame(spark, np.concatenate([rng.normal(0, 0.1, (30, 3)), rng.normal(0, 0.1, (30, 3)) + [3, 0, 0]]))


def test_plane_and_line(spark):
    rng = np.random.default_rng(0)
    plane = np.c_[rng.uniform(-1, 1, (60, 2)), np.full(60, 0.5)]
    noise = rng.uniform(-1, 1, (20, 3))
    coefficients, inliers = models.fit_model(frame(spark, np.concatenate([plane, noise])), "plane", 0.01, 60)
    assert np.allclose(coefficients, [0, 0, 1, -0.5], atol=0.02) and inliers.where("pid < 60").count() == 60
    line = np.outer(rng.uniform(-1, 1, 60), [1, 2, 2]) / 3
    coefficients, _ = models.fit_model(frame(spark, np.concatenate([line, noise])), "line", 0.01, 60)
    assert np.allclose(np.abs(np.array(coefficients[3:]) @ [1 / 3, 2 / 3, 2 / 3]), 1, atol=1e-3)


def test_j_linkage_separates_planes(spark):
    rng = np.random.default_rng(1)
    a = np.c_[rng.uniform(-1, 1, (30, 2)), np.zeros(30)]
    b = np.c_[np.full(30, 4.0), rng.uniform(-1, 1, (30, 2)) + 3]
    got = {r["pid"]: r["model"] for r in models.j_linkage(frame(spark, np.concatenate([a, b])), "plane", 0.02, 150, least=10).collect()}
    most = [max(set(part), key=part.count) for part in ([got[k] for k in range(30)], [got[k] for k in range(30, 60)])]
    assert 0 not in most and most[0] != most[1]
    assert sum(got[k] == most[k // 30] for k in range(60)) >= 54


def test_icp_finds_a_small_motion(spark):
    rng = np.random.default_rng(3)
    target = frame(spark, rng.uniform(0, 1, (120, 3)))
    angle = 0.02
    m = np.array([[np.cos(angle), -np.sin(angle), 0, 0.01], [np.sin(angle), np.cos(angle), 0, -0.005], [0, 0, 1, 0.004], [0, 0, 0, 1]])
    source = cleaning.rigid_transform(target, np.linalg.inv(m).tolist())
    found = registration.icp(source, target, 0.2, 20)
    assert np.allclose(found.matrix, m, atol=1e-4)
    assert np.allclose(found.matrix[:3, :3] @ found.matrix[:3, :3].T, np.eye(3), atol=1e-9)
    rms = registration.rms(registration.residuals(source, target, found.pairs, found.matrix)).first()
    assert rms["n"] == 120 and rms["rms"] < 1e-3


def test_icp_planes_on_a_corner(spark):
    g = np.linspace(0, 1, 7)
    a, b = (v.ravel() for v in np.meshgrid(g, g))
    o = np.zeros_like(a)
    corner = np.unique(np.concatenate([np.c_[a, b, o], np.c_[a, o, b], np.c_[o, a, b]]), axis=0)
    target = normals_knn(frame(spark, corner), 6)
    shift = [[1, 0, 0, 0.02], [0, 1, 0, -0.01], [0, 0, 1, 0.015], [0, 0, 0, 1]]
    source = cleaning.rigid_transform(target, shift)
    found = registration.icp_planes(source, target, 0.3, 6, degrees=20.0)
    assert np.allclose(found.matrix @ np.array(shift), np.eye(4), atol=5e-3)


def test_bisection_is_balanced_and_cheap():
    nodes = list(range(20))
    edges = [(a, b, 5) for s in (range(10), range(10, 20)) for a in s for b in s if a < b] + [(0, 10, 1)]
    side = chameleon.bisect(nodes, edges, 6)
    assert len({side[k] for k in range(10)}) == 1 and len({side[k] for k in range(10, 20)}) == 1 and side[0] != side[10]


def test_chameleon_finds_blobs(spark, two_blobs):
    got = {r["pid"]: r["cluster"] for r in chameleon.chameleon(two_blobs, 2, 5, 10.0, 0.3).collect()}
    assert len({got[k] for k in range(30)}) == 1 and len({got[k] for k in range(30, 60)}) == 1 and got[0] != got[30]


def test_random_walker(spark, two_blobs):
    vertices, edges = graphs.graph_knn(two_blobs, 6)
    seeds = spark.createDataFrame([(0.0, 0.0, 0.0, 4), (3.0, 0.0, 0.0, 2)], "x double, y double, z double, label int")
    clusters, _ = graphs.random_walker(vertices, graphs.weighted(vertices, edges), seeds, rounds=30)
    got = {r["pid"]: r["cluster"] for r in clusters.collect()}
    assert {got[k] for k in range(30)} == {2} and {got[k] for k in range(30, 60)} == {1}


def test_min_cut_keeps_the_object(spark, two_blobs):
    got = graphs.min_cut(two_blobs, (0.0, 0.0, 0.0), 0.25, 1.0, 6).where("foreground").select("pid")
    assert {r["pid"] for r in got.collect()} == set(range(30))


def test_supervoxels_cover_all_points(spark, two_blobs):
    got = graphs.supervoxels(two_blobs, 0.2, 1.0, 2)
    assert got.count() == 60 and got.where(F.col("label").isNull()).count() == 0
