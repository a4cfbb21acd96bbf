"""Occupancy against step-by-step versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudweave.operators import occupancy as oc


def walk(start, end, res):
    """One ray cell by cell."""
    key = [int(np.floor(v / res)) + oc.ZERO for v in start]
    last = [int(np.floor(v / res)) + oc.ZERO for v in end]
    out = []
    length = float(np.linalg.norm(np.subtract(end, start)))
    direction = [(b - a) / length if length else 0.0 for a, b in zip(start, end)]
    while key != last:
        out.append(tuple(key))
        border = []
        for d in range(3):
            if key[d] == last[d]:
                border.append(float("inf"))
            else:
                up = last[d] > key[d]
                border.append(((key[d] - oc.ZERO + up) * res - start[d]) / direction[d])
        d = min(range(3), key=lambda d: (border[d], -d))
        key[d] += 1 if last[d] > key[d] else -1
    return out


def test_rays():
    rng = np.random.default_rng(0)
    start, end = rng.uniform(-1, 1, (200, 3)), rng.uniform(-1, 1, (200, 3))
    end[:20] = start[:20]
    end[20:40, 0] = start[20:40, 0]
    ray, step, keys = oc.traverse(start, end, 0.1)
    for n in range(200):
        got = [tuple(k) for k in keys[ray == n]]
        assert got == walk(start[n], end[n], 0.1)
        assert step[ray == n].tolist() == list(range(len(got)))


def test_ray_that_leaves_the_key_range_is_dropped():
    ray, _, _ = oc.traverse(np.array([[0.0, 0.0, 0.0]]), np.array([[1e6, 0.0, 0.0]]), 0.1)
    assert not len(ray)


@pytest.mark.parametrize("seed", range(2))
def test_fold(spark, seed):
    rnd = random.Random(seed)
    rows = [(k % 5, 0, 0, rnd.choice([k, k * 700]) * 10 + j, rnd.choice([0.85, -0.4, 2.0, -2.5])) for k in range(60) for j in range(3)]
    rows = list({(r[0], r[3]): r for r in rows}.values())
    want = {}
    for x, _, _, seq, u in sorted(rows, key=lambda r: r[3]):
        want[x] = min(max(want.get(x, 0.0) + u, -2.0), 3.5)
    got = oc.fold(spark.createDataFrame(rows, "kx int, ky int, kz int, seq long, u double"))
    assert {r["kx"]: round(r["log_odds"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def cells(spark, rows):
    return spark.createDataFrame([(*k, 16, v) for k, v in rows.items()], "kx int, ky int, kz int, depth int, log_odds double")


def test_prune_and_expand_are_inverse(spark):
    rows = {k: 1.0 for k in itertools.product(range(32768, 32772), repeat=3)} | {(32772, 32768, 32768): 1.0}
    pruned = oc.prune(cells(spark, rows))
    assert sorted((r["depth"], r["kx"]) for r in pruned.collect()) == [(14, 32770), (16, 32772)]
    assert oc.equal_trees(oc.expand(pruned), cells(spark, rows))
    found = oc.search(pruned, spark.createDataFrame([(1, 0.15, 0.05, 0.25), (2, -0.1, 0.0, 0.0)], "pid long, x double, y double, z double"), 0.1)
    assert {r["pid"]: (r["log_odds"], r["found_depth"]) for r in found.collect()} == {1: (1.0, 14), 2: (None, None)}
    mixed = rows | {(32768, 32768, 32768): 0.5}
    assert oc.prune(cells(spark, mixed)).where("depth = 14").count() == 0


def test_keys_and_centres(spark):
    p = spark.createDataFrame([(1, -0.01, 0.0, 0.26)], "pid long, x double, y double, z double")
    k = oc.with_keys(p, 0.1).first()
    assert (k["kx"], k["ky"], k["kz"]) == (32767, 32768, 32770)
    assert oc.with_keys(p, 0.1, 13).first()["kx"] == 32764
    far = p.withColumn("x", F.lit(1e6))
    assert oc.with_keys(far, 0.1).count() == 0


def test_scan_update_prefers_occupied_and_cuts_at_the_range(spark):
    columns = "scan_id long, ray_id long, ox double, oy double, oz double, x double, y double, z double"
    scan = spark.createDataFrame([(0, 0, 0.05, 0.05, 0.05, 0.35, 0.05, 0.05), (0, 1, 0.05, 0.05, 0.05, 0.75, 0.05, 0.05)], columns)
    got = {r["kx"] - oc.ZERO: r["occupied"] for r in oc.scan_update(scan, 0.1).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}
    got = {r["kx"] - oc.ZERO: r["occupied"] for r in oc.scan_update(scan, 0.1, 0.5).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: False}
    boxed = {r["kx"] - oc.ZERO: r["occupied"] for r in oc.scan_update(scan, 0.1, box=((0.1, 0, 0), (0.5, 1, 1))).collect()}
    assert boxed == {3: True, 2: False, 1: False}


def test_cast_rays(spark):
    table = cells(spark, {(oc.ZERO + k, oc.ZERO, oc.ZERO): (1.0 if k == 5 else -1.0) for k in range(6)})
    rays = spark.createDataFrame([(1, 0.05, 0.05, 0.05, 1.0, 0.0, 0.0), (2, 0.05, 0.05, 0.05, -1.0, 0.0, 0.0), (3, 0.55, 0.05, 0.05, 1.0, 0.0, 0.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r["ray_id"]: (r["hit"], r["kx"] - oc.ZERO) for r in oc.cast_rays(table, rays, 0.1, 2.0).collect()}
    assert got == {1: (True, 5), 2: (False, -1), 3: (True, 5)}
    near = oc.cast_rays(table, rays.where("ray_id = 1"), 0.1, 0.32).first()
    assert (near["hit"], near["kx"] - oc.ZERO) == (False, 4)


def test_ray_intersection(spark):
    one = spark.range(1)

    def hit(origin, direction):
        lit = [[F.lit(float(v)) for v in x] for x in (origin, direction, (1.0, 0.0, 0.0))]
        r = one.select(oc.ray_intersection(*lit, 0.5).alias("h")).first()["h"]
        return None if r is None else tuple(round(v, 6) for v in r)

    assert hit((0, 0, 0), (1, 0, 0)) == (0.75, 0.0, 0.0)
    assert hit((0, 0, 0), (0, 1, 0)) is None


def test_distance_field_against_brute_force(spark):
    rng = np.random.default_rng(5)
    blocked = {tuple(oc.ZERO + v for v in k) for k in rng.integers(0, 8, (12, 3)).tolist()} | {tuple(oc.ZERO + v for v in k) for k in itertools.product(range(3), repeat=3)}
    low, high = (oc.ZERO,) * 3, (oc.ZERO + 7,) * 3
    field = oc.distance_field(cells(spark, {k: 1.0 for k in blocked}), low, high, 0.1, 0.25)
    for r in field.collect():
        k = (r["kx"], r["ky"], r["kz"])
        want = min(9, min(sum((a - b) ** 2 for a, b in zip(k, o)) for o in blocked))
        assert r["sqdist"] == want
    assert oc.field_errors(field, cells(spark, {k: 1.0 for k in blocked})).count() == 0


def test_changes_cancel(spark):
    a = cells(spark, {(1, 1, 1): 1.0, (2, 1, 1): -1.0})
    b = cells(spark, {(1, 1, 1): 0.5, (2, 1, 1): 1.0, (3, 1, 1): -1.0})
    assert {(r["kx"], r["created"]) for r in oc.changes(a, b).collect()} == {(2, False), (3, True)}


def test_pruned_tables_answer_like_whole_ones(spark):
    """Blocks of 2, 4 and 8 cells a side merge; rays, maps, obstacles and updates must not notice."""
    rnd = random.Random(5)
    z = oc.ZERO
    cells = {}
    for side, at in ((2, (0, 0, 0)), (2, (2, 0, 0)), (4, (8, 0, 0)), (8, (16, 0, 0)), (4, (0, 4, 0))):
        value = rnd.choice((-0.4, 0.85))
        for o in itertools.product(range(side), repeat=3):
            cells[tuple(z + a + b for a, b in zip(at, o))] = value
    cells.update({(z + 30 + k, z + 1, z + 1): 0.85 if k % 4 == 0 else -0.4 for k in range(12)})
    whole = spark.createDataFrame([(*k, oc.DEPTH, v) for k, v in cells.items()], "kx int, ky int, kz int, depth int, log_odds double")
    pruned = oc.cut(oc.prune(whole))
    assert pruned.count() < whole.count() and pruned.agg(F.min("depth")).first()[0] <= oc.DEPTH - 3
    as_set = lambda df: {tuple(r) for r in df.select(*oc.KEYS, "log_odds").collect()}
    assert as_set(oc.expand(pruned)) == as_set(whole)
    rays = spark.createDataFrame([(k, 0.05, rnd.uniform(0, 0.7), rnd.uniform(0, 0.7), 1.0, rnd.uniform(-0.2, 0.2), rnd.uniform(-0.2, 0.2)) for k in range(40)], "ray_id int, ox double, oy double, oz double, dx double, dy double, dz double")
    for unknown in (False, True):
        a, b = (sorted(map(tuple, oc.cast_rays(t, rays, 0.1, 4.0, unknown).collect())) for t in (whole, pruned))
        assert a == b and a
    low, high = (z - 1, z, z + 1), (z + 20, z + 6, z + 3)
    for unknown in (False, True):
        a, b = (sorted(map(tuple, oc.obstacles(t, low, high, unknown_too=unknown).collect())) for t in (whole, pruned))
        assert a == b and a
    points = spark.createDataFrame([(k, rnd.uniform(0, 4), rnd.uniform(0, 1), rnd.uniform(0, 1)) for k in range(60)], "pid int, x double, y double, z double")
    maps = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("b", 0.3, 0.1, 0.0, 0.1, 0.0, 0.5)], "map_id string, x double, y double, z double, roll double, pitch double, yaw double")
    a, b = (sorted(map(str, oc.search_maps(maps, t.crossJoin(maps.select("map_id")), points, 0.1).collect())) for t in (whole, pruned))
    assert a == b
    updates = spark.createDataFrame([(z + x, z + 1, z + 1, s, 0.85) for s, x in enumerate((0, 9, 17, 17, 40, 60))], "kx int, ky int, kz int, seq long, u double")
    a, b = oc.fold(updates, start=whole), oc.fold(updates, start=pruned)
    assert as_set(a) == as_set(oc.expand(b)) and b.count() < a.count()
    values = updates.select(*oc.KEYS, F.lit(0.3).alias("log_odds")).distinct()
    assert as_set(oc.set_values(whole, values)) == as_set(oc.expand(oc.set_values(pruned, values)))


def test_cast_rays_in_maps(spark):
    # Both maps hold one cell ahead of the first ray; that of the second, shifted map is closer.
    wall = spark.createDataFrame([("a", 32778, 32768, 32768, 16, 3.5), ("b", 32772, 32768, 32768, 16, 3.5)], "map_id string, kx int, ky int, kz int, depth int, log_odds double")
    maps = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("b", 0.2, 0.0, 0.0, 0.0, 0.0, 0.0)], "map_id string, x double, y double, z double, roll double, pitch double, yaw double")
    rays = spark.createDataFrame([(1, 0.05, 0.05, 0.05, 1.0, 0.0, 0.0), (2, 0.05, 0.05, 0.05, 0.0, 1.0, 0.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    hit, miss = oc.cast_rays_in_maps(maps, wall, rays, 0.1, 3.0, ignore_unknown=True).orderBy("ray_id").collect()
    assert hit["hit"] and hit["map_id"] == "b" and abs(hit["x"] - 0.65) < 1e-9 and abs(hit["distance"] - 0.6) < 1e-9
    assert not miss["hit"] and miss["map_id"] is None and miss["x"] is None
    assert [r["hit"] for r in oc.cast_rays_in_maps(maps.limit(0), wall, rays, 0.1, 3.0).collect()] == [False, False]
