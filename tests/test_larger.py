"""Queries on tables that are denser or larger than the smallest ones."""

import itertools
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from cloudweave.operators import density, models
from cloudweave.operators import occupancy as oc
from cloudweave.plans import catalog
from test_oracle import rows


def embeddings(folder, p):
    """A folder with an embeddings table of the given points."""
    table = pa.table({"vec_id": pa.array(range(len(p)), pa.int64()), "embedding": pa.array(np.asarray(p).tolist(), pa.list_(pa.float32())), "label": pa.array([k % 10 for k in range(len(p))], pa.int32())})
    pq.write_table(table, f"{folder}/embeddings.parquet")
    return str(folder)


def against_sql(spark, name, sf):
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert len(want) and rows(got) == rows(want)
    return got


def test_pruning_where_blocks_merge_twice(spark, tmp_path):
    # Every cell of a block of four a side is hit by each of the four scans.
    block = [c for c in itertools.product(np.arange(4, 8) * 0.05 + 0.025, repeat=3) for _ in range(4)]
    sf = embeddings(tmp_path, block)
    assert {15} <= set(against_sql(spark, "occupancy_pruned", sf)["depth"]) <= {15, 16}
    full = spark.createDataFrame([(*k, 16, 1.0) for k in itertools.product(range(32772, 32776), repeat=3)], "kx int, ky int, kz int, depth int, log_odds double")
    assert oc.prune(full, 1).where("depth = 15").count() == oc.prune(full, 1).count() == 8 and oc.prune(full).select("depth").collect() == [(14,)]


def plain_j_linkage(preferred):
    """The group of every set, merging the first pair of largest similarity until none shares a hypothesis."""
    sets, group = [set(s) for s in preferred], list(range(len(preferred)))
    while True:
        alive = sorted(set(group))
        best, i, j = max(((len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])), -a, -b) for a, b in itertools.combinations(alive, 2)), default=(0, 0, 0))
        if not best:
            return group
        sets[-i] &= sets[-j]
        group = [-i if g == -j else g for g in group]


def test_agglomeration_merges_the_first_pair_of_largest_similarity():
    rng = np.random.default_rng(4)
    for hypotheses, share in ((5, 0.5), (70, 0.1), (140, 0.05), (12, 0.9)):
        sets = sorted({tuple(np.flatnonzero(rng.random(hypotheses) < share).tolist()) for _ in range(40)} | {()}, key=lambda s: hash(s))
        assert models.agglomerate(sets, hypotheses).tolist() == plain_j_linkage(sets)


def test_j_linkage_of_many_preference_sets(spark):
    p = np.random.default_rng(6).normal(0, 0.12, (6000, 3))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(p.tolist())], "pid long, x double, y double, z double")
    models_ = models.plane_hypotheses(models._sample(df, 180, 0))
    preferred = np.abs(p @ models_[:, :3].T + models_[:, 3]) <= 0.03
    assert len(np.unique(preferred, axis=0)) > 5000
    got = {r["pid"]: r["model"] for r in models.j_linkage(df, "plane", 0.03, 60).collect()}
    assert len(got) == 6000 and [got[k] > 0 for k in range(6000)] == preferred.any(axis=1).tolist()


def test_mean_knn_distance_leaves_no_table_of_pairs(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.normal(0, 0.12, (2500, 3)), np.zeros((300, 3)), rng.uniform(-4, 4, (200, 3)), [[50, 0, 0]]])
    d = np.sqrt(sum((a[:, None] - a[None]) ** 2 for a in p.T))
    np.fill_diagonal(d, np.inf)
    d.sort(axis=1)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(p.tolist())], "pid long, x double, y double, z double")
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("part-*"))
    before = held()
    for k in (1, 44, 700, 5000):
        got = {r["pid"]: r["density"] for r in density.mean_knn_distance(df, k=k).collect()}
        assert np.allclose([got[i] for i in range(len(p))], d[:, : min(k, len(p) - 1)].mean(axis=1), rtol=1e-12, atol=1e-12)
    assert held() - before < len(p) * 44 * 8
    few = df.where("pid < 3").union(spark.createDataFrame([(9, None, 1.0, 1.0)], df.schema))
    assert {r["pid"]: r["density"] > 0 for r in density.mean_knn_distance(few).collect()} == {0: True, 1: True, 2: True, 9: False}
    assert density.mean_knn_distance(df.where("pid = 1")).first()["density"] == 0 and density.mean_knn_distance(df.where("pid < 0")).count() == 0
