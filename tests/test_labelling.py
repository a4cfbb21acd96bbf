"""Golden labelling cases (four sites, nine labels), refusals, and brute force for flows and assignments."""

import itertools
import resource
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudweave.operators import assignment, components, labelling
from cloudweave.operators.flow import ArrayNetwork, FlowNetwork

A = ["125842379", "312545555", "555545213", "973248521"]
B = ["125842379", "311545555", "555545113", "973248521"]
C = ["125842379", "313543555", "555545113", "973248521"]
D = ["125842379", "313542555", "555555113", "973248521"]
PAIRS = [(1, 2, 2), (2, 3, 1), (3, 4, 2)]


def problem(spark, data, smooth=False, label=None, subsets=()):
    p = labelling.Labelling(spark, 4, 9)
    p.set_data_cost(spark.createDataFrame([(s + 1, k + 1, int(c)) for s, row in enumerate(data) for k, c in enumerate(row)], "site int, label int, cost long"))
    if smooth:
        p.set_neighbors(spark.createDataFrame(PAIRS, "p int, q int, w long"))
        p.set_smooth_cost(spark.createDataFrame([(a, b, min(abs(a - b), 3)) for a in range(1, 10) for b in range(1, 10)], "l1 int, l2 int, cost long"))
    if label:
        p.set_label_cost([int(c) for c in label])
    for cost, subset in subsets:
        p.set_label_cost(cost, subset)
    return p


def of(spark, text):
    return spark.createDataFrame([(k + 1, int(c)) for k, c in enumerate(text)], "site int, label int")


def text(df):
    return "".join(str(r["label"]) for r in df.orderBy("site").collect())


CASES = [
    ("data only", A, False, None, (), "1289", 4),
    ("data and smooth", B, True, None, (), "2288", 9),
    ("data and label", C, False, "991112199", (), "7373", 12),
    ("with subsets", C, False, "991112199", ((3, (1, 3, 4, 5, 6)), (4, (4, 8, 9))), "7777", 15),
    ("all three", D, True, "191111199", (), "6677", 13),
    ("all three with subsets", D, True, "191111199", ((3, (1, 3, 4, 5, 6)), (4, (5, 8, 9))), "7777", 15),
]


@pytest.mark.parametrize("name,data,smooth,label,subsets,expected,value", CASES, ids=[c[0] for c in CASES])
def test_golden_expansion(spark, name, data, smooth, label, subsets, expected, value):
    p = problem(spark, data, smooth, label, subsets)
    found = p.expansion(of(spark, "5555"))
    e = p.energy(found).first()
    assert e["energy"] == value == p.energy(of(spark, expected)).first()["energy"]
    assert e["energy"] == e["data"] + e["smooth"] + e["label"]


def test_golden_energies_of_given_labellings(spark):
    assert [problem(spark, A).energy(of(spark, t)).first()["energy"] for t in ("3333", "1234")] == [15, 9]
    assert [problem(spark, B, True).energy(of(spark, t)).first()["energy"] for t in ("3333", "1245")] == [14, 17]
    sub = ((3, (1, 3, 4, 5, 6)), (4, (4, 8, 9)))
    assert [problem(spark, C, False, "991112199", sub).energy(of(spark, t)).first()["energy"] for t in ("3333", "5589", "1245")] == [20, 36, 38]


def test_single_expansions_and_swap(spark):
    p = problem(spark, A)
    once = p.expansion(of(spark, "5555"), only=8)
    assert text(once) == "5588"
    assert text(p.expansion(once, only=3)) == "5388"
    assert problem(spark, B).energy(problem(spark, B).expansion(of(spark, "5555"), swap=True)).first()["energy"] == 4
    p = problem(spark, B, True)
    assert p.energy(p.expansion(of(spark, "5555"), swap=True)).first()["energy"] == 9


def test_refusals(spark):
    frame = spark.createDataFrame
    with pytest.raises(ValueError):
        labelling.Labelling(spark, 4, 1)
    with pytest.raises(ValueError):
        labelling.Labelling(spark, 0, 3)
    p = problem(spark, A)
    bad = [
        lambda: p.set_neighbors(frame([(1, 1, 1)], "p int, q int, w long")),
        lambda: p.set_neighbors(frame([(2, 1, 1)], "p int, q int, w long")),
        lambda: p.set_neighbors(frame([(1, 9, 1)], "p int, q int, w long")),
        lambda: p.set_data_cost(frame([(1, 1, 1)], "site int, label int, cost long")),
        lambda: p.set_data_cost(frame([(1, 1, 10_000_001)], "site int, label int, cost long")),
        lambda: p.set_smooth_cost(frame([(1, 1, 0)], "l1 int, l2 int, cost long")),
        lambda: p.set_label_cost([1, 2]),
        lambda: p.checked(of(spark, "12")),
    ]
    for f in bad:
        with pytest.raises(ValueError):
            f()
    q = problem(spark, B, True)
    q.set_smooth_cost(frame([(a, b, (a - b) ** 2) for a in range(1, 10) for b in range(1, 10)], "l1 int, l2 int, cost long"))
    with pytest.raises(ValueError):
        q.expansion(of(spark, "5555"))


def test_sparse_costs_keep_to_feasible_labels(spark):
    p = labelling.Labelling(spark, 3, 3)
    p.set_data_cost(spark.createDataFrame([(1, 1, 5), (1, 2, 1), (2, 2, 3), (3, 3, 1), (3, 1, 0)], "site int, label int, cost long"))
    p.set_neighbors(spark.createDataFrame([(1, 2, 4), (2, 3, 1)], "p int, q int, w long"))
    found = p.expansion(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "site int, label int"))
    assert text(found) in ("221",) and p.energy(found).first()["energy"] == 1 + 3 + 0 + 1


def test_flow_against_cuts():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 6
        caps = rng.integers(0, 5, size=(n, n)) * (rng.random((n, n)) < 0.5)
        net = FlowNetwork(n)
        for a, b in itertools.permutations(range(n), 2):
            net.edge(a, b, float(caps[a, b]))
        cuts = [sum(caps[a, b] for a in s for b in range(n) if b not in s) for r in range(n - 1) for s in map(lambda x: {0, *x}, itertools.combinations(range(1, n - 1), r))]
        assert net.run(0, n - 1) == min(cuts)


def test_assignment():
    assert assignment.assign(np.array([[8, 10, -4.5], [0, 12, 6], [18, -3, 5.138]])) == [1, 2, 0]
    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (3, 5), (4, 4), (1, 6), (5, 6)):
        for _ in range(20):
            s = rng.integers(-9, 10, size=(n, m))
            best = max(sum(s[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
            assert sum(s[i, c] for i, c in enumerate(assignment.assign(s))) == best
    with pytest.raises(ValueError):
        assignment.assign(np.zeros((3, 2)))


def test_segmentation_evaluation(spark):
    p = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 8), (2, 8), (3, 8)], "label int, truth int")
    assert tuple(assignment.evaluate_segmentation(p).first()) == (6, 4, 2)


def test_grid_neighbors(spark):
    assert labelling.grid_neighbors(spark, 3, 2).where(F.col("p") >= F.col("q")).count() == 0
    assert labelling.grid_neighbors(spark, 3, 2).count() == 7


def dense(spark, n):
    """One component of n sites that are all neighbours; two in five have label 5 for nothing, the others label 2."""
    p = labelling.Labelling(spark, n, 6)
    site = spark.range(1, n + 1, numPartitions=2).select(F.col("id").cast("int").alias("site"))
    p.data_cost = site.withColumn("label", F.explode(F.sequence(F.lit(1), F.lit(6)))).select("site", "label", F.when(F.col("label") == F.when(F.col("site") % 5 < 2, 5).otherwise(2), 0).otherwise(9).cast("long").alias("cost"))
    p.neighbors = site.withColumnRenamed("site", "p").select("p", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("q")).where("p < q").withColumn("w", F.lit(2).cast("long"))
    return p


def grown_and_labels(p, start, **how):
    """MB by which the largest Python worker grew during the moves, and the number of sites by label."""
    first, grown, over = {}, [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            for at in Path("/proc").glob("[0-9]*"):
                try:
                    if b"pyspark.daemon" in (at / "cmdline").read_bytes():
                        now = int((at / "statm").read_text().split()[1]) * resource.getpagesize() >> 20
                        grown[0] = max(grown[0], now - first.setdefault(at.name, now))
                except OSError:
                    continue

    seen = threading.Thread(target=watch)
    seen.start()
    try:
        found = dict(p.expansion(start, **how).groupBy("label").count().collect())
    finally:
        over.set()
        seen.join()
    return grown[0], found


def test_expansion_on_a_dense_component(spark):
    """719,400 pairs in one component; a tuple for each and a network of them all took hundreds of MB."""
    grown, found = grown_and_labels(dense(spark, 1200), None)
    assert found == {2: 1200} and grown < 200


def test_one_expansion_on_a_dense_component(spark):
    start = spark.range(1, 1201).select(F.col("id").cast("int").alias("site"), F.when(F.col("id") % 5 < 2, 5).otherwise(3).alias("label"))
    grown, found = grown_and_labels(dense(spark, 1200), start, only=2)
    assert found == {2: 1200} and grown < 200


def test_swaps_on_a_dense_component(spark):
    start = spark.range(1, 1201).select(F.col("id").cast("int").alias("site"), F.when(F.col("id") % 5 < 2, 5).otherwise(2).alias("label"))
    grown, found = grown_and_labels(dense(spark, 1200), start, swap=True)
    assert found == {2: 1200} and grown < 200


def test_array_network_against_blocking_flows():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, m = 9, int(rng.integers(1, 30))
        excess, (a, b) = rng.integers(-6, 7, n), rng.integers(0, n, (2, m))
        forth, back = rng.integers(0, 5, (2, m))
        whole, net = FlowNetwork(n + 2), ArrayNetwork(excess)
        for k in range(n):
            whole.edge(n, k, max(excess[k], 0))
            whole.edge(k, n + 1, max(-excess[k], 0))
        for part in np.array_split(np.arange(m), 3):
            for k in part:
                whole.edge(a[k], b[k], forth[k], back[k])
            net.add(a[part], b[part], forth[part], back[part])
            net.run()
        whole.run(n, n + 1)
        assert net.source_side().tolist() == whole.cut_side(n)[:n]


def test_moves_against_all_choices():
    """A move's pairs enter the network in several steps; its result is still the best of all choices, with most sites changed."""
    rng = np.random.default_rng(6)
    v = np.abs(np.subtract.outer(np.arange(4), np.arange(4))).clip(max=2).astype(float)
    for _ in range(40):
        n = 7
        cost, of = rng.integers(0, 12, (n, 4)).astype(float), rng.integers(1, 4, n)
        p, q = np.array([x for x in itertools.combinations(range(n), 2) if rng.random() < 0.7] or [(0, 1)]).T
        w = rng.integers(1, 4, len(p)).astype(float)
        pairs = labelling.Pairs()
        pairs.add(p, q, w)
        pairs.number(np.arange(n))
        parts = labelling.Parts(cost, np.zeros(n, dtype=int), pairs, v, [])
        got = parts.moved(of, parts.around(of, 4), np.array([True]), 2, None)
        choices = [np.where(np.array(x), 2, of) for x in itertools.product((False, True), repeat=n)]
        best = min(choices, key=lambda x: (cost[np.arange(n), x].sum() + (w * v[x[p], x[q]]).sum(), -(x == 2).sum()))
        assert got.tolist() == best.tolist()


def test_stars_keep_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    df = spark.createDataFrame(edges, "p int, q int").repartition(3)
    few = components.stars(df, "p", "q", rows=16)
    assert set(map(tuple, components.connected_components(few, "p", "q").collect())) == set(map(tuple, components.connected_components(df, "p", "q").collect()))
    assert components.stars(df.coalesce(1).crossJoin(spark.range(9)).coalesce(1), "p", "q").count() < 400
