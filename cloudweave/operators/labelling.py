"""Labelling energies: data costs of sites, smoothness costs of neighbouring sites and costs of label sets in use.

Tables: data_cost(site, label, cost), neighbors(p, q, w) with p < q, smooth(l1, l2, cost), label_cost(set_id, label, cost) and a
labelling(site, label). Energies and independent minimisation are joins and aggregates. Moves that need a maximum flow are accepted
apart for every connected component of the neighbours when no label costs tie the components together. A task has whole components, their
pairs in about 4 bytes each; a flow network gets a pair only once a cut would separate it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.operators.components import connected_components, stars
from cloudweave.operators.flow import LEAST, ArrayNetwork

LARGEST = 10_000_000
INFEASIBLE = 10**12


def _refuse(what: str, found: DataFrame) -> None:
    if not found.isEmpty():
        raise ValueError(what)


@dataclass
class Labelling:
    """The tables of one problem, checked as they are set."""

    spark: SparkSession
    sites: int
    labels: int
    data_cost: DataFrame | None = None
    neighbors: DataFrame | None = None
    smooth: DataFrame | None = None
    label_cost: DataFrame | None = None
    order: list[int] = field(default_factory=list)
    sparse: bool = False

    def __post_init__(self) -> None:
        if self.sites < 1 or self.labels < 2:
            raise ValueError("at least one site and two labels are needed")
        self.order = self.order or list(range(1, self.labels + 1))

    def _in_range(self, df: DataFrame, columns: dict[str, int]) -> None:
        bad = F.lit(False)
        for c, most in columns.items():
            bad = bad | ~F.col(c).between(1, most)
        _refuse("ids are out of range", df.where(bad))

    def _not_too_large(self, df: DataFrame, column: str) -> None:
        _refuse(f"coefficients above {LARGEST} risk an overflow", df.where(F.col(column) > LARGEST))

    def set_data_cost(self, table: DataFrame) -> Labelling:
        """Dense (every site and label) or sparse: pairs that don't occur can't be taken. Sparse costs don't follow dense ones."""
        self._in_range(table, {"site": self.sites, "label": self.labels})
        self._not_too_large(table, "cost")
        _refuse("a site and label occurs twice", table.groupBy("site", "label").count().where("count > 1"))
        sparse = table.count() < self.sites * self.labels
        if sparse and self.data_cost is not None and not self.sparse:
            raise ValueError("sparse data costs can't follow dense ones")
        self.data_cost, self.sparse = table, sparse
        return self

    def set_neighbors(self, table: DataFrame) -> Labelling:
        """Pairs p < q with weight above 0."""
        _refuse("a site can't be its own neighbour", table.where("p = q"))
        _refuse("pairs must be given once, from the smaller site", table.where("p > q"))
        self._in_range(table, {"p": self.sites, "q": self.sites})
        _refuse("weights must be above 0", table.where("w <= 0"))
        self._not_too_large(table, "w")
        self.neighbors = table
        return self

    def set_smooth_cost(self, table: DataFrame | None = None) -> Labelling:
        """A full table of label pairs; None: 0 for equal labels, else 1."""
        if table is None:
            ids = self.spark.range(1, self.labels + 1)
            table = ids.select(F.col("id").cast("int").alias("l1"), F.explode(F.sequence(F.lit(1), F.lit(self.labels))).alias("l2")).withColumn("cost", (F.col("l1") != F.col("l2")).cast("long"))
        else:
            self._in_range(table, {"l1": self.labels, "l2": self.labels})
            self._not_too_large(table, "cost")
            if table.count() != self.labels**2:
                raise ValueError("smooth costs need every pair of labels")
        self.smooth = table
        return self

    def set_label_cost(self, cost: float | Iterable[float], subset: Iterable[int] | None = None) -> Labelling:
        """One cost for all labels, one for each, or one for a set of labels, paid once if any of the set is in use."""
        before = [] if self.label_cost is None else [tuple(r) for r in self.label_cost.collect()]
        if subset is not None:
            n = max([0, *(r[0] for r in before)]) + 1
            rows = before + [(max(n, self.labels + 1), int(x), int(cost)) for x in subset]
        else:
            each = [cost] * self.labels if isinstance(cost, int | float) else list(cost)
            if len(each) != self.labels:
                raise ValueError("label costs need one cost for each label")
            rows = [r for r in before if r[0] > self.labels] + [(k + 1, k + 1, int(c)) for k, c in enumerate(each)]
        if any(c > LARGEST for _, _, c in rows):
            raise ValueError(f"coefficients above {LARGEST} risk an overflow")
        self.label_cost = self.spark.createDataFrame(rows, "set_id int, label int, cost long")
        return self

    def set_label_order(self, order: Iterable[int]) -> Labelling:
        self.order = list(order)
        if any(not 1 <= x <= self.labels for x in self.order):
            raise ValueError("labels are out of range")
        return self

    def checked(self, labelling: DataFrame) -> DataFrame:
        self._in_range(labelling, {"site": self.sites, "label": self.labels})
        if labelling.count() != self.sites:
            raise ValueError("a labelling needs every site once")
        return labelling

    def energy(self, labelling: DataFrame) -> DataFrame:
        return energy(labelling, self.data_cost, self.neighbors, self.smooth, self.label_cost)

    def greedy_start(self, label: int = 1) -> DataFrame:
        return self.spark.range(1, self.sites + 1).select(F.col("id").cast("int").alias("site"), F.lit(label).alias("label"))

    def expansion(self, start: DataFrame | None = None, only: int | None = None, swap: bool = False, cycles: int = 100) -> DataFrame:
        """(site, label) after expansion moves (one with ``only``), or swap moves, until none lowers the energy."""
        if swap and (self.label_cost is not None or self.sparse):
            raise ValueError("swap takes neither label costs nor sparse data costs")
        if self.neighbors is None and self.label_cost is None and only is None and not swap:
            return cheapest(self.data_cost)
        if self.neighbors is not None and self.smooth is None:
            self.set_smooth_cost()
        if self.neighbors is not None and not swap:
            _refuse_not_metric(self.smooth, self.labels)
        return minimise(self, start if start is not None else self.greedy_start(), only, swap, cycles)


def _refuse_not_metric(smooth: DataFrame, labels: int) -> None:
    """Expansion needs V(b, c) + V(a, a) <= V(b, a) + V(a, c) for the label a that expands."""
    v = {(r["l1"], r["l2"]): r["cost"] for r in smooth.collect()}
    ids = range(1, labels + 1)
    if any(v[b, c] + v[a, a] > v[b, a] + v[a, c] for a in ids for b in ids for c in ids):
        raise ValueError("expansion needs a metric smooth cost")


def energy(labelling: DataFrame, data_cost: DataFrame, neighbors: DataFrame | None = None, smooth: DataFrame | None = None, label_cost: DataFrame | None = None) -> DataFrame:
    """One row (energy, data, smooth, label) as longs."""
    d = labelling.join(data_cost, ["site", "label"]).agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("data"))
    none = labelling.sparkSession.range(1)
    s = none.select(F.lit(0).cast("long").alias("smooth"))
    if neighbors is not None and smooth is not None:
        a, b = labelling.select(F.col("site").alias("p"), F.col("label").alias("l1")), labelling.select(F.col("site").alias("q"), F.col("label").alias("l2"))
        s = neighbors.join(a, "p").join(b, "q").join(smooth, ["l1", "l2"]).agg(F.coalesce(F.sum(F.col("w") * F.col("cost")), F.lit(0)).cast("long").alias("smooth"))
    c = none.select(F.lit(0).cast("long").alias("label"))
    if label_cost is not None:
        used = label_cost.join(labelling.select("label").distinct(), "label", "left_semi").select("set_id", "cost").distinct()
        c = used.agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("label"))
    # Three one-row tables.
    one = d.join(s).join(c)
    return one.select((F.col("data") + F.col("smooth") + F.col("label")).alias("energy"), "data", "smooth", "label")


def cheapest(data_cost: DataFrame) -> DataFrame:
    """(site, label) of the least data cost, ties to the smaller label."""
    return data_cost.groupBy("site").agg(F.min(F.struct("cost", "label")).alias("m")).select("site", F.col("m.label").cast("int").alias("label"))


def grid_neighbors(spark: SparkSession, width: int, height: int, weight: int = 1) -> DataFrame:
    """(p, q, w) of a 4-connected grid with sites x + y * width, counted from 1."""
    cells = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    p = F.col("x") + F.col("y") * width + 1
    right = cells.where(F.col("x") < width - 1).select(p.alias("p"), (p + 1).alias("q"))
    down = cells.where(F.col("y") < height - 1).select(p.alias("p"), (p + width).alias("q"))
    return right.unionByName(down).withColumn("w", F.lit(weight))


class Pairs:
    """Weighted pairs (p, q) of sites numbered from 0, in blocks sorted by p."""

    ROWS = 1 << 19

    def __init__(self):
        self.blocks: list[tuple] = []
        self._open: list[tuple] = []

    def add(self, p: np.ndarray, q: np.ndarray, w: np.ndarray) -> None:
        """w has one weight for all pairs or one for each."""
        self._open.append((p, q, w))
        if sum(len(x[0]) for x in self._open) >= self.ROWS:
            self.close()

    def close(self) -> None:
        if not self._open:
            return
        p, q = (np.concatenate([x[k] for x in self._open]) for k in (0, 1))
        w = np.concatenate([np.broadcast_to(x[2], len(x[0])) for x in self._open])
        order = np.argsort(p, kind="stable")
        first, counts = np.unique(p[order], return_counts=True)
        w = w[:1].copy() if (w == w[0]).all() else w[order]
        self.blocks.append((first, counts, q[order], w.astype(np.int32) if (w == w.astype(np.int32)).all() else w))
        self._open = []

    def number(self, sites: np.ndarray) -> None:
        """From ids of sites to their places among the sorted ``sites``."""
        self.close()
        for k, (first, counts, q, w) in enumerate(self.blocks):
            places = [np.minimum(np.searchsorted(sites, x), len(sites) - 1).astype(np.int32) for x in (first, q)]
            if any((sites[at] != x).any() for at, x in zip(places, (first, q), strict=True)):
                raise ValueError("a neighbour has no data cost or no label")
            self.blocks[k] = (places[0], counts, places[1], w)

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, counts, q, w = self.blocks[k]
        return np.repeat(first, counts), q, np.broadcast_to(w, len(q))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return map(self.block, range(len(self.blocks)))


class Parts:
    """The problems of whole components in arrays: costs by site and label (NaN: can't be taken), pairs, smooth costs by label pair."""

    #: Pairs that a site on the source's side gets at most in the first network of a move; half as many more in each network after it.
    FIRST = 4

    def __init__(self, cost: np.ndarray, part: np.ndarray, pairs: Pairs, smooth: np.ndarray, sets: list[tuple[int, frozenset]]):
        self.cost, self.can = np.where(np.isnan(cost), INFEASIBLE, cost), ~np.isnan(cost)
        self.part, self.parts = part, int(part.max()) + 1
        self.pairs, self.smooth, self.sets = pairs, smooth, sets
        self.rng = np.random.default_rng(0)

    def around(self, state: np.ndarray, states: int) -> np.ndarray:
        """Weights of the neighbours in each state, [0] of those a site precedes in its pairs, [1] of those it follows."""
        n = len(state)
        out = np.zeros((2, n * states))
        for p, q, w in self.pairs:
            for k, (a, b) in enumerate(((p, q), (q, p))):
                out[k] += np.bincount(a.astype(np.int64) * states + state[b], weights=w, minlength=n * states)
        return out.reshape(2, n, states)

    def value(self, of: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The energy of every component."""
        each = self.cost[np.arange(len(of)), of] + np.einsum("sl,sl->s", near[0], self.smooth[of])
        total = np.bincount(self.part, weights=each, minlength=self.parts)
        if self.sets:
            used = np.zeros((self.parts, self.cost.shape[1]), dtype=bool)
            used[self.part, of] = True
            for c, labels in self.sets:
                total += c * used[:, list(labels)].any(axis=1)
        return total

    def _solve(self, of: np.ndarray, free: np.ndarray, new: int, by_free: np.ndarray, by_fixed: np.ndarray) -> np.ndarray:
        """The sites of ``free`` that take the label ``new`` (sink side) instead of theirs in the best choice."""
        v, sites = self.smooth, np.flatnonzero(free)
        room = np.maximum(0.0, v[:, [new]] + v[[new], :] - v - v[new, new])
        # A pair's room is shared by both directions, which leaves terms below 0 to all sites but those with few neighbours.
        change = self.cost[sites, new] - self.cost[sites, of[sites]]
        terms = ((by_free[0], v[[new], :] - v - room / 2), (by_fixed[0], v[[new], :] - v), (by_free[1], (v[new, new] - v[new, :])[:, None] + room.T / 2), (by_fixed[1], v[:, [new]].T - v.T))
        for weights, table in terms:
            change = change + np.einsum("sl,sl->s", weights[sites], table[of[sites]])
        place = np.full(len(of), -1, dtype=np.int32)
        place[sites] = np.arange(len(sites))
        extra, edges = self._set_nodes(of, free, new, len(sites))
        net = ArrayNetwork(np.concatenate([change, extra]))
        for a, b in edges:
            net.add(a, b, np.full(len(a), INFEASIBLE * 10.0), np.zeros(len(a)))
        given = [np.zeros(len(x[2]), dtype=bool) for x in self.pairs.blocks]
        most = self.FIRST
        while True:
            net.run()
            stays = net.source_side()[: len(sites)]
            found = self._separated(of, place, stays, room, given, most) if stays.any() else []
            if not found:
                break
            p, q, share = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            net.add(place[p], place[q], share, share)
            most += max(self.FIRST // 2, 1)
        takes = free.copy()
        takes[sites[stays]] = False
        return takes

    def _separated(self, of: np.ndarray, place: np.ndarray, stays: np.ndarray, room: np.ndarray, given: list[np.ndarray], most: int) -> list[tuple]:
        """Pairs that the network lacks and its cut separates, at most ``most`` for each site that stays."""
        side = np.zeros(len(of), dtype=np.int8)
        side[place >= 0] = 1 + stays
        had = np.zeros(len(of), dtype=np.int64)
        found = []
        for k in self.rng.permutation(len(given)):
            (p, q, w), has = self.pairs.block(k), given[k]
            at = np.flatnonzero((side[p] + side[q] == 3) & ~has)
            share = w[at] * room[of[p[at]], of[q[at]]] / 2
            order = self.rng.permutation(np.flatnonzero(share > 0))
            at, share = at[order], share[order]
            site = np.where(side[p[at]] == 2, p[at], q[at])
            order = np.argsort(site, kind="stable")
            at, share, site = at[order], share[order], site[order]
            keep = had[site] + np.arange(len(site)) - np.searchsorted(site, site) < most
            at, share, site = at[keep], share[keep], site[keep]
            if len(at):
                has[at] = True
                np.add.at(had, site, 1)
                side[site[had[site] >= most]] = 4
                found.append((p[at], q[at], share))
        return found

    def _set_nodes(self, of: np.ndarray, free: np.ndarray, new: int, n: int) -> tuple[np.ndarray, list[tuple]]:
        """Excess and edges of the nodes that stand for label sets; their costs tie everything together, so there is one component."""
        extra: list[float] = []
        edges = []
        for c, labels in self.sets:
            inside = np.isin(of, list(labels))
            if (inside & ~free).any():
                continue
            members, node = np.flatnonzero(inside[free]), n + len(extra)
            if new not in labels and len(members):
                extra.append(-max(c, 0))
                edges.append((members, np.full(len(members), node)))
            elif new in labels and not len(members):
                extra.append(max(c, 0))
                edges.append((np.full(n, node), np.arange(n)))
        return np.array(extra), edges

    def moved(self, of: np.ndarray, near: np.ndarray, on: np.ndarray, new: int, old: int | None) -> np.ndarray:
        """Labels after the best move in the components ``on``: an expansion of ``new``, or a swap of ``old`` and ``new``."""
        sites, labels = on[self.part], self.cost.shape[1]
        if old is not None:
            free = sites & ((of == old) | (of == new))
            base = np.where(free, old, of)
            by_free, by_fixed = np.zeros_like(near), near.copy()
            by_free[:, :, old] = near[:, :, old] + near[:, :, new]
            by_fixed[:, :, [old, new]] = 0
        else:
            base, free = of, sites & (of != new) & self.can[:, new]
            if (sites & (of != new) & ~free).any():
                both = self.around(of + labels * free, 2 * labels)
                by_fixed, by_free = both[:, :, :labels], both[:, :, labels:]
            else:
                by_free, by_fixed = near.copy(), np.zeros_like(near)
                by_free[:, :, new], by_fixed[:, :, new] = 0, near[:, :, new]
        if not free.any():
            return of
        return np.where(self._solve(base, free, new, by_free, by_fixed), new, base)

    def minimise(self, of: np.ndarray, order: list[int], only: int | None, swap: bool, cycles: int) -> np.ndarray:
        """Moves in order; a component's later cycle tries only the labels whose last move lowered its energy, and all once more before it ends."""
        moves = [(only, None)] if only is not None else [(b, a) for n, a in enumerate(order) for b in order[n + 1 :]] if swap else [(a, None) for a in order]
        near = self.around(of, self.cost.shape[1])
        value = self.value(of, near)
        active, full, alive = np.ones((self.parts, len(moves)), dtype=bool), np.ones(self.parts, dtype=bool), np.ones(self.parts, dtype=bool)
        # A move that lowered nothing is not solved again in a component whose labels are still the same.
        turn, tried = np.zeros(self.parts, dtype=np.int64), np.full(active.shape, -1)
        for _ in range(1 if only is not None else cycles):
            good = np.zeros_like(active)
            for m, (new, old) in enumerate(moves):
                on = alive & active[:, m] & (tried[:, m] != turn)
                tried[on, m] = turn[on]
                to = self.moved(of, near, on, new, old) if on.any() else of
                if (to == of).all():
                    continue
                near_to = self.around(to, self.cost.shape[1])
                now = self.value(to, near_to)
                good[:, m] = now < value - LEAST
                turn += good[:, m]
                taken = good[:, m][self.part]
                of, value = np.where(taken, to, of), np.where(good[:, m], now, value)
                near = np.where(taken[:, None], near_to, near)
            none = ~good.any(axis=1)
            alive &= ~(none & full)
            if not alive.any():
                break
            full, active = none, good | none[:, None]
        return of


def _packed(pairs: DataFrame) -> DataFrame:
    """Rows (bucket, p, q, w) of many pairs as bytes: ids of 8 bytes, and of weights one or as many as there are pairs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            bucket, p, q, w = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(bucket, kind="stable")
            bucket, p, q, w = bucket[order], p[order], q[order], w[order]
            for a, b in zip(at := np.flatnonzero(np.diff(bucket, prepend=-1)), [*at[1:], len(bucket)], strict=True):
                ws = w[a : a + 1] if (w[a:b] == w[a]).all() else w[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (p[a:b], q[a:b], ws)]], names=["bucket", "p", "q", "w"])

        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if sum(len(x[0]) for x in held) >= 1 << 17:
                yield from flush()
        if held:
            yield from flush()

    return pairs.mapInArrow(pack, "bucket int, p binary, q binary, w binary")


def minimise(problem: Labelling, start: DataFrame, only: int | None, swap: bool, cycles: int) -> DataFrame:
    labels, order = problem.labels + 1, problem.order
    smooth = np.zeros((labels, labels))
    for r in [] if problem.smooth is None else problem.smooth.collect():
        smooth[r["l1"], r["l2"]] = r["cost"]
    sets: dict[int, tuple[float, set]] = {}
    for r in [] if problem.label_cost is None else problem.label_cost.collect():
        sets.setdefault(r["set_id"], (r["cost"], set()))[1].add(r["label"])
    costs = [(c, frozenset(x)) for c, x in sets.values()]
    sites = start.select("site")
    if costs or problem.neighbors is None:
        # Label costs tie all sites together; without neighbours and label costs every site is a component.
        named = sites.withColumn("part", (F.lit(0) if costs else F.col("site")).cast("long"))
    else:
        linked = connected_components(stars(problem.neighbors, "p", "q"), "p", "q")
        named = sites.join(linked, sites["site"] == linked["node"], "left").select("site", F.coalesce("component", "site").cast("long").alias("part"))
    tasks = int(start.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = named.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(tasks)).cast("int"))
    unary = problem.data_cost.join(start.withColumnRenamed("label", "now"), "site").join(named, "site")
    none = F.lit(None)
    rows = unary.select("bucket", "part", F.col("site").cast("long").alias("site"), F.col("now").cast("int").alias("now"), F.col("label").cast("int").alias("label"), F.col("cost").cast("double").alias("cost"), *[none.cast("binary").alias(c) for c in "pqw"])
    if problem.neighbors is not None:
        pairs = problem.neighbors.join(named.withColumnRenamed("site", "p"), "p").select("bucket", F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q"), F.col("w").cast("double").alias("w"))
        rows = rows.unionByName(_packed(pairs), allowMissingColumns=True)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = [], Pairs()
        for b in batches:
            one = b.filter(pa.compute.is_valid(b.column("site")))
            if one.num_rows:
                held.append([one.column(c).to_numpy(zero_copy_only=False) for c in ("part", "site", "now", "label", "cost")])
            for p, q, w in zip(*[b.column(c).drop_null() for c in "pqw"], strict=True):
                p, q = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (p, q))
                kind = np.int32 if max(p.max(), q.max()) < 1 << 31 and min(p.min(), q.min()) >= -(1 << 31) else np.int64
                found.add(p.astype(kind), q.astype(kind), np.frombuffer(w.as_buffer()).copy())
        if not held:
            return
        part, site, now, label, cost = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, first, at = np.unique(site, return_index=True, return_inverse=True)
        table = np.full((len(ids), labels), np.nan)
        table[at, label] = cost
        found.number(ids)
        parts = Parts(table, np.unique(part[first], return_inverse=True)[1], found, smooth, costs)
        of = parts.minimise(now[first].astype(np.int64), order, only, swap, cycles)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(of, pa.int32())], names=["site", "label"])

    return rows.repartition(tasks, "bucket").mapInArrow(solve, "site int, label int")
