"""Probabilistic voxel occupancy as a table of cells: kx, ky, kz, depth, log_odds.

Keys are 16-bit cell indices, 32768 being the cell that starts at 0. A leaf above the finest depth stands for all cells below
it, under the key of its centre. A cell that is absent is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.functions.geometry import XYZ, clamp, dot
from cloudweave.operators.iteration import cut

DEPTH = 16
ZERO = 1 << (DEPTH - 1)
KEYS = ("kx", "ky", "kz")


@dataclass(frozen=True)
class Sensor:
    """Log-odds of a hit and a miss, clamping bounds and the threshold from which a cell is occupied."""

    hit: float = 0.85
    miss: float = -0.4
    low: float = -2.0
    high: float = 3.5
    threshold: float = 0.0


# Keys and coordinates


def key_of(value: Column, resolution: float, depth: int = DEPTH) -> Column:
    """Key of a coordinate; above the finest depth the key of the coarse cell's centre."""
    return at_depth((F.floor(value / F.lit(float(resolution))) + ZERO).cast("int"), depth)


def at_depth(key: Column, depth: int) -> Column:
    drop = DEPTH - depth
    return key if drop == 0 else (F.shiftleft(F.shiftright(key, drop), drop) + (1 << (drop - 1))).cast("int")


def in_range(*keys: Column) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & k.between(0, (1 << DEPTH) - 1)
    return out


def coordinate_of(key: Column, resolution: float, depth: int = DEPTH) -> Column:
    """Centre of a cell; 0 for the root."""
    if depth == 0:
        return F.lit(0.0)
    width = 1 << (DEPTH - depth)
    return (F.floor((key - ZERO) / F.lit(float(width))) + 0.5) * F.lit(float(resolution) * width)


def with_keys(points: DataFrame, resolution: float, depth: int = DEPTH, checked: bool = True) -> DataFrame:
    """Points with kx, ky, kz; checked: without those outside the key range."""
    out = points.withColumns({k: key_of(F.col(d), resolution, depth) for k, d in zip(KEYS, XYZ, strict=True)})
    return out.where(in_range(*[F.col(k) for k in KEYS])) if checked else out


def _pow2(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent).cast("int")


def cell_centres(cells: DataFrame, resolution: float) -> DataFrame:
    """Cells with x, y, z of their centres and their side length ``size``."""
    width = _pow2(DEPTH - F.col("depth"))
    centre = {d: (F.floor((F.col(k) - ZERO) / width.cast("double")) + 0.5) * width * F.lit(float(resolution)) for d, k in zip(XYZ, KEYS, strict=True)}
    return cells.withColumns({**centre, "size": width * F.lit(float(resolution))})


# Rays


def traverse(start: np.ndarray, end: np.ndarray, resolution: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ray, step, keys) of the cells from each start to its end, without the end cell; nothing where both lie in one cell.

    A ray changes its key once at every cell border it crosses. All borders of all rays are laid out axis by axis, sorted by
    the distance at which they are crossed (ties: z before y before x), and the running counts of crossings give the keys.
    """
    first, last = (np.floor(p / resolution).astype(np.int64) + ZERO for p in (start, end))
    inside = ((first >= 0) & (first < 2 * ZERO) & (last >= 0) & (last < 2 * ZERO)).all(axis=1)
    length = np.linalg.norm(end - start, axis=1)
    direction = (end - start) / np.maximum(length, 1e-300)[:, None]
    way = np.sign(last - first).astype(np.int64)
    rays, dims, times = [], [], []
    for d in range(3):
        many = np.where(inside, np.abs(last[:, d] - first[:, d]), 0)
        ray = np.repeat(np.arange(len(start)), many)
        k = np.arange(len(ray)) - np.repeat(np.cumsum(many) - many, many)
        border = (first[ray, d] - ZERO + k * way[ray, d] + (way[ray, d] > 0)) * resolution
        rays.append(ray)
        dims.append(np.full(len(ray), d))
        times.append((border - start[ray, d]) / np.where(direction[ray, d] == 0, 1.0, direction[ray, d]))
    ray, dim, time = np.concatenate(rays), np.concatenate(dims), np.concatenate(times)
    order = np.lexsort((-dim, time, ray))
    ray, dim, time = ray[order], dim[order], time[order]
    moves = np.zeros((len(ray), 3), dtype=np.int64)
    moves[np.arange(len(ray)), dim] = way[ray, dim]
    total = np.cumsum(moves, axis=0)
    begin = np.flatnonzero(np.diff(ray, prepend=-1))
    count = np.diff(np.append(begin, len(ray)))
    before = np.repeat(total[begin] - moves[begin], count, axis=0) if len(begin) else total
    keys = first[ray] + total - before
    step = np.arange(len(ray)) - np.repeat(begin, count) + 1
    keep = (keys != last[ray]).any(axis=1)
    moving = np.flatnonzero(inside & (first != last).any(axis=1))
    ray = np.concatenate([moving, ray[keep]])
    keys = np.concatenate([first[moving], keys[keep]])
    step = np.concatenate([np.zeros(len(moving), dtype=np.int64), step[keep]])
    order = np.lexsort((step, ray))
    return ray[order], step[order], keys[order]


def ray_keys(rays: DataFrame, resolution: float) -> DataFrame:
    """(ray_id, step, kx, ky, kz) from rays (ray_id, ox, oy, oz, x, y, z)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for lo in range(0, len(p), 1000):
                q = p.iloc[lo : lo + 1000]
                ray, step, keys = traverse(q[["ox", "oy", "oz"]].to_numpy(float), q[["x", "y", "z"]].to_numpy(float), resolution)
                yield pd.DataFrame({"ray_id": q["ray_id"].to_numpy()[ray], "step": step.astype(np.int32), **{k: keys[:, n].astype(np.int32) for n, k in enumerate(KEYS)}})

    kind = rays.schema["ray_id"].dataType.simpleString()
    wanted = rays.select("ray_id", *[F.col(c).cast("double").alias(c) for c in ("ox", "oy", "oz", "x", "y", "z")])
    return wanted.mapInPandas(run, f"ray_id {kind}, step int, kx int, ky int, kz int")


def _length() -> Column:
    return F.sqrt(sum(((F.col(d) - F.col("o" + d)) * (F.col(d) - F.col("o" + d)) for d in ("y", "z")), (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox"))))


def scan_update(scan: DataFrame, resolution: float, max_range: float = -1.0, box: tuple[Sequence[float], Sequence[float]] | None = None, discrete: bool = False) -> DataFrame:
    """(scan_id, kx, ky, kz, occupied) of scan points (scan_id, ray_id, ox, oy, oz, x, y, z): each cell once, occupied before free.

    Beyond max_range (if it is not negative) only the ray up to there counts, as free. With a box only points in it count, and of their rays
    the cells from the point back to where the ray leaves the box. discrete: one ray for each end cell, from and to cell centres.
    """
    if discrete:
        keyed = with_keys(scan, resolution)
        for d in XYZ:
            keyed = keyed.withColumn(d, coordinate_of(F.col("k" + d), resolution)).withColumn("o" + d, coordinate_of(key_of(F.col("o" + d), resolution), resolution))
        scan = keyed.groupBy("scan_id", *KEYS).agg(*[F.min(c).alias(c) for c in ("ray_id", "ox", "oy", "oz", "x", "y", "z")]).drop(*KEYS)
    scan = scan.withColumn("_l", _length())
    far = F.lit(max_range >= 0) & (F.col("_l") > max_range)
    if box is not None:
        scan = scan.where(~far)
        for d, a, b in zip(XYZ, *box, strict=True):
            scan = scan.where(F.col(d).between(a, b))
    hits = with_keys(scan.where(~far), resolution).select("scan_id", *KEYS).distinct()
    ends = {d: F.when(far, F.col("o" + d) + (F.col(d) - F.col("o" + d)) / F.col("_l") * max_range).otherwise(F.col(d)) for d in XYZ}
    rays = scan.withColumns(ends).withColumn("ray_id", F.struct("scan_id", "ray_id"))
    steps = _scan_rays(rays, resolution)
    if box is not None:
        low, high = ([int(np.floor(v / resolution)) + ZERO for v in side] for side in box)
        outside = ~F.lit(True)
        for k, a, b in zip(KEYS, low, high, strict=True):
            outside = outside | ~F.col(k).between(a, b)
        leaves = steps.where(outside).groupBy("scan_id", "ray").agg(F.max("step").alias("_out"))
        steps = steps.join(leaves, ["scan_id", "ray"], "left").where(F.col("_out").isNull() | (F.col("step") > F.col("_out")))
    free = steps.select("scan_id", *KEYS).distinct().join(hits, ["scan_id", *KEYS], "left_anti")
    return hits.withColumn("occupied", F.lit(True)).unionByName(free.withColumn("occupied", F.lit(False)))


def _scan_rays(rays: DataFrame, resolution: float) -> DataFrame:
    """(scan_id, ray, step, kx, ky, kz) of rays whose ray_id is a struct (scan_id, ray_id)."""
    flat = rays.select(F.col("ray_id.scan_id").cast("long").alias("scan_id"), F.col("ray_id.ray_id").cast("long").alias("ray"), "ox", "oy", "oz", "x", "y", "z")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for lo in range(0, len(p), 1000):
                q = p.iloc[lo : lo + 1000]
                ray, step, keys = traverse(q[["ox", "oy", "oz"]].to_numpy(float), q[["x", "y", "z"]].to_numpy(float), resolution)
                ids = {c: q[c].to_numpy()[ray] for c in ("scan_id", "ray")}
                yield pd.DataFrame({**ids, "step": step.astype(np.int32), **{k: keys[:, n].astype(np.int32) for n, k in enumerate(KEYS)}})

    return flat.mapInPandas(run, "scan_id long, ray long, step int, kx int, ky int, kz int")


# Leaves above the finest depth


def _depths(cells: DataFrame) -> list[int]:
    return sorted(r["depth"] for r in cells.select("depth").distinct().collect())


def with_leaf(keyed: DataFrame, cells: DataFrame, value: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """keyed (kx, ky, kz, ...) with the value of the leaf that covers each key, null where none does; ``by`` names further key columns.

    Leaves don't overlap, so one equality join for each depth that occurs finds it.
    """
    out, found, under = keyed, [], ["_" + k for k in KEYS]
    for d in _depths(cells):
        found.append(f"_leaf{d}")
        table = cells.where(F.col("depth") == d).select(*by, *[F.col(k).alias(u) for k, u in zip(KEYS, under, strict=True)], value.alias(found[-1]))
        out = out.withColumns({u: at_depth(F.col(k), d) for k, u in zip(KEYS, under, strict=True)}).join(table, [*by, *under], "left").drop(*under)
    return out.withColumn(name, F.coalesce(*found) if found else F.lit(None)).drop(*found)


def cells_inside(cells: DataFrame, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """The finest cells (kx, ky, kz, log_odds) of a box of keys, ends included, that leaves of any depth cover."""
    width, out = _pow2(DEPTH - F.col("depth")), cells
    for k, a, b in zip(KEYS, low, high, strict=True):
        first = (F.floor(F.col(k) / width) * width).cast("int")
        out = out.withColumn("_a", F.greatest(first, F.lit(a))).withColumn("_b", F.least(first + width - 1, F.lit(b)).cast("int")).where("_a <= _b")
        out = out.withColumn(k, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    return out.select(*KEYS, "log_odds")


def split(cells: DataFrame, touched: DataFrame) -> DataFrame:
    """cells in which no leaf above the finest depth covers a key of ``touched``: such leaves give way to their eight children, level by level."""
    depths = _depths(cells)
    if not depths or depths[0] == DEPTH:
        return cells
    touched, out = cut(touched.select(*KEYS).distinct()), cells
    for d in range(depths[0], DEPTH):
        width, under = 1 << (DEPTH - d), ["_" + k for k in KEYS]
        at = touched.select(*[at_depth(F.col(k), d).alias(k) for k in KEYS]).distinct()
        here = out.where(F.col("depth") == d)
        hit = cut(here.join(at, list(KEYS), "left_semi"))
        if hit.isEmpty():
            continue
        rest = out.where(F.col("depth") != d).unionByName(here.join(hit.select(*KEYS), list(KEYS), "left_anti"))
        for k, u in zip(KEYS, under, strict=True):
            first = F.floor(F.col(k) / width) * width + (width // 4)
            hit = hit.withColumn(u, F.explode(F.array(first, first + width // 2)))
        out = cut(rest.unionByName(hit.select(*[F.col(u).cast("int").alias(k) for k, u in zip(KEYS, under, strict=True)], F.lit(d + 1).alias("depth"), "log_odds")))
    return out


# Updates


FOLD_RUN = 1024


def fold(updates: DataFrame, sensor: Sensor = Sensor(), start: DataFrame | None = None) -> DataFrame:
    """Cells after updates (kx, ky, kz, seq, u): log_odds becomes clamp(log_odds + u), in order of seq, from 0 or the cells ``start``.

    Such steps compose to (add, least, most), which is associative: runs of FOLD_RUN sequence numbers are folded apart and their results
    in turn, so no row gathers all updates of a busy cell. Coarser leaves of ``start`` are split where an update falls into them.
    """
    low, high = F.lit(float(sensor.low)), F.lit(float(sensor.high))

    def limit(x: Column) -> Column:
        return F.least(F.greatest(x, low), high)

    def step(a: Column, e: Column) -> Column:
        return F.struct((a["add"] + e["u"]).alias("add"), limit(a["least"] + e["u"]).alias("least"), limit(a["most"] + e["u"]).alias("most"))

    def join(a: Column, e: Column) -> Column:
        def then(x: Column) -> Column:
            return F.least(F.greatest(x + e["add"], e["least"]), e["most"])

        return F.struct((a["add"] + e["add"]).alias("add"), then(a["least"]).alias("least"), then(a["most"]).alias("most"))

    nothing = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most"))
    runs = updates.groupBy(*KEYS, F.floor(F.col("seq") / FOLD_RUN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("u").cast("double").alias("u")))).alias("e"))
    runs = runs.select(*KEYS, "run", F.aggregate("e", nothing, step).alias("f"))
    whole = runs.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("run", "f"))).alias("r"))
    whole = whole.select(*KEYS, F.aggregate(F.transform("r", lambda x: x["f"]), nothing, join).alias("f"))
    coarse = None
    if start is None:
        before = whole.withColumn("b", F.lit(0.0))
    else:
        start = split(start, updates)
        finest, coarse = start.where(F.col("depth") == DEPTH), start.where(F.col("depth") < DEPTH).select(*KEYS, "depth", "log_odds")
        before = whole.join(finest.select(*KEYS, F.col("log_odds").alias("b")), list(KEYS), "full").withColumn("b", F.coalesce("b", F.lit(0.0)))
    value = F.when(F.col("f").isNull(), F.col("b")).otherwise(F.least(F.greatest(F.col("b") + F.col("f.add"), F.col("f.least")), F.col("f.most")))
    after = before.select(*KEYS, F.lit(DEPTH).alias("depth"), value.alias("log_odds"))
    return after if coarse is None else after.unionByName(coarse)


def insert_scans(scans: DataFrame, resolution: float, sensor: Sensor = Sensor(), max_range: float = -1.0, start: DataFrame | None = None, discrete: bool = False) -> DataFrame:
    """Cells after all scans, in order of scan_id; within a scan every cell is updated once."""
    seen = scan_update(scans, resolution, max_range, discrete=discrete)
    updates = seen.select(*KEYS, F.col("scan_id").alias("seq"), F.when(F.col("occupied"), sensor.hit).otherwise(sensor.miss).alias("u"))
    return fold(updates, sensor, start)


def insert_rays(scans: DataFrame, resolution: float, sensor: Sensor = Sensor(), max_range: float = -1.0, start: DataFrame | None = None) -> DataFrame:
    """Cells after all rays one by one, in order of (scan_id, ray_id): every ray counts, however often it meets a cell."""
    scan = scans.withColumn("_l", _length())
    far = F.lit(max_range >= 0) & (F.col("_l") > max_range)
    ends = {d: F.when(far, F.col("o" + d) + (F.col(d) - F.col("o" + d)) / F.col("_l") * max_range).otherwise(F.col(d)) for d in XYZ}
    rays = scan.withColumns(ends).withColumn("ray_id", F.struct("scan_id", "ray_id"))
    rank = F.col("scan_id") * F.lit(1 << 32) + F.col("ray")
    misses = _scan_rays(rays, resolution).select(*KEYS, (rank * 2).alias("seq"), F.lit(sensor.miss).alias("u"))
    hits = with_keys(scan.where(~far), resolution).select(*KEYS, ((F.col("scan_id").cast("long") * F.lit(1 << 32) + F.col("ray_id")) * 2 + 1).alias("seq"), F.lit(sensor.hit).alias("u"))
    return fold(misses.unionByName(hits), sensor, start)


def set_values(cells: DataFrame, values: DataFrame, sensor: Sensor = Sensor()) -> DataFrame:
    """Cells with the clamped log_odds of ``values`` (kx, ky, kz, log_odds), new ones included; coarser leaves are split where one falls into them."""
    new = values.select(*KEYS, F.lit(DEPTH).alias("depth"), clamp(F.col("log_odds"), sensor.low, sensor.high).alias("_v"))
    both = split(cells, values).join(new, [*KEYS, "depth"], "full")
    return both.select(*KEYS, "depth", F.coalesce("_v", "log_odds").alias("log_odds"))


def is_occupied(sensor: Sensor = Sensor()) -> Column:
    return F.col("log_odds") >= sensor.threshold


def probability() -> Column:
    return 1 - 1 / (1 + F.exp("log_odds"))


def most_likely(cells: DataFrame, sensor: Sensor = Sensor()) -> DataFrame:
    """Every cell snapped to the clamping bound of its state."""
    return cells.withColumn("log_odds", F.when(is_occupied(sensor), F.lit(float(sensor.high))).otherwise(F.lit(float(sensor.low))))


def inner_cells(cells: DataFrame, depth: int) -> DataFrame:
    """The nodes of a coarser depth, each as likely as its most likely cell."""
    keys = [at_depth(F.col(k), depth).alias(k) for k in KEYS]
    return cells.where(F.col("depth") >= depth).groupBy(*keys).agg(F.max("log_odds").alias("log_odds")).select(*KEYS, F.lit(depth).alias("depth"), "log_odds")


def prune(cells: DataFrame, levels: int = DEPTH) -> DataFrame:
    """Eight leaves of one node with equal values become one leaf, from the finest depth up; ``levels``: from so many finest depths only."""
    done = None
    level = cells
    for depth in range(DEPTH, DEPTH - levels, -1):
        here = level.where(F.col("depth") == depth)
        up = [at_depth(F.col(k), depth - 1).alias("p" + k) for k in KEYS]
        with_parent = here.select("*", *up)
        parents = with_parent.groupBy(*["p" + k for k in KEYS]).agg(F.count("*").alias("n"), F.min("log_odds").alias("a"), F.max("log_odds").alias("b")).where("n = 8 and a = b")
        merged = cut(parents.select(*[F.col("p" + k).alias(k) for k in KEYS], F.lit(depth - 1).alias("depth"), F.col("a").alias("log_odds")))
        kept = with_parent.join(parents.select(*["p" + k for k in KEYS]), ["p" + k for k in KEYS], "left_anti").select(*KEYS, "depth", "log_odds")
        done = kept if done is None else done.unionByName(kept)
        coarser = level.where(F.col("depth") < depth)
        if merged.isEmpty() and coarser.isEmpty():
            return done
        level = coarser.unionByName(merged)
    return done.unionByName(level)


def expand(cells: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Leaves above the depth replaced by all their cells at it."""
    gap = depth - F.col("depth")
    width = _pow2(DEPTH - F.col("depth"))
    side = _pow2(gap)
    unit, half = 1 << (DEPTH - depth), (1 << (DEPTH - depth)) // 2
    out = cells.where(F.col("depth") < depth)
    for k in KEYS:
        first = (F.floor(F.col(k) / width) * width + half).cast("int")
        out = out.withColumn(k, F.explode(F.sequence(first, first + (side - 1) * unit, F.lit(unit))))
    return out.withColumn("depth", F.lit(depth)).unionByName(cells.where(F.col("depth") >= depth))


def delete(cells: DataFrame, gone: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Cells without those below the nodes ``gone`` (kx, ky, kz) of a depth."""
    keyed = cells.select("*", *[at_depth(F.col(k), depth).alias("_" + k) for k in KEYS])
    wanted = gone.select(*[at_depth(F.col(k), depth).alias("_" + k) for k in KEYS]).distinct()
    return keyed.join(wanted, ["_" + k for k in KEYS], "left_anti").select(*cells.columns)


# Queries


def search(cells: DataFrame, points: DataFrame, resolution: float, depth: int = DEPTH) -> DataFrame:
    """(pid, log_odds, found_depth) of points; null where unknown. A leaf answers for everything below it.

    Only the depths that occur in the table are probed, by one equality join each.
    """
    keyed = with_keys(points.select("pid", *XYZ), resolution)
    depths = sorted(r["depth"] for r in cells.select("depth").distinct().collect())
    found = None
    for d in depths:
        at = min(d, depth)
        table = (inner_cells(cells.where(F.col("depth") == d), at) if d > depth else cells.where(F.col("depth") == d)).select(*KEYS, "log_odds", F.lit(at).alias("found_depth"))
        probe = keyed.select("pid", *[at_depth(F.col(k), at).alias(k) for k in KEYS])
        hit = probe.join(table, list(KEYS)).select("pid", "log_odds", "found_depth")
        found = hit if found is None else found.unionByName(hit)
    out = points.select("pid")
    if found is None:
        return out.select("pid", F.lit(None).cast("double").alias("log_odds"), F.lit(None).cast("int").alias("found_depth"))
    best = found.groupBy("pid").agg(F.max("log_odds").alias("log_odds"), F.min("found_depth").alias("found_depth"))
    return out.join(best, "pid", "left")


def cast_rays(cells: DataFrame, rays: DataFrame, resolution: float, max_range: float, ignore_unknown: bool = False, sensor: Sensor = Sensor(), by: Sequence[str] = ()) -> DataFrame:
    """(ray_id, hit, kx, ky, kz) of rays (ray_id, ox, oy, oz, dx, dy, dz): the first cell that is occupied, unknown (unless ignored) or
    whose centre lies beyond max_range ends a ray; only the first of these is a hit. No row for rays that nothing ends before the range.
    Leaves of any depth count, as the cells they cover. ``by``: fields of a ray_id struct that choose among the cells by columns of that name.
    """
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    reach = max_range + 2 * resolution
    ends = {d: F.col("o" + d) + F.col("d" + d) / norm * reach for d in XYZ}
    streams = ray_keys(rays.where(norm > 0).withColumns(ends).select("ray_id", "ox", "oy", "oz", *XYZ), resolution)
    streams = streams.withColumns({c: F.col("ray_id")[c] for c in by})
    seen = with_leaf(streams, cells, is_occupied(sensor), "occupied", by).drop(*by).join(rays.select("ray_id", "ox", "oy", "oz"), "ray_id")
    away = sum(((coordinate_of(F.col(k), resolution) - F.col("o" + d)) ** 2 for k, d in zip(KEYS[1:], XYZ[1:], strict=True)), (coordinate_of(F.col("kx"), resolution) - F.col("ox")) ** 2)
    beyond = (F.col("step") > 0) & (away > max_range * max_range)
    stop = beyond | F.coalesce(F.col("occupied"), F.lit(not ignore_unknown))
    first = seen.where(stop).groupBy("ray_id").agg(F.min(F.struct("step", *KEYS, (~beyond & F.coalesce("occupied", F.lit(False))).alias("hit"))).alias("s"))
    return first.select("ray_id", F.col("s.hit").alias("hit"), *[F.col(f"s.{k}").alias(k) for k in KEYS])


def ray_intersection(origin: Sequence[Column], direction: Sequence[Column], centre: Sequence[Column], resolution: float, delta: float = 0.0) -> Column:
    """Struct (x, y, z): where a line first meets a cell's surface, shifted by delta along it; null if it misses."""
    half, slack = resolution / 2, 1e-6
    hits = []
    for n in range(3):
        others = [m for m in range(3) if m != n]
        for side in (-half, half):
            t = (centre[n] + side - origin[n]) / F.when(direction[n] != 0, direction[n])
            within = F.lit(True)
            for m in others:
                within = within & (F.abs(origin[m] + t * direction[m] - centre[m]) <= half + slack)
            hits.append(F.when(within, t))
    t = F.array_min(F.array(*hits))
    return F.when(t.isNotNull(), F.struct(*[(direction[n] * (t + delta) + origin[n]).alias(d) for n, d in enumerate(XYZ)]))


def leaves(cells: DataFrame, resolution: float, box: tuple[Sequence[float], Sequence[float]] | None = None, max_depth: int = DEPTH) -> DataFrame:
    """Leaf cells with centres and sizes, at most at max_depth, whose centres lie in a closed box."""
    limited = cells.where(F.col("depth") <= max_depth)
    if max_depth < DEPTH:
        limited = limited.unionByName(inner_cells(cells.where(F.col("depth") > max_depth), max_depth))
    out = cell_centres(limited, resolution)
    if box is not None:
        for d, a, b in zip(XYZ, *box, strict=True):
            out = out.where(F.col(d).between(a, b))
    return out


def unknown_centres(cells: DataFrame, low: Sequence[float], high: Sequence[float], resolution: float, depth: int = DEPTH) -> DataFrame:
    """Lattice points of a box whose cell is unknown. The lattice starts one step past ``low`` on each axis."""
    step = resolution * (1 << (DEPTH - depth))
    many = [int(np.floor((b - a) / step)) for a, b in zip(low, high, strict=True)]
    grid = cells.sparkSession.range(1, many[0] + 1).select(F.col("id").alias("_x"))
    for d, n in zip(("_y", "_z"), many[1:], strict=True):
        grid = grid.withColumn(d, F.explode(F.sequence(F.lit(1), F.lit(n))) if n > 0 else F.explode(F.array().cast("array<int>")))
    points = grid.select(*[(F.lit(float(a)) + F.col("_" + d) * step).alias(d) for d, a in zip(XYZ, low, strict=True)])
    keyed = with_keys(points, resolution, depth)
    known = cells.where(F.col("depth") >= depth).select(*[at_depth(F.col(k), depth).alias(k) for k in KEYS]).distinct()
    return keyed.join(known, list(KEYS), "left_anti").select(*XYZ)


def metric_bounds(cells: DataFrame, resolution: float) -> DataFrame:
    """One row: least and largest coordinates of the leaf cubes."""
    c = cell_centres(cells, resolution)
    return c.agg(*[f.alias(n) for d in XYZ for f, n in ((F.min(F.col(d) - F.col("size") / 2), f"min_{d}"), (F.max(F.col(d) + F.col("size") / 2), f"max_{d}"))])


def node_counts(cells: DataFrame) -> DataFrame:
    """(depth, nodes, leaves) of the tree that the cells span, root included."""
    out = None
    for d in range(DEPTH + 1):
        keys = [at_depth(F.col(k), d).alias(k) if d else F.lit(0).alias(k) for k in KEYS]
        level = cells.where(F.col("depth") >= d).select(*keys, (F.col("depth") == d).cast("long").alias("leaf")).groupBy(*KEYS).agg(F.max("leaf").alias("leaf"))
        one = level.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves")).select(F.lit(d).alias("depth"), "nodes", "leaves")
        out = one if out is None else out.unionByName(one)
    return out


def equal_trees(a: DataFrame, b: DataFrame) -> bool:
    cols = [*KEYS, "depth", "log_odds"]
    return a.select(*cols).exceptAll(b.select(*cols)).isEmpty() and b.select(*cols).exceptAll(a.select(*cols)).isEmpty()


def changes(before: DataFrame, after: DataFrame, sensor: Sensor = Sensor()) -> DataFrame:
    """(kx, ky, kz, created): cells that are new, or whose state flipped between two tables; flips that cancel don't show."""
    a = before.select(*KEYS, is_occupied(sensor).alias("_a"))
    b = after.select(*KEYS, is_occupied(sensor).alias("_b"))
    both = a.join(b, list(KEYS), "full").where(F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col("_a") != F.col("_b"))))
    return both.select(*KEYS, F.col("_a").isNull().alias("created"))


def surface_normals(cells: DataFrame, wanted: DataFrame, sensor: Sensor = Sensor(), unknown_occupied: bool = False) -> DataFrame:
    """(kx, ky, kz, corner, nx, ny, nz): for each of a cell's eight corners with both states around it the unit direction from
    the occupied to the other cells of the eight that touch there."""
    offsets = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    steps = F.array(*[F.struct(*[F.lit(v).alias("o" + d) for d, v in zip(XYZ, o, strict=True)]) for o in offsets])
    near = wanted.select(*[F.col(k).alias("w" + k) for k in KEYS], F.explode(steps).alias("o"))
    near = near.select("wkx", "wky", "wkz", "o", *[(F.col("wk" + d) + F.col("o.o" + d)).alias("k" + d) for d in XYZ])
    state = near.join(cells.select(*KEYS, is_occupied(sensor).alias("s")), list(KEYS), "left").withColumn("s", F.coalesce("s", F.lit(unknown_occupied)))
    corners = F.array(*[F.struct(*[F.lit(v).alias("c" + d) for d, v in zip(XYZ, c, strict=True)]) for c in [(a, b, e) for a in (0, 1) for b in (0, 1) for e in (0, 1)]])
    touching = state.withColumn("c", F.explode(corners))
    for d in XYZ:
        touching = touching.where((F.col("o.o" + d) == F.col("c.c" + d)) | (F.col("o.o" + d) == F.col("c.c" + d) - 1))
    sign = F.when(F.col("s"), -1).otherwise(1)
    found = touching.groupBy("wkx", "wky", "wkz", "c").agg(*[F.sum(sign * (F.col("o.o" + d) - F.col("c.c" + d) + 0.5)).alias("n" + d) for d in XYZ], F.min("s").alias("a"), F.max("s").alias("b"))
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    found = found.where(F.col("a") != F.col("b")).where(length > 0)
    return found.select(*[F.col("w" + k).alias(k) for k in KEYS], "c", *[(F.col("n" + d) / length).alias("n" + d) for d in XYZ])


# Collections of maps


def _into_maps(maps: DataFrame, points: DataFrame) -> DataFrame:
    """Points in the frame of every map (map_id, x, y, z, roll, pitch, yaw). Every point meets every map by definition; Spark broadcasts
    the poses where they are small."""
    both = points.select("pid", *XYZ).crossJoin(_poses(maps))
    moved = _turned([F.col(d) - F.col("m" + d) for d in XYZ])
    return both.select("pid", "map_id", *[m.alias(d) for m, d in zip(moved, XYZ, strict=True)])


def _poses(maps: DataFrame) -> DataFrame:
    return maps.select("map_id", *[F.col(d).alias("m" + d) for d in XYZ], "roll", "pitch", "yaw")


def _rotation() -> tuple[tuple[Column, ...], ...]:
    """Rows of the rotation from the world into a map of pose roll, pitch, yaw; its transpose leads back."""
    cr, sr, cp, sp, cy, sy = (f(c) for c in ("roll", "pitch", "yaw") for f in (F.cos, F.sin))
    return (
        (cy * cp, sy * cp, -sp),
        (cy * sp * sr - sy * cr, sy * sp * sr + cy * cr, cp * sr),
        (cy * sp * cr + sy * sr, sy * sp * cr - cy * sr, cp * cr),
    )


def _turned(v: Sequence[Column], back: bool = False) -> list[Column]:
    rows = _rotation()
    return [dot(r, v) for r in (zip(*rows, strict=True) if back else rows)]


def cast_rays_in_maps(maps: DataFrame, cells: DataFrame, rays: DataFrame, resolution: float, max_range: float, ignore_unknown: bool = False, sensor: Sensor = Sensor()) -> DataFrame:
    """(ray_id, hit, map_id, x, y, z, distance) of rays cast in every map of a collection; cells carry map_id.

    The closest hit of all maps counts, ties by map_id: x, y, z is its cell's centre in the world, distance that from the origin. Rays that hit in
    no map have hit false and nulls; an empty collection hits nothing.
    """
    both = rays.select("ray_id", *["o" + d for d in XYZ], *["d" + d for d in XYZ]).crossJoin(_poses(maps))
    origin, direction = _turned([F.col("o" + d) - F.col("m" + d) for d in XYZ]), _turned([F.col("d" + d) for d in XYZ])
    local = both.select(F.struct("map_id", "ray_id").alias("ray_id"), *[c.alias("o" + d) for c, d in zip(origin, XYZ, strict=True)], *[c.alias("d" + d) for c, d in zip(direction, XYZ, strict=True)])
    met = cast_rays(cells, local, resolution, max_range, ignore_unknown, sensor, by=["map_id"]).where("hit").join(local.select("ray_id", *["o" + d for d in XYZ]), "ray_id")
    met = met.withColumns({"c" + d: coordinate_of(F.col("k" + d), resolution) for d in XYZ})
    away = [F.col("c" + d) - F.col("o" + d) for d in XYZ]
    best = met.groupBy(F.col("ray_id.ray_id").alias("ray_id")).agg(F.min(F.struct(F.sqrt(dot(away, away)).alias("distance"), F.col("ray_id.map_id").alias("map_id"), "cx", "cy", "cz")).alias("b"))
    best = best.select("ray_id", "b.*").join(_poses(maps), "map_id")
    world = [c + F.col("m" + d) for c, d in zip(_turned([F.col("c" + d) for d in XYZ], back=True), XYZ, strict=True)]
    found = best.select("ray_id", F.lit(True).alias("hit"), "map_id", *[c.alias(d) for c, d in zip(world, XYZ, strict=True)], "distance")
    return rays.select("ray_id").join(found, "ray_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def search_maps(maps: DataFrame, cells: DataFrame, points: DataFrame, resolution: float, sensor: Sensor = Sensor()) -> DataFrame:
    """(pid, map_id, occupied, probability) of points in a collection; cells carry map_id, maps are ranked by it.

    The first map that holds the point occupied answers for ``map_id`` and ``occupied``; probability is the largest of all maps, 0.5 if none knows it.
    """
    keyed = with_keys(_into_maps(maps, points), resolution).select("pid", "map_id", *KEYS)
    hit = with_leaf(keyed, cells, F.col("log_odds"), "log_odds", by=["map_id"]).where("log_odds is not null")
    best = hit.groupBy("pid").agg(F.min(F.when(is_occupied(sensor), F.col("map_id"))).alias("map_id"), F.max(probability()).alias("p"))
    return points.select("pid").join(best, "pid", "left").select("pid", "map_id", F.col("map_id").isNotNull().alias("occupied"), F.coalesce("p", F.lit(0.5)).alias("probability"))


def occupied_centres(cells: DataFrame, resolution: float, sensor: Sensor = Sensor()) -> DataFrame:
    return cell_centres(cells.where(is_occupied(sensor)), resolution)


# Distance fields


def obstacles(cells: DataFrame, low: Sequence[int], high: Sequence[int], sensor: Sensor = Sensor(), unknown_too: bool = False) -> DataFrame:
    """Obstacle keys of a box of keys (ends included): occupied cells, or all that are not known free; ``surrounded`` by 26 others or not."""
    held = cells_inside(cells, low, high)
    if unknown_too:
        every = box_keys(cells, low, high)
        blocked = every.join(held.where(~is_occupied(sensor)).select(*KEYS), list(KEYS), "left_anti")
    else:
        blocked = held.where(is_occupied(sensor)).select(*KEYS)
    blocked = cut(blocked)
    offsets = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(v).alias("o" + d) for d, v in zip(XYZ, o, strict=True)]) for o in offsets])
    spread = blocked.select(F.explode(steps).alias("o"), *KEYS).select(*[(F.col("k" + d) + F.col("o.o" + d)).alias("k" + d) for d in XYZ])
    around = spread.join(blocked, list(KEYS), "left_semi").groupBy(*KEYS).agg(F.count("*").alias("n")).where("n = 26")
    return blocked.join(around.withColumn("surrounded", F.lit(True)), list(KEYS), "left").select(*KEYS, F.coalesce("surrounded", F.lit(False)).alias("surrounded"))


def box_keys(anyone: DataFrame, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    out = anyone.sparkSession.range(low[0], high[0] + 1).select(F.col("id").cast("int").alias("kx"))
    for k, a, b in zip(KEYS[1:], low[1:], high[1:], strict=True):
        out = out.withColumn(k, F.explode(F.sequence(F.lit(a), F.lit(b))))
    return out


def distance_field(cells: DataFrame, low: Sequence[int], high: Sequence[int], resolution: float, max_distance: float, sensor: Sensor = Sensor(), unknown_too: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """(kx, ky, kz, sqdist, ox, oy, oz) of every cell of a box (or of ``wanted`` keys in it): squared distance in cells to the closest obstacle, and that.

    Capped at (floor(max_distance / resolution) + 1)^2, without an obstacle. Surrounded obstacles are closest to themselves and to nothing else,
    so they stay out of the join.
    """
    from cloudweave.operators.neighbours import range_join

    reach = int(max_distance / resolution) + 1
    blocked = cut(obstacles(cells, low, high, sensor, unknown_too))
    seeds = blocked.where("not surrounded").select(F.struct(*KEYS).alias("pid"), *[F.col("k" + d).alias(d) for d in XYZ])
    deep = blocked.where("surrounded").select(F.struct(*KEYS).alias("_deep"))
    targets = (wanted if wanted is not None else box_keys(cells, low, high)).select(F.struct(*KEYS).alias("pid"), *[F.col("k" + d).alias(d) for d in XYZ])
    near = range_join(seeds, targets, float(reach), left_id="pid", right_id="pid").groupBy("j").agg(F.min(F.struct("d2", "i")).alias("m"))
    out = targets.join(near, targets["pid"] == near["j"], "left").join(deep, targets["pid"] == deep["_deep"], "left")
    closest = F.coalesce("_deep", "m.i")
    squared = F.when(F.col("_deep").isNotNull(), F.lit(0.0)).otherwise(F.coalesce("m.d2", F.lit(float(reach * reach))))
    return out.select(*[F.col(f"pid.{k}").alias(k) for k in KEYS], squared.cast("long").alias("sqdist"), *[closest[f"k{d}"].alias("o" + d) for d in XYZ])


def update_field(field: DataFrame, cells: DataFrame, changed: DataFrame, low: Sequence[int], high: Sequence[int], resolution: float, max_distance: float, sensor: Sensor = Sensor()) -> DataFrame:
    """The field after changes (kx, ky, kz): only cells within reach of a changed key, or of a neighbour whose seed state it may have changed, are computed anew."""
    from cloudweave.operators.neighbours import range_join

    reach = int(max_distance / resolution) + 1
    moved = changed.select(F.struct(*KEYS).alias("pid"), *[F.col("k" + d).alias(d) for d in XYZ])
    at = field.select(F.struct(*KEYS).alias("pid"), *[F.col("k" + d).alias(d) for d in XYZ])
    touched = cut(range_join(moved, at, float(reach) + 2).select(*[F.col(f"j.{k}").alias(k) for k in KEYS]).distinct())
    new = distance_field(cells, low, high, resolution, max_distance, sensor, wanted=touched)
    return field.join(touched, list(KEYS), "left_anti").unionByName(new)


def distance_at(field: DataFrame, points: DataFrame, resolution: float) -> DataFrame:
    """(pid, distance, sqdist) in metres and cells squared; -1 outside the field."""
    keyed = with_keys(points.select("pid", *XYZ), resolution, checked=False).select("pid", *KEYS)
    found = keyed.join(field, list(KEYS), "left")
    return found.select("pid", F.coalesce(F.sqrt(F.col("sqdist").cast("double")) * resolution, F.lit(-1.0)).alias("distance"), F.coalesce("sqdist", F.lit(-1)).alias("sqdist"))


def field_errors(field: DataFrame, cells: DataFrame, sensor: Sensor = Sensor()) -> DataFrame:
    """Field cells where distance 0 and an occupied cell don't go together; empty if the two are consistent."""
    state = field.join(cells.where(F.col("depth") == DEPTH).select(*KEYS, is_occupied(sensor).alias("s")), list(KEYS), "left")
    return state.where((F.col("sqdist") == 0) != F.coalesce("s", F.lit(False))).select(*KEYS)
