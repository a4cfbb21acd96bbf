"""Occupancy of a stream of scans.

Updates are keyed by tiles of cells. Each tile keeps its cells and the updates that the watermark doesn't cover yet; once it passes
a scan, the tile applies that scan's updates in order of scan number. A scan that is later than the watermark is dropped, as Spark drops late rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.operators.occupancy import KEYS, Sensor

TILE_BITS = 5


def with_tiles(updates: DataFrame, bits: int = TILE_BITS) -> DataFrame:
    return updates.withColumn("tile", F.concat_ws("/", *[F.shiftright(F.col(k), bits).cast("string") for k in KEYS]))


def occupancy_stream(updates: DataFrame, delay: str = "10 minutes", sensor: Sensor = Sensor()) -> DataFrame:
    """(tile, kx, ky, kz, log_odds, scan_id) of cells as they change, from a stream (ts, scan_id, kx, ky, kz, occupied).

    Output mode is update or append. State is one row a tile: cells and pending updates as parallel lists.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    low, high, hit, miss = sensor.low, sensor.high, sensor.hit, sensor.miss

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cells: dict = {}
        waiting: list = []
        if state.exists:
            kx, ky, kz, lo, px, py, pz, ps, pt, po = state.get
            cells = dict(zip(zip(kx, ky, kz, strict=True), lo, strict=True))
            waiting = list(zip(pt, ps, px, py, pz, po, strict=True))
        for p in parts:
            stamps = (p["ts"].astype("int64") // 1_000 if p["ts"].dtype == "datetime64[ns]" else p["ts"].astype("datetime64[us]").astype("int64")) // 1_000
            waiting += list(zip(stamps.tolist(), p["scan_id"].tolist(), p["kx"].tolist(), p["ky"].tolist(), p["kz"].tolist(), p["occupied"].tolist(), strict=True))
        mark = state.getCurrentWatermarkMs()
        ready = sorted(w for w in waiting if w[0] < mark)
        ready.sort(key=lambda w: w[1])
        waiting = [w for w in waiting if w[0] >= mark]
        changed: dict = {}
        for _, scan, x, y, z, occupied in ready:
            value = min(max(cells.get((x, y, z), 0.0) + (hit if occupied else miss), low), high)
            cells[x, y, z] = value
            changed[x, y, z] = (value, scan)
        columns = [[k[n] for k in cells] for n in range(3)] + [list(cells.values())]
        columns += [[w[n] for w in waiting] for n in (2, 3, 4, 1, 0, 5)]
        state.update(tuple(columns))
        if waiting:
            state.setTimeoutTimestamp(max(max(w[0] for w in waiting), mark) + 1)
        yield pd.DataFrame(
            {"tile": [key[0]] * len(changed), **{k: [c[n] for c in changed] for n, k in enumerate(KEYS)}, "log_odds": [v for v, _ in changed.values()], "scan_id": [s for _, s in changed.values()]}
        ).astype({"tile": "object", "kx": "int32", "ky": "int32", "kz": "int32", "log_odds": "float64", "scan_id": "int64"})

    tiled = with_tiles(updates.withWatermark("ts", delay)).select("tile", "ts", "scan_id", *KEYS, "occupied")
    lists = "kx array<int>, ky array<int>, kz array<int>, lo array<double>, px array<int>, py array<int>, pz array<int>, ps array<long>, pt array<long>, po array<boolean>"
    return tiled.groupBy("tile").applyInPandasWithState(step, "tile string, kx int, ky int, kz int, log_odds double, scan_id long", lists, "update", GroupStateTimeout.EventTimeTimeout)


def scan_counts(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events and their mean value for every window and type of a stream (ts, event_type, value)."""
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")
    )
