"""LAS files as a Spark data source named ``las``: point formats 0 to 3 of version 1.2.

Records have a fixed size, so a file is read by byte ranges of whole records, in as many partitions as asked for. Every write task makes
one complete file. Paths are opened by the executors themselves: they must be on a file system that all of them mount.

Writing keeps RGB (format 3) and counts the rows it has to reject instead of dropping them silently; its bounding boxes are those of the
written points. An empty file has a box of zeros.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "x double, y double, z double, intensity int, classification long, gpstime double, red int, green int, blue int"
COLUMNS = ("x", "y", "z", "intensity", "classification", "gpstime", "red", "green", "blue")
HEADER = struct.Struct("<4sHHIHH8sBB32s32sHHHIIBHI5I3d3d6d")
HEADER_SIZE = 227

_CORE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_TIME, _RGB = [("gpstime", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
RECORDS = {0: np.dtype(_CORE), 1: np.dtype(_CORE + _TIME), 2: np.dtype(_CORE + _RGB), 3: np.dtype(_CORE + _TIME + _RGB)}


@dataclass(frozen=True)
class LasHeader:
    version: tuple[int, int]
    point_format: int
    record_size: int
    points: int
    data_at: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]


def read_header(path: str) -> LasHeader:
    with open(path, "rb") as f:
        raw = f.read(HEADER_SIZE)
    if len(raw) < HEADER_SIZE or raw[:4] != b"LASF":
        raise ValueError(f"{path} is not a LAS file")
    v = HEADER.unpack(raw)
    point_format = v[16] & 0x3F
    if point_format not in RECORDS:
        raise ValueError(f"point format {point_format} is not supported")
    box = v[-6:]
    return LasHeader((v[7], v[8]), point_format, v[17], v[18], v[14], v[24:27], v[27:30], (box[1], box[3], box[5]), (box[0], box[2], box[4]))


def bounding_box(path: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    h = read_header(path)
    return h.low, h.high


def header_bytes(point_format: int, points: int, scale: float, offset: tuple, low: tuple, high: tuple, by_return: tuple = (0,) * 5) -> bytes:
    size = RECORDS[point_format].itemsize
    box = [v for a, b in zip(high, low, strict=True) for v in (a, b)]
    first = points if not any(by_return) else by_return[0]
    return HEADER.pack(b"LASF", 0, 0, 0, 0, 0, b"\0" * 8, 1, 2, b"cloudweave", b"cloudweave", 1, 2000, HEADER_SIZE, HEADER_SIZE, 0, point_format, size, points, first, *by_return[1:5], *(scale,) * 3, *offset, *box)


def decode(raw: bytes, h: LasHeader) -> dict[str, np.ndarray]:
    """Columns of raw records; what a format lacks is 0."""
    n = len(raw) // h.record_size
    kind = RECORDS[h.point_format]
    rows = np.frombuffer(raw, dtype=np.dtype({"names": kind.names, "formats": [kind.fields[k][0] for k in kind.names], "offsets": [kind.fields[k][1] for k in kind.names], "itemsize": h.record_size}), count=n)
    out = {d: rows[d.upper()] * s + o for d, s, o in zip("xyz", h.scale, h.offset, strict=True)}
    out["intensity"] = rows["intensity"].astype(np.int32)
    out["classification"] = rows["class"].astype(np.int64)
    for c, t in (("gpstime", np.float64), ("red", np.int32), ("green", np.int32), ("blue", np.int32)):
        out[c] = rows[c].astype(t) if c in kind.names else np.zeros(n, dtype=t)
    return out


def encode(columns: dict[str, np.ndarray], point_format: int, scale: float, offset: tuple[float, float, float]) -> tuple[bytes, np.ndarray]:
    """(raw records, kept): coordinates in steps of ``scale`` from the offset; rows out of the format's range are not kept."""
    whole = {d: np.rint((columns[d] - o) / scale) for d, o in zip("xyz", offset, strict=True)}
    kept = np.ones(len(columns["x"]), dtype=bool)
    for v in whole.values():
        kept &= np.isfinite(v) & (np.abs(v) < 2**31)
    kept &= (columns["intensity"] >= 0) & (columns["intensity"] < 2**16) & (columns["classification"] >= 0) & (columns["classification"] < 256)
    rows = np.zeros(int(kept.sum()), dtype=RECORDS[point_format])
    for d in "xyz":
        rows[d.upper()] = whole[d][kept]
    rows["intensity"], rows["class"] = columns["intensity"][kept], columns["classification"][kept]
    rows["bits"] = 0b001001  # first of one return
    for c in ("gpstime", "red", "green", "blue"):
        if c in rows.dtype.names:
            rows[c] = columns[c][kept]
    return rows.tobytes(), kept


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "*.las")))
    return sorted(glob.glob(path))


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    count: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rowsperpartition", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _files(self.path):
            n = read_header(path).points
            out += [_Range(path, at, min(self.rows, n - at)) for at in range(0, n, self.rows)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import pyarrow as pa

        if not partition.count:
            return
        h = read_header(partition.path)
        with open(partition.path, "rb") as f:
            f.seek(h.data_at + partition.first * h.record_size)
            left = partition.count
            while left:
                raw = f.read(min(left, 65_536) * h.record_size)
                if not raw:
                    raise ValueError(f"{partition.path} ends before its last record")
                columns = decode(raw, h)
                left -= len(columns["x"])
                yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in COLUMNS], names=list(COLUMNS))


@dataclass
class _Written(WriterCommitMessage):
    path: str
    temporary: str
    points: int
    rejected: int


class LasWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.point_format = int(options.get("pointformat", 3))
        self.scale = float(options.get("scale", 0.01))
        self.offset = tuple(float(options.get("offset" + d, 0.0)) for d in "xyz")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{context.partitionId():05d}.las")
        temporary = f"{name}.{context.taskAttemptId()}.tmp"
        low, high, points, rejected = np.full(3, np.inf), np.full(3, -np.inf), 0, 0
        with open(temporary, "wb") as f:
            f.write(b"\0" * HEADER_SIZE)
            block: list = []

            def flush() -> None:
                nonlocal points, rejected, low, high
                if not block:
                    return
                columns = {c: np.array([0 if r[k] is None else r[k] for r in block]) for k, c in enumerate(COLUMNS)}
                raw, kept = encode(columns, self.point_format, self.scale, self.offset)
                f.write(raw)
                points += int(kept.sum())
                rejected += int((~kept).sum())
                if kept.any():
                    whole = np.stack([np.rint((columns[d][kept] - o) / self.scale) * self.scale + o for d, o in zip("xyz", self.offset, strict=True)])
                    low, high = np.minimum(low, whole.min(axis=1)), np.maximum(high, whole.max(axis=1))
                block.clear()

            for r in rows:
                block.append(tuple(r[c] if c in r else 0 for c in COLUMNS))
                if len(block) == 65_536:
                    flush()
            flush()
            if not points:
                low, high = np.zeros(3), np.zeros(3)
            f.seek(0)
            f.write(header_bytes(self.point_format, points, self.scale, self.offset, tuple(low), tuple(high)))
        return _Written(name, temporary, points, rejected)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for old in _files(self.path):
                os.remove(old)
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.path)
        rejected = sum(m.rejected for m in messages if m is not None)
        with open(os.path.join(self.path, "_REJECTED"), "w") as f:
            f.write(str(rejected))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class LasSource(DataSource):
    """spark.dataSource.register(LasSource), then spark.read.format("las").load(path) and df.write.format("las").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LasReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LasWriter(self.options, overwrite)
