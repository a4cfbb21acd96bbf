"""Round trips of files, and the stream of scans."""

import numpy as np
from pyspark.sql import functions as F

from cloudweave.operators import occupancy as oc
from cloudweave.operators import voxels
from cloudweave.sources import cells as cell_files
from cloudweave.sources import las, text
from cloudweave.streaming.occupancy import occupancy_stream


def test_las_round_trip(spark, tmp_path):
    spark.dataSource.register(las.LasSource)
    rows = [(round(-3 + k * 0.01, 2), float(k), -2.5, k % 100, k % 7, k * 0.5, k % 65536, 2, 3) for k in range(2500)]
    df = spark.createDataFrame(rows, las.SCHEMA)
    df.write.format("las").mode("overwrite").save(str(tmp_path / "a"))
    back = spark.read.format("las").option("rowsPerPartition", "700").load(str(tmp_path / "a"))
    assert back.schema == df.schema
    assert sorted(tuple(round(v, 6) for v in r) for r in back.collect()) == sorted(rows)
    low, high = zip(*(las.bounding_box(f) for f in las._files(str(tmp_path / "a"))))
    assert np.allclose(np.min(low, axis=0), (-3, 0, -2.5)) and np.allclose(np.max(high, axis=0), (21.99, 2499, -2.5))


def test_las_counts_rejects_and_reads_empty_files(spark, tmp_path):
    spark.dataSource.register(las.LasSource)
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 70000, 1, 0.0, 0, 0, 0), (1.0, 1.0, 1.0, 7, 1, 0.0, 0, 0, 0)], las.SCHEMA)
    df.coalesce(1).write.format("las").mode("overwrite").save(str(tmp_path / "b"))
    assert (tmp_path / "b" / "_REJECTED").read_text() == "1"
    assert spark.read.format("las").load(str(tmp_path / "b")).count() == 1
    df.limit(0).coalesce(1).write.format("las").mode("overwrite").save(str(tmp_path / "c"))
    assert spark.read.format("las").load(str(tmp_path / "c")).count() == 0


def test_point_lists_and_matrices(spark, tmp_path):
    (tmp_path / "p.dat").write_text("1 2\n 3.5   -4\n\n5 6\n")
    points = text.read_points(spark, str(tmp_path / "p.dat"))
    assert [(r["x"], r["y"]) for r in points.orderBy("pid").collect()] == [(1, 2), (3.5, -4), (5, 6)]
    (tmp_path / "m.txt").write_text("# scores\n8 10 -4.5\nabc 12 6 # more\n18 -3 5.138\n")
    got = {(r["row"], r["col"]): r["score"] for r in text.read_matrix(spark, str(tmp_path / "m.txt")).collect()}
    assert got == {(0, 0): 8, (0, 1): 10, (0, 2): -4.5, (1, 0): 0, (1, 1): 12, (1, 2): 6, (2, 0): 18, (2, 1): -3, (2, 2): 5.138}


def test_map_collections(spark, tmp_path):
    (tmp_path / "maps.txt").write_text("# maps\nMAPNODEID cup\nMAPNODEFILENAME a.bt\nMAPNODEPOSE 1 2 3 4.56 67.3 1.24\n\nMAPNODEID glass\nMAPNODEFILENAME b.bt\nMAPNODEPOSE 0 0 0 0 0 0\n")
    maps = text.read_map_collection(spark, str(tmp_path / "maps.txt"))
    assert sorted(map(tuple, maps.collect())) == [("cup", "a.bt", 1, 2, 3, 4.56, 67.3, 1.24), ("glass", "b.bt", 0, 0, 0, 0, 0, 0)]
    text.map_collection_lines(maps).select("value").write.text(str(tmp_path / "again"))
    assert sorted(map(tuple, text.read_map_collection(spark, str(tmp_path / "again")).collect())) == sorted(map(tuple, maps.collect()))


def test_ply(spark, tmp_path):
    p = spark.createDataFrame([(1, 0.1, 0.1, 0.1), (2, 5.0, 5.0, 5.0)], "pid long, x double, y double, z double")
    text.write_ply(text.voxel_mesh(voxels.voxel_centroids(p, (1, 1, 1)), 2.0), str(tmp_path / "ply"))
    head, vertices, faces = (["\n".join(r["value"] for r in spark.read.text(str(tmp_path / "ply" / d)).collect())][0].split("\n") for d in ("header", "vertices", "faces"))
    assert "element vertex 16" in head and len(vertices) == 16 and len(faces) == 12
    assert sorted({int(v) for f in faces for v in f.split()[1:]}) == list(range(16))


def test_cells_on_disk(spark, tmp_path):
    c = spark.createDataFrame([(1, 2, 3, 16, 0.7), (4, 5, 6, 15, -0.2)], "kx int, ky int, kz int, depth int, log_odds double")
    cell_files.write_cells(c, str(tmp_path / "full"))
    assert oc.equal_trees(cell_files.read_cells(spark, str(tmp_path / "full")), c)
    cell_files.write_states(c, str(tmp_path / "states"))
    assert {(r["kx"], r["log_odds"]) for r in cell_files.read_states(spark, str(tmp_path / "states")).collect()} == {(1, 3.5), (4, -2.0)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{10 * s:02d}:00", s, 32768 + k, 32768, 32768, (s + k) % 3 == 0) for s in range(5) for k in range(4)]
    df = spark.createDataFrame(rows, "ts string, scan_id long, kx int, ky int, kz int, occupied boolean").withColumn("ts", F.to_timestamp("ts"))
    late = spark.createDataFrame([("2024-01-01 03:00:00", 99, 1, 1, 1, True)], "ts string, scan_id long, kx int, ky int, kz int, occupied boolean").withColumn("ts", F.to_timestamp("ts"))
    for n, part in enumerate((df.where("scan_id in (0, 2, 1)"), df.where("scan_id in (4, 3)"), late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = occupancy_stream(stream, "1 hour").writeStream.outputMode("update").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {}
    for r in spark.table("cells").orderBy("scan_id").collect():
        got[r["kx"]] = round(r["log_odds"], 6)
    want = oc.fold(df.select("kx", "ky", "kz", F.col("scan_id").alias("seq"), F.when(F.col("occupied"), 0.85).otherwise(-0.4).alias("u")))
    assert {k: v for k, v in got.items() if k != 1} == {r["kx"]: round(r["log_odds"], 6) for r in want.collect()}
