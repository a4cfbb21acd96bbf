"""Text formats: point lists, cluster matrices, residual lists, meshes, map collections and assignment matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.functions.geometry import XYZ
from cloudweave.operators.ranking import ranked


def read_points(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """pid, x, y of a file of whitespace-separated pairs, one a line; pid is the order of the lines."""
    numbers = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(numbers[0].cast("double").alias("x"), numbers[1].cast("double").alias("y"))
    rows = rows.withColumn("pid", F.monotonically_increasing_id()).select("pid", "x", "y")
    if most is not None and rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} points")
    return rows


def checked_arguments(points: int, path: str, clusters: int, most: int = 10_000) -> tuple[int, str, int]:
    """The limits of the point-list clustering tool."""
    if not 0 < points <= most:
        raise ValueError(f"the number of points must be 1 to {most}")
    if not path:
        raise ValueError("a file is needed")
    if not 0 < clusters <= points:
        raise ValueError("the number of clusters can't exceed that of points")
    return points, path, clusters


def cluster_matrices(points: DataFrame, clusters: DataFrame, wanted: int | None = None) -> DataFrame:
    """One text row a cluster: a matrix ``clusterN = [x y; x y]`` in order of pid. wanted: an error if there are other than so many clusters."""
    named = points.join(clusters, "pid").where("cluster > 0")
    rows = named.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pid", "x", "y"))).alias("p"))
    if wanted is not None and rows.count() != wanted:
        raise ValueError("the number of clusters differs from the wanted one")
    body = F.array_join(F.transform("p", lambda r: F.format_string("%f %f", r["x"], r["y"])), "; ")
    return rows.select("cluster", F.concat(F.lit("cluster"), F.col("cluster").cast("string"), F.lit(" = ["), body, F.lit("];")).alias("value"))


def residual_lines(found: DataFrame) -> DataFrame:
    """(n, value): a first line with count and RMS, then one residual a line with four decimals, in order of the pair."""
    head = found.agg(F.count("*").alias("c"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("r")).select(F.lit(0).cast("long").alias("n"), F.format_string("%d %.4f", "c", F.coalesce("r", F.lit(0.0))).alias("value"))
    lines = ranked(found.select("i", "j", "residual"), [F.col("i"), F.col("j")], "n").select("n", F.format_string("%.4f", "residual").alias("value"))
    return head.unionByName(lines)


def cuboid_corners(low: Sequence[Column], high: Sequence[Column]) -> Column:
    """The eight corners of a box, x fastest."""
    return F.array(*[F.struct(*[(high if k >> n & 1 else low)[n].alias(d) for n, d in enumerate(XYZ)]) for k in range(8)])


#: Corners of the six faces, seen from outside.
FACES = ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))


def voxel_mesh(centres: DataFrame, side: float) -> DataFrame:
    """(vx, vy, vz, corners, faces) of a cube around each voxel centroid."""
    half = side / 2
    corners = cuboid_corners([F.col(d) - half for d in XYZ], [F.col(d) + half for d in XYZ])
    return centres.select("vx", "vy", "vz", corners.alias("corners"), F.array(*[F.array(*[F.lit(v) for v in f]) for f in FACES]).alias("faces"))


def write_ply(mesh: DataFrame, path: str) -> None:
    """Cubes as an ASCII PLY in three parts: a header file, and folders of vertex and face lines in the same order of voxels.

    Concatenated (header, vertices, faces) they are one PLY file. Face numbers follow from a count of the cubes before each partition.
    """
    cubes = mesh.count()
    head = ["ply", "format ascii 1.0", f"element vertex {8 * cubes}", "property float x", "property float y", "property float z", f"element face {6 * cubes}", "property list uchar int vertex_indices", "end_header"]
    spark = mesh.sparkSession
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    from cloudweave.operators.iteration import cut

    ordered = cut(mesh.repartitionByRange("vx", "vy", "vz").sortWithinPartitions("vx", "vy", "vz").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id() % (1 << 33)))
    before, start = {}, 0
    for r in ordered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        before[r["part"]], start = start, start + r["n"]
    table = F.create_map(*[F.lit(v) for p in sorted(before) for v in (p, before[p])]) if before else F.create_map(F.lit(0), F.lit(0))
    vertices = ordered.select(F.array_join(F.transform("corners", lambda c: F.format_string("%f %f %f", c["x"], c["y"], c["z"])), "\n").alias("value"))
    vertices.write.mode("overwrite").text(f"{path}/vertices")
    cube = (table[F.col("part")] + F.col("row")) * 8
    faces = ordered.withColumn("cube", cube).select(F.array_join(F.transform("faces", lambda f: F.concat(F.lit("4 "), F.array_join(F.transform(f, lambda v: (v + F.col("cube")).cast("string")), " "))), "\n").alias("value"))
    faces.write.mode("overwrite").text(f"{path}/faces")


def read_map_collection(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, file, x, y, z, roll, pitch, yaw) from tagged lines; lines that start with # are skipped, every MAPNODEID starts a map.

    Collections are small files: one task reads each.
    """
    lines = F.filter(F.transform(F.split("value", "\n"), lambda s: F.trim(s)), lambda s: ~s.startswith("#") & (s != ""))
    words = F.flatten(F.transform(lines, lambda s: F.split(s, r"\s+")))
    whole = spark.read.text(path, wholetext=True).select(F.array_join(words, " ").alias("t"))
    parts = whole.select(F.posexplode(F.split("t", "MAPNODEID:? ")).alias("k", "p")).where("k > 0")
    pose = F.split(F.trim(F.regexp_extract("p", r"MAPNODEPOSE:? ([-+.eE0-9 ]+)", 1)), " ")
    return parts.select(
        F.trim(F.regexp_extract("p", r"^(\S+)", 1)).alias("map_id"), F.regexp_extract("p", r"MAPNODEFILENAME:? (\S+)", 1).alias("file"),
        *[pose[k].cast("double").alias(c) for k, c in enumerate((*XYZ, "roll", "pitch", "yaw"))],
    )


def map_collection_lines(maps: DataFrame) -> DataFrame:
    """(map_id, value): the tagged lines of each map."""
    pose = F.concat_ws(" ", *[F.col(c).cast("string") for c in (*XYZ, "roll", "pitch", "yaw")])
    return maps.select("map_id", F.concat(F.lit("MAPNODEID "), F.col("map_id").cast("string"), F.lit("\nMAPNODEFILENAME "), F.col("file"), F.lit("\nMAPNODEPOSE "), pose).alias("value"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, score) of a text matrix: # starts a comment, tokens that are no numbers count as 0. More rows than columns are refused."""
    text = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", "\n"), lambda s: F.trim(F.regexp_replace(s, "#.*", ""))), lambda s: s != "").alias("rows"))
    cells = text.select(F.posexplode("rows").alias("row", "line")).select("row", F.posexplode(F.split("line", r"\s+")).alias("col", "token"))
    out = cells.select("row", "col", F.coalesce(F.expr("try_cast(token as double)"), F.lit(0.0)).alias("score"))
    size = out.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    if size["r"] is not None and size["r"] > size["c"]:
        raise ValueError("there are more rows than columns")
    return out
