"""Geometry derived from the given tables.

Every building comes from one row of `orders`: a rectangle, or an L when the
key is a multiple of three; odd keys are stored in the opposite direction.
Coordinates are multiples of a quarter pixel, so sums and products are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.functions import rings
from ringfield.operators.geometry import explode_ring, settled

SIDE = 5000
FIELD_SIDE = 625


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table that comes as a single small file; larger tables keep their splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return spread(orders, "o_orderkey").selectExpr(
        "o_custkey % 16 AS image_id",
        "o_orderkey AS poly_id",
        "CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS is_l",
        "CAST((o_orderkey * 37) % 4900 AS DOUBLE) AS r0",
        "CAST((o_orderkey * 101 + o_custkey * 13) % 4900 AS DOUBLE) AS c0",
        "CAST(8 + o_custkey % 23 AS DOUBLE) AS h",
        "CAST(8 + o_orderkey % 29 AS DOUBLE) AS w",
        "o_custkey AS ck",
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, poly_id, ck, ring)"""
    b = buildings(spark, sf_dir)

    def corner(fi: int, fj: int) -> Column:
        return rings.point(F.col("r0") + F.col("h") * (fi * 0.5), F.col("c0") + F.col("w") * (fj * 0.5))

    rectangle = F.array(corner(0, 0), corner(0, 2), corner(2, 2), corner(2, 0))
    ell = F.array(corner(0, 0), corner(0, 2), corner(1, 2), corner(1, 1), corner(2, 1), corner(2, 0))
    ring = F.when(F.col("is_l") == 1, ell).otherwise(rectangle)
    drawn = settled(b.select("image_id", "poly_id", "ck", ring.alias("ring")))
    return drawn.withColumn("ring", F.when(F.col("poly_id") % 2 == 1, F.reverse("ring")).otherwise(F.col("ring")))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same buildings with every vertex moved by up to four pixels per axis."""
    ck, poly = F.col("ck"), F.col("poly_id")

    def moved(p: Column, k: Column) -> Column:
        di = ((ck * 7 + k * 3) % 33 - 16) * 0.25
        dj = ((poly * 5 + k * 11) % 33 - 16) * 0.25
        return rings.point(p["i"] + di, p["j"] + dj)

    return settled(polygons(spark, sf_dir).withColumn("ring", F.transform("ring", moved)))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_ring(polygons(spark, sf_dir))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 16).alias("image_id")).distinct()
    return ids.selectExpr(
        "image_id",
        f"{SIDE} AS height",
        f"{SIDE} AS width",
        "CAST(CASE WHEN image_id % 2 = 0 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS pixelsize",
        "CAST(500000 + image_id * 4096 AS DOUBLE) AS x0",
        "CAST(4000000 - image_id * 2048 AS DOUBLE) AS y0",
    )


def georeferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with a geotransform."""
    gt = "array(x0, pixelsize, 0.0D, y0, 0.0D, -pixelsize) AS gt"
    return images(spark, sf_dir).selectExpr("*", gt)


def view_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three views of every building, displaced by a multiple of its height class."""
    views = F.explode(
        F.array(*[F.struct(F.lit(v).alias("view_id"), F.lit(m).alias("m")) for v, m in (("ref", 0), ("mid", 1), ("rec", 2))])
    )
    lift = F.col("v.m") * (F.col("ck") % 8) * 0.25
    return (
        polygons(spark, sf_dir)
        .withColumn("v", views)
        .withColumn("ring", rings.shift(F.col("ring"), lift * 3, lift * 4))
        .select(F.col("v.view_id").alias("view_id"), "image_id", "poly_id", "ck", "ring")
    )


def field(spark: SparkSession, side: int = FIELD_SIDE) -> DataFrame:
    """A displacement field of two maps shared by all images."""
    cells = spark.range(2 * side * side).selectExpr(
        f"CAST(id DIV {side * side} AS INT) AS map_id",
        f"CAST((id DIV {side}) % {side} AS INT) AS i",
        f"CAST(id % {side} AS INT) AS j",
    )
    return cells.selectExpr(
        "map_id",
        "i",
        "j",
        "((i * 7 + j * 3 + map_id * 5) % 17 - 8) * 0.25D AS di",
        "((i * 5 + j * 11 + map_id * 3) % 17 - 8) * 0.25D AS dj",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding is an 8 x 8 tile: (image_id, band, i, j, value)."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS image_id", "label AS band", "posexplode(embedding) AS (pos, v)"
    ).selectExpr(
        "image_id",
        "band",
        "CAST(pos DIV 8 AS INT) AS i",
        "CAST(pos % 8 AS INT) AS j",
        "CAST(v AS DOUBLE) AS value",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat(event_type, '_', CAST(user_id % 10 AS STRING)) AS run_name", "ts", "event_id"
    )
