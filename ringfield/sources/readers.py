"""Polygon sources: wide CSV, annotation JSON, map ways, feature JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.functions import rings
from ringfield.operators.geometry import project_lonlat, settled, world_to_image
from ringfield.operators.skew import skew_join
from ringfield.operators.tiles import bucket, explode_buckets
from ringfield.sources.splits import json_records, lines, numbered

COCO_RECORD = "id BIGINT, image_id BIGINT, category_id BIGINT, segmentation ARRAY<ARRAY<DOUBLE>>, file_name STRING"
FEATURE_SCHEMA = "geometry STRUCT<coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>, properties MAP<STRING, STRING>"
# Fixed value: pixel size assumed for annotation files, which carry none.
ANNOTATION_PIXELSIZE = 0.3


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """Polygon parts of wide CSV files; the header line of each file is skipped. Ids come from file and byte offset."""
    text = lines(spark, path).where((F.col("start") > 0) & (F.col("line") != ""))
    return parse_wide_rows(numbered(text, "poly_id").select("poly_id", "file", "line"))


def parse_wide_rows(lines: DataFrame, skip: int = 3) -> DataFrame:
    """`line` text to ring rows: (other columns, part, ring).

    Values start after `skip` columns; tokens that are no number are dropped,
    `nan` pairs separate parts; pairs are (x, y) and turn into (row, column).
    A line is one record, so all of this is a narrow expression on it.
    """
    keys = [c for c in lines.columns if c != "line"]
    tokens = F.split("line", ",")
    wanted = F.slice(tokens, F.lit(skip + 1), F.greatest(F.size(tokens) - skip, F.lit(0)))
    numbers = F.filter(F.transform(wanted, lambda t: F.trim(t).try_cast("double")), lambda v: v.isNotNull())
    flat = settled(lines.select(*keys, numbers.alias("v")), "v")
    v = F.col("v")
    count = F.floor(F.size(v) / 2).cast("int")
    pairs = F.when(
        count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda n: rings.point(F.get(v, 2 * n + 1), F.get(v, 2 * n)))
    )
    return split_parts(settled(flat.select(*keys, pairs.alias("ring"))).where(F.col("ring").isNotNull()))


def split_parts(polygons: DataFrame) -> DataFrame:
    """A ring with NaN separators to one row per part; empty parts (a trailing separator) vanish."""
    keys = [c for c in polygons.columns if c != "ring"]
    ring = F.col("ring")
    stops = F.filter(
        F.transform(ring, lambda p, k: F.when(F.isnan(p["i"]) | F.isnan(p["j"]), k)), lambda k: k.isNotNull()
    )
    marked = settled(polygons.withColumn("_ends", F.concat(stops, F.array(F.size(ring)))), "_ends")
    ends = F.col("_ends")
    parts = F.transform(
        ends,
        lambda e, n: F.slice(
            ring,
            F.when(n == 0, F.lit(0)).otherwise(F.get(ends, n - 1) + 1) + 1,
            e - F.when(n == 0, F.lit(0)).otherwise(F.get(ends, n - 1) + 1),
        ),
    )
    kept = F.filter(parts, lambda p: F.size(p) > 0)
    return marked.select(*keys, F.posexplode(kept).alias("part", "ring"))


def coco_polygons(annotations: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Annotation rows (image_id, id, segmentation) to (image_id, poly_id, part, ring).

    With `images`, only annotations of listed images are kept.
    """
    kept = annotations if images is None else annotations.join(images.select("image_id").distinct(), "image_id", "left_semi")
    flat = kept.select("image_id", F.col("id").alias("poly_id"), F.posexplode("segmentation").alias("part", "s"))
    s = F.col("s")
    ring = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(s) / 2).cast("int") - 1), lambda n: rings.point(F.get(s, 2 * n + 1), F.get(s, 2 * n))
    )
    return flat.where(F.size(s) >= 2).select("image_id", "poly_id", "part", ring.alias("ring"))


def annotated_images(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Images that hold every listed category, with the pixel size assumed for this format."""
    wanted = categories.select(F.col("id").alias("category_id")).distinct()
    asked = wanted.agg(F.count(F.lit(1)).alias("_asked"))
    have = annotations.select("image_id", "category_id").distinct().join(wanted, "category_id", "left_semi")
    counted = have.groupBy("image_id").agg(F.count(F.lit(1)).alias("_have"))
    # `asked` is one row; its size is fixed.
    full = counted.join(F.broadcast(asked), F.col("_have") == F.col("_asked"))
    kept = images.select(F.col("id").alias("image_id"), "file_name").join(full, "image_id", "left_semi")
    return kept.withColumn("pixelsize", F.lit(ANNOTATION_PIXELSIZE))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, polygons) of annotation documents, each of which may be cut by many tasks.

    Annotations are the objects with an `image_id`, images those with a `file_name`, the others are categories.
    """
    found = json_records(spark, path).select(F.from_json("record", COCO_RECORD).alias("r")).select("r.*")
    annotations = found.where("image_id IS NOT NULL").drop("file_name")
    images = found.where("image_id IS NULL AND file_name IS NOT NULL").select("id", "file_name")
    categories = found.where("image_id IS NULL AND file_name IS NULL AND id IS NOT NULL").select("id")
    kept = annotated_images(images, annotations, categories)
    return kept, coco_polygons(annotations, kept)


def osm_ways_to_polygons(
    ways: DataFrame, nodes: DataFrame, images: DataFrame, tag: str, epsg: int, size: float = 4096.0
) -> DataFrame:
    """Ways carrying `tag` with a node inside an image, as rings in that image's pixels.

    `ways(way_id, tags MAP, refs ARRAY)`, `nodes(node_id, lon, lat)`, `images`
    with the extent x_min..y_max. Nodes meet extents by tile bucket, ways meet
    nodes by id; a way reaching two images appears in both.
    """
    tagged = ways.where(F.map_contains_key("tags", tag))
    refs = tagged.select("way_id", F.posexplode("refs").alias("k", "node_id"))
    placed = project_lonlat(nodes, epsg).select("node_id", "x", "y")
    points = skew_join(refs, placed, ["node_id"], ["way_id", "k"])
    extents = images.select(
        "image_id", F.col("y_min").alias("r0"), F.col("x_min").alias("c0"), F.col("y_max").alias("r1"), F.col("x_max").alias("c1")
    )
    reach = explode_buckets(extents, size)
    sent = points.select("way_id", "x", "y", bucket(F.col("y"), size).alias("bi"), bucket(F.col("x"), size).alias("bj"))
    near = skew_join(sent, reach, ["bi", "bj"], ["way_id", "x", "y"])
    inside = F.col("x").between(F.col("c0"), F.col("c1")) & F.col("y").between(F.col("r0"), F.col("r1"))
    hits = near.where(inside).select("image_id", "way_id").distinct()
    whole = points.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    joined = whole.join(hits, "way_id").join(images.select("image_id", "gt"), "image_id")
    gt = F.col("gt")
    ring = F.transform("p", lambda p: rings.point((p["y"] - gt[3]) / gt[5], (p["x"] - gt[0]) / gt[1]))
    return joined.select("image_id", F.col("way_id").alias("poly_id"), ring.alias("ring"))


def read_geojson(spark: SparkSession, path: str, image_id: int | None = None) -> DataFrame:
    """Features of collections, or one a line: (poly_id, world, props, extra_dims).

    A large file is cut by many tasks; ids come from file and byte offset. Text that is no JSON is an error.
    """
    found = numbered(json_records(spark, path, "features"), "poly_id")
    read = found.select("poly_id", F.from_json("record", FEATURE_SCHEMA, {"mode": "FAILFAST"}).alias("f")).select("poly_id", "f.*")
    parsed = parse_features(read)
    return parsed if image_id is None else parsed.withColumn("image_id", F.lit(image_id).cast("long"))


def parse_features(features: DataFrame) -> DataFrame:
    """First ring of each feature as (x, y) pairs; further dimensions are dropped and reported in `extra_dims`."""
    keys = [c for c in features.columns if c not in ("geometry", "properties")]
    first = F.get(F.col("geometry.coordinates"), F.lit(0))
    world = F.transform(first, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    extra = F.exists(first, lambda p: F.size(p) > 2)
    return features.where(first.isNotNull()).select(
        *keys, world.alias("world"), F.col("properties").alias("props"), extra.alias("extra_dims")
    )


def features_to_image(features: DataFrame, images: DataFrame) -> DataFrame:
    """World rings to image rings with the geotransform of `image_id`."""
    joined = features.join(images.select("image_id", "gt"), "image_id")
    gt = F.col("gt")
    ring = F.transform("world", lambda p: rings.point((p["y"] - gt[3]) / gt[5], (p["x"] - gt[0]) / gt[1]))
    return joined.withColumn("ring", ring).drop("world", "gt")


__all__ = [
    "annotated_images", "coco_polygons", "features_to_image", "osm_ways_to_polygons", "parse_features",
    "parse_wide_rows", "read_coco", "read_geojson", "read_wide_csv", "split_parts", "world_to_image",
]
