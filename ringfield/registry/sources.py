"""Catalogs, readers, writers and rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield import fixtures as X
from ringfield.functions import rings
from ringfield.operators import geometry as G
from ringfield.operators import tiles as T
from ringfield.registry.base import register, with_views
from ringfield.registry.joins import PATCHES
from ringfield.session import scratch_path
from ringfield.sources import catalog as C
from ringfield.sources import readers as Rd
from ringfield.sources import writers as Wr

IDS = ["image_id", "poly_id"]
CITY = "CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS fold"


@register(
    "tile_catalog",
    f"""SELECT c_name AS city, {CITY}, 0.3::DOUBLE AS pixelsize, CAST(c_custkey AS INT) AS number FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_name, {CITY}, 0.3, CAST(n.n AS INT) FROM customer JOIN range(1, 6) AS n(n) ON n.n <= 1 + c_custkey % 5 WHERE c_custkey % 3 = 1""",
)
def tile_catalog(spark, sf):
    """A third of the entries names one image, a third several, a third none."""
    cities = X.table(spark, sf, "customer").selectExpr(
        "c_name AS city", CITY, "0.3D AS pixelsize", "IF(c_custkey % 3 = 0, CAST(c_custkey AS INT), NULL) AS number",
        "IF(c_custkey % 3 = 1, sequence(1, CAST(1 + c_custkey % 5 AS INT)), NULL) AS numbers",
    )
    return C.tile_catalog(cities)


@register(
    "image_names",
    f"""SELECT c_custkey, concat(c_name, c_custkey) AS name, concat(c_name, '_', CASE WHEN c_custkey < 10 THEN concat('0', c_custkey) ELSE CAST(c_custkey AS VARCHAR) END) AS padded,
      concat(fold, '/images/', c_name, c_custkey, '.tif') AS path, concat(c_name, '/', c_name, '_', CASE WHEN c_custkey < 10 THEN concat('0', c_custkey) ELSE CAST(c_custkey AS VARCHAR) END, '_buildingCoord.csv') AS polygons,
      concat('alpha_', c_custkey, '_beta_0.5_gamma_', c_nationkey) AS params
    FROM (SELECT *, {CITY} FROM customer)""",
)
def image_names(spark, sf):
    c = X.table(spark, sf, "customer").selectExpr("*", CITY)
    city, number = F.col("c_name"), F.col("c_custkey")
    params = F.create_map(F.lit("gamma"), F.col("c_nationkey").cast("double"), F.lit("beta"), F.lit(0.5), F.lit("alpha"), number.cast("double"))
    return c.select(
        "c_custkey", C.image_name(city, number).alias("name"), C.image_name(city, number, 2).alias("padded"),
        C.image_path(F.col("fold"), city, number).alias("path"), C.city_path(city, number, "_buildingCoord.csv").alias("polygons"),
        C.params_text(params).alias("params"),
    )


@register(
    "wide_csv",
    with_views(
        """SELECT poly_id, CAST(0 AS INT) AS part, k, i, j FROM vertices WHERE poly_id % 2 = 0
        UNION ALL SELECT poly_id, CAST(CASE WHEN k < 2 THEN 0 ELSE 1 END AS INT), CAST(CASE WHEN k < 2 THEN k ELSE k - 2 END AS INT), i, j FROM vertices WHERE poly_id % 2 = 1""",
        "vertices",
    ),
)
def wide_csv(spark, sf):
    """Text lines with a junk token; odd polygons have a NaN pair after two vertices and one at the end."""
    p = X.polygons(spark, sf)
    texts = F.transform("ring", lambda v: F.concat_ws(",", v["j"].cast("string"), v["i"].cast("string")))
    odd = F.flatten(F.array(F.slice(texts, 1, 2), F.array(F.lit("nan,NaN")), F.slice(texts, F.lit(3), F.size(texts) - 2), F.array(F.lit("nan,nan"))))
    body = F.concat_ws(",", F.when(F.col("poly_id") % 2 == 1, odd).otherwise(texts))
    lines = p.select("poly_id", F.concat_ws(",", F.col("poly_id").cast("string"), F.lit("0,0"), F.lit("x"), body, F.lit("")).alias("line"))
    return G.explode_ring(Rd.parse_wide_rows(lines))


@register(
    "annotations",
    with_views(
        """SELECT image_id, poly_id, CAST(CASE WHEN k < 2 THEN 0 ELSE 1 END AS INT) AS part, CAST(CASE WHEN k < 2 THEN k ELSE k - 2 END AS INT) AS k, i, j
        FROM vertices WHERE image_id % 4 <> 3""",
        "vertices",
    ),
)
def annotations(spark, sf):
    """Annotation rows as JSON text, two segments each; images of one class lack a category."""
    p = X.polygons(spark, sf)
    flat = F.flatten(F.transform("ring", lambda v: F.array(v["j"], v["i"])))
    segments = F.array(F.slice(flat, 1, 4), F.slice(flat, F.lit(5), F.size(flat) - 4))
    row = F.struct(
        F.col("poly_id").alias("id"), "image_id", F.when(F.col("image_id") % 4 == 3, 100).otherwise(F.col("poly_id") % 2).alias("category_id"), segments.alias("segmentation")
    )
    text = p.select(F.to_json(row).alias("t"))
    rows = text.select(F.from_json("t", "id BIGINT, image_id BIGINT, category_id BIGINT, segmentation ARRAY<ARRAY<DOUBLE>>").alias("a")).select("a.*")
    images = X.images(spark, sf).selectExpr("image_id AS id", "concat(image_id, '.jpg') AS file_name")
    # Every image of the other classes holds both categories of its annotations.
    categories = rows.where("category_id < 100").select(F.col("category_id").alias("id")).distinct()
    return G.explode_ring(Rd.coco_polygons(rows, Rd.annotated_images(images, rows, categories)))


@register(
    "osm_ways",
    with_views(
        """SELECT m.image_id, v.poly_id, v.k, round((r * (ln(tan(pi() / 4 + radians(v.lat) / 2))) - 0) / -100 + 0, 3) AS i, round(r * radians(v.lon) / 100, 3) AS j
        FROM (SELECT *, 6378137.0::DOUBLE AS r, j / 4096 AS lon, -i / 4096 AS lat FROM vertices) v
        JOIN (SELECT 1 AS image_id, 0.0 AS c0, 60000.0 AS c1, -70000.0 AS r0, 0.0 AS r1 UNION ALL SELECT 2, 50000.0, 130000.0, -140000.0, -60000.0) m ON EXISTS
          (SELECT 1 FROM vertices w WHERE w.poly_id = v.poly_id AND v.r * radians(w.j / 4096) BETWEEN m.c0 AND m.c1
             AND v.r * ln(tan(pi() / 4 + radians(-w.i / 4096) / 2)) BETWEEN m.r0 AND m.r1) WHERE v.poly_id % 3 <> 1""",
        "vertices",
    ).replace("SELECT m.image_id,", "SELECT CAST(m.image_id AS BIGINT) AS image_id,"),
)
def osm_ways(spark, sf):
    """Buildings as ways over nodes; a third lacks the tag; two images overlap. Pixels of 100 m."""
    p = X.polygons(spark, sf)
    nodes = G.explode_ring(p).select(
        (F.col("poly_id") * 8 + F.col("k")).alias("node_id"), (F.col("j") / 4096).alias("lon"), (-F.col("i") / 4096).alias("lat")
    )
    tags = F.when(F.col("poly_id") % 3 == 1, F.create_map(F.lit("highway"), F.lit("yes"))).otherwise(F.create_map(F.lit("building"), F.lit("yes")))
    refs = F.transform("ring", lambda v, k: F.col("poly_id") * 8 + k)
    ways = p.select(F.col("poly_id").alias("way_id"), tags.alias("tags"), refs.alias("refs"))
    boxes = [(1, 0.0, 60000.0, -70000.0, 0.0), (2, 50000.0, 130000.0, -140000.0, -60000.0)]
    one = X.table(spark, sf, "region").where("r_regionkey = 0")
    listed = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("image_id"), *[F.lit(v).alias(n) for n, v in zip(("x_min", "x_max", "y_min", "y_max"), b)]) for a, *b in boxes]))
    images = one.select(listed.alias("m")).select("m.*").withColumn("gt", F.array(*[F.lit(v) for v in (0.0, 100.0, 0.0, 0.0, 0.0, -100.0)]))
    out = Rd.osm_ways_to_polygons(ways, nodes, images, "building", 3857)
    return G.explode_ring(out).select(*IDS, "k", (F.round("i", 3) + 0.0).alias("i"), (F.round("j", 3) + 0.0).alias("j"))


@register(
    "geojson_features",
    with_views(
        """SELECT v.image_id, v.poly_id, v.k, v.i, v.j, CAST(b.h AS VARCHAR) AS height, v.poly_id % 2 = 1 AS extra_dims FROM vertices v JOIN buildings b USING (image_id, poly_id)""",
        "vertices",
    ),
)
def geojson_features(spark, sf):
    """Feature text in world coordinates, odd ones with a third dimension, read back to pixels."""
    m = X.georeferenced(spark, sf)
    h = (8 + F.col("ck") % 23).cast("double").cast("string")
    p = X.polygons(spark, sf).join(m.select("image_id", "gt"), "image_id")
    odd = F.col("poly_id") % 2 == 1
    world = F.transform(Wr.world_ring(F.col("ring"), F.col("gt")), lambda v: F.when(odd, F.array(v["x"], v["y"], F.lit(7.0))).otherwise(F.array(v["x"], v["y"])))
    geometry = F.struct(F.array(world).alias("coordinates"))
    text = p.select(*IDS, F.to_json(F.struct(geometry.alias("geometry"), F.create_map(F.lit("HEIGHT"), h).alias("properties"))).alias("t"))
    features = text.select(*IDS, F.from_json("t", Rd.FEATURE_SCHEMA).alias("f")).select(*IDS, "f.geometry", "f.properties")
    out = Rd.features_to_image(Rd.parse_features(features), m)
    return G.explode_ring(out.select(*IDS, F.col("props")["HEIGHT"].alias("height"), "extra_dims", "ring"))


@register(
    "feature_wkt",
    with_views(
        """SELECT image_id, poly_id, concat('POLYGON ((', string_agg(concat(CAST(m.x0 + m.pixelsize * v.j AS VARCHAR), ' ', CAST(m.y0 - m.pixelsize * v.i AS VARCHAR)), ',' ORDER BY v.k), '))') AS wkt
        FROM vertices v JOIN images m USING (image_id) GROUP BY image_id, poly_id""",
        "vertices", "images",
    ),
)
def feature_wkt(spark, sf):
    return Wr.feature_rows(X.polygons(spark, sf), X.georeferenced(spark, sf)).select(*IDS, "wkt")


@register(
    "property_fields",
    "SELECT * FROM (VALUES ('HEIGHT', 'real'), ('LEVELS', 'integer'), ('NAME', 'string'), ('NOTE', 'integer')) AS t(name, kind) WHERE EXISTS (SELECT 1 FROM orders)",
)
def property_fields(spark, sf):
    """Keys appear in different polygons; NOTE is null where it first appears."""
    b = X.buildings(spark, sf)
    h, name = (F.col("h") + 0.5).cast("string"), F.concat(F.lit("b"), F.col("poly_id"))
    props = F.map_from_arrays(
        F.array(F.lit("HEIGHT"), F.when(F.col("poly_id") % 2 == 0, "LEVELS").otherwise("NAME"), F.lit("NOTE")),
        F.array(h, F.when(F.col("poly_id") % 2 == 0, F.col("ck").cast("string")).otherwise(name), F.when(F.col("poly_id") > 10, name)),
    )
    return Wr.property_fields(b.select("poly_id", props.alias("props")))


@register(
    "sharded_write",
    with_views("SELECT fold, image_id, count(*) AS records, true AS within_limit FROM (SELECT *, CASE WHEN image_id % 4 = 0 THEN 'val' ELSE 'train' END AS fold FROM buildings) GROUP BY fold, image_id", "buildings"),
)
def sharded_write(spark, sf):
    """Written to the shared folder and read back with the size of every file."""
    path = scratch_path(spark, "sharded")
    rows = X.buildings(spark, sf).select(*IDS, F.when(F.col("image_id") % 4 == 0, "val").otherwise("train").alias("fold"))
    Wr.write_sharded(rows, path, 100, ("fold", "image_id"), {"disp_max_abs_value": 4, "downsampling_factors": [1, 2, 4, 8]})
    back = spark.read.parquet(f"{path}/records").withColumn("file", F.input_file_name())
    files = back.groupBy("fold", "image_id", "file").agg(F.count("*").alias("n"))
    folds = files.groupBy("fold", F.col("image_id").cast("long").alias("image_id"))
    return folds.agg(F.sum("n").alias("records"), (F.max("n") <= 100).alias("within_limit"))


@register(
    "oversample",
    with_views("SELECT image_id, poly_id, f AS ds_fac, CAST(c.n AS INT) AS copy FROM (SELECT *, CAST(power(2, poly_id % 5) AS INT) AS f FROM buildings) JOIN range(1, 65) AS c(n) ON c.n <= CASE f WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 4 THEN 16 WHEN 8 THEN 64 ELSE 0 END", "buildings"),
)
def oversample(spark, sf):
    b = X.buildings(spark, sf).selectExpr(*IDS, "CAST(power(2, poly_id % 5) AS INT) AS ds_fac")
    return C.oversample(b, {1: 1, 2: 4, 4: 16, 8: 64})


@register(
    "union_datasets",
    "SELECT o_orderkey AS id, 'orders' AS dataset FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer UNION ALL SELECT event_id, 'events' FROM events",
)
def union_datasets(spark, sf):
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id"}
    return C.union_datasets({name: X.table(spark, sf, name).select(F.col(key).alias("id")) for name, key in keys.items()})


@register(
    "rounds",
    with_views(
        """SELECT m.image_id, v.poly_id, v.k, v.i, v.j, v.poly_id IS NULL AS missing FROM images m LEFT JOIN (SELECT * FROM pred WHERE image_id % 3 <> 0) v ON v.image_id = m.image_id""",
        "pred", "images",
    ),
)
def rounds(spark, sf):
    """A stored version read back for all images; a version never written gives None."""
    path = scratch_path(spark, "rounds")
    p = X.predicted(spark, sf).where("image_id % 3 <> 0").select(*IDS, "ring")
    C.save_round(p, path, "aligned_gt_polygons")
    if C.load_round(spark, path, "aligned_gt_polygons_1") is not None:
        raise AssertionError("a missing version must read as None")
    rows = C.load_round(spark, path, "aligned_gt_polygons", X.images(spark, sf))
    out = rows.select(*IDS, "missing", F.posexplode_outer("ring").alias("k", "p"))
    return out.select(*IDS, "k", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "missing")


@register("pending_images", "SELECT DISTINCT c_custkey AS image_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def pending_images(spark, sf):
    images = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id"))
    return C.pending(images, X.table(spark, sf, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("image_id")))


@register(
    "gathered_results",
    with_views("SELECT image_id, count(*) AS n FROM buildings WHERE image_id % 2 = 0 GROUP BY image_id", "buildings"),
)
def gathered_results(spark, sf):
    """Two folders of results; the pattern keeps one kind of file only."""
    path = scratch_path(spark, "results")
    b = X.buildings(spark, sf).select(*IDS)
    for kind, rows in (("accuracy", b.where("image_id % 2 = 0")), ("iou", b.where("image_id % 2 = 1"))):
        codec = "zstd" if kind == "accuracy" else "snappy"
        rows.write.option("compression", codec).mode("overwrite").parquet(f"{path}/{kind}")
    return C.gather_results(spark, path, ".zstd.parquet", "part").groupBy("image_id").agg(F.count("*").alias("n"))


@register(
    "latest_run",
    with_views("SELECT run_name, max_by(concat(run_name, ' | ', event_id), ts) AS path, max(ts) AS ts FROM runs GROUP BY run_name", "runs"),
)
def latest_run(spark, sf):
    r = X.runs(spark, sf)
    return C.latest_run(r.select("run_name", "ts", F.concat_ws(" | ", "run_name", F.col("event_id").cast("string")).alias("path")))


@register(
    "newest_run",
    with_views("SELECT run_name, date_trunc('second', ts) AS ts FROM runs ORDER BY date_trunc('second', ts) DESC, run_name DESC LIMIT 1", "runs"),
)
def newest_run(spark, sf):
    """Run folders named `name | timestamp`, over all names."""
    r = X.runs(spark, sf)
    paths = r.select(F.concat(F.lit("runs/"), "run_name", F.lit(" | "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("path"))
    return C.newest_run(C.parse_run_paths(paths)).select("run_name", "ts")


@register(
    "export_padded",
    with_views(
        """SELECT image_id, patch_id, CAST(m.m AS INT) AS map_id, count(*) + 1 AS slots, CAST((count(*) + 1) * (max(n) + 1) AS BIGINT) AS places, sum(n)::BIGINT AS filled,
          sum(si - n * r0 + n * 2 * greatest(m.m, 0)) AS i_sum
        FROM (SELECT DISTINCT v.image_id, v.poly_id, p.patch_id, p.r0 FROM vertices v JOIN patches p ON v.image_id = p.image_id AND v.i BETWEEN p.r0 AND p.r1 AND v.j BETWEEN p.c0 AND p.c1)
        JOIN (SELECT image_id, poly_id, count(*) AS n, sum(i) AS si FROM vertices GROUP BY image_id, poly_id) USING (image_id, poly_id)
        CROSS JOIN (VALUES (-1), (0), (1)) AS m(m) GROUP BY image_id, patch_id, m.m""",
        "vertices", "images", patches=PATCHES,
    ),
)
def export_padded(spark, sf):
    """Sizes and sums of the padded batches; map 1 is moved down by two pixels."""
    p = X.polygons(spark, sf).select(*IDS, "ring")
    touching = T.polygons_touching_patches(p, T.patch_grid(X.images(spark, sf), 100, 220))
    maps = F.explode(F.array(F.lit(0), F.lit(1)))
    moved = p.withColumn("map_id", maps).withColumn("ring", rings.shift(F.col("ring"), F.col("map_id") * 2.0, F.lit(0.0)))
    out = Wr.export_padded(touching, moved)
    real = F.filter("ring", lambda p: ~F.isnan(p["i"]))
    rows = out.select(
        "image_id", "patch_id", "map_id", F.size("ring").alias("length"), F.size(real).alias("n"),
        F.aggregate(real, F.lit(0.0), lambda t, p: t + p["i"]).alias("i"),
    )
    return rows.groupBy("image_id", "patch_id", "map_id").agg(
        F.count("*").alias("slots"), F.sum("length").alias("places"), F.sum("n").alias("filled"), F.sum("i").alias("i_sum")
    )


@register(
    "pad_rings",
    with_views(
        """SELECT v.image_id, v.poly_id, CAST(s.n AS INT) AS k, i, j FROM vertices v JOIN boxes b USING (image_id, poly_id) JOIN range(0, 8) AS s(n) ON v.k = least(s.n, b.n - 1)""", "boxes"
    ),
)
def pad_rings(spark, sf):
    return G.explode_ring(Wr.pad_rings(X.polygons(spark, sf).drop("ck"), 8))


@register(
    "convert_round",
    with_views("SELECT image_id, count(*) AS n FROM buildings GROUP BY image_id", "buildings"),
)
def convert_round(spark, sf):
    """A stored version written as features; the missing one is skipped."""
    path = scratch_path(spark, "convert")
    m = X.georeferenced(spark, sf)
    p = X.polygons(spark, sf).select(*IDS, "ring", F.create_map(F.lit("ID"), F.col("poly_id").cast("string")).alias("props"))
    C.save_round(p, path, "gt_polygons")
    done = [Wr.convert_round(spark, path, s, m, f"{path}/out-{s}") for s in ("gt_polygons", "noisy_gt_polygons")]
    if done != [True, False]:
        raise AssertionError(done)
    rows = spark.read.schema("image_id BIGINT, poly_id BIGINT, wkt STRING, props MAP<STRING, STRING>").json(f"{path}/out-gt_polygons/features")
    return rows.where(F.col("wkt").startswith("POLYGON")).groupBy("image_id").agg(F.count("*").alias("n"))
