"""Rings, edges, boxes and coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield import fixtures as X
from ringfield.functions import rings
from ringfield.operators import geometry as G
from ringfield.registry.base import register, uniform_sql, with_views

IDS = ["image_id", "poly_id"]


@register("edges", with_views("SELECT image_id, poly_id, k, i1, j1, i2, j2 FROM ring_edges", "ring_edges"))
def edges(spark, sf):
    return G.edges(X.polygons(spark, sf).drop("ck"))


@register("ring_area", with_views("SELECT image_id, poly_id, area FROM areas", "areas"))
def ring_area(spark, sf):
    return G.ring_area(X.polygons(spark, sf)).select(*IDS, "area")


@register(
    "orientation",
    with_views("SELECT image_id, poly_id, sum(i1 * j2 - i2 * j1) > 0 AS clockwise FROM ring_edges GROUP BY image_id, poly_id", "ring_edges"),
)
def orientation(spark, sf):
    return G.orientation(X.polygons(spark, sf)).select(*IDS, "clockwise")


@register(
    "orient_clockwise",
    with_views(
        """SELECT v.image_id, v.poly_id, CAST(CASE WHEN t.turn > 0 THEN v.k ELSE t.n - 1 - v.k END AS INT) AS k, v.i, v.j
        FROM vertices v JOIN (SELECT image_id, poly_id, sum(i1 * j2 - i2 * j1) AS turn, count(*) AS n
          FROM ring_edges GROUP BY image_id, poly_id) t USING (image_id, poly_id)""",
        "ring_edges", once=True,
    ),
)
def orient_clockwise(spark, sf):
    return G.explode_ring(G.orient(X.polygons(spark, sf).drop("ck")))


FIT = """SELECT image_id, poly_id,
  CAST(round_even((r0 + r1) / 2, 0) AS BIGINT) - hr AS r0, CAST(round_even((c0 + c1) / 2, 0) AS BIGINT) - hc AS c0,
  CAST(round_even((r0 + r1) / 2, 0) AS BIGINT) + hr AS r1, CAST(round_even((c0 + c1) / 2, 0) AS BIGINT) + hc AS c1
FROM (SELECT *, {hr} AS hr, {hc} AS hc FROM (SELECT *, CAST(ceil((r1 - r0) * {s}::DOUBLE / 2) AS BIGINT) + {m} AS a,
  CAST(ceil((c1 - c0) * {s}::DOUBLE / 2) AS BIGINT) + {m} AS b FROM boxes))"""


@register("fitted_box", with_views(FIT.format(hr="a", hc="b", s="1.5", m=2), "boxes"))
def fitted_box(spark, sf):
    return G.fitted_box(X.polygons(spark, sf), 1.5, 2).select(*IDS, "r0", "c0", "r1", "c1")


@register("fitted_square", with_views(FIT.format(hr="greatest(a, b)", hc="greatest(a, b)", s="1.0", m=0), "boxes"))
def fitted_square(spark, sf):
    return G.fitted_box(X.polygons(spark, sf), square=True).select(*IDS, "r0", "c0", "r1", "c1")


@register(
    "box_operations",
    with_views(
        """SELECT image_id, poly_id, r0 + 2 AS pad_r0, c0 + 2 AS pad_c0, r1 - 2 AS pad_r1, c1 - 2 AS pad_c1,
          r0 - 3 AS out_r0, c1 + 3 AS out_c1, CAST(floor(r0) AS BIGINT) AS int_r0, CAST(ceil(c1) AS BIGINT) AS int_c1,
          greatest(r0, 100.0) AS clip_r0, least(c1, 4000.0) AS clip_c1, (r1 - r0) * (c1 - c0) AS box_area,
          CAST(floor((r1 - r0) / 2 - 2.5) AS BIGINT) AS mid_r0, CAST(ceil((c1 - c0) / 2 + 3.5) AS BIGINT) AS mid_c1
        FROM (SELECT image_id, poly_id, min(i) AS r0, min(j) AS c0, max(i) AS r1, max(j) AS c1 FROM pred GROUP BY image_id, poly_id)""",
        "pred",
    ),
)
def box_operations(spark, sf):
    b = X.predicted(spark, sf).select(*IDS, rings.box(F.col("ring")).alias("b")).select(*IDS, "b.*")
    pad, out, whole = G.box_pad(2.0), G.box_margin(3.0), G.box_to_int()
    clip = G.box_clip(F.lit(100.0), F.lit(0.0), F.lit(5000.0), F.lit(4000.0))
    middle = G.centred_box(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0"), 5, 7)
    return b.select(
        *IDS, *[pad[c].alias(f"pad_{c}") for c in pad], out["r0"].alias("out_r0"), out["c1"].alias("out_c1"),
        whole["r0"].alias("int_r0"), whole["c1"].alias("int_c1"), clip["r0"].alias("clip_r0"), clip["c1"].alias("clip_c1"),
        G.box_area().alias("box_area"), middle["r0"].alias("mid_r0"), middle["c1"].alias("mid_c1"),
    )


@register(
    "ring_centre",
    with_views(
        """SELECT image_id, poly_id, ci, cj, CAST(ceil(ci - 110) AS BIGINT) AS r0, CAST(ceil(cj - 110) AS BIGINT) AS c0,
          CAST(ceil(ci + 110) AS BIGINT) AS r1, CAST(ceil(cj + 110) AS BIGINT) AS c1
        FROM (SELECT image_id, poly_id, sum(i) / count(*) AS ci, sum(j) / count(*) AS cj FROM vertices GROUP BY image_id, poly_id)""",
        "vertices",
    ),
)
def ring_centre(spark, sf):
    return G.centre_patch(G.ring_centre(X.polygons(spark, sf)), 220).drop("ck", "ring")


@register(
    "to_box_space",
    with_views(
        "SELECT v.image_id, v.poly_id, v.k, v.i - b.r0 AS i, v.j - b.c0 AS j FROM vertices v JOIN boxes b USING (image_id, poly_id)",
        "boxes",
    ),
)
def to_box_space(spark, sf):
    p = X.polygons(spark, sf)
    b = rings.box(F.col("ring"))
    boxed = p.withColumns({"r0": b["r0"], "c0": b["c0"]})
    return G.to_box_space(G.explode_ring(boxed)).select(*IDS, "k", "i", "j")


@register(
    "rescale_levels",
    with_views(
        """SELECT v.image_id, v.poly_id, v.k, v.i * (1 / (4 * 0.25::DOUBLE / m.pixelsize)) AS i,
          v.j * (1 / (4 * 0.25::DOUBLE / m.pixelsize)) AS j
        FROM vertices v JOIN images m USING (image_id)""",
        "vertices", "images",
    ),
)
def rescale_levels(spark, sf):
    v = X.vertices(spark, sf).join(X.images(spark, sf).select("image_id", "pixelsize"), "image_id")
    return G.rescale(v, 1 / G.level_factor(4, F.col("pixelsize"), 0.25)).select(*IDS, "k", "i", "j")


@register("swap_coords", with_views("SELECT image_id, poly_id, k, j AS i, i AS j FROM vertices", "vertices"))
def swap_coords(spark, sf):
    return G.swap_coords(X.vertices(spark, sf)).select(*IDS, "k", "i", "j")


@register(
    "snap_int",
    with_views("SELECT image_id, poly_id, k, round_even(i, 0) + 0.0 AS i, round_even(j, 0) + 0.0 AS j FROM pred", "pred"),
)
def snap_int(spark, sf):
    v = G.snap_int(G.explode_ring(X.predicted(spark, sf)))
    return v.select(*IDS, "k", (F.col("i") + 0.0).alias("i"), (F.col("j") + 0.0).alias("j"))


@register(
    "strip_closing_vertex",
    with_views(
        """SELECT image_id, poly_id, k, i, j FROM (
          SELECT *, first_value(i) OVER w AS fi, first_value(j) OVER w AS fj, max(k) OVER (PARTITION BY image_id, poly_id) AS m FROM
            (SELECT image_id, poly_id, k, i, j FROM vertices UNION ALL
             SELECT image_id, poly_id, CASE WHEN is_l = 1 THEN 6 ELSE 4 END, i, j FROM vertices WHERE k = 0 AND poly_id % 5 < 2)
          WINDOW w AS (PARTITION BY image_id, poly_id ORDER BY k))
        WHERE NOT (k = m AND abs(fi - i) + abs(fj - j) < 1)""",
        "vertices",
    ),
)
def strip_closing_vertex(spark, sf):
    ring = F.col("ring")
    p = X.polygons(spark, sf).drop("ck")
    some = p.withColumn("ring", F.when(F.col("poly_id") % 5 < 2, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring))
    return G.explode_ring(G.strip_closing_vertex(some, 1.0))


@register(
    "drop_doubles",
    with_views(
        """SELECT image_id, poly_id, CAST(row_number() OVER (PARTITION BY image_id, poly_id ORDER BY k) - 1 AS INT) AS k, i, j
        FROM (SELECT image_id, poly_id, k, i1 AS i, j1 AS j FROM ring_edges
          WHERE sqrt((i1 - i2) * (i1 - i2) + (j1 - j2) * (j1 - j2)) > 8.5)""",
        "ring_edges",
    ),
)
def drop_doubles(spark, sf):
    return G.explode_ring(G.drop_doubles(X.polygons(spark, sf).drop("ck"), 8.5))


@register(
    "drop_holes",
    with_views("SELECT image_id, poly_id, k, i, j FROM vertices WHERE poly_id % 4 <> 0 OR k < 2", "vertices"),
)
def drop_holes(spark, sf):
    """Every fourth ring carries a NaN separator after its second vertex."""
    ring = F.col("ring")
    nan = F.array(rings.point(F.lit(float("nan")), F.lit(float("nan"))))
    split = F.concat(F.slice(ring, F.lit(1), F.lit(2)), nan, F.slice(ring, F.lit(3), F.size(ring) - 2))
    marked = X.polygons(spark, sf).drop("ck").withColumn("ring", F.when(F.col("poly_id") % 4 == 0, split).otherwise(ring))
    return G.explode_ring(G.drop_holes(marked))


@register(
    "edge_attributes",
    with_views(
        """SELECT image_id, poly_id, k, (i1 + i2) / 2 AS centre_i, (j1 + j2) / 2 AS centre_j, length,
          -(j2 - j1) / length + 0.0 AS normal_i, (i2 - i1) / length + 0.0 AS normal_j,
          round(CASE WHEN atan2(j2 - j1, i2 - i1) < 0 THEN atan2(j2 - j1, i2 - i1) + 2 * pi() ELSE atan2(j2 - j1, i2 - i1) END, 6) AS angle,
          round(CASE WHEN atan2(-(j2 - j1), i2 - i1) < 0 THEN atan2(-(j2 - j1), i2 - i1) + 2 * pi() ELSE atan2(-(j2 - j1) + 0.0, i2 - i1) END, 6) AS normal_angle
        FROM (SELECT *, sqrt((i2 - i1) * (i2 - i1) + (j2 - j1) * (j2 - j1)) AS length FROM ring_edges)""",
        "ring_edges",
    ),
)
def edge_attributes(spark, sf):
    e = G.edge_attributes(G.edges(X.polygons(spark, sf)))
    return e.select(
        *IDS, "k", "centre_i", "centre_j", "length", (F.col("normal_i") + 0.0).alias("normal_i"),
        (F.col("normal_j") + 0.0).alias("normal_j"), F.round("angle", 6).alias("angle"),
        F.round("normal_angle", 6).alias("normal_angle"),
    )


@register(
    "turn_angles",
    with_views(
        """SELECT image_id, poly_id, k, round(pi() / 2, 6) AS turn, round(pi() / 2, 6) AS inner_angle FROM ring_edges""",
        "ring_edges",
    ),
)
def turn_angles(spark, sf):
    """Every corner of a building is a right angle."""
    t = G.turn_angles(X.polygons(spark, sf))
    return t.select(*IDS, "k", F.round("turn", 6).alias("turn"), F.round("inner", 6).alias("inner_angle"))


@register(
    "shorten_edges",
    with_views(
        """SELECT image_id, poly_id, k, round((i1 - ci) * f + ci, 6) AS i1, round((j1 - cj) * f + cj, 6) AS j1,
          round((i2 - ci) * f + ci, 6) AS i2, round((j2 - cj) * f + cj, 6) AS j2
        FROM (SELECT *, (i1 + i2) / 2 AS ci, (j1 + j2) / 2 AS cj, (len - 3) / len AS f FROM
          (SELECT *, sqrt((i2 - i1) * (i2 - i1) + (j2 - j1) * (j2 - j1)) AS len FROM ring_edges) WHERE len - 3 >= 4)""",
        "ring_edges",
    ),
)
def shorten_edges(spark, sf):
    e = G.shorten_edges(G.edges(X.polygons(spark, sf)), 1, 2, 4)
    return e.select(*IDS, "k", *[F.round(c, 6).alias(c) for c in ("i1", "j1", "i2", "j2")])


@register(
    "ring_diameter",
    with_views(
        """SELECT a.image_id, a.poly_id, max(sqrt((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j))) AS diameter
        FROM vertices a JOIN vertices b USING (image_id, poly_id) GROUP BY a.image_id, a.poly_id""",
        "vertices",
    ),
)
def ring_diameter(spark, sf):
    """Opposite corners for a rectangle; an L lacks the far corner of its box."""
    return G.ring_diameter(X.polygons(spark, sf)).select(*IDS, "diameter")


@register(
    "simplify",
    with_views("SELECT image_id, poly_id, k, i, j FROM vertices", "vertices"),
)
def simplify(spark, sf):
    """Midpoints added to every side vanish again; the corners stay."""
    ring = F.col("ring")
    doubled = F.flatten(
        F.transform(
            ring,
            lambda p, k: F.when(k == F.size(ring) - 1, F.array(p)).otherwise(
                F.array(p, rings.point((p["i"] + rings.following(ring, k)["i"]) / 2, (p["j"] + rings.following(ring, k)["j"]) / 2))
            ),
        )
    )
    return G.explode_ring(G.simplify(X.polygons(spark, sf).drop("ck").withColumn("ring", doubled), 1.0))


@register(
    "simplify_to_count",
    with_views(
        """SELECT image_id, poly_id, CAST(v.k AS INT) AS k, CASE WHEN v.a = 0 THEN r0 ELSE r1 END AS i, CASE WHEN v.b = 0 THEN c0 ELSE c1 END AS j
        FROM boxes CROSS JOIN (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) AS v(k, a, b)""",
        "boxes",
    ),
)
def simplify_to_count(spark, sf):
    """The closed box of every building, with a vertex beside the middle of each side up to a quarter of a pixel off, goes back to its corners."""
    box, off = rings.box(F.col("ring")), (1 + F.col("poly_id") % 8) * 0.03125
    boxed = G.settled(X.polygons(spark, sf).select(*IDS, box.alias("b")), "b")
    corners = F.array(*[rings.point(F.col(f"b.{r}"), F.col(f"b.{c}")) for r, c in (("r0", "c0"), ("r0", "c1"), ("r1", "c1"), ("r1", "c0"))])
    cornered = G.settled(boxed.select(*IDS, corners.alias("ring")))
    ring = F.col("ring")

    def beside(p, q):
        di, dj = q["i"] - p["i"], q["j"] - p["j"]
        length = F.sqrt(di * di + dj * dj)
        return rings.point((p["i"] + q["i"]) * 0.5 - dj / length * off, (p["j"] + q["j"]) * 0.5 + di / length * off)

    more = F.flatten(F.transform(ring, lambda p, k: F.array(p, beside(p, rings.following(ring, k)))))
    closed = cornered.select(*IDS, F.concat(more, F.slice("ring", 1, 1)).alias("ring"))
    return G.explode_ring(G.simplify_to_count(G.settled(closed), 4))


@register(
    "drop_spikes",
    with_views("SELECT image_id, poly_id, k AS pos, poly_id * 8 + k AS v FROM vertices", "vertices"),
)
def drop_spikes(spark, sf):
    """A there-and-back spike is added after the second vertex of every face."""
    base = X.polygons(spark, sf)
    ids = F.transform("ring", lambda p, k: F.col("poly_id") * 8 + k)
    spiky = base.select(*IDS, ids.alias("face")).withColumn(
        "face",
        F.concat(
            F.slice("face", F.lit(1), F.lit(2)),
            F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"), F.lit(-1).cast("long")),
            F.slice("face", F.lit(2), F.size("face") - 1),
        ),
    )
    return G.drop_spikes(spiky).select(*IDS, F.posexplode("face").alias("pos", "v"))


@register(
    "box_predicates",
    with_views(
        """SELECT e.image_id, e.poly_id, e.k,
          (e.i1 BETWEEN 500 AND 3000 AND e.j1 BETWEEN 250 AND 4000) AS vertex_in,
          (e.i1 BETWEEN 500 AND 3000 AND e.j1 BETWEEN 250 AND 4000 AND e.i2 BETWEEN 500 AND 3000 AND e.j2 BETWEEN 250 AND 4000) AS edge_in,
          (500 <= b.r0 AND 250 <= b.c0 AND b.r1 <= 3000 AND b.c1 <= 4000) AS box_in
        FROM ring_edges e JOIN boxes b USING (image_id, poly_id)""",
        "ring_edges", "boxes",
    ),
)
def box_predicates(spark, sf):
    p = X.polygons(spark, sf).withColumn("b", rings.box(F.col("ring")))
    bounds = (500, 250, 3000, 4000)
    b = F.col("b")
    inner = G.box_in_box((b["r0"], b["c0"], b["r1"], b["c1"]), tuple(F.lit(float(v)) for v in bounds))
    e = G.edges(p.withColumn("box_in", inner).drop("b"))
    vertex = G.vertex_in_box(F.col("i1"), F.col("j1"), *bounds)
    return e.select(*IDS, "k", vertex.alias("vertex_in"), G.edge_in_box(*bounds).alias("edge_in"), "box_in")


@register(
    "image_to_world",
    with_views(
        """SELECT v.image_id, v.poly_id, v.k, m.x0 + m.pixelsize * v.j AS x, m.y0 - m.pixelsize * v.i AS y, v.i AS i, v.j AS j
        FROM vertices v JOIN images m USING (image_id)""",
        "vertices", "images",
    ),
)
def image_to_world(spark, sf):
    """Forward and back."""
    m = X.georeferenced(spark, sf)
    world = G.image_to_world(X.vertices(spark, sf), m).drop("i", "j")
    return G.world_to_image(world, m).select(*IDS, "k", "x", "y", "i", "j")


@register(
    "image_extent",
    with_views(
        """SELECT image_id, x0 AS x_min, y0 - height * pixelsize AS y_min, x0 + width * pixelsize AS x_max, y0 AS y_max,
          pixelsize, pixelsize < 0.001 AS pixelsize_suspect FROM images""",
        "images",
    ),
)
def image_extent(spark, sf):
    m = G.pixel_size(G.image_extent(X.georeferenced(spark, sf)))
    return m.select("image_id", "x_min", "y_min", "x_max", "y_max", "pixelsize", "pixelsize_suspect")


LONLAT = "(c0 - 2450) / 16 AS lon, (r0 - 2450) / 32 AS lat"


@register(
    "project_mercator",
    with_views(
        """SELECT image_id, poly_id, round(radians(lon) * 6378137.0, 3) AS x,
          round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat
        FROM (SELECT image_id, poly_id, """ + LONLAT + " FROM buildings)",
        "buildings",
    ),
)
def project_mercator(spark, sf):
    p = X.buildings(spark, sf).selectExpr("image_id", "poly_id", *[f"CAST({e} AS DOUBLE) AS {n}" for e, n in (("(c0 - 2450) / 16", "lon"), ("(r0 - 2450) / 32", "lat"))])
    back = G.unproject_lonlat(G.project_lonlat(p, 3857).drop("lon", "lat"), 3857)
    return back.select(*IDS, F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@register(
    "project_utm_roundtrip",
    with_views(
        "SELECT image_id, poly_id, round(15 + (c0 - 2450) / 1000, 6) AS lon, round((r0 - 2450) / 40, 6) AS lat FROM buildings", "buildings"
    ),
)
def project_utm_roundtrip(spark, sf):
    """Zone 33 there and back."""
    p = X.buildings(spark, sf).selectExpr("image_id", "poly_id", "15 + (c0 - 2450) / 1000 AS lon", "(r0 - 2450) / 40 AS lat")
    back = G.unproject_lonlat(G.project_lonlat(p, 32633).drop("lon", "lat"), 32633)
    return back.select(*IDS, F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


# theta = 0: the matrix is rational and both engines agree to the last digit.
H_PARAMS = {
    "t1": "image_id * 0.5D", "t2": "image_id * 0.25D - 1", "theta": "0.0D", "s1": "0.25D", "s2": "-0.25D",
    "k1": "0.125D", "k2": "image_id * 0.0625D", "p1": "0.0009765625D", "p2": "0.00048828125D",
}
H_SQL = """SELECT image_id, 1.25::DOUBLE + t1 * p1 AS h11, k2 + t1 * p2 AS h12, t1 AS h13,
  0.125::DOUBLE + t2 * p1 AS h21, 0.75::DOUBLE + t2 * p2 AS h22, t2 AS h23, p1 AS h31, p2 AS h32, 1.0::DOUBLE AS h33
FROM (SELECT image_id, image_id * 0.5::DOUBLE AS t1, image_id * 0.25::DOUBLE - 1 AS t2, image_id * 0.0625::DOUBLE AS k2,
  0.0009765625::DOUBLE AS p1, 0.00048828125::DOUBLE AS p2 FROM images)"""


def _matrices(spark, sf):
    params = X.images(spark, sf).selectExpr("image_id", *[f"{e} AS {n}" for n, e in H_PARAMS.items()])
    return G.homography(params)


@register(
    "homography_points",
    with_views(
        """SELECT v.image_id, v.poly_id, v.k, round((h11 * v.i + h12 * v.j + h13) / (h31 * v.i + h32 * v.j + h33), 6) AS x,
          round((h21 * v.i + h22 * v.j + h23) / (h31 * v.i + h32 * v.j + h33), 6) AS y FROM vertices v JOIN hm USING (image_id)""",
        "vertices", "images", hm=H_SQL,
    ),
)
def homography_points(spark, sf):
    v = X.vertices(spark, sf).withColumnsRenamed({"i": "x", "j": "y"})
    out = G.apply_homography(v, _matrices(spark, sf))
    return out.select(*IDS, "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register(
    "homography_corners",
    with_views(
        """SELECT image_id, c.corner, round((h11 * c.x + h12 * c.y + h13) / (h31 * c.x + h32 * c.y + h33), 6) AS x,
          round((h21 * c.x + h22 * c.y + h23) / (h31 * c.x + h32 * c.y + h33), 6) AS y
        FROM hm CROSS JOIN (VALUES (0, -1.0::DOUBLE, -1.0::DOUBLE), (1, 1.0, -1.0), (2, 1.0, 1.0), (3, -1.0, 1.0)) AS c(corner, x, y)""",
        "images", hm=H_SQL,
    ),
)
def homography_corners(spark, sf):
    out = G.four_points(_matrices(spark, sf))
    return out.select("image_id", "corner", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register(
    "fit_homography",
    with_views(
        """SELECT image_id, """ + ", ".join(f"round(h{r}{c}, 3) AS h{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3)) + " FROM hm",
        "images", hm=H_SQL,
    ),
)
def fit_homography(spark, sf):
    """Recovers the matrix of each image from all of its moved vertices (coordinates scaled to about one)."""
    v = X.vertices(spark, sf).select("image_id", (F.col("i") / 4096).alias("x"), (F.col("j") / 4096).alias("y"))
    hm = _matrices(spark, sf)
    h = [f"h{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3)]
    joined = v.join(hm.select("image_id", *h), "image_id")

    def line(r):
        return F.col(f"h{r}1") * F.col("x") + F.col(f"h{r}2") * F.col("y") + F.col(f"h{r}3")

    pairs = joined.select("image_id", "x", "y", (line(1) / line(3)).alias("u"), (line(2) / line(3)).alias("v"))
    out = G.fit_homography(pairs)
    return out.select("image_id", *[(F.round(c, 3) + 0.0).alias(c) for c in h])


@register(
    "clean_polygons",
    with_views(
        """SELECT m.image_id, v.poly_id, v.k, v.i, v.j FROM (SELECT image_id FROM images UNION ALL SELECT 99) m
        LEFT JOIN vertices v ON v.image_id = m.image_id""",
        "vertices", "images",
    ),
)
def clean_polygons(spark, sf):
    """Image 99 has no polygons."""
    m = X.images(spark, sf).select("image_id")
    more = m.unionByName(m.agg(F.lit(99).cast("long").alias("image_id")))
    out = G.clean_polygons(X.polygons(spark, sf).drop("ck"), more)
    rows = out.select(*IDS, F.posexplode_outer("ring").alias("k", "p"))
    return rows.select(*IDS, "k", F.col("p.i").alias("i"), F.col("p.j").alias("j"))


@register(
    "sample_polygons",
    with_views(f"SELECT image_id, poly_id FROM buildings WHERE {uniform_sql(5, 'image_id', 'poly_id')} < 0.1", "buildings"),
)
def sample_polygons(spark, sf):
    return G.sample_polygons(X.polygons(spark, sf), 0.1, 5).select(*IDS)


@register(
    "ds_levels",
    with_views(
        """SELECT image_id, f.f AS ds_fac FROM (SELECT *, CASE WHEN image_id % 4 = 0 THEN 'val' ELSE 'train' END AS fold,
          CAST(1 + image_id % 3 AS INT) AS min_ds_fac FROM images) m JOIN (VALUES (1), (2), (4), (8)) AS f(f) ON m.min_ds_fac <= f.f
        WHERE fold = 'train'""",
        "images",
    ),
)
def ds_levels(spark, sf):
    m = X.images(spark, sf).selectExpr(
        "image_id", "CASE WHEN image_id % 4 = 0 THEN 'val' ELSE 'train' END AS fold", "CAST(1 + image_id % 3 AS INT) AS min_ds_fac"
    )
    return G.ds_levels(G.fold_filter(m, "train"), [1, 2, 4, 8]).select("image_id", "ds_fac")

