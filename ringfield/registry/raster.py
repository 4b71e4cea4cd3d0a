"""Raster cells and displacement fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield import fixtures as X
from ringfield.functions import rings
from ringfield.operators import fields as D
from ringfield.operators import geometry as G
from ringfield.operators import raster as R
from ringfield.operators import tiles as T
from ringfield.registry.base import register, uniform_sql, with_views

IDS = ["image_id", "poly_id"]
SMALL = "0.25::DOUBLE"


def _small(spark, sf):
    """Buildings at a quarter of the size, as (image_id, ring)."""
    return X.polygons(spark, sf).select("image_id", rings.scale(F.col("ring"), F.lit(0.25)).alias("ring"))


FILLED = f"""SELECT DISTINCT image_id, i.i, j.j FROM (SELECT image_id, ceil(r0 * {SMALL})::BIGINT AS a, floor(r1 * {SMALL})::BIGINT AS b,
    ceil(c0 * {SMALL})::BIGINT AS c, floor(c1 * {SMALL})::BIGINT AS d FROM rects) r,
  LATERAL (SELECT unnest(generate_series(r.a, r.b)) AS i) i, LATERAL (SELECT unnest(generate_series(r.c, r.d)) AS j) j"""
# Axis-parallel sides: rounded ends, one cell to each side across the direction of the line.
LINES = f"""SELECT DISTINCT image_id, i.i, j.j FROM (
    SELECT image_id, least(a, c) - CASE WHEN abs(c - a) >= abs(d - b) THEN 0 ELSE 1 END AS i0, greatest(a, c) + CASE WHEN abs(c - a) >= abs(d - b) THEN 0 ELSE 1 END AS i1,
      least(b, d) - CASE WHEN abs(c - a) >= abs(d - b) THEN 1 ELSE 0 END AS j0, greatest(b, d) + CASE WHEN abs(c - a) >= abs(d - b) THEN 1 ELSE 0 END AS j1
    FROM (SELECT e.image_id, round_even(i1 * {SMALL}, 0)::BIGINT AS a, round_even(j1 * {SMALL}, 0)::BIGINT AS b, round_even(i2 * {SMALL}, 0)::BIGINT AS c, round_even(j2 * {SMALL}, 0)::BIGINT AS d
      FROM ring_edges e JOIN boxes b USING (image_id, poly_id) WHERE e.k < b.n - 1)) r,
  LATERAL (SELECT unnest(generate_series(r.i0, r.i1)) AS i) i, LATERAL (SELECT unnest(generate_series(r.j0, r.j1)) AS j) j"""
POINTS = f"SELECT DISTINCT image_id, round_even(i * {SMALL}, 0)::BIGINT AS i, round_even(j * {SMALL}, 0)::BIGINT AS j FROM vertices"


@register(
    "rasterize",
    with_views(
        """SELECT image_id, layer, i, count(*) AS n, CAST(sum(j) AS BIGINT) AS j_sum FROM (
          SELECT image_id, 'fill' AS layer, CAST(i AS INT) AS i, j FROM filled UNION ALL SELECT image_id, 'edge', CAST(i AS INT), j FROM lines
          UNION ALL SELECT image_id, 'vertex', CAST(i AS INT), j FROM points)
        WHERE i >= 0 AND i < 1250 AND j >= 0 AND j < 1250 GROUP BY image_id, layer, i""",
        "rects", "ring_edges", "boxes", filled=FILLED, lines=LINES, points=POINTS,
    ),
)
def rasterize(spark, sf):
    """All three layers, reported per image row."""
    cells = R.rasterize(_small(spark, sf), 1250, 1250)
    return cells.groupBy("image_id", "layer", "i").agg(F.count("*").alias("n"), F.sum("j").alias("j_sum"))


@register(
    "rasterize_lines",
    with_views(
        f"""SELECT image_id, poly_id, count(*) AS n, CAST(sum(i * 10000 + j) AS BIGINT) AS position FROM (
          SELECT DISTINCT image_id, poly_id, i.i, j.j FROM (SELECT image_id, poly_id, round_even(least(i1, i2), 0)::BIGINT AS a, round_even(greatest(i1, i2), 0)::BIGINT AS b,
            round_even(least(j1, j2), 0)::BIGINT AS c, round_even(greatest(j1, j2), 0)::BIGINT AS d FROM ring_edges) r,
          LATERAL (SELECT unnest(generate_series(r.a, r.b)) AS i) i, LATERAL (SELECT unnest(generate_series(r.c, r.d)) AS j) j) GROUP BY image_id, poly_id""",
        "ring_edges",
    ),
)
def rasterize_lines(spark, sf):
    """Outlines one cell wide, per polygon."""
    cells = R.rasterize_lines(G.edges(X.polygons(spark, sf).drop("ck")))
    place = F.sum(F.col("i").cast("long") * 10000 + F.col("j")).alias("position")
    return cells.groupBy(*IDS).agg(F.count("*").alias("n"), place)


@register(
    "rasterize_triangles",
    with_views(
        """SELECT image_id, poly_id, sum(1 + (h::BIGINT * (c0 + w - j.j)::BIGINT) // w::BIGINT)::BIGINT AS n FROM buildings b,
        LATERAL (SELECT unnest(generate_series(b.c0::BIGINT, (b.c0 + b.w)::BIGINT)) AS j) j GROUP BY image_id, poly_id""",
        "buildings",
    ),
)
def rasterize_triangles(spark, sf):
    """The corner triangle of every building's box."""
    r0, c0, h, w = (F.col(c) for c in ("r0", "c0", "h", "w"))
    ring = F.array(rings.point(r0, c0), rings.point(r0, c0 + w), rings.point(r0 + h, c0))
    cells = R.rasterize_triangles(X.buildings(spark, sf).select(*IDS, ring.alias("ring")))
    return cells.groupBy(*IDS).agg(F.count("*").alias("n"))


@register(
    "downsample",
    with_views("SELECT image_id, CAST(i // 2 AS INT) AS i, CAST(j // 2 AS INT) AS j, round(avg(value), 6) AS value FROM cells GROUP BY image_id, i // 2, j // 2", "cells"),
)
def downsample(spark, sf):
    return R.downsample(X.cells(spark, sf), 2, ["image_id"]).select("image_id", "i", "j", F.round("value", 6).alias("value"))


@register(
    "resample_up",
    with_views(
        """SELECT image_id, CAST(t.i AS INT) AS i, CAST(t.j AS INT) AS j, round(sum(value * greatest(0, 1 - abs(t.y - c.i)) * greatest(0, 1 - abs(t.x - c.j))), 6) AS value
        FROM cells c CROSS JOIN (SELECT a.n AS i, b.n AS j, least(greatest((a.n + 0.5) / 2.5::DOUBLE - 0.5, 0), 7) AS y, least(greatest((b.n + 0.5) / 2.5::DOUBLE - 0.5, 0), 7) AS x
          FROM range(0, 20) a(n) CROSS JOIN range(0, 20) b(n)) t
        WHERE abs(t.y - c.i) < 1 AND abs(t.x - c.j) < 1 GROUP BY image_id, t.i, t.j""",
        "cells",
    ),
)
def resample_up(spark, sf):
    """Bilinear, factor 2.5."""
    c = X.cells(spark, sf)
    shapes = c.select("image_id").distinct().selectExpr("image_id", "8 AS from_h", "8 AS from_w", "20 AS height", "20 AS width")
    out = D.resample(c, shapes, [], ["value"])
    return out.select("image_id", "i", "j", F.round("value", 6).alias("value"))


@register(
    "crop_pad",
    with_views(
        """SELECT image_id, CAST(i - 0 + 1 AS INT) AS i, CAST(j - 3 + 2 AS INT) AS j, value FROM cells WHERE i < 6 AND j >= 3""", "cells"
    ),
)
def crop_pad(spark, sf):
    """Box (-2, 3, 6, 12): two rows of padding above and four columns beside it, shared by both sides."""
    return R.crop_pad(X.cells(spark, sf), (-2, 3, 6, 12), 8, 8).select("image_id", "i", "j", "value")


@register(
    "centre_crop_dense",
    with_views(
        """SELECT g.image_id, CAST(g.i AS INT) AS i, CAST(g.j AS INT) AS j, coalesce(c.value, 0.0) AS value FROM
        (SELECT image_id, a.n AS i, b.n AS j FROM (SELECT DISTINCT image_id FROM cells) CROSS JOIN range(0, 5) a(n) CROSS JOIN range(0, 11) b(n)) g
        LEFT JOIN cells c ON c.image_id = g.image_id AND c.i = g.i + 1 AND c.j = g.j - 1""",
        "cells",
    ),
)
def centre_crop_dense(spark, sf):
    c = X.cells(spark, sf)
    cut = R.centre_crop_pad(c.drop("band"), 8, 8, 5, 11)
    return R.densify(cut, c.select("image_id").distinct(), 5, 11)


@register(
    "gaussian_field",
    f"""WITH modes AS (SELECT c_custkey // 60 AS map_id, (c_custkey // 30) % 2 AS channel, c_custkey,
        (c_custkey * 37 % 101) / 101.0::DOUBLE AS mi, (c_custkey * 53 % 103) / 103.0::DOUBLE AS mj, CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS sg,
        0.02::DOUBLE AS a, 0.005::DOUBLE AS b, 0.03::DOUBLE AS d FROM customer),
      mixed AS (SELECT map_id, channel, g.i, g.j, sum(sg * exp(-(d * power(g.i / 7.0::DOUBLE - mi, 2) - 2 * b * (g.i / 7.0::DOUBLE - mi) * (g.j / 7.0::DOUBLE - mj) + a * power(g.j / 7.0::DOUBLE - mj, 2)) / (a * d - b * b) / 2) / (2 * pi() * sqrt(a * d - b * b))) AS v
        FROM modes CROSS JOIN (SELECT x.n AS i, y.n AS j FROM range(0, 8) x(n) CROSS JOIN range(0, 8) y(n)) g GROUP BY map_id, channel, g.i, g.j),
      stretched AS (SELECT *, (v - min(v) OVER w) * 2 / (max(v) OVER w - min(v) OVER w) - 1 AS s FROM mixed WINDOW w AS (PARTITION BY map_id, channel)),
      up AS (SELECT map_id, channel, CAST(t.i AS INT) AS i, CAST(t.j AS INT) AS j, sum(s * greatest(0, 1 - abs(t.y - c.i)) * greatest(0, 1 - abs(t.x - c.j))) AS value
        FROM stretched c CROSS JOIN (SELECT a.n AS i, b.n AS j, least(greatest((a.n + 0.5) / 4::DOUBLE - 0.5, 0), 7) AS y, least(greatest((b.n + 0.5) / 4::DOUBLE - 0.5, 0), 7) AS x
          FROM range(0, 32) a(n) CROSS JOIN range(0, 32) b(n)) t WHERE abs(t.y - c.i) < 1 AND abs(t.x - c.j) < 1 GROUP BY map_id, channel, t.i, t.j)
    SELECT CAST(map_id AS INT) AS map_id, i, j, round(max(CASE WHEN channel = 0 THEN value END), 6) AS di, round(max(CASE WHEN channel = 1 THEN value END), 6) AS dj
    FROM up GROUP BY map_id, i, j""",
)
def gaussian_field(spark, sf):
    """Sixty customers give the modes of one map, the last of which may lack some; a 32 x 32 image, mixed on an 8 x 8 grid."""
    c = X.table(spark, sf, "customer")
    modes = c.selectExpr(
        "0L AS image_id", "CAST(c_custkey DIV 60 AS INT) AS map_id", "CAST((c_custkey DIV 30) % 2 AS INT) AS channel", "c_custkey AS mode",
        "(c_custkey * 37 % 101) / 101.0D AS mu_i", "(c_custkey * 53 % 103) / 103.0D AS mu_j", "IF(c_custkey % 2 = 0, 1.0D, -1.0D) AS sign",
        "0.02D AS s_ii", "0.005D AS s_ij", "0.03D AS s_jj",
    )
    image = c.select(F.lit(0).cast("long").alias("image_id"), F.lit(32).alias("height"), F.lit(32).alias("width")).distinct()
    out = D.gaussian_field(image, modes)
    return out.select("map_id", "i", "j", F.round("di", 6).alias("di"), F.round("dj", 6).alias("dj"))


@register(
    "random_modes",
    with_views(
        f"""SELECT image_id, CAST(m.n AS INT) AS map_id, CAST(c.n AS INT) AS channel, CAST(o.n AS INT) AS mode, round({uniform_sql(79190, 'image_id', 'm.n', 'c.n', 'o.n')}, 6) AS mu_i,
          CASE WHEN {uniform_sql(79192, 'image_id', 'm.n', 'c.n', 'o.n')} < 0.5 THEN -1.0::DOUBLE ELSE 1.0 END AS sign
        FROM images CROSS JOIN range(0, 2) m(n) CROSS JOIN range(0, 2) c(n) CROSS JOIN range(0, 30) o(n)""",
        "images",
    ),
)
def random_modes(spark, sf):
    m = D.random_modes(X.images(spark, sf), 2, 30, 10)
    return m.select("image_id", "map_id", "channel", "mode", F.round("mu_i", 6).alias("mu_i"), "sign")


@register(
    "minmax_stretch",
    with_views("SELECT image_id, i, j, round((value - min(value) OVER w) * 2 / (max(value) OVER w - min(value) OVER w) - 1, 6) AS value FROM cells WINDOW w AS (PARTITION BY image_id)", "cells"),
)
def minmax_stretch(spark, sf):
    return D.minmax_stretch(X.cells(spark, sf), "value", ["image_id"]).select("image_id", "i", "j", F.round("value", 6).alias("value"))


@register(
    "quantise_roundtrip",
    with_views(
        """SELECT image_id, i, j, qi, round(qi * 0.5::DOUBLE / 32767, 6) AS di, round(qi * 0.5::DOUBLE / 32767 / 0.5 * 4, 6) AS pixels
        FROM (SELECT image_id, i, j, CAST(round_even(greatest(least(value, 1.0), -1.0) * 32767, 0) AS SMALLINT) AS qi FROM cells)""",
        "cells",
    ),
)
def quantise_roundtrip(spark, sf):
    c = X.cells(spark, sf).selectExpr("image_id", "i", "j", "greatest(least(value, 1.0D), -1.0D) AS di", "0.5D AS dj")
    q = D.quantise_field(c)
    back = D.dequantise_field(q.withColumn("qi", F.col("di")))
    wide = D.denormalise_prediction(back.withColumn("half", F.col("di")), 4.0)
    return wide.select("image_id", "i", "j", "qi", F.round("half", 6).alias("di"), F.round("di", 6).alias("pixels"))


@register(
    "rotate_vectors",
    with_views(
        """SELECT image_id, i, j, round(value * cos(-0.5) + (i - j) * sin(-0.5), 6) AS di, round((i - j) * cos(-0.5) - value * sin(-0.5), 6) AS dj FROM cells""", "cells"
    ),
)
def rotate_vectors(spark, sf):
    f = X.cells(spark, sf).selectExpr("image_id", "i", "j", "value AS di", "CAST(i - j AS DOUBLE) AS dj")
    return D.rotate_vectors(f, 0.5).select("image_id", "i", "j", F.round("di", 6).alias("di"), F.round("dj", 6).alias("dj"))


@register(
    "flip_cells",
    with_views("SELECT image_id, CAST(7 - i AS INT) AS i, j, -value + 0.0 AS di, CAST(j AS DOUBLE) AS dj FROM cells", "cells"),
)
def flip_cells(spark, sf):
    f = X.cells(spark, sf).selectExpr("image_id", "i", "j", "value AS di", "CAST(j AS DOUBLE) AS dj")
    return D.flip_rows(R.flip_cells(f, 8)).select("image_id", "i", "j", (F.col("di") + 0.0).alias("di"), "dj")


@register(
    "field_polar",
    with_views(
        """SELECT image_id, i, j, round(CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END, 6) AS angle, round(m, 6) AS magnitude,
          round((m - min(m) OVER w) * 255 / (max(m) OVER w - min(m) OVER w), 6) AS level
        FROM (SELECT image_id, i, j, value AS x, (i - j) * 0.25::DOUBLE + 0.125 AS y, sqrt(value * value + ((i - j) * 0.25 + 0.125) * ((i - j) * 0.25 + 0.125)) AS m FROM cells)
        WINDOW w AS (PARTITION BY image_id)""",
        "cells",
    ),
)
def field_polar(spark, sf):
    f = X.cells(spark, sf).selectExpr("image_id", "i", "j", "value AS di", "(i - j) * 0.25D + 0.125D AS dj")
    out = D.field_polar(f, ["image_id"])
    return out.select("image_id", "i", "j", *[F.round(c, 6).alias(c) for c in ("angle", "magnitude", "level")])


@register(
    "warp_pixels",
    with_views(
        """SELECT c.image_id, CAST(m.n AS INT) AS map_id, CAST(g.i AS INT) AS i, CAST(g.j AS INT) AS j, c.value FROM range(0, 2) m(n) CROSS JOIN
          (SELECT a.n AS i, b.n AS j FROM range(0, 8) a(n) CROSS JOIN range(0, 8) b(n)) g
          JOIN cells c ON c.i = round_even(g.i + ((g.i * 7 + g.j * 3 + m.n * 5) % 17 - 8) * 0.25::DOUBLE, 0)
            AND c.j = round_even(g.j + ((g.i * 5 + g.j * 11 + m.n * 3) % 17 - 8) * 0.25::DOUBLE, 0)""",
        "cells",
    ),
)
def warp_pixels(spark, sf):
    out = D.warp_pixels(X.cells(spark, sf), X.field(spark, 8), 8, 8)
    return out.select("image_id", "map_id", "i", "j", "value")


NEAR = "(SELECT a.n AS a, b.n AS b FROM range(-1, 2) a(n) CROSS JOIN range(-1, 2) b(n))"


@register(
    "dilate3",
    with_views(
        f"SELECT c.image_id, CAST(c.i + t.a AS INT) AS i, CAST(c.j + t.b AS INT) AS j, max(value) AS value FROM cells c CROSS JOIN {NEAR} t WHERE c.i + t.a BETWEEN 0 AND 7 AND c.j + t.b BETWEEN 0 AND 7 GROUP BY c.image_id, c.i + t.a, c.j + t.b",
        "cells",
    ),
)
def dilate3(spark, sf):
    return R.dilate(X.cells(spark, sf), ["image_id"], 3, 8, 8)


@register(
    "blur_cells",
    with_views(
        """SELECT c.image_id, CAST(c.i + t.a AS INT) AS i, CAST(c.j + t.b AS INT) AS j, round(sum(value * t.w), 6) AS value FROM cells c CROSS JOIN
        (SELECT a.n AS a, b.n AS b, exp(-(a.n * a.n + b.n * b.n) / 2.0::DOUBLE) / (SELECT sum(exp(-(x.n * x.n + y.n * y.n) / 2.0::DOUBLE)) FROM range(-2, 3) x(n) CROSS JOIN range(-2, 3) y(n)) AS w
          FROM range(-2, 3) a(n) CROSS JOIN range(-2, 3) b(n)) t GROUP BY c.image_id, c.i + t.a, c.j + t.b""",
        "cells",
    ),
)
def blur_cells(spark, sf):
    out = R.blur_cells(X.cells(spark, sf), ["image_id"], 2, 1.0)
    return out.select("image_id", "i", "j", F.round("value", 6).alias("value"))


MASK = "SELECT image_id, i, j FROM cells WHERE value > 0"
COMPONENTS = dict(
    mask="SELECT image_id, i, j, CAST(i AS BIGINT) * 4294967296 + j AS id FROM cells WHERE value > 0",
    links="""SELECT a.image_id, a.id AS a, b.id AS b FROM mask a JOIN mask b ON a.image_id = b.image_id AND abs(a.i - b.i) + abs(a.j - b.j) = 1""",
    reach="""SELECT image_id, id, id AS other FROM mask UNION SELECT r.image_id, r.id, l.b FROM reach r JOIN links l ON l.image_id = r.image_id AND l.a = r.other""",
    labels="SELECT image_id, id, min(other) AS label FROM reach GROUP BY image_id, id",
)


@register(
    "cell_components",
    with_views("SELECT m.image_id, m.i, m.j, l.label FROM mask m JOIN labels l USING (image_id, id)", "cells", recursive=True, **COMPONENTS),
)
def cell_components(spark, sf):
    return R.cell_components(X.cells(spark, sf).where("value > 0").drop("band"), ["image_id"])


@register(
    "drop_components",
    with_views(
        f"""SELECT DISTINCT c.image_id, y.layer, c.i, c.j, c.value FROM cells c CROSS JOIN (VALUES ('fill'), ('edge')) AS y(layer)
        JOIN (SELECT m.image_id, m.i, m.j FROM mask m JOIN labels l USING (image_id, id) WHERE {uniform_sql(4, 'm.image_id', 'l.label')} < 0.3) k
        ON k.image_id = c.image_id AND abs(k.i - c.i) <= 1 AND abs(k.j - c.j) <= 1""",
        "cells", recursive=True, **COMPONENTS,
    ),
)
def drop_components(spark, sf):
    c = X.cells(spark, sf).select("image_id", F.explode(F.array(F.lit("fill"), F.lit("edge"))).alias("layer"), "i", "j", "value")
    return R.drop_components(c, ["image_id"], 0.3, 4, 8, 8)


@register(
    "rotate_cells",
    with_views(
        """SELECT c.image_id, CAST(t.i AS INT) AS i, CAST(t.j AS INT) AS j, round(sum(value * (1 - abs(t.y - c.i)) * (1 - abs(t.x - c.j))), 6) AS value FROM cells c CROSS JOIN
        (SELECT a.n AS i, b.n AS j, 3.5 + (a.n - 3.5) * cos(0.5) + (b.n - 3.5) * sin(0.5) AS y, 3.5 - (a.n - 3.5) * sin(0.5) + (b.n - 3.5) * cos(0.5) AS x
          FROM range(0, 8) a(n) CROSS JOIN range(0, 8) b(n)) t WHERE abs(t.y - c.i) < 1 AND abs(t.x - c.j) < 1 GROUP BY c.image_id, t.i, t.j""",
        "cells",
    ),
)
def rotate_cells(spark, sf):
    out = R.rotate_cells(X.cells(spark, sf), ["image_id"], 0.5, 8, 8)
    return out.select("image_id", "i", "j", F.round("value", 6).alias("value"))


@register(
    "rotate_cells_nearest",
    with_views(
        """SELECT c.image_id, CAST(t.i AS INT) AS i, CAST(t.j AS INT) AS j, c.value FROM cells c JOIN
        (SELECT a.n AS i, b.n AS j, 3.5 + (a.n - 3.5) * cos(0.5) + (b.n - 3.5) * sin(0.5) AS y, 3.5 - (a.n - 3.5) * sin(0.5) + (b.n - 3.5) * cos(0.5) AS x
          FROM range(0, 8) a(n) CROSS JOIN range(0, 8) b(n)) t ON c.i = round_even(t.y, 0) AND c.j = round_even(t.x, 0)""",
        "cells",
    ),
)
def rotate_cells_nearest(spark, sf):
    return R.rotate_cells(X.cells(spark, sf), ["image_id"], 0.5, 8, 8, nearest=True)


RGB = "SELECT image_id, CAST(b.n AS INT) AS band, i, j, greatest(least(value * 100 + 60 + b.n * 20, 255), 0) AS v FROM cells CROSS JOIN range(0, 3) b(n)"


def _rgb(spark, sf):
    c = X.cells(spark, sf).withColumn("b", F.explode(F.array(*[F.lit(n) for n in range(3)])))
    return c.selectExpr("image_id", "b AS band", "i", "j", "greatest(least(value * 100 + 60 + b * 20, 255D), 0D) AS value")


@register(
    "photometric",
    with_views(
        f"""SELECT image_id, band, i, j, round(greatest(least((top - (top - v) * CASE WHEN top > low AND top > 0 THEN least(s, 1 / ((top - low) / top)) ELSE 1 END) * 2 - 1, 1), -1), 6) AS value FROM (
          SELECT *, max(v) OVER p AS top, min(v) OVER p AS low FROM (
            SELECT image_id, band, i, j, s, (v - avg(v) OVER (PARTITION BY image_id, band)) * c + avg(v) OVER (PARTITION BY image_id, band) AS v FROM (
              SELECT r.image_id, r.band, r.i, r.j, r.v / 255 + {uniform_sql(21, 'image_id')} * 0.5 - 0.25 AS v,
                {uniform_sql(22, 'image_id')} * 0.4 + 0.8 AS c, {uniform_sql(23, 'image_id')} * 0.4 + 0.8 AS s FROM rgb r))
          WINDOW p AS (PARTITION BY image_id, i, j))""",
        "cells", rgb=RGB,
    ),
)
def photometric(spark, sf):
    p = _rgb(spark, sf)
    out = R.photometric(p, R.photometric_params(p.select("image_id").distinct(), 21))
    return out.select("image_id", "band", "i", "j", F.round("value", 6).alias("value"))


@register(
    "apply_alpha",
    with_views(
        """SELECT c.image_id, CAST(b.n AS INT) AS band, c.i, c.j, CASE WHEN c.band % 2 = 0 THEN round_even(((c.i * 8 + b.n) * 3) / 255.0::DOUBLE * (c.j * 36 / 255.0::DOUBLE) * 255, 0) ELSE ((c.i * 8 + b.n) * 3)::DOUBLE END AS value
        FROM cells c CROSS JOIN range(0, 3) b(n)""",
        "cells",
    ),
)
def apply_alpha(spark, sf):
    """Tiles with an even label are treated as the city with a meaningful fourth band."""
    c = X.cells(spark, sf)
    p = c.withColumn("b", F.explode(F.array(*[F.lit(n) for n in range(4)]))).selectExpr(
        "image_id", "b AS band", "i", "j", "CAST(IF(b = 3, j * 36, (i * 8 + b) * 3) AS DOUBLE) AS value"
    )
    m = c.selectExpr("image_id", "IF(band % 2 = 0, 'SanFrancisco', 'Atlanta') AS city").distinct()
    return R.apply_alpha(p, m, ["SanFrancisco"]).select("image_id", "band", "i", "j", "value")


@register(
    "mask_boundary",
    with_views(
        """SELECT m.image_id, CAST(m.i + s.a AS INT) AS i1, CAST(m.j + s.b AS INT) AS j1, CAST(m.i + s.c AS INT) AS i2, CAST(m.j + s.d AS INT) AS j2
        FROM mask m CROSS JOIN (VALUES (-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0)) AS s(ni, nj, a, b, c, d)
        WHERE NOT EXISTS (SELECT 1 FROM mask n WHERE n.image_id = m.image_id AND n.i = m.i + s.ni AND n.j = m.j + s.nj)""",
        "cells", mask=MASK,
    ),
)
def mask_boundary(spark, sf):
    return R.mask_boundary(X.cells(spark, sf).where("value > 0"), ["image_id"])


@register(
    "boundary_rings",
    with_views(
        """SELECT image_id, count(*) AS rings, CAST(sum(1) AS BIGINT) AS check_rings FROM (SELECT image_id, label FROM labels GROUP BY image_id, label) GROUP BY image_id""",
        "cells", recursive=True, **COMPONENTS,
    ),
)
def boundary_rings(spark, sf):
    """Outer outlines: one per 4-connected part."""
    out = R.boundary_rings(X.cells(spark, sf).where("value > 0").drop("band"), ["image_id"])
    outer = out.where("outer")
    return outer.groupBy("image_id").agg(F.count("*").alias("rings"), F.sum(F.lit(1).cast("long")).alias("check_rings"))


@register(
    "cells_in_patches",
    with_views(
        """SELECT c.image_id, CAST(a.n * 3 + b.n AS INT) AS patch_id, CAST(c.i - a.n * 2 AS INT) AS pi, CAST(c.j - b.n * 2 AS INT) AS pj, c.value
        FROM cells c CROSS JOIN range(0, 3) a(n) CROSS JOIN range(0, 3) b(n) WHERE c.i >= a.n * 2 AND c.i < a.n * 2 + 4 AND c.j >= b.n * 2 AND c.j < b.n * 2 + 4""",
        "cells",
    ),
)
def cells_in_patches(spark, sf):
    c = X.cells(spark, sf)
    images = c.select("image_id").distinct().selectExpr("image_id", "8 AS height", "8 AS width")
    out = R.cells_in_patches(c, T.patch_grid(images, 2, 4), 4)
    return out.select("image_id", "patch_id", "pi", "pj", "value")
