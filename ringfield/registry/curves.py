"""Accuracy and IoU curves, heights, histograms, coverage and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield import fixtures as X
from ringfield.functions import rings
from ringfield.operators import metrics as M
from ringfield.operators import raster as R
from ringfield.registry.base import register, with_views

IDS = ["image_id", "poly_id"]


@register(
    "distance_summary",
    with_views("SELECT image_id, min(d) AS min_d, round(avg(d), 6) AS mean_d, max(d) AS max_d FROM distances GROUP BY image_id", "distances"),
)
def distance_summary(spark, sf):
    s = M.distance_summary(X.polygons(spark, sf), X.predicted(spark, sf), ["image_id"])
    return s.select("image_id", "min_d", F.round("mean_d", 6).alias("mean_d"), "max_d")


ACCURACY = "SELECT image_id, threshold, avg(CASE WHEN d <= threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS value, count(*) AS n FROM distances CROSS JOIN thresholds GROUP BY image_id, threshold"


@register(
    "threshold_accuracy",
    with_views(f"SELECT image_id, threshold, round(value, 6) AS value, n FROM ({ACCURACY})", "distances", "thresholds"),
)
def threshold_accuracy(spark, sf):
    c = M.threshold_accuracy(X.polygons(spark, sf), X.predicted(spark, sf))
    return c.select("image_id", "threshold", F.round("value", 6).alias("value"), "n")


@register(
    "threshold_accuracy_closed",
    with_views(
        """SELECT threshold, round(avg(CASE WHEN d <= threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS value, count(*) AS n
        FROM (SELECT d FROM distances WHERE poly_id % 4 <> 1 UNION ALL SELECT d FROM distances WHERE poly_id % 4 = 1 AND k < 2)
        CROSS JOIN (VALUES (0.5::DOUBLE), (1.0), (2.75), (4.0), (5.5)) AS t(threshold) GROUP BY threshold""",
        "distances",
    ),
)
def threshold_accuracy_closed(spark, sf):
    """Rings with a repeated closing vertex and rings cut by a NaN separator; uneven thresholds."""
    ring = F.col("ring")
    nan = F.array(rings.point(F.lit(float("nan")), F.lit(float("nan"))))
    cut = F.concat(F.slice("ring", 1, 2), nan, F.slice("ring", F.lit(3), F.size("ring") - 2))
    closed = F.concat(ring, F.slice("ring", 1, 1))

    def dress(df):
        return df.withColumn("ring", F.when(F.col("poly_id") % 4 == 1, cut).when(F.col("poly_id") % 4 == 2, closed).otherwise(ring))

    d = M.matched_rings(dress(X.polygons(spark, sf)), dress(X.predicted(spark, sf)))
    c = M.accuracy_curve(d.select(F.explode_outer("d").alias("d")), [], [0.5, 1.0, 2.75, 4.0, 5.5])
    return c.select("threshold", F.round("value", 6).alias("value"), "n")


BANDS = f"SELECT threshold, min(value) AS low, avg(value) AS mean, max(value) AS high, stddev_pop(value) AS deviation FROM ({ACCURACY}) GROUP BY threshold"


@register(
    "curve_bands",
    with_views(f"SELECT threshold, round(low, 6) AS low, round(mean, 6) AS mean, round(high, 6) AS high, round(deviation, 6) AS deviation FROM ({BANDS})", "distances", "thresholds"),
)
def curve_bands(spark, sf):
    b = M.curve_bands(M.threshold_accuracy(X.polygons(spark, sf), X.predicted(spark, sf)))
    return b.select("threshold", *[F.round(c, 6).alias(c) for c in ("low", "mean", "high", "deviation")])


@register(
    "curve_summary",
    with_views(
        f"""SELECT round(sum((threshold - pt) * (mean + pm) / 2), 6) AS area, round(max(mean), 6) AS peak, round(max(CASE WHEN threshold = 8 THEN mean END), 6) AS middle
        FROM (SELECT threshold, mean, lag(threshold) OVER (ORDER BY threshold) AS pt, lag(mean) OVER (ORDER BY threshold) AS pm FROM ({BANDS}))""",
        "distances", "thresholds",
    ),
)
def curve_summary(spark, sf):
    s = M.curve_summary(M.curve_bands(M.threshold_accuracy(X.polygons(spark, sf), X.predicted(spark, sf))))
    return s.select(*[F.round(c, 6).alias(c) for c in ("area", "peak", "middle")])


def _iou_sql(low: int, high: int) -> str:
    return f"""SELECT band, n.n / 100.0::DOUBLE AS threshold,
      CAST(count(*) FILTER (WHERE n.n / 100.0::DOUBLE < value AND g) AS BIGINT) AS inter,
      CAST(count(*) FILTER (WHERE n.n / 100.0::DOUBLE < value OR g) AS BIGINT) AS uni,
      round(count(*) FILTER (WHERE n.n / 100.0::DOUBLE < value AND g) / nullif(count(*) FILTER (WHERE n.n / 100.0::DOUBLE < value OR g), 0)::DOUBLE, 6) AS iou
    FROM (SELECT *, i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5 AS g FROM cells WHERE i BETWEEN {low} AND {high} AND j BETWEEN {low} AND {high}) CROSS JOIN range(0, 101) AS n(n)
    GROUP BY band, n.n"""


@register("mask_iou_curve", with_views(_iou_sql(0, 7).replace("band", "image_id"), "cells"))
def mask_iou_curve(spark, sf):
    c = X.cells(spark, sf)
    gt = c.where("i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5")
    out = M.mask_iou_curve(c, gt, ["image_id"], margin=0)
    return out.withColumn("iou", F.round("iou", 6))


@register("mask_iou_margin", with_views(_iou_sql(1, 6).replace("band", "image_id"), "cells"))
def mask_iou_margin(spark, sf):
    c = X.cells(spark, sf)
    gt = c.where("i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5")
    out = M.mask_iou_curve(c, gt, ["image_id"], margin=1, height=8, width=8)
    return out.withColumn("iou", F.round("iou", 6))


@register(
    "round_report",
    with_views(
        """SELECT m.source, m.image_id, n.n * 0.25::DOUBLE AS threshold,
          round(avg(CASE WHEN sqrt((m.i - t.i) * (m.i - t.i) + (m.j - t.j) * (m.j - t.j)) <= n.n * 0.25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS value
        FROM turned m JOIN turned t ON t.source = 'truth' AND m.source <> 'truth' AND m.image_id = t.image_id AND m.poly_id = t.poly_id AND m.kk = t.kk
        CROSS JOIN range(0, 129) AS n(n) GROUP BY m.source, m.image_id, n.n""",
        "pred",
        versions="""SELECT s.source, v.image_id, v.poly_id, v.k, v.i + (p.i - v.i) * s.f AS i, v.j + (p.j - v.j) * s.f AS j
          FROM vertices v JOIN pred p USING (image_id, poly_id, k)
          JOIN (VALUES ('truth', 0.0::DOUBLE), ('gt', 1.0), ('aligned', 0.5), ('aligned_1', 0.25), ('aligned_2', 0.0)) AS s(source, f)
          ON NOT (s.source IN ('aligned_1', 'aligned_2') AND v.image_id % 4 = 1) AND NOT (v.image_id % 4 = 2 AND s.source NOT IN ('gt', 'truth'))""",
        turned="""SELECT *, CASE WHEN sum(i * nj - ni * j) OVER w > 0 THEN k ELSE count(*) OVER w - 1 - k END AS kk FROM (
          SELECT *, coalesce(lead(i) OVER o, first_value(i) OVER o) AS ni, coalesce(lead(j) OVER o, first_value(j) OVER o) AS nj FROM versions
          WINDOW o AS (PARTITION BY source, image_id, poly_id ORDER BY k)) WINDOW w AS (PARTITION BY source, image_id, poly_id)""",
    ),
)
def round_report(spark, sf):
    """Four versions, each closer to the truth; some images lack one and lose those after it."""
    gt = X.polygons(spark, sf).select(*IDS, "ring")
    joined = gt.join(X.predicted(spark, sf).select(*IDS, F.col("ring").alias("moved")), IDS)
    steps = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(f).alias("f")) for s, f in (("gt", 1.0), ("aligned", 0.5), ("aligned_1", 0.25), ("aligned_2", 0.0))])
    rows = joined.withColumn("s", F.explode(steps))
    f = F.col("s.f")
    ring = F.zip_with("ring", "moved", lambda p, q: rings.point(p["i"] + (q["i"] - p["i"]) * f, p["j"] + (q["j"] - p["j"]) * f))
    versions = rows.select(*IDS, F.col("s.source").alias("source"), ring.alias("ring"))
    missing = ((F.col("image_id") % 4 == 1) & (F.col("source") == "aligned_1")) | ((F.col("image_id") % 4 == 2) & (F.col("source") == "aligned"))
    report = M.round_report(gt, versions.where(~missing), ["gt", "aligned", "aligned_1", "aligned_2"])
    return report.select("source", "image_id", "threshold", F.round("value", 6).alias("value"))


TANGENTS = {"ref": 4.0, "mid": 3.0, "rec": 2.0}
HEIGHTS = """SELECT image_id, poly_id, avg(h) AS height, count(*) AS pairs, ck FROM (
  SELECT a.image_id, a.poly_id, a.ck, sqrt((a.ci - b.ci) ** 2 + (a.cj - b.cj) ** 2) * (least(a.t, b.t) * greatest(a.t, b.t) / (greatest(a.t, b.t) - least(a.t, b.t))) * 0.5::DOUBLE AS h
  FROM centres a JOIN centres b ON a.image_id = b.image_id AND a.poly_id = b.poly_id AND a.view_id < b.view_id) GROUP BY image_id, poly_id, ck"""
CENTRES = """SELECT view_id, image_id, poly_id, ck, avg(i) AS ci, avg(j) AS cj, CASE view_id WHEN 'ref' THEN 4.0::DOUBLE WHEN 'mid' THEN 3.0 ELSE 2.0 END AS t
  FROM view_vertices GROUP BY view_id, image_id, poly_id, ck"""


def _heights(spark, sf):
    return M.building_heights(X.view_polygons(spark, sf), TANGENTS, 0.5)


@register(
    "building_heights",
    with_views("SELECT image_id, poly_id, round(height, 6) AS height, CAST(pairs AS INT) AS pairs FROM heights", "view_vertices", centres=CENTRES, heights=HEIGHTS),
)
def building_heights(spark, sf):
    return _heights(spark, sf).select(*IDS, F.round("height", 6).alias("height"), "pairs")


def _gt_heights(spark, sf):
    return X.buildings(spark, sf).select(*IDS, ((F.col("ck") % 8) * 9.0 + 1).alias("gt_height"))


@register(
    "height_error",
    with_views(
        """SELECT round(avg((ck % 8) * 9.0::DOUBLE + 1), 6) AS mean_gt, round(avg(height), 6) AS mean_pred, round(avg(abs((ck % 8) * 9.0::DOUBLE + 1 - height)), 6) AS mean_diff, count(*) AS n FROM heights""",
        "view_vertices", centres=CENTRES, heights=HEIGHTS,
    ),
)
def height_error(spark, sf):
    e = M.height_error(_heights(spark, sf), _gt_heights(spark, sf))
    return e.select(*[F.round(c, 6).alias(c) for c in ("mean_gt", "mean_pred", "mean_diff")], "n")


@register(
    "area_height_pairs",
    with_views(
        """SELECT h.image_id, h.poly_id, a.area * 0.25::DOUBLE AS area, round(abs((h.ck % 8) * 9.0::DOUBLE + 1 - h.height), 6) AS diff
        FROM heights h JOIN areas a USING (image_id, poly_id)""",
        "view_vertices", "areas", centres=CENTRES, heights=HEIGHTS,
    ),
)
def area_height_pairs(spark, sf):
    p = M.area_height_pairs(_heights(spark, sf), _gt_heights(spark, sf), X.polygons(spark, sf), 0.5)
    return p.select(*IDS, "area", F.round("diff", 6).alias("diff"))


HIST = """SELECT {by}b.n AS bin, e.lo + b.n * e.step AS lo, e.lo + (b.n + 1) * e.step AS hi, count(d.v) AS n
FROM (SELECT {by}min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 50 AS step FROM src {group}) e CROSS JOIN range(0, 50) AS b(n)
LEFT JOIN (SELECT *, o_totalprice AS v FROM src) d ON {on} least(CAST(floor((d.v - e.lo) / e.step) AS BIGINT), 49) = b.n GROUP BY {outer}b.n, e.lo, e.step"""


@register(
    "histogram50",
    "WITH src AS (SELECT * FROM orders) SELECT CAST(bin AS INT) AS bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM (" + HIST.format(by="", group="", on="", outer="") + ")",
)
def histogram50(spark, sf):
    h = M.histogram(X.table(spark, sf, "orders"), "o_totalprice", 50)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@register(
    "histogram_by_status",
    "WITH src AS (SELECT * FROM orders) SELECT o_orderstatus, CAST(bin AS INT) AS bin, n FROM (" + HIST.format(by="o_orderstatus, ", group="GROUP BY o_orderstatus", on="d.o_orderstatus = e.o_orderstatus AND ", outer="e.o_orderstatus, ").replace("SELECT o_orderstatus, b.n", "SELECT e.o_orderstatus, b.n") + ")",
)
def histogram_by_status(spark, sf):
    return M.histogram(X.table(spark, sf, "orders"), "o_totalprice", 50, ["o_orderstatus"]).select("o_orderstatus", "bin", "n")


@register(
    "channel_stretch",
    with_views(
        """SELECT image_id, band, i, j, round(CASE WHEN s > 0 THEN greatest(least((v - (m - 0.5 * s)) / (s) * 255, 255), 0) END, 6) AS value FROM (
          SELECT *, avg(v) OVER (PARTITION BY image_id, band) AS m, stddev_pop(v) OVER (PARTITION BY image_id, band) AS s
          FROM (SELECT *, greatest(least(value * 128 + 64, 255), 0) AS v FROM cells))""",
        "cells",
    ),
)
def channel_stretch(spark, sf):
    """Half a deviation, so that both ends are clipped."""
    p = X.cells(spark, sf).withColumn("value", F.col("value") * 128 + 64)
    return M.channel_stretch(p, 0.5).select("image_id", "band", "i", "j", F.round("value", 6).alias("value"))


@register(
    "z_score",
    with_views("SELECT image_id, i, j, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS value FROM cells WINDOW w AS (PARTITION BY image_id)", "cells"),
)
def z_score(spark, sf):
    return M.z_score(X.cells(spark, sf)).select("image_id", "i", "j", F.round("value", 6).alias("value"))


@register(
    "coverage_check",
    with_views(
        """SELECT m.image_id, count(v.poly_id) AS n, min(r0) AS min_i, min(c0) AS min_j, max(r1) AS max_i, max(c1) AS max_j,
          coalesce(NOT (max(r1) < 0 OR m.h < min(r0) OR max(c1) < 0 OR m.w < min(c0)), false) AS covered
        FROM (SELECT image_id, 5000 AS h, CASE WHEN image_id = 3 THEN -1 ELSE 5000 END AS w FROM images UNION ALL SELECT 99, 10, 10) m
        LEFT JOIN boxes v ON v.image_id = m.image_id GROUP BY m.image_id, m.h, m.w""",
        "boxes", "images",
    ),
)
def coverage_check(spark, sf):
    """Image 99 has no polygons, image 3 does not reach its own."""
    m = X.images(spark, sf).selectExpr("image_id", "height", "CASE WHEN image_id = 3 THEN -1 ELSE width END AS width")
    more = m.agg(F.lit(99).cast("long").alias("image_id"), F.lit(10).alias("height"), F.lit(10).alias("width"))
    return M.coverage_check(X.polygons(spark, sf), m.unionByName(more))


def _tile_field(spark, sf, factor=1.0):
    c = X.cells(spark, sf)
    return c.selectExpr("image_id", "i", "j", f"value * {factor}D AS di", f"(i - j) * 0.125D * {factor}D AS dj")


def _tile_layers(spark, sf):
    """Square fill, its outline, its corners."""
    c = X.cells(spark, sf).where("i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5")
    edge, corner = "(i IN (2, 5) OR j IN (2, 5))", "(i IN (2, 5) AND j IN (2, 5))"
    layers = F.expr(f"explode(filter(array('fill', IF({edge}, 'edge', NULL), IF({corner}, 'vertex', NULL)), l -> l IS NOT NULL)) AS layer")
    return c.select("image_id", "i", "j", layers).withColumn("value", F.lit(1.0))


LAYERS = """SELECT image_id, i, j, 'fill' AS layer FROM cells WHERE i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5
  UNION ALL SELECT image_id, i, j, 'edge' FROM cells WHERE i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5 AND (i IN (2, 5) OR j IN (2, 5))
  UNION ALL SELECT image_id, i, j, 'vertex' FROM cells WHERE i IN (2, 5) AND j IN (2, 5)"""
WEIGHT = """SELECT image_id, i, j, sum(CASE layer WHEN 'fill' THEN 0.1 / (16 + 1e-7) WHEN 'edge' THEN 1 / (12 + 1e-7) ELSE 10 / (4 + 1e-7) END::DOUBLE) AS w
  FROM layers GROUP BY image_id, i, j"""


@register(
    "displacement_error",
    with_views(
        """SELECT image_id, CAST(l.level AS INT) AS level, round(sum((power(value * (1 - l.f), 2) + power((i - j) * 0.125 * (1 - l.f), 2)) * w), 6) AS error, round(sum(w), 6) AS weight
        FROM cells JOIN weight USING (image_id, i, j) CROSS JOIN (VALUES (0, 0.5::DOUBLE), (1, 0.25)) AS l(level, f) GROUP BY image_id, l.level""",
        "cells", layers=LAYERS, weight=WEIGHT,
    ),
)
def displacement_error(spark, sf):
    levels = _tile_field(spark, sf, 0.5).withColumn("level", F.lit(0)).unionByName(_tile_field(spark, sf, 0.25).withColumn("level", F.lit(1)))
    e = M.displacement_error(_tile_field(spark, sf), levels, _tile_layers(spark, sf))
    return e.select("image_id", "level", F.round("error", 6).alias("error"), F.round("weight", 6).alias("weight"))


@register(
    "displacement_loss",
    with_views(
        """SELECT round(sum((power(value, 2) + power((i - j) * 0.125, 2)) * w) / (sum(w) + 1e-7), 6) AS loss FROM cells JOIN weight USING (image_id, i, j)""",
        "cells", layers=LAYERS, weight=WEIGHT,
    ),
)
def displacement_loss(spark, sf):
    """The baseline: zero prediction."""
    e = M.displacement_error(_tile_field(spark, sf), None, _tile_layers(spark, sf))
    return M.displacement_loss(e).select(F.round("loss", 6).alias("loss"))


@register(
    "segmentation_error",
    with_views(
        """SELECT image_id, round(avg((greatest(x, 0) - x * z + ln(1 + exp(-abs(x)))) * c), 6) AS error FROM (
          SELECT c.image_id, c.value * 4 - s.o AS x, s.c, CASE s.layer WHEN 'bg' THEN CASE WHEN c.i BETWEEN 2 AND 5 AND c.j BETWEEN 2 AND 5 THEN 0 ELSE 1 END
            ELSE CASE WHEN l.layer IS NULL THEN 0 ELSE 1 END END AS z
          FROM cells c CROSS JOIN (VALUES ('bg', 0.0::DOUBLE, 0.05::DOUBLE), ('fill', 0.5, 0.1), ('edge', 1.0, 1.0), ('vertex', 1.5, 10.0)) AS s(layer, o, c)
          LEFT JOIN layers l ON l.image_id = c.image_id AND l.i = c.i AND l.j = c.j AND l.layer = s.layer) GROUP BY image_id""",
        "cells", layers=LAYERS,
    ),
)
def segmentation_error(spark, sf):
    offsets = F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(o).alias("o")) for n, o in (("bg", 0.0), ("fill", 0.5), ("edge", 1.0), ("vertex", 1.5))])
    x = X.cells(spark, sf).withColumn("s", F.explode(offsets))
    logits = x.select("image_id", F.lit(0).alias("level"), "i", "j", "s.layer", (F.col("value") * 4 - F.col("s.o")).alias("x"))
    e = M.segmentation_error(_tile_layers(spark, sf), logits)
    return e.select("image_id", F.round("error", 6).alias("error"))


@register(
    "laplacian_penalty",
    with_views(
        """SELECT image_id, round(sum(a * a + b * b) / 64, 6) AS penalty FROM (
          SELECT c.image_id, c.i, c.j, sum(n.value * t.w) AS a, sum((n.i - n.j) * 0.125 * t.w) AS b
          FROM cells c CROSS JOIN (VALUES (-1,-1,0.5::DOUBLE),(-1,0,1.0),(-1,1,0.5),(0,-1,1.0),(0,0,-6.0),(0,1,1.0),(1,-1,0.5),(1,0,1.0),(1,1,0.5)) AS t(a, b, w)
          JOIN cells n ON n.image_id = c.image_id AND n.i = c.i + t.a AND n.j = c.j + t.b GROUP BY c.image_id, c.i, c.j) GROUP BY image_id""",
        "cells",
    ),
)
def laplacian_penalty(spark, sf):
    return M.laplacian_penalty(_tile_field(spark, sf), 8, 8).select("image_id", F.round("penalty", 6).alias("penalty"))


@register(
    "total_loss",
    """SELECT event_id AS step, round(100 * value + 50 * (value / 2) + 0 * (value * 3), 6) AS loss FROM events""",
)
def total_loss(spark, sf):
    terms = X.table(spark, sf, "events").selectExpr(
        "event_id AS step", "stack(3, 'displacement', value, 'segmentation', value / 2, 'laplacian', value * 3) AS (term, value)"
    )
    return M.total_loss(terms).select("step", F.round("loss", 6).alias("loss"))


@register(
    "mask_iou_polygons",
    with_views(
        """SELECT image_id, t.t AS threshold, CAST(count(*) FILTER (WHERE p AND g AND t.t < 0.5) AS BIGINT) AS inter,
          CAST(count(*) FILTER (WHERE (p AND t.t < 0.5) OR g) AS BIGINT) AS uni FROM (
            SELECT image_id, i, j, bool_or(s = 0) AS g, bool_or(s = 1) AS p FROM (
              SELECT DISTINCT image_id, 0 AS s, i.i, j.j FROM (SELECT image_id, ceil(r0 / 8)::BIGINT AS a, floor(r1 / 8)::BIGINT AS b, ceil(c0 / 8)::BIGINT AS c, floor(c1 / 8)::BIGINT AS d FROM rects) r,
                LATERAL (SELECT unnest(generate_series(r.a, r.b)) AS i) i, LATERAL (SELECT unnest(generate_series(r.c, r.d)) AS j) j
              UNION ALL SELECT DISTINCT image_id, 1, i.i, j.j FROM (SELECT image_id, ceil((r0 + 8) / 8)::BIGINT AS a, floor((r1 + 8) / 8)::BIGINT AS b, ceil(c0 / 8)::BIGINT AS c, floor(c1 / 8)::BIGINT AS d FROM rects) r,
                LATERAL (SELECT unnest(generate_series(r.a, r.b)) AS i) i, LATERAL (SELECT unnest(generate_series(r.c, r.d)) AS j) j)
            GROUP BY image_id, i, j) CROSS JOIN (VALUES (0.25::DOUBLE), (0.75)) AS t(t) GROUP BY image_id, t.t""",
        "rects",
    ),
)
def mask_iou_polygons(spark, sf):
    """Filled buildings at an eighth of the size against themselves moved down by one cell."""
    p = X.polygons(spark, sf).select("image_id", rings.scale(F.col("ring"), F.lit(0.125)).alias("ring"))
    moved = p.withColumn("ring", rings.shift(F.col("ring"), F.lit(1.0), F.lit(0.0)))
    pred = R.fill_cells(moved).withColumn("value", F.lit(0.5))
    out = M.mask_iou_curve(pred, R.fill_cells(p), ["image_id"], [0.25, 0.75], margin=0)
    return out.select("image_id", "threshold", "inter", "uni")

