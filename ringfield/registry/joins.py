"""Patch joins, overlaps, fields and edge joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield import fixtures as X
from ringfield.functions import rings
from ringfield.operators import edge_joins as E
from ringfield.operators import fields as D
from ringfield.operators import geometry as G
from ringfield.operators import metrics as M
from ringfield.operators import overlap as O
from ringfield.operators import tiles as T
from ringfield.operators import windows as N
from ringfield.registry.base import register, uniform_sql, with_views

IDS = ["image_id", "poly_id"]

PATCHES = """SELECT m.image_id, CAST(a.n * 49 + b.n AS INT) AS patch_id,
  CAST(CASE WHEN a.n = 48 THEN 5000 - 220 ELSE a.n * 100 END AS INT) AS r0, CAST(CASE WHEN b.n = 48 THEN 5000 - 220 ELSE b.n * 100 END AS INT) AS c0,
  CAST(CASE WHEN a.n = 48 THEN 5000 ELSE a.n * 100 + 220 END AS INT) AS r1, CAST(CASE WHEN b.n = 48 THEN 5000 ELSE b.n * 100 + 220 END AS INT) AS c1
FROM images m CROSS JOIN range(0, 49) AS a(n) CROSS JOIN range(0, 49) AS b(n)"""


def _patches(spark, sf):
    return T.patch_grid(X.images(spark, sf), 100, 220)


@register("patch_grid", with_views("SELECT * FROM patches", "images", patches=PATCHES))
def patch_grid(spark, sf):
    return _patches(spark, sf)


@register(
    "polygons_touching_patches",
    with_views(
        """SELECT image_id, patch_id, poly_id, k, i - r0 AS i, j - c0 AS j FROM (
          SELECT DISTINCT v.image_id, v.poly_id, p.patch_id, p.r0, p.c0 FROM vertices v JOIN patches p
          ON v.image_id = p.image_id AND v.i BETWEEN p.r0 AND p.r1 AND v.j BETWEEN p.c0 AND p.c1)
        JOIN vertices USING (image_id, poly_id)""",
        "vertices", "images", patches=PATCHES,
    ),
)
def polygons_touching_patches(spark, sf):
    t = T.polygons_touching_patches(X.polygons(spark, sf), _patches(spark, sf))
    return G.explode_ring(t.select("image_id", "patch_id", "poly_id", "ring"))


@register(
    "polygons_within_patches",
    with_views(
        """SELECT b.image_id, b.poly_id, p.patch_id FROM boxes b JOIN patches p ON b.image_id = p.image_id
        AND b.r0 >= p.r0 AND b.r1 <= p.r1 AND b.c0 >= p.c0 AND b.c1 <= p.c1""",
        "boxes", "images", patches=PATCHES,
    ),
)
def polygons_within_patches(spark, sf):
    return T.polygons_within_patches(X.polygons(spark, sf), _patches(spark, sf)).select(*IDS, "patch_id")


@register(
    "polygons_within_box",
    with_views("SELECT image_id, poly_id FROM boxes WHERE r0 >= 1000 AND r1 <= 2500.5 AND c0 >= 500 AND c1 <= 4000", "boxes"),
)
def polygons_within_box(spark, sf):
    return T.polygons_within_box(X.polygons(spark, sf), 1000, 500, 2500.5, 4000).select(*IDS)


PAIRS = """SELECT a.image_id, a.poly_id AS poly_a, b.poly_id AS poly_b,
  sum(greatest(0.0, least(a.r1, b.r1) - greatest(a.r0, b.r0)) * greatest(0.0, least(a.c1, b.c1) - greatest(a.c0, b.c0))) AS shared
FROM rects a JOIN rects b ON a.image_id = b.image_id AND a.poly_id < b.poly_id
  AND a.r0 < b.r1 AND b.r0 < a.r1 AND a.c0 < b.c1 AND b.c0 < a.c1
GROUP BY a.image_id, a.poly_id, b.poly_id"""


@register("overlapping_pairs", with_views("SELECT * FROM pairs WHERE shared > 0", "rects", pairs=PAIRS))
def overlapping_pairs(spark, sf):
    """Shared area of rectangles and L shapes."""
    return O.overlapping_pairs(X.polygons(spark, sf)).select("image_id", "poly_a", "poly_b", "shared")


@register(
    "polygon_iou",
    with_views(
        """SELECT p.image_id, p.poly_a, p.poly_b, a.area + b.area - p.shared AS union_area,
          round(p.shared / (a.area + b.area - p.shared), 6) AS iou
        FROM pairs p JOIN areas a ON a.image_id = p.image_id AND a.poly_id = p.poly_a
        JOIN areas b ON b.image_id = p.image_id AND b.poly_id = p.poly_b WHERE p.shared > 0""",
        "areas", pairs=PAIRS,
    ),
)
def polygon_iou(spark, sf):
    out = O.polygon_iou(O.overlapping_pairs(X.polygons(spark, sf)))
    return out.select("image_id", "poly_a", "poly_b", "union_area", F.round("iou", 6).alias("iou"))


@register(
    "intersecting_any",
    with_views(
        """SELECT DISTINCT a.image_id, a.poly_id FROM rects a JOIN rects b ON a.image_id = b.image_id AND a.poly_id % 2 = 0
          AND b.poly_id % 2 = 1 AND a.r0 < b.r1 AND b.r0 < a.r1 AND a.c0 < b.c1 AND b.c0 < a.c1""",
        "rects",
    ),
)
def intersecting_any(spark, sf):
    """Even buildings that meet an odd one."""
    p = X.polygons(spark, sf)
    return O.intersecting_any(p.where("poly_id % 2 = 0"), p.where("poly_id % 2 = 1")).select(*IDS)


@register(
    "largest_per_cluster",
    with_views(
        """SELECT image_id, cluster, max_by(poly_id, area * 1000000.0 - poly_id * 0.000001) AS poly_id, max(area) AS area, count(*) AS members
        FROM (SELECT l.image_id, l.poly_id, min(l.other) AS cluster, any_value(a.area) AS area FROM reach l
          JOIN areas a ON a.image_id = l.image_id AND a.poly_id = l.poly_id GROUP BY l.image_id, l.poly_id)
        GROUP BY image_id, cluster""",
        "areas", recursive=True, pairs=PAIRS,
        links="""SELECT image_id, poly_a AS a, poly_b AS b FROM pairs WHERE shared > 0
          UNION ALL SELECT image_id, poly_b, poly_a FROM pairs WHERE shared > 0""",
        reach="""SELECT image_id, poly_id, poly_id AS other FROM buildings
          UNION SELECT r.image_id, r.poly_id, l.b FROM reach r JOIN links l ON l.image_id = r.image_id AND l.a = r.other""",
    ),
)
def largest_per_cluster(spark, sf):
    return O.largest_per_cluster(X.polygons(spark, sf))


BAND_ID = "(CAST(floor(r0 / 32) AS BIGINT) * 5000 + CAST(c0 AS BIGINT)) * 100000000 + poly_id"


@register(
    "largest_per_running_cluster",
    with_views(
        f"""SELECT image_id, start, poly_id, area FROM (SELECT c.image_id, c.start, c.poly_id, a.area,
          row_number() OVER (PARTITION BY c.image_id, c.start ORDER BY a.area DESC, c.poly_id) AS rn
          FROM chain c JOIN areas a ON a.image_id = c.image_id AND a.poly_id = c.poly_id % 100000000) WHERE rn = 1""",
        "areas", recursive=True, pairs=PAIRS,
        ids=f"SELECT image_id, poly_id AS old, {BAND_ID} AS poly_id FROM buildings",
        partners="""SELECT image_id, greatest(a, b) AS poly_id, max(least(a, b)) AS m FROM (
          SELECT p.image_id, x.poly_id AS a, y.poly_id AS b FROM pairs p JOIN ids x ON x.old = p.poly_a JOIN ids y ON y.old = p.poly_b
          WHERE p.shared > 0) GROUP BY image_id, greatest(a, b)""",
        ordered="""SELECT i.image_id, i.poly_id, p.m, row_number() OVER (PARTITION BY i.image_id ORDER BY i.poly_id) AS rn
          FROM ids i LEFT JOIN partners p ON p.image_id = i.image_id AND p.poly_id = i.poly_id""",
        chain="""SELECT image_id, poly_id, poly_id AS start, rn FROM ordered WHERE rn = 1
          UNION ALL SELECT o.image_id, o.poly_id, CASE WHEN o.m >= c.start THEN c.start ELSE o.poly_id END, o.rn
          FROM chain c JOIN ordered o ON o.image_id = c.image_id AND o.rn = c.rn + 1""",
    ),
)
def largest_per_running_cluster(spark, sf):
    """Ids follow bands of 32 rows, so that overlapping buildings often succeed each other."""
    p = X.polygons(spark, sf).withColumn("b", rings.box(F.col("ring")))
    ids = (F.floor(F.col("b.r0") / 32) * 5000 + F.col("b.c0").cast("long")) * 100000000 + F.col("poly_id")
    return O.largest_per_running_cluster(p.select("image_id", ids.alias("poly_id"), "ring"))


FIELD_AT = """((n.ci * 7 + n.cj * 3 + n.map_id * 5) % 17 - 8) * 0.25::DOUBLE"""
FIELD_AT_J = """((n.ci * 5 + n.cj * 11 + n.map_id * 3) % 17 - 8) * 0.25::DOUBLE"""


def _moved_sql(sign: str, scale: str = "1") -> str:
    return f"""SELECT n.image_id, n.poly_id, n.k, CAST(n.map_id AS INT) AS map_id, n.i {sign} {FIELD_AT} * {scale} AS i, n.j {sign} {FIELD_AT_J} * {scale} AS j
    FROM (SELECT v.*, m.map_id, CAST(least(greatest(round_even(v.i, 0), 0), 624) AS BIGINT) AS ci,
      CAST(least(greatest(round_even(v.j, 0), 0), 624) AS BIGINT) AS cj
      FROM pred v CROSS JOIN (VALUES (0), (1)) AS m(map_id)) n"""


@register("apply_field_plus", with_views(_moved_sql("+"), "pred"))
def apply_field_plus(spark, sf):
    v = G.explode_ring(X.predicted(spark, sf)).select(*IDS, "k", "i", "j")
    return D.apply_field(v, X.field(spark), X.FIELD_SIDE, X.FIELD_SIDE, 1)


@register("apply_field_minus", with_views(_moved_sql("-"), "pred"))
def apply_field_minus(spark, sf):
    v = G.explode_ring(X.predicted(spark, sf)).select(*IDS, "k", "i", "j")
    return D.apply_field(v, X.field(spark), X.FIELD_SIDE, X.FIELD_SIDE, -1)


@register("displace_polygons", with_views(_moved_sql("-", "0.125 * 16"), "pred"))
def displace_polygons(spark, sf):
    """A field in [-2, 2] scaled as if normalised."""
    v = G.explode_ring(X.predicted(spark, sf)).select(*IDS, "k", "i", "j")
    f = X.field(spark).selectExpr("map_id", "i", "j", "di * 0.125D AS di", "dj * 0.125D AS dj")
    return D.displace_polygons(v, f, X.FIELD_SIDE, X.FIELD_SIDE, 16)


@register(
    "match_distance",
    with_views("SELECT image_id, poly_id, k, d FROM distances", "distances", once=True),
)
def match_distance(spark, sf):
    m = M.match_vertices(X.vertices(spark, sf), G.explode_ring(X.predicted(spark, sf)))
    di, dj = F.col("gi") - F.col("pi"), F.col("gj") - F.col("pj")
    return m.select(*IDS, "k", F.sqrt(di * di + dj * dj).alias("d"))


VIEWS_SQL = "(SELECT DISTINCT concat('v', o_custkey % 16) AS view_id FROM orders)"


@register("view_combinations", f"SELECT a.view_id AS view_id_1, b.view_id AS view_id_2 FROM {VIEWS_SQL} a JOIN {VIEWS_SQL} b ON a.view_id < b.view_id")
def view_combinations(spark, sf):
    return M.view_pairs(X.images(spark, sf).selectExpr("concat('v', image_id) AS view_id"))


@register("view_permutations", f"SELECT a.view_id AS view_id_1, b.view_id AS view_id_2 FROM {VIEWS_SQL} a JOIN {VIEWS_SQL} b ON a.view_id <> b.view_id")
def view_permutations(spark, sf):
    return M.view_pairs(X.images(spark, sf).selectExpr("concat('v', image_id) AS view_id"), ordered=True)


# A crossing of a horizontal and a vertical side lies in the tile of the one's row and the other's column.
LEVEL_SIDES = """SELECT *, CAST(floor(i1 / 64) AS BIGINT) AS bi,
  unnest(range(CAST(floor(least(j1, j2) / 64) AS BIGINT), CAST(floor(greatest(j1, j2) / 64) AS BIGINT) + 1)) AS bj FROM ring_edges WHERE i1 = i2"""
UPRIGHT_SIDES = """SELECT *, unnest(range(CAST(floor(least(i1, i2) / 64) AS BIGINT), CAST(floor(greatest(i1, i2) / 64) AS BIGINT) + 1)) AS bi,
  CAST(floor(j1 / 64) AS BIGINT) AS bj FROM ring_edges WHERE j1 = j2"""


@register(
    "edge_crossings",
    with_views(
        """SELECT image_id, CASE WHEN h_first THEN hp ELSE vp END AS poly_id, CASE WHEN h_first THEN hk ELSE vk END AS k,
            CASE WHEN h_first THEN vp ELSE hp END AS poly_id_b, CASE WHEN h_first THEN vk ELSE hk END AS k_b, i, j FROM (
          SELECT h.image_id, h.poly_id AS hp, h.k AS hk, v.poly_id AS vp, v.k AS vk, h.i1 AS i, v.j1 AS j,
            h.poly_id < v.poly_id OR (h.poly_id = v.poly_id AND h.k < v.k) AS h_first
          FROM h JOIN v ON h.image_id = v.image_id AND h.bi = v.bi AND h.bj = v.bj
          WHERE h.i1 BETWEEN least(v.i1, v.i2) AND greatest(v.i1, v.i2) AND v.j1 BETWEEN least(h.j1, h.j2) AND greatest(h.j1, h.j2)
            AND NOT ((h.i1 = v.i1 AND h.j1 = v.j1) OR (h.i1 = v.i2 AND h.j1 = v.j2) OR (h.i2 = v.i1 AND h.j2 = v.j1) OR (h.i2 = v.i2 AND h.j2 = v.j2)))""",
        "ring_edges", once=True, h=LEVEL_SIDES, v=UPRIGHT_SIDES,
    ),
)
def edge_crossings(spark, sf):
    """Axis-parallel sides meet where one is horizontal and one vertical, in one building or in two."""
    out = E.edge_crossings(G.edges(X.polygons(spark, sf)), ends=False)
    return out.select(*IDS, "k", "poly_id_b", "k_b", (F.col("i") + 0.0).alias("i"), (F.col("j") + 0.0).alias("j"))


@register(
    "self_crossings",
    with_views(
        "SELECT image_id, poly_id, CAST(1 AS INT) AS k, CAST(3 AS INT) AS k_b, (r0 + r1) / 2 AS i, (c0 + c1) / 2 AS j FROM boxes WHERE n = 4", "boxes"
    ),
)
def self_crossings(spark, sf):
    """Rectangles whose last two corners change places cross themselves in the middle; L shapes do not."""
    ring = F.col("ring")
    tied = F.concat(F.slice("ring", 1, 2), F.slice("ring", 4, 1), F.slice("ring", 3, 1))
    p = X.polygons(spark, sf).select(*IDS, F.when(F.size("ring") == 4, tied).otherwise(ring).alias("ring"))
    out = E.edge_crossings(G.edges(G.settled(p)), within=True)
    return out.select(*IDS, "k", "k_b", F.round("i", 6).alias("i"), F.round("j", 6).alias("j"))


ON = "sqrt(({p}i{x} - {q}i1) ** 2 + ({p}j{x} - {q}j1) ** 2) + sqrt(({p}i{x} - {q}i2) ** 2 + ({p}j{x} - {q}j2) ** 2) < sqrt(({q}i1 - {q}i2) ** 2 + ({q}j1 - {q}j2) ** 2) + 0.5"
ON_SUM = " + ".join(f"CAST({ON.format(p=p, q=q, x=x)} AS INT)" for p, q in (("a.", "b."), ("b.", "a.")) for x in (1, 2))
SAME_SUM = " - ".join(f"CAST(a.i{x} = b.i{y} AND a.j{x} = b.j{y} AS INT)" for x in (1, 2) for y in (1, 2))


# Sides in the tiles that their boxes reach, grown by half a pixel; a pair is taken in the tile of the near corner of both boxes.
TILED_SIDES = """SELECT *, unnest(range(CAST(floor(c0 / 64) AS BIGINT), CAST(floor(c1 / 64) AS BIGINT) + 1)) AS bj FROM (
  SELECT *, unnest(range(CAST(floor(r0 / 64) AS BIGINT), CAST(floor(r1 / 64) AS BIGINT) + 1)) AS bi FROM (
    SELECT *, least(i1, i2) - 0.5 AS r0, greatest(i1, i2) + 0.5 AS r1, least(j1, j2) - 0.5 AS c0, greatest(j1, j2) + 0.5 AS c1 FROM ring_edges))"""


@register(
    "edge_overlaps",
    with_views(
        f"""SELECT * FROM (SELECT a.image_id, a.poly_id, a.k, b.poly_id AS poly_id_b, b.k AS k_b, CAST({ON_SUM} - {SAME_SUM} AS INT) AS on_edge
        FROM tiled a JOIN tiled b ON a.image_id = b.image_id AND a.bi = b.bi AND a.bj = b.bj
        WHERE (a.poly_id < b.poly_id OR (a.poly_id = b.poly_id AND a.k < b.k))
        AND floor(greatest(a.r0, b.r0) / 64) = a.bi AND floor(greatest(a.c0, b.c0) / 64) = a.bj
        AND a.r0 <= b.r1 AND b.r0 <= a.r1 AND a.c0 <= b.c1 AND b.c0 <= a.c1) WHERE on_edge >= 2""",
        "ring_edges", once=True, tiled=TILED_SIDES,
    ),
)
def edge_overlaps(spark, sf):
    out = E.edge_overlaps(G.edges(X.polygons(spark, sf)), 0.5, ends=False)
    return out.select(*IDS, "k", "poly_id_b", "k_b", "on_edge")


@register(
    "edge_connectivity",
    """SELECT o_orderkey AS poly_id, v.v1, v.v2, CAST(v.n AS BIGINT) AS triangles FROM orders
    CROSS JOIN (VALUES (0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1), (0, 2, 2), (1, 3, 0)) AS v(v1, v2, n)""",
)
def edge_connectivity(spark, sf):
    """Rectangles cut along a diagonal: the diagonal has two triangles, the other one none."""
    ids = X.buildings(spark, sf).select("poly_id")

    def listed(name, rows):
        return F.explode(F.array(*[F.array(*[F.lit(v) for v in r]) for r in rows])).alias(name)

    asked = ids.select("poly_id", listed("e", [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3)]))
    asked = asked.select("poly_id", F.col("e")[0].alias("v1"), F.col("e")[1].alias("v2"))
    triangles = ids.select("poly_id", listed("t", [(0, 1, 2), (0, 2, 3)]))
    return E.edge_connectivity(asked, triangles, ["poly_id"])


@register(
    "merge_faces",
    """SELECT o_orderkey AS poly_id, CAST(0 AS INT) AS outline, CAST(k.k AS INT) AS pos,
      o_orderkey * 16 + CASE WHEN o_orderkey % 2 = 0 THEN k.k ELSE (n - k.k) % n END AS v
    FROM (SELECT o_orderkey, 4 + o_orderkey % 5 AS n FROM orders) JOIN range(0, 8) AS k(k) ON k.k < n
    UNION ALL
    SELECT o_orderkey AS poly_id, CAST(w.o AS INT) AS outline, CAST(w.pos AS INT) AS pos, o_orderkey * 16 + w.v AS v
    FROM orders JOIN (VALUES (1, 0, 8), (1, 1, 9), (1, 2, 10), (1, 3, 11), (2, 0, 12), (2, 1, 15), (2, 2, 14), (2, 3, 13)) AS w(o, pos, v) ON o_orderkey % 3 = 0""",
)
def merge_faces(spark, sf):
    """Rings of 4 to 8 vertices cut along a chord, in both directions, give the ring back; every third building has a frame cut in two besides, which gives its outer and its inner outline."""
    base, n = F.col("poly_id") * 16, F.col("n")
    shifted = X.buildings(spark, sf).select("poly_id", (4 + F.col("poly_id") % 5).alias("n"), (F.col("poly_id") % 7).alias("turn"))
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda k: base + (k + F.col("turn")) % n)
    ring = shifted.select("poly_id", "n", F.when(F.col("poly_id") % 2 == 0, ring).otherwise(F.reverse(ring)).alias("ring"))
    # The chord joins the first vertex with one in the middle.
    middle = (F.col("poly_id") % (n - 3) + 3).cast("int")
    first = F.slice("ring", F.lit(1), middle)
    second = F.concat(F.slice("ring", F.lit(1), F.lit(1)), F.slice("ring", middle, (n - middle + 1).cast("int")))
    cut = ring.select("poly_id", F.lit(0).alias("part"), F.explode(F.array(first, second)).alias("face"))
    halves = [(8, 9, 13, 12, 15, 11), (9, 10, 11, 15, 14, 13)]
    frames = X.buildings(spark, sf).where("poly_id % 3 = 0").select(
        "poly_id", F.lit(1).alias("part"), F.explode(F.array(*[F.array(*[F.col("poly_id") * 16 + v for v in h]) for h in halves])).alias("face")
    )
    out = E.merge_faces(cut.unionByName(frames), ["poly_id", "part"])
    low = F.get("face", F.lit(0)) - F.col("poly_id") * 16
    number = F.col("part") + F.when(low == 12, 1).otherwise(0)
    return out.select("poly_id", number.cast("int").alias("outline"), F.posexplode("face").alias("pos", "v"))


@register(
    "attach_props",
    with_views(
        """SELECT image_id, poly_id, CASE WHEN poly_id % 5 = 0 THEN 'old' ELSE CAST(h AS VARCHAR) END AS height, 'brick' AS material FROM buildings""",
        "buildings",
    ),
)
def attach_props(spark, sf):
    """HEIGHT is replaced except where no value exists; other properties stay."""
    from ringfield.sources.writers import attach_props as attach

    b = X.buildings(spark, sf)
    props = F.create_map(F.lit("HEIGHT"), F.lit("old"), F.lit("MATERIAL"), F.lit("brick"))
    p = b.select(*IDS, props.alias("props"))
    values = b.where("poly_id % 5 <> 0").select(*IDS, F.col("h").alias("value"))
    out = attach(p, values, "HEIGHT")
    return out.select(*IDS, F.col("props")["HEIGHT"].alias("height"), F.col("props")["MATERIAL"].alias("material"))


@register(
    "schedule_lookup",
    """SELECT event_id AS step, CASE WHEN event_id <= 2500 THEN 0.5 WHEN event_id <= 5000 THEN 0.75 WHEN event_id <= 7500 THEN 0.9 ELSE 1.0 END::DOUBLE AS coef,
      CASE WHEN event_id <= 25000 THEN 0.0001 ELSE 0.00005 END::DOUBLE AS rate FROM events""",
)
def schedule_lookup(spark, sf):
    steps = X.table(spark, sf, "events").select(F.col("event_id").alias("step"))
    coefs = M.schedule_lookup(steps, [2500, 5000, 7500], [0.5, 0.75, 0.9, 1.0])
    return M.schedule_lookup(coefs, [25000], [1e-4, 0.5e-4], "rate")


@register(
    "threshold_cross",
    with_views("SELECT threshold, count(*) AS n FROM distances JOIN (SELECT * FROM thresholds WHERE threshold = floor(threshold)) t ON d <= threshold GROUP BY threshold", "distances", "thresholds"),
)
def threshold_cross(spark, sf):
    d = M.matched_rings(X.polygons(spark, sf), X.predicted(spark, sf)).select(F.explode_outer("d").alias("d"))
    return M.threshold_cross(d, M.ALIGN_THRESHOLDS, integers_only=True).groupBy("threshold").agg(F.count("*").alias("n"))


BATCH = """SELECT image_id, poly_id, CAST(rn // 12 AS BIGINT) AS batch, CAST(rn % 12 AS INT) AS slot
FROM (SELECT image_id, poly_id, row_number() OVER (PARTITION BY image_id ORDER BY poly_id) - 1 AS rn FROM buildings)"""


@register(
    "batches_padded",
    with_views(
        f"""SELECT * FROM b UNION ALL SELECT l.image_id, l.poly_id, l.batch, CAST(s.n AS INT) FROM
        (SELECT image_id, max_by(poly_id, batch * 12 + slot) AS poly_id, max(batch) AS batch, max(batch * 12 + slot) % 12 AS slot FROM b GROUP BY image_id) l
        JOIN range(0, 12) AS s(n) ON s.n > l.slot""",
        "buildings", b=BATCH,
    ),
)
def batches_padded(spark, sf):
    return N.batches(X.buildings(spark, sf).select(*IDS), 12, "poly_id", ["image_id"], pad=True)


@register(
    "batches",
    "SELECT o_orderkey AS poly_id, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS BIGINT) AS batch, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 32 AS INT) AS slot FROM orders",
)
def batches(spark, sf):
    return N.batches(X.buildings(spark, sf).select("poly_id"), 32, "poly_id")


@register(
    "shard_number",
    with_views("SELECT image_id, shard, count(*) AS n FROM (SELECT image_id, CAST((row_number() OVER (PARTITION BY image_id ORDER BY poly_id) - 1) // 100 AS BIGINT) AS shard FROM buildings) GROUP BY image_id, shard", "buildings"),
)
def shard_number(spark, sf):
    s = N.shard_number(X.buildings(spark, sf).select(*IDS), 100, "poly_id", ["image_id"])
    return s.groupBy("image_id", "shard").agg(F.count("*").alias("n"))


@register("shuffled", with_views("SELECT image_id, poly_id FROM buildings", "buildings"))
def shuffled(spark, sf):
    """All rows in a random order (the check ignores order)."""
    return N.shuffle(X.buildings(spark, sf).select(*IDS), 7, "poly_id")


@register(
    "choose_map",
    with_views(f"SELECT image_id, poly_id, CAST(floor({uniform_sql(3, 'image_id', 'poly_id')} * (1 + poly_id % 4)) AS INT) AS map_id FROM buildings", "buildings"),
)
def choose_map(spark, sf):
    b = X.buildings(spark, sf).selectExpr(*IDS, "1 + poly_id % 4 AS map_count")
    return N.choose_map(b, 3, IDS).select(*IDS, "map_id")


@register(
    "stitch_patches",
    with_views(
        """SELECT image_id, i, j, max_by(value, patch_id) AS value FROM (
          SELECT image_id, 0 AS patch_id, i, j, value FROM cells
          UNION ALL SELECT image_id, 1 + band, CAST(i + 4 AS INT), CAST(j + band % 3 AS INT), value * 2 FROM cells)
        GROUP BY image_id, i, j""",
        "cells",
    ),
)
def stitch_patches(spark, sf):
    c = X.cells(spark, sf)
    first = c.selectExpr("image_id", "0 AS patch_id", "i", "j", "value")
    second = c.selectExpr("image_id", "1 + band AS patch_id", "i + 4 AS i", "CAST(j + band % 3 AS INT) AS j", "value * 2 AS value")
    return N.stitch_patches(first.unionByName(second))


@register(
    "field_patch_cycle",
    """SELECT c_custkey AS image_id, CAST(rn // 256 AS BIGINT) AS field_id, CAST(rn % 256 AS INT) AS patch_id
    FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rn FROM customer)""",
)
def field_patch_cycle(spark, sf):
    return N.field_patch_cycle(X.table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id")), 256)


@register(
    "keep_patches_with_vertices",
    with_views(
        """SELECT DISTINCT p.image_id, p.patch_id FROM patches p JOIN pred v ON v.image_id = p.image_id
        AND round_even(v.i, 0) >= p.r0 + 10 AND round_even(v.i, 0) < p.r1 - 10 AND round_even(v.j, 0) >= p.c0 + 10 AND round_even(v.j, 0) < p.c1 - 10""",
        "pred", "images", patches=PATCHES,
    ),
)
def keep_patches_with_vertices(spark, sf):
    v = G.snap_int(G.explode_ring(X.predicted(spark, sf)))
    cells = v.select("image_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    return T.keep_patches_with_vertices(_patches(spark, sf), cells, 200).select("image_id", "patch_id")


@register(
    "cyclic_distance",
    with_views(
        """SELECT image_id, poly_id, min(mean) AS mean, CAST(min_by(s, mean * 1000 + s * 0.000001) AS INT) AS shift FROM (
          SELECT a.image_id, a.poly_id, s.s, sum(sqrt((a.i - b.i) ** 2 + (a.j - b.j) ** 2)) / count(*) AS mean
          FROM vertices a JOIN boxes n USING (image_id, poly_id) JOIN range(0, 6) AS s(s) ON s.s < n.n
          JOIN pred b ON b.image_id = a.image_id AND b.poly_id = a.poly_id AND b.k = (a.k + s.s + 1) % n.n
          GROUP BY a.image_id, a.poly_id, s.s) GROUP BY image_id, poly_id""",
        "pred", "boxes",
    ).replace("min(mean) AS mean", "round(min(mean), 6) AS mean"),
)
def cyclic_distance(spark, sf):
    """The second set starts one vertex later."""
    a = X.polygons(spark, sf).select(*IDS, "ring")
    rolled = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1))
    b = X.predicted(spark, sf).select(*IDS, rolled.alias("other"))
    # The rotated copy sits at k - 1, so a vertex meets it after k + s = k' + 1.
    m = a.join(b, IDS).select(*IDS, rings.cyclic_match(F.col("ring"), F.col("other")).alias("m"))
    return m.select(*IDS, F.round("m.mean", 6).alias("mean"), "m.shift")
