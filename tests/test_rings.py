"""Hand-computed rings, angles, simplification and projections."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ringfield.functions import rings
from ringfield.functions.numeric import count_below, frange
from ringfield.operators import geometry as G

RING = "ARRAY<STRUCT<i: DOUBLE, j: DOUBLE>>"


def polygons(spark, *shapes):
    rows = [(0, n, [tuple(map(float, p)) for p in s]) for n, s in enumerate(shapes)]
    return spark.createDataFrame(rows, f"image_id BIGINT, poly_id BIGINT, ring {RING}")


def ring_of(df, poly=0):
    return [(p.i, p.j) for p in df.where(F.col("poly_id") == poly).first().ring]


def test_orientation_is_idempotent(spark):
    p = polygons(spark, [(0, 0), (0, 2), (2, 2), (2, 0)], [(0, 0), (2, 0), (2, 2), (0, 2)])
    once = G.orient(p)
    assert ring_of(once, 0) == ring_of(G.orient(once), 0) == [(2, 0), (2, 2), (0, 2), (0, 0)]
    assert ring_of(once, 1) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert {r.clockwise for r in G.orientation(G.orient(p, clockwise=False)).collect()} == {False}


def brute_simplify(points, tolerance):
    """Recursive form, written on its own."""

    def gap(p, a, b):
        di, dj = b[0] - a[0], b[1] - a[1]
        span = di * di + dj * dj
        t = 0.0 if span == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * di + (p[1] - a[1]) * dj) / span))
        return math.hypot(p[0] - a[0] - t * di, p[1] - a[1] - t * dj)

    if len(points) < 3:
        return points
    gaps = [gap(p, points[0], points[-1]) for p in points[1:-1]]
    far = max(range(len(gaps)), key=lambda n: gaps[n])
    if gaps[far] <= tolerance:
        return [points[0], points[-1]]
    return brute_simplify(points[: far + 2], tolerance)[:-1] + brute_simplify(points[far + 1 :], tolerance)


def test_simplify_matches_recursion(spark):
    draw = random.Random(4)
    shapes = [[(draw.uniform(0, 30), draw.uniform(0, 30)) for _ in range(draw.randint(2, 40))] for _ in range(60)]
    shapes += [s + s[:1] for s in shapes]
    out = {r.poly_id: [(p.i, p.j) for p in r.ring] for r in G.simplify(polygons(spark, *shapes), 4.0).collect()}
    for n, shape in enumerate(shapes):
        assert out[n] == brute_simplify([tuple(map(float, p)) for p in shape], 4.0)


def looped_without_spikes(ids):
    """One pass after the other; in a pass a spike goes with the vertex behind it."""
    while True:
        gone, at = set(), 0
        while at < len(ids):
            if ids[at - 1] == ids[(at + 1) % len(ids)]:
                gone |= {at, at + 1}
                at += 1
            at += 1
        if not gone:
            return ids
        ids = [v for n, v in enumerate(ids) if n not in gone]


def test_spikes(spark):
    draw = random.Random(12)
    faces = [[], [4], [4, 9], [1, 2, 1, 2, 1, 2]]
    for _ in range(300):
        face = [draw.randrange(9) for _ in range(draw.randrange(3, 9))] if draw.random() < 0.5 else draw.sample(range(30), draw.randrange(3, 12))
        for _ in range(draw.randrange(4)):
            at, deep = draw.randrange(len(face)), draw.randrange(1, 4)
            out = [draw.randrange(100, 200) for _ in range(deep)]
            face = face[: at + 1] + out + out[-2::-1] + face[at:]
        faces.append(face)
    table = spark.createDataFrame(list(enumerate(faces)) + [(-1, None)], "id INT, face ARRAY<BIGINT>").repartition(3)
    found = {r.id: r.face for r in G.drop_spikes(table).collect()}
    assert found.pop(-1) is None
    assert found == {n: looped_without_spikes(f) for n, f in enumerate(faces)}
    assert any(len(found[n]) < len(f) for n, f in enumerate(faces))


def kept_by_recursion(ring, tolerance, a=0, b=None):
    """Positions strictly between a and b that stay."""
    b = len(ring) - 1 if b is None else b
    gaps = []
    for p in ring[a + 1 : b]:
        ci, cj = ring[b][0] - ring[a][0], ring[b][1] - ring[a][1]
        pi, pj = p[0] - ring[a][0], p[1] - ring[a][1]
        span = ci * ci + cj * cj
        along = min(max((pi * ci + pj * cj) / span, 0.0), 1.0) if span > 0 else 0.0
        gaps.append(math.hypot(pi - along * ci, pj - along * cj))
    if not gaps or max(gaps) <= tolerance:
        return []
    far = a + 1 + gaps.index(max(gaps))
    return kept_by_recursion(ring, tolerance, a, far) + [far] + kept_by_recursion(ring, tolerance, far, b)


def random_rings(seed, count):
    draw = random.Random(seed)
    shapes = [[], [(1.0, 1.0)], [(0.0, 0.0), (3.0, 3.0)], [(2.0, 2.0)] * 5]
    for _ in range(count):
        at, ring = (0.0, 0.0), []
        for _ in range(draw.randrange(3, 60)):
            at = (at[0] + draw.gauss(0, 2), at[1] + draw.gauss(0, 2))
            ring.append(at)
        shapes.append(ring + ring[:1] if draw.random() < 0.5 else ring)
    return shapes


@pytest.mark.parametrize("tolerance", [0.05, 1.0, 4.0])
def test_simplification_equals_the_recursion(spark, tolerance):
    shapes = random_rings(3, 200)
    table = spark.createDataFrame(list(enumerate(shapes)) + [(-1, None)], f"poly_id INT, ring {RING}").repartition(3)
    kept = {r.poly_id: r.kept for r in G.kept_positions(table, tolerance).collect()}
    assert kept.pop(-1) is None
    for n, ring in enumerate(shapes):
        ends = sorted({0, len(ring) - 1}) if ring else []
        assert kept[n] == sorted({*ends, *(kept_by_recursion(ring, tolerance) if ring else [])}), n
    assert {r.poly_id: len(r.ring) for r in G.simplify(table, tolerance).where("poly_id >= 0").collect()} == {n: len(k) for n, k in kept.items()}


def test_simplification_to_a_count_raises_the_tolerance(spark):
    shapes = [r + r[:1] if r and r[0] != r[-1] else r for r in random_rings(5, 60)]
    table = spark.createDataFrame(list(enumerate(shapes)), f"poly_id INT, ring {RING}")
    found = {r.poly_id: [tuple(p) for p in r.ring] for r in G.simplify_to_count(table, 6).collect()}
    for n, ring in enumerate(shapes):
        kept, tries = list(range(len(ring))), 0
        while len(kept) > 7:
            tries += 1
            kept = sorted({0, len(ring) - 1, *kept_by_recursion(ring, tries * 0.1)})
        assert found[n] == [ring[k] for k in kept[:-1]], n


def test_copies_keep_what_their_truth_keeps(spark):
    truth = polygons(spark, [(0, 0), (0, 5), (0, 10), (10, 10), (0, 0)], [(0, 0), (0, 9), (9, 9)])
    # The copy's second vertex sticks out, but lies on a side in the truth.
    copies = polygons(spark, [(1, 1), (4, 5), (1, 11), (11, 11), (1, 1)], [(1, 1), (1, 10), (10, 10)]).withColumn("map_id", F.explode(F.array(F.lit(0), F.lit(1))))
    out = G.at_truth_positions(copies, G.kept_positions(truth)).collect()
    assert len(out) == 4
    for r in out:
        want = [(1, 1), (1, 11), (11, 11), (1, 1)] if r.poly_id == 0 else [(1, 1), (1, 10), (10, 10)]
        assert [tuple(p) for p in r.ring] == want


def test_zero_vector_and_angles(spark):
    e = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, -1.0, 0.0), (0.0, 0.0, 0.0, -2.0)], "i1 double, j1 double, i2 double, j2 double")
    rows = sorted(G.edge_attributes(e).collect(), key=lambda r: r.length)
    assert rows[0].angle == pytest.approx(1.5 * math.pi) and rows[0].normal_angle is None
    assert rows[1].angle == pytest.approx(math.pi)
    assert rows[2].angle == pytest.approx(1.5 * math.pi)
    same = spark.range(1).select(G.angle_between(*[rings.point(F.lit(1.0), F.lit(2.0))] * 3).alias("a")).first().a
    assert same == math.inf


def test_overlap_of_slanted_rings(spark):
    square = [(0, 0), (0, 4), (4, 4), (4, 0)]
    diamond = [(2, -1), (5, 2), (2, 5), (-1, 2)]
    for a in (square, square[::-1]):
        for b in (diamond, diamond[::-1]):
            p = polygons(spark, a, b).groupBy().agg(F.min_by("ring", "poly_id").alias("a"), F.max_by("ring", "poly_id").alias("b"))
            s = p.select(rings.strip_overlap(rings.strips(F.col("a")), rings.strips(F.col("b")), F.lit(-1.0)).alias("s")).first().s
            # The diamond |di| + |dj| <= 3 cuts a triangle with legs of one from each corner of the square.
            assert s == pytest.approx(16 - 4 * 0.5)


def test_cyclic_match_of_rolled_ring(spark):
    base = [(0, 0), (0, 3), (5, 3), (5, 0)]
    df = polygons(spark, base, base[2:] + base[:2], base[:3])
    rows = {r.poly_id: r.ring for r in df.collect()}
    pairs = spark.createDataFrame([(rows[0], rows[1]), (rows[0], rows[2])], f"a {RING}, b {RING}")
    out = [r.m for r in pairs.select(rings.cyclic_match(F.col("a"), F.col("b")).alias("m")).collect()]
    assert (out[0].mean, out[0].shift) == (0.0, 2)
    assert out[1].distances == [0.0, 0.0, 0.0, 3.0]
    summed = pairs.select(rings.cyclic_match(F.col("a"), F.col("b"), "sum").alias("m")).collect()[1].m
    assert summed.mean <= out[1].mean


def test_utm(spark):
    points = spark.createDataFrame([(15.0, 0.0), (15.0, 45.0), (12.5, -33.25)], "lon double, lat double")
    north = G.project_lonlat(points, 32633).collect()
    assert (north[0].x, north[0].y) == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert north[1].y == pytest.approx(0.9996 * 4984944.378, abs=2e-3)
    south = G.project_lonlat(points, 32733)
    assert south.collect()[0].y == pytest.approx(1e7, abs=1e-6)
    back = G.unproject_lonlat(south.drop("lon", "lat"), 32733).collect()
    assert [v for r in back for v in (r.lon, r.lat)] == pytest.approx([15.0, 0.0, 15.0, 45.0, 12.5, -33.25], abs=1e-7)
    with pytest.raises(ValueError):
        G.project_lonlat(points, 2154)


def test_exact_four_point_homography(spark):
    pairs = spark.createDataFrame(
        [(0, -1.0, -1.0, 0.0, 0.0), (0, 1.0, -1.0, 4.0, 0.5), (0, 1.0, 1.0, 3.0, 3.0), (0, -1.0, 1.0, 0.25, 2.0)],
        "image_id BIGINT, x double, y double, u double, v double",
    )
    corners = G.four_points(G.fit_homography(pairs)).orderBy("corner").collect()
    assert [(r.x, r.y) for r in corners] == [pytest.approx(p, abs=1e-6) for p in [(0, 0), (4, 0.5), (3, 3), (0.25, 2)]]


def test_count_below_matches_loop(spark):
    grid, uneven = frange(0, 1.01, 0.01), [0.5, 1.0, 2.75]
    values = grid + [v + 1e-12 for v in grid] + [v - 1e-12 for v in grid] + [-5.0, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", count_below(F.col("v"), grid).alias("a"), count_below(F.col("v"), uneven).alias("b")).collect()
    for r in rows:
        assert r.a == sum(t < r.v for t in grid)
        assert r.b == sum(t < r.v for t in uneven)
