"""The adaptive tile index against brute force: crowds on one tile, big boxes over small ones, no task above the stated size."""

import random

import pytest
from pyspark.sql import functions as F

from ringfield.operators import edge_joins, overlap, tiles
from ringfield.operators import geometry as G
from ringfield.operators.quadtree import Things, box_tiles, dealt, near_join, ring_tiles

RINGS = "image_id long, poly_id long, ring array<struct<i:double,j:double>>"


def rectangle(r, c, h, w):
    return [(r, c), (r, c + w), (r + h, c + w), (r + h, c)]


def crowd(rng, n, side, sizes):
    out = []
    for i in range(n):
        h, w = rng.choice(sizes), rng.choice(sizes)
        out.append((i % 2, i, rectangle(rng.randrange(side * 4) / 4.0, rng.randrange(side * 4) / 4.0, h, w)))
    return out


CASES = {
    "one spot": (120, 2, [8.0, 20.0]),
    "sizes from a pixel to a thousand": (160, 900, [1.0, 4.0, 30.0, 150.0, 1000.0]),
    "big boxes over crowds": (200, 100, [0.75, 0.75, 1.5, 400.0]),
}


def boxes(rows):
    return {p: (im, *map(min, zip(*ring)), *map(max, zip(*ring))) for im, p, ring in rows}


def meets(a, b):
    """The image and an inside in common."""
    return a[0] == b[0] and max(a[1], b[1]) < min(a[3], b[3]) and max(a[2], b[2]) < min(a[4], b[4])


@pytest.mark.parametrize("case, most", [("one spot", 9), ("sizes from a pixel to a thousand", 9), ("big boxes over crowds", 9)])
def test_pairs_of_rectangles(spark, case, most):
    rows = crowd(random.Random(case), *CASES[case])
    table = spark.createDataFrame(rows, RINGS)
    at = boxes(rows)
    want = sorted((a, b) for a in at for b in at if a < b and meets(at[a], at[b]))
    got = sorted((r.poly_a, r.poly_b) for r in overlap.overlapping_pairs(table, hot_rows=most).collect())
    assert got == want
    some, others = table.where("poly_id % 3 = 0"), table.where("poly_id % 3 > 0")
    hit = {a for a in at if a % 3 == 0 and any(b % 3 and meets(at[a], at[b]) for b in at)}
    assert {r.poly_id for r in overlap.intersecting_any(some, others, hot_rows=most).collect()} == hit
    if case != "big boxes over crowds":
        return
    got = [(r.poly_a, r.poly_b) for r in overlap.overlapping_pairs(some, others, hot_rows=most).collect()]
    assert sorted(got) == sorted((a, b) for a in at for b in at if a % 3 == 0 and b % 3 and meets(at[a], at[b]))


@pytest.mark.parametrize("most", [4])
def test_patches_over_a_crowd(spark, most):
    rng = random.Random(2)
    rows = crowd(rng, 150, 300, [0.5, 2.0, 90.0]) + [(0, 900, [(5.0, 5.0), (5.0, 250.0), (250.0, 5.0)])]
    table = spark.createDataFrame(rows, RINGS)
    images = spark.createDataFrame([(0, 400, 400), (1, 400, 400)], "image_id long, height int, width int")
    grid = tiles.patch_grid(images, 50, 110)
    patches = [tuple(r) for r in grid.select("image_id", "patch_id", "r0", "c0", "r1", "c1").collect()]
    touch, within = [], []
    for im, p, ring in rows:
        for pim, patch, r0, c0, r1, c1 in patches:
            held = [r0 <= i <= r1 and c0 <= j <= c1 for i, j in ring]
            if im == pim and any(held):
                touch.append((p, patch))
            if im == pim and all(held):
                within.append((p, patch))
    found = tiles.polygons_touching_patches(table, grid, hot_rows=most)
    assert sorted((r.poly_id, r.patch_id) for r in found.collect()) == sorted(touch)
    first = found.where("poly_id = 900").orderBy("patch_id").first()
    assert (first.ring[0].i, first.ring[0].j) == (5.0 - first.r0, 5.0 - first.c0)
    found = tiles.polygons_within_patches(table, grid, hot_rows=most)
    assert sorted((r.poly_id, r.patch_id) for r in found.collect()) == sorted(within)


@pytest.mark.parametrize("most", [6])
def test_crossings_in_a_crowd(spark, most):
    rng = random.Random(4)
    rows = [(0, i, [(float(rng.randrange(60)), float(rng.randrange(60))) for _ in range(4)]) for i in range(25)]
    rows += [(0, 100, [(0.0, 0.0), (700.0, 650.0), (10.0, 600.0)])]
    table = spark.createDataFrame(rows, RINGS)

    def cross(p, q, r, s):
        def turn(a, b, c):
            return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

        return turn(p, q, r) * turn(p, q, s) < 0 and turn(r, s, p) * turn(r, s, q) < 0

    sides = [(p, k, ring[k], ring[(k + 1) % len(ring)]) for _, p, ring in rows for k in range(len(ring))]
    want = {(a[0], a[1], b[0], b[1]) for a in sides for b in sides if a[:2] < b[:2] and cross(a[2], a[3], b[2], b[3])}
    found = edge_joins.edge_crossings(G.edges(table), hot_rows=most).collect()
    got = {(r.poly_id, r.k, r.poly_id_b, r.k_b) for r in found}
    assert len(got) == len(found)
    assert want <= got and any(a == b for a, _, b, _ in want)
    # What is more are ends that lie on the other edge.
    for a, k, b, m in got - want:
        one, two = next(s for s in sides if s[:2] == (a, k)), next(s for s in sides if s[:2] == (b, m))
        turns = [(q[0] - p[0]) * (x[1] - p[1]) - (q[1] - p[1]) * (x[0] - p[0]) for p, q, xs in ((*one[2:], two[2:]), (*two[2:], one[2:])) for x in xs]
        assert min(map(abs, turns)) < 1e-9


def things(table, suffix=""):
    b = table.select(F.col("poly_id").alias("poly_id" + suffix), "image_id", *[F.col(c).alias(c + suffix) for c in ("r0", "c0", "r1", "c1")])
    extent = F.greatest(F.col("r1" + suffix) - F.col("r0" + suffix), F.col("c1" + suffix) - F.col("c0" + suffix))
    return Things(b, box_tiles(*[c + suffix for c in ("r0", "c0", "r1", "c1")]), extent, ["poly_id" + suffix])


@pytest.mark.parametrize("case", ["one spot", "big boxes over crowds"])
def test_no_task_holds_more_than_stated(spark, case):
    n, side, sizes = CASES[case]
    rows = [(0, p, ring) for _, p, ring in crowd(random.Random(1), 8 * n, side, sizes)]
    flat = [(im, p, *map(min, zip(*ring)), *map(max, zip(*ring))) for im, p, ring in rows]
    table = spark.createDataFrame(flat, "image_id long, poly_id long, r0 double, c0 double, r1 double, c1 double")
    most = 40
    one, two, on = dealt(things(table), things(table, "_b"), ["image_id"], most=most)
    for df in (one, two):
        counts = [r["count"] for r in df.groupBy(*on).count().collect()]
        # A slice is dealt by hash: `most` on average, with its deviation.
        assert max(counts) < 2 * most
    if case == "one spot":
        assert one.select("bi", "bj").distinct().count() <= 16


def test_big_boxes_do_not_flood_small_tiles(spark):
    table = spark.createDataFrame([(0, p, p * 7.0, 3.0, p * 7.0 + 60000.0, 50000.0) for p in range(20)], "image_id long, poly_id long, r0 double, c0 double, r1 double, c1 double")
    one, _, _ = dealt(things(table), things(table, "_b"), ["image_id"])
    assert one.count() <= 4 * 20


def test_points_meet_boxes_once(spark):
    ring = [(1.0, 1.0), (63.9, 64.1), (64.0, 64.0), (500.0, 2.0)]
    polys = spark.createDataFrame([(0, 1, ring)], RINGS)
    assert polys.select(ring_tiles("ring")(64.0).alias("t")).first().t == [(0, 0), (0, 1), (1, 1), (7, 0)]
    empty = polys.limit(0)
    assert near_join(Things(empty, ring_tiles("ring"), F.lit(0.0), ["poly_id"]), things(spark.createDataFrame([], "image_id long, poly_id long, r0 double, c0 double, r1 double, c1 double"), "_b"), ["image_id"], F.lit(True)).count() == 0
