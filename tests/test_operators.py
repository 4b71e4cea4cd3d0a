"""Small inputs with known results, invariants, skewed inputs and repeatability."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ringfield import fixtures as X
from ringfield.functions import rings
from ringfield.operators import edge_joins as E
from ringfield.operators import fields as D
from ringfield.operators import geometry as G
from ringfield.operators import metrics as M
from ringfield.operators import overlap as O
from ringfield.operators import raster as R
from ringfield.operators import tiles as T
from ringfield.operators import windows as N
from ringfield.operators.components import connected_components, cycle_order
from ringfield.operators.skew import skew_join
from ringfield.plans import align as A
from ringfield.plans import examples as Ex
from ringfield.plans import predict as P
from ringfield.sources import catalog as C
from ringfield.sources import readers as Rd
from ringfield.sources import writers as Wr

RING = "ARRAY<STRUCT<i: DOUBLE, j: DOUBLE>>"
NAN = (math.nan, math.nan)


def rects(spark, rows):
    """(image, id, r0, c0, r1, c1) to ring rows."""
    data = [(m, p, [(a, b), (a, d), (c, d), (c, b)]) for m, p, a, b, c, d in rows]
    return spark.createDataFrame(data, f"image_id BIGINT, poly_id BIGINT, ring {RING}")


def random_rects(seed, count, side, size, images=1):
    draw = random.Random(seed)
    rows = []
    for p in range(count):
        a, b = draw.uniform(0, side), draw.uniform(0, side)
        rows.append((draw.randrange(images), p, a, b, a + draw.uniform(1, size), b + draw.uniform(1, size)))
    return rows


def shared(x, y):
    high, wide = min(x[4], y[4]) - max(x[2], y[2]), min(x[5], y[5]) - max(x[3], y[3])
    return high * wide if high > 0 and wide > 0 and x[0] == y[0] else 0.0


# ------------------------------------------------------------ accuracy


def test_accuracy_with_nan_padding(spark):
    gt = spark.createDataFrame([(0, 0, [(1.0, 2.0), (3.0, 4.0), NAN, (9.0, 9.0)]), (0, 1, [NAN, NAN])], f"image_id BIGINT, poly_id BIGINT, ring {RING}")
    curve = M.threshold_accuracy(gt, gt, [1, 2, 3, 4, 5, 6, 7, 8]).collect()
    assert [r.value for r in curve] == [1.0] * 8 and {r.n for r in curve} == {2}
    assert M.threshold_accuracy(gt.where("poly_id = 1"), gt, [1.0]).count() == 0


def test_accuracy_strips_by_the_truth(spark):
    gt = spark.createDataFrame([(0, 0, [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)])], f"image_id BIGINT, poly_id BIGINT, ring {RING}")
    moved = gt.withColumn("ring", F.transform("ring", lambda p, k: rings.point(p["i"] + k, p["j"])))
    curve = {r.threshold: r.value for r in M.threshold_accuracy(gt, moved, [0.0, 1.0, 2.0, 3.0]).collect()}
    assert curve == {0.0: pytest.approx(1 / 3), 1.0: pytest.approx(2 / 3), 2.0: 1.0, 3.0: 1.0}


def test_accuracy_is_monotone(spark, sf):
    curve = M.threshold_accuracy(X.polygons(spark, sf), X.predicted(spark, sf)).orderBy("image_id", "threshold").collect()
    for a, b in zip(curve, curve[1:]):
        assert a.image_id != b.image_id or a.value <= b.value


def test_rounds_stop_at_a_gap(spark):
    p = rects(spark, [(0, 0, 0.0, 0.0, 4.0, 4.0), (1, 0, 0.0, 0.0, 4.0, 4.0)])
    versions = p.withColumn("source", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).where("NOT (image_id = 1 AND source = 'b')")
    found = {(r.image_id, r.source) for r in M.round_report(p, versions, ["a", "b", "c"], [0.0]).collect()}
    assert found == {(0, "a"), (0, "b"), (0, "c"), (1, "a")}


# ------------------------------------------------------------ grids and numbering


def test_patch_larger_than_image(spark):
    images = spark.createDataFrame([(0, 5, 10)], "image_id BIGINT, height INT, width INT")
    rows = T.patch_grid(images, 15, 15).collect()
    assert [(r.r0, r.c0, r.r1, r.c1) for r in rows] == [(-10, -5, 5, 10)]


def test_patches_cover_the_image(spark):
    images = spark.createDataFrame([(0, 517, 431)], "image_id BIGINT, height INT, width INT")
    boxes = T.patch_grid(images, 100, 220).collect()
    for axis, size in (("r", 517), ("c", 431)):
        covered = {n for b in boxes for n in range(b[f"{axis}0"], b[f"{axis}1"])}
        assert covered == set(range(size))
    assert T.rotated_patch_size(100, 220) == (70, 312)


def test_chunks_of_four_with_padding(spark):
    out = N.batches(spark.range(10), 4, "id", pad=True).orderBy("batch", "slot").collect()
    assert [r.id for r in out] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9]
    assert N.batches(spark.range(8), 4, "id", pad=True).count() == 8


def test_numbering_with_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id") * 7 % 3001, F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(0).alias("g"))
    df = df.toDF("v", "g")
    rows = N.number_rows(df, "v", ["g"]).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: (r.g, r.v)):
        assert r.rn == seen.get(r.g, 0)
        seen[r.g] = r.rn + 1
    assert sum(seen.values()) == 3000


def test_shuffle_keeps_rows_and_repeats(spark):
    df = spark.range(500)
    a = [r.id for r in N.shuffle(df, 1, "id").collect()]
    b = [r.id for r in N.shuffle(df.repartition(5), 1, "id").collect()]
    assert a == b != sorted(a) and sorted(a) == list(range(500))
    assert a != [r.id for r in N.shuffle(df, 2, "id").collect()]


# ------------------------------------------------------------ skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, how):
    left = spark.range(1200).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("k"))
    right = spark.range(60).where("id % 2 = 1").select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = sorted(map(tuple, left.join(right, "k", how).select("id", "k").collect()))
    salted = sorted(map(tuple, skew_join(left, right, ["k"], ["id"], how, hot_rows=50).select("id", "k").collect()))
    assert salted == plain


def test_pairs_match_brute_force_with_a_hot_bucket(spark):
    rows = random_rects(1, 150, 40, 8) + [(0, 1000 + n, 5.0 + n / 8, 5.0, 9.0 + n / 8, 9.0) for n in range(60)] + random_rects(2, 60, 400, 30)
    rows = [(m, n, *box) for n, (m, _, *box) in enumerate(rows)]
    expected = {(x[1], y[1]): shared(x, y) for x in rows for y in rows if x[1] < y[1] and shared(x, y) > 0}
    found = {(r.poly_a, r.poly_b): r.shared for r in O.overlapping_pairs(rects(spark, rows), size=16, hot_rows=20).collect()}
    assert found.keys() == expected.keys()
    for pair, value in expected.items():
        assert found[pair] == pytest.approx(value, rel=1e-9, abs=1e-9)


def test_touching_patches_with_a_hot_bucket(spark):
    rows = [(0, n, 10.0 + n % 7, 12.0, 16.0 + n % 7, 20.0) for n in range(120)] + random_rects(3, 100, 380, 40)
    rows = [(m, n, *box) for n, (m, _, *box) in enumerate(rows)]
    images = spark.createDataFrame([(0, 400, 400)], "image_id BIGINT, height INT, width INT")
    patches = T.patch_grid(images, 50, 110)
    out = T.polygons_touching_patches(rects(spark, rows), patches, 32, hot_rows=25)
    found = sorted((r.poly_id, r.patch_id) for r in out.select("poly_id", "patch_id").collect())
    boxes = patches.collect()

    def inside(p, b):
        return b.r0 <= p[0] <= b.r1 and b.c0 <= p[1] <= b.c1

    expected = sorted(
        (n, b.patch_id) for _, n, a, c, d, e in rows for b in boxes if any(inside(p, b) for p in ((a, c), (a, e), (d, e), (d, c)))
    )
    assert found == expected


def brute_components(ids, pairs):
    parent = {n: n for n in ids}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in ids}


def test_components_of_chain_star_and_random(spark):
    draw = random.Random(9)
    pairs = [(n, n + 1) for n in range(100, 160)] + [(200, n) for n in range(201, 300)]
    pairs += [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)]
    nodes = spark.range(100, 400).select(F.lit(0).alias("g"), "id")
    links = spark.createDataFrame([(0, a, b) for a, b in pairs], "g INT, a BIGINT, b BIGINT")
    found = {r.id: r.label for r in connected_components(nodes, links, ["g"]).collect()}
    assert found == brute_components(range(100, 400), pairs)


def test_clusters_with_copies(spark):
    rows = random_rects(5, 80, 60, 8) + [(0, 0, 30.0, 30.0, 33.0, 33.0)] * 40
    rows = [(m, n, *box) for n, (m, _, *box) in enumerate(rows)]
    expected = brute_components([r[1] for r in rows], [(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and shared(x, y) > 0])
    found = {r.poly_id: r.cluster for r in O.cluster_labels(rects(spark, rows), 16).collect()}
    assert found == expected


def test_running_clusters_match_a_loop(spark):
    rows = random_rects(6, 160, 25, 6)
    starts, expected, members = {}, {}, []
    for row in rows:
        if not any(shared(row, other) > 0 for other in members):
            members = []
        members.append(row)
        expected[row[1]] = members[0][1]
    starts = {r.poly_id: r.start for r in O.running_clusters(rects(spark, rows), 16).collect()}
    assert starts == expected


def looped_starts(rows):
    """`rows` of one image in id order, with the partner of each."""
    start, out = None, {}
    for own, partner in rows:
        if start is None or partner is None or partner < start:
            start = own
        out[own] = start
    return out


@pytest.mark.parametrize("kind", ["chain", "skipping", "random", "none"])
def test_running_clusters_of_sparse_ids(spark, kind, monkeypatch):
    """Starts that depend on each other over 10,000 polygons, with ids far apart; the partners are given."""
    draw = random.Random(kind)
    rows = {}
    for image in (0, 1):
        ids = sorted(draw.sample(range(1 << 50), 10_000 if image else 40))
        back = {"chain": lambda n: n - 1, "skipping": lambda n: n - 2 - n % 3, "random": lambda n: n - draw.randrange(1, 30), "none": lambda n: -1}[kind]
        rows[image] = [(x, ids[back(n)] if back(n) >= 0 and draw.random() < 0.999 else None) for n, x in enumerate(ids)]
        rows[image][0] = (ids[0], None)
    pairs = [(m, p, x) for m, of in rows.items() for x, p in of if p is not None]
    pairs += [(m, min(p, 1), x) for m, p, x in pairs[::7]]
    made = spark.createDataFrame(pairs, "image_id long, poly_a long, poly_b long")
    monkeypatch.setattr(O, "overlapping_pairs", lambda polygons, size: made)
    table = spark.createDataFrame([(m, x) for m, of in rows.items() for x, _ in of], "image_id long, poly_id long")
    found = {(r.image_id, r.poly_id): r.start for r in O.running_clusters(table).collect()}
    assert found == {(m, x): start for m, of in rows.items() for x, start in looped_starts(of).items()}


@pytest.mark.parametrize("kind", ["path", "star", "clique", "two trees", "loops"])
def test_components_of_shapes(spark, kind):
    draw = random.Random(1)
    names = draw.sample(range(10**12), 600)
    pairs = {
        "path": [(n, n + 1) for n in range(599)],
        "star": [(599, n) for n in range(599)],
        "clique": [(a, b) for a in range(40) for b in range(a)],
        "two trees": [(n, n // 2) for n in range(2, 300)] + [(300 + n, 300 + n // 3) for n in range(3, 300)],
        "loops": [(n, n) for n in range(50)] + [(7, 8), (8, 7), (7, 8)],
    }[kind]
    pairs = [(names[a], names[b]) for a, b in pairs]
    nodes = spark.createDataFrame([(n,) for n in names], "id long")
    links = spark.createDataFrame(pairs, "a long, b long")
    found = {r.id: r.label for r in connected_components(nodes, links, []).collect()}
    assert found == brute_components(names, pairs)


def test_cycle_order(spark):
    draw = random.Random(2)
    chain, want = [], {}
    for g, sizes in enumerate(([1, 2, 3, 200], [4, 37])):
        for n in sizes:
            ids = draw.sample(range(g * 10**6, (g + 1) * 10**6), n)
            low = ids.index(min(ids))
            ids = ids[low:] + ids[:low]
            chain += [(g, a, b) for a, b in zip(ids, ids[1:] + ids[:1])]
            want |= {(g, x): (ids[0], (n - k) % n) for k, x in enumerate(ids)}
    found = cycle_order(spark.createDataFrame(chain, "g int, id long, next long"), ["g"])
    assert {(r.g, r.id): (r.label, r.ahead) for r in found.collect()} == want


def merged(spark, groups, common=None):
    rows = [(g, list(f)) for g, faces in groups.items() for f in faces]
    table = spark.createDataFrame(rows, "g int, face array<bigint>")
    ends = None
    if common:
        table = table.withColumns({"e0": F.lit(common[0]).cast("long"), "e1": F.lit(common[1]).cast("long")})
        ends = ("e0", "e1")
    found = {}
    for r in E.merge_faces(table, ["g"], ends).collect():
        found.setdefault(r.g, []).append(tuple(r.face))
    return {g: sorted(f) for g, f in found.items()}


def test_merged_faces_give_every_outline(spark):
    # A frame cut into two C shapes: one outline outside, one around the hole.
    frame = [(0, 1, 5, 4, 7, 3), (1, 2, 3, 7, 6, 5)]
    groups = {
        0: [(0, 1, 2), (0, 2, 3)],
        1: frame,
        # Two squares that share a vertex only, and two that share all sides.
        2: [(0, 1, 2, 3), (2, 4, 5, 6)],
        3: [(0, 1, 2), (2, 1, 0)],
        # Three faces around an inner vertex.
        4: [(0, 1, 9), (1, 2, 9), (2, 0, 9)],
        # A face that meets the other along two sides in a row.
        5: [(0, 1, 2, 3, 4), (3, 2, 1, 7)],
    }
    found = merged(spark, groups)
    assert found[0] == [(0, 1, 2, 3)]
    assert found[1] == [(0, 1, 2, 3), (4, 7, 6, 5)]
    assert found[2] == [(0, 1, 2, 3), (2, 4, 5, 6)]
    assert 3 not in found
    assert found[4] == [(0, 1, 2)]
    assert found[5] == [(0, 1, 7, 3, 4)]


def test_merging_around_one_side_leaves_a_bridge(spark):
    frame = [(0, 1, 5, 4, 7, 3), (1, 2, 3, 7, 6, 5)]
    # The other common side 3-7 stays and is walked in both directions.
    (face,) = merged(spark, {0: frame}, common=(1, 5))[0]
    assert len(face) == 10 and face.count(3) == face.count(7) == 2


def test_edge_crossings_match_brute_force(spark):
    draw = random.Random(7)
    ends = [tuple(draw.uniform(0, 60) for _ in range(4)) for _ in range(90)]
    df = spark.createDataFrame([(0, n, 0, *e) for n, e in enumerate(ends)], "image_id BIGINT, poly_id BIGINT, k INT, i1 double, j1 double, i2 double, j2 double")

    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def cross(a, b):
        p, q, r, s = a[:2], a[2:], b[:2], b[2:]
        return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0

    expected = {(a, b) for a in range(90) for b in range(a + 1, 90) if cross(ends[a], ends[b])}
    found = {(r.poly_id, r.poly_id_b) for r in E.edge_crossings(df, size=16, hot_rows=15).collect()}
    assert found == expected


# ------------------------------------------------------------ fields


def test_plus_undoes_minus_on_a_constant_field(spark, sf):
    v = X.vertices(spark, sf)
    f = spark.range(100).selectExpr("CAST(id DIV 10 AS INT) AS i", "CAST(id % 10 AS INT) AS j", "1.5D AS di", "-0.25D AS dj")
    back = D.apply_field(D.apply_field(v, f, 10, 10, -1), f, 10, 10, 1)
    assert back.count() == v.count()
    assert back.exceptAll(v.select(back.columns)).count() == 0


def test_field_keeps_separators_and_any_slice_count(spark):
    v = spark.createDataFrame([(0, 0, 0, 2.0, 3.0), (0, 0, 1, math.nan, math.nan), (0, 0, 2, 99.0, -5.0)], "image_id BIGINT, poly_id BIGINT, k INT, i double, j double")
    f = spark.range(64).selectExpr("CAST(id DIV 8 AS INT) AS i", "CAST(id % 8 AS INT) AS j", "CAST(id AS DOUBLE) AS di", "0D AS dj")
    for slices in (1, 4, 32):
        rows = {r.k: r for r in D.apply_field(v, f, 8, 8, 1, edge_slices=slices).collect()}
        assert rows[0].i == 2 + 19 and rows[2].i == 99 + 56 and math.isnan(rows[1].i)


def test_quantisation_roundtrip(spark):
    f = spark.range(1000).selectExpr("id", "(id - 500) / 500D AS di", "sin(id) AS dj")
    q = D.dequantise_field(D.quantise_field(f), 1.0).withColumnsRenamed({"di": "qi", "dj": "qj"}).join(f, "id")
    assert q.where("abs(di - qi) > 1D / 32767 OR abs(dj - qj) > 1D / 32767").count() == 0


def test_random_field_repeats_and_stays_in_range(spark):
    images = spark.createDataFrame([(0, 40, 48)], "image_id BIGINT, height INT, width INT")

    def build(parts):
        return D.gaussian_field(images.repartition(parts), D.random_modes(images, 1, 5, 3), coarse=4)

    a, b = (sorted(map(tuple, build(n).collect())) for n in (1, 5))
    assert len(a) == 40 * 48
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=1e-9)
    assert all(-1 - 1e-9 <= v <= 1 + 1e-9 for r in a for v in r[-2:])


# ------------------------------------------------------------ raster


def test_fill_matches_point_in_polygon(spark):
    draw = random.Random(11)
    shapes = []
    for _ in range(25):
        angles = sorted(draw.uniform(0, 2 * math.pi) for _ in range(draw.randint(3, 9)))
        shapes.append([(10 + draw.uniform(2, 9.7) * math.cos(a), 10 + draw.uniform(2, 9.7) * math.sin(a)) for a in angles])
    df = spark.createDataFrame([(n, s) for n, s in enumerate(shapes)], f"poly BIGINT, ring {RING}")
    found = {}
    for r in R.fill_cells(df).distinct().collect():
        found.setdefault(r.poly, set()).add((r.i, r.j))

    def inside(p, ring):
        hit = False
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (a > p[0]) != (c > p[0]) and p[1] < b + (p[0] - a) * (d - b) / (c - a):
                hit = not hit
        return hit

    for n, shape in enumerate(shapes):
        assert found.get(n, set()) == {(i, j) for i in range(-1, 22) for j in range(-1, 22) if inside((i, j), shape)}


def test_runs_give_each_cell_once(spark):
    draw = random.Random(8)
    shapes = [[(float(draw.randrange(-3, 25)), float(draw.randrange(-3, 25))) for _ in range(3)] for _ in range(40)]
    shapes += [[(5.0, 3.0), (5.0, 9.0), (9.0, 9.0)]] * 5
    df = spark.createDataFrame([(n % 2, n, s) for n, s in enumerate(shapes)], "image_id long, poly_id long, ring array<struct<i:double,j:double>>")
    found = [(r.image_id, r.layer, r.i, r.j) for r in R.rasterize(df, 20, 18).collect()]
    keyed = df.select("image_id", "ring")
    fill = R.fill_cells(keyed).select("image_id", F.lit("fill").alias("layer"), "i", "j")
    edge = R.line_cells(R.drawn_edges(keyed), 3).select("image_id", F.lit("edge").alias("layer"), "i", "j")
    want = {tuple(r) for r in fill.union(edge).collect()} | {(n % 2, "vertex", int(i), int(j)) for n, s in enumerate(shapes) for i, j in s}
    want = {x for x in want if 0 <= x[2] < 20 and 0 <= x[3] < 18}
    assert len(found) == len(set(found)) and set(found) == want


def test_quarter_turn(spark):
    cells = spark.createDataFrame([(0, 0, 1, 5.0), (0, 2, 2, 7.0)], "image_id BIGINT, i INT, j INT, value double")
    for nearest in (True, False):
        out = {(r.i, r.j): round(r.value, 9) for r in R.rotate_cells(cells, ["image_id"], math.pi / 2, 3, 3, nearest).collect() if r.value > 1e-9}
        assert out == {(1, 0): 5.0, (0, 2): 7.0}


def test_boundary_of_touching_corners_and_a_hole(spark):
    ring = [(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    cells = [(0, i, j) for i, j in ring] + [(1, 0, 0), (1, 1, 1)]
    df = spark.createDataFrame(cells, "image_id BIGINT, i INT, j INT")
    rows = R.boundary_rings(df, ["image_id"]).collect()
    assert sorted((r.image_id, r.outer, len(r.ring)) for r in rows) == [(0, False, 4), (0, True, 4), (1, True, 4), (1, True, 4)]


def test_drop_components_shortcuts_and_repeat(spark, sf):
    c = X.cells(spark, sf).where("value > 0 AND image_id < 40").select("image_id", F.lit("fill").alias("layer"), "i", "j", "value")
    assert R.drop_components(c, ["image_id"], 1).count() == c.count()
    assert R.drop_components(c, ["image_id"], 0).count() == 0
    a = R.drop_components(c, ["image_id"], 0.4, 5).count()
    assert a == R.drop_components(c.repartition(3), ["image_id"], 0.4, 5).count()
    assert 0 < a < c.count()


# ------------------------------------------------------------ losses


def test_displacement_loss_by_hand(spark):
    gt = spark.createDataFrame([(0, 0, 0, 1.0, 0.0), (0, 0, 1, 0.0, 0.5)], "image_id BIGINT, i INT, j INT, di double, dj double")
    cells = spark.createDataFrame([(0, "fill", 0, 0, 1.0), (0, "fill", 0, 1, 1.0), (0, "vertex", 0, 0, 1.0)], "image_id BIGINT, layer STRING, i INT, j INT, value double")
    loss = M.displacement_loss(M.displacement_error(gt, None, cells)).first().loss
    assert loss == pytest.approx((1.0 * 10.05 + 0.25 * 0.05) / 10.1, rel=1e-5)


def test_schedule_edges(spark):
    steps = spark.createDataFrame([(0,), (2500,), (2501,), (7501,)], "step BIGINT")
    out = [r.coef for r in M.schedule_lookup(steps, [2500, 5000, 7500], [0.5, 0.75, 0.9, 1.0]).orderBy("step").collect()]
    assert out == [0.5, 0.5, 0.75, 1.0]
    with pytest.raises(ValueError):
        M.schedule_lookup(steps, [1], [1.0])


# ------------------------------------------------------------ files and workflows


def test_wide_csv_file(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"{n}.csv").write_text("a,b,c,d\n0,x,y,1,2,3,4,nan,nan,5,6\n1,x,y,7,8,,\n")
    rows = Rd.read_wide_csv(spark, str(tmp_path)).collect()
    shapes = sorted((r.part, [(p.i, p.j) for p in r.ring]) for r in rows)
    assert shapes == [(0, [(2.0, 1.0), (4.0, 3.0)])] * 2 + [(0, [(8.0, 7.0)])] * 2 + [(1, [(6.0, 5.0)])] * 2
    assert len({r.poly_id for r in rows}) == 4


def test_coco_document(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"annotations": [{"id": 5, "image_id": 1, "category_id": 100, "segmentation": [[1, 2, 3, 4, 5, 6], [7, 8, 9, 10]]},\n'
        '{"id": 6, "image_id": 2, "category_id": 7, "segmentation": [[0, 0, 1, 1]]}],\n'
        '"images": [{"id": 1, "file_name": "x.jpg"}, {"id": 2, "file_name": "y.jpg"}], "categories": [{"id": 100}]}'
    )
    images, polygons = Rd.read_coco(spark, str(tmp_path / "a.json"))
    assert [(r.image_id, r.file_name, r.pixelsize) for r in images.collect()] == [(1, "x.jpg", 0.3)]
    rows = polygons.orderBy("part").collect()
    assert [[(p.i, p.j) for p in r.ring] for r in rows] == [[(2, 1), (4, 3), (6, 5)], [(8, 7), (10, 9)]]


def test_features_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(0, [100.0, 0.5, 0.0, 900.0, 0.0, -0.5])], "image_id BIGINT, gt ARRAY<DOUBLE>")
    p = rects(spark, [(0, 0, 2.0, 4.0, 8.0, 6.0)]).withColumn("props", F.create_map(F.lit("HEIGHT"), F.lit("3.5")))
    Wr.write_features(p, images, str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out" / "features")).first()
    assert row.wkt.startswith("POLYGON ((102.0 899.0,103.0 899.0,")
    (tmp_path / "f.json").write_text('{"geometry": {"coordinates": [[[102, 899, 1], [103, 899, 1], [103, 896, 1]], [[0, 0], [1, 1]]]}, "properties": {"HEIGHT": 3}}\n')
    f = Rd.read_geojson(spark, str(tmp_path / "f.json"), image_id=0)
    back = Rd.features_to_image(f, images).first()
    assert [(q.i, q.j) for q in back.ring] == [(2, 4), (2, 6), (8, 6)]
    assert back.extra_dims and back.props == {"HEIGHT": "3"}


def test_shards_hold_at_most_n(spark, tmp_path):
    df = spark.range(1050).select("id", F.when(F.col("id") < 900, 0).otherwise(1).alias("image_id"), F.lit(2).alias("ds_fac"))
    Wr.write_sharded(df, str(tmp_path / "s"), 100, metadata={"disp_max_abs_value": 4, "downsampling_factors": [1, 2]})
    files = spark.read.parquet(str(tmp_path / "s" / "records")).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in files) <= 100 and sum(r["count"] for r in files) == 1050
    assert spark.read.json(str(tmp_path / "s" / "metadata")).first().downsampling_factors == [1, 2]


def test_missing_round_is_none(spark, tmp_path):
    assert C.load_round(spark, str(tmp_path), "gt_polygons") is None
    assert A.align_round(spark, str(tmp_path), "gt_polygons", "next", None, {}) is None


def test_rounds_tell_absent_unfinished_and_damaged_apart(spark, tmp_path):
    rows = rects(spark, [(0, 0, 0.0, 0.0, 2.0, 2.0), (0, 1, 0.0, 0.0, 2.0, 2.0)])
    path = str(tmp_path / "rounds")
    assert C.load_round(spark, path, "a") is None
    # Rows without a commit record, as a writer leaves them that was stopped; an empty folder is no version either.
    rows.write.parquet(f"{path}/b/data/0-x")
    (tmp_path / "rounds" / "empty").mkdir()
    for name in ("b", "empty"):
        with pytest.raises(C.RoundError) as error:
            C.load_round(spark, path, name)
        assert error.value.state == "unfinished"
    assert C.save_round(rows, path, "b") == 0
    assert C.load_round(spark, path, "b").count() == 2
    # A rerun that stops leaves the version as it was, one that ends replaces it whole, also by nothing.
    rows.limit(1).write.parquet(f"{path}/b/data/1-y")
    assert C.load_round(spark, path, "b").count() == 2
    assert C.save_round(rows.limit(1), path, "b") == 1
    assert C.load_round(spark, path, "b").count() == 1
    assert C.save_round(rows.limit(0), path, "b") == 2
    assert C.load_round(spark, path, "b").columns == [*rows.columns, "source"] and C.load_round(spark, path, "b").isEmpty()
    C.save_round(rows, path, "c")
    (data,) = (tmp_path / "rounds" / "c" / "data").iterdir()
    rows.write.mode("append").parquet(str(data))
    with pytest.raises(C.RoundError) as error:
        C.load_round(spark, path, "c")
    assert error.value.state == "damaged"


FEATURES = [
    {"type": "Feature", "properties": {"name": 'a "quoted} {brace', "n": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [2, 3], [4, 5]]]}},
    {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[10, 1, 7], [12, 3, 7], [14, 5, 7]], [[0, 0], [1, 1]]]}, "properties": {}},
    {"type": "Feature", "properties": {"slash": "\\", "more": "]}[{\\\"", "é": "漢字"}, "geometry": {"type": "Polygon", "coordinates": [[[-1.5, 0.25], [2, 3]]]}},
]


@pytest.mark.parametrize("layout, split", [("collection", 1 << 27), ("collection", 31), ("indented", 61), ("lines", 61), ("keys last", 97)])
def test_features_are_found_whatever_the_splits(spark, tmp_path, layout, split):
    import json

    features = FEATURES * 9
    whole = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": features}
    if layout == "keys last":
        whole = {"features": features, "crs": {"a": [{"b": 1}]}, "type": "FeatureCollection"}
    text = "\n".join(json.dumps(f, ensure_ascii=False) for f in features) + "\n" if layout == "lines" else json.dumps(whole, indent=2 if layout == "indented" else None)
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(json.dumps(whole))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        found = Rd.read_geojson(spark, str(tmp_path)).orderBy("poly_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [[tuple(map(float, p[:2])) for p in f["geometry"]["coordinates"][0]] for f in features] * 2
    assert [[(p.x, p.y) for p in r.world] for r in found] == want
    assert [r.props for r in found[:3]] == [{k: str(v) for k, v in f["properties"].items()} for f in FEATURES]
    # The id of a feature is its file and the byte at which it begins.
    data = text.encode()
    for r in found[: len(features)]:
        assert r.poly_id < 1 << 44 and json.JSONDecoder().raw_decode(data[r.poly_id :].decode())[0] in FEATURES
    assert len({r.poly_id for r in found}) == 2 * len(features)


@pytest.mark.parametrize("text", ['{"type": "Feature", "geometry": {"coordinates": oops}}\n', '{"features": [{"geometry": {"coordinates": [[[1, 2]]]}}', "hello\n{}\n"])
def test_broken_feature_files_raise(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="(?i)json|malformed|incomplete"):
        Rd.read_geojson(spark, str(tmp_path)).collect()


def test_wide_rows_have_stable_ids(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"{n}.csv").write_text("a,b,c\n" + "".join(f"{k},x,y,{k},2,3,4\n" for k in range(50)))
    seen = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in (before, "61"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            seen.append(sorted((r.poly_id, r.ring[0].j) for r in Rd.read_wide_csv(spark, str(tmp_path)).collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] and len(seen[0]) == 100


def test_oversample_needs_integers(spark):
    with pytest.raises(ValueError):
        C.oversample(spark.range(1), {1: 1.5})


def test_small_level_is_skipped(spark):
    images = spark.createDataFrame([(0, 100, 100, 0.3), (1, 300, 300, 0.3)], "image_id BIGINT, height INT, width INT, pixelsize double")
    v = spark.createDataFrame([(0, 0, 0, 50.0, 50.0), (1, 0, 0, 150.0, 150.0)], "image_id BIGINT, poly_id BIGINT, k INT, i double, j double")
    f = spark.range(180 * 180).selectExpr("CAST(id DIV 180 AS INT) AS i", "CAST(id % 180 AS INT) AS j", "2D AS di", "-1D AS dj")
    out = {r.image_id: (r.i, r.j) for r in A.multires_align(v, images, {1: f}, (1,)).collect()}
    assert out == {0: (50.0, 50.0), 1: (152.0, 149.0)}


def test_model_chain_moves_polygons(spark):
    """A constant model shifts every polygon inside the predicted area by the same pixels per level."""
    images = spark.createDataFrame([(0, 16, 16, 0.3)], "image_id BIGINT, height INT, width INT, pixelsize double")
    pixels = spark.range(256).selectExpr("0L AS image_id", "CAST(0 AS INT) AS band", "CAST(id DIV 16 AS INT) AS i", "CAST(id % 16 AS INT) AS j", "128D AS value")

    def model(batch, maps):
        side = 4
        field = batch[:, :side, :side, :2].repeat(2, axis=-1)[..., :2] * 0
        field[..., 0] = 0.25
        return field, batch[:, :side, :side, :1].repeat(4, axis=-1)

    out = A.predict_and_align(rects(spark, [(0, 0, 5.0, 5.0, 9.0, 10.0)]), images, lambda f: pixels, lambda f: model, (1,), 0.3, 8, 4, 4.0)
    assert [(p.i, p.j) for p in out.first().ring] == [(7, 5), (7, 10), (11, 10), (11, 5)]


def test_zero_model_predicts_nothing():
    import numpy as np

    field, seg = P.zero_model(np.zeros((2, 220, 220, 3)), np.zeros((2, 220, 220, 3)))
    assert field.shape == (2, 100, 100, 2) and seg.shape == (2, 100, 100, 4)
    assert not field.any() and seg[..., 0].all()
    moved, _ = P.constant_model(0.25, -0.5)(np.zeros((1, 220, 220, 3)), np.zeros((1, 220, 220, 3)))
    assert moved[0, 5, 5].tolist() == [0.25, -0.5]


def test_augmentation_repeats(spark, sf):
    from ringfield.registry import QUERIES

    rows = [sorted(map(tuple, QUERIES["augment_examples"](spark, sf).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_patch_tables(spark):
    """One 400-pixel image: patches with a vertex in the inner square survive, and the rest follows them."""
    images = spark.createDataFrame([(0, "val", 400, 400, 0.3, 1)], "image_id BIGINT, fold STRING, height INT, width INT, pixelsize double, min_ds_fac INT")
    polygons = rects(spark, [(0, 0, 150.0, 150.0, 160.0, 162.0)])
    field = spark.range(160000).selectExpr("0L AS image_id", "0 AS map_id", "CAST(id DIV 400 AS INT) AS i", "CAST(id % 400 AS INT) AS j", "0.5D AS di", "0D AS dj")
    out = Ex.build_patches(images, polygons, {1: field}, (1,), rotate=False, with_polygons=True)
    kept = {(r.r0, r.c0) for r in out["patches"].collect()}
    assert kept == {(a, b) for a in (0, 100, 180) for b in (0, 100, 180) if a + 10 <= 160 and 150 < a + 210 and b + 10 <= 162 and 150 < b + 210}
    assert out["field"].count() == len(kept) * 220 * 220
    assert out["field"].select("di").distinct().collect()[0].di == 16384
    batch = Wr.pack_batches(out["polygons"].where("patch_id = 0 AND map_id = 0")).first().batch
    assert len(batch) == 2 and all(math.isnan(p.i) for p in batch[1])
    moved = [(p.i, p.j) for p in batch[0]]
    assert moved[:4] == [(148, 150), (148, 162), (158, 162), (158, 150)] and math.isnan(moved[4][0])
    fill = {r.patch_id: r.n for r in out["disp_cells"].where("layer = 'fill'").groupBy("patch_id").agg(F.count("*").alias("n")).collect()}
    assert fill[0] == 11 * 13


def test_stateless_operators_on_a_stream(spark, sf, tmp_path):
    """Row-wise geometry runs unchanged on a streaming table."""
    X.polygons(spark, sf).select("image_id", "poly_id", "ring").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = G.ring_area(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).select("poly_id", "area")
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    still = G.ring_area(X.polygons(spark, sf)).select("poly_id", "area")
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(still).count() == 0


# ------------------------------------------------------------ closed rings and parts


def vertex_rows(spark, rings_):
    rows = [(0, p, part, k, float(i), float(j)) for p, part, ring in rings_ for k, (i, j) in enumerate(ring)]
    return spark.createDataFrame(rows, "image_id long, poly_id long, part int, k int, i double, j double")


def ring_rows(spark, rings_):
    rows = [(0, p, part, [(float(i), float(j)) for i, j in ring]) for p, part, ring in rings_]
    return spark.createDataFrame(rows, "image_id long, poly_id long, part int, ring array<struct<i:double,j:double>>")


def test_a_closing_vertex_counts_once(spark):
    nan = float("nan")
    truth = [(0, 0, [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)])]
    moved = [(0, 0, [(0, 0), (0, 4), (4, 9), (4, 0), (0, 0)])]
    tail = [(nan, nan), (50, 50), (60, 60)]
    for more, other in (([], []), (tail, [(nan, nan), (0, 0), (0, 0)])):
        a, b = ([(p, q, ring + extra) for p, q, ring in rows] for rows, extra in ((truth, more), (moved, other)))
        for curve in (M.vertex_accuracy(vertex_rows(spark, a), vertex_rows(spark, b), [1.0]), M.threshold_accuracy(ring_rows(spark, a), ring_rows(spark, b), [1.0])):
            assert [r.value for r in curve.collect()] == [0.75]


def test_parts_meet_their_own(spark):
    both = [(0, 0, [(0, 0), (0, 4), (4, 4)]), (0, 1, [(50, 50), (50, 54), (54, 54)])]
    assert [r.value for r in M.threshold_accuracy(ring_rows(spark, both), ring_rows(spark, both), [0.5]).collect()] == [1.0]
    assert [r.value for r in M.vertex_accuracy(vertex_rows(spark, both), vertex_rows(spark, both), [0.5]).collect()] == [1.0]
    summary = M.distance_summary(ring_rows(spark, both), ring_rows(spark, both), ["image_id"]).first()
    assert (summary.min_d, summary.max_d) == (0.0, 0.0)


def test_displaced_copies_are_measured_on_distinct_vertices(spark):
    from ringfield.plans.evaluate import make_test_displacements

    ring = spark.createDataFrame([(0, 0, [(0.0, 0.0), (0.0, 3.0), (3.0, 3.0), (3.0, 0.0), (0.0, 0.0)])], "image_id long, poly_id long, ring array<struct<i:double,j:double>>")
    # The one cell with a vector is that of the closing corner.
    field = spark.createDataFrame([(i, j, 1.0 if i == j == 0 else 0.0, 0.0) for i in range(4) for j in range(4)], "i int, j int, di double, dj double")
    moved, base = make_test_displacements(ring, field, 4, 4, 8.0, [1.0])
    assert moved.count() == 5
    assert [r.value for r in base.collect()] == [0.75]
