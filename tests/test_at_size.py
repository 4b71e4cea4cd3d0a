"""Operators whose cost once grew faster than their input: what they shuffle and where they compute."""

from __future__ import annotations

import contextlib
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ringfield.functions import rings, shared_area
from ringfield.operators import edge_joins as E
from ringfield.operators import geometry as G
from ringfield.operators import overlap as O
from ringfield.operators import raster as R
from ringfield.plans import examples as Ex
from ringfield.registry.workflows import _all_number_rows
from ringfield.sources import writers as Wr


def plan(df) -> list[str]:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue().splitlines()


def shapes(spark, corners):
    draw = random.Random(3)
    rows = [
        (n % 3 if n % 5 else None, [(draw.uniform(-40, 600), draw.uniform(-40, 90)) for _ in range(corners)]) for n in range(12)
    ]
    return spark.createDataFrame(rows + rows[:4], "g long, ring array<struct<i double, j double>>")


def cells(df):
    found = [(r.g, r.i, r.j) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_triangles_travel_not_their_cells(spark):
    table = shapes(spark, 3)
    drawn = R.rasterize_triangles(table)
    assert cells(drawn) == {(r.g, r.i, r.j) for r in R.fill_cells(table).collect()}
    assert not [line for line in plan(drawn) if "Exchange" in line and "j#" in line]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_lines_travel_not_their_cells(spark, width):
    table = R.drawn_edges(shapes(spark, 4), True)
    level = table.withColumn("i2", F.col("i1"))
    table = table.unionByName(level).withColumn("k", F.lit(0))
    drawn = R.rasterize_lines(table, width)
    assert cells(drawn) == {(r.g, r.i, r.j) for r in R.line_cells(table, width).collect()}
    assert not [line for line in plan(drawn) if "Exchange" in line and "j#" in line]


FRAME = [(0, 1, 5, 4, 7, 3), (1, 2, 3, 7, 6, 5)]
FAN = [(0, 1, 9), (1, 2, 9), (2, 0, 9)]


def faces(spark, groups):
    rows = [(g, list(f)) for g, group in groups for f in group]
    return spark.createDataFrame(rows, "g int, face array<bigint>")


def outlines(df):
    return sorted((r.g, tuple(r.face)) for r in df.collect())


def test_small_groups_of_faces_are_followed_in_their_row(spark, monkeypatch):
    def never(*_):
        raise AssertionError("doubled")

    monkeypatch.setattr(E, "cycle_order", never)
    found = outlines(E.merge_faces(faces(spark, [(0, FRAME), (1, FAN)]), ["g"]))
    assert found == [(0, (0, 1, 2, 3)), (0, (4, 7, 6, 5)), (1, (0, 1, 2))]


def test_groups_of_faces_agree_on_both_ways(spark, monkeypatch):
    # A missing key, and a group with a face given twice, go the long way whatever their size.
    table = faces(spark, [(0, FRAME), (1, FAN), (None, FAN), (3, [(0, 1, 2), (0, 1, 2)]), (4, [(), (5, 6, 7)])])
    short = outlines(E.merge_faces(table, ["g"]))
    monkeypatch.setattr(E, "FEW_SIDES", 0)
    assert short == outlines(E.merge_faces(table, ["g"]))


def test_angles_are_not_taken_in_a_lambda(spark):
    ring = [(0.0, 0.0), (0.0, 4.0), (3.0, 4.0)]
    table = spark.createDataFrame([(1, ring)], "poly_id long, ring array<struct<i double, j double>>")
    turned = G.turn_angles(table)
    assert [round(r.inner, 6) for r in turned.orderBy("k").collect()] == [0.643501, 1.570796, 0.927295]
    assert not [line for line in plan(turned) if "Generate" in line and "ACOS" in line.upper()]


def test_edge_distances_are_not_part_of_the_join(spark):
    sides = [(0, n, 0, 4.0 * n, 0.0, 4.0 * n, 9.0) for n in range(3)] + [(0, 7, 0, 4.0, 2.0, 4.0, 5.0)]
    table = spark.createDataFrame(sides, "image_id long, poly_id long, k int, i1 double, j1 double, i2 double, j2 double")
    found = E.edge_overlaps(table, 0.5)
    assert [(r.poly_id, r.poly_id_b, r.on_edge) for r in found.collect()] == [(1, 7, 2)]
    assert not [line for line in plan(found) if "Join" in line and "SQRT" in line.upper()]


def crowd(spark, count, reach, seed):
    """Triangles and L shapes, some ids and rings given twice, and rows without image, id or ring."""
    draw = random.Random(seed)

    def ring():
        i, j, h, w = draw.randrange(reach), draw.randrange(reach), draw.uniform(2, 40), draw.uniform(2, 40)
        ell = [(i, j), (i, j + w), (i + h / 2, j + w), (i + h / 2, j + w / 2), (i + h, j + w / 2), (i + h, j)]
        points = ell if draw.random() < 0.5 else [(i, j), (i + h, j + w), (i + h, j - w)]
        return [(float(x), float(y)) for x, y in (points if draw.random() < 0.5 else points[::-1])]

    rows = [(n % 2, draw.randrange(10 * count), ring()) for n in range(count)]
    rows += [(g, n + 1, r) for g, n, r in rows[:5]] + [(g, n, ring()) for g, n, _ in rows[5:10]]
    rows += [(None, 1, ring()), (0, None, ring()), (0, 3, None), (0, 4, []), (1, 5, [(1.0, None), (9.0, 9.0), (1.0, 9.0)])]
    return spark.createDataFrame(rows, "image_id int, poly_id long, ring array<struct<i double, j double>>")


def pairs_of(table):
    return {(r.image_id, r.poly_a, r.poly_b) for r in O.overlapping_pairs(table).select("image_id", "poly_a", "poly_b").collect()}


def groups_of(links):
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for g, a, b in links:
        one, two = sorted((find((g, a)), find((g, b))))
        root[two] = one
    return {n: find(n) for n in root}


@pytest.mark.parametrize(("reach", "most"), [(60, 25), (400, 2000)])
def test_what_follows_from_pairs_is_told_by_tile(spark, reach, most):
    table = crowd(spark, 120, reach, reach + most)
    pairs = pairs_of(table)
    assert pairs
    links = O._told_by_tile(table, 32, most, shared_area.hubs, ("a", "b")).collect()
    assert groups_of({(r.image_id, r.a, r.b) for r in links}) == groups_of(pairs)
    latest = {}
    for r in O._told_by_tile(table, 32, most, shared_area.latest, ("poly_id", "partner")).collect():
        latest[r.image_id, r.poly_id] = max(latest.get((r.image_id, r.poly_id), r.partner), r.partner)
    wanted = {}
    for g, a, b in sorted(pairs):
        wanted[g, b] = a
    assert latest == wanted


def test_clusters_list_no_pairs(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("pairs listed")

    monkeypatch.setattr(O, "overlapping_pairs", never)
    square = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0)]
    rows = [(0, n, [(i + n // 20 * 100.0, j + n % 20) for i, j in square]) for n in range(40)]
    table = spark.createDataFrame(rows, "image_id int, poly_id long, ring array<struct<i double, j double>>")
    found = O.largest_per_cluster(table).collect()
    assert sorted((r.cluster, r.poly_id, r.area, r.members) for r in found) == [(0, 0, 81.0, 20), (20, 20, 81.0, 20)]
    found = O.largest_per_running_cluster(table).collect()
    assert sorted((r.start, r.poly_id, r.area) for r in found) == [(0, 0, 81.0), (20, 20, 81.0)]


def test_rotations_take_slices_not_places(spark):
    long, short = [(0.0, 0.0), (0.0, 3.0), (4.0, 3.0)], [(4.0, 3.0), (0.0, 0.0)]
    rows = [(1, long, short), (2, long, long[1:] + long[:1]), (3, None, short), (4, [], short), (5, None, None)]
    kind = "array<struct<i double, j double>>"
    table = spark.createDataFrame(rows, f"n int, a {kind}, b {kind}")
    for metric, first in (("l2", [0.0, 0.0, 3.0]), ("sum", [0.0, 0.0, 3.0])):
        matched = table.select("n", rings.cyclic_match(F.col("a"), F.col("b"), metric).alias("m"))
        found = {r.n: r.m and (r.m.mean, r.m.shift, r.m.distances) for r in matched.collect()}
        assert found == {1: (1.0, 1, first), 2: (0.0, 2, [0.0] * 3), 3: (None, 0, [None] * 2), 4: (None, 0, [None] * 2), 5: None}
        assert "pmod" not in "".join(plan(matched)).lower()


def test_columns_of_numbers_are_read_from_records_made_once(spark):
    """the records were made again for each of their columns."""
    a, b = np.arange(8, dtype="u1"), np.arange(16, dtype="<i2") - 7
    rows = [(n, bytearray((a + n).tobytes()), bytearray((b * n).tobytes())) for n in range(3)]
    made = spark.createDataFrame(rows, "image_id long, one binary, two binary").mapInArrow(lambda batches: batches, "image_id long, one binary, two binary")
    found = _all_number_rows(made, ["image_id"], [("one", "u1", 2, 2), ("two", "<i2", 2, 2)])
    assert sum("MapInArrow" in line for line in plan(found)) == 1
    want = set()
    for n in range(3):
        for name, kind, values in (("one", 1, a + n), ("two", 2, b * n)):
            want |= {(n, name, *map(int, at), float(v)) for at, v in np.ndenumerate(values.reshape(kind, 2, 2, 2))}
    assert {(r.image_id, r.name, r.map_id, r.i, r.j, r.plane, r.value) for r in found.collect()} == want


def test_polygons_travel_not_their_runs(spark):
    """runs were gathered before the shuffle, by tasks whose memory grew with their polygons."""
    table = shapes(spark, 6).withColumns({"height": F.when(F.col("g") == 1, 90).otherwise(700), "width": F.lit(60)})
    bent = table.where("g = 2").withColumn("ring", F.transform("ring", lambda p, n: F.when(n != 2, p)))
    table = table.unionByName(bent).unionByName(table.limit(1).withColumn("ring", F.lit(None).cast(table.schema["ring"].dataType)))
    drawn = R.rasterize(table, F.col("height"), F.col("width"), line_width=4)
    steps = plan(drawn) + plan(R.rasterize(table.withColumn("map_id", F.lit(0)), F.col("height"), F.col("width")))
    assert not [line for line in steps if "hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]
    rings_only = table.where("ring IS NOT NULL")
    points = rings_only.select("g", "height", "width", F.explode("ring").alias("p"))
    near = points.select("g", "height", "width", F.expr("CAST(rint(p.i) AS INT)").alias("i"), F.expr("CAST(rint(p.j) AS INT)").alias("j"))
    layers = {"fill": R.fill_cells(rings_only), "edge": R.line_cells(R.drawn_edges(rings_only), 4), "vertex": near}
    want = {
        (r.g, name, r.i, r.j) for name, df in layers.items()
        for r in df.where("i >= 0 AND i < height AND j >= 0 AND j < width").collect()
    }
    found = [(r.g, r.layer, r.i, r.j) for r in drawn.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_truth_is_drawn_once_for_all_patch_tables(spark):
    """the truth's cells were drawn again for each table that follows the patches."""
    square = [(float(i), float(j)) for i, j in ((60, 60), (60, 90), (90, 90), (90, 60))]
    polygons = spark.createDataFrame([(1, 0, square)], "image_id long, poly_id long, ring array<struct<i double, j double>>")
    images = spark.createDataFrame([(1, 200, 200, 1.0, "train", 1)], "image_id long, height int, width int, pixelsize double, fold string, min_ds_fac int")
    field = spark.range(200 * 200).selectExpr("1L AS image_id", "0 AS map_id", "int(id DIV 200) AS i", "int(id % 200) AS j", "0D AS di", "0D AS dj")
    tables = Ex.build_patches(images, polygons, {1: field}, (1,), 1.0, 40, 100)
    for name in ("patches", "gt_cells", "field"):
        assert not [line for line in plan(tables[name]) if "ring#" in line], name
    assert tables["gt_cells"].where("layer = 'vertex'").select("i", "j").distinct().count() == 4


def test_pairs_are_told_in_cells_not_by_a_join(spark):
    """every pair of polygons of a tile was a row of a join, and its sides were met one by one in a lambda."""
    table = crowd(spark, 100, 60, 8)
    found = O.overlapping_pairs(table, hot_rows=30)
    assert not [line for line in plan(O.overlapping_pairs(table)) if "Join" in line and "Inner" in line]
    rows = [r for r in table.collect() if r.image_id is not None and r.poly_id is not None and r.ring and all(None not in tuple(p) for p in r.ring)]
    want = []
    for a in rows:
        for b in rows:
            if a.image_id == b.image_id and a.poly_id < b.poly_id:
                want.append((a.image_id, a.poly_id, b.poly_id, [tuple(p) for p in a.ring], [tuple(p) for p in b.ring]))
    kind = "array<struct<i double, j double>>"
    given = spark.createDataFrame(want, f"image_id int, poly_a long, poly_b long, a {kind}, b {kind}")
    base = F.least(F.array_min(F.transform("a", lambda p: p["j"])), F.array_min(F.transform("b", lambda p: p["j"])))
    strips = given.withColumns({"s": rings.strips(F.col("a")), "t": rings.strips(F.col("b")), "base": base})
    measured = strips.select("image_id", "poly_a", "poly_b", rings.strip_overlap(F.col("s"), F.col("t"), F.col("base")).alias("shared"))
    pairs = sorted(tuple(r) for r in measured.collect() if r.shared > 1e-9)
    got = sorted(tuple(r) for r in found.select("image_id", "poly_a", "poly_b", "shared").collect() if r.shared > 1e-9)
    assert len(pairs) > 100 and got == pairs


def test_areas_of_rings_of_few_and_of_many_sides_agree(monkeypatch):
    draw = random.Random(3)

    def round_(n):
        i, j, turn = draw.uniform(0, 9), draw.uniform(0, 9), draw.choice([1, -1])
        points = [(i + 8 * np.cos(6.283 * k / n * turn), j + 8 * np.sin(6.283 * k / n * turn)) for k in range(n)]
        return [float(x) for x, _ in points], [float(y) for _, y in points]

    made = [round_(draw.choice([3, 4, 6, 30])) for _ in range(60)]
    table = pa.table({"poly_id": list(range(60)), "is": [x for x, _ in made], "js": [y for _, y in made], **{c: [f(v) for v in of] for c, f, of in (
        ("r0", min, [x for x, _ in made]), ("c0", min, [y for _, y in made]), ("r1", max, [x for x, _ in made]), ("c1", max, [y for _, y in made]))}})
    sides = shared_area.rings_of(table, "poly_id")
    p, q = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    monkeypatch.setattr(shared_area, "PAIRS", 100)
    assert (shared_area.areas(sides, sides, p, q) == shared_area._shared(sides, sides, p, q)).all()


@pytest.mark.parametrize("most", [7, 4000])
def test_edges_are_met_in_cells_not_by_a_join(spark, most):
    """every pair of edges of a tile was a row of a join."""
    table = G.edges(crowd(spark, 60, 80, most).select("image_id", "poly_id", "ring"))
    wide = spark.createDataFrame([(0, 90000, 0, 1.0, -500.0, 40.0, 900.0), (1, 90001, 0, 2.0, 2.0, 2.0, 900.0)], "image_id int, poly_id long, k int, i1 double, j1 double, i2 double, j2 double")
    table = table.unionByName(wide)
    crossed, over = E.edge_crossings(table, hot_rows=most), E.edge_overlaps(table, 2.0, hot_rows=most, ends=False)
    assert not [line for df in (E.edge_crossings(table), E.edge_overlaps(table, 2.0)) for line in plan(df) if "Join" in line and "Inner" in line]
    pairs = E.candidate_edge_pairs(table, 0.0)
    (a1, a2), (b1, b2) = E._ends(), E._ends("_b")
    apart = ~(E._same(a1, b1) | E._same(a1, b2) | E._same(a2, b1) | E._same(a2, b2))
    at = G.settled(pairs.where(apart).withColumn("at", E.line_intersection(a1, a2, b1, b2)), "at").where("at.i != double('inf')")
    seen = [G.angle_between(F.col("at"), *x) > np.pi - 1e-6 for x in ((a1, a2), (b1, b2))]
    wanted = at.where(seen[0] & seen[1]).select(*crossed.columns[:-2], "at.i", "at.j")
    rows = sorted(map(repr, crossed.collect()))
    assert len(rows) > 100 and rows == sorted(map(repr, wanted.collect()))
    near = E.candidate_edge_pairs(table, 4.0)

    def on(p, e1, e2):
        def span(x, y):
            return F.sqrt((x["i"] - y["i"]) * (x["i"] - y["i"]) + (x["j"] - y["j"]) * (x["j"] - y["j"]))

        return (span(p, e1) + span(p, e2) < span(e1, e2) + 2.0).cast("int")

    count = sum((on(p, *e) for p, e in ((a1, (b1, b2)), (a2, (b1, b2)), (b1, (a1, a2)), (b2, (a1, a2)))), F.lit(0))
    count = count - sum((E._same(p, q).cast("int") for p in (a1, a2) for q in (b1, b2)), F.lit(0))
    wanted = near.withColumn("on_edge", count).where("on_edge >= 2").select(*over.columns)
    rows = sorted(map(repr, over.collect()))
    assert rows and rows == sorted(map(repr, wanted.collect()))
    own = E.edge_crossings(table, within=True, ends=False)
    assert sorted(map(repr, own.collect())) == sorted(map(repr, crossed.where("poly_id = poly_id_b").select(*own.columns).collect()))


def test_only_hubs_are_connected_in_rounds(spark, monkeypatch):
    """a link for each polygon of a tile went through all rounds, each stored; rings were shuffled again for each step."""
    square = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0)]
    rows = [(0, n, [(i + n // 60 * 100.0, j + n % 60 * 8) for i, j in square]) for n in range(240)]
    rows += [(0, 1000 + n, ring) for _, n, ring in rows[:20]]
    table = spark.createDataFrame(rows, "image_id int, poly_id long, ring array<struct<i double, j double>>")
    given, connected = [], O.connected_components

    def counted(nodes, pairs, keys):
        given.append(pairs.count())
        return connected(nodes, pairs, keys)

    monkeypatch.setattr(O, "connected_components", counted)
    found = {(r.poly_id, r.cluster) for r in O.cluster_labels(table, size=32).collect()}
    assert found == {(n, n % 1000 // 60 * 60) for _, n, _ in rows}
    assert given and given[0] <= 4 * 3 * 2


def test_rings_wait_while_slots_are_numbered(spark, monkeypatch):
    """F8: rings were checkpointed three times and shuffled with each step of the numbering."""
    numbered, given = Wr.number_rows, []

    def noted(df, *rest, **more):
        given.append(df.columns)
        return numbered(df, *rest, **more)

    monkeypatch.setattr(Wr, "number_rows", noted)
    kind = "array<struct<i double, j double>>"
    rings_ = {n: [(float(n), float(k)) for k in range(3 + n % 2)] for n in range(4)}
    rows = [(0, p, n, r, 10 * p, 0) for p in (0, 1) for n, r in rings_.items()] + [(0, 1, 2, rings_[2], 10, 0)]
    touching = spark.createDataFrame(rows, f"image_id long, patch_id int, poly_id long, ring {kind}, r0 int, c0 int")
    moved = spark.createDataFrame([(0, n, 0, [(i + 1, j) for i, j in r]) for n, r in rings_.items()], f"image_id long, poly_id long, map_id int, ring {kind}")
    found = Wr.export_padded(touching, moved).collect()
    assert given and "ring" not in given[0]
    for patch, ids in ((0, [0, 1, 2, 3]), (1, [0, 1, 2, 2, 3])):
        for m in (-1, 0):
            mine = sorted((r.slot, r.poly_id, [(p.i, p.j) for p in r.ring if p.i == p.i], len(r.ring)) for r in found if r.patch_id == patch and r.map_id == m)
            shift = [[(i + (m + 1) - (10 * patch if m == 0 else 0), j) for i, j in rings_[n]] for n in ids]
            assert mine == [(k, n, r, 5) for k, (n, r) in enumerate(zip(ids, shift))] + [(len(ids), None, [], 5)]
