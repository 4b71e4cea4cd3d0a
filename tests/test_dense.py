"""Dense tiles and example records against plain numpy on small images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfield.functions import arrays
from ringfield.operators import dense
from ringfield.plans import examples as Ex

SHAPES = {0: (21, 13), 1: (8, 8), 2: (5, 30)}


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(4)
    return {n: rng.integers(0, 256, (2, *shape)) for n, shape in SHAPES.items()}


@pytest.fixture(scope="module")
def cells(spark, images):
    rows = [(n, p, i, j, float(v)) for n, a in images.items() for (p, i, j), v in np.ndenumerate(a) if v]
    return spark.createDataFrame(rows, "image_id long, plane int, i int, j int, value double").repartition(3)


def whole(tiles, planes, kind, side, shapes):
    out = {n: np.zeros((planes, *shape)) for n, shape in shapes.items()}
    for r in dense.unpack_tiles(tiles, ["image_id"], planes, kind, side).collect():
        if r.i < shapes[r.image_id][0] and r.j < shapes[r.image_id][1]:
            out[r.image_id][r.plane, r.i, r.j] = r.value
    return out


def test_cells_to_tiles_and_back(cells, images):
    tiles = dense.pack_cells(cells, ["image_id"], F.col("plane"), 2, "u1", 4)
    back = whole(tiles, 2, "u1", 4, SHAPES)
    assert all((back[n] == images[n]).all() for n in images)


def brute_mean(a, to):
    """Mean of the stretch each target cell covers, cell parts included."""
    out = np.zeros((a.shape[0], *to))
    ratios = [h / t for h, t in zip(a.shape[1:], to)]
    for i in range(to[0]):
        for j in range(to[1]):
            for s in range(a.shape[1]):
                for t in range(a.shape[2]):
                    wi = max(0.0, min((i + 1) * ratios[0], s + 1) - max(i * ratios[0], s))
                    wj = max(0.0, min((j + 1) * ratios[1], t + 1) - max(j * ratios[1], t))
                    out[:, i, j] += a[:, s, t] * wi * wj / (ratios[0] * ratios[1])
    return out


@pytest.mark.parametrize("side, targets", [(4, {0: (10, 7), 1: (4, 4), 2: (5, 9)}), (8, {0: (21, 13), 1: (3, 1), 2: (1, 1)})])
def test_scaling_down_by_tiles(spark, cells, images, side, targets):
    tiles = dense.pack_cells(cells, ["image_id"], F.col("plane"), 2, "u1", side)
    shapes = spark.createDataFrame([(n, *SHAPES[n], *targets[n]) for n in SHAPES], "image_id long, from_h int, from_w int, height int, width int")
    found = whole(dense.resample_tiles(tiles, shapes, ["image_id"], 2, "u1", side, "<f8"), 2, "<f8", side, targets)
    for n in images:
        assert found[n] == pytest.approx(brute_mean(images[n], targets[n]), abs=1e-9)
    rounded = whole(dense.resample_tiles(tiles, shapes, ["image_id"], 2, "u1", side), 2, "u1", side, targets)
    assert all((rounded[n] == np.rint(found[n])).all() for n in images)


def test_patches_are_cut_from_tiles(spark, cells, images):
    tiles = dense.pack_cells(cells, ["image_id"], F.col("plane"), 2, "u1", 4)
    boxes = [(n, k, r, c, r + 6, c + 6) for n in SHAPES for k, (r, c) in enumerate([(0, 0), (-2, -3), (3, 1), (17, 9), (2, 26)])]
    patches = spark.createDataFrame(boxes, "image_id long, patch_id int, r0 int, c0 int, r1 int, c1 int")
    pieces = dense.patch_pieces(tiles, patches, ["image_id"], 2, "u1", 4)
    part = F.struct(F.lit(0).alias("map_id"), "i0", "j0", "rows", "piece")
    joined = pieces.groupBy("image_id", "patch_id").agg(F.collect_list(part).alias("p"))
    found = {(r.image_id, r.patch_id): np.frombuffer(r.d, "u1").reshape(6, 6, 2) for r in joined.select("image_id", "patch_id", dense.assembled(F.col("p"), 2, 6, 6, "u1").alias("d")).collect()}
    for n, k, r0, c0, r1, c1 in boxes:
        want = np.zeros((6, 6, 2))
        h, w = SHAPES[n]
        for i in range(max(r0, 0), min(r1, h)):
            for j in range(max(c0, 0), min(c1, w)):
                want[i - r0, j - c0] = images[n][:, i, j]
        assert (found.get((n, k), np.zeros((6, 6, 2))) == want).all()


def test_parts_of_a_mask():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((12, 9)) < 0.5
        label = arrays.parts_of(mask)
        want = np.full(mask.shape, -1)
        for start in zip(*np.nonzero(mask)):
            if want[start] >= 0:
                continue
            todo = [start]
            while todo:
                i, j = todo.pop()
                if 0 <= i < 12 and 0 <= j < 9 and mask[i, j] and want[i, j] < 0:
                    want[i, j] = start[0] * 9 + start[1]
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        assert (label == want).all()


def test_dropped_parts_take_their_layers_along():
    layers = np.zeros((7, 12, 3))
    layers[1:3, 1:4, 0] = layers[4:6, 7:10, 0] = 1.0
    layers[1, 0, 1] = layers[3, 10, 2] = 1.0
    seen = {tuple(arrays.without_parts(layers, 0.5, np.random.default_rng(n)).sum(axis=(0, 1))) for n in range(40)}
    assert seen == {(0, 0, 0), (6, 1, 0), (6, 0, 1), (12, 1, 1)}


def test_turning_there_and_back():
    rng = np.random.default_rng(2)
    a = rng.random((9, 9, 2))
    quarter = arrays.turned(a, math.pi / 2)
    assert quarter == pytest.approx(np.rot90(a, -1).transpose(0, 1, 2)) or quarter == pytest.approx(np.rot90(a, 1))
    assert arrays.turned(quarter, -math.pi / 2) == pytest.approx(a)
    assert (arrays.turned(a, math.pi, nearest=True) == a[::-1, ::-1]).all()
    assert arrays.centred(arrays.centred(a, 14), 9) == pytest.approx(a)


def test_choices_repeat_and_move_everything_together(spark):
    """A mark in one corner of image, maps and field ends in the same place of all of them."""
    rows = []
    for n in range(30):
        image, truth = np.zeros((12, 12, 3), "u1"), np.zeros((12, 12, 3), "u1")
        maps, field = np.zeros((2, 12, 12, 3), "u1"), np.zeros((2, 12, 12, 2), "<i2")
        i, j = 4 + n % 4, 4 + n // 4 % 4
        image[i, j], truth[i, j, 2], maps[:, i, j, 2], field[:, i, j] = 255, 255, 255, 32767
        rows.append((n, 1, 0, 12, 2, *(bytearray(x.tobytes()) for x in (image, truth, maps, field))))
    names = "image binary, gt_polygon_map binary, disp_polygon_maps binary, disp_field_maps binary"
    records = spark.createDataFrame(rows, f"image_id long, ds_fac int, patch_id int, tile_res int, disp_map_count int, {names}")
    chosen = Ex.example_params(records, 5).withColumns({"brightness": F.lit(0.0), "contrast": F.lit(1.0), "saturation": F.lit(1.0)})
    runs = [sorted(Ex.augment_records(d, 8, 4, None, 5, kind="<f8").collect()) for d in (chosen, chosen.repartition(4))]
    assert runs[0] == runs[1] and len(runs[0]) > 15
    for r in runs[0]:
        truth = np.frombuffer(r.gt_polygon_map).reshape(8, 8, 3)[..., 2]
        (i, j), = np.argwhere(truth > 0)
        image = np.frombuffer(r.image).reshape(8, 8, 3).mean(axis=2)
        field = np.abs(np.frombuffer(r.disp_field_map).reshape(4, 4, 2)).sum(axis=2)
        assert abs(np.argwhere(image == image.max())[0] - (i, j)).max() <= 1
        assert abs(np.argwhere(field == field.max())[0] + 2 - (i, j)).max() <= 1
        assert (np.frombuffer(r.disp_polygon_map).reshape(8, 8, 3)[..., 2] == truth).all()
