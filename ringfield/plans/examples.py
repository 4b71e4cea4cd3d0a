"""Training examples: cutting images into patches, and augmenting stored examples."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfield.functions import arrays, rings
from ringfield.functions.numeric import uniform
from ringfield.operators import dense
from ringfield.operators.fields import displace_polygons, quantise_field, rotate_vectors
from ringfield.operators.geometry import collect_rings, explode_ring, level_factor
from ringfield.operators.raster import (
    cells_in_patches,
    centre_crop_pad,
    drop_components,
    photometric,
    photometric_params,
    rasterize,
    rotate_cells,
)
from ringfield.operators.tiles import (
    keep_patches_with_vertices,
    patch_grid,
    polygons_touching_patches,
    rotated_patch_size,
)
from ringfield.session import written
from ringfield.sources.writers import export_padded, write_sharded


def level_tables(images: DataFrame, polygons: DataFrame, ds_fac: int, reference: float) -> tuple[DataFrame, DataFrame]:
    """Images and rings scaled to one level."""
    factor = level_factor(ds_fac, F.col("pixelsize"), reference)
    sized = images.where(F.col("min_ds_fac") <= ds_fac).select(
        "image_id", "fold", F.lit(ds_fac).alias("ds_fac"), factor.alias("factor"),
        F.rint(F.col("height") / factor).cast("int").alias("height"), F.rint(F.col("width") / factor).cast("int").alias("width"),
    )
    scaled = polygons.join(sized, "image_id").withColumn("ring", rings.scale(F.col("ring"), 1 / F.col("factor")))
    return sized.drop("factor"), scaled.drop("factor")


def build_patches(
    images: DataFrame, polygons: DataFrame, fields: dict[int, DataFrame], levels: Sequence[int], reference: float = 0.3,
    stride: int = 100, res: int = 220, max_abs: float = 4.0, rotate: bool = True, with_polygons: bool = False,
    line_width: int = 3,
) -> dict[str, DataFrame]:
    """Patch tables over all images and levels: `patches`, `gt_cells`, `disp_cells`, `field`, and `polygons` on request.

    Rings come simplified. `fields[level]` is normalised to [-1, 1] and keyed by
    (image_id, map_id, i, j). Patches without a vertex in their inner square are
    dropped, and everything else follows the patches that remain.
    """
    step, size = rotated_patch_size(stride, res) if rotate else (stride, res)
    parts: dict[str, list[DataFrame]] = {}
    for ds_fac in levels:
        sized, scaled = level_tables(images, polygons, ds_fac, reference)
        limits = ("height", "width")
        base = scaled.select("image_id", "ds_fac", *limits, "ring")
        # Kept patches need these cells before any table can be cut: they are drawn once, not again for each table.
        gt_cells = written(rasterize(base, F.col("height"), F.col("width"), line_width=line_width).drop(*limits), "gt-cells")
        field = fields[ds_fac].join(sized.select("image_id", *limits), "image_id")
        vertices = explode_ring(scaled.select("image_id", "poly_id", *limits, "ring"))
        moved = displace_polygons(vertices, field, *limits, max_abs)
        displaced = collect_rings(moved, "image_id", "poly_id", "map_id", *limits)
        disp_cells = rasterize(displaced.withColumn("ds_fac", F.lit(ds_fac)), F.col("height"), F.col("width"), line_width=line_width).drop(*limits)
        grid = patch_grid(sized, step, size)
        kept = written(keep_patches_with_vertices(grid, gt_cells.where(F.col("layer") == "vertex"), 2 * step), "kept-patches")
        coded = quantise_field(field.drop(*limits)).withColumn("ds_fac", F.lit(ds_fac))
        found = {
            "patches": kept,
            "gt_cells": cells_in_patches(gt_cells, kept),
            "disp_cells": cells_in_patches(disp_cells, kept),
            "field": cells_in_patches(coded, kept),
        }
        if with_polygons:
            touching = polygons_touching_patches(scaled.select("image_id", "poly_id", "ring"), kept)
            padded = export_padded(touching, displaced.drop(*limits))
            found["polygons"] = padded.withColumn("ds_fac", F.lit(ds_fac))
        for name, df in found.items():
            parts.setdefault(name, []).append(df)
    tables = {}
    for name, dfs in parts.items():
        union = dfs[0]
        for df in dfs[1:]:
            union = union.unionByName(df)
        tables[name] = union
    return tables


LAYERS = ("fill", "edge", "vertex")
#: Number types of a stored record: image bytes, polygon maps, coded fields.
KINDS = {"image": "u1", "gt_polygon_map": "u1", "disp_polygon_maps": "u1", "disp_field_maps": "<i2"}


def patch_records(
    pixel_tiles: DataFrame, images: DataFrame, polygons: DataFrame, fields: dict[int, DataFrame], levels: Sequence[int],
    map_count: int, reference: float = 0.3, stride: int = 100, res: int = 220, max_abs: float = 4.0, rotate: bool = True,
    line_width: int = 3, bands: int = 3, side: int = dense.SIDE,
) -> DataFrame:
    """One record a patch, over all images and levels, with everything a training example holds.

    (image_id, ds_fac, patch_id, fold, r0, c0, tile_res, disp_map_count, image, gt_polygon_map, disp_field_maps, disp_polygon_maps): the last
    four are numbers of the types in `KINDS`, laid out res x res x channels, the maps one after the other.

    `pixel_tiles(image_id, ti, tj, data)` are tiles of bytes with all bands, `fields[level]` is normalised to
    [-1, 1] and keyed by (image_id, map_id, i, j), map_id from 0 to map_count - 1. Images are scaled down tile by tile.
    Patches without a vertex in their inner square go before anything is cut; what the others need of a tile travels to
    them, and each patch is gathered once. Rings come simplified.
    """
    step, size = rotated_patch_size(stride, res) if rotate else (stride, res)
    plane = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer")) - 1
    whole: DataFrame | None = None
    for ds_fac in levels:
        sized, scaled = level_tables(images, polygons, ds_fac, reference)
        limits = ("height", "width")
        gt_cells = rasterize(scaled.select("image_id", *limits, "ring"), F.col("height"), F.col("width"), line_width=line_width).drop(*limits)
        gt_cells = written(gt_cells, "gt-cells")
        field = fields[ds_fac].join(sized.select("image_id", *limits), "image_id")
        vertices = explode_ring(scaled.select("image_id", "poly_id", *limits, "ring"))
        displaced = collect_rings(displace_polygons(vertices, field, *limits, max_abs), "image_id", "poly_id", "map_id", *limits)
        disp_cells = rasterize(displaced, F.col("height"), F.col("width"), line_width=line_width).drop(*limits)
        vertex_cells = gt_cells.where(F.col("layer") == "vertex").withColumn("ds_fac", F.lit(ds_fac))
        kept = written(keep_patches_with_vertices(patch_grid(sized, step, size), vertex_cells, 2 * step), "kept-patches")
        shapes = images.select("image_id", F.col("height").alias("from_h"), F.col("width").alias("from_w")).join(sized.select("image_id", *limits), "image_id")
        coded = quantise_field(field.drop(*limits))
        channels = F.explode(F.array(*[F.struct(F.lit(n).alias("plane"), F.col(c).alias("value")) for n, c in enumerate(("di", "dj"))]))
        coded = coded.select("image_id", "map_id", "i", "j", channels.alias("c")).select("image_id", "map_id", "i", "j", "c.*")
        tables = {
            "image": (dense.resample_tiles(pixel_tiles, shapes, ["image_id"], bands, "u1", side), bands),
            "gt_polygon_map": (dense.pack_cells(gt_cells, ["image_id"], plane, 3, "u1", side), 3),
            "disp_polygon_maps": (dense.pack_cells(disp_cells, ["image_id", "map_id"], plane, 3, "u1", side), 3),
            "disp_field_maps": (dense.pack_cells(coded, ["image_id", "map_id"], F.col("plane"), 2, "<i2", side), 2),
        }
        for name, (tiles, planes) in tables.items():
            maps = F.col("map_id").cast("int") if "map_id" in tiles.columns else F.lit(0)
            carried = tuple(c for c in ("fold", "r0", "c0") if c in kept.columns)
            keys = [c for c in ("image_id", "map_id") if c in tiles.columns]
            pieces = dense.patch_pieces(tiles, kept.withColumn("ds_fac", F.lit(ds_fac)), keys, planes, KINDS[name], side, carried)
            owner = ["image_id", "patch_id", *carried]
            part = F.struct(maps.alias("map_id"), "i0", "j0", "rows", "piece")
            pieces = pieces.select(*owner, F.lit(ds_fac).alias("ds_fac"), F.lit(name).alias("name"), part.alias("p"))
            whole = pieces if whole is None else whole.unionByName(pieces)
    owner = [c for c in whole.columns if c not in ("name", "p")]
    counts = {"image": (bands, 1), "gt_polygon_map": (3, 1), "disp_polygon_maps": (3, map_count), "disp_field_maps": (2, map_count)}
    lists = [F.collect_list(F.when(F.col("name") == name, F.col("p"))).alias(name) for name in counts]
    gathered = whole.groupBy(*owner).agg(*lists)
    data = [dense.assembled(F.col(n), planes, size, size, KINDS[n], maps).alias(n) for n, (planes, maps) in counts.items()]
    return gathered.select(*owner, F.lit(size).alias("tile_res"), F.lit(map_count).alias("disp_map_count"), *data)


def example_params(records: DataFrame, seed: int, keys: Sequence[str] = ("image_id", "ds_fac", "patch_id")) -> DataFrame:
    """Adds one row's random choices, drawn from its ids: the map, turn, flip, brightness, contrast and saturation."""
    ids = [F.col(k) for k in keys]

    def draw(n: int) -> Column:
        return uniform(seed * 7919 + n, *ids)

    return records.withColumns(
        {
            "map_id": F.floor(draw(0) * F.col("disp_map_count")).cast("int"), "turn": draw(1) * 2 * F.pi(), "flip": draw(2) >= 0.5,
            "brightness": draw(3) * 0.5 - 0.25, "contrast": draw(4) * 0.4 + 0.8, "saturation": draw(5) * 0.4 + 0.8,
        }
    )


def augment_records(
    records: DataFrame, out: int = 220, out_field: int = 100, keep: float | None = 0.1, seed: int = 0, dynamic_range: float = 0.5,
    bands: int = 3, kind: str = "<f4",
) -> DataFrame:
    """Stored records as training examples: image, truth map, displaced map and field moved together.

    `records` carries the choices of `example_params` (or the caller's own). The chosen map is taken, numbers are
    scaled (image and maps to [0, 1], the field to its dynamic range), parts of the displaced map dropped (`keep`: the share
    that stays, None: all), colours changed, everything turned about the centre, cut to `out` (the field to `out_field`), the image
    shifted to [-1, 1], and rows flipped. Examples without a truth vertex in the inner square are left out. A record is
    read once and needs nothing but itself, so no step shuffles.

    The result has the ids and `image`, `gt_polygon_map`, `disp_polygon_map` (out x out x channels) and `disp_field_map`, of type `kind`.
    """
    owner = [c for c in ("image_id", "ds_fac", "patch_id", "fold") if c in records.columns]
    choices = ["map_id", "turn", "flip", "brightness", "contrast", "saturation"]
    source = ["image", "gt_polygon_map", "disp_polygon_maps", "disp_field_maps"]
    made = ["image", "gt_polygon_map", "disp_polygon_map", "disp_field_map"]
    wide, narrow = math.ceil(out * math.sqrt(2)), math.ceil(out_field * math.sqrt(2))
    margin = (out - out_field) // 2

    def one(row: dict) -> list[np.ndarray] | None:
        res, n, turn = row["tile_res"], row["disp_map_count"], row["turn"]
        at = row["map_id"]
        image = np.frombuffer(row["image"], "u1").reshape(res, res, bands) / 255.0
        truth = np.frombuffer(row["gt_polygon_map"], "u1").reshape(res, res, 3) / 255.0
        moved = np.frombuffer(row["disp_polygon_maps"], "u1").reshape(n, res, res, 3)[at] / 255.0
        field = np.frombuffer(row["disp_field_maps"], "<i2").reshape(n, res, res, 2)[at] * dynamic_range / 32767.0
        if keep is not None:
            ids = [int(row[c]) for c in owner if c != "fold"]
            moved = arrays.without_parts(moved, keep, np.random.default_rng([seed, *(i & 0xFFFFFFFF for i in ids)]))
        image = arrays.recoloured(image, row["brightness"], row["contrast"], row["saturation"])
        # Channels that are read alike are turned together: their places are worked out once.
        whole = arrays.centred(np.dstack([image, truth[..., :2], moved[..., :2], truth[..., 2:], moved[..., 2:]]), wide)
        smooth = arrays.turned(whole[..., : bands + 4], turn)
        sharp = arrays.turned(whole[..., bands + 4 :], turn, nearest=True)
        whole = arrays.centred(np.dstack([smooth, sharp]), out)
        image, truth, moved = (whole[..., at] for at in (slice(bands), [bands, bands + 1, bands + 4], [bands + 2, bands + 3, bands + 5]))
        field = arrays.turned(arrays.centred(field, narrow), turn)
        cos, sin = math.cos(-turn), math.sin(-turn)
        field = np.dstack([field[..., 0] * cos + field[..., 1] * sin, field[..., 1] * cos - field[..., 0] * sin])
        field = arrays.centred(field, out_field)
        image = np.clip(image * 2 - 1, -1.0, 1.0)
        if row["flip"]:
            image, truth, moved, field = (x[::-1] for x in (image, truth, moved, field))
            field = field * np.array([-1.0, 1.0])
        if not truth[margin : margin + out_field, margin : margin + out_field, 2].any():
            return None
        return [image, truth, moved, field]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                part = batch.slice(start, 16)
                found = [(n, one(row)) for n, row in enumerate(part.to_pylist())]
                found = [(n, x) for n, x in found if x is not None]
                ids = [part.column(n).take(pa.array([f[0] for f in found], pa.int32())) for n in range(len(owner))]
                data = [pa.array([np.ascontiguousarray(x[m], dtype=kind).tobytes() for _, x in found], pa.binary()) for m in range(len(made))]
                yield pa.RecordBatch.from_arrays([*ids, *data], [*owner, *made])

    shape = ", ".join([f"{c} {records.schema[c].dataType.simpleString()}" for c in owner] + [f"{c} binary" for c in made])
    return records.select(*owner, "tile_res", "disp_map_count", *choices, *source).mapInArrow(run, shape)


def write_patches(tables: dict[str, DataFrame], path: str, per_shard: int = 100, max_abs: float = 4.0, levels: Sequence[int] = ()) -> None:
    """Store the patch tables, the patch list in shards with its metadata sidecar."""
    metadata = {"disp_max_abs_value": max_abs, "downsampling_factors": list(levels)}
    write_sharded(tables["patches"], f"{path}/patches", per_shard, metadata=metadata)
    for name, df in tables.items():
        if name != "patches":
            write_sharded(df, f"{path}/{name}", 1_000_000, by=("ds_fac", "image_id"))


def augment_examples(
    pixels: DataFrame, cells: DataFrame, field: DataFrame, height: int, width: int, out: int, out_field: int, seed: int = 0,
    keep: float = 0.1, turn: Column | None = None,
) -> dict[str, DataFrame]:
    """Examples (one image_id each) after component dropping, colour changes, rotation, cropping and flips.

    `cells(image_id, layer, i, j, value)` in [0, 1] is the displaced map, `field`
    is dequantised. The result holds `pixels`, `cells`, `field` of the examples
    that keep a vertex in the inner square.
    """
    ids = pixels.select("image_id").distinct()
    dropped = drop_components(cells, ["image_id"], keep, seed, height, width)
    coloured = photometric(pixels, photometric_params(ids, seed))
    draw = turn if turn is not None else uniform(seed + 11, F.col("image_id")) * 2 * F.pi()
    turned_pixels = rotate_cells(coloured, ["image_id", "band"], draw, height, width)
    smooth = rotate_cells(dropped.where(F.col("layer") != "vertex"), ["image_id", "layer"], draw, height, width)
    sharp = rotate_cells(dropped.where(F.col("layer") == "vertex"), ["image_id", "layer"], draw, height, width, nearest=True)
    turned_cells = smooth.unionByName(sharp)
    spun = rotate_vectors(rotate_cells(field, ["image_id"], draw, height, width, values=("di", "dj")), draw)
    cut_pixels = centre_crop_pad(turned_pixels, height, width, out, out)
    cut_cells = centre_crop_pad(turned_cells, height, width, out, out)
    cut_field = centre_crop_pad(spun, height, width, out_field, out_field)
    flips = uniform(seed + 13, F.col("image_id")) >= 0.5

    def flip(df: DataFrame, size: int) -> DataFrame:
        return df.withColumn("i", F.when(flips, size - 1 - F.col("i")).otherwise(F.col("i")))

    margin = (out - out_field) // 2
    inner = F.col("i").between(margin, margin + out_field - 1) & F.col("j").between(margin, margin + out_field - 1)
    alive = cut_cells.where((F.col("layer") == "vertex") & inner & (F.col("value") > 0)).select("image_id").distinct()
    flipped_field = flip(cut_field, out_field).withColumn("di", F.when(flips, -F.col("di")).otherwise(F.col("di")))
    tables = {"pixels": flip(cut_pixels, out), "cells": flip(cut_cells, out), "field": flipped_field}
    return {name: df.join(alive, "image_id", "left_semi") for name, df in tables.items()}
