"""Coarse-to-fine alignment with given displacement fields, and rounds of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.functions.numeric import half_even
from ringfield.operators.fields import apply_field
from ringfield.operators.geometry import (
    at_truth_positions,
    clean_polygons,
    collect_rings,
    explode_ring,
    kept_positions,
    level_factor,
    shells,
)
from ringfield.operators.metrics import channel_stretch, coverage_check
from ringfield.operators.raster import rasterize
from ringfield.plans.predict import INPUT_RES, OUTPUT_RES, ModelFn, predict_patches
from ringfield.sources.catalog import load_round, save_round
from ringfield.session import cut_lineage
from ringfield.sources.writers import write_features

# Levels of the published experiments, coarse first.
LEVELS = (8, 4, 2, 1)
REFERENCE_PIXELSIZE = 0.3


def level_shape(images: DataFrame, ds_fac: int, reference: float, margin: int) -> DataFrame:
    """Adds the level's factor and size, and (fh, fw), the size of the field it carries."""
    factor = level_factor(ds_fac, F.col("pixelsize"), reference)
    sized = images.withColumn("factor", factor).withColumns(
        {"lh": half_even(F.col("height") / F.col("factor")).cast("int"), "lw": half_even(F.col("width") / F.col("factor")).cast("int")}
    )
    return sized.withColumns({"fh": F.col("lh") - 2 * margin, "fw": F.col("lw") - 2 * margin})


def mark_border(field: DataFrame, shape: DataFrame) -> DataFrame:
    """Flags the cells vertices are clipped to: the border of each image's field.

    A field shared by all images carries the borders of every size in use.
    """
    low = (F.col("i") == 0) | (F.col("j") == 0)
    if "image_id" in field.columns:
        sized = field.join(shape.select("image_id", "fh", "fw"), "image_id")
        high = (F.col("i") == F.col("fh") - 1) | (F.col("j") == F.col("fw") - 1)
        return sized.withColumn("border", low | high).drop("fh", "fw")
    marks = {}
    for axis, size in (("i", "fh"), ("j", "fw")):
        marks[axis] = shape.select((F.col(size) - 1).alias(axis)).distinct().withColumn(f"last_{axis}", F.lit(True))
    flagged = field.join(marks["i"], "i", "left").join(marks["j"], "j", "left")
    high = F.coalesce("last_i", F.lit(False)) | F.coalesce("last_j", F.lit(False))
    return flagged.withColumn("border", low | high).drop("last_i", "last_j")


def align_level(
    vertices: DataFrame, images: DataFrame, field: DataFrame, ds_fac: int,
    reference: float = REFERENCE_PIXELSIZE, input_res: int = INPUT_RES, output_res: int = OUTPUT_RES,
) -> DataFrame:
    """One level: scale down, move into the field's frame, add the field, move back, scale up.

    Images smaller than the network input at this level keep their vertices.
    """
    margin = (input_res - output_res) // 2
    shape = level_shape(images, ds_fac, reference, margin).select("image_id", "factor", "lh", "lw", "fh", "fw")
    placed = vertices.join(shape, "image_id").withColumns(
        {"i0": F.col("i"), "j0": F.col("j"), "fits": (F.col("lh") >= input_res) & (F.col("lw") >= input_res)}
    )
    local = placed.withColumns({c: F.col(c) / F.col("factor") - margin for c in ("i", "j")})
    vectors = mark_border(field, shape)
    moved = apply_field(local, vectors, "fh", "fw", where=F.col("fits"))
    back = {c: F.when(F.col("fits"), (F.col(c) + margin) * F.col("factor")).otherwise(F.col(f"{c}0")) for c in ("i", "j")}
    return moved.withColumns(back).select(*vertices.columns)


def multires_align(
    vertices: DataFrame, images: DataFrame, fields: dict[int, DataFrame], levels: Sequence[int] = LEVELS,
    reference: float = REFERENCE_PIXELSIZE, input_res: int = INPUT_RES, output_res: int = OUTPUT_RES,
) -> DataFrame:
    """All levels in order; `fields` maps a level to field(image_id?, i, j, di, dj) in pixels of that level."""
    for ds_fac in levels:
        if ds_fac in fields:
            vertices = align_level(vertices, images, fields[ds_fac], ds_fac, reference, input_res, output_res)
    return vertices


def predict_and_align(
    polygons: DataFrame, images: DataFrame, level_pixels: Callable[[int], DataFrame], model_for: Callable[[int], ModelFn],
    levels: Sequence[int] = LEVELS, reference: float = REFERENCE_PIXELSIZE,
    input_res: int = INPUT_RES, output_res: int = OUTPUT_RES, max_abs: float = 4.0,
) -> DataFrame:
    """Alignment with a model: every level draws the current polygons, predicts a field and applies it.

    `level_pixels(ds_fac)` gives the pixels at that level. The vertices are
    checkpointed after each level, so that no model runs twice.
    """
    keys = [c for c in polygons.columns if c != "ring"]
    vertices = explode_ring(polygons)
    margin = (input_res - output_res) // 2
    for ds_fac in levels:
        shape = level_shape(images, ds_fac, reference, margin).select("image_id", "factor", F.col("lh").alias("height"), F.col("lw").alias("width"))
        small = vertices.join(shape, "image_id").withColumns({c: F.col(c) / F.col("factor") for c in ("i", "j")})
        drawn = collect_rings(small, "image_id", "poly_id", "height", "width")
        cells = rasterize(drawn, F.col("height"), F.col("width"))
        field = predict_patches(level_pixels(ds_fac), cells, shape, model_for(ds_fac), input_res, output_res, max_abs=max_abs)
        vertices = align_level(
            vertices, images, field.select("image_id", "i", "j", "di", "dj"), ds_fac, reference, input_res, output_res
        )
        vertices = cut_lineage(vertices)
    return collect_rings(vertices, *keys)


def align_round(
    spark: SparkSession, path: str, source: str, next_source: str, images: DataFrame, fields: dict[int, DataFrame],
    levels: Sequence[int] = LEVELS, tolerance: float = 1.0, truth: str | None = None, **settings,
) -> DataFrame | None:
    """Clean and align one stored polygon version and store it as the next; None when it does not exist.

    Holes go and rings are simplified at `tolerance`. With `truth`, another stored version, its rings decide which vertices
    stay, so that rounds can be measured against it by vertex number; otherwise each ring decides for itself.
    """
    rows = load_round(spark, path, source)
    if rows is None:
        return None
    if truth is None:
        cleaned = clean_polygons(rows, tolerance=tolerance)
    else:
        known = load_round(spark, path, truth)
        if known is None:
            raise ValueError(f"{path} holds no version {truth}")
        cleaned = at_truth_positions(rows, kept_positions(shells(known), tolerance))
    keys = [c for c in cleaned.columns if c not in ("ring", "source")]
    aligned = multires_align(explode_ring(cleaned.drop("source")), images, fields, levels, **settings)
    save_round(collect_rings(aligned, *keys), path, next_source)
    return load_round(spark, path, next_source)


def align_user_image(
    pixels: DataFrame, polygons: DataFrame, images: DataFrame, fields: dict[int, DataFrame], out: str | None = None,
    levels: Sequence[int] = LEVELS, **settings,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stretch the image, check that the polygons lie on it, align them and save: (pixels, report, polygons).

    Images whose polygons miss them entirely are reported and left out.
    """
    stretched = channel_stretch(pixels, 3.0)
    report = coverage_check(polygons, images)
    covered = polygons.join(report.where("covered").select("image_id"), "image_id", "left_semi")
    keys = [c for c in polygons.columns if c != "ring"]
    vertices = multires_align(explode_ring(covered), images, fields, levels, **settings)
    aligned = collect_rings(vertices, *keys)
    if out is not None:
        write_features(aligned, images, out)
    return stretched, report, aligned

