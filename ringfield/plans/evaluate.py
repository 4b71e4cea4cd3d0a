"""Displace, align, measure: the experiments as plans over all images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.operators.fields import displace_polygons
from ringfield.operators.geometry import at_positions, at_truth_positions, explode_ring, kept_positions, shells
from ringfield.operators.metrics import (
    ALIGN_THRESHOLDS,
    IOU_THRESHOLDS,
    curve_bands,
    curve_summary,
    mask_iou_curve,
    truth_rings,
    vertex_accuracy,
)
from ringfield.operators.raster import rasterize
from ringfield.plans.align import LEVELS, multires_align
from ringfield.plans.predict import predict_patches, predicted_cells


def make_test_displacements(
    polygons: DataFrame, field: DataFrame, height, width, max_abs: float = 32.0, thresholds: Sequence[float] = ALIGN_THRESHOLDS
) -> tuple[DataFrame, DataFrame]:
    """(displaced vertices, baseline accuracy at whole thresholds) for fields normalised to [-1, 1]."""
    displaced = displace_polygons(explode_ring(polygons), field, height, width, max_abs)
    whole = [t for t in thresholds if t == int(t)]
    return displaced, vertex_accuracy(explode_ring(truth_rings(polygons)), displaced, whole, stripped=True)


def evaluate_alignment(
    gt: DataFrame, images: DataFrame, fields: dict[int, DataFrame], displaced: DataFrame | None = None,
    disp_field: DataFrame | None = None, disp_shape: tuple | None = None, max_abs: float = 32.0,
    levels: Sequence[int] = LEVELS, thresholds: Sequence[float] = ALIGN_THRESHOLDS, tolerance: float = 1.0, **settings,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(curves, bands, summary) after aligning displaced copies of `gt`.

    The copies come as rings (`displaced`), or are made from `disp_field`, one
    per map. Without either, `gt` itself is aligned and measured against its
    start, which is the case without a separate truth. Holes go and rings are
    simplified; the truth decides which vertices stay, and every copy keeps
    those, so that vertices are still met by their number.
    """
    kept = kept_positions(shells(gt), tolerance)
    whole = at_positions(kept)
    truth = explode_ring(truth_rings(whole))
    if displaced is not None:
        start = explode_ring(at_truth_positions(displaced, kept))
    elif disp_field is not None and disp_shape is not None:
        start = displace_polygons(explode_ring(whole), disp_field, *disp_shape, max_abs)
    else:
        start = explode_ring(whole)
    aligned = multires_align(start, images, fields, levels, **settings)
    curves = vertex_accuracy(truth, aligned, thresholds, stripped=True)
    bands = curve_bands(curves)
    return curves, bands, curve_summary(bands)


def detect_new(
    pixels: DataFrame, gt: DataFrame, images: DataFrame, model_fn, thresholds: Sequence[float] = IOU_THRESHOLDS,
    input_res: int = 220, output_res: int = 100, bands: int = 3,
) -> DataFrame:
    """IoU curve per image of a prediction made without any input polygons.

    Runs at the finest level: `images` and `gt` are in its pixels.
    """
    spark = pixels.sparkSession
    empty = spark.createDataFrame([], "image_id long, layer string, i int, j int, value double")
    prediction = predict_patches(pixels, empty, images, model_fn, input_res, output_res, bands)
    margin = (input_res - output_res) // 2
    sized = gt.join(images.select("image_id", "height", "width"), "image_id").select("image_id", "height", "width", "ring")
    truth = rasterize(sized, F.col("height"), F.col("width"))
    crop = images.select("image_id", "height", "width")
    inside = F.col("i").between(margin, F.col("height") - margin - 1) & F.col("j").between(margin, F.col("width") - margin - 1)
    kept = truth.where(inside).select("image_id", "i", "j")
    seg = predicted_cells(prediction, margin).join(crop, "image_id").where(inside)
    return mask_iou_curve(seg, kept, ["image_id"], thresholds, margin=0)
