"""Patch grids and the joins between polygons and patches.

Range conditions become equality on nodes of an adaptive tile index (`quadtree`),
so Spark shuffles by node and never compares a polygon with every patch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfield.functions import rings
from ringfield.operators.geometry import vertex_in_box
from ringfield.operators.quadtree import Things, box_tiles, bucket, home, near_join, ring_tiles
from ringfield.operators.skew import HOT_ROWS, shuffled


def axis_count(length: Column, stride: int, res: int) -> Column:
    """Patches along one axis."""
    return F.greatest(F.lit(1), F.ceil((length - F.lit(res - stride)) / F.lit(stride))).cast("int")


def patch_grid(images: DataFrame, stride: int, res: int) -> DataFrame:
    """Patches of size `res`; the last of each axis ends at the image edge (it may start below zero)."""
    rows, cols = axis_count(F.col("height"), stride, res), axis_count(F.col("width"), stride, res)
    keys = [c for c in ("image_id", "ds_fac", "fold") if c in images.columns]
    grid = (
        images.select(*keys, "height", "width", rows.alias("n_rows"), cols.alias("n_cols"))
        .withColumn("pi", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
        .withColumn("pj", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    )

    def start(index: str, count: str, length: str) -> Column:
        last = F.col(index) == F.col(count) - 1
        return F.when(last, F.col(length) - res).otherwise(F.col(index) * stride).cast("int")

    patch_id = (F.col("pi") * F.col("n_cols") + F.col("pj")).cast("int")
    r0, c0 = start("pi", "n_rows", "height"), start("pj", "n_cols", "width")
    return grid.select(
        *keys, patch_id.alias("patch_id"), r0.alias("r0"), c0.alias("c0"), (r0 + res).alias("r1"), (c0 + res).alias("c1")
    )


def rotated_patch_size(stride: int, res: int) -> tuple[int, int]:
    """(stride, res) for patches that stay covered after any rotation."""
    return math.floor(stride * math.sqrt(2) / 2), math.ceil(res * math.sqrt(2))


def explode_buckets(boxes: DataFrame, size: float) -> DataFrame:
    """One row per tile bucket (bi, bj) that the box r0, c0, r1, c1 reaches."""
    rows = F.sequence(bucket(F.col("r0"), size), bucket(F.col("r1"), size))
    cols = F.sequence(bucket(F.col("c0"), size), bucket(F.col("c1"), size))
    return boxes.withColumn("bi", F.explode(rows)).withColumn("bj", F.explode(cols))


def _patch_things(patches: DataFrame) -> Things:
    extent = F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")).cast("double")
    return Things(patches, box_tiles("r0", "c0", "r1", "c1"), extent, ["patch_id"])


def polygons_touching_patches(
    polygons: DataFrame, patches: DataFrame, size: float = 256, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every (polygon, patch) where at least one vertex lies in the patch, bounds included.

    A polygon is sent once to each tile that holds one of its vertices. A pair is
    reported in the one node with the first vertex that lies in the patch, so no
    `distinct` follows. The ring comes back relative to the patch.
    """
    other = [c for c in patches.columns if c not in ("image_id", "r0", "c0", "r1", "c1")]
    b = rings.box(F.col("ring"))
    sent = polygons.withColumn("b", b)

    def inside(p: Column) -> Column:
        return vertex_in_box(p["i"], p["j"], F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))

    near = (F.col("b.r1") >= F.col("r0")) & (F.col("b.r0") <= F.col("r1"))
    near = near & (F.col("b.c1") >= F.col("c0")) & (F.col("b.c0") <= F.col("c1"))
    first = F.get(F.filter("ring", inside), F.lit(0))
    # No vertex in the patch: null, which is no match.
    condition = near & home(size, first["i"], first["j"])
    points = Things(sent, ring_tiles("ring"), F.lit(0.0), ["poly_id"])
    kept = near_join(points, _patch_things(patches), ["image_id"], condition, size=size, most=hot_rows)
    moved = rings.shift(F.col("ring"), -F.col("r0"), -F.col("c0"))
    columns = [*polygons.columns, *other, "r0", "c0", "r1", "c1"]
    return kept.withColumn("ring", moved).select(*columns)


def polygons_within_box(polygons: DataFrame, r0, c0, r1, c1) -> DataFrame:
    """Polygons all of whose vertices lie in the box, bounds included."""
    return polygons.where(F.forall("ring", lambda p: vertex_in_box(p["i"], p["j"], r0, c0, r1, c1)))


def polygons_within_patches(
    polygons: DataFrame, patches: DataFrame, size: float = 256, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every (polygon, patch) where the whole ring lies in the patch.

    The tile of the first vertex is enough: a patch that holds the ring reaches it.
    """
    first = F.get("ring", F.lit(0))

    def start(side: float) -> Column:
        return F.array(F.struct(bucket(first["i"], side).alias("bi"), bucket(first["j"], side).alias("bj")))

    box = (F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))
    # The first vertex goes first, as it needs no loop.
    condition = vertex_in_box(first["i"], first["j"], *box) & F.forall("ring", lambda p: vertex_in_box(p["i"], p["j"], *box))
    points = Things(polygons, start, F.lit(0.0), ["poly_id"])
    kept = near_join(points, _patch_things(patches), ["image_id"], condition, size=size, most=hot_rows)
    return kept.drop("lv", "bi", "bj")


def inner_patches(patches: DataFrame, inner_res: int) -> DataFrame:
    """Shrink each patch to its central square; slices are exclusive at the far side."""
    margin = F.floor((F.col("r1") - F.col("r0") - inner_res) / 2).cast("int")
    return patches.withColumn("m", margin).selectExpr(
        *[c for c in patches.columns if c not in ("r0", "c0", "r1", "c1")],
        "r0 + m AS r0", "c0 + m AS c0", "r1 - m AS r1", "c1 - m AS c1",
    )


def keep_patches_with_vertices(
    patches: DataFrame, vertex_cells: DataFrame, inner_res: int, size: float = 128
) -> DataFrame:
    """Patches whose central square holds at least one vertex cell.

    Cells are made distinct first, so piled-up copies of a vertex count once,
    and the semi join then needs no salting: a bucket holds at most size^2 cells.
    """
    keys = [c for c in ("image_id", "ds_fac") if c in patches.columns and c in vertex_cells.columns]
    points = vertex_cells.select(*keys, "i", "j").distinct()
    points = points.withColumns({"bi": bucket(F.col("i"), size), "bj": bucket(F.col("j"), size)})
    inner = inner_patches(patches, inner_res)
    reach = explode_buckets(inner, size).alias("p")
    same = [F.col(f"p.{c}") == F.col(f"v.{c}") for c in [*keys, "bi", "bj"]]
    inside = (
        (F.col("v.i") >= F.col("p.r0")) & (F.col("v.i") < F.col("p.r1"))
        & (F.col("v.j") >= F.col("p.c0")) & (F.col("v.j") < F.col("p.c1"))
    )
    condition = inside
    for equal in same:
        condition = condition & equal
    hit = reach.join(shuffled(points).alias("v"), condition, "left_semi").select(*keys, "patch_id").distinct()
    return patches.join(shuffled(hit), [*keys, "patch_id"], "left_semi")
