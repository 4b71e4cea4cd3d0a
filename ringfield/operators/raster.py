"""Sparse raster cells: drawing, cropping, filtering, resampling, augmentation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringfield.functions import rings
from ringfield.functions.numeric import half_even, uniform
from ringfield.operators.components import connected_components, cycle_order
from ringfield.operators.geometry import settled
from ringfield.operators.skew import shuffled
from ringfield.session import cut_lineage

# ---------------------------------------------------------------- drawing

# A cell centre this close to a slanted side counts as lying on it.
ON_LINE = 1e-9
# Image rows that are drawn together.
BAND = 256
# The same for whole polygons, which are many on small images.
POLYGON_BAND = 64


def _int_rows(low: Column, high: Column) -> Column:
    """Integers in [low, high] as an array, possibly empty."""
    first, last = F.ceil(low).cast("int"), F.floor(high).cast("int")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def fill_spans(polygons: DataFrame, rows: tuple[Column, Column] | None = None) -> DataFrame:
    """Runs of cells whose centre lies in the closed polygon: (keys, i, a, b), both ends included; runs may overlap.

    `rows` are the first and last image row asked for; others are not made.

    Rows of a ring are exploded, its edges are crossed with the row, and the
    sorted crossings are paired into spans. A row through a vertex is crossed
    twice, with the edges ending above and those ending below, so that the
    boundary is included on every side.
    """
    keys = [c for c in polygons.columns if c != "ring"]
    polygons = settled(polygons)
    edge = F.transform(
        F.filter(rings.ring_edges(F.col("ring")), lambda e: e["i1"] != e["i2"]),
        lambda e: F.struct(
            F.least(e["i1"], e["i2"]).alias("lo"),
            F.greatest(e["i1"], e["i2"]).alias("hi"),
            F.when(e["i1"] < e["i2"], e["j1"]).otherwise(e["j2"]).alias("at"),
            ((e["j2"] - e["j1"]) / (e["i2"] - e["i1"])).alias("slope"),
        ),
    )
    boxed = polygons.select(*keys, edge.alias("e"), rings.box(F.col("ring")).alias("b"))
    low, high = F.col("b.r0"), F.col("b.r1")
    if rows is not None:
        low, high = F.greatest(low, rows[0]), F.least(high, rows[1])
    reached = boxed.select(*keys, "e", F.explode(_int_rows(low, high)).alias("i"))
    i = F.col("i")

    def crossings(chosen: Column) -> Column:
        return F.array_sort(F.transform(chosen, lambda e: e["at"] + e["slope"] * (i - e["lo"])))

    below = F.filter("e", lambda e: (e["lo"] <= i) & (i < e["hi"]))
    above = F.filter("e", lambda e: (e["lo"] < i) & (i <= e["hi"]))
    through = F.exists("e", lambda e: (e["lo"] == i) | (e["hi"] == i))
    sides = F.when(through, F.array(crossings(below), crossings(above))).otherwise(F.array(crossings(below)))
    crossed = reached.select(*keys, "i", F.explode(sides).alias("x")).where(F.size("x") > 1)
    starts = F.sequence(F.lit(0), F.size("x") - 2, F.lit(2))
    spans = F.transform(starts, lambda n: F.struct(F.get("x", n).alias("a"), F.get("x", n + 1).alias("b")))
    spanned = crossed.select(*keys, "i", F.explode(spans).alias("s"))
    first, last = F.ceil(F.col("s.a") - ON_LINE).cast("int"), F.floor(F.col("s.b") + ON_LINE).cast("int")
    return spanned.select(*keys, "i", first.alias("a"), last.alias("b")).where(F.col("a") <= F.col("b"))


def fill_cells(polygons: DataFrame) -> DataFrame:
    """Cells whose centre lies in the closed polygon: (keys, i, j), duplicates possible."""
    spans = fill_spans(polygons)
    keys = [c for c in spans.columns if c not in ("a", "b")]
    return spans.select(*keys, F.explode(F.sequence("a", "b")).alias("j"))


def merged_spans(spans: DataFrame, height: int | Column, width: int | Column) -> DataFrame:
    """Cells (keys, i, j) of runs (keys, i, a, b) inside the image, each once.

    Of runs that begin in the same cell the longest is kept, before the shuffle where it can be, so an image row holds no
    more runs than cells, however many polygons lie there. In order, each run gives the cells beyond those before it; only then are runs exploded.
    """
    keys = [c for c in spans.columns if c not in ("i", "a", "b")]
    inside = spans.withColumns({"a": F.greatest("a", F.lit(0)), "b": F.least("b", F.lit(width) - 1 if isinstance(width, int) else width - 1)})
    inside = inside.where((F.col("i") >= 0) & (F.col("i") < height) & (F.col("a") <= F.col("b")))
    limits = [c for c in ("height", "width") if c in keys]
    longest = inside.groupBy(*keys, "i", "a").agg(F.max("b").alias("b"))
    row = W.partitionBy(*[k for k in keys if k not in limits], "i").orderBy("a").rowsBetween(W.unboundedPreceding, -1)
    first = F.greatest(F.col("a"), F.coalesce(F.max("b").over(row), F.lit(-1)) + 1)
    fresh = longest.withColumn("a", first).where(F.col("a") <= F.col("b"))
    return fresh.select(*keys, "i", F.explode(F.sequence("a", "b")).alias("j"))


def _drawn_in_bands(
    shapes: DataFrame, keys: list[str], low: Column, high: Column, spans: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Cells (keys, i, j) of the runs that `spans` makes of shapes lying in the rows from `low` to `high`, each once.

    Shapes travel, not cells: each goes once to every band of rows it reaches, where its runs are made, merged and exploded.
    """
    bands = F.sequence(F.floor(low / BAND), F.floor(high / BAND))
    placed = shapes.withColumn("_band", F.explode(bands))
    # A stated number of partitions is not merged by AQE, which sees the size of the shapes only.
    tasks = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = spans(placed.repartition(tasks, *keys, "_band")).where(F.floor(F.col("i") / BAND) == F.col("_band"))
    row = W.partitionBy(*keys, "_band", "i").orderBy("a").rowsBetween(W.unboundedPreceding, -1)
    first = F.greatest(F.col("a"), F.max("b").over(row) + 1)
    fresh = inside.withColumn("a", first).where(F.col("a") <= F.col("b"))
    return fresh.select(*keys, "i", F.explode(F.sequence("a", "b")).alias("j"))


def line_cells(edge_rows: DataFrame, width: int = 3) -> DataFrame:
    """Cells of straight lines: one per step of the longer axis, widened across it."""
    keys = [c for c in edge_rows.columns if c not in ("i1", "j1", "i2", "j2", "k")]
    ends = {c: half_even(F.col(c)) for c in ("i1", "j1", "i2", "j2")}
    lines = edge_rows.select(*keys, *[v.alias(c) for c, v in ends.items()])
    di, dj = F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1")
    steps = F.greatest(F.abs(di), F.abs(dj))
    by_row = F.abs(di) >= F.abs(dj)
    walked = lines.select(
        *keys, "i1", "j1", di.alias("di"), dj.alias("dj"), by_row.alias("by_row"), steps.alias("steps"),
        F.explode(F.sequence(F.lit(0), steps.cast("int"))).alias("t"),
    )
    share = F.when(F.col("steps") > 0, F.col("t") / F.nullif("steps", F.lit(0.0))).otherwise(0.0)
    half = (width - 1) // 2
    offset = F.explode(F.array(*[F.lit(n) for n in range(-half, width - half)])).alias("o")
    centre = walked.select(
        *keys, "by_row", offset,
        half_even(F.col("i1") + F.col("di") * share).cast("int").alias("i"),
        half_even(F.col("j1") + F.col("dj") * share).cast("int").alias("j"),
    )
    return centre.select(
        *keys,
        F.when(F.col("by_row"), F.col("i")).otherwise(F.col("i") + F.col("o")).alias("i"),
        F.when(F.col("by_row"), F.col("j") + F.col("o")).otherwise(F.col("j")).alias("j"),
    )


def line_spans(edge_rows: DataFrame, width: int = 3, rows: tuple[Column, Column] | None = None) -> DataFrame:
    """The cells of `line_cells` as runs (keys, i, a, b); a line along a row is one run for each row of its width.

    `rows` are the first and last image row asked for; lines are walked there only, others are not returned.
    """
    keys = [c for c in edge_rows.columns if c not in ("i1", "j1", "i2", "j2", "k")]
    ends = {c: half_even(F.col(c)) for c in ("i1", "j1", "i2", "j2")}
    lines = edge_rows.select(*keys, *[v.cast("int").alias(c) for c, v in ends.items()])
    if rows is not None:
        # Lines between the same cells have the same runs: of many small polygons most are alike.
        lines = lines.distinct()
    half = (width - 1) // 2
    di, dj = F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1")
    steps = F.greatest(F.abs(di), F.abs(dj))
    level = (di == 0) & (dj != 0)
    walk = F.sequence(F.lit(0), F.when(level, F.lit(0)).otherwise(steps))
    if rows is not None:
        # The steps that come near these rows, of one too many at either end; runs elsewhere are dropped below.
        ends = [steps * (r - F.col("i1")) / F.nullif(di, F.lit(0)) for r in (rows[0] - width - 1, rows[1] + width + 1)]
        first, last = F.greatest(F.floor(F.least(*ends)) - 1, F.lit(0)), F.least(F.ceil(F.greatest(*ends)) + 1, steps)
        part = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
        walk = F.when(di != 0, part).otherwise(walk)
    # A row for each step: evaluated in lambdas this costs several times as much.
    walked = lines.select(
        *keys, "i1", "j1", "j2", di.alias("di"), dj.alias("dj"), steps.alias("steps"), level.alias("_level"),
        (F.abs(di) >= F.abs(dj)).alias("by_row"), F.explode(walk).alias("t"),
    )
    share = F.when(F.col("steps") > 0, F.col("t") / F.nullif("steps", F.lit(0))).otherwise(0.0)
    i, j = half_even(F.col("i1") + F.col("di") * share).cast("int"), half_even(F.col("j1") + F.col("dj") * share).cast("int")
    # Widened across the longer axis: a run in a steep line's row, or single cells above and below a flat line's.
    across = F.when(F.col("by_row"), F.array(F.lit(0))).otherwise(F.array(*[F.lit(o) for o in range(-half, width - half)]))
    centre = walked.select(
        *keys, "j1", "j2", "_level", "by_row", i.alias("i"), j.alias("j"), F.explode(across).alias("o")
    )
    first = F.when(F.col("_level"), F.least("j1", "j2")).when(F.col("by_row"), F.col("j") - half).otherwise(F.col("j"))
    last = F.when(F.col("_level"), F.greatest("j1", "j2")).when(F.col("by_row"), F.col("j") + (width - half - 1)).otherwise(F.col("j"))
    runs = centre.select(*keys, (F.col("i") + F.col("o")).alias("i"), first.alias("a"), last.alias("b"))
    return runs if rows is None else runs.where(F.col("i").between(*rows))


def drawn_edges(polygons: DataFrame, closed: bool = False) -> DataFrame:
    """Edges to draw: consecutive vertices only, as rings repeat their first vertex; `closed` adds the last side."""
    keys = [c for c in polygons.columns if c != "ring"]
    drawn = F.filter(rings.ring_edges(F.col("ring")), lambda e: F.lit(closed) | (e["k"] < F.size("ring") - 1))
    return polygons.select(*keys, F.explode(drawn).alias("e")).select(*keys, "e.i1", "e.j1", "e.i2", "e.j2")


def rasterize(
    polygons: DataFrame,
    height: int | Column,
    width: int | Column,
    layers: tuple[str, ...] = ("fill", "edge", "vertex"),
    line_width: int = 3,
    closed: bool = False,
    value: float = 255.0,
) -> DataFrame:
    """(keys, layer, i, j, value): the union of all polygons per key and layer.

    `polygons` carries the grouping keys and `ring`. Polygons are shuffled to bands of image rows and drawn there as runs of
    cells, which are merged in place; a task holds no more runs than cells. Cells come into being at the end.
    """
    keys = [c for c in polygons.columns if c not in ("ring", "poly_id", "part")]
    shells = settled(polygons.select(*keys, rings.cut_at_nan(F.col("ring")).alias("ring"))).where(F.size("ring") > 0)
    levels = F.transform("ring", lambda p: p["i"])
    margin = line_width // 2 + 1 if "edge" in layers else 1
    low = F.greatest(F.array_min(levels) - margin, F.lit(0.0))
    high = F.least(F.array_max(levels) + margin, (F.lit(height) if isinstance(height, int) else height) - 1)
    # Far sides of `least` and `greatest` pass over nulls: a ring without places, or an image without height, is not drawn.
    seen = F.array_min(levels).isNotNull() & (low <= high) & (F.lit(height) > 0 if isinstance(height, int) else height > 0)
    bands = F.sequence(F.floor(low / POLYGON_BAND), F.floor(high / POLYGON_BAND))
    # The place to draw is one generated column, as Catalyst would drop constant keys from what is grouped below and shuffle once more.
    by = [k for k in keys if k not in ("height", "width")]
    spots = F.transform(bands, lambda b: F.struct(b.alias("band"), F.xxhash64(*by, b).alias("spot")))
    placed = shells.where(seen).withColumn("_at", F.explode(spots))
    # A stated number of partitions is not merged by AQE, which sees the size of the polygons only.
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [*keys, "_band", "_spot"]
    dealt = placed.select(*keys, "ring", F.col("_at.band").alias("_band"), F.col("_at.spot").alias("_spot")).repartition(tasks, "_spot")
    rows = (F.col("_band") * POLYGON_BAND).cast("int"), (F.col("_band") * POLYGON_BAND + (POLYGON_BAND - 1)).cast("int")
    parts: list[DataFrame] = []
    if "fill" in layers:
        parts.append(fill_spans(dealt, rows).select(*own, F.lit("fill").alias("layer"), "i", "a", "b"))
    if "edge" in layers:
        lines = line_spans(drawn_edges(dealt, closed), line_width, rows)
        parts.append(lines.select(*own, F.lit("edge").alias("layer"), "i", "a", "b"))
    if "vertex" in layers:
        points = dealt.select(*own, F.explode("ring").alias("p"))
        i, j = (half_even(F.col(f"p.{c}")).cast("int") for c in ("i", "j"))
        dots = points.select(*own, F.lit("vertex").alias("layer"), i.alias("i"), j.alias("a"), j.alias("b"))
        parts.append(dots.where(F.col("i").between(*rows)))
    # Merged layer by layer, as a union would have to be shuffled again.
    merged = [merged_spans(part, height, width) for part in parts]
    cells = merged[0]
    for part in merged[1:]:
        cells = cells.unionByName(part)
    return cells.select(*keys, "layer", "i", "j", F.lit(float(value)).alias("value"))


def rasterize_lines(edge_rows: DataFrame, width: int = 1, blur: tuple[int, float] | None = None) -> DataFrame:
    """Line cells with value 1, blurred on request with (radius, std)."""
    keys = [c for c in edge_rows.columns if c not in ("i1", "j1", "i2", "j2", "k")]
    low, high = F.least("i1", "i2") - width, F.greatest("i1", "i2") + width
    drawn = _drawn_in_bands(edge_rows.drop("k"), keys, low, high, lambda lines: line_spans(lines, width))
    drawn = drawn.withColumn("value", F.lit(1.0))
    return blur_cells(drawn, keys, *blur) if blur else drawn


def rasterize_triangles(triangles: DataFrame, blur: tuple[int, float] | None = None) -> DataFrame:
    """Filled triangles with value 1; `triangles` carries `ring` with three vertices."""
    keys = [c for c in triangles.columns if c != "ring"]
    box = rings.box(F.col("ring"))
    drawn = _drawn_in_bands(settled(triangles), keys, box["r0"], box["r1"], fill_spans).withColumn("value", F.lit(1.0))
    return blur_cells(drawn, keys, *blur) if blur else drawn


def cells_in_patches(cells: DataFrame, patches: DataFrame, size: float = 128) -> DataFrame:
    """Cells of every patch that holds them, far side exclusive, with the position inside the patch.

    A cell has one bucket and a bucket holds at most size^2 cells per layer, so the join cannot be skewed.
    """
    from ringfield.operators.tiles import bucket, explode_buckets

    keys = [c for c in ("image_id", "ds_fac") if c in patches.columns and c in cells.columns]
    reach = explode_buckets(patches, size).select(*keys, "patch_id", "r0", "c0", "r1", "c1", "bi", "bj")
    placed = cells.withColumns({"bi": bucket(F.col("i"), size), "bj": bucket(F.col("j"), size)})
    joined = placed.join(shuffled(reach), [*keys, "bi", "bj"])
    inside = (
        (F.col("i") >= F.col("r0")) & (F.col("i") < F.col("r1")) & (F.col("j") >= F.col("c0")) & (F.col("j") < F.col("c1"))
    )
    kept = joined.where(inside)
    local = {"pi": (F.col("i") - F.col("r0")).cast("int"), "pj": (F.col("j") - F.col("c0")).cast("int")}
    return kept.withColumns(local).drop("bi", "bj", "r0", "c0", "r1", "c1")


# ---------------------------------------------------------------- cropping and scaling


def crop_pad(cells: DataFrame, box: tuple[int, int, int, int], height: int, width: int) -> DataFrame:
    """Cells of a box, moved to its space; where the box leaves the image the padding is shared by both sides.

    The result is sparse: padded cells are absent.
    """
    r0, c0, r1, c1 = box
    rows, cols = max(0, -r0) + max(0, r1 - height), max(0, -c0) + max(0, c1 - width)
    top, left = max(0, r0), max(0, c0)
    inside = (
        (F.col("i") >= top) & (F.col("i") < min(height, r1)) & (F.col("j") >= left) & (F.col("j") < min(width, c1))
    )
    moved = {"i": F.col("i") - top + rows // 2, "j": F.col("j") - left + cols // 2}
    return cells.where(inside).withColumns({c: v.cast("int") for c, v in moved.items()})


def centre_crop_pad(cells: DataFrame, height: int, width: int, out_height: int, out_width: int) -> DataFrame:
    """Central crop or centred zero padding to a size."""

    def offset(size: int, out: int) -> int:
        return (size - out) // 2 if size >= out else -((out - size) // 2)

    moved = cells.withColumns(
        {
            "i": (F.col("i") - offset(height, out_height)).cast("int"),
            "j": (F.col("j") - offset(width, out_width)).cast("int"),
        }
    )
    return moved.where(F.col("i").between(0, out_height - 1) & F.col("j").between(0, out_width - 1))


def densify(cells: DataFrame, groups: DataFrame, height: int, width: int, value: str = "value") -> DataFrame:
    """Full grid for every group, absent cells as 0."""
    keys = groups.columns
    grid = groups.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    )
    return grid.join(shuffled(cells), [*keys, "i", "j"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def downsample(cells: DataFrame, factor: int, keys: list[str], values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Block mean for an integer factor (dense input). Other factors go through `fields.resample`."""
    blocks = cells.withColumns({c: F.floor(F.col(c) / factor).cast("int") for c in ("i", "j")})
    return blocks.groupBy(*keys, "i", "j").agg(*[F.avg(v).alias(v) for v in values])


# ---------------------------------------------------------------- neighbourhoods


def _offsets(low: int, high: int) -> Column:
    """All (oi, oj) with both in [low, high], as one exploded column."""
    span = [F.struct(F.lit(a).alias("oi"), F.lit(b).alias("oj")) for a in range(low, high + 1) for b in range(low, high + 1)]
    return F.explode(F.array(*span))


def dilate(cells: DataFrame, keys: list[str], size: int = 3, height: int | None = None, width: int | None = None) -> DataFrame:
    """Largest value in the size x size neighbourhood; cells outside the image are cut when its size is given."""
    low = -(size // 2)
    sent = cells.select(*keys, "i", "j", "value", _offsets(low, low + size - 1).alias("o")).select(
        *keys, (F.col("i") + F.col("o.oi")).alias("i"), (F.col("j") + F.col("o.oj")).alias("j"), "value"
    )
    if height is not None and width is not None:
        sent = sent.where(F.col("i").between(0, height - 1) & F.col("j").between(0, width - 1))
    return sent.groupBy(*keys, "i", "j").agg(F.max("value").alias("value"))


def gaussian_kernel(radius: int, std: float) -> list[float]:
    """Normalised weights for offsets -radius..radius."""
    raw = [math.exp(-(n * n) / (2 * std * std)) for n in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def blur_cells(cells: DataFrame, keys: list[str], radius: int, std: float) -> DataFrame:
    """Gaussian blur as two one-dimensional passes; zero outside."""
    weights = gaussian_kernel(radius, std)
    taps = F.explode(
        F.array(*[F.struct(F.lit(n - radius).alias("o"), F.lit(w).alias("w")) for n, w in enumerate(weights)])
    )
    for axis, other in (("i", "j"), ("j", "i")):
        sent = cells.select(*keys, axis, other, "value", taps.alias("t"))
        moved = (F.col(axis) + F.col("t.o")).cast("int").alias(axis)
        cells = (
            sent.select(*keys, moved, other, (F.col("value") * F.col("t.w")).alias("value"))
            .groupBy(*keys, axis, other)
            .agg(F.sum("value").alias("value"))
        )
    return cells.select(*keys, "i", "j", "value")


# ---------------------------------------------------------------- components


def cell_components(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, label) for 4-connected cells; the label is the smallest packed position."""
    ids = cells.select(*keys, F.expr("shiftleft(CAST(i AS BIGINT), 32) + j").alias("id"))
    near = F.array(F.col("id") + 1, F.col("id") + (1 << 32))
    asked = ids.select(*keys, F.col("id").alias("a"), F.explode(near).alias("b"))
    links = asked.join(shuffled(ids.withColumnRenamed("id", "b")), [*keys, "b"], "left_semi")
    labels = connected_components(ids, links, keys)
    return labels.select(
        *keys, F.expr("CAST(shiftright(id, 32) AS INT)").alias("i"), F.expr("CAST(id & 4294967295 AS INT)").alias("j"), "label"
    )


def drop_components(
    cells: DataFrame, keys: list[str], keep: float, seed: int = 0, height: int | None = None, width: int | None = None
) -> DataFrame:
    """Keep each connected part of the fill layer with a probability, and all layers under it (grown by one cell)."""
    if keep >= 1:
        return cells
    if keep <= 0:
        return cells.where(F.lit(False))
    labels = cell_components(cells.where((F.col("layer") == "fill") & (F.col("value") > 0)), keys)
    drawn = uniform(seed, *[F.col(k) for k in keys], F.col("label"))
    kept = labels.where(drawn < F.lit(float(keep))).withColumn("value", F.lit(1.0))
    mask = dilate(kept, keys, 3, height, width).select(*keys, "i", "j")
    return cells.join(shuffled(mask), [*keys, "i", "j"], "left_semi")


# ---------------------------------------------------------------- rotation and flips


def rotate_cells(
    cells: DataFrame, keys: list[str], angle, height: int, width: int, nearest: bool = False, values: tuple[str, ...] = ("value",)
) -> DataFrame:
    """Rotate about the image centre by `angle` (a number or a column of the rows), zero outside.

    Each source cell is sent to the few targets around its image, which then
    weigh it by the distance of their own inverse image: bilinear, or the
    nearest cell alone.
    """
    a = angle if isinstance(angle, Column) else F.lit(float(angle))
    mi, mj = (height - 1) / 2, (width - 1) / 2
    carried = cells.withColumn("_angle", a)
    cos, sin = F.cos("_angle"), F.sin("_angle")
    y, x = F.col("i") - mi, F.col("j") - mj
    ti, tj = F.floor(mi + y * cos - x * sin), F.floor(mj + y * sin + x * cos)
    sent = carried.withColumns({"_ti": ti, "_tj": tj}).withColumn("_o", _offsets(-1, 2))
    target = sent.withColumns(
        {"_ti": (F.col("_ti") + F.col("_o.oi")).cast("int"), "_tj": (F.col("_tj") + F.col("_o.oj")).cast("int")}
    ).where(F.col("_ti").between(0, height - 1) & F.col("_tj").between(0, width - 1))
    ty, tx = F.col("_ti") - mi, F.col("_tj") - mj
    back_i, back_j = mi + ty * cos + tx * sin, mj - ty * sin + tx * cos
    if nearest:
        weight = ((half_even(back_i) == F.col("i")) & (half_even(back_j) == F.col("j"))).cast("double")
    else:
        near_i = F.greatest(F.lit(0.0), 1.0 - F.abs(back_i - F.col("i")))
        weight = near_i * F.greatest(F.lit(0.0), 1.0 - F.abs(back_j - F.col("j")))
    weighed = target.withColumn("_w", weight).where(F.col("_w") > 0)
    sums = [F.sum(F.col(v) * F.col("_w")).alias(v) for v in values]
    return weighed.groupBy(*keys, F.col("_ti").alias("i"), F.col("_tj").alias("j")).agg(*sums)


def flip_cells(cells: DataFrame, height: int | Column) -> DataFrame:
    """Rows reversed."""
    return cells.withColumn("i", (F.lit(height) - 1 - F.col("i")).cast("int"))


# ---------------------------------------------------------------- pixels


def photometric_params(images: DataFrame, seed: int) -> DataFrame:
    """Random brightness shift, contrast and saturation factors per image."""
    draw = [uniform(seed + n, F.col("image_id")) for n in range(3)]
    return images.select(
        "image_id",
        (draw[0] * 0.5 - 0.25).alias("brightness"),
        (draw[1] * 0.4 + 0.8).alias("contrast"),
        (draw[2] * 0.4 + 0.8).alias("saturation"),
    )


def photometric(pixels: DataFrame, params: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Bytes to [0, 1], brightness, contrast about the band mean, saturation, then to [low, high] with clipping.

    Saturation is scaled in hue-saturation-value space: value and hue stay, so
    each channel moves towards the largest one, limited where saturation reaches 1.
    """
    unit = pixels.withColumn("value", F.col("value") / 255.0).join(params, "image_id")
    bright = unit.withColumn("value", F.col("value") + F.col("brightness"))
    means = bright.groupBy("image_id", "band").agg(F.avg("value").alias("_mean"))
    contrasted = bright.join(means, ["image_id", "band"]).withColumn(
        "value", (F.col("value") - F.col("_mean")) * F.col("contrast") + F.col("_mean")
    )
    # The bands of a cell meet in one row: one shuffle, no join.
    cell = contrasted.groupBy("image_id", "i", "j").agg(
        F.max("value").alias("_top"), F.min("value").alias("_low"), F.first("saturation").alias("saturation"),
        F.collect_list(F.struct("band", "value")).alias("_b"),
    )
    joined = cell.select("image_id", "i", "j", "_top", "_low", "saturation", F.explode("_b").alias("_b")).select("*", "_b.band", "_b.value")
    strength = F.when(F.col("_top") > 0, (F.col("_top") - F.col("_low")) / F.nullif("_top", F.lit(0.0))).otherwise(0.0)
    factor = F.least(F.col("saturation"), 1.0 / F.nullif(strength, F.lit(0.0)))
    value = F.col("_top") - (F.col("_top") - F.col("value")) * F.coalesce(factor, F.lit(1.0))
    scaled = value * F.lit(high - low) + F.lit(low)
    clipped = F.least(F.greatest(scaled, F.lit(low)), F.lit(high))
    return joined.select("image_id", "band", "i", "j", clipped.alias("value"))


def apply_alpha(pixels: DataFrame, images: DataFrame, cities: list[str]) -> DataFrame:
    """Drop the fourth band; in the listed cities multiply the others by it first (bytes, half to even)."""
    rest = [c for c in pixels.columns if c not in ("image_id", "i", "j")]
    # The bands of a cell meet in one row: one shuffle, no self join.
    cell = pixels.groupBy("image_id", "i", "j").agg(
        F.max(F.when(F.col("band") == 3, F.col("value"))).alias("_alpha"), F.collect_list(F.struct(*rest)).alias("_b")
    )
    colour = cell.select("image_id", "i", "j", "_alpha", F.explode("_b").alias("_b")).select("image_id", "i", "j", "_alpha", "_b.*").where(F.col("band") < 3)
    named = colour.join(images.select("image_id", "city"), "image_id")
    masked = half_even(F.col("value") / 255.0 * (F.col("_alpha") / 255.0) * 255.0)
    use = F.col("city").isin(cities) & F.col("_alpha").isNotNull()
    return named.withColumn("value", F.when(use, masked).otherwise(F.col("value"))).drop("_alpha", "city")


# ---------------------------------------------------------------- outlines


def mask_boundary(cells: DataFrame, keys: list[str], height: int | None = None, width: int | None = None) -> DataFrame:
    """Unit sides between a mask cell and an empty one, directed with the mask on the right.

    Sides run between cell corners: (i1, j1) to (i2, j2).
    """
    sides = [
        # neighbour offset, then the directed side in corner offsets
        (-1, 0, 0, 0, 0, 1),
        (0, 1, 0, 1, 1, 1),
        (1, 0, 1, 1, 1, 0),
        (0, -1, 1, 0, 0, 0),
    ]
    names = ("ni", "nj", "a", "b", "c", "d")
    around = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in sides]))
    asked = cells.select(*keys, "i", "j", around.alias("s")).select(
        *keys,
        (F.col("i") + F.col("s.ni")).alias("i"), (F.col("j") + F.col("s.nj")).alias("j"),
        (F.col("i") + F.col("s.a")).alias("i1"), (F.col("j") + F.col("s.b")).alias("j1"),
        (F.col("i") + F.col("s.c")).alias("i2"), (F.col("j") + F.col("s.d")).alias("j2"),
    )
    bare = asked.join(shuffled(cells.select(*keys, "i", "j")), [*keys, "i", "j"], "left_anti")
    return bare.select(*keys, "i1", "j1", "i2", "j2")


def boundary_rings(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Closed outlines of a mask: (keys, start, ring, outer), corners of straight runs left out.

    Every directed side points to the side it continues with (at a pinched
    corner the one turning right, so that 4-connected parts stay apart). Sides
    find their outline and their place in it by pointer doubling; only the
    corners of an outline, which are its record in the result, are gathered.
    """
    sides = mask_boundary(cells, keys)
    packed = "shiftleft(CAST({i} AS BIGINT), 32) + {j}"
    named = sides.select(
        *keys, "i1", "j1", "i2", "j2",
        F.expr(packed.format(i="i1", j="j1")).alias("tail"), F.expr(packed.format(i="i2", j="j2")).alias("head"),
        (F.col("i2") - F.col("i1")).alias("ui"), (F.col("j2") - F.col("j1")).alias("uj"),
    )
    # Four directions make a side's id unique: its tail and where it points.
    heading = F.when(F.col("uj") == 1, 0).when(F.col("ui") == 1, 1).when(F.col("uj") == -1, 2).otherwise(3)
    numbered = named.withColumn("id", F.col("tail") * 4 + heading).withColumn("heading", heading)
    nexts = numbered.select(*keys, F.col("tail").alias("head"), F.col("id").alias("next"), F.col("heading").alias("to"))
    joined = numbered.join(shuffled(nexts), [*keys, "head"])
    turn = F.pmod(F.col("to") - F.col("heading") + 3, F.lit(4))  # right turn 0, straight 3, left 2
    order = F.when(turn == 0, 0).when(turn == 3, 1).otherwise(2)
    followed = joined.groupBy(*keys, "id", "heading", "i2", "j2").agg(F.min_by(F.struct("next", "to"), order).alias("n"))
    followed = cut_lineage(followed.select(*keys, "id", "i2", "j2", (F.col("heading") != F.col("n.to")).alias("bends"), F.col("n.next").alias("next")))
    placed = cycle_order(followed, keys)
    # A side gives the point it ends in, which is where the next side starts: the outline's first side is reached with one step left.
    corners = followed.where("bends").select(*keys, "id", "i2", "j2").join(shuffled(placed), [*keys, "id"])
    point = rings.point(F.col("i2").cast("double"), F.col("j2").cast("double"))
    turn_by = F.struct((F.col("ahead") != 1).alias("late"), (F.col("ahead") != 0).alias("later"), (-F.col("ahead")).alias("at"), point.alias("p"))
    gathered = corners.groupBy(*keys, F.col("label").alias("start")).agg(F.sort_array(F.collect_list(turn_by)).alias("o"))
    drawn = settled(gathered.select(*keys, "start", F.transform("o", lambda o: o["p"]).alias("ring")))
    return drawn.withColumn("outer", ~rings.is_clockwise(F.col("ring")))
