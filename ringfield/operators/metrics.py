"""Alignment, segmentation and height measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfield.functions import rings
from ringfield.functions.numeric import count_below, frange
from ringfield.operators.geometry import settled
from ringfield.operators.skew import shuffled

# The thresholds of the published experiments.
ALIGN_THRESHOLDS = frange(0, 16.25, 0.25)
ROUND_THRESHOLDS = frange(0, 32.25, 0.25)
IOU_THRESHOLDS = frange(0, 1.01, 0.01)
# Loss weights of the published configuration.
DISP_WEIGHTS = {"fill": 0.1, "edge": 1.0, "vertex": 10.0}
SEG_WEIGHTS = {"bg": 0.05, "fill": 0.1, "edge": 1.0, "vertex": 10.0}
LOSS_WEIGHTS = {"displacement": 100.0, "segmentation": 50.0, "laplacian": 0.0}
TINY = 1e-7

# ---------------------------------------------------------------- vertex distance


def _identity(gt: DataFrame, pred: DataFrame, *more: str) -> list[str]:
    """What names a ring: image, polygon and, where both tables have it, the part."""
    part = ["part"] if "part" in gt.columns and "part" in pred.columns else []
    return ["image_id", "poly_id", *part, *more]


def match_vertices(gt: DataFrame, pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Vertices of two tables met by identity (image, polygon, part, k), never by row position."""
    keys = keys or _identity(gt, pred, "k")
    extra = [c for c in ("source", "map_id") if c in pred.columns and c not in keys]
    truth = gt.select(*keys, F.col("i").alias("gi"), F.col("j").alias("gj"))
    moved = pred.select(*keys, *extra, F.col("i").alias("pi"), F.col("j").alias("pj"))
    return truth.join(shuffled(moved), keys)


def without_closing(vertices: DataFrame, keys: list[str], eps: float = 1e-3) -> DataFrame:
    """Vertex rows without the last vertex of rings whose last vertex repeats the first (L1 distance below eps).

    Rings that end at a NaN separator end before it.
    """
    numbers = ~F.isnan("i") & ~F.isnan("j")
    point = F.struct("i", "j")
    stop = F.min(F.when(~numbers, F.col("k"))).alias("stop")
    plain = vertices.join(shuffled(vertices.groupBy(*keys).agg(stop)), keys).where(F.coalesce(F.col("k") < F.col("stop"), F.lit(True))).drop("stop")
    ends = plain.groupBy(*keys).agg(F.min_by(point, "k").alias("f"), F.max_by(point, "k").alias("l"), F.max("k").alias("k"), F.min("k").alias("k0"))
    gap = F.abs(F.col("f.i") - F.col("l.i")) + F.abs(F.col("f.j") - F.col("l.j"))
    closing = ends.where((gap < eps) & (F.col("k") > F.col("k0"))).select(*keys, "k")
    return plain.join(shuffled(closing), [*keys, "k"], "left_anti")


def truth_rings(gt: DataFrame, eps: float = 1e-3) -> DataFrame:
    """Rings as the truth is measured: up to a NaN separator, without a repeated closing vertex."""
    return settled(settled(gt.withColumn("ring", rings.cut_at_nan(F.col("ring")))).withColumn("ring", rings.strip_closing(F.col("ring"), eps)))


def _distances(ring: Column, other: Column) -> Column:
    count = F.least(F.size(ring), F.size(other))
    pairs = F.zip_with(F.slice(ring, F.lit(1), count), F.slice(other, F.lit(1), count), rings.distance)
    return pairs


def matched_rings(gt: DataFrame, pred: DataFrame, keys: list[str] | None = None, eps: float | None = 1e-3) -> DataFrame:
    """One row per polygon with the array `d` of vertex distances.

    Rings end at a NaN separator; a repeated closing vertex of the truth (L1
    distance below eps) is left out of both. Vertex distances need one join per
    polygon this way, not one per vertex.
    """
    keys = keys or _identity(gt, pred)
    extra = [c for c in ("source", "map_id") if c in pred.columns and c not in keys]
    truth = settled(gt.select(*keys, rings.cut_at_nan(F.col("ring")).alias("g")), "g")
    if eps is not None:
        truth = settled(truth.withColumn("g", rings.strip_closing(F.col("g"), eps)), "g")
    moved = pred.select(*keys, *extra, F.col("ring").alias("p"))
    joined = truth.where(F.size("g") > 0).join(moved, keys)
    return settled(joined.select(*keys, *extra, _distances(F.col("g"), F.col("p")).alias("d")), "d")


def distance_summary(gt: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """Smallest, mean and largest vertex distance; NaN vertices are ignored."""
    d = matched_rings(gt, pred, eps=None).select(*by, F.explode_outer("d").alias("d")).where(~F.isnan("d"))
    return d.groupBy(*by).agg(F.min("d").alias("min_d"), F.avg("d").alias("mean_d"), F.max("d").alias("max_d"))


def threshold_cross(distances: DataFrame, thresholds: Sequence[float], integers_only: bool = False) -> DataFrame:
    """One row per distance and threshold that reaches it.

    The thresholds are a literal array filtered before it is exploded. Curves do
    not need this expansion, see `threshold_accuracy`.
    """
    chosen = [t for t in thresholds if not integers_only or t == int(t)]
    literal = F.array(*[F.lit(float(t)) for t in chosen])
    return distances.withColumn("threshold", F.explode(F.filter(literal, lambda t: F.col("d") <= t)))


def accuracy_curve(distances: DataFrame, by: list[str], thresholds: Sequence[float]) -> DataFrame:
    """Share of rows with `d <= threshold` per group and threshold: (by, threshold, value, n).

    A histogram over "how many thresholds are too small" shuffles a few rows per
    group and task; the curve is its running sum.
    """
    grid = [float(t) for t in thresholds]
    counted = distances.select(*by, count_below(F.col("d"), grid).alias("b")).groupBy(*by, "b").agg(
        F.count(F.lit(1)).alias("n")
    )
    # At most one entry per threshold and group from here on.
    hist = counted.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("h"), F.sum("n").alias("total")
    )
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(grid) - 1)), lambda b: F.coalesce(F.try_element_at("h", b), F.lit(0)))
    sums = settled(hist.select(*by, "total", running_sum(counts).alias("s")), "s")
    points = sums.select(*by, "s", "total", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("pos", "threshold"))
    hits = F.get("s", F.col("pos"))
    return points.select(*by, "threshold", (hits / F.col("total")).alias("value"), F.col("total").alias("n"))


def running_sum(counts: Column) -> Column:
    """Prefix sums of an array of counts, which has one entry per threshold."""
    grown = F.aggregate(
        counts, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )
    return F.slice(grown, F.lit(2), F.size(counts))


def threshold_accuracy(
    gt: DataFrame, pred: DataFrame, thresholds: Sequence[float] = ALIGN_THRESHOLDS,
    by: list[str] | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """Accuracy curves from two ring tables, per image (and source and map where present)."""
    matched = matched_rings(gt, pred, keys)
    by = by or [c for c in ("source", "image_id", "map_id") if c in matched.columns]
    distances = matched.select(*by, F.explode_outer("d").alias("d")).where(~F.isnan("d"))
    return accuracy_curve(distances, by, thresholds)


def vertex_accuracy(
    gt: DataFrame, pred: DataFrame, thresholds: Sequence[float] = ALIGN_THRESHOLDS, by: list[str] | None = None,
    stripped: bool = False,
) -> DataFrame:
    """Accuracy curves from vertex tables (the form pipelines on fields produce).

    As with rings, a repeated closing vertex of the truth and what follows a NaN separator are left out of both sides.
    `stripped` says that `gt` comes without them (from `truth_rings`), which saves the look at the ends of each ring.
    """
    if not stripped:
        gt = without_closing(gt, [c for c in ("image_id", "poly_id", "part") if c in gt.columns])
    matched = match_vertices(gt, pred)
    by = by or [c for c in ("source", "image_id", "map_id") if c in matched.columns]
    di, dj = F.col("gi") - F.col("pi"), F.col("gj") - F.col("pj")
    distances = matched.select(*by, F.sqrt(di * di + dj * dj).alias("d")).where(~F.isnan("d"))
    return accuracy_curve(distances, by, thresholds)


# ---------------------------------------------------------------- masks


def mask_iou_curve(
    pred: DataFrame, gt: DataFrame, by: list[str], thresholds: Sequence[float] = IOU_THRESHOLDS,
    margin: int = 60, height=None, width=None,
) -> DataFrame:
    """IoU of `threshold < prediction` against the truth mask: (by, threshold, inter, uni, iou).

    `pred(by, i, j, value)` and `gt(by, i, j)` may hold several layers of a cell;
    the largest counts. Cells within `margin` of the image border are left out.
    The IoU is null where the union is empty.
    """
    keys = [*by, "i", "j"]
    p = pred.groupBy(*keys).agg(F.max("value").alias("p"))
    g = gt.select(*keys).distinct().withColumn("g", F.lit(1))
    cells = p.join(g, keys, "full_outer")
    if margin:
        if height is None or width is None:
            raise ValueError("a margin needs the image size")
        cells = cells.where(
            F.col("i").between(margin, F.lit(height) - margin - 1) & F.col("j").between(margin, F.lit(width) - margin - 1)
        )
    grid = [float(t) for t in thresholds]
    level = F.coalesce(count_below(F.col("p"), grid), F.lit(0))
    truth = F.coalesce("g", F.lit(0))
    counted = cells.select(*by, level.alias("b"), truth.alias("g")).groupBy(*by, "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum("g").alias("g")
    )
    hist = counted.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("b", F.struct("n", "g")))).alias("h"), F.sum("g").alias("total")
    )
    places = F.sequence(F.lit(0), F.lit(len(grid)))
    dense = {f: F.transform(places, _bin_reader(f)) for f in ("n", "g")}
    sums = settled(
        hist.select(*by, "total", F.struct(*[running_sum(c).alias(f) for f, c in dense.items()]).alias("s")), "s"
    )
    points = sums.select(*by, "s", "total", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("pos", "threshold"))

    def above(f: str) -> Column:
        return F.get(F.col(f"s.{f}"), F.lit(len(grid))) - F.get(F.col(f"s.{f}"), F.col("pos"))

    inter = above("g")
    union = F.col("total") + above("n") - above("g")
    iou = F.when(union > 0, inter / F.nullif(union, F.lit(0)))
    return points.select(*by, "threshold", inter.alias("inter"), union.alias("uni"), iou.alias("iou"))


def _bin_reader(name: str):
    return lambda b: F.coalesce(F.try_element_at("h", b)[name], F.lit(0))


# ---------------------------------------------------------------- curves


def curve_bands(curves: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Over images: smallest, mean, largest value and population deviation per threshold."""
    return curves.groupBy(*(by or []), "threshold").agg(
        F.min("value").alias("low"), F.avg("value").alias("mean"), F.max("value").alias("high"),
        F.stddev_pop("value").alias("deviation"),
    )


def curve_summary(bands: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the mean curve (trapezoids), its largest and its middle value.

    One curve has as many points as there are thresholds, so it is gathered whole.
    """
    by = by or []
    whole = bands.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("threshold", "mean"))).alias("c"))
    c = F.col("c")
    steps = F.sequence(F.lit(0), F.size(c) - 2)
    area = F.aggregate(
        F.when(F.size(c) > 1, steps).otherwise(F.array().cast("array<int>")), F.lit(0.0),
        lambda t, n: t
        + (F.get(c, n + 1)["threshold"] - F.get(c, n)["threshold"]) * (F.get(c, n + 1)["mean"] + F.get(c, n)["mean"]) / 2,
    )
    middle = F.get(c, F.floor(F.size(c) / 2).cast("int"))["mean"]
    peak = F.array_max(F.transform(c, lambda p: p["mean"]))
    return whole.select(*by, area.alias("area"), peak.alias("peak"), middle.alias("middle"))


def round_report(
    perfect: DataFrame, versions: DataFrame, order: Sequence[str], thresholds: Sequence[float] = ROUND_THRESHOLDS
) -> DataFrame:
    """Accuracy curves of every polygon version against the hand-aligned one.

    Both are oriented clockwise first. `order` lists the versions; for each
    image, those after the first missing one are left out.
    """
    ordered = F.array(*[F.lit(s) for s in order])
    have = versions.select("image_id", "source").distinct().groupBy("image_id").agg(F.collect_set("source").alias("have"))
    present = F.transform(ordered, lambda s: F.array_contains("have", s))
    gap = F.array_position(present, False)
    usable = F.when(gap == 0, ordered).otherwise(F.slice(ordered, F.lit(1), (gap - 1).cast("int")))
    kept = have.select("image_id", F.explode(usable).alias("source"))
    chosen = versions.join(kept, ["image_id", "source"], "left_semi")
    truth = perfect.withColumn("ring", rings.orient(F.col("ring")))
    moved = chosen.withColumn("ring", rings.orient(F.col("ring")))
    return threshold_accuracy(truth, moved, thresholds, ["source", "image_id"])


# ---------------------------------------------------------------- heights


def view_pairs(views: DataFrame, ordered: bool = False) -> DataFrame:
    """Combinations of views, or all ordered pairs."""
    a = views.select(*[F.col(c).alias(f"{c}_1") for c in views.columns])
    b = views.select(*[F.col(c).alias(f"{c}_2") for c in views.columns])
    one, two = F.col("view_id_1"), F.col("view_id_2")
    return a.join(b, one != two if ordered else one < two)


def building_heights(
    views: DataFrame, angles: dict[str, float] | dict[str, tuple[int, float]], pixelsize: float, factor: float = 1.0
) -> DataFrame:
    """Mean over view pairs of centre distance x tan a tan b / (tan b - tan a) x pixelsize / factor.

    `views(view_id, image_id, poly_id, ring)`; `angles` gives the elevation of
    each view as its tangent. The few views of a building meet in one group, and
    all pairs are formed from that array without a self join.
    """
    mean = rings.centre(F.col("ring"))
    tangent = F.element_at(F.create_map(*[x for v, t in angles.items() for x in (F.lit(v), F.lit(float(t)))]), F.col("view_id"))
    seen = views.select("image_id", "poly_id", F.struct(F.col("view_id"), tangent.alias("t"), mean.alias("c")).alias("v"))
    grouped = seen.groupBy("image_id", "poly_id").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    vs = F.col("vs")

    def height(a: Column, b: Column) -> Column:
        low, high = F.least(a["t"], b["t"]), F.greatest(a["t"], b["t"])
        return rings.distance(a["c"], b["c"]) * (low * high / (high - low)) * F.lit(float(pixelsize))

    pairs = F.flatten(
        F.transform(vs, lambda a: F.transform(F.filter(vs, lambda b: a["view_id"] < b["view_id"]), lambda b: height(a, b)))
    )
    summed = F.aggregate("h", F.lit(0.0), lambda t, h: t + h) / F.size("h") / F.lit(float(factor))
    return grouped.select("image_id", "poly_id", pairs.alias("h")).select(
        "image_id", "poly_id", summed.alias("height"), F.size("h").alias("pairs")
    )


def height_error(heights: DataFrame, gt: DataFrame) -> DataFrame:
    """One row: mean truth, mean prediction, mean absolute difference."""
    joined = heights.join(gt, ["image_id", "poly_id"])
    gap = F.abs(F.col("gt_height") - F.col("height"))
    return joined.agg(
        F.avg("gt_height").alias("mean_gt"), F.avg("height").alias("mean_pred"), F.avg(gap).alias("mean_diff"),
        F.count(F.lit(1)).alias("n"),
    )


def area_height_pairs(heights: DataFrame, gt: DataFrame, polygons: DataFrame, pixelsize: float) -> DataFrame:
    """(image_id, poly_id, area in square metres, height difference)."""
    square = rings.area(F.col("ring")) * F.lit(pixelsize * pixelsize)
    sized = polygons.select("image_id", "poly_id", square.alias("area"))
    joined = heights.join(gt, ["image_id", "poly_id"]).join(sized, ["image_id", "poly_id"])
    return joined.select("image_id", "poly_id", "area", F.abs(F.col("gt_height") - F.col("height")).alias("diff"))


def histogram(df: DataFrame, value: str, bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """Equal bins between the extremes, the last one closed: (by, bin, lo, hi, n); empty bins are listed."""
    by = by or []
    ends = df.groupBy(*by).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    edged = ends.withColumn("_step", (F.col("_max") - F.col("_min")) / bins)
    if by:
        joined = df.select(*by, value).join(edged, by)
    else:
        # A single row of extremes: the only broadcast, and its size is fixed.
        joined = df.select(value).join(F.broadcast(edged), F.lit(True))
    spread = F.nullif("_step", F.lit(0.0))
    slot = F.coalesce(F.floor((F.col(value) - F.col("_min")) / spread), F.lit(0))
    bin_ = F.least(F.greatest(slot, F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = joined.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = edged.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    lo, hi = F.col("_min") + F.col("bin") * F.col("_step"), F.col("_min") + (F.col("bin") + 1) * F.col("_step")
    listed = grid.join(counted, [*by, "bin"], "left")
    return listed.select(*by, "bin", lo.alias("lo"), hi.alias("hi"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# ---------------------------------------------------------------- pixels and coverage


def channel_stretch(pixels: DataFrame, k: float = 3.0) -> DataFrame:
    """Clip to bytes, then stretch mean +/- k deviations of each band to [0, 255] and clip again."""
    clipped = pixels.withColumn("value", _byte(F.col("value")))
    stats = clipped.groupBy("image_id", "band").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    joined = clipped.join(stats, ["image_id", "band"])
    low, high = F.col("_m") - k * F.col("_s"), F.col("_m") + k * F.col("_s")
    stretched = (F.col("value") - low) / F.nullif(high - low, F.lit(0.0)) * 255.0
    return joined.withColumn("value", _byte(stretched)).drop("_m", "_s")


def _byte(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(255.0)), F.lit(0.0)))


def z_score(pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or ["image_id"]
    stats = pixels.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    score = (F.col("value") - F.col("_m")) / F.nullif("_s", F.lit(0.0))
    return pixels.join(stats, by).withColumn("value", score).drop("_m", "_s")


def coverage_check(polygons: DataFrame, images: DataFrame) -> DataFrame:
    """Per image: polygon count, extent, and whether the extent meets the image."""
    b = rings.box(F.col("ring"))
    extent = polygons.select("image_id", b.alias("b")).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("b.r0").alias("min_i"), F.min("b.c0").alias("min_j"),
        F.max("b.r1").alias("max_i"), F.max("b.c1").alias("max_j"),
    )
    apart = (
        (F.col("max_i") < 0) | (F.col("height") < F.col("min_i")) | (F.col("max_j") < 0) | (F.col("width") < F.col("min_j"))
    )
    joined = images.select("image_id", "height", "width").join(extent, "image_id", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return joined.select("image_id", n.alias("n"), "min_i", "min_j", "max_i", "max_j", F.coalesce(~apart, F.lit(False)).alias("covered"))


# ---------------------------------------------------------------- training losses


def displacement_error(
    gt: DataFrame, pred: DataFrame | None, cells: DataFrame, weights: dict[str, float] = DISP_WEIGHTS
) -> DataFrame:
    """Weighted squared error and weight sum per image and level: (image_id, level, error, weight).

    A cell weighs coefficient / (cells of its layer in the image), summed over
    its layers; `pred=None` is the zero prediction. `loss` over all images is
    sum(error x level coefficient) / (sum(weight) + tiny).
    """
    coef = F.create_map(*[x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))])
    layers = cells.where(F.col("layer").isin(*weights))
    sizes = layers.groupBy("image_id", "layer").agg(F.sum("value").alias("_n"))
    share = F.col("value") * coef[F.col("layer")] / (F.col("_n") + F.lit(TINY))
    weight = layers.join(sizes, ["image_id", "layer"]).groupBy("image_id", "i", "j").agg(F.sum(share).alias("w"))
    truth = gt.select("image_id", "i", "j", F.col("di").alias("gi"), F.col("dj").alias("gj"))
    masked = truth.join(shuffled(weight), ["image_id", "i", "j"])
    if pred is None:
        compared = masked.withColumns({"level": F.lit(0), "di": F.lit(0.0), "dj": F.lit(0.0)})
    else:
        levels = pred if "level" in pred.columns else pred.withColumn("level", F.lit(0))
        compared = masked.join(shuffled(levels.select("image_id", "level", "i", "j", "di", "dj")), ["image_id", "i", "j"])
    di, dj = F.col("gi") - F.col("di"), F.col("gj") - F.col("dj")
    return compared.groupBy("image_id", "level").agg(
        F.sum((di * di + dj * dj) * F.col("w")).alias("error"), F.sum("w").alias("weight")
    )


def displacement_loss(errors: DataFrame, level_coefs: Sequence[float] = (1.0,)) -> DataFrame:
    """One row: the loss over a batch of images. The weight mask counts once, not once per level."""
    coef = F.element_at(F.array(*[F.lit(float(c)) for c in level_coefs]), F.col("level") + 1)
    weight = F.sum(F.when(F.col("level") == 0, F.col("weight")).otherwise(0.0)) + F.lit(TINY)
    return errors.agg((F.sum(F.col("error") * coef) / weight).alias("loss"))


def segmentation_error(
    gt: DataFrame, logits: DataFrame, weights: dict[str, float] = SEG_WEIGHTS, level_coefs: Sequence[float] = (1.0,)
) -> DataFrame:
    """Mean weighted sigmoid cross entropy per image: (image_id, error).

    `gt(image_id, i, j, layer, value)` is sparse; `logits(image_id, level, i, j,
    layer, x)` is dense and includes the background layer, whose truth is the
    product of one minus the other layers.
    """
    products = gt.groupBy("image_id", "i", "j").agg(
        *[F.coalesce(F.max(F.when(F.col("layer") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in weights if n != "bg"]
    )
    background = F.lit(1.0)
    for name in weights:
        if name != "bg":
            background = background * (1 - F.coalesce(name, F.lit(0.0)))
    joined = logits.join(shuffled(products), ["image_id", "i", "j"], "left").withColumn("bg", background)
    z = F.lit(0.0)
    for name in weights:
        z = F.when(F.col("layer") == name, F.coalesce(name, F.lit(0.0))).otherwise(z)
    x = F.col("x")
    loss = F.greatest(x, F.lit(0.0)) - x * z + F.log1p(F.exp(-F.abs(x)))
    coef = F.create_map(*[v for name, w in weights.items() for v in (F.lit(name), F.lit(float(w)))])
    level = F.element_at(F.array(*[F.lit(float(c)) for c in level_coefs]), F.col("level") + 1)
    weighed = loss * coef[F.col("layer")] * level
    return joined.groupBy("image_id").agg(F.avg(weighed).alias("error"))


def laplacian_penalty(field: DataFrame, height: int, width: int, level_coefs: Sequence[float] = (1.0,)) -> DataFrame:
    """Mean squared response of the 3 x 3 kernel (0.5, 1, -6), zero outside, per image and level."""
    by = [c for c in ("image_id", "level") if c in field.columns]
    taps = [(a, b, -6.0 if a == b == 0 else (1.0 if a == 0 or b == 0 else 0.5)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    around = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in taps])
    )
    sent = field.select(*by, "i", "j", "di", "dj", around.alias("t")).select(
        *by, (F.col("i") + F.col("t.a")).alias("i"), (F.col("j") + F.col("t.b")).alias("j"),
        (F.col("di") * F.col("t.w")).alias("di"), (F.col("dj") * F.col("t.w")).alias("dj"),
    ).where(F.col("i").between(0, height - 1) & F.col("j").between(0, width - 1))
    response = sent.groupBy(*by, "i", "j").agg(F.sum("di").alias("a"), F.sum("dj").alias("b"))
    mean = F.sum(F.col("a") * F.col("a") + F.col("b") * F.col("b")) / F.lit(float(height * width))
    penalty = response.groupBy(*by).agg(mean.alias("penalty"))
    if "level" in by:
        coef = F.element_at(F.array(*[F.lit(float(c)) for c in level_coefs]), F.col("level") + 1)
        return penalty.withColumn("penalty", F.col("penalty") * coef)
    return penalty


def schedule_lookup(steps: DataFrame, boundaries: Sequence[float], values: Sequence[float], name: str = "coef") -> DataFrame:
    """Piecewise constant value of `step`: values[n] for boundaries[n-1] < step <= boundaries[n]."""
    if len(values) != len(boundaries) + 1:
        raise ValueError("a schedule needs one value more than boundaries")
    literal = F.array(*[F.lit(float(v)) for v in values])
    return steps.withColumn(name, F.get(literal, count_below(F.col("step"), boundaries)))


def total_loss(terms: DataFrame, weights: dict[str, float] = LOSS_WEIGHTS) -> DataFrame:
    """Weighted sum of `terms(step, term, value)` per step."""
    coef = F.create_map(*[x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))])
    return terms.groupBy("step").agg(F.sum(F.col("value") * coef[F.col("term")]).alias("loss"))
