"""Displacement fields: creation, application to vertices, warping, coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfield.functions.numeric import clamp, half_even, uniform
from ringfield.operators.skew import shuffled

EDGE_SLICES = 32
INT16 = 32767.0


def apply_field(
    vertices: DataFrame,
    field: DataFrame,
    height,
    width,
    sign: int = 1,
    scale: float = 1.0,
    edge_slices: int = EDGE_SLICES,
    where: Column | None = None,
) -> DataFrame:
    """Move each vertex by the field vector of its (rounded, clipped) cell; one output per map.

    `sign=1` applies a prediction, `sign=-1` makes a displaced copy. Vertices
    outside the field all clip to its border, so a border cell can hold most of
    the table: those vertices are spread over `edge_slices` copies of the border
    cells, which are few against the interior. Vertices with NaN coordinates
    (separators) stay as they are.

    `height` and `width` are numbers, or columns carried by both tables; a field
    with a `border` flag needs them on the vertices only. Rows for
    which `where` is false, or whose field is absent, keep their position when
    `where` is given (a left join); they are spread as well.
    """
    size = [F.lit(s) if not isinstance(s, str) else F.col(s) for s in (height, width)]
    shared = [c for c in ("image_id", "ds_fac") if c in field.columns and c in vertices.columns]
    maps = ["map_id"] if "map_id" in field.columns else []
    if maps and "map_id" in vertices.columns:
        shared.append("map_id")
        maps = []
    rows, cols = half_even(F.col("i")), half_even(F.col("j"))
    ci, cj = (clamp(v, F.lit(0.0), s - 1).cast("int") for v, s in ((rows, size[0]), (cols, size[1])))
    on_edge = (F.col("ci") == 0) | (F.col("cj") == 0) | (F.col("ci") == size[0] - 1) | (F.col("cj") == size[1] - 1)
    identity = [c for c in ("image_id", "poly_id", "part", "k") if c in vertices.columns]
    spread = F.pmod(F.xxhash64(*identity), F.lit(edge_slices)).cast("int")
    slice_ = F.when(on_edge, spread).otherwise(0)
    if where is not None:
        slice_ = F.when(where, slice_).otherwise(-1 - F.pmod(F.xxhash64(*identity), F.lit(1024)).cast("int"))
    located = vertices.withColumns({"ci": ci, "cj": cj}).withColumn("slice", slice_)

    if "border" in field.columns:
        at_edge = F.col("border")
    else:
        at_edge = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == size[0] - 1) | (F.col("j") == size[1] - 1)
    copies = F.when(at_edge, F.sequence(F.lit(0), F.lit(edge_slices - 1))).otherwise(F.array(F.lit(0)))
    vectors = field.select(
        *shared, *maps, F.col("i").cast("int").alias("ci"), F.col("j").cast("int").alias("cj"),
        "di", "dj", F.explode(copies).alias("slice"),
    )
    moved = located.join(shuffled(vectors), [*shared, "ci", "cj", "slice"], "inner" if where is None else "left")
    step = F.lit(float(sign) * float(scale))
    added = {c: F.col(c) + F.coalesce(F.col(f"d{c}"), F.lit(0.0)) * step for c in ("i", "j")}
    return moved.withColumns(added).select(*vertices.columns, *maps)


def displace_polygons(vertices: DataFrame, field: DataFrame, height, width, max_abs: float) -> DataFrame:
    """Displaced copies of the vertices from a field normalised to [-1, 1]."""
    return apply_field(vertices, field, height, width, sign=-1, scale=max_abs)


# ---------------------------------------------------------------- synthesis


def random_modes(
    images: DataFrame, map_count: int, modes: int, seed: int,
    mu_range: tuple[float, float] = (0.0, 1.0), sig_scaling: tuple[float, float] = (0.0, 0.002),
) -> DataFrame:
    """Signed Gaussian modes per (image, map, channel): means, covariance and sign.

    The covariance is spread * Q + low, where Q is the matrix ((e1, 1), (1, e2))
    with e1, e2 in [1, 2), turned to a random axis. Written out before use, the table makes
    the field reproducible.
    """
    grid = images.select("image_id")
    for name, count in (("map_id", map_count), ("channel", 2), ("mode", modes)):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    ids = [F.col(c) for c in ("image_id", "map_id", "channel", "mode")]

    def draw(n: int) -> Column:
        return uniform(seed * 7919 + n, *ids)

    low, high = mu_range
    spread = sig_scaling[1] - sig_scaling[0]
    turn, e1, e2 = draw(3) * 2 * F.pi(), 1.0 + draw(4), 1.0 + draw(5)
    cos, sin = F.cos("turn"), F.sin("turn")
    return (
        grid.withColumns(
            {
                "mu_i": low + draw(0) * (high - low),
                "mu_j": low + draw(1) * (high - low),
                "sign": F.when(draw(2) < 0.5, -1.0).otherwise(1.0),
                "turn": turn, "e1": e1, "e2": e2,
            }
        )
        .withColumns(
            {
                "s_ii": spread * (F.col("e1") * cos * cos - 2 * cos * sin + F.col("e2") * sin * sin) + sig_scaling[0],
                "s_ij": spread * ((F.col("e1") - F.col("e2")) * cos * sin + cos * cos - sin * sin) + sig_scaling[0],
                "s_jj": spread * (F.col("e1") * sin * sin + 2 * cos * sin + F.col("e2") * cos * cos) + sig_scaling[0],
            }
        )
        .drop("turn", "e1", "e2")
    )


def gaussian_field(
    images: DataFrame, modes: DataFrame, coarse: int = 4, mu_range: tuple[float, float] = (0.0, 1.0)
) -> DataFrame:
    """Smooth random field in [-1, 1] per (image, map), on every pixel.

    The mixture is summed on a grid `coarse` times smaller over the whole mean
    range, stretched per channel, cropped to the centre and upsampled
    bilinearly. The modes of a channel (a fixed count) travel as one array, so
    the grid meets them in an equi join per image and never multiplies.
    """
    span = mu_range[1] - mu_range[0]
    packed = modes.groupBy("image_id", "map_id", "channel").agg(
        F.sort_array(F.collect_list(F.struct("mode", "mu_i", "mu_j", "sign", "s_ii", "s_ij", "s_jj"))).alias("modes")
    )
    sizes = images.select(
        "image_id",
        F.floor(F.col("height") * span / coarse).cast("int").alias("gh"),
        F.floor(F.col("width") * span / coarse).cast("int").alias("gw"),
        F.floor(F.col("height") / coarse).cast("int").alias("ch"),
        F.floor(F.col("width") / coarse).cast("int").alias("cw"),
        "height",
        "width",
    )
    # Joined before the grid is exploded, so that neither side is larger than one row per image and channel.
    rows = sizes.join(packed, "image_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("gh") - 1)))
    grid = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("gw") - 1)))
    y = mu_range[0] + span * F.col("i") / F.greatest(F.col("gh") - 1, F.lit(1))
    x = mu_range[0] + span * F.col("j") / F.greatest(F.col("gw") - 1, F.lit(1))
    summed = grid.select(
        "image_id", "map_id", "channel", "i", "j", "gh", "gw", "ch", "cw", "height", "width",
        mixture(F.col("modes"), y, x).alias("value"),
    )
    stretched = minmax_stretch(summed, "value", ["image_id", "map_id", "channel"])
    top = F.floor(F.col("gh") / 2) - F.floor(F.col("ch") / 2)
    left = F.floor(F.col("gw") / 2) - F.floor(F.col("cw") / 2)
    inner = stretched.withColumns({"i": (F.col("i") - top).cast("int"), "j": (F.col("j") - left).cast("int")}).where(
        F.col("i").between(0, F.col("ch") - 1) & F.col("j").between(0, F.col("cw") - 1)
    )
    vectors = inner.groupBy("image_id", "map_id", "i", "j").agg(
        F.max(F.when(F.col("channel") == 0, F.col("value"))).alias("di"),
        F.max(F.when(F.col("channel") == 1, F.col("value"))).alias("dj"),
    )
    shapes = images.select(
        "image_id", F.floor(F.col("height") / coarse).cast("int").alias("from_h"),
        F.floor(F.col("width") / coarse).cast("int").alias("from_w"), "height", "width",
    )
    return resample(vectors, shapes, ["map_id"], ["di", "dj"])


def mixture(modes: Column, y: Column, x: Column) -> Column:
    """Sum of signed bivariate normal densities at (y, x)."""

    def density(total: Column, m: Column) -> Column:
        det = m["s_ii"] * m["s_jj"] - m["s_ij"] * m["s_ij"]
        dy, dx = y - m["mu_i"], x - m["mu_j"]
        quad = (m["s_jj"] * dy * dy - 2.0 * m["s_ij"] * dy * dx + m["s_ii"] * dx * dx) / det
        return total + m["sign"] * F.exp(-quad / 2) / (2 * F.pi() * F.sqrt(det))

    return F.aggregate(modes, F.lit(0.0), density)


def resample(cells: DataFrame, shapes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Bilinear resize from (from_h, from_w) to (height, width), pixel centres aligned.

    Each source cell is sent to the target pixels it contributes to, with its
    weight; one partial sum per pixel is all that shuffles.
    """
    placed = cells.join(shapes, "image_id")

    def targets(index: Column, source: Column, target: Column) -> Column:
        ratio = target / source
        first = F.ceil((index - 0.5) * ratio - 0.5).cast("int")
        last = F.floor((index + 1.5) * ratio - 0.5).cast("int")
        first = F.when(index == 0, F.lit(0)).otherwise(F.greatest(first, F.lit(0)))
        last = F.when(index == source - 1, (target - 1).cast("int")).otherwise(F.least(last, (target - 1).cast("int")))

        def weight(t: Column) -> Column:
            at = clamp((t + 0.5) / ratio - 0.5, F.lit(0.0), (source - 1).cast("double"))
            return F.struct(t.alias("at"), F.greatest(F.lit(0.0), 1.0 - F.abs(at - index)).alias("w"))

        reach = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(reach, weight), lambda t: t["w"] > 0)

    sent = placed.withColumn("a", F.explode(targets(F.col("i"), F.col("from_h"), F.col("height")))).withColumn(
        "b", F.explode(targets(F.col("j"), F.col("from_w"), F.col("width")))
    )
    sums = [F.sum(F.col(v) * F.col("a.w") * F.col("b.w")).alias(v) for v in values]
    return sent.groupBy("image_id", *keys, F.col("a.at").alias("i"), F.col("b.at").alias("j")).agg(*sums)


def minmax_stretch(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Stretch to [-1, 1] per group; a constant group is left unchanged.

    Extremes come from an aggregate joined back, not a window, so a group of any size is spread.
    """
    extremes = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    joined = df.join(extremes, keys)
    spread = F.col("_high") - F.col("_low")
    stretched = (F.col(value) - F.col("_low")) * 2 / F.nullif(spread, F.lit(0.0)) - 1
    return joined.withColumn(value, F.when(spread > 0, stretched).otherwise(F.col(value))).drop("_low", "_high")


# ---------------------------------------------------------------- coding and vectors


def quantise_field(field: DataFrame) -> DataFrame:
    """[-1, 1] to SMALLINT."""
    return field.withColumns({c: half_even(F.col(c) * INT16).cast("short") for c in ("di", "dj")})


def dequantise_field(field: DataFrame, dynamic_range: float = 0.5) -> DataFrame:
    """SMALLINT to [-dynamic_range, dynamic_range]."""
    return field.withColumns({c: F.col(c) * F.lit(dynamic_range) / F.lit(INT16) for c in ("di", "dj")})


def denormalise_prediction(field: DataFrame, max_abs: float, dynamic_range: float = 0.5) -> DataFrame:
    """Network output to pixels."""
    return field.withColumns({c: F.col(c) / F.lit(dynamic_range) * F.lit(float(max_abs)) for c in ("di", "dj")})


def rotate_vectors(field: DataFrame, angle) -> DataFrame:
    """Turn every vector with the matrix of `-angle`, vectors as rows; positions stay."""
    a = angle if isinstance(angle, Column) else F.lit(float(angle))
    cos, sin = F.cos(-a), F.sin(-a)
    di, dj = F.col("di"), F.col("dj")
    return field.withColumns({"di": di * cos + dj * sin, "dj": dj * cos - di * sin})


def flip_rows(field: DataFrame) -> DataFrame:
    """Reverse the sign of the row channel."""
    return field.withColumn("di", -F.col("di"))


def field_polar(field: DataFrame, keys: list[str]) -> DataFrame:
    """Angle in [0, 2 pi) and magnitude stretched to [0, 255] per group."""
    turned = F.atan2("dj", "di")
    polar = field.withColumns(
        {
            "angle": F.when(turned < 0, turned + 2 * F.pi()).otherwise(turned),
            "magnitude": F.sqrt(F.col("di") * F.col("di") + F.col("dj") * F.col("dj")),
        }
    )
    extremes = polar.groupBy(*keys).agg(F.min("magnitude").alias("_low"), F.max("magnitude").alias("_high"))
    spread = F.col("_high") - F.col("_low")
    level = F.when(spread > 0, (F.col("magnitude") - F.col("_low")) * 255 / F.nullif(spread, F.lit(0.0))).otherwise(0.0)
    return polar.join(extremes, keys).withColumn("level", level).drop("_low", "_high")


def warp_pixels(pixels: DataFrame, field: DataFrame, height, width) -> DataFrame:
    """Nearest-pixel remap: target (i, j) takes the source pixel at (i + di, j + dj); outside is 0.

    Row displacement is `di`, as for polygons. Callers with fields in the other
    channel order swap the two columns first.
    """
    keys = [c for c in ("image_id",) if c in field.columns]
    maps = [c for c in ("map_id",) if c in field.columns]
    source = field.select(
        *keys, *maps, F.col("i").alias("ti"), F.col("j").alias("tj"),
        half_even(F.col("i") + F.col("di")).cast("int").alias("i"),
        half_even(F.col("j") + F.col("dj")).cast("int").alias("j"),
    )
    bands = pixels.select("image_id", "band", "i", "j", "value")
    inside = F.col("i").between(0, F.lit(height) - 1) & F.col("j").between(0, F.lit(width) - 1)
    hit = source.where(inside).join(shuffled(bands), [*keys, "i", "j"])
    return hit.select("image_id", *maps, "band", F.col("ti").alias("i"), F.col("tj").alias("j"), "value")
