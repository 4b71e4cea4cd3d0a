"""Row-wise geometry: rings, vertices, edges, boxes and map coordinates.

Input rings are one row per polygon part, so nothing here shuffles except the
joins with the (image-level) georeference.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringfield.functions import rings
from ringfield.functions.numeric import half_even, uniform, vector_angle
from ringfield.operators.skew import shuffled

# ---------------------------------------------------------------- shape changes


def explode_ring(polygons: DataFrame) -> DataFrame:
    """Ring rows to vertex rows (k, i, j); other columns pass through.

    The outer form keeps the optimizer from inferring `size(ring) > 0` and
    evaluating the whole ring expression a second time below the generator.
    """
    rest = [c for c in polygons.columns if c != "ring"]
    exploded = polygons.select(*rest, F.posexplode_outer("ring").alias("k", "p")).where(F.col("k").isNotNull())
    return exploded.select(*rest, "k", F.col("p.i").alias("i"), F.col("p.j").alias("j"))


def settled(df: DataFrame, column: str = "ring") -> DataFrame:
    """Evaluate a column once.

    Catalyst copies an expression into the filters and lambdas that use it; a
    ring would then be rebuilt for every vertex. A one-element generator is not
    merged, costs no shuffle and keeps null rings.
    """
    return df.withColumn(column, F.explode_outer(F.array(column)))


def collect_rings(vertices: DataFrame, *keys: str) -> DataFrame:
    """Vertex rows to ring rows. A ring is one record, so the group is as large as one output row."""
    ordered = F.sort_array(F.collect_list(F.struct("k", "i", "j")))
    grouped = vertices.groupBy(*keys).agg(ordered.alias("o"))
    return grouped.select(*keys, F.transform("o", lambda p: rings.point(p["i"], p["j"])).alias("ring"))


def edges(polygons: DataFrame) -> DataFrame:
    """One row per edge, closing edge included."""
    rest = [c for c in polygons.columns if c != "ring"]
    exploded = polygons.select(*rest, F.explode(rings.ring_edges(F.col("ring"))).alias("e"))
    return exploded.select(*rest, "e.k", "e.i1", "e.j1", "e.i2", "e.j2")


# ---------------------------------------------------------------- ring measures


def ring_area(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("area", rings.area(F.col("ring")))


def orientation(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("clockwise", rings.is_clockwise(F.col("ring")))


def orient(polygons: DataFrame, clockwise: bool = True) -> DataFrame:
    return settled(polygons.withColumn("ring", rings.orient(F.col("ring"), clockwise)))


def fitted_box(
    polygons: DataFrame, scale: float = 1.0, margin: int = 0, square: bool = False
) -> DataFrame:
    """Integer box around a ring: half sizes rounded up, centre rounded half to even."""
    b = F.col("b")
    half_rows = F.ceil((b["r1"] - b["r0"]) * F.lit(float(scale)) / 2) + margin
    half_cols = F.ceil((b["c1"] - b["c0"]) * F.lit(float(scale)) / 2) + margin
    if square:
        half_rows = half_cols = F.greatest(half_rows, half_cols)
    row = half_even((b["r0"] + b["r1"]) / 2).cast("long")
    col = half_even((b["c0"] + b["c1"]) / 2).cast("long")
    return (
        polygons.withColumn("b", rings.box(F.col("ring")))
        .withColumn("r0", row - half_rows)
        .withColumn("c0", col - half_cols)
        .withColumn("r1", row + half_rows)
        .withColumn("c1", col + half_cols)
        .drop("b")
    )


def ring_centre(polygons: DataFrame) -> DataFrame:
    mean = rings.centre(F.col("ring"))
    return polygons.withColumn("ci", mean["i"]).withColumn("cj", mean["j"])


def centre_patch(centres: DataFrame, size: float) -> DataFrame:
    """Box of `size` around (ci, cj), every side rounded up."""
    half = size / 2
    return (
        centres.withColumn("r0", F.ceil(F.col("ci") - half))
        .withColumn("c0", F.ceil(F.col("cj") - half))
        .withColumn("r1", F.ceil(F.col("ci") + half))
        .withColumn("c1", F.ceil(F.col("cj") + half))
    )


def ring_diameter(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("diameter", rings.diameter(F.col("ring")))


# ---------------------------------------------------------------- boxes


def box_pad(padding: float, prefix: str = "") -> dict[str, Column]:
    """Move all sides inwards; use as `df.withColumns(box_pad(2))`."""
    r0, c0, r1, c1 = (F.col(prefix + n) for n in ("r0", "c0", "r1", "c1"))
    return {prefix + "r0": r0 + padding, prefix + "c0": c0 + padding, prefix + "r1": r1 - padding, prefix + "c1": c1 - padding}


def box_margin(margin: float, prefix: str = "") -> dict[str, Column]:
    """Move all sides outwards."""
    return box_pad(-margin, prefix)


def box_to_int(prefix: str = "") -> dict[str, Column]:
    """Smallest integer box around a box."""
    low = {prefix + n: F.floor(F.col(prefix + n)) for n in ("r0", "c0")}
    return low | {prefix + n: F.ceil(F.col(prefix + n)) for n in ("r1", "c1")}


def box_clip(r0, c0, r1, c1, prefix: str = "") -> dict[str, Column]:
    return {
        prefix + "r0": F.greatest(F.col(prefix + "r0"), r0),
        prefix + "c0": F.greatest(F.col(prefix + "c0"), c0),
        prefix + "r1": F.least(F.col(prefix + "r1"), r1),
        prefix + "c1": F.least(F.col(prefix + "c1"), c1),
    }


def centred_box(height: Column, width: Column, out_height, out_width) -> dict[str, Column]:
    """Integer box of the given size in the middle of (height, width)."""
    return {
        "r0": F.floor(height / 2 - F.lit(out_height) / 2),
        "c0": F.floor(width / 2 - F.lit(out_width) / 2),
        "r1": F.ceil(height / 2 + F.lit(out_height) / 2),
        "c1": F.ceil(width / 2 + F.lit(out_width) / 2),
    }


def box_area(prefix: str = "") -> Column:
    rows = F.col(prefix + "r1") - F.col(prefix + "r0")
    return rows * (F.col(prefix + "c1") - F.col(prefix + "c0"))


def vertex_in_box(i: Column, j: Column, r0, c0, r1, c1) -> Column:
    return i.between(r0, r1) & j.between(c0, c1)


def edge_in_box(r0, c0, r1, c1) -> Column:
    first = vertex_in_box(F.col("i1"), F.col("j1"), r0, c0, r1, c1)
    return first & vertex_in_box(F.col("i2"), F.col("j2"), r0, c0, r1, c1)


def box_in_box(inner: tuple, outer: tuple) -> Column:
    r0, c0, r1, c1 = inner
    return (outer[0] <= r0) & (outer[1] <= c0) & (r1 <= outer[2]) & (c1 <= outer[3])


# ---------------------------------------------------------------- vertex changes


def to_box_space(vertices: DataFrame) -> DataFrame:
    """Subtract the origin (r0, c0) carried by each row."""
    return vertices.withColumn("i", F.col("i") - F.col("r0")).withColumn("j", F.col("j") - F.col("c0"))


def level_factor(ds_fac, pixelsize: Column, reference: float = 0.3) -> Column:
    """Pixels of the original image per pixel of the level."""
    return F.lit(ds_fac) * F.lit(reference) / pixelsize


def rescale(vertices: DataFrame, factor: Column) -> DataFrame:
    return vertices.withColumn("i", F.col("i") * factor).withColumn("j", F.col("j") * factor)


def swap_coords(vertices: DataFrame) -> DataFrame:
    return vertices.withColumns({"i": F.col("j"), "j": F.col("i")})


def snap_int(vertices: DataFrame) -> DataFrame:
    return vertices.withColumns({"i": half_even(F.col("i")), "j": half_even(F.col("j"))})


def strip_closing_vertex(polygons: DataFrame, eps: float = 1.0) -> DataFrame:
    return settled(polygons.withColumn("ring", rings.strip_closing(F.col("ring"), eps)))


def drop_doubles(polygons: DataFrame, eps: float = 0.1) -> DataFrame:
    return settled(polygons.withColumn("ring", rings.drop_doubles(F.col("ring"), eps)))


def drop_holes(polygons: DataFrame) -> DataFrame:
    """Keep the shell: part 0 of split polygons, or everything before a NaN separator."""
    shells = polygons.where(F.col("part") == 0) if "part" in polygons.columns else polygons
    return settled(shells.withColumn("ring", rings.cut_at_nan(F.col("ring"))))


# ---------------------------------------------------------------- edges


def edge_attributes(edge_rows: DataFrame) -> DataFrame:
    """Centre, length, unit normal and the two angles of every edge."""
    di, dj = F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1")
    length = F.sqrt(di * di + dj * dj)
    real = F.col("length") > 0
    return edge_rows.withColumns(
        {
            "centre_i": (F.col("i1") + F.col("i2")) / 2,
            "centre_j": (F.col("j1") + F.col("j2")) / 2,
            "length": length,
        }
    ).withColumns(
        {
            "normal_i": F.when(real, -dj / F.col("length")),
            "normal_j": F.when(real, di / F.col("length")),
            "angle": vector_angle(di, dj),
            "normal_angle": F.when(real, vector_angle(di, -dj)),
        }
    )


def turn_angles(polygons: DataFrame) -> DataFrame:
    """Per vertex: fold angle between its two edges, and the inner angle by the cosine rule."""
    ring = F.col("ring")

    def corner(p: Column, k: Column) -> Column:
        size = F.size(ring)
        before = F.get(ring, (k + size - 1) % size)
        return F.struct(k.alias("k"), p.alias("p"), before.alias("before"), rings.following(ring, k).alias("after"))

    rest = [c for c in polygons.columns if c != "ring"]
    # Angles are taken of exploded corners: in a lambda they are interpreted, and again for each use.
    corners = polygons.select(*rest, F.explode(F.transform(ring, corner)).alias("_c"))
    p, before, after = F.col("_c.p"), F.col("_c.before"), F.col("_c.after")
    incoming = vector_angle(p["i"] - before["i"], p["j"] - before["j"])
    outgoing = vector_angle(after["i"] - p["i"], after["j"] - p["j"])
    gap = F.abs(incoming - outgoing)
    fold = F.when(gap > F.pi(), 2 * F.pi() - gap).otherwise(gap)
    return corners.select(*rest, F.col("_c.k").alias("k"), fold.alias("turn"), angle_between(p, before, after).alias("inner"))


def angle_between(at: Column, a: Column, b: Column) -> Column:
    """Angle a-at-b in [0, pi]; infinite when a or b coincides with `at`."""

    def squared(p: Column, q: Column) -> Column:
        return (p["i"] - q["i"]) * (p["i"] - q["i"]) + (p["j"] - q["j"]) * (p["j"] - q["j"])

    left, right = squared(at, a), squared(at, b)
    product = 2 * F.sqrt(left) * F.sqrt(right)
    cosine = (left + right - squared(a, b)) / F.nullif(product, F.lit(0.0))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return F.when(product == 0, F.lit(float("inf"))).otherwise(angle)


def shorten_edges(edge_rows: DataFrame, cut1: float, cut2: float, min_length: float) -> DataFrame:
    """Shrink edges about their centre; edges that get too short are dropped."""
    di, dj = F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1")
    total = F.sqrt(di * di + dj * dj)
    left = total - F.lit(float(cut1)) - F.lit(float(cut2))
    ci, cj = (F.col("i1") + F.col("i2")) / 2, (F.col("j1") + F.col("j2")) / 2
    factor = F.col("_factor")
    return (
        edge_rows.where((total > 0) & (left >= F.lit(float(min_length))))
        .withColumn("_factor", left / total)
        .withColumns(
            {
                "i1": (F.col("i1") - ci) * factor + ci,
                "j1": (F.col("j1") - cj) * factor + cj,
                "i2": (F.col("i2") - ci) * factor + ci,
                "j2": (F.col("j2") - cj) * factor + cj,
            }
        )
        .drop("_factor")
    )


# ---------------------------------------------------------------- simplification


def _within(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    starts = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(starts, lengths)


def _importance(i: np.ndarray, j: np.ndarray, offsets: np.ndarray, stop: float = -1.0) -> np.ndarray:
    """Up to which tolerance Douglas-Peucker keeps each vertex of many rings, given one after the other (the ends: always).

    The vertex farthest from the chord segment splits it, whatever the tolerance, so a vertex stays as long as its own
    distance and those of the splits above it exceed the tolerance. All chords of all rings are split at once, level by
    level; chords whose farthest vertex is not beyond `stop` are left, as nothing inside can stay.
    """
    found = np.zeros(len(i))
    filled = offsets[1:] > offsets[:-1]
    a, b = offsets[:-1][filled], offsets[1:][filled] - 1
    found[a] = found[b] = np.inf
    above = np.full(len(a), np.inf)
    while True:
        wide = b - a >= 2
        a, b, above = a[wide], b[wide], above[wide]
        if not len(a):
            return found
        inner = b - a - 1
        at = np.repeat(a + 1, inner) + _within(inner)
        ci, cj = np.repeat(i[b] - i[a], inner), np.repeat(j[b] - j[a], inner)
        pi, pj = i[at] - np.repeat(i[a], inner), j[at] - np.repeat(j[a], inner)
        span = ci * ci + cj * cj
        along = np.clip(np.divide(pi * ci + pj * cj, span, out=np.zeros(len(at)), where=span > 0), 0.0, 1.0)
        gap = np.hypot(pi - along * ci, pj - along * cj)
        starts = np.cumsum(inner) - inner
        most = np.maximum.reduceat(gap, starts)
        far = np.minimum.reduceat(np.where(gap == np.repeat(most, inner), at, len(i)), starts)
        # Coordinates that are no numbers have no farthest vertex.
        goes = (most > stop) & (far < len(i))
        a, b, far, above = a[goes], b[goes], far[goes], np.minimum(above, most)[goes]
        found[far] = above
        a, b, above = np.concatenate([a, far]), np.concatenate([far, b]), np.concatenate([above, above])


def _lists(values: np.ndarray, counts: np.ndarray, missing: pa.Array) -> pa.Array:
    """Lists of the given lengths; null where `missing` is."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=missing.is_null() if missing.null_count else None)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a list column and the offsets of its rows; rows that are null are empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _positions(pick, ring: Column) -> Column:
    """`pick(i, j, offsets)` marks the vertices that stay; their positions in the ring."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def positions(rows: pa.Array, cols: pa.Array) -> pa.Array:
        i, offsets = _flat(rows)
        j, _ = _flat(cols)
        stays = pick(i, j, offsets)
        lengths = np.diff(offsets)
        counts = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[stays], minlength=len(lengths))
        return _lists(_within(lengths)[stays].astype(np.int32), counts, rows)

    return positions(F.transform(ring, lambda p: p["i"]), F.transform(ring, lambda p: p["j"]))


def kept_positions(polygons: DataFrame, tolerance: float = 1.0, name: str = "kept") -> DataFrame:
    """Adds the positions of the vertices that Douglas-Peucker keeps; the first and last vertex always stay."""

    def pick(i: np.ndarray, j: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _importance(i, j, offsets, tolerance) > tolerance

    if tolerance <= 0:
        return polygons.withColumn(name, F.transform("ring", lambda p, k: k))
    return settled(polygons).withColumn(name, _positions(pick, F.col("ring")))


def at_positions(polygons: DataFrame, name: str = "kept") -> DataFrame:
    """Rings reduced to the vertices at the positions of a column, which is dropped."""
    ring = F.transform(name, lambda k: F.get(F.col("ring"), k))
    return settled(polygons.withColumn("ring", ring).drop(name))


def shells(polygons: DataFrame) -> DataFrame:
    """Rings without holes that hold a vertex."""
    return drop_holes(polygons).where(F.size("ring") > 0)


def at_truth_positions(copies: DataFrame, kept: DataFrame, name: str = "kept") -> DataFrame:
    """Copies of rings (displaced, of another version or map) reduced to the vertices their truth keeps.

    `kept` has a row for each truth ring, see `kept_positions`; copies without a truth are left out.
    """
    keys = [c for c in ("image_id", "poly_id", "part") if c in copies.columns and c in kept.columns]
    return at_positions(drop_holes(copies).join(shuffled(kept.select(*keys, name)), keys), name)


def simplify(polygons: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Douglas-Peucker on each ring; the first and last vertex always stay."""
    if tolerance <= 0:
        return polygons
    return at_positions(kept_positions(polygons, tolerance, "_kept"), "_kept")


def simplify_to_count(polygons: DataFrame, count: int, step: float = 0.1) -> DataFrame:
    """Raise the tolerance by steps until a closed ring has at most `count` distinct vertices, then open it."""

    def pick(i: np.ndarray, j: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, lengths = _importance(i, j, offsets), np.diff(offsets)
        ring = np.repeat(np.arange(len(lengths)), lengths)
        # The first vertex to go decides the tolerance: the largest importance beyond the `count` + 1 that may stay.
        order = np.lexsort((-found, ring))
        last = offsets[:-1] + count + 1
        over = lengths > count + 1
        limit = np.zeros(len(lengths))
        limit[over] = np.minimum(found[order[last[over]]], 1e300)
        tries = np.maximum(np.floor(limit / step) - 1, 1)
        for _ in range(3):  # within rounding of the quotient
            tries = np.where(tries * step < limit, tries + 1, tries)
        stays = ~over[ring] | (found > (tries * step)[ring])
        stays[(offsets[1:] - 1)[lengths > 0]] = False
        return stays

    return at_positions(settled(polygons).withColumn("_kept", _positions(pick, F.col("ring"))), "_kept")


def drop_spikes(faces: DataFrame) -> DataFrame:
    """Remove vertices whose two neighbours are the same vertex, with their successor, until none is left.

    `faces.face` holds vertex ids of an open ring in order.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def smooth(face: pa.Array) -> pa.Array:
        ids, offsets = _flat(face)
        ids, lengths = _without_spikes(ids.astype(np.int64), np.diff(offsets))
        return _lists(ids, lengths, face)

    return faces.withColumn("face", smooth(F.col("face")))


def _without_spikes(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rings at once, round by round."""
    while len(ids):
        ends = np.cumsum(lengths)
        ring = np.repeat(np.arange(len(lengths)), lengths)
        place, size = _within(lengths), lengths[ring]
        start = np.arange(len(ids)) - place
        before, after = ids[start + (place - 1) % size], ids[start + (place + 1) % size]
        spike = before == after
        if not spike.any():
            break
        # In a run of spikes every other one goes, with its successor; runs do not reach over the end of a ring.
        opens = spike & ((place == 0) | ~np.concatenate([[False], spike[:-1]]))
        since = np.arange(len(ids)) - np.maximum.accumulate(np.where(opens, np.arange(len(ids)), 0))
        goes = spike & (since % 2 == 0)
        follows = np.concatenate([[False], goes[:-1]]) & (place > 0)
        stays = ~(goes | follows)
        ids = ids[stays]
        lengths = np.add.reduceat(np.append(stays, False).astype(np.int64), ends - lengths) * (lengths > 0)
    return ids, lengths


def clean_polygons(polygons: DataFrame, images: DataFrame | None = None, tolerance: float = 1.0) -> DataFrame:
    """Drop holes, then simplify; with `images`, those left without polygons appear with a null ring."""
    cleaned = simplify(shells(polygons), tolerance)
    if images is None:
        return cleaned
    return images.select("image_id").join(cleaned, "image_id", "left")


def sample_polygons(polygons: DataFrame, keep: float, seed: int = 0) -> DataFrame:
    """Keep a polygon with the given probability, decided by its id (the sampling is the feature)."""
    return polygons.where(uniform(seed, F.col("image_id"), F.col("poly_id")) < F.lit(float(keep)))


# ---------------------------------------------------------------- map coordinates


def image_to_world(vertices: DataFrame, images: DataFrame) -> DataFrame:
    """(i, j) to (x, y) with the image's geotransform; rotation terms are ignored."""
    placed = vertices.join(images.select("image_id", "gt"), "image_id")
    gt = F.col("gt")
    return placed.withColumns({"x": gt[0] + gt[1] * F.col("j"), "y": gt[3] + gt[5] * F.col("i")}).drop("gt")


def world_to_image(points: DataFrame, images: DataFrame) -> DataFrame:
    """(x, y) to (i, j)."""
    placed = points.join(images.select("image_id", "gt"), "image_id")
    gt = F.col("gt")
    return placed.withColumns(
        {"i": (F.col("y") - gt[3]) / gt[5], "j": (F.col("x") - gt[0]) / gt[1]}
    ).drop("gt")


def image_extent(images: DataFrame) -> DataFrame:
    gt = F.col("gt")
    return images.withColumns(
        {
            "x_min": gt[0],
            "y_min": gt[3] + F.col("width") * gt[4] + F.col("height") * gt[5],
            "x_max": gt[0] + F.col("width") * gt[1] + F.col("height") * gt[2],
            "y_max": gt[3],
        }
    )


def pixel_size(images: DataFrame, override: float | None = None, tiny: float = 1e-3) -> DataFrame:
    """Mean pixel side; `pixelsize_suspect` marks sizes too small to be metres."""
    mean = (F.col("gt")[1] - F.col("gt")[5]) / 2
    size = F.lit(float(override)) if override is not None else mean
    return images.withColumn("pixelsize", size).withColumn("pixelsize_suspect", F.col("pixelsize") < tiny)


# WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0


def project_lonlat(points: DataFrame, epsg: int) -> DataFrame:
    """(lon, lat) in degrees to (x, y) for web mercator (3857) or a UTM zone (326zz, 327zz)."""
    lon, lat = F.radians("lon"), F.radians("lat")
    if epsg == 3857:
        north = F.log(F.tan(F.pi() / 4 + lat / 2)) * WGS84_A
        return points.withColumns({"x": lon * WGS84_A, "y": north})
    zone, south = _utm_zone(epsg)
    n, radius, alpha, _, _ = _utm_series()
    root = 2 * math.sqrt(n) / (1 + n)
    delta = lon - math.radians(zone * 6 - 183)
    tau = F.sinh(F.atanh(F.sin(lat)) - root * F.atanh(root * F.sin(lat)))
    xi, eta = F.atan2(tau, F.cos(delta)), F.atanh(F.sin(delta) / F.sqrt(1 + tau * tau))
    east, north = eta, xi
    for m, a in enumerate(alpha, start=1):
        east = east + a * F.cos(2 * m * xi) * F.sinh(2 * m * eta)
        north = north + a * F.sin(2 * m * xi) * F.cosh(2 * m * eta)
    shift = UTM_FALSE_NORTHING_SOUTH if south else 0.0
    return points.withColumns(
        {
            "x": UTM_FALSE_EASTING + UTM_SCALE * radius * east,
            "y": shift + UTM_SCALE * radius * north,
        }
    )


def unproject_lonlat(points: DataFrame, epsg: int) -> DataFrame:
    """(x, y) back to (lon, lat) in degrees."""
    if epsg == 3857:
        lat = 2 * F.atan(F.exp(F.col("y") / WGS84_A)) - F.pi() / 2
        return points.withColumns({"lon": F.degrees(F.col("x") / WGS84_A), "lat": F.degrees(lat)})
    zone, south = _utm_zone(epsg)
    _, radius, _, beta, delta = _utm_series()
    shift = UTM_FALSE_NORTHING_SOUTH if south else 0.0
    xi = (F.col("y") - shift) / (UTM_SCALE * radius)
    eta = (F.col("x") - UTM_FALSE_EASTING) / (UTM_SCALE * radius)
    north, east = xi, eta
    for m, b in enumerate(beta, start=1):
        north = north - b * F.sin(2 * m * xi) * F.cosh(2 * m * eta)
        east = east - b * F.cos(2 * m * xi) * F.sinh(2 * m * eta)
    chi = F.asin(F.sin(north) / F.cosh(east))
    lat = chi
    for m, d in enumerate(delta, start=1):
        lat = lat + d * F.sin(2 * m * chi)
    lon = F.atan2(F.sinh(east), F.cos(north))
    return points.withColumns(
        {"lon": F.degrees(lon) + float(zone * 6 - 183), "lat": F.degrees(lat)}
    )


def _utm_zone(epsg: int) -> tuple[int, bool]:
    family, zone = divmod(epsg, 100)
    if family not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} is not web mercator and not a UTM zone")
    return zone, family == 327


def _utm_series():
    """Third-order transverse Mercator series (Krueger) in the third flattening n."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return n, radius, alpha, beta, delta


# ---------------------------------------------------------------- homographies


def homography(params: DataFrame) -> DataFrame:
    """Nine matrix columns h11..h33 from t1, t2, theta, s1, s2, k1, k2, p1, p2.

    The matrix is (rotation and translation) x (scale and shear) x (projection).
    """
    cos, sin = F.cos("theta"), F.sin("theta")
    a = [[1 + F.col("s1"), F.col("k2")], [F.col("k1"), 1 + F.col("s2")]]
    rotated = [
        [cos * a[0][0] - sin * a[1][0], cos * a[0][1] - sin * a[1][1], F.col("t1")],
        [sin * a[0][0] + cos * a[1][0], sin * a[0][1] + cos * a[1][1], F.col("t2")],
        [F.lit(0.0), F.lit(0.0), F.lit(1.0)],
    ]
    out: dict[str, Column] = {}
    for r, row in enumerate(rotated, start=1):
        out[f"h{r}1"] = row[0] + row[2] * F.col("p1")
        out[f"h{r}2"] = row[1] + row[2] * F.col("p2")
        out[f"h{r}3"] = row[2]
    return params.withColumns(out)


def apply_homography(points: DataFrame, matrices: DataFrame, on: str = "image_id") -> DataFrame:
    """Map (x, y) with the matrix of its image."""
    h = [f"h{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3)]
    joined = points.join(matrices.select(on, *h), on)

    def line(r: int) -> Column:
        return F.col(f"h{r}1") * F.col("x") + F.col(f"h{r}2") * F.col("y") + F.col(f"h{r}3")

    return joined.withColumns({"x": line(1) / line(3), "y": line(2) / line(3)}).drop(*h)


# Corners of the unit square, in the order used for the four-point form.
UNIT_CORNERS = ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))


def four_points(matrices: DataFrame, on: str = "image_id") -> DataFrame:
    """The four unit corners mapped through each matrix: (corner, x, y)."""
    corners = F.array(
        *[F.struct(F.lit(n).alias("corner"), F.lit(x).alias("x"), F.lit(y).alias("y")) for n, (x, y) in enumerate(UNIT_CORNERS)]
    )
    points = matrices.select(on, F.explode(corners).alias("p")).select(on, "p.corner", "p.x", "p.y")
    return apply_homography(points, matrices, on)


def fit_homography(pairs: DataFrame, on: str = "image_id") -> DataFrame:
    """Least-squares matrix per image from point pairs (x, y) to (u, v), scaled so that h33 = 1.

    The 9 x 9 normal matrix is a plain sum aggregate, so an image with any
    number of pairs arrives at the eigen solver as a single small row.
    """
    x, y, u, v = (F.col(c) for c in ("x", "y", "u", "v"))
    zero, one = F.lit(0.0), F.lit(1.0)
    first = [x, y, one, zero, zero, zero, -u * x, -u * y, -u]
    second = [zero, zero, zero, x, y, one, -v * x, -v * y, -v]
    cells = [(r, c) for r in range(9) for c in range(r, 9)]
    sums = [F.sum(first[r] * first[c] + second[r] * second[c]).alias(f"m{r}{c}") for r, c in cells]
    moments = pairs.groupBy(on).agg(*sums)
    packed = moments.select(on, F.array(*[F.col(f"m{r}{c}") for r, c in cells]).alias("m"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(rows: pd.Series) -> pd.Series:
        found = []
        for row in rows:
            normal = np.zeros((9, 9))
            for value, (r, c) in zip(row, cells):
                normal[r, c] = normal[c, r] = value
            vector = np.linalg.eigh(normal)[1][:, 0]
            found.append((vector / vector[8]).tolist())
        return pd.Series(found)

    solved = packed.select(on, solve("m").alias("h"))
    return solved.select(on, *[F.col("h")[3 * r + c].alias(f"h{r + 1}{c + 1}") for r in range(3) for c in range(3)])


# ---------------------------------------------------------------- image lists


def fold_filter(images: DataFrame, fold: str) -> DataFrame:
    return images.where(F.col("fold") == fold)


def ds_levels(images: DataFrame, factors: list[int]) -> DataFrame:
    """One row per image and level, levels finer than the image's minimum left out."""
    levels = F.filter(F.array(*[F.lit(f) for f in factors]), lambda f: F.col("min_ds_fac") <= f)
    return images.withColumn("ds_fac", F.explode(levels))
