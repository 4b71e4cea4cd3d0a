"""Dense tiles: the values of a square of cells in one row, all planes (bands, layers, maps) together.

A tile table is (keys, ti, tj, data): `data` holds planes x side x side numbers of the table's type, row after row, little
endian; tile (ti, tj) begins at cell (ti * side, tj * side) and hangs over the image's far edges, where its values count for
nothing. Absent tiles are zero. Resampling and cutting send parts of tiles to where they are needed (the part of a source tile
that a target uses, and no more), so what is shuffled is proportional to the values of the result. A tile and a
patch are one record each; everything else stays spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfield.operators.skew import shuffled

SIDE = 64


def _arrays(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in column]


def pack_cells(cells: DataFrame, keys: list[str], plane: Column, planes: int, kind: str, side: int = SIDE, value: str = "value") -> DataFrame:
    """Cells (keys, i, j, value) as tiles; `plane` numbers the plane of a cell. Of several values the largest counts."""
    at = (plane * side + F.pmod("i", F.lit(side))) * side + F.pmod("j", F.lit(side))
    placed = cells.select(
        *keys, F.floor(F.col("i") / side).cast("int").alias("ti"), F.floor(F.col("j") / side).cast("int").alias("tj"),
        F.struct(at.cast("int").alias("at"), F.col(value).cast("double").alias("v")).alias("c"),
    )
    packed = placed.groupBy(*keys, "ti", "tj").agg(F.sort_array(F.collect_list("c")).alias("c"))

    @F.arrow_udf("binary")
    def fill(places: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for at, v in zip(places, values):
            data = np.zeros(planes * side * side, kind)
            data[at.values.to_numpy()] = v.values.to_numpy()  # in order, so the largest is written last
            out.append(data.tobytes())
        return pa.array(out, pa.binary())

    return packed.select(*keys, "ti", "tj", fill(F.col("c.at"), F.col("c.v")).alias("data"))


def unpack_tiles(tiles: DataFrame, keys: list[str], planes: int, kind: str, side: int = SIDE) -> DataFrame:
    """(keys, plane, i, j, value) of every cell of the tiles, also of those beyond the image's edge."""
    flat = tiles.select(*keys, "ti", "tj", F.posexplode(numbers("data", kind)).alias("at", "value"))
    return flat.select(
        *keys, F.expr(f"CAST(at DIV {side * side} AS INT)").alias("plane"),
        F.expr(f"CAST(ti * {side} + (at DIV {side}) % {side} AS INT)").alias("i"),
        F.expr(f"CAST(tj * {side} + at % {side} AS INT)").alias("j"), "value",
    )


def _shares(first: int, count: int, source: int, target: int) -> tuple[int, np.ndarray]:
    """Weights by which cells first..first + count - 1 of `source` take part in the target's cells from the returned one on.

    A target cell is the mean of the stretch it covers, in parts of cells.
    """
    ratio = source / target
    last = min(first + count, source)
    low, high = int(first / ratio), min(target, int(np.ceil(last / ratio - 1e-9)))
    t, s = np.arange(low, high)[:, None], np.arange(first, first + count)[None, :]
    shared = np.minimum((t + 1) * ratio, s + 1) - np.maximum(t * ratio, s)
    return low, np.where(s < source, np.clip(shared, 0.0, None), 0.0) / ratio


def resample_tiles(
    tiles: DataFrame, shapes: DataFrame, keys: list[str], planes: int, kind: str, side: int = SIDE, to_kind: str | None = None
) -> DataFrame:
    """Tiles of images scaled down by block means from (from_h, from_w) to (height, width), any ratio of at least 1.

    `shapes` has one row for each image. A source tile gives each target tile it reaches its weighted part; parts of a
    target tile are added up. Integer types are rounded half to even.
    """
    to_kind = to_kind or kind
    parts_type = pa.list_(
        pa.struct([("ti", pa.int32()), ("tj", pa.int32()), ("first_i", pa.int32()), ("first_j", pa.int32()), ("rows", pa.int32()), ("part", pa.binary())])
    )

    @F.arrow_udf("array<struct<ti:int,tj:int,first_i:int,first_j:int,rows:int,part:binary>>")
    def parts(ti: pa.Array, tj: pa.Array, h: pa.Array, w: pa.Array, th: pa.Array, tw: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for i, j, fh, fw, nh, nw, raw in zip(*(c.to_pylist() for c in (ti, tj, h, w, th, tw)), _arrays(data, kind)):
            low_i, rows = _shares(i * side, side, fh, nh)
            low_j, cols = _shares(j * side, side, fw, nw)
            scaled = rows @ raw.reshape(planes, side, side).astype(np.float64) @ cols.T
            made = []
            for a in range(low_i // side, -(-(low_i + len(rows)) // side)):
                for b in range(low_j // side, -(-(low_j + len(cols)) // side)):
                    i0, i1 = max(a * side, low_i), min((a + 1) * side, low_i + len(rows))
                    j0, j1 = max(b * side, low_j), min((b + 1) * side, low_j + len(cols))
                    if i0 < i1 and j0 < j1:
                        piece = scaled[:, i0 - low_i : i1 - low_i, j0 - low_j : j1 - low_j]
                        made.append({"ti": a, "tj": b, "first_i": i0 - a * side, "first_j": j0 - b * side, "rows": i1 - i0, "part": piece.tobytes()})
            out.append(made)
        return pa.array(out, parts_type)

    @F.arrow_udf("binary")
    def added(found: pa.Array) -> pa.Array:
        out = []
        for of in found:
            data = np.zeros((planes, side, side))
            for p in of.as_py():
                piece = np.frombuffer(p["part"], np.float64).reshape(planes, p["rows"], -1)
                data[:, p["first_i"] : p["first_i"] + p["rows"], p["first_j"] : p["first_j"] + piece.shape[2]] += piece
            whole = np.rint(data) if np.issubdtype(np.dtype(to_kind), np.integer) else data
            out.append(whole.astype(to_kind).tobytes())
        return pa.array(out, pa.binary())

    placed = tiles.join(shapes.select("image_id", "from_h", "from_w", "height", "width"), "image_id")
    sent = placed.select(*keys, F.explode(parts("ti", "tj", "from_h", "from_w", "height", "width", "data")).alias("p"))
    # Sorted, so that sums do not depend on the order of arrival.
    piece = F.struct("p.first_i", "p.first_j", "p.rows", "p.part")
    gathered = sent.groupBy(*keys, F.col("p.ti").alias("ti"), F.col("p.tj").alias("tj")).agg(F.sort_array(F.collect_list(piece)).alias("f"))
    return gathered.select(*keys, "ti", "tj", added("f").alias("data"))


def patch_pieces(
    tiles: DataFrame, patches: DataFrame, keys: list[str], planes: int, kind: str, side: int = SIDE, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(keys of the patch, keys of the tile, `carry`, i0, j0, rows, piece): for each patch the parts of the tiles it covers.

    `patches` has r0, c0, r1, c1 (the far side exclusive) and one row for each patch. Only the covered part of a tile is
    sent on; (i0, j0) is its place in the patch.
    """

    @F.arrow_udf("binary")
    def cropped(i0: pa.Array, i1: pa.Array, j0: pa.Array, j1: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for a, b, c, d, raw in zip(*(x.to_pylist() for x in (i0, i1, j0, j1)), _arrays(data, kind)):
            out.append(raw.reshape(planes, side, side)[:, a:b, c:d].tobytes())
        return pa.array(out, pa.binary())

    shared = [c for c in ("image_id", "ds_fac") if c in patches.columns and c in tiles.columns]

    def reach(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / side).cast("int"), F.floor((F.col(high) - 1) / side).cast("int")))

    wanted = patches.withColumn("ti", reach("r0", "r1")).withColumn("tj", reach("c0", "c1"))
    met = tiles.join(shuffled(wanted), [*shared, "ti", "tj"])
    top, left = F.col("ti") * side, F.col("tj") * side
    i0, j0 = F.greatest("r0", top), F.greatest("c0", left)
    i1, j1 = F.least("r1", top + side), F.least("c1", left + side)
    rest = [c for c in dict.fromkeys([*shared, "patch_id", *keys, *carry]) if c in met.columns]
    return met.select(
        *rest, (i0 - F.col("r0")).cast("int").alias("i0"), (j0 - F.col("c0")).cast("int").alias("j0"), (i1 - i0).cast("int").alias("rows"),
        cropped((i0 - top).cast("int"), (i1 - top).cast("int"), (j0 - left).cast("int"), (j1 - left).cast("int"), "data").alias("piece"),
    )


def assembled(pieces: Column, planes: int, rows: int, cols: int, kind: str, maps: int = 1) -> Column:
    """Pieces ARRAY<STRUCT<map_id, i0, j0, rows, piece>> of one patch as maps x rows x cols x planes numbers; absent ones are zero."""

    @F.arrow_udf("binary")
    def joined(found: pa.Array) -> pa.Array:
        out = []
        for of in found:
            data = np.zeros((maps, planes, rows, cols), kind)
            for p in of.as_py() or ():
                piece = np.frombuffer(p["piece"], kind).reshape(planes, p["rows"], -1)
                data[p["map_id"], :, p["i0"] : p["i0"] + p["rows"], p["j0"] : p["j0"] + piece.shape[2]] = piece
            out.append(data.transpose(0, 2, 3, 1).tobytes())
        return pa.array(out, pa.binary())

    return joined(pieces)


def numbers(data: Column | str, kind: str) -> Column:
    """Binary numbers of a type as doubles."""

    @F.arrow_udf("array<double>")
    def read(raw: pa.Array) -> pa.Array:
        return pa.array([a.astype(np.float64) for a in _arrays(raw, kind)], pa.list_(pa.float64()))

    return read(data)
