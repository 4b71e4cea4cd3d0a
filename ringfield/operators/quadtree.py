"""An adaptive tile index for joins of things that lie near each other.

Tiles form a quadtree. A thing (a box, or the vertices of a ring) lives on a level whose tiles are not smaller than itself:
big boxes stay in upper nodes and reach four tiles there at most, instead of hundreds of small ones. Level 0 has tiles of
`size`; below it only tiles that hold more than `most` things of one side are split, level by level, and small things move down.
On its way to the tile it lives in, a thing visits the nodes above. Two things meet in a node where one of them lives and the
other lives or visits; of those nodes over any one point exactly one is such, so a pair is found once for each point asked.

Things that pile up in one place cannot be told apart by splitting. A node of n and m things that is still above `most`
is cut into ceil(n / most) by ceil(m / most) pairs of slices, so no task is given more than about `most` rows of either side of a
node, however many lie on one spot.

What is counted are rows for each tile, combined before the shuffle. Tables of crowded nodes have fewer rows than there are
things / `most`; they are written once, so that both sides read the same tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringfield.functions.near_boxes import meeting
from ringfield.operators.skew import HOT_ROWS, shuffled
from ringfield.session import cut_lineage, scratch_path

#: Splits below level 0, and levels above it, each of twice the side.
DEPTH, HEIGHT = 6, 40


def bucket(value: Column, side: Column | float) -> Column:
    return F.floor(value / (side if isinstance(side, Column) else F.lit(float(side)))).cast("int")


def box_tiles(r0: str, c0: str, r1: str, c1: str) -> Callable[[float], Column]:
    """Tiles of a side that a box reaches."""

    def tiles(side: float) -> Column:
        rows = F.sequence(bucket(F.col(r0), side), bucket(F.col(r1), side))
        cols = F.sequence(bucket(F.col(c0), side), bucket(F.col(c1), side))
        return F.flatten(F.transform(rows, lambda i: F.transform(cols, lambda j: F.struct(i.alias("bi"), j.alias("bj")))))

    return tiles


def box_spans(r0: str, c0: str, r1: str, c1: str) -> Callable[[float], list[Column]]:
    """First and last row and column of the tiles of a side that a box reaches."""
    return lambda side: [bucket(F.col(c), side) for c in (r0, r1, c0, c1)]


def ring_tiles(ring: str) -> Callable[[float], Column]:
    """Tiles of a side that hold a vertex."""

    def tiles(side: float) -> Column:
        return F.array_distinct(
            F.transform(ring, lambda p: F.struct(bucket(p["i"], side).alias("bi"), bucket(p["j"], side).alias("bj")))
        )

    return tiles


@dataclass(frozen=True)
class Things:
    """One side of a join: its rows, the tiles a row reaches, its extent (0: a set of points) and what tells rows apart."""

    rows: DataFrame
    tiles: Callable[[float], Column]
    extent: Column
    row_id: list[str]


def _side(level: int, size: float) -> float:
    return size / 2.0**level


def _levelled(things: Things, size: float, depth: int) -> DataFrame:
    """Adds `_lv`, the lowest level on which the row may live."""
    fits = F.floor(F.log2(F.lit(float(size)) / things.extent))
    level = F.when(things.extent > 0, F.least(F.greatest(fits, F.lit(-HEIGHT)), F.lit(depth))).otherwise(F.lit(depth))
    return things.rows.withColumn("_lv", level.cast("int"))


def _node(level: int, tiles: Column, lives: Column | bool) -> Column:
    live = lives if isinstance(lives, Column) else F.lit(lives)
    return F.transform(
        tiles, lambda t: F.struct(F.lit(level).alias("lv"), t["bi"].alias("bi"), t["bj"].alias("bj"), live.alias("lives"))
    )


def _upper(levelled: DataFrame, things: Things, upper: list[int], size: float) -> DataFrame:
    """A row for each node of level 0 and of the upper levels in use; small rows visit the latter."""
    nothing = F.array().cast("array<struct<lv:int,bi:int,bj:int,lives:boolean>>")
    lv = F.col("_lv")
    parts = [F.when(lv >= u, _node(u, things.tiles(_side(u, size)), lv == u)).otherwise(nothing) for u in upper]
    parts.append(F.when(lv >= 0, _node(0, things.tiles(size), True)).otherwise(nothing))
    return levelled.withColumn("_n", F.explode(F.concat(*parts))).select(
        *levelled.columns, F.col("_n.lv").alias("lv"), F.col("_n.bi").alias("bi"), F.col("_n.bj").alias("bj"), F.col("_n.lives").alias("lives")
    )


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _both_counts(left: DataFrame, right: DataFrame, at: list[str]) -> DataFrame:
    """Rows of either side for each key."""
    one = left.select(*at, F.lit(1).alias("l"), F.lit(0).alias("r"))
    two = right.select(*at, F.lit(0).alias("l"), F.lit(1).alias("r"))
    return one.unionByName(two).groupBy(*at).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def dealt(
    left: Things, right: Things, keys: list[str], size: float = 64, most: int = HOT_ROWS, depth: int = DEPTH
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with one row for each place where they may meet, and the columns on which they do.

    Added columns: `lv`, `bi`, `bj` (the node), `part` (0: the left row lives there, 1: it visits) and, where a node is
    crowded, the slices. Columns of either side must not bear these names.
    """
    tile = [*keys, "lv", "bi", "bj"]
    sides = [_levelled(t, size, depth) for t in (left, right)]
    # First look: which upper levels are lived on, and which tiles of level 0 are crowded.
    seen = [_upper_seen(df, t, keys, size) for df, t in zip(sides, (left, right), strict=True)]
    first = _both_counts(*seen, tile).where((F.col("lv") < 0) | (F.col("l") > most) | (F.col("r") > most))
    first = _written(first.select(*tile), "crowded-tiles")
    upper = sorted(r[0] for r in first.where("lv < 0").select("lv").distinct().collect())  # HEIGHT values at most
    crowded = first.where("lv = 0")
    placed = [_upper(df, t, upper, size) for df, t in zip(sides, (left, right), strict=True)]
    if crowded.isEmpty():
        if not upper:
            out = [p.drop("_lv", "lives").withColumn("part", F.lit(0)) for p in placed]
            return out[0], out[1], [*tile, "part"]
        split = [p.withColumn("cut", F.col("lv") < 0) for p in placed]
    else:
        split = _descend(placed, (left, right), keys, crowded, size, most, depth)
    met = [_parted(split[0], True), _parted(split[1], False)]
    return _sliced(met[0], met[1], left.row_id, right.row_id, [*tile, "part"], most)


def _upper_seen(levelled: DataFrame, things: Things, keys: list[str], size: float) -> DataFrame:
    """Tiles of level 0, or just the level for rows that live above."""
    above = F.array(F.struct(F.col("_lv").alias("lv"), F.lit(0).alias("bi"), F.lit(0).alias("bj")))
    here = F.transform(things.tiles(size), lambda t: F.struct(F.lit(0).alias("lv"), t["bi"].alias("bi"), t["bj"].alias("bj")))
    return levelled.select(*keys, F.explode(F.when(F.col("_lv") < 0, above).otherwise(here)).alias("n")).select(*keys, "n.*")


def _descend(
    placed: list[DataFrame], things: tuple[Things, Things], keys: list[str], crowded: DataFrame, size: float, most: int, depth: int
) -> list[DataFrame]:
    """Move small rows of crowded tiles down, one level after the other; `cut` marks nodes with something below."""
    done: list[list[DataFrame]] = [[], []]
    at = [p.where("lv = 0") for p in placed]
    for n in range(2):
        done[n].append(placed[n].where("lv < 0").withColumn("cut", F.lit(True)))
    tile = [*keys, "lv", "bi", "bj"]
    for level in range(depth + 1):
        marked = [df.join(crowded.withColumn("cut", F.lit(True)), tile, "left").withColumn("cut", F.coalesce("cut", F.lit(False))) for df in at]
        if level == depth:
            for n in range(2):
                done[n].append(marked[n].withColumn("cut", F.lit(False)))
            break
        goes = F.col("cut") & (F.col("_lv") > level)
        for n in range(2):
            done[n].append(marked[n].withColumn("lives", ~goes))
        below = []
        for n, side in enumerate(things):
            inside = F.filter(
                side.tiles(_side(level + 1, size)),
                lambda t: (F.floor(t["bi"] / 2) == F.col("bi")) & (F.floor(t["bj"] / 2) == F.col("bj")),
            )
            plain = [c for c in marked[n].columns if c not in ("lv", "bi", "bj", "cut")]
            down = marked[n].where(goes).withColumn("_t", F.explode(inside))
            below.append(cut_lineage(down.select(*plain, F.lit(level + 1).alias("lv"), F.col("_t.bi").alias("bi"), F.col("_t.bj").alias("bj"))))
        at = below
        counts = _both_counts(at[0], at[1], tile)
        crowded = _written(counts.where((F.col("l") > most) | (F.col("r") > most)).select(*tile), "crowded-tiles")
        if crowded.isEmpty():
            for n in range(2):
                done[n].append(at[n].withColumn("cut", F.lit(False)))
            break
    out = []
    for parts in done:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        out.append(whole)
    return out


def _parted(df: DataFrame, is_left: bool) -> DataFrame:
    """Part 0 holds what meets left rows that live in the node, part 1 what meets left rows that visit it."""
    if is_left:
        return df.withColumn("part", F.when(F.col("lives"), 0).otherwise(1)).drop("lives", "cut", "_lv")
    both = F.when(F.col("lives") & F.col("cut"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("part", F.explode(both)).drop("lives", "cut", "_lv")


def _sliced(
    left: DataFrame, right: DataFrame, left_id: list[str], right_id: list[str], on: list[str], most: int
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cut the pairs of crowded nodes into a grid of slices."""
    counts = _both_counts(left, right, on)
    slices = [F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int").alias(f"_{c}s") for c in ("l", "r")]
    grid = counts.where((F.col("l") > most) | (F.col("r") > most)).select(*on, *slices)
    grid = _written(grid, "slices")
    if grid.isEmpty():
        return left, right, on

    def slice_of(df: DataFrame, ids: list[str], own: str, other: str, mine: str, theirs: str) -> DataFrame:
        known = df.join(grid, on, "left")
        own_slice = F.pmod(F.xxhash64(*ids), F.coalesce(own, F.lit(1))).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return known.withColumn(mine, own_slice).withColumn(theirs, others).drop("_ls", "_rs")

    one = slice_of(left, left_id, "_ls", "_rs", "ls", "rs")
    two = slice_of(right, right_id, "_rs", "_ls", "rs", "ls")
    return one, two, [*on, "ls", "rs"]


#: Levels whose tiles are counted in one pass.
LEVELS = 3


def _reached(levelled: DataFrame, spans: Callable[[float], list[Column]], levels: list[int], size: float, above: bool = False) -> DataFrame:
    """A row for each tile of `levels` that a row reaches where it may live or go further down; `above` adds one for rows of upper levels."""
    ends = ("_r0", "_r1", "_c0", "_c1")

    def span(lv: Column, parts: list[Column]) -> Column:
        return F.struct(lv.alias("lv"), *[p.alias(n) for p, n in zip(parts, ends)])

    lv = F.col("_lv")
    found = [F.when(lv >= n, span(F.lit(n), spans(_side(n, size)))) for n in levels]
    if above:
        found.append(F.when(lv < 0, span(lv, [F.lit(0)] * 4)))
    rows = levelled.withColumn("_s", F.explode(F.array(*found))).where("_s IS NOT NULL").select(*levelled.columns, "_s.*")
    rows = rows.withColumn("bi", F.explode(F.sequence("_r0", "_r1"))).withColumn("bj", F.explode(F.sequence("_c0", "_c1")))
    return rows.drop(*ends)


#: Roles of a row in a cell: its pairs are those of a left or `BOTH` row with a right or `BOTH` one.
LEFT, RIGHT, BOTH = 0, 1, 2


def _crowded(
    levelled: DataFrame, spans: Callable[[float], list[Column]], keys: list[str], size: float, most: int, depth: int
) -> tuple[DataFrame | None, int, list[int]]:
    """Tiles of levels 0 to `depth` - 1 that rows are moved down from, the lowest level with one (-1: none), upper levels lived on.

    A crowded tile lies in a crowded one, so levels are counted together; rows are counted where they may live or go further down.
    """
    tile = [*keys, "lv", "bi", "bj"]
    found, upper, lowest = None, [], -1
    for first in range(0, max(1, depth), LEVELS):
        levels = list(range(first, min(first + LEVELS, depth)))
        seen = _reached(levelled, spans, levels, size, above=not first).select(*tile)
        counts = seen.groupBy(*tile).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.when(F.col("lv") < 0, 0).otherwise(most))
        part = _written(counts.select(*tile), "crowded-tiles")
        used = sorted(r[0] for r in part.select("lv").distinct().collect())  # HEIGHT + LEVELS values at most
        upper += [n for n in used if n < 0]
        if not used or used[-1] < 0:
            break
        cut = part.where("lv >= 0")
        found, lowest = cut if found is None else found.unionByName(cut), used[-1]
        if lowest < levels[-1]:
            break
    return found, lowest, upper


def dealt_once(
    things: Things, spans: Callable[[float], list[Column]], keys: list[str], size: float = 64, most: int = HOT_ROWS, depth: int = DEPTH
) -> tuple[DataFrame, list[str]]:
    """Rows of one set, boxes that reach the tiles of `spans`, by the cells in which its pairs meet, with their role `_side`, and the columns that name a cell.

    The nodes are those of `dealt` for a set and itself, but each row is placed once for both sides and nothing is stored on the way but
    crowded tiles. Rows that visit a node are told apart from those that live there, as two visitors do not meet in it. A node of more
    than `most` rows of a kind is cut into pairs of slices.
    """
    tile = [*keys, "lv", "bi", "bj"]
    levelled = _levelled(things, size, depth)
    cuts, lowest, upper = _crowded(levelled, spans, keys, size, most, depth)
    rows = _reached(levelled, spans, [*upper, *range(lowest + 2)], size)
    rows = rows.withColumn("lives", F.col("_lv") == F.col("lv")).drop("_lv")
    names = ["_kind", "_p", "_q"]
    if cuts is None and not upper:
        return rows.drop("lives").withColumns({**{n: F.lit(0) for n in names}, "_side": F.lit(BOTH)}), [*tile, *names]
    if cuts is None:
        rows = rows.withColumn("lives", F.col("lives") | (F.col("lv") >= 0))
    else:
        rows = rows.join(cuts.withColumn("_cut", F.lit(True)), tile, "left")
        over = cuts.select(*keys, (F.col("lv") + 1).alias("lv"), F.col("bi").alias("_bi"), F.col("bj").alias("_bj"), F.lit(True).alias("_in"))
        rows = rows.withColumns({f"_{c}": F.floor(F.col(c) / 2).cast("int") for c in ("bi", "bj")}).join(over, [*keys, "lv", "_bi", "_bj"], "left")
        lives = F.col("lives") | ((F.col("lv") >= 0) & F.col("_cut").isNull())
        rows = rows.where((F.col("lv") <= 0) | F.col("_in")).withColumn("lives", lives).drop("_cut", "_in", "_bi", "_bj")
    counts = rows.groupBy(*tile).agg(F.count_if("lives").alias("_l"), F.count_if(~F.col("lives")).alias("_v"))
    nodes = _written(counts.where((F.col("_l") > most) | (F.col("_v") > 0)), "shared-nodes")
    rows = rows.join(nodes, tile, "left")
    own_l, own_v = (F.pmod(F.xxhash64(*things.row_id), F.greatest(F.lit(1), F.ceil(F.col(c) / most))).cast("int") for c in ("_l", "_v"))

    def cell(kind: int, p: Column | int, q: Column | int, role: Column | int) -> Column:
        values = [v if isinstance(v, Column) else F.lit(v) for v in (kind, p, q, role)]
        return F.struct(*[v.cast("int").alias(n) for v, n in zip(values, [*names, "_side"])])

    def slices(column: str) -> Column:
        return F.sequence(F.lit(1), F.ceil(F.col(column) / most).cast("int"))

    def within(n: Column) -> Column:
        return cell(0, F.least(own_l, n - 1), F.greatest(own_l, n - 1), F.when(own_l == n - 1, BOTH).when(own_l < n - 1, LEFT).otherwise(RIGHT))

    none = F.array().cast("array<struct<_kind:int,_p:int,_q:int,_side:int>>")
    visited = F.when(F.col("_v") > 0, F.transform(slices("_v"), lambda n: cell(1, own_l, n - 1, LEFT))).otherwise(none)
    cells = (
        F.when(F.col("_l").isNull(), F.array(cell(0, 0, 0, BOTH)))
        .when(F.col("_l") == 0, none)
        .when((F.col("_l") <= most) & (F.col("_v") <= most), F.array(cell(0, 0, 0, F.when(F.col("lives"), BOTH).otherwise(RIGHT))))
        .when(F.col("lives"), F.concat(F.transform(slices("_l"), within), visited))
        .otherwise(F.transform(slices("_l"), lambda n: cell(1, n - 1, own_v, RIGHT)))
    )
    rows = rows.withColumn("_c", F.explode(cells)).select(*things.rows.columns, "lv", "bi", "bj", "_c.*")
    return rows, [*tile, *names]


def told(rows: DataFrame, on: list[str], tell: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """What `tell` finds in each cell, that is in the rows of the same `on`; a task holds one cell at a time."""
    placed = rows.repartition(*on).sortWithinPartitions(*on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if held is None or not held.num_rows:
                continue
            new = np.zeros(held.num_rows - 1, bool)
            for name in on:
                values = held[name].combine_chunks()
                new |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
            start = 0
            for end in [*(np.flatnonzero(new) + 1).tolist(), *([held.num_rows] if batch is None else [])]:
                yield from tell(held.slice(start, end - start).combine_chunks())
                start = end
            held = held.slice(start)

    return placed.mapInArrow(run, schema)


def boxes_of(cell: pa.Table) -> np.ndarray:
    return np.array([cell[c].to_numpy() for c in ("r0", "c0", "r1", "c1")], float)


#: Pairs of a cell that are handed on at once, about.
HANDED = 1 << 15


def met(cell: pa.Table, boxes: np.ndarray, size: float, touching: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (i, j) of a cell whose boxes meet with the near corner of the common box in its node, and whether they also come as (j, i)."""
    role = cell["_side"].to_numpy()
    side = size / 2.0 ** cell["lv"][0].as_py()
    at = cell["bi"][0].as_py(), cell["bj"][0].as_py()
    whole = (role == BOTH).all()
    if whole:
        pairs = meeting(boxes, None, touching)
    else:
        left, right = np.flatnonzero(role != RIGHT), np.flatnonzero(role != LEFT)
        pairs = ((left[p], right[q]) for p, q in meeting(boxes[:, left], boxes[:, right], touching))
    held, many = [], 0
    for pair in chain(pairs, [None]):
        if pair is not None:
            held.append(pair)
            many += len(pair[0])
        if many and (pair is None or many >= HANDED):
            i, j = (np.concatenate(x) for x in zip(*held))
            held, many = [], 0
            here = [np.floor(np.maximum(boxes[n, i], boxes[n, j]) / side) == at[n] for n in (0, 1)]
            kept = here[0] & here[1]
            i, j = i[kept], j[kept]
            yield i, j, np.zeros(len(i), bool) if whole else (role[i] == BOTH) & (role[j] == BOTH)


def in_order(i: np.ndarray, j: np.ndarray, twice: np.ndarray, less: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, the row that is `less` first; pairs that are neither less nor more are dropped."""
    kept = less | (more & ~twice)
    turned = more[kept]
    i, j = i[kept], j[kept]
    return np.where(turned, j, i), np.where(turned, i, j)


def tile_side(size: float) -> Column:
    """Side of the tiles of a node's level."""
    return F.lit(float(size)) / F.pow(F.lit(2.0), F.col("lv"))


def home(size: float, i: Column, j: Column) -> Column:
    """True in the one node, of those in which a pair meets, that holds the point."""
    side = tile_side(size)
    return (bucket(i, side) == F.col("bi")) & (bucket(j, side) == F.col("bj"))


def near_join(
    left: Things, right: Things, keys: list[str], condition: Column, how: str = "inner", size: float = 64,
    most: int = HOT_ROWS, depth: int = DEPTH,
) -> DataFrame:
    """Rows that meet in a node and fulfil `condition`, which may use the node (see `home`).

    `how` is inner or left_semi. A semi join ends with the first hit of a left row in each of its nodes and slices, so its rows may repeat.
    Columns of both sides, but for `keys`, must differ.
    """
    one, two, on = dealt(left, right, keys, size, most, depth)
    added = [c for c in on if c not in keys]
    theirs = two.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in two.columns])
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    for equal in same:
        condition = equal & condition
    joined = one.join(shuffled(theirs), condition, how)
    return joined.drop(*[f"_{c}" for c in on], *[c for c in added if c not in ("lv", "bi", "bj")])
