"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

The two halves of a vector are quantised separately (k-means on at most `SAMPLE` distinct vectors, those of smallest hash);
a cell is a pair of centroids. Equal vectors are one entry, which keeps the smallest ids it can need (k + 1), so a vector
that fills a third of the table is searched once. A query takes centroid pairs in the order of summed distance (negative
inner products of its halves with the centroids) from a heap, until the cells hold the share `CANDIDATES` of all entries.
Entries are dealt by first centroid and split into blocks of about `BLOCK` rows; a query travels once to each block with
its list of cells. In a partition a block's entries come first, queries stream past them, and scores are recomputed in
double precision, summed in a fixed order. The number of centroids grows with the root of the table up to `MOST` a half,
so the broadcast index (cell sizes) is bounded.

Cases: vectors that are null, zero, of another length than the most frequent one (the longer of two), or hold null or
non-finite components take no part; other columns are ignored; fewer candidates than k: all of them; ties go to the smaller id; repeated ids are entries of
their own and only a query's own id is left out; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringfield.llm.text import rows_of, stored

K = 20
SAMPLE = 20_000
MOST = 1024
PER_CELL = 16
#: A query looks at this share of the entries, and at `LEAST` of them at any rate. On vectors without clusters less than
#: half of the entries does not reach a recall of 0.9.
CANDIDATES = 0.5
LEAST = 4000
BLOCK = 8192
ROUNDS = 8


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, axis=1)


def kmeans(points: np.ndarray, k: int) -> np.ndarray:
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        at = nearest(points, centres)
        counts = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def cells_of(query: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, wanted: int) -> dict[int, list[int]]:
    """Second centroids by first centroid, in cells that together hold `wanted` entries; nearest pairs first."""
    h = one.shape[1]
    a, b = -(one @ query[:h]), -(two @ query[h:])
    ra, rb = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, got = [(a[ra[0]] + b[rb[0]], 0, 0)], 0
    out: dict[int, list[int]] = {}
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        held = int(sizes[ra[i], rb[j]])
        if held:
            out.setdefault(int(ra[i]), []).append(int(rb[j]))
            got += held
        if j + 1 < len(rb):
            heapq.heappush(heap, (a[ra[i]] + b[rb[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(ra):
            heapq.heappush(heap, (a[ra[i + 1]] + b[rb[0]], i + 1, 0))
    return out


def search(table: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, candidates: float = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score); `queries` is a condition on `vec_id`."""
    spark = table.sparkSession

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            ids, raw = [], []
            for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if i is None or not v or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    narrow = (x + 0.0).astype(np.float32)
                    ids.append(i)
                    raw.append((b"f" + narrow.tobytes()) if (narrow == x).all() else (b"d" + (x + 0.0).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "v"])

    rows = stored(table.select(F.col(id_col).cast("long"), vector_col).mapInArrow(clean, "vec_id bigint, v binary"), "vectors")
    length = F.expr("(octet_length(v) - 1) DIV IF(substring(v, 1, 1) = X'66', 4, 8)")
    common = rows.groupBy(length.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is not None:
        rows = rows.where(length == common[0])
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = top.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stored(entries.withColumn("e", F.col("ids")[0]), "vector-entries")
    total = entries.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], out)
    sample = np.array([decoded(r[0]) for r in entries.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()])
    wanted = max(LEAST, int(candidates * total) + 1)
    c = int(min(MOST, len(sample), max(1, round((total / PER_CELL) ** 0.5))))
    h = max(1, sample.shape[1] // 2)
    one, two = kmeans(sample[:, :h], c), kmeans(sample[:, h:], c)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            x = np.array([decoded(v) for v in part.column(0).to_pylist()])
            cells = nearest(x[:, :h], one), nearest(x[:, h:], two)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[0]), pa.array(cells[1])], ["v", "ids", "e", "i", "j"])

    placed = stored(entries.select("v", "ids", "e").mapInArrow(place, "v binary, ids array<bigint>, e bigint, i bigint, j bigint"), "vector-cells")
    sizes = np.zeros((c, c), np.int64)
    for r in placed.groupBy("i", "j").count().collect():  # at most MOST squared
        sizes[r[0], r[1]] = r[2]
    blocks = np.maximum(1, -(-sizes.sum(1) // BLOCK))
    held = spark.sparkContext.broadcast((one, two, sizes, blocks))
    of = F.element_at(F.lit(blocks.tolist()), (F.col("i") + 1).cast("int"))
    index = placed.select("i", F.pmod(F.xxhash64("e"), of).alias("b"), F.lit(0).alias("kind"), "e", "v", F.array("j").alias("cells"))
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "v")
    distinct = asked.select("v").distinct().join(placed.select("v", "e"), "v")

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, sizes, blocks = held.value
        for part in rows_of(batches, 1 << 19):
            made = []
            for v, e in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for i, js in cells_of(decoded(v), one, two, sizes, wanted).items():
                    made += [(i, b, 1, e, v, js) for b in range(int(blocks[i]))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([m[n] for m in made], t) for n, t in enumerate(kinds)], ["i", "b", "kind", "e", "v", "cells"])

    shape = "i bigint, b bigint, kind int, e bigint, v binary, cells array<bigint>"
    both = index.unionByName(distinct.select("v", "e").mapInArrow(travel, shape))
    dealt = both.repartition("i", "b").sortWithinPartitions("i", "b", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, where = None, [], [], []
        grid = names = cells = longest = None
        for part in rows_of(batches):
            made: list[tuple[int, int, float]] = []
            for i, b, kind, e, v, js in zip(*(part.column(n).to_pylist() for n in range(6)), strict=True):
                if (i, b) != block:
                    block, ids, vectors, where, grid = (i, b), [], [], [], None
                if kind == 0:
                    ids.append(e)
                    vectors.append(decoded(v))
                    where.append(js[0])
                    continue
                if not ids:
                    continue
                if grid is None:
                    grid, names, cells = np.array(vectors), np.array(ids), np.array(where)
                    longest = np.linalg.norm(grid, axis=1).max()
                at = np.flatnonzero(np.isin(cells, js))
                q = decoded(v)
                rough = grid[at] @ q
                if len(at) > k + 1:
                    # All that rounding may have put behind the last one asked for, ties included; exact sums decide.
                    margin = 4 * len(q) * np.finfo(float).eps * longest * np.linalg.norm(q)
                    at = at[~(rough < -np.partition(-rough, k)[k] - margin)]
                exact = (grid[at] * q).sum(1)
                order = np.lexsort((names[at], -exact))[: k + 1]
                made += [(e, int(names[at[o]]), float(exact[o])) for o in order]
            kinds = [pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([m[n] for m in made], t) for n, t in enumerate(kinds)], ["q", "e", "score"])

    found = dealt.mapInArrow(meet, "q bigint, e bigint, score double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "e"))).where(F.col("r") <= k + 1)
    ids = placed.select("e", "ids", "v")
    named = best.join(ids.select("e", "ids"), "e").select("q", F.explode("ids").alias("vec_id"), "score")
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("hits"))
    lists = stored(lists.join(ids.select(F.col("e").alias("q"), "v"), "q").select("v", "hits"), "vector-hits")
    mine = asked.join(lists, "v").select("query_id", F.filter("hits", lambda x: x["vec_id"] != F.col("query_id")).alias("hits"))
    flat = mine.select("query_id", F.posexplode(F.slice("hits", 1, k)).alias("p", "x"))
    return flat.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def decoded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], np.float32 if raw[:1] == b"f" else np.float64).astype(np.float64)
