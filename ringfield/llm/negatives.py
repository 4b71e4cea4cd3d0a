"""Hard negatives by one-bit codes: exact results, most pairs judged by counts of equal bits.

Vectors hold integers. Each is turned by a random rotation and coded by the signs of its components: a code vector of
+-1/sqrt(d), stored with its alignment (the inner product of vector and code vector). What the code leaves over is turned
and coded again in the same way, `LEVELS` times, and the length of the last rest is stored. For each level an anchor's turned
components are rounded to `BITS` bits, so its inner products with code vectors are sums of popcounts. By Cauchy and Schwarz the
true score lies within rest * |anchor| + sum of (alignment * rounding error) of the estimate. Rows whose interval does not reach
what the k with the highest lower bounds truly score are left; the others are scored with the integers, which alone decide.

The rows are dealt into blocks by row number. An anchor travels to each block, meets its rows there and leaves with its best
few, so the anchors (a stated set) meet all rows in blocks and no task holds more than a block and a batch of anchors. Two
such passes: the first finds the positives, the second the negatives below each positive's ceiling.

Cases: rows with a null id, label or vector, with a null component, or of another length than the most frequent one (the
longer of two) take no part, nor do rows whose squared length reaches 2^55, as scores would not fit. Rows that bear the
anchor's own id are not its candidates. Repeated rows are candidates each; equal anchors (id, label, vector) count
as one. Ties go to the smaller id. Vectors of zeros score 0. Fewer candidates than asked for: all of them. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringfield.llm.text import rows_of, stored

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
LEVELS, BITS, BLOCK = 7, 8, 8192
SEED = 7
BOUND = float(2**55)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def rotations(size: int, levels: int) -> list[np.ndarray]:
    """Orthogonal matrices, the same on every worker."""
    draw = np.random.default_rng(SEED)
    found = [np.linalg.qr(draw.standard_normal((size, size))) for _ in range(levels)]
    return [q * np.sign(np.diag(r)) for q, r in found]


def padded(ints: np.ndarray) -> np.ndarray:
    """As doubles, with zeros up to a multiple of 64 components."""
    more = -ints.shape[1] % 64
    return np.pad(ints.astype(np.float64), ((0, 0), (0, more)))


def coded(ints: np.ndarray, turns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, level, word) and, for each row, its alignments and the length of the last rest."""
    rest = padded(ints)
    unit = 1 / np.sqrt(rest.shape[1])
    codes, stored_with = [], []
    for turn in turns:
        rest = rest @ turn
        signs = rest >= 0
        along = np.abs(rest).sum(1) * unit
        rest = rest - np.where(signs, unit, -unit) * along[:, None]
        codes.append(np.packbits(signs, axis=1, bitorder="little").view(np.uint64))
        stored_with.append(along)
    return np.stack(codes, 1), np.stack([*stored_with, np.linalg.norm(rest, axis=1)], 1)


class Block:
    """Rows of one block, ordered by label, with their codes by level and word."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, codes: np.ndarray, held: np.ndarray, turns: list[np.ndarray]):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.ints = ids[order], labels[order], ints[order]
        self.codes = np.ascontiguousarray(codes[order].transpose(1, 2, 0))
        self.along, self.rest = np.ascontiguousarray(held[order, :-1].T), held[order, -1]
        self.ones = np.bitwise_count(self.codes).sum(1, dtype=np.int64)
        self.turns, self.size = turns, turns[0].shape[0]

    def interval(self, anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible inner product of the anchor with each row."""
        q = padded(anchor[None])[0]
        length = np.linalg.norm(q)
        guess, width = np.zeros(len(self.ids)), self.rest * length
        for level, words in enumerate(self.codes):
            q = q @ self.turns[level]
            least, step = q.min(), (q.max() - q.min()) / (2**bits - 1) or 1.0
            steps = np.rint((q - least) / step).astype(np.int64)
            rounded = least + step * steps
            met = np.zeros(len(self.ids), np.int64)
            for j in range(bits):
                plane = np.packbits((steps >> j) & 1 == 1, bitorder="little").view(np.uint64)
                for word, mask in zip(words, plane, strict=True):
                    met += np.bitwise_count(word & mask).astype(np.int64) << j
            # Sum over set bits of the rounded components, less the sum over the others.
            signed = 2 * (least * self.ones[level] + step * met) - rounded.sum()
            guess += self.along[level] * signed / np.sqrt(self.size)
            width += self.along[level] * np.linalg.norm(q - rounded)
        # For the rounding of doubles.
        width += 1e-9 * (1 + self.along.sum(0) + self.rest) * (1 + length)
        return guess - width, guess + width

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.ints[at].astype(np.int64) @ anchor.astype(np.int64)

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, k: int, bits: int) -> list[tuple[int, int]]:
        """The block's first k (id, score) of the anchor's label."""
        low, high = self.interval(anchor, bits)
        may = (self.labels == label) & (self.ids != anchor_id)
        if may.sum() > k:
            may &= high >= self.reached(np.flatnonzero(may), low, anchor, k)
        at = np.flatnonzero(may)
        return ordered(self.ids[at], self.scores(at, anchor), k)

    def reached(self, at: np.ndarray, low: np.ndarray, anchor: np.ndarray, k: int) -> int:
        """A score that k of the rows reach: the least true score of the k with the highest lower bounds."""
        first = at[np.argpartition(-low[at], k - 1)[:k]]
        return int(self.scores(first, anchor).min())

    def negatives(
        self, anchor_id: int, label: int, anchor: np.ndarray, tops: list[int], k: int, band: tuple[int, int], bits: int
    ) -> list[list[tuple[int, int]]]:
        """For each positive score the block's first k (id, score) of other labels within the band."""
        low, high = self.interval(anchor, bits)
        other = (self.labels != label) & (self.ids != anchor_id)
        wanted = np.zeros(len(self.ids), bool)
        for top in tops:
            floor, ceiling = band[0] * top, band[1] * top
            may = other & (100 * high >= floor) & (100 * low <= ceiling)
            sure = np.flatnonzero(may & (100 * low >= floor) & (100 * high <= ceiling))
            if len(sure) > k:
                may &= high >= self.reached(sure, low, anchor, k)
            wanted |= may
        at = np.flatnonzero(wanted)
        score = self.scores(at, anchor)
        out = []
        for top in tops:
            fits = (100 * score >= band[0] * top) & (100 * score <= band[1] * top)
            out.append(ordered(self.ids[at[fits]], score[fits], k))
        return out


def ordered(ids: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
    order = np.lexsort((ids, -score))[:k]
    return list(zip(ids[order].tolist(), score[order].tolist(), strict=True))


def meet(index: DataFrame, anchors: DataFrame, blocks: int, length: int, levels: int, work, made: str) -> DataFrame:
    """`work(block, anchor row)` for each anchor in each block; it yields rows of the schema `made`.

    `anchors`: key, vec_id, label, v, tops. In a partition the rows of a block come before the anchors.
    """
    codes, held = F.lit(None).cast("binary"), F.lit(None).cast("binary")
    visits = anchors.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"kind": F.lit(1), "codes": codes, "held": held})
    names = ["b", "kind", "key", "vec_id", "label", "v", "tops", "codes", "held"]
    rows = index.withColumns({"kind": F.lit(0), "key": F.lit(None).cast("long"), "tops": F.lit(None).cast("array<struct<id:bigint,score:bigint>>")})
    dealt = rows.select(*names).unionByName(visits.select(*names)).repartitionById(blocks, "b").sortWithinPartitions("b", "kind")
    columns = [c.split()[0] for c in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, gathered, block, turns = None, [], None, None
        for part in rows_of(batches):
            out = []
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                b, kind, key, vec_id, label, v, tops, code, along = row
                if b != number:
                    number, gathered, block = b, [], None
                if kind == 0:
                    gathered.append((vec_id, label, v, code, along))
                    continue
                if not gathered:
                    continue
                if block is None:
                    turns = turns or rotations(length + -length % 64, levels)
                    ids, labels = (np.array([g[n] for g in gathered], np.int64) for n in (0, 1))
                    ints = np.frombuffer(b"".join(g[2] for g in gathered), np.int32).reshape(len(ids), length)
                    words = np.frombuffer(b"".join(g[3] for g in gathered), np.uint64).reshape(len(ids), levels, -1)
                    parts = np.frombuffer(b"".join(g[4] for g in gathered), np.float64).reshape(len(ids), -1)
                    block = Block(ids, labels, ints, words, parts, turns)
                out += work(block, key, vec_id, label, np.frombuffer(v, np.int32), tops)
            arrays = [pa.array([o[n] for o in out], pa.int64()) for n in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return dealt.mapInArrow(run, made)


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "v",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, levels: int = LEVELS,
    bits: int = BITS, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` holds arrays of integers; `anchors` is a condition on `vec_id`.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<bigint>").alias("v"))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = rows.where(whole & (squared < BOUND))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None or common[0] == 0:
        return spark.createDataFrame([], RESULT)
    length = common[0]
    rows = rows.where(F.size("v") == length)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = rotations(length + -length % 64, levels)
        for part in rows_of(batches):
            ints = part.column(2).flatten().to_numpy().reshape(-1, length).astype(np.int32)
            codes, held = coded(ints, turns)
            made = [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in (ints, codes, held)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["vec_id", "label", "v", "codes", "held"])

    shape = "vec_id bigint, label bigint, v binary, codes binary, held binary"
    index = rows.mapInArrow(code, shape).withColumn("row", F.monotonically_increasing_id())
    index = stored(index, "one-bit-codes")
    blocks = -(-index.count() // block)
    index = index.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    asked = index.where(anchors).groupBy("vec_id", "label", "v").agg(F.min("row").alias("key"))
    asked = stored(asked, "anchors")
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")

    def find_positives(held: Block, key, vec_id, label, v, tops) -> list[tuple]:
        return [(key, i, s) for i, s in held.positives(vec_id, label, v, positives, bits)]

    found = meet(index, asked.withColumn("tops", none), blocks, length, levels, find_positives, "key bigint, id bigint, score bigint")
    by_score = W.partitionBy("key").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= positives)
    tops = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("t"))
    tops = tops.select("key", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("tops"))
    asked = stored(asked.join(tops, "key"), "anchors-with-positives")

    def find_negatives(held: Block, key, vec_id, label, v, tops) -> list[tuple]:
        lists = held.negatives(vec_id, label, v, [t["score"] for t in tops], negatives, (low, high), bits)
        return [
            (key, vec_id, p, top["id"], top["score"], i, s)
            for p, (top, one) in enumerate(zip(tops, lists, strict=True)) for i, s in one
        ]

    shape = "key bigint, anchor_id bigint, p bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    met = meet(index, asked, blocks, length, levels, find_negatives, shape)
    order = W.partitionBy("key", "p").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
