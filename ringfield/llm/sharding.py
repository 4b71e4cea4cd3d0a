"""Shards in random order by a two-pass external shuffle.

The first pass scatters the rows over buckets by a seeded hash of all their columns; there are as many buckets as make each
about `BUCKET` bytes of text, which a task can hold. The second pass takes one bucket after the other, shuffles it by Fisher
and Yates with a seed made of the given seed and the bucket's number, and writes its rows to their shards. The order of
the whole table is bucket after bucket, and a shard is a run of it, so shards differ by one row at most, and a task
writes to few of them. Buckets are counted before the scatter (combined in the map tasks), which gives each its first place.

Rows that are equal in every column hash alike. Those with more than a quarter of a bucket's rows are folded to one row and
their number, and their copies are dealt one by one, by copy number; everything else is scattered as it is.

Cases: null and empty texts are rows like others. The order within a bucket is settled before the shuffle (by a second
hash; what still ties is equal in every column that can be hashed), so a task that runs again writes the same rows, and the
result depends on rows, seed and bucket size alone. Fewer rows than shards leave the last shards empty; an empty table gives
no rows. A text longer than a bucket is held whole. Columns named like the two result columns are left out. Columns of a
type that cannot be hashed (maps) do not decide. The table is read four times, so it should be stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringfield.llm.text import fresh, stored
from ringfield.session import scratch_path

SEED = 20_240
#: Bytes of text in a bucket, and the least number of buckets, so that small tables use several tasks.
BUCKET, LEAST = 64 << 20, 16
#: Copies that one task unfolds; buckets whose counts are summed by one task.
UNFOLD, GROUP = 10_000, 4096
#: Bytes of a batch that a task gives out.
BATCH = 4 << 20


def hashable(docs: DataFrame) -> list[str]:
    return [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]


def hashed(docs: DataFrame, seed: int, *more: Column) -> Column:
    return F.xxhash64(F.lit(seed), *more, *hashable(docs))


def spread(docs: DataFrame, seed: int, buckets: int, bucket: str, h: str, rows: int) -> DataFrame:
    """The rows with their bucket; crowds of equal rows are dealt copy by copy."""
    at = docs.withColumn(h, hashed(docs, seed))
    plain = at.withColumn(bucket, F.pmod(h, F.lit(buckets)).cast("int"))
    most = max(1, rows // (4 * buckets))
    sizes = plain.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    # Only a bucket of more than twice its share can hold a crowd that matters; most tables have none.
    if not rows or sizes.where(F.col("n") > 2 * (rows // buckets) + 64).isEmpty():
        return plain
    copies, block = fresh(plain, "copies", "block")
    crowds = at.groupBy(h).agg(F.count(F.lit(1)).alias(copies)).where(F.col(copies) > most)
    crowds = stored(crowds, "crowds")  # at most 4 for each bucket
    keys = hashable(docs)
    others = [F.first(c).alias(c) for c in docs.columns if c not in keys]
    folded = at.join(crowds.select(h), h, "left_semi").groupBy(h, *keys).agg(F.count(F.lit(1)).alias(copies), *others)
    blocks = folded.withColumn(block, F.explode(F.sequence(F.lit(0), F.expr(f"(`{copies}` - 1) div {UNFOLD}"))))
    blocks = blocks.repartition(h, block)
    first = F.col(block) * UNFOLD
    last = F.least(first + UNFOLD, F.col(copies)) - 1
    dealt = blocks.withColumn(copies, F.explode(F.sequence(first, last)))
    dealt = dealt.withColumn(h, hashed(docs, seed, F.col(copies)))
    dealt = dealt.withColumn(bucket, F.pmod(h, F.lit(buckets)).cast("int")).select(*plain.columns)
    return plain.join(crowds.select(h), h, "left_anti").select(*plain.columns).unionByName(dealt)


def first_places(sizes: DataFrame, bucket: str, name: str) -> DataFrame:
    """(bucket, name): rows in earlier buckets, summed in groups of buckets and over the groups."""
    group = F.expr(f"`{bucket}` div {GROUP}")
    placed = sizes.withColumn("g", group)
    before = W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("g").agg(F.sum("n").alias("all")).select("g", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("g").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    counted = placed.withColumn("here", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "g")
    return counted.select(bucket, (F.col("start") + F.col("here")).alias(name))


def shard(
    docs: DataFrame, shards: int, path: str | None = None, text_col: str = "text", seed: int = SEED,
    bucket_bytes: int = BUCKET, shard_as: str = "shard", slot_as: str = "slot",
) -> DataFrame:
    """Write the shuffled rows below `path` (default: a new folder below the shared one), a folder a shard, and read them.

    `shard_as`: 0 to shards - 1. `slot_as`: the place in the shard, from 0 without gaps; files hold rows in its order.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c.lower() not in {shard_as.lower(), slot_as.lower()}]
    docs = docs.select(*columns)
    bucket, h, tie, start = fresh(docs, "bucket", "hash", "tie", "start")
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    buckets = max(LEAST, -(-size // bucket_bytes))
    at = spread(docs, seed, buckets, bucket, h, rows)
    sizes = at.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    starts = stored(first_places(sizes, bucket, start), "bucket-starts")
    order = at.join(starts, bucket).withColumn(tie, hashed(docs, seed + 1))
    dealt = order.repartitionById(buckets, bucket).sortWithinPartitions(bucket, h, tie)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    each, longer = divmod(rows, shards)

    def shuffled(held: pa.Table) -> Iterator[pa.RecordBatch]:
        number, first = held.column(bucket)[0].as_py(), held.column(start)[0].as_py()
        # numpy's permutation is the Fisher-Yates shuffle of 0..n-1.
        turn = np.random.default_rng([seed, number]).permutation(held.num_rows)
        place = first + np.arange(held.num_rows)
        edge = longer * (each + 1)
        late = longer + (place - edge) // max(1, each)
        which = np.where(place < edge, place // (each + 1), late)
        slot = place - np.where(which < longer, which * (each + 1), edge + (which - longer) * each)
        texts = held.select(columns)
        step = max(1, int(held.num_rows * BATCH / max(1, held.nbytes)))
        for a in range(0, held.num_rows, step):
            part = texts.take(turn[a : a + step])
            part = part.append_column(shard_as, pa.array(which[a : a + step], pa.int32()))
            part = part.append_column(slot_as, pa.array(slot[a : a + step], pa.int64()))
            yield from part.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(batch.schema.get_field_index(bucket)).to_numpy()
            ends = [*(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            at = 0
            for end in ends:
                part = batch.slice(at, end - at)
                if held and held[0].column(bucket)[0].as_py() != numbers[at]:
                    yield from shuffled(pa.Table.from_batches(held))
                    held = []
                held.append(part)
                at = end
        if held:
            yield from shuffled(pa.Table.from_batches(held))

    done = dealt.select(*columns, bucket, start).mapInArrow(run, f"{fields}, `{shard_as}` int, `{slot_as}` bigint")
    path = path or scratch_path(spark, "shards")
    done.sortWithinPartitions(shard_as, slot_as).write.partitionBy(shard_as).parquet(path)
    # A folder a shard, of which an empty table has none: the layout is told, not guessed.
    return spark.read.schema(done.schema).parquet(path).select(*done.columns)
