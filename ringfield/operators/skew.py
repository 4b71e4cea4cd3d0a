"""Equi joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.session import scratch_path

#: Rows of one key that a task takes; a key of n rows is dealt into ceil(n / HOT_ROWS) slices.
HOT_ROWS = 500_000


def shuffled(df: DataFrame) -> DataFrame:
    """Join this side by shuffle and merge.

    Catalyst sizes a generator's output by its input. A side that was exploded
    (patches of an image, cells of a polygon) looks small enough to broadcast
    when it is not; AQE still splits skewed partitions of a merge join.
    """
    return df.hint("merge")


def salt_table(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every key that needs more than one slice and how many; written once, so that both sides read the same slices.

    It has fewer than rows / `hot_rows` keys. Catalyst knows its size from the
    files and broadcasts it or joins it by shuffle.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    path = scratch_path(df.sparkSession, "salts")
    counts.select(*on, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_slices")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    row_id: list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join `left` with `right`; rows of a hot key of `left` are spread by their id.

    The right rows of those keys alone are repeated, once per slice. `how` may
    be any type that keeps left rows (inner, left, left_semi, left_anti).
    """
    salts = salt_table(left, on, hot_rows)
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    spread = left.join(salts, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*row_id), slices).cast("int")
    )
    repeated = right.join(salts, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    joined = spread.drop("_slices").join(shuffled(repeated.drop("_slices")), [*on, "_salt"], how)
    return joined.drop("_salt")
