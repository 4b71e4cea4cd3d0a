"""Words of a text, shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes of UTF-8: A-Z in lower case, other ASCII characters but digits and letters become spaces, the rest stays.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
# A-Z in lower case, nothing else changes.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
ALNUM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def alnum_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8; none of null."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8; none of null."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def folded(text: Column) -> Column:
    """A-Z in lower case, in the JVM."""
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for inner use that no column of `df` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: a result that several later steps use, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most_bytes`, so that a task holds the words of few documents at once."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def added(
    df: DataFrame, names: list[str], types: list[str], work: Callable[[pa.RecordBatch], list[pa.Array]]
) -> DataFrame:
    """`df` with columns that `work` makes from each slice of a batch; rows and their order stay."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = f"{fields}, " + ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *work(part)], [*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def repeat_lengths(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    total = int(lengths.sum())
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(total) - starts
