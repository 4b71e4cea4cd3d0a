"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text becomes a sparse vector: runs of letters, of digits and of other signs are its words. Words (A-Z lower-cased) and
pairs of neighbours are hashed into `SLOTS` slots, their counts dampened by a logarithm; the shapes of words (capitals,
digits, signs) and pairs of them have slots of their own. Each part is scaled to length one. The labelled rows (at most `most_rows`, the ones of smallest hash,
picked by id before texts are read) are dealt into `SHARDS` shards; each shard runs FTRL-proximal for `EPOCHS` passes in one task, and the weights are averaged per slot
by a grouped sum. The weights are bounded by `SLOTS`, so they may be broadcast; scoring is a sparse dot product.

Cases: null and empty texts have only the bias and are scored like any other; a missing or empty label table gives the
score 0.5; null labels and labelled rows without document are left out; repeated rows are scored each by itself and a
repeated labelled row counts as often as it stands; other columns are carried along, but for one named like the score. Rows of
equal hash are taken in the order of id and label. A very long text is one sparse vector of at most `SLOTS` entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfield.llm.text import added, rows_of, stored

SLOTS = 1 << 18
SHARDS = 6
EPOCHS = 6
MOST_ROWS = 20_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
THRESHOLD = 0.7
WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
#: The slot that every text has.
BIAS = 0
#: Slots below this one belong to the bias and the shapes.
FIRST = 1 + 8 + 64
CACHED = 200_000


def shape(word: bytes) -> int:
    """0: digits, 1-4: letters (lower, capital first, capitals, mixed), 5-7: signs (one, two, more)."""
    if word[:1].isdigit():
        return 0
    if word[0] < 0x80 and not word[:1].isalpha():
        return 4 + min(3, len(word))
    if word.islower():
        return 1
    return 3 if len(word) > 1 and word.isupper() else 2 if word[1:].islower() or len(word) == 1 else 4


def unit(values: np.ndarray) -> np.ndarray:
    size = float(np.sqrt((values * values).sum()))
    return values / size if size else values


def features(text: str | None, cache: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots (each once) and values of a text; `cache` keeps hash and shape of words seen before."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass")) if text else []
    if len(cache) > CACHED:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = crc32(w.lower()), shape(w)
    known = np.array([cache[w] for w in words], np.uint64).reshape(-1, 2)
    one, form = known[:, 0], known[:, 1].astype(np.int64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    slots, counts = np.unique(np.concatenate([one, two >> np.uint64(20)]) % np.uint64(SLOTS - FIRST), return_counts=True)
    # Shapes and pairs of shapes have their own slots and count as shares of the text.
    shapes = np.bincount(form, minlength=8)
    pairs = np.bincount(8 * form[:-1] + form[1:], minlength=64)
    both = np.concatenate([shapes, pairs])
    at = np.flatnonzero(both)
    return (
        np.concatenate([[BIAS], 1 + at, FIRST + slots.astype(np.int64)]),
        np.concatenate([[0.25], unit(both[at].astype(np.float64)), unit(np.log1p(counts.astype(np.float64)))]),
    )


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights after `EPOCHS` passes over the rows in the order given."""
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for slots, values, label in rows:
            w = weights(slots)
            p = 1.0 / (1.0 + np.exp(-np.clip(float(w @ values), -35, 35)))
            g = (p - label) * values
            before = n[slots]
            after = before + g * g
            z[slots] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[slots] = after
    return weights(slice(None))


def train(labelled: DataFrame, text_col: str, label_col: str, key_col: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """(slot, weight) learned from `labelled`, at most `most_rows` rows of it."""
    order = F.xxhash64(F.col(key_col), F.lit(17))
    picked = labelled.where(F.col(label_col).isNotNull()).select(
        order.alias("h"), F.col(label_col).cast("int").alias("y"), F.col(text_col).alias("t")
    )
    picked = picked.orderBy("h").limit(most_rows)
    shape = pa.schema([("slot", pa.int64()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        cache: dict[bytes, tuple[int, int]] = {}
        for part in rows_of(batches):
            keys, labels, texts, shard = (part.column(i).to_pylist() for i in range(4))
            for h, y, t, s in zip(keys, labels, texts, shard, strict=True):
                shards.setdefault(s, []).append((h, *features(t, cache), y))
        for rows in shards.values():
            rows.sort(key=lambda r: (r[0], r[3]))
            w = ftrl([r[1:] for r in rows])
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], schema=shape)

    dealt = picked.withColumn("shard", F.pmod("h", F.lit(SHARDS)).cast("int")).repartition(SHARDS, "shard")
    found = dealt.mapInArrow(run, "slot bigint, weight double")
    return found.groupBy("slot").agg((F.sum("weight") / SHARDS).alias("weight"))


def score(docs: DataFrame, weights: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the probability of label 1; a column of that name is replaced."""
    docs = docs.drop(out)
    dense = np.zeros(SLOTS)
    for slot, weight in stored(weights, "quality-weights").orderBy("slot").collect():
        dense[slot] = weight
    held = docs.sparkSession.sparkContext.broadcast(dense)
    at = docs.columns.index(text_col)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        w = held.value
        cache: dict[bytes, tuple[int, int]] = {}
        sums = [float(w[s] @ v) for s, v in (features(t, cache) for t in part.column(at).to_pylist())]
        return [pa.array(1.0 / (1.0 + np.exp(-np.clip(np.array(sums, np.float64), -35, 35))))]

    return added(docs, [out], ["double"], work)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; null keys belong to fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label_col: str, key: str = "doc_id", folds: int = 4, held: int = 2, most_rows: int = MOST_ROWS
) -> DataFrame:
    """Documents with their label, without the held-out fold: those of at most `most_rows` label rows, of smallest hash.

    The ids are picked before any text is read, so the picked labels are a table of at most `most_rows` rows, which may be broadcast.
    """
    marks = labels.where(F.col(label_col).isNotNull() & (fold(F.col(key), folds) != held)).select(key, F.col(label_col).alias("label_"))
    picked = marks.orderBy(F.xxhash64(F.col(key), F.lit(17)), key, "label_").limit(most_rows)
    return docs.select(key, "text").join(F.broadcast(stored(picked, "picked-labels")), key)
