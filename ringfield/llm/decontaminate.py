"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over whole documents.

The windows of the benchmark (n consecutive words of an item; an item of fewer words, but not none, is one window) are
hashed and broadcast. Each document is turned into word numbers, all windows of a slice of documents are hashed at once,
and every hash that is found is compared word by word before it counts. No document is shuffled.

A broadcast holds at most `block_bytes` of window text. A larger benchmark is dealt by hash into as many blocks as it
needs and the documents are scanned once for each, so that neither the driver nor a task ever holds more than one block.

Cases: a null or empty text has no words and no hits; a null or empty item has no windows; equal items and equal windows
count once per item id; an item without id marks words but is not among the items; repeated document rows are judged
each by itself; an empty benchmark hits nothing; columns of other names, clashing ones too, are carried along.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.llm.text import ALNUM, ALNUM_WORD, added, alnum_words, fresh, rows_of, stored

WORDS = 13
BLOCK_BYTES = 16 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """One row for each window and item: `words` (joined by a blank), `item` (the id as text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 1 << 20):
            grams: list[bytes] = []
            items: list[str | None] = []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                size = min(n, len(words))
                found = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
                grams += found
                items += [item] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), pa.array(items, pa.string())], ["words", "item"])

    pairs = benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "words binary, item string")
    return pairs.distinct()


class WindowSet:
    """The windows of one block: word numbers, and for each window length the sorted hashes with words and items."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]) -> None:
        by_window: dict[bytes, list[str]] = defaultdict(list)
        for words, item in pairs:
            by_window[bytes(words)] += [] if item is None else [item]
        self.number: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[list[int], list[str]]]] = defaultdict(list)
        for words, items in by_window.items():
            numbers = [self.number.setdefault(w, len(self.number) + 1) for w in words.split(b" ")]
            by_length[len(numbers)].append((numbers, items))
        self.levels = []
        for length, entries in sorted(by_length.items()):
            grid = np.array([e[0] for e in entries], np.int64)
            hashes = self.hashes(grid.reshape(-1), length)[:: length]
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            same = int(np.unique(hashes, return_counts=True)[1].max())
            self.levels.append((length, hashes, grid[order], [entries[i][1] for i in order], same))

    @staticmethod
    def hashes(ids: np.ndarray, length: int) -> np.ndarray:
        """The hash of the `length` numbers from each position on."""
        out = np.zeros(max(0, len(ids) - length + 1), np.uint64)
        for k in range(length):
            out *= STEP
            out += ids[k : k + len(out)].astype(np.uint64)
            out ^= out >> np.uint64(29)
        return out

    def find(self, documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]] | None]:
        """For each document the hit word ranges (end exclusive, merged, ascending) and items; None without hits."""
        get, ids_of = self.number.get, []
        for words in documents:
            ids_of.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
            ids_of.append(np.zeros(1, np.int64))  # no window reaches over the end of a document
        out: list[tuple[list[tuple[int, int]], set[str]] | None] = [None] * len(documents)
        if not self.levels:
            return out
        ids = np.concatenate([*ids_of, np.zeros(0, np.int64)])
        first = np.cumsum([0, *(len(w) + 1 for w in documents)])
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for length, hashes, grid, names, same in self.levels:
            if len(ids) < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(at):
                continue
            # Hashes only where all words of a window are known.
            wanted = self.hashes_at(ids, at, length)
            slot = np.searchsorted(hashes, wanted)
            for more in range(same):
                here = np.minimum(slot + more, len(hashes) - 1)
                ok = (hashes[here] == wanted) & (slot + more < len(hashes))
                found, entry = at[ok], here[ok]
                if not len(found):
                    break
                exact = (ids[found[:, None] + np.arange(length)] == grid[entry]).all(1)
                for p, e in zip(found[exact].tolist(), entry[exact].tolist(), strict=True):
                    k = int(np.searchsorted(first, p, "right")) - 1
                    start = p - int(first[k])
                    hits[k].append((start, start + length))
                    items[k].update(names[e])
        for k, ranges in hits.items():
            out[k] = merged(ranges), items[k]
        return out

    @staticmethod
    def hashes_at(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(length):
            out *= STEP
            out += ids[at + k].astype(np.uint64)
            out ^= out >> np.uint64(29)
        return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in ascending order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with `n_words`, `n_hit`, `items` (ids as text, sorted as strings) and `spans` (hit words, end exclusive).

    Existing columns of these names are replaced."""
    spark = docs.sparkSession
    docs = docs.select([c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "items", "spans") or c == text_col])
    pairs = stored(benchmark_windows(benchmark, item_id, item_text, n), "benchmark-windows")
    size = pairs.agg(F.sum(F.length("words") + F.coalesce(F.length("item"), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found, words, old = fresh(docs, "hits_found", "words_found", "hits_before")
    kind = "struct<spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
    at = docs.columns.index(text_col)
    for block in range(blocks):
        mine = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([(bytes(r[0]), r[1]) for r in mine.collect()])
        first = block == 0

        def work(part: pa.RecordBatch, held=held, first=first, built=[]) -> list[pa.Array]:  # noqa: B006
            if not built:  # once for each task
                built.append(WindowSet(held.value))
            words_of = [alnum_words(t) for t in part.column(at).to_pylist()]
            before = [None] * part.num_rows if first else part.column(part.num_columns - 1).to_pylist()
            out = []
            for got, prior in zip(built[0].find(words_of), before, strict=True):
                ranges, names = got or ([], set())
                if prior:
                    ranges = merged([*ranges, *((s["start"], s["end"]) for s in prior["spans"])])
                    names = names.union(prior["items"])
                out.append({"spans": [{"start": a, "end": b} for a, b in ranges], "items": sorted(names)})
            shape = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
            counts = [pa.array([len(w) for w in words_of], pa.int64())] if first else []
            return [*counts, pa.array(out, shape)]

        if first:
            docs = added(docs, [words, found], ["bigint", kind], work)
        else:
            docs = added(docs.withColumnRenamed(found, old), [found], [kind], work).drop(old)
    spans = F.col(f"{found}.spans")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    keep = [c for c in docs.columns if c not in (words, found)]
    return docs.select(*keep, F.col(words).alias("n_words"), hit.alias("n_hit"), F.col(f"{found}.items").alias("items"), spans.alias("spans"))


def is_contaminated(share_of_words: int = 20):
    """The rule on `n_hit` and `n_words`: some hit, and at least one word in `share_of_words`."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share_of_words >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", mode: str = "document", **options) -> DataFrame:
    """`docs` in their own columns without contaminated documents (`document`), or with hit spans cut out (`span`).

    A span goes from its first to its last word; what stands before and after it stays."""
    own = docs.columns
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode}")
    given = [f"c{i}" for i in range(len(own))]  # no clash with the columns that scan() adds
    text = given[own.index(text_col)]
    marked = scan(docs.toDF(*given), benchmark, text, **options)
    if mode == "document":
        return marked.where(~is_contaminated()).select(*given).toDF(*own)
    t, s = marked.columns.index(text), marked.columns.index("spans")

    def cut(part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.column(t).to_pylist()
        for i, spans in enumerate(part.column(s).to_pylist()):
            if spans:
                texts[i] = without(texts[i], [(x["start"], x["end"]) for x in spans])
        return [pa.array(texts, pa.string())]

    (new,) = fresh(marked, "text_after")
    return added(marked, [new], ["string"], cut).select(*[F.col(new if c == text else c).alias(c) for c in given]).toDF(*own)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in ALNUM_WORD.finditer(raw.translate(ALNUM))]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
