"""Line dedup: content-defined chunks of words; repeated passages are removed but for the first place.

A text is words with what stands between them (characters from U+2E80 on, which are written without blanks, are words of
their own). Of each `WINDOW` successive runs of `RUN` words the one of smallest hash is an anchor, so anchors move along
with the content, whatever the lines and stops are. A chunk reaches from an anchor to the end of the next; a passage of
2 * `WINDOW` + `RUN` - 1 = 47 words that stands in two places holds the same whole chunk in both, wherever it begins and
ends. Lines of at least `LEAST` words, and texts of so many that are too short for two anchors, are chunks as well.

Chunk hashes are counted over the whole corpus with map-side sums and the first place of each repeated hash is found. A
chunk is removed only if the BLAKE2b digest (128 bits) of its bytes is that of the first place. Where its neighbour is not repeated, it is extended
word by word as long as the bytes agree with those around the first place; the next anchor is at most `WINDOW` words away,
so that many are compared. Overlapping spans are joined; spans of fewer than `LEAST` words stay.

Cases: rows are told apart by (id, hash of the text): repeated rows are one document in two rows and get the same result;
a document that repeats under another id loses its repeated chunks; null and empty texts stay as they are; the first
place is the smallest (id, text hash, position), null ids first; other columns are carried along, `n_chars` too, which
becomes the length of the new text where it exists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.llm.jaccard import mixed
from ringfield.llm.text import added, rows_of, stored

RUN = 8
WINDOW = 20
LEAST = 12
#: Odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
WIDE = 0x2E80


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        row = np.full(n, base, np.uint64)
        row[:1] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends) of the words."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D)) | (codes == 0xA0) | (codes == 0x3000)
    own = codes >= WIDE
    cut = np.ones(len(codes) + 1, bool)
    cut[1:-1] = blank[1:] | blank[:-1] | own[1:] | own[:-1]
    return codes, np.flatnonzero(cut[:-1] & ~blank), np.flatnonzero(cut[1:] & ~blank) + 1


def sliding(x: np.ndarray, window: int, best: np.ufunc) -> np.ndarray:
    """The best of each `window` successive values, by doubling."""
    size = 1
    while size < window:
        step = min(size, window - size)
        x = best(x[:-step], x[step:])
        size += step
    return x


def chunks(text: str | None, pows: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the chunks; `pows` reach as far as the text."""
    codes, first, last = words(text or "")
    n = len(first)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * pows[0][: len(codes)], out=sums[1:])

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(mixed((sums[b] - sums[a]) * pows[1][a]) + (b - a).astype(np.uint64))

    starts, ends = [], []
    if n > RUN:
        runs = hashed(first[: n - RUN + 1], last[RUN - 1 :])
        window = min(WINDOW, len(runs))
        least = sliding(runs, window, np.minimum)
        # A run is the smallest of some window around it if the largest of their smallest is its own.
        wide = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
        anchors = np.flatnonzero(sliding(wide, window, np.maximum) == runs)
        starts.append(first[anchors[:-1]])
        ends.append(last[anchors[1:] + RUN - 1])
    if n:
        line = np.searchsorted(np.flatnonzero(codes == 0x0A), first)
        opens = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        closes = np.append(opens[1:], n) - 1
        whole = closes - opens + 1 >= LEAST
        starts.append(first[opens[whole]])
        ends.append(last[closes[whole]])
    if LEAST <= n < 2 * WINDOW + RUN:
        starts.append(first[:1])
        ends.append(last[-1:])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    both = np.unique((np.concatenate(starts) << 32) | np.concatenate(ends))
    start, end = both >> 32, both & 0xFFFFFFFF
    return start, end, hashed(start, end)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """From (id, th, text) a row (id, th, start, end, h) for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 1 << 20):
            texts = part.column(2).to_pylist()
            pows = powers(max((len(t) for t in texts if t), default=0) + 1)
            found = [chunks(t, pows) for t in texts]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            start, end, h = (np.concatenate([f[i] for f in found]) for i in range(3))
            made = [part.column(0).take(at), part.column(1).take(at), pa.array(start), pa.array(end), pa.array(h.view(np.int64))]
            yield pa.RecordBatch.from_arrays(made, ["id", "th", "start", "end", "h"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, th bigint, start bigint, end bigint, h bigint")


def ends_of_runs(places: list[dict]) -> list[tuple[bool, bool]]:
    """For each place, by start, whether it is the first and the last of its run of overlapping chunks that are not kept."""
    out = [(True, True)] * len(places)
    run: list[int] = []

    def close() -> None:
        low, high = min(places[i]["start"] for i in run), max(places[i]["end"] for i in run)
        for i in run:
            out[i] = (places[i]["start"] == low, places[i]["end"] == high)

    reach = -1
    for i, p in enumerate(places):
        if p["kept"]:
            continue
        if run and p["start"] > reach:
            close()
            run = []
        run.append(i)
        reach = max(reach, p["end"])
    if run:
        close()
    return out


def digest(piece: str) -> bytes:
    return hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def pieces(docs: DataFrame) -> DataFrame:
    """From (id, th, text, places) a row for each place with the digest of its text and, where it may be extended, the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 1 << 20):
            rows: list[int] = []
            made: list[tuple] = []
            for i, (text, places) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                _, first, last = words(text)
                at_a, at_b = np.searchsorted(first, [p["start"] for p in places]), np.searchsorted(last, [p["end"] for p in places])
                lows = first[np.maximum(0, at_a - WINDOW)].tolist()
                highs = last[np.minimum(len(last) - 1, at_b + WINDOW)].tolist()
                for p, (opens, closes), low, high in zip(places, ends_of_runs(places), lows, highs, strict=True):
                    a, b = p["start"], p["end"]
                    rows.append(i)
                    made.append((p["h"], p["kept"], a, b, text[low:a] if opens else "", digest(text[a:b]), text[b:high] if closes else ""))
            at = pa.array(rows, pa.int64())
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            columns = [pa.array([m[j] for m in made], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *columns], ["id", "th", "h", "kept", "start", "end", "left", "piece", "right"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, th bigint, h bigint, kept boolean, start bigint, end bigint, left string, piece binary, right string")


def agreed(mine: str, other: str, from_end: bool) -> int:
    """How many characters of whole words agree, counted from the end or from the start."""
    common = 0
    most = min(len(mine), len(other))
    while common < most and (mine[-1 - common] == other[-1 - common] if from_end else mine[common] == other[common]):
        common += 1
    if not common:
        return 0
    if from_end:
        fit = set(len(mine) - words(mine)[1]) & set(len(other) - words(other)[1])
    else:
        fit = set(words(mine)[2]) & set(words(other)[2])
    return int(max((x for x in fit if x <= common), default=0))


def extended(pairs: DataFrame) -> DataFrame:
    """(id, th, start, end) of the places whose digest is the first place's, as far as the words around agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            start, end = part.column("start").to_pylist(), part.column("end").to_pylist()
            texts = [part.column(c).to_pylist() for c in ("left", "piece", "right", "left_", "piece_", "right_")]
            keep = []
            for i, (left, piece, right, left_, piece_, right_) in enumerate(zip(*texts, strict=True)):
                if piece == piece_:
                    keep.append(i)
                    start[i] -= agreed(left, left_, True)
                    end[i] += agreed(right, right_, False)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(at), part.column("th").take(at), pa.array([start[i] for i in keep], pa.int64()), pa.array([end[i] for i in keep], pa.int64())],
                ["id", "th", "start", "end"],
            )

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"id {kind}, th bigint, start bigint, end bigint")


def removals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, spans): what repeats an earlier place; spans can overlap."""
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "th", "start")
    mark = F.xxhash64("id", "th", "start")
    counted = chunk_rows(given).groupBy("h").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"))
    repeated = stored(counted.where("lo != hi").select("h"), "repeated-chunks")
    found = stored(chunk_rows(given).join(repeated, "h"), "chunk-places")
    # Written, so that the joins by a hot hash can be split.
    first = stored(found.groupBy("h").agg(F.min(place).alias("first")), "first-places")
    marked = found.join(first, "h").select("id", "th", F.struct("start", "end", "h", (F.col("first") == place).alias("kept")).alias("p"))
    # Repeated rows give the same places more than once.
    places = marked.groupBy(F.col("id").alias("i_"), F.col("th").alias("t_")).agg(F.sort_array(F.collect_set("p")).alias("places"))
    texts = given.where("text is not null").join(places, F.col("id").eqNullSafe(F.col("i_")) & (F.col("th") == F.col("t_")))
    around = stored(pieces(texts.select("id", "th", "text", "places")), "chunk-pieces")
    kept = around.where("kept").groupBy("h").agg(*[F.first(c).alias(f"{c}_") for c in ("left", "piece", "right")])
    kept = stored(kept, "first-pieces")
    each = extended(around.where(~F.col("kept")).join(kept, "h"))
    return each.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def joined_spans(text: str, spans: list[dict]) -> list[dict]:
    """Overlapping and touching spans joined; those of at least `LEAST` words."""
    out: list[dict] = []
    for s in spans:
        if out and not text[out[-1]["end"] : s["start"]].strip():
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return [s for s in out if len(words(text[s["start"] : s["end"]])[1]) >= LEAST]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a line feed right after a span that leaves its line empty goes too."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
        if (a == 0 or text[a - 1] == "\n") and text[at : at + 1] == "\n":
            at += 1
    return "".join([*out, text[at:]])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_as: str | None = None) -> DataFrame:
    """`docs` in their columns with repeated chunks cut out; `spans_as` names a column of the cut spans."""
    own = docs.columns
    given = [f"c{i}" for i in range(len(own))]
    ident, text = given[own.index(id_col)], given[own.index(text_col)]
    plain = docs.toDF(*given)
    spans = removals(plain, ident, text)
    left = plain.withColumn("th_", F.xxhash64(text))
    joined = left.join(spans, left[ident].eqNullSafe(spans["id"]) & (left["th_"] == spans["th"]), "left").select(*given, "spans")
    at, s = given.index(text), len(given)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.column(at).to_pylist()
        gone: list[list[dict]] = [[] for _ in texts]
        for i, found in enumerate(part.column(s).to_pylist()):
            if found:
                gone[i] = joined_spans(texts[i], found)
                texts[i] = cut(texts[i], [(x["start"], x["end"]) for x in gone[i]])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(texts, pa.string()), pa.array(gone, kind)]

    made = added(joined, ["new_text", "gone"], ["string", "array<struct<start:bigint,end:bigint>>"], work)
    columns = []
    for c, name in zip(given, own, strict=True):
        if c == text:
            columns.append(F.col("new_text").alias(name))
        elif name.lower() == "n_chars":
            columns.append(F.coalesce(F.length("new_text").cast(docs.schema[name].dataType), F.col(c)).alias(name))
        else:
            columns.append(F.col(c).alias(name))
    if spans_as:
        columns.append(F.col("gone").alias(spans_as))
    return made.select(*columns)
