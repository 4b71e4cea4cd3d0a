"""N-gram Jaccard join: universe partition and pigeonhole, exact.

A document's set holds the hashes of its distinct shingles (`n` consecutive words; a shorter text is one shingle). Sets
linked by |A and B| >= t |A or B| differ in at most H = (1 - t) / (1 + t) * (|A| + |B|) shingles. Sizes fall into bands
in the ratio 1 / t, so linked sets share a band or have neighbouring ones; each set is indexed once for its own band and
once for the band above, under the H of the larger band. For a band the universe of shingles is dealt by a hash into
more than H segments: two linked sets then agree in at least one segment as a whole. One row is indexed for each segment, the
hash of its shingles.

Empty segments and such of few shingles are equal in many sets. A band has a quarter more segments than H + 1, and a set differs from
its partners in at most as many shingles as its own size allows; so linked sets agree in more than one segment, and each may leave
out some: those of fewest shingles (ties by their hash). As both leave out the first ones of the same order, what they agree in is
left out by neither as a whole. Bands of up to `SMALL` segments have little to leave out: there sets look
within the first `DELETE` segments also for sets that differ by one shingle (each segment so treated
covers one difference more, and every set indexes its one-deletion neighbourhood of these), and leave out as many segments more.

Pairs are first told apart by marks: counts of the shingles by a small hash, which differ in at most as many as the sets do,
so that no link is lost. Sets are verified exactly on their shingle hashes (64 bits), which are made again from the texts where they are needed rather
than stored. Equal sets are one class and stand for one another. Within the sets of one index entry not all pairs are made at
once: all are compared with the first; components are joined; then only pairs of sets that are still in different
components are left to compare, block by block and by their marks. No entry is cut and no partner dropped.

Cases: null and empty texts (and such without words) have size 0 and are linked with nothing; repeated rows with the same
id count as one document and are returned as often as they stand; null ids are documents of their own without links to
ids and keep a null component; equal texts under different ids are linked; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.llm.text import added, fresh, rows_of, space_words, stored
from ringfield.operators.components import connected_components

N = 3
#: The threshold as a fraction of whole numbers, so that the comparison is exact.
OVER, UNDER = 90, 100
DELETE = 2
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Ascending distinct hashes of the text's shingles."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    cache = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    ids = np.array([cache[w] for w in words], np.uint64)
    size = min(n, len(ids))
    out = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * MIX + ids[k : k + len(out)])
    return np.unique(out)


def band_of(size: int, over: int = OVER, under: int = UNDER) -> int:
    """Bands in the ratio under / over; `band_top` is monotone, so float noise cannot part linked sizes by two bands."""
    band = max(0, floor(log(size) / log(under / over)))
    while band_top(band, over, under) < size:
        band += 1
    while band and band_top(band - 1, over, under) >= size:
        band -= 1
    return band


def band_top(band: int, over: int = OVER, under: int = UNDER) -> int:
    return int((under / over) ** (band + 1) * (1 + 1e-9))


def differences(sizes: int, over: int, under: int) -> int:
    """In how many shingles two linked sets can differ that are `sizes` large together."""
    return (under - over) * sizes // (under + over)


#: Segments more than needed, as a share, and up to how many of them the one-deletion neighbourhoods are indexed.
MORE, SMALL = 4, 32


def segments_of(band: int, over: int, under: int) -> int:
    """More than two sets of the band's largest size can differ in."""
    most = differences(2 * band_top(band, over, under), over, under)
    return most + most // MORE + 1


#: What an entry does, in the order in which the entries of a key are read: it looks for others; it is a one-deletion neighbour
#: (and looks for others); it is only found.
ASKS, DELETED, FOUND = 0, 1, 2


def entries(hashes: np.ndarray, over: int, under: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and kinds of a set's index entries."""
    own, size = band_of(len(hashes), over, under), len(hashes)
    marks = mixed(hashes * MIX + np.uint64(7))
    keys, kinds = [], []
    for band in (own, own + 1):
        m = segments_of(band, over, under)
        seg = (mixed(hashes + np.uint64(band + 1)) % np.uint64(m)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, seg, marks)
        counts = np.bincount(seg, minlength=m)
        base = mixed(np.arange(m, dtype=np.uint64) + np.uint64(band) * np.uint64(1 << 32) + np.uint64(1))
        key = mixed(sums + base)
        first = min(DELETE, m) if m <= SMALL else 0
        near = np.flatnonzero(counts[:first])
        # Partners differ in at most `apart`, and in two or more of each segment of `near` unless they are found there.
        apart = differences(size + min(band_top(band, over, under), size * under // over), over, under)
        loose = np.ones(m, bool)
        loose[near] = False
        loose = np.flatnonzero(loose)
        out = loose[np.lexsort((key[loose], counts[loose]))][: m - 1 - apart + len(near)]
        kind = np.full(m, ASKS, np.int8)
        kind[out] = -1
        kind[out[out < first]] = FOUND  # empty: a neighbour with one shingle may look for it
        keys.append(key[kind >= 0])
        kinds.append(kind[kind >= 0])
        at = np.flatnonzero(seg < first)
        keys.append(mixed(sums[seg[at]] - marks[at] + base[seg[at]]))
        kinds.append(np.full(len(at), DELETED, np.int8))
    return np.concatenate(keys), np.concatenate(kinds)


#: Counts of a set's shingles by a hash, a byte for each: linked sets cannot differ in more of them than in shingles.
MARKS = 128


def marks_of(hashes: np.ndarray) -> bytes:
    at = (mixed(hashes * MIX + np.uint64(3)) % np.uint64(MARKS)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=MARKS), 255).astype(np.uint8).tobytes()


def classed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, cls, marks) from (doc_id, text): `cls` is 128 bits of the set, null for empty sets as are its marks."""

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        found = [shingles(t, n) for t in part.column(1).to_pylist()]
        return [
            pa.array([len(s) for s in found], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
            pa.array([marks_of(s) if len(s) else None for s in found], pa.binary()),
        ]

    return added(docs, ["n_shingles", "cls", "marks"], ["bigint", "binary", "binary"], work).drop("text")


def indexed(texts: DataFrame, n: int, over: int, under: int) -> DataFrame:
    """(key, kind, id) from (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 1 << 20):
            found = [entries(h, over, under) if len(h) else None for h in (shingles(t, n) for t in part.column(1).to_pylist())]
            ids = np.repeat(part.column(0).to_numpy(), [len(f[0]) if f else 0 for f in found])
            keys = np.concatenate([np.zeros(0, np.uint64), *(f[0] for f in found if f)]).view(np.int64)
            kinds = np.concatenate([np.zeros(0, np.int8), *(f[1] for f in found if f)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(kinds), pa.array(ids, pa.int64())], ["key", "kind", "id"])

    return texts.mapInArrow(run, "key bigint, kind tinyint, id bigint")


def shared_entries(index: DataFrame) -> DataFrame:
    """(key, head, head_kind, id, kind): for keys where somebody asks, every entry but the first, with the first.

    The index is shuffled once. In a partition the entries of a key come in the order of their kind; only the first one of a key is
    remembered, so a key of any size streams by. A key whose first entry is only to be found has nobody who asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, kind, ids = (batch.column(n).to_numpy() for n in range(3))
            new = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            carried = at < 0
            head, head_kind = ids[at], kind[at]
            if carried.any():
                head, head_kind = np.where(carried, last[1], head), np.where(carried, last[2], head_kind)
            last = key[-1], head[-1], head_kind[-1]
            kept = ~new & (head_kind != FOUND) & (ids != head)
            columns = [key[kept], head[kept], head_kind[kept].astype(np.int8), ids[kept], kind[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "head", "head_kind", "id", "kind"])

    dealt = index.repartition("key").sortWithinPartitions("key", "kind", "id")
    return dealt.mapInArrow(run, "key bigint, head bigint, head_kind tinyint, id bigint, kind tinyint")


#: Sets near each other are dealt into groups of at most about this many; the pairs of two groups are compared together.
GROUP = 256
#: A stored table of at most this many rows of whole numbers is sent to all workers; a longer one is joined by shuffle.
SENT = 1_000_000


def few(numbers: DataFrame) -> DataFrame:
    return F.broadcast(numbers) if numbers.count() <= SENT else numbers


def sized(members: DataFrame) -> DataFrame:
    """(id, low, high, marks) from (id, n, marks): an id with several texts has their range of sizes, and marks if they have the same."""
    marks = F.when(F.min("marks") == F.max("marks"), F.min("marks")).alias("marks")
    return members.groupBy("id").agg(F.min("n").alias("low"), F.max("n").alias("high"), marks)


def marked(marks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of counts for each set, and whether they are known."""
    known = marks.is_valid().to_numpy(zero_copy_only=False)
    counts = np.frombuffer(b"".join(m or bytes(MARKS) for m in marks.to_pylist()), np.uint8)
    return counts.reshape(-1, MARKS).astype(np.int16), known


def may_link(x: np.ndarray, y: np.ndarray, known: np.ndarray, sizes: np.ndarray, over: int, under: int) -> np.ndarray:
    """False where the counts of two sets, `sizes` large together, differ in more than linked sets can; true where they are not known."""
    apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
    return ~known | (apart * (under + over) <= (under - over) * sizes)


def near_pairs(pairs: DataFrame, sizes: DataFrame, over: int, under: int) -> DataFrame:
    """Different pairs (a, b) whose sizes and marks allow a link."""
    one, two = sizes.toDF("a", "la", "ha", "ma"), sizes.toDF("b", "lb", "hb", "mb")
    met = pairs.distinct().join(one, "a").join(two, "b")
    # An id with several texts may be linked through any of them.
    met = met.where(F.least("ha", "hb") * under >= F.greatest("la", "lb") * over)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            (x, known), (y, also) = marked(part.column(3)), marked(part.column(4))
            kept = pa.array(may_link(x, y, known & also, part.column(2).to_numpy(), over, under))
            yield pa.RecordBatch.from_arrays([part.column(n).filter(kept) for n in (0, 1)], ["a", "b"])

    return met.select("a", "b", (F.col("ha") + F.col("hb")).alias("s"), "ma", "mb").mapInArrow(run, "a bigint, b bigint")


#: Sets of an index entry that a task compares at once, and how many of them with the others in one step.
BLOCK, STEP = 2048, 32


def cross_pairs(rest: DataFrame, sizes: DataFrame, over: int, under: int) -> DataFrame:
    """Pairs (a, b) of one key and of different components whose sizes and marks allow a link, from (key, id, kind, label).

    The sets of a key are dealt into blocks, and every two blocks meet in a cell; only pairs that may be linked become rows.
    """
    blocks = rest.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    placed = rest.join(sizes, "id").join(blocks, "key").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["key", "p", "q", "own", "id", "kind", "label", "low", "high", "marks"]
    cells = placed.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).select(*names)
    dealt = cells.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def met(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        c = {n: cell[n].to_numpy() for n in names[1:-1]}
        counts, known = marked(cell["marks"].combine_chunks())
        left, right = (np.flatnonzero(c["own"] == c[n][0]) for n in ("p", "q"))
        out = [(np.zeros(0, np.int64),) * 2]
        for start in range(0, len(left), STEP):
            x, y = left[start : start + STEP, None], right[None, :]
            open_ = (c["label"][x] != c["label"][y]) & (c["id"][x] != c["id"][y])
            if c["p"][0] == c["q"][0]:
                open_ &= c["id"][x] < c["id"][y]
            for kind in (DELETED, FOUND):
                open_ &= (c["kind"][x] != kind) | (c["kind"][y] != kind)
            open_ &= np.minimum(c["high"][x], c["high"][y]) * under >= np.maximum(c["low"][x], c["low"][y]) * over
            i, j = np.nonzero(open_)
            i, j = left[start + i], right[j]
            kept = may_link(counts[i], counts[j], known[i] & known[j], c["high"][i] + c["high"][j], over, under)
            out.append((c["id"][i[kept]], c["id"][j[kept]]))
        a, b = (np.concatenate(x) for x in zip(*out))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            if held is None or not held.num_rows:
                continue
            at = np.stack([held[n].to_numpy() for n in names[:3]])
            ends = np.append(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, [held.num_rows] if batch is None else [])
            start, found = 0, []
            for end in ends.astype(int).tolist():
                found.append(met(held.slice(start, end - start)))
                start = end
            held = held.slice(start)
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def verified(near: DataFrame, texts: DataFrame, n: int, over: int, under: int) -> DataFrame:
    """Those of different pairs (a, b) that are linked.

    A set travels to the cells (two groups of sets) in which it has pairs, not to every pair; a cell holds the sets of two groups.
    """
    near = stored(near, "near-pairs")
    # Sets that are near each other go to the same group: that of the smallest id within two pairs. A large one is split.
    ways = stored(near.select(F.col("a").alias("id"), F.col("b").alias("other")).union(near.select("b", "a")), "ways")
    one = ways.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("m"))
    two = ways.join(one.toDF("other", "far"), "other").groupBy("id").agg(F.min("far").alias("far"))
    named = one.join(two, "id").select("id", F.least("m", "far").alias("g"))
    counts = named.groupBy("g").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")
    named = stored(named.join(counts, "g").select("id", F.struct("g", part.alias("part")).alias("g")), "paired-ids")
    places = few(named)
    cells = near.join(places.toDF("a", "ga"), "a").join(places.toDF("b", "gb"), "b")
    cells = cells.select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"), "a", "b")
    visits = stored(cells.select("ga", "gb", F.col("a").alias("id")).union(cells.select("ga", "gb", "b")).distinct(), "visits")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 1 << 20):
            found = [shingles(t, n).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["id", "shingles"])

    asked = texts.join(places.select("id"), "id", "left_semi").select("id", "text").mapInArrow(read, "id bigint, shingles binary")
    sets = asked.join(few(visits), "id").select("ga", "gb", F.lit(0).alias("pair"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    both = sets.unionByName(cells.select("ga", "gb", F.lit(1).alias("pair"), "a", "b", F.lit(None).cast("binary").alias("shingles")))
    dealt = both.repartition("ga", "gb").sortWithinPartitions("ga", "gb", "pair")

    def linked(p: np.ndarray, q: np.ndarray) -> bool:
        if len(p) > len(q):
            p, q = q, p
        if len(p) * under < len(q) * over:
            return False
        at = np.searchsorted(q, p)
        common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
        return under * common >= over * (len(p) + len(q) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for part in rows_of(batches):
            out = []
            for ga, gb, pair, a, b, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (ga, gb) != cell:
                    cell, held = (ga, gb), {}
                if not pair:
                    mine = held.setdefault(a, [])
                    if raw and not any(raw == other.tobytes() for other in mine):
                        mine.append(np.frombuffer(raw, np.uint64))
                elif any(linked(p, q) for p in held.get(a, ()) for q in held.get(b, ())):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, over: int = OVER, under: int = UNDER
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`; ids are whole numbers."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(classed(given, n), "shingle-classes")
    members = found.where("cls is not null and doc_id is not null")
    reps = stored(members.groupBy("cls").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n")), "class-heads")
    # A class is found by the texts of its smallest id. An id with several texts is in several classes; its entries are those of
    # all of them, so a shared id joins them of itself.
    ids = stored(reps.select("id").distinct(), "class-ids")
    texts = given.select(F.col("doc_id").alias("id"), "text")
    wanted = texts.join(few(ids), "id", "left_semi")
    sizes = members.join(ids, members["doc_id"] == ids["id"], "left_semi")
    sizes = stored(sized(sizes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "marks")), "class-sizes")
    rows = stored(shared_entries(indexed(wanted, n, over, under)), "shared-entries")
    # Two one-deletion neighbours prove nothing.
    near = rows.where((F.col("head_kind") != DELETED) | (F.col("kind") != DELETED))
    near = near.select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b"))
    links = stored(verified(near_pairs(near, sizes, over, under), wanted, n, over, under), "links")
    label = stored(connected_components(ids, links, []), "labels")
    # What is left: entries of one key in different components, the first one's pairs apart.
    named = rows.select("key", "id", "kind").distinct().join(label, "id")
    some = [F.min(F.col("kind") == k).alias(f"all_{k}") for k in (DELETED, FOUND)]
    open_ = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), *some)
    open_ = open_.where(f"x < y and not all_{DELETED} and not all_{FOUND}").select("key")
    rest = stored(named.join(open_, "key").select("key", "id", "kind", "label"), "open-entries")
    if not rest.isEmpty():
        cross = cross_pairs(rest, sizes, over, under).distinct()
        more = stored(verified(cross, wanted, n, over, under), "more-links")
        if not more.isEmpty():
            label = stored(connected_components(ids, links.unionByName(more).distinct(), []), "labels")
    by_class = reps.select("cls", "id").join(label, "id").groupBy("cls").agg(F.min("label").alias("label"))
    by_class = by_class.select(F.col("cls").alias("c_"), "label")
    out = found.join(by_class, (F.col("cls") == F.col("c_")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without those whose component holds a smaller id."""
    found = components(docs, id_col, text_col, **options)
    gone = few(stored(found.where("component_id < doc_id").select(F.col("doc_id").alias("gone_")).distinct(), "gone-ids"))
    return docs.join(gone, docs[id_col] == gone["gone_"], "left_anti")


def one_row_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each group: the first by id, null ids last. Rows of one id or without id count on their own."""
    row, known = fresh(docs, "row_"), F.struct(F.col("id").isNull().alias("none"), "id", "th", "doc_id")
    numbered = stored(docs.withColumn(row[0], F.monotonically_increasing_id()), "numbered-docs")
    found = components(numbered, row[0], text_col, **options).where("n_shingles > 0")
    ids = numbered.select(F.col(row[0]).alias("doc_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    placed = stored(found.join(ids, "doc_id").select("component_id", known.alias("place")), "placed-rows")
    first = stored(placed.groupBy("component_id").agg(F.min("place").alias("first")).select("component_id", F.col("first.doc_id").alias("first")), "first-rows")
    gone = placed.join(first, "component_id").where("place.doc_id != first").select(F.col("place.doc_id").alias("gone_"))
    gone = few(stored(gone, "gone-rows"))
    return numbered.join(gone, numbered[row[0]] == gone["gone_"], "left_anti").drop(row[0])
