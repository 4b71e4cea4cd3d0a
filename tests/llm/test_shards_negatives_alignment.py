"""Shards, hard negatives and token alignment against brute force, with nulls, ties, repeats, empty and clashing tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ringfield.llm import alignment, negatives, sharding


def rows_of(df, *drop):
    return Counter(str(r) for r in df.drop(*drop).collect())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(None, None, 1), (1, None, 1), (2, "", 2), (3, "a", 3), (3, "a", 3), (4, "b " * 9000, 4)]
    rows += [(i, " ".join(rng.choice(["oak", "elm", "fir"]) for _ in range(rng.randrange(1, 60))), 1) for i in range(10, 400)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int")


def test_shards_hold_every_row_once_and_differ_by_one(docs, spark):
    for n in (1, 7, 8):
        out = sharding.shard(docs, n, bucket_bytes=3000)
        assert out.columns == ["doc_id", "text", "shard", "slot"]
        assert rows_of(out, "shard", "slot") == rows_of(docs, "shard")
        places = defaultdict(list)
        for r in out.collect():
            places[r.shard].append(r.slot)
        assert sorted(places) == list(range(n))
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        sizes = [len(p) for p in places.values()]
        assert max(sizes) - min(sizes) <= 1


def test_shards_depend_on_rows_and_seed_alone(docs):
    seen = [rows_of(sharding.shard(d, 5, seed=s, bucket_bytes=5000)) for d, s in ((docs, 1), (docs.repartition(7), 1), (docs, 2))]
    assert seen[0] == seen[1] != seen[2]


def test_shards_are_a_uniform_shuffle(spark):
    table = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(table, 8).collect()}
    # The first half of the table is spread evenly over shards and slots (deviation sqrt(125) = 11 of 250).
    assert all(abs(sum(out[i][0] == s for i in range(2000)) - 250) < 60 for s in range(8))
    assert abs(sum(out[i][1] < 250 for i in range(2000)) - 1000) < 130
    assert sum(out[i][0] == out[i + 1][0] for i in range(3999)) < 700


def test_shards_spread_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "UNFOLD", 100)
    many = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"))
    table = many.union(spark.range(3000).select((F.col("id") + 5).cast("int"), F.lit("other")))
    out = sharding.shard(table, 3)
    assert rows_of(out, "shard", "slot") == rows_of(table)
    assert all(900 < r["n"] < 1100 for r in out.where("doc_id = 1").groupBy("shard").agg(F.count("*").alias("n")).collect())
    plain = sharding.spread(table, 1, 16, "bucket", "h", 6000)
    assert plain.groupBy("bucket").count().agg(F.max("count")).first()[0] < 600


def test_shards_of_an_empty_table_and_of_few_rows(docs):
    assert sharding.shard(docs.limit(0), 8).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.shard(docs.limit(2), 8).collect()) == [(0, 0), (1, 0)]


def mined(rows, is_anchor, positives=5, count=10, low=30, high=90):
    length = Counter(len(v) for i, l, v in rows if None not in (i, l, v) and None not in v)
    want = max(length, key=lambda n: (length[n], n)) if length else 0
    rows = [(i, l, v) for i, l, v in rows if None not in (i, l, v) and None not in v and len(v) == want]
    out = []
    for i, l, v in {(i, l, tuple(v)) for i, l, v in rows if is_anchor(i)}:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i]
        for s, p, m in sorted(x for x in scored if x[2] == l)[:positives]:
            fits = sorted(x for x in scored if x[2] != l and low * -s <= 100 * -x[0] <= high * -s)[:count]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits)]
    return Counter(out)


@pytest.mark.parametrize("dims, spread", [(64, 60), (5, 3), (70, 1), (128, 900)])
def test_hard_negatives_against_brute_force(spark, dims, spread):
    rng = random.Random(dims)
    base = [[rng.randint(-spread, spread) for _ in range(dims)] for _ in range(6)]
    rows = [(None, 1, base[0]), (5, None, base[0]), (7, 1, None), (9, 1, [None] * dims), (11, 1, [1] * (dims + 1)), (20, 2, [0] * dims)]
    for i in range(100, 420):
        v = [x + rng.randint(-spread, spread) // 2 for x in base[i % 6]] if i % 3 else base[i % 6]
        rows.append((i, rng.randrange(3), v))
    rows += [(200, 1, base[1]), (200, 1, base[1]), (200, 2, base[2]), (301, 0, base[3]), (301, 0, base[3])]
    table = spark.createDataFrame(rows, "vec_id long, label int, v array<bigint>").withColumn("row", F.lit("mine")).repartition(3)
    want = mined(rows, lambda i: i % 20 == 0)
    assert want
    for block in (50, 1000):
        got = negatives.mine(table, F.col("vec_id") % 20 == 0, block=block)
        assert Counter(map(tuple, got.collect())) == want


def test_interval_holds_the_score(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    ints = rng.integers(-100, 100, (300, 64)).astype(np.int32)
    turns = negatives.rotations(64, 4)
    codes, held = negatives.coded(ints, turns)
    block = negatives.Block(np.arange(300), np.zeros(300, np.int64), ints, codes, held, turns)
    low, high = block.interval(ints[5], 6)
    true = ints.astype(np.int64) @ ints[5].astype(np.int64)
    assert (low <= true).all() and (true <= high).all()
    # The intervals tell most rows apart: they are much narrower than the scores are spread.
    assert np.median(high - low) < 3 * true[np.arange(300) != 5].std()


def test_hard_negatives_of_odd_tables(spark):
    shape = "vec_id long, label int, v array<bigint>"
    for rows in ([], [(0, 1, None)], [(0, 1, [])], [(0, 1, [5, 5])], [(0, 1, [5, 5]), (1, 1, [5, 4])]):
        assert negatives.mine(spark.createDataFrame(rows, shape), F.col("vec_id") % 100 == 0).count() == 0
    huge = [(0, 1, [1 << 40, 0]), (1, 1, [1, 1]), (2, 2, [1, 1])]
    assert negatives.mine(spark.createDataFrame(huge, shape), F.col("vec_id") % 100 == 0).count() == 0


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "one two three", "one two three", "tab\there and\n\nlines \n  x", "x\t   y", "x\t  ",
    "naïve café £5 — “quoted” 漢字かな 한국어 مرحبا 🙂🙂🏽", "it's they'll 1234567 3.14", "<|endoftext|> <s> </s> <0x41> <unk>",
    "a ▁ piece", "x\ny\n\nz\n", "\nfirst\nsecond", "a\n b", "é    wide　x \x1c \x85y", "antidisestablishmentarianism " * 30, "ab" * 3000, "\x00 \x01 a",
]


def test_alignment_against_whole_texts(spark):
    both = alignment.Tokenizers(alignment.A_PATH, alignment.B_PATH)
    assert both.by_words
    rng = random.Random(9)
    alphabet = "ab  \n\té'漢1.▁"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(150)]
    want, pairs = [], Counter()
    for n, text in enumerate(texts):
        groups = []
        if text:
            one, two = both.encode([" " + text])[0]
            target = (" " + text).encode()
            if b"".join(both.a_bytes[t] for t in one) == target == b"".join(both.b_bytes[t] for t in two):
                ends = [{0}, {0}]
                for side, ids, names in ((0, one, both.a_bytes), (1, two, both.b_bytes)):
                    at = 0
                    for t in ids:
                        at += len(names[t])
                        ends[side].add(at)
                marks = sorted(ends[0] & ends[1])
                for a, b in zip(marks, marks[1:]):
                    parts = []
                    for ids, names in ((one, both.a_bytes), (two, both.b_bytes)):
                        at, part = 0, []
                        for t in ids:
                            if a <= at < b:
                                part.append(t)
                            at += len(names[t])
                        parts.append(part)
                    groups.append(parts)
        links = [(a[-1], b[-1]) for a, b in groups]
        pairs.update(links)
        want.append((n, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), groups, links))
    best = defaultdict(int)
    for (_, b), count in pairs.items():
        best[b] = max(best[b], count)
    rows = [
        (n, na, nb, len(groups), len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links),
         ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups))
        for n, na, nb, groups, links in want
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("mine")).withColumn("n_a", F.lit(7))
    got = alignment.align(table.repartition(3))
    assert got.columns == ["doc_id", "row", *alignment.RESULT]
    assert sorted(tuple(r) for r in got.drop("row").collect()) == sorted(rows)
    # The same with every pair broadcast, with none, and with whole texts.
    for hot in (1, 1 << 40):
        old, alignment.HOT = alignment.HOT, hot
        try:
            assert sorted(tuple(r) for r in alignment.align(table).drop("row").collect()) == sorted(rows)
        finally:
            alignment.HOT = old
    digest = alignment.align(table, digest=True)
    shas = {r.doc_id: r.groups for r in digest.collect()}
    assert all(shas[r[0]] == alignment.hashed(r[7]) for r in rows)
    assert alignment.align(table.limit(0)).count() == 0


def test_alignment_writes_its_pairs(spark, tmp_path):
    table = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one")], "doc_id long, text string")
    out = alignment.align(table, pairs_path=str(tmp_path / "pairs"))
    written = {(r.a, r.b): r.n for r in spark.read.parquet(str(tmp_path / "pairs")).collect()}
    assert sorted(written.values()) == [2, 3]
    assert out.agg(F.sum("count_sum")).first()[0] == 2 * (3 + 2) + 3
