"""Brute-force checks of the training-data operators on small fixtures with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfield.llm import ann, decontaminate, jaccard, licenses, linededup, mixing, pii, quality, suffixtree, urls

DOCS = "doc_id long, text string, source string, n_words long, found string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    rows = [(0, None, None, 1, "x"), (1, "", "a", 1, "x"), (2, "one", "a", 1, "x"), (3, "one", "b", 1, "x"), (3, "one", "b", 1, "x")]
    for i in range(4, 60):
        text = " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.choice([1, 2, 40, 120])))
        rows.append((i, text, rng.choice(["a", "b", "c", None]), 1, "x"))
        if i % 3 == 0:
            near = text.split()
            near[rng.randrange(len(near))] = "changed"
            rows.append((1000 + i, " ".join(near), "a", 1, "x"))
    return spark.createDataFrame(rows, DOCS)


def test_contamination_against_brute_force(spark, docs):
    pick = [r.text for r in docs.collect() if r.text and len(r.text.split()) > 30][:3]
    items = [("i1", " ".join(pick[0].split()[5:25])), ("i2", "one"), ("i3", None), ("i4", ""), ("i5", pick[1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = []
    for d in docs.collect():
        w = re.findall(r"[0-9a-z]+", (d.text or "").lower())
        hit, names = set(), set()
        for name, t in items:
            b = re.findall(r"[0-9a-z]+", (t or "").lower())
            n = min(13, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    names.add(name)
        want.append((d.doc_id, len(w), len(hit), tuple(sorted(names))))
    for block_bytes in (1 << 20, 64):
        got = decontaminate.scan(docs, bench, block_bytes=block_bytes)
        assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == sorted(want)


def test_jaccard_against_brute_force(docs):
    rows = docs.collect()
    sets = {}
    for r in rows:
        w = (r.text or "").lower().split()
        n = min(3, len(w))
        sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 90 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = jaccard.components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((r.doc_id, len(sets[r.doc_id]), label[r.doc_id]) for r in rows)
    assert any(label[d] != d for d in label)


def test_near_copies_stage_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(None, None), (7, ""), (None, "a b"), (None, "a b"), (8, "c d"), (8, "c d")]
    for i in range(12):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 300]))]
        rows.append((20 + i, " ".join(base)))
        for changes in (1, 2, 4, 6, 9):
            near = list(base)
            for at in rng.sample(range(len(near)), changes):
                near[at] = f"changed{rng.randrange(10**6)}"
            rows.append((rng.choice([None, 20 + i, 100 + i, rng.randrange(10**6)]), " ".join(near)))
    base = [f"u{k}" for k in range(300)]
    rows.append((1, " ".join(base)))
    rows.append((2, " ".join("x" + w if k % 50 == 25 else w for k, w in enumerate(base))))
    sets = []
    for _, text in rows:
        w = (text or "").split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = corpus_pipeline.drop_near_copies(spark, table, "").collect()
    groups = {}
    for i, (ident, text) in enumerate(rows):
        groups.setdefault(label[i] if sets[i] else -1 - i, []).append((ident is None, ident, text))
    assert len(got) == len(groups) < len(rows)
    left = {(r.doc_id, r.text) for r in got}
    for members in groups.values():
        smallest = min((x[:2] for x in members), key=lambda x: (x[0], x[1] or 0))
        assert sum((ident, text) in left for _, ident, text in set(members)) == 1
        assert any((ident, text) in left for none, ident, text in members if (none, ident) == smallest)
    assert (1, rows[-2][1]) in left and (2, rows[-1][1]) not in left


def test_bands_hold_linked_sizes():
    for size in range(1, 3000):
        band = jaccard.band_of(size)
        assert jaccard.band_of(-(-size * 100 // 90) - 1 or 1) <= band + 1
        assert band == 0 or jaccard.band_top(band - 1) < size <= jaccard.band_top(band)
        other = int(size / 0.9)
        top = max(band, jaccard.band_of(other))
        assert top - band <= 1
        assert jaccard.segments_of(top, 90, 100) > 10 * (size + other) // 190


def test_mix(spark, docs):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert len(got) == docs.count()
    total = sum(r["size"] for r in got)
    goal = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in goal.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-9 for s, t in goal.values())
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    for source, (_, target) in goal.items():
        most = max(r["size"] for r in got if r.source == source)
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 2 * most + 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_line_dedup(spark):
    passage = ". ".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(7)) + "."
    rows = [(1, f"First line.\n{passage}\nEnd here."), (2, f"Other start.\n{passage}\nDone."), (3, "Clean text. Nothing else here."), (4, None), (5, "")]
    out = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), spans_as="spans").collect()}
    assert out[1].text == rows[0][1] and out[1].spans == []
    assert passage.split()[3] not in out[2].text and out[2].text.startswith("Other start.") and out[2].text.endswith("Done.")
    assert out[3].text == rows[2][1] and out[4].text is None and out[5].text == ""


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(3)

    def some(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]

    rows, want = [], {}
    for case in range(40):
        passage = some(rng.choice([50, 60, 90]))
        kind = case % 4
        gaps = ["\n" if kind == 1 and i % 3 == 2 else ". " if kind == 2 and i % 9 == 8 else " " for i in range(len(passage) - 1)]
        body = "".join(w + g for w, g in zip(passage, [*gaps, ""], strict=True))
        for copy in range(3):
            head, tail = " ".join(some(rng.randrange(80))), " ".join(some(rng.randrange(80)))
            text = f"{head} {body} {tail}".strip() if kind != 3 else f"{head}\n{body}\n{tail}".strip()
            at = text.index(body)
            rows.append((3 * case + copy, text))
            want[3 * case + copy] = [(at, at + len(body))] if copy else []
    wide = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(80))
    rows += [(900, f"x{wide}y"), (901, f"zz{wide}z"), (902, "p " * 30 + "q")]
    want |= {900: [], 901: [(2, 82)]}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = {r.doc_id: r for r in linededup.dedup(table, spans_as="spans").collect()}
    assert {i: [(s.start, s.end) for s in out[i].spans] for i in want} == want
    assert out[902].text.split() == ["p"] * (len(out[902].text.split()) - 1) + ["q"]


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i % 250]]) for i in range(300)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    full = x[[i % 250 for i in range(300)]].astype(np.float64)
    for q in range(0, 300, 20):
        scores = (full * full[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(300), -scores)) if i != q][:20]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == order
    assert len(got) == 300
    assert ann.search(table.limit(0), F.lit(True)).count() == 0


def test_search_orders_many_ties_by_id(spark):
    # Every vector has the score 1 with the query, vector 0.
    ids = np.random.default_rng(4).permutation(511) + 1
    rows = [(0, [1.0] + [0.0] * 9)] + [(int(v), [1.0, *(float(b) for b in f"{i + 1:09b}")]) for i, v in enumerate(ids)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, 1.0) for i in range(1, 21)]


def test_search_recall_above_the_least_table(spark):
    x = np.random.default_rng(6).normal(size=(2 * ann.LEAST + 1000, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(table, F.col("vec_id") < 20).collect()
    full = x.astype(np.float64)
    hits = 0
    for q in range(20):
        order = [i for i in np.argsort(-(full @ full[q])) if i != q][:20]
        hits += len(set(order) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 400 and hits >= 360


def test_licenses(spark):
    rows = [(1, "Foo. CC BY and cc-by. Released under the MIT License."), (2, None), (3, "all rights reserved, All Rights Reserved"), (4, "the of a")]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels, out[1].labels) == (2, 1, 4, "cc-by", "cc-by,mit")
    assert (out[3].n_base, out[3].labels, out[3].score) == (2, "reserved", 1.0)
    assert (out[2].n_words, out[2].labels, out[2].first_word, out[4].score) == (0, "", None, 0.0)


def test_urls(spark):
    rows = [(1, "http://A.example.org/es/x?q"), (2, "https://example.org/en/12#f"), (3, "http://x.com/de/1"), (4, None), (5, "nothing"), (6, "http://xorg/"), (7, "http://x.org")]
    pages = spark.createDataFrame([(*r, "<p>some words</p>") for r in rows], "page_id long, url string, html string")
    out = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(pages).collect()}
    assert out[1] == ("a.example.org", "/es/x", "example.org/es/")
    assert out[2] == ("example.org", "/en/12", "example.org/en/1") and out[3] == ("x.com", "/de/1", "com/de/")
    assert out[4] == out[5] == ("", "", None) and out[6] == ("xorg", "/", None) and out[7] == ("x.org", "", None)
    assert urls.viterbi("freebets", [{"s": 1, "k": 4, "n": 9}, {"s": 5, "k": 4, "n": 9}], 20) == ["free", "bets"]


def test_pii(spark):
    assert pii.base_spans("a.b@c.de 1.2.3.4 256.1.1.1 x 4111 1111 1111 1111 +1 (555) 123-4567") == [
        (0, 8, "email"), (9, 16, "ip"), (29, 48, "card"), (49, 66, "phone")]
    assert pii.emails("x@@y.z.w@a.b") == [(3, 12)] and pii.emails("a@b") == []
    rows = [(i, f"words card 4111111111111111 and {i}") for i in range(30)] + [(50, "my card 4111111111111112 x"), (51, None)]
    out = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start) for s in out[50].spans] == [("card", 8)] and out[50].base == [] and out[51].spans == []


def test_pii_finds_unseen_forms_of_each_kind(spark):
    seeds = {"mail": "jo{}@site.org", "address": "10.0.{}.7", "phone": "+1 555 {:03d} 4567", "card": "4111 1111 1111 1111"}
    rows = [(100 * k + i, f"w{i} {word}: {form.format(i)} seen{i} there") for k, (word, form) in enumerate(seeds.items()) for i in range(30)]
    unseen = {
        "email": ["jane_doe[at]example.com", "jane at example dot com", "jane (at) example (dot) com", "jane@example[.]com"],
        "ip": ["10[.]0[.]0[.]5", "10 dot 0 dot 0 dot 5", "fe80::12:3:4"],
        "phone": ["555 123 4567", "(555) 123-4567", "(555)123-4567", "01 23 45 67 89", "5551234567"],
        "card": ["4111 1111 1111 1112", "4111-1111-1111-1112", "4111111111111112"],
    }
    want, at = {}, 1000
    for (word, _), (kind, forms) in zip(seeds.items(), unseen.items(), strict=True):
        for form in forms:
            rows.append((at, f"q{at} {word}: {form}, then 8 more"))
            want[at] = [(kind, form)]
            at += 1
    # Patterns of several words, and of the words behind; the word next to the place is not enough here.
    rows += [(2000 + i, f"n{i} reach me on +1 555 {i:03d} 9999 b{i}") for i in range(30)] + [(2100 + i, f"n{i} goes on 77{i:03d}00 b{i}") for i in range(90)]
    rows += [(2300 + i, f"n{i} +1 555 {i:03d} 8888 (mobile) b{i}") for i in range(30)]
    rows += [(3000, "so reach me on 555 777 1234 soon"), (3001, "x9 555 777 4321 (mobile) z"), (3002, "it goes on 7712300 long")]
    want |= {3000: [("phone", "555 777 1234")], 3001: [("phone", "555 777 4321")], 3002: []}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.extract(table).collect()}
    assert {i: got[i] for i in want} == want


def test_suffix_tree(spark):
    rows = [(i, "the cat sat on the mat " * 5) for i in range(6)] + [(9, None), (10, "the cat zzz")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffixtree.score(table, F.col("doc_id") < 6).collect()}
    n, v = 6 * 31, 6
    assert got[0].train_tokens == n and got[9].n_tokens == 1
    assert got[10].n_known == 3 and got[10].n_tokens == 4
    base = np.log10(61 / (n + v + 1)) + np.log10(31 / (n + v + 1)) + np.log10(1 / (n + v + 1)) + np.log10(7 / (n + v + 1))
    assert got[10].base_score == pytest.approx(base)
    assert got[0].score > got[0].base_score


def test_quality(spark):
    rows = [(i, "good plain words here " * 4 if i % 2 else "BAD!!! ### $$$ 99 " * 4, i % 2) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, y int")
    weights = quality.train(table, "text", "y", "doc_id")
    out = quality.score(table.unionByName(spark.createDataFrame([(99, None, None)], table.schema)), weights).collect()
    assert all((r.score >= 0.7) == bool(r.y) for r in out if r.y is not None) and all(0 <= r.score <= 1 for r in out)


def test_digest_is_of_the_listed_spans(spark):
    row = pii.extract(spark.createDataFrame([(1, "x a@b.cd")], "doc_id long, text string")).select(F.sha2(pii.listed(F.col("base")), 256)).first()
    assert row[0] == hashlib.sha256(b"email:2:8").hexdigest()


def test_jaccard_near_copies_do_not_meet_as_rows(spark, monkeypatch):
    """Sets that share segments but are too far apart for a link: their pairs are not listed, and links across blocks are found."""
    common = [f"w{k}" for k in range(200)]

    def copy(n, changed):
        return " ".join(f"x{n}y{k}" if k in changed else w for k, w in enumerate(common))

    rows = [(n, copy(n, {11 + n % 7, 60 + n % 11, 100 + n % 13, 140 + n % 5, 180 + n % 9, 30 + n % 3})) for n in range(0, 180, 2)]
    rows += [(n + 1, t + " end") for n, t in rows[:20]]
    given = []
    verified = jaccard.verified

    def counted(pairs, *rest):
        given.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    monkeypatch.setattr(jaccard, "BLOCK", 16, raising=False)
    found = {r.doc_id: r.component_id for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {n: n - n % 2 for n, _ in rows}
    assert sum(given) < 200


def test_jaccard_long_texts_do_not_meet_in_small_segments(spark):
    """long sets have empty segments and such of one shingle; they met there whatever they held."""
    draw = random.Random(5)
    rows = [(n, " ".join(str(draw.randrange(10**12)) for _ in range(1500))) for n in range(40)]
    words = rows[0][1].split()
    rows.append((40, " ".join(words[:1450])))
    index = jaccard.indexed(spark.createDataFrame(rows, "id long, text string"), 5, 80, 100)
    assert {(r.head, r.id) for r in jaccard.shared_entries(index).collect()} == {(0, 40)}


@pytest.mark.parametrize("over", [80, 90])
def test_jaccard_linked_sets_share_an_entry(over):
    draw = np.random.default_rng(over)
    linked = 0
    for n in range(1500):
        size = int(draw.integers(1, 400 if n % 3 else 30))
        a = draw.integers(0, 1 << 63, size, dtype=np.uint64)
        kept = a[: size - int(draw.integers(0, size * (100 - over) // 100 + 1))]
        more = len(kept) * 100 // over - size
        if not len(kept) or more < 0:
            continue
        b = np.concatenate([kept, draw.integers(0, 1 << 63, more if n % 2 else int(draw.integers(0, more + 1)), dtype=np.uint64)])
        linked += 1
        (x, kind), (y, other) = (jaccard.entries(np.unique(s), over, 100) for s in (a, b))
        at, to = np.nonzero(x[:, None] == y[None, :])
        proven = (kind[at] != other[to]) | (kind[at] == jaccard.ASKS)
        assert proven.any(), (len(a), len(b))
    assert linked > 1000
