"""The pipeline's stages on a small folder, held against what each of them must keep."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [a + b for a in ("ta", "mi", "ro", "ke", "su", "lo") for b in ("na", "ri", "do", "pe", "shu", "ven", "gal")]
    bench = " ".join(rng.choice(words) + "x" for _ in range(30))
    passage = " ".join(rng.choice(words) + "y" for _ in range(80))

    def good(n=90):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    def bad():
        return " ".join(rng.choice(["###", "$$$", "&&& 99", "A1B2", "!!!"]) for _ in range(60))

    texts = {n: good() if n % 3 else bad() for n in range(150)}
    texts[200] = good(30) + " " + bench + " " + good(30)
    texts[201] = texts[1]
    near = texts[4].split()
    near[40] = "changed"
    texts[202] = " ".join(near)
    for n in (203, 204, 205):
        texts[n] = good(60) + "\n" + passage + "\n" + good(60)
    rows = [(n, t, "en", "abc"[n % 3], len(t)) for n, t in texts.items()]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SHAPE).withColumn("score", F.lit("mine")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(n, int(n % 3 > 0), 0) for n in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("i1", bench), ("i2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, bench, passage


def test_stages_take_effect_and_keep_clean_documents(spark, folder):
    path, texts, bench, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, path), "test-stage")
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
            assert docs.where("score != 'mine'").isEmpty()
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {n for n in texts if n % 3 or n >= 200}
    assert set(seen["quality"]) == clean
    assert set(seen["line_dedup"]) == clean
    assert sum(passage in t for t in seen["line_dedup"].values()) == 1
    assert all(seen["line_dedup"][n] == texts[n] for n in clean if n < 200)
    # What line dedup leaves of a copy (nothing, or what stands around a changed word) is no copy of anything.
    left = {n: len(re.findall(r"\S+", t)) for n, t in seen["jaccard"].items()}
    assert clean - {201, 202} <= set(left) and left.get(201, 0) == 0 and left.get(202, 0) < 45
    copies = spark.createDataFrame([(n, texts[n], "en", "a", 1) for n in (1, 201, 4, 202, 5)], SHAPE)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, copies, path).collect()) == [1, 4, 5]
    assert set(seen["jaccard"]) - set(seen["decontaminate"]) == {200}
    mixed = {r.doc_id: r for r in docs.collect()}
    assert set(mixed) == set(seen["decontaminate"])
    assert all(r["size"] == len(seen["decontaminate"][n].split()) and 0 <= r.taken <= 2 * r["size"] for n, r in mixed.items())


def test_stages_on_empty_tables(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
