"""Empty tables, nulls in every column, repeated rows and clashing column names, for operators that carry rows along."""

import pytest
from pyspark.sql import functions as F

from ringfield.llm import ann, decontaminate, jaccard, licenses, linededup, mixing, pii, quality, suffixtree, urls

SHAPE = "doc_id long, text string, source string, lang string"
# Columns that the operators use or make themselves.
CLASHING = ["id", "th", "start", "spans", "n_words", "labels", "score", "h", "cls", "shingles", "size", "target", "label_"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "some plain words", "a", "en"), (1, "some plain words", "a", "en"), (2, None, None, None), (None, "x y", "a", None), (None, None, None, None), (3, "", "b", "en")]
    table = spark.createDataFrame(rows, SHAPE)
    for c in CLASHING:
        table = table.withColumn(c, F.lit("mine"))
    return table


WAYS = {
    "licenses": lambda d: licenses.scan(d),
    "linededup": lambda d: linededup.dedup(d),
    "mixing": lambda d: mixing.mix(d),
    "jaccard": lambda d: jaccard.components(d),
    "pii": lambda d: pii.extract(d),
    "suffixtree": lambda d: suffixtree.score(d, F.coalesce(F.col("doc_id") < 3, F.lit(True))),
    "urls": lambda d: urls.judge(d, "text", "lang"),
    "decontaminate": lambda d: decontaminate.scan(d, d.select(F.col("source").alias("item_id"), F.col("lang").alias("text"))),
}


@pytest.mark.parametrize("name", WAYS)
def test_rows_stay_whole(odd, name):
    found = WAYS[name](odd)
    assert found.count() == 6
    assert WAYS[name](odd.limit(0)).count() == 0


def test_filters_keep_columns_and_clean_rows(spark, odd):
    bench = spark.createDataFrame([("i", "nothing of these is here")], "item_id string, text string")
    for out in (decontaminate.decontaminate(odd, bench), decontaminate.decontaminate(odd, bench, mode="span"), linededup.dedup(odd), jaccard.one_of_each(odd)):
        assert out.columns == odd.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(i, [float(i % 7) + 0.5, 1.0, float(i % 3)]) for i in range(60)] + [(100, [1.0] * 5), (20, [2.0]), (120, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine"))
    found = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in found} == {0, 20, 40}
    assert len(found) == 60 and all(r.vec_id < 60 for r in found)
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_score_column_is_replaced(odd):
    weights = quality.train(odd.withColumn("y", F.lit(1)), "text", "y", "doc_id")
    out = quality.score(odd, weights)
    assert out.columns.count("score") == 1 and out.count() == 6 and all(0 <= r.score <= 1 for r in out.select("score").collect())
