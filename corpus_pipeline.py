"""The training-data pipeline: quality, line dedup, near duplicates, decontamination, mix. Counted as part of `llm`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of `documents`.

Cases, for every stage: an empty table stays empty; null and empty texts and null ids are rows like others (without words they are
neither copies nor contaminated); repeated rows are judged each, only the near copies' stage leaves one of them; texts of any
length are read whole; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.llm import decontaminate, jaccard, linededup, mixing, quality
from ringfield.llm.text import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: those scoring the threshold or more. Without labels all score 0.5 and go."""
    rows = quality.labelled_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")
    scored = quality.score(docs, quality.train(rows, "text", "label_", "doc_id"), out="quality_score_")
    return scored.where(F.col("quality_score_") >= quality.THRESHOLD).drop("quality_score_")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stood before are cut out of the texts."""
    return linededup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one of smallest id; words are compared by five, at 0.8."""
    return jaccard.one_row_of_each(docs, n=5, over=80, under=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken; documents that the mix does not take stay with 0 words."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("jaccard", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("mix", mix_sources),
]

#: SQL cannot express the classifier or the random mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
