"""URL filters: rules on host and path, else words of the host by unigram Viterbi and naive Bayes on host and path words.

Word counts come from the paths and texts of all pages. Every distinct label of a host (`www`, `freebets`) is split into
the words of largest probability: its substrings (up to `LONGEST` letters) are joined with the word counts by shuffle, and
the split is found for each label by itself, so the vocabulary is never broadcast. A run of unknown letters costs more the
longer it is. Naive Bayes learns from the distinct URLs that a rule decides; counts of words are sums that combine before
the shuffle. Log weights are rounded to whole millionths, so that sums do not depend on the order of rows. Host and path
are judged once for each distinct pair and joined back.

Cases: a null url and one without `://` have empty host and path, no rule, and are judged by the prior alone; no page
under a rule: every other page is allowed; ties allow; repeated rows and null ids are judged each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfield.llm.text import folded, rows_of, stored

# Fixed values: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
LONGEST = 24
UNKNOWN = 10.0
SCALE = 1_000_000


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    there = F.instr(url, "://") > 0
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(there, folded(host)).otherwise(""), F.when(there, path).otherwise("")


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """`pages` (host, path) with `rule` and `ruled` (allow, block or null); the longest rule wins, block before allow."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, host, path in reversed(ordered):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, name).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def path_words(text: Column) -> Column:
    return F.filter(F.split(folded(text), "[^a-z0-9]+"), lambda w: w != "")


def word_counts(pages: DataFrame, text: Column) -> DataFrame:
    """(word, n) over paths and texts of pages; markup is left out."""
    words = F.concat(path_words(F.col("path")), path_words(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " ")))
    return pages.select(F.explode(words).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for each distinct label."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    n = F.length("label")
    starts = labels.select("label", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    parts = starts.select("label", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), n - F.col("s") + 1))).alias("k"))
    parts = parts.withColumn("word", F.substring("label", F.col("s"), F.col("k")))
    known = parts.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("s", "k", "n")).alias("known"))
    ready = labels.join(known, "label", "left").select("label", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            texts = part.column(0).to_pylist()
            out = [viterbi(t, k or [], total) for t, k in zip(texts, part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(out, pa.list_(pa.string()))], ["label", "words"])

    return ready.mapInArrow(run, "label string, words array<string>")


def viterbi(label: str, known: list[dict], total: int) -> list[str]:
    """The split of largest probability; an unknown letter costs 1 / total and a fixed factor more, runs of them join."""
    by_end: dict[int, list[tuple[int, float]]] = {}
    for x in known:
        start = x["s"] - 1
        by_end.setdefault(start + x["k"], []).append((start, log(x["n"] / total)))
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
    for end in range(1, len(label) + 1):
        options = [(best[end - 1][0] - log(total) - UNKNOWN, end - 1, False)]
        options += [(best[start][0] + p, start, True) for start, p in by_end.get(end, [])]
        best.append(max(options))
    words: list[str] = []
    end, loose = len(label), False
    while end:
        _, start, sure = best[end]
        if not sure and loose:
            words[-1] = label[start:end] + words[-1]
        else:
            words.append(label[start:end])
        loose, end = not sure, start
    return words[::-1]


def judge(pages: DataFrame, url_col: str = "url", text_col: str = "html", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """`pages` with `host`, `path`, `rule`, `verdict`, `weight` (millionths of log odds for block; null under a rule).

    Existing columns of these names are replaced."""
    rules = RULES if rules is None else rules
    made = ("host", "path", "rule", "ruled", "verdict", "weight")
    host, path = parsed(F.col(url_col))
    pages = pages.select(*[c for c in pages.columns if c.lower() not in made], host.alias("host"), path.alias("path"))
    pages = ruled(pages, rules)
    counts = stored(word_counts(pages, F.col(text_col)), "url-words")
    urls = stored(pages.groupBy("host", "path").agg(F.first("ruled").alias("ruled")), "url-pairs")
    parts = F.filter(F.split("host", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hosts = urls.select("host").distinct().select("host", F.explode(parts).alias("label"))
    split = segmented(hosts.select("label").distinct(), counts)
    by_host = hosts.join(split, "label").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))
    tokens = urls.join(by_host, "host", "left").withColumn(
        "tokens",
        F.concat(
            F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
            F.transform(path_words(F.col("path")), lambda w: F.concat(F.lit("p:"), w)),
        ),
    )
    tokens = stored(tokens.select("host", "path", "ruled", "tokens"), "url-tokens")
    is_block, is_allow = (F.col("ruled") == "block").cast("long"), (F.col("ruled") == "allow").cast("long")
    each = tokens.where("ruled is not null").select(is_block.alias("b"), is_allow.alias("a"), F.explode("tokens").alias("token"))
    learned = stored(each.groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "url-model")
    nb, na, size = learned.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    ub, ua = tokens.agg(F.coalesce(F.sum(is_block), F.lit(0)), F.coalesce(F.sum(is_allow), F.lit(0))).first()
    prior = round(SCALE * log((ub + 1) / (ua + 1)))
    odds = F.log((F.col("b") + 1) / F.lit(nb + size + 1)) - F.log((F.col("a") + 1) / F.lit(na + size + 1))
    weights = learned.select("token", F.round(odds * SCALE).cast("long").alias("w"))
    open_ = tokens.where("ruled is null")
    scored = open_.select("host", "path", F.explode("tokens").alias("token")).join(weights, "token")
    scored = scored.groupBy(F.col("host").alias("h_"), F.col("path").alias("p_")).agg(F.sum("w").alias("w"))
    out = pages.join(scored, (F.col("host") == F.col("h_")) & (F.col("path") == F.col("p_")), "left")
    weight = F.when(F.col("ruled").isNull(), F.coalesce("w", F.lit(0)) + prior)
    verdict = F.coalesce("ruled", F.when(weight > 0, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).withColumn("weight", weight).drop("h_", "p_", "w", "ruled")
