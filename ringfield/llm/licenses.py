"""License scans: exact set-containment join of text blocks with license templates.

A text is cut into blocks of `BLOCK` words, one starting every half block, so that each run of up to half a block lies in
one block whole. A template of |T| distinct words is met by a block B if |T and B| >= t |T|. Words are ordered by their
frequency in the whole corpus, rare ones first (only the templates' words are counted, by sums that combine before the
shuffle). By the prefix filter a block that meets T holds one of the first |T| - o + 1 words of T, o = ceil(t |T|); a
block shorter than o words is left out (length filter), and a candidate whose words behind the first common one cannot
reach o any more is left out too (positional filter). Candidates are verified exactly. Templates are a bounded parameter,
so they travel with the task, and no document is shuffled.

Cases: null and empty texts have no words, no labels and score 0; repeated rows are judged each by itself; templates
without words meet nothing; other columns, clashing ones too, are carried along unless replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.llm.text import added, alnum_words, rows_of

BLOCK = 64
THRESHOLD = 0.8
# Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices of public licenses, with their labels.
TEMPLATES = [
    ("released under the MIT License", "mit"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("this work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("this Source Code Form is subject to the terms of the Mozilla Public License", "mpl-2.0"),
]


def frequencies(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of the templates stands in the corpus; bounded by the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for part in rows_of(batches):
            for text in part.column(0).to_pylist():
                total.update(filter(vocabulary.__contains__, alnum_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = docs.select(text_col).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r[0]): r[1] for r in counted.collect()}


class Templates:
    """Ordered templates and, for each prefix word, the templates that start with it and its place."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float) -> None:
        known = {w for text, _ in templates for w in alnum_words(text)}
        self.rank = {w: i for i, w in enumerate(sorted(known, key=lambda w: (counts.get(w, 0), w)))}
        self.entries: list[tuple[list[int], int, str]] = []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for text, label in templates:
            ordered = sorted({self.rank[w] for w in alnum_words(text)})
            if not ordered:
                continue
            need = ceil(threshold * len(ordered) - 1e-9)
            for place, r in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix.setdefault(r, []).append((len(self.entries), place))
            self.entries.append((ordered, need, label))

    def met(self, ranks: list[int], n_words: int) -> Iterator[tuple[str, float]]:
        """(label, containment) of the templates a block meets; `ranks` are its known words' ranks, ascending, distinct."""
        seen: set[int] = set()
        have = set(ranks)
        for q, r in enumerate(ranks):
            for which, place in self.prefix.get(r, ()):
                ordered, need, label = self.entries[which]
                if which in seen or n_words < need:
                    continue
                seen.add(which)
                # The first common word: nothing before it is shared.
                if 1 + min(len(ordered) - place - 1, len(ranks) - q - 1) < need:
                    continue
                both = len(have.intersection(ordered))
                if both >= need:
                    yield label, both / len(ordered)


def scan(
    docs: DataFrame,
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | None = None,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """`docs` with `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score`."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    vocabulary = {w for text, _ in templates for w in alnum_words(text)}
    lookup = Templates(templates, frequencies(docs, text_col, vocabulary), threshold)
    wanted = [(alnum_words(p), label) for p, label in phrases.items()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs = docs.select([c for c in docs.columns if c.lower() not in names or c == text_col])
    at = docs.columns.index(text_col)
    half = block // 2

    def judge(text: str | None) -> tuple:
        words = alnum_words(text)
        places: list[int] = []
        base: set[str] = set()
        for phrase, label in wanted:
            start = -1
            while True:
                try:
                    start = words.index(phrase[0], start + 1)
                except ValueError:
                    break
                if words[start : start + len(phrase)] == phrase:
                    places.append(start)
                    base.add(label)
        blocks: dict[int, set[int]] = {}
        for i, r in enumerate(map(lookup.rank.get, words)):
            if r is not None:
                blocks.setdefault(i // half, set()).add(r)
        labels, score = set(base), float(bool(base))
        for k in {b for j in blocks for b in (j - 1, j) if b >= 0}:
            ranks = sorted(blocks.get(k, set()) | blocks.get(k + 1, set()))
            for label, part in lookup.met(ranks, min(block, len(words) - k * half)):
                labels.add(label)
                score = max(score, part)
        first, last = (min(places), max(places)) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        rows = list(map(judge, part.column(at).to_pylist()))
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return added(docs, names, ["bigint"] * 4 + ["string"] * 2 + ["double"], work)
