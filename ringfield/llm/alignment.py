"""Cross-tokenizer alignment: which tokens of B stand where which tokens of A stand, counted over a whole corpus.

A text is encoded by both tokenizers. The byte offsets at which a token of A and a token of B both end cut the tokens into
groups; a link is a pair of tokens whose byte ranges end together, which is the last of A and the last of B in each group.

Most groups are one token of A and one of B over the same bytes. For those `identity` holds, for each id of A, the id of B
with the same bytes: they are counted in one vector of A's vocabulary length a task (one to one groups whose id of B is
another one go the irregular way). Only irregular groups enter the pair shuffle, as counts per document and pair, combined
before the shuffle. Counts come back the same way: totals of identity pairs and the highest count of each id of B are
vectors of vocabulary length, which are broadcast; of the irregular pairs those with more than 1/`HOT` of all links are
fewer than `HOT` and are broadcast too, so no key of the join of the others holds more than that share of the links.

Both tokenizers are run on the words of a text, each distinct word of a task once, and what a word gives (its groups as text,
its counts and ids) is added up for each text. Words end where a new token begins in both tokenizers whatever stands around:
before a single space or line feed between two characters that are no white space, and between a letter and a mark. A's pattern
takes a space together with what follows, a line feed alone, and no letter with a mark; no piece of B goes on with a space,
holds a line feed or has a mark behind a letter. Tokenizers for which that does not hold (checked when they are loaded)
are given whole texts.

Cases: texts that are null or empty, or that either tokenizer does not give back byte for byte, have no tokens: zeros and an
empty string. Repeated rows and ids stay rows of their own. An empty table gives an empty result. Very long texts are cut
whole; a task holds a few megabytes of texts at once, or one text. Columns of the table that bear the name of a result column
(or of the text) are left out of the result. Ties for the highest count of an id of B are all best.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.llm.text import fresh, repeat_lengths, rows_of, stored

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Irregular pairs above this share (one in `HOT`) of all links are broadcast, fewer than `HOT` of them.
HOT = 1 << 16
#: Distinct words a task remembers before it begins anew.
WORDS = 200_000
# The published pattern of byte-level BPE, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
WORD = re.compile(rf"(?<=\S)(?=[ \n]\S)|(?<={LETTER})(?=[^\w\s])")
RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def byte_alphabet() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if it is printed, else the next from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the id of B for each id of A with the same bytes (-1: none)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(alphabet[c] for c in name) for name in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        plain = [i for i in range(len(pieces)) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        # Of two ids with the same bytes the piece goes before the byte, then the smaller id.
        first: dict[bytes, int] = {}
        for i in sorted(plain, key=lambda i: (self.b.is_byte(i), i)):
            first.setdefault(self.b_bytes[i], i)
        self.identity = [first.get(t, -1) for t in self.a_bytes]
        # How a group of one token each reads, by its id of A.
        self.said = [f"{t}|{same}" for t, same in enumerate(self.identity)]
        rules = json.loads(self.a.to_str())
        form = rules["pre_tokenizer"] or {}
        plain_bytes = rules["normalizer"] is None and form.get("type") == "ByteLevel" and form.get("use_regex") is True
        ordinary = [pieces[i] for i in plain if not self.b.is_byte(i)]
        across = re.compile(rf"[^▁]▁|\n|{LETTER}[^\w\s▁]")
        self.by_words = (
            plain_bytes and not form.get("add_prefix_space") and self.b.normalize(" a  b\tÅ ﬁ ") == "▁▁a▁▁b\tÅ▁ﬁ▁"
            and not any(across.search(p) for p in ordinary) and len(self.b.encode("a")) == 1
        )
        # Where the merges stand in the order of their ids, ranks say the same, and short words are encoded faster by them.
        added = {t["id"] for t in rules["added_tokens"]}
        ranks = {t: i for i, t in enumerate(self.a_bytes) if i not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in rules["model"]["merges"]]
        made = [rules["model"]["vocab"][m[0] + m[1]] for m in merges]
        self.ranked = None
        if plain_bytes and self.by_words and made == sorted(set(made)) and set(range(256)).isdisjoint(made):
            import tiktoken

            self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both. B puts a space before what it is given: that is the one a word begins with; before other words a
        letter is put, whose piece goes."""
        if self.ranked is not None:
            one = [self.ranked.encode_ordinary(w) for w in words]
        else:
            one = [e.ids for e in self.a.encode_batch(words, add_special_tokens=False)]
        two = self.b.encode([w[1:] if w[0] == " " else "a" + w for w in words], num_threads=1)
        return [(a, b if w[0] == " " else b[1:]) for w, a, b in zip(words, one, two, strict=True)]


def cut(one: list[int], two: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
    """Ids of A and of B between the offsets where tokens of both end."""
    i = j = start_i = start_j = at_a = at_b = 0
    while i < len(one) or j < len(two):
        if at_a <= at_b:
            at_a += len(a_bytes[one[i]])
            i += 1
        else:
            at_b += len(b_bytes[two[j]])
            j += 1
        if at_a == at_b:
            yield one[start_i:i], two[start_j:j]
            start_i, start_j = i, j


def aligned(words: list[str], both: Tokenizers) -> list[tuple | None]:
    """For each word: groups as text, numbers of tokens and groups, ids of A in identity groups, keys of the other links."""
    out: list[tuple | None] = []
    size, identity = len(both.b_bytes), both.identity
    for word, (one, two) in zip(words, both.encode(words), strict=True):
        if [identity[t] for t in one] == two:
            out.append((";".join([both.said[t] for t in one]), len(one), len(one), len(one), one, ()))
            continue
        target = word.encode("utf-8", "surrogatepass")
        if b"".join(both.a_bytes[t] for t in one) != target or b"".join(both.b_bytes[t] for t in two) != target:
            out.append(None)
            continue
        said, same, other = [], [], []
        for mine, theirs in cut(one, two, both.a_bytes, both.b_bytes):
            said.append(",".join(map(str, mine)) + "|" + ",".join(map(str, theirs)))
            if len(mine) == len(theirs) == 1 and identity[mine[0]] == theirs[0]:
                same.append(mine[0])
            else:
                other.append(mine[-1] * size + theirs[-1])
        out.append((";".join(said), len(one), len(two), len(said), same, other))
    return out


def hashed(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


class Known:
    """What the words of a task have given so far, by number of the word."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.said: list[str] = []
        # n_a, n_b, n_groups, whether the bytes do not come back, how many identity tokens and other links.
        self.counts: list[tuple[int, ...]] = []
        self.same: list[int] = []
        self.other: list[int] = []

    def add(self, words: list[str], both: Tokenizers) -> None:
        for word, found in zip(words, aligned(words, both), strict=True):
            said, n_a, n_b, n, same, other = found or ("", 0, 0, 0, (), ())
            self.at[word] = len(self.said)
            self.said.append(said)
            self.counts.append((n_a, n_b, n, found is None, len(same), len(other)))
            self.same += same
            self.other += other


def counted(numbers: np.ndarray, text: np.ndarray, texts: int, lengths: np.ndarray, flat: list[int]) -> list[pa.Array]:
    """For each text the distinct ids that its words (`numbers`) hold, and how often: two lists a text."""
    own, starts = lengths[numbers], (np.cumsum(lengths) - lengths)[numbers]
    ids = np.array(flat, np.int64)[np.repeat(starts, own) + repeat_lengths(own)]
    size = int(ids.max(initial=0)) + 1
    found, times = np.unique(np.repeat(text, own) * size + ids, return_counts=True)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(found // size, minlength=texts))]).astype(np.int32)
    return [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (found % size, times)]


def read_groups(docs: DataFrame, text_col: str, a_path: str, b_path: str, digest: bool) -> DataFrame:
    """Each row without its text, with its groups and with counted identity tokens and counted keys of other links."""
    kept = [c for c in docs.columns if c.lower() not in {text_col.lower(), *RESULT}]
    row, same, same_n, other, other_n = fresh(docs, "row", "same", "same_n", "other", "other_n")
    made = ["n_a", "n_b", "n_groups", "groups", same, same_n, other, other_n]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    types = ["bigint", "bigint", "bigint", "string", *["array<bigint>"] * 4]
    schema = ", ".join(fields + [f"`{n}` {t}" for n, t in zip(made, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, known = None, Known()
        for part in rows_of(batches):
            both = both or Tokenizers(a_path, b_path)
            if len(known.at) > WORDS:
                known = Known()
            whole = [" " + t if t else "" for t in part.column(len(kept)).to_pylist()]
            texts = [WORD.split(t) if t and both.by_words else [t] if t else [] for t in whole]
            words = list(chain.from_iterable(texts))
            known.add(list(set(words) - known.at.keys()), both)
            numbers = np.fromiter(map(known.at.__getitem__, words), np.int64, len(words))
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            counts = np.array(known.counts, np.int64).reshape(-1, 6)
            sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[numbers, :4], axis=0)])
            sums = sums[ends[1:]] - sums[ends[:-1]]
            whole_back = sums[:, 3] == 0
            sums[~whole_back] = 0
            text = np.repeat(np.arange(len(texts)), sizes)
            good = whole_back[text]
            said = [";".join(map(known.said.__getitem__, numbers[a:b].tolist())) if ok else "" for a, b, ok in zip(ends[:-1], ends[1:], whole_back)]
            columns = [*(pa.array(sums[:, n]) for n in range(3)), pa.array(list(map(hashed, said)) if digest else said, pa.string())]
            for n, flat in ((4, known.same), (5, known.other)):
                columns += counted(numbers[good], text[good], len(texts), counts[:, n], flat)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], [*kept, *made])

    return docs.select(*kept, text_col).mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id())


def count_pairs(read: DataFrame, names: list[str], a_path: str, b_path: str) -> DataFrame:
    """(a, b, n, same): how many links of the corpus hold the pair; `same` for pairs of the identity map."""
    same, same_n, other, other_n = names

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, counts = None, None
        for part in batches:
            both = both or Tokenizers(a_path, b_path)
            counts = np.zeros(len(both.identity), np.int64) if counts is None else counts
            np.add.at(counts, part.column(0).flatten().to_numpy(), part.column(1).flatten().to_numpy())
        if counts is not None:
            at = np.flatnonzero(counts)
            columns = [pa.array(at), pa.array(np.array(both.identity)[at]), pa.array(counts[at]), pa.array(np.ones(len(at), bool))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n", "same"])

    shape = "a bigint, b bigint, n bigint, same boolean"
    regular = read.select(same, same_n).mapInArrow(vectors, shape)
    size = len(Tokenizers(a_path, b_path).b_bytes)
    odd = read.select(F.explode(F.arrays_zip(F.col(other).alias("key"), F.col(other_n).alias("n"))).alias("x"))
    a, b = F.expr(f"x.key div {size}"), F.col("x.key") % size
    odd = odd.select(a.alias("a"), b.alias("b"), F.col("x.n").alias("n"), F.lit(False).alias("same"))
    counted = odd.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("same").alias("same"))
    return regular.union(counted).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("same").alias("same"))


def align(
    docs: DataFrame, text_col: str = "text", a_path: str = A_PATH, b_path: str = B_PATH, pairs_path: str | None = None,
    digest: bool = False,
) -> DataFrame:
    """The rows without their text, with n_a, n_b, n_groups, n_links, n_best, count_sum and `groups` (`a1,a2|b1;a3|b2`).

    n_best: links whose pair has the highest count of its id of B. count_sum: the counts of the pairs, over links.
    `digest`: `groups` is the SHA-256 of that text, in lowercase hex (of no groups: empty). `pairs_path`: where to write the
    table of counted pairs (a, b, n). The tokenizers' files must be readable on every worker.
    """
    spark = docs.sparkSession
    row, same, same_n, other, other_n = fresh(docs, "row", "same", "same_n", "other", "other_n")
    read = stored(read_groups(docs, text_col, a_path, b_path, digest), "token-groups")
    pairs = count_pairs(read, [same, same_n, other, other_n], a_path, b_path)
    pairs = stored(pairs, "token-pairs")
    if pairs_path is not None:
        pairs.select("a", "b", "n").write.parquet(pairs_path)
    both = Tokenizers(a_path, b_path)
    size = len(both.b_bytes)
    # Bounded by the vocabularies: one count for each id of A, one for each id of B. Bounded by HOT: the hot pairs.
    totals, highest = np.zeros(len(both.identity), np.int64), np.zeros(size, np.int64)
    for r in pairs.where("same").select("a", "n").collect():
        totals[r[0]] = r[1]
    best = pairs.groupBy("b").agg(F.max("n").alias("most"))
    for r in best.collect():
        highest[r[0]] = r[1]
    links = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > F.lit(links / HOT)
    hot = sorted((r[0] * size + r[1], r[2]) for r in pairs.where(~F.col("same") & is_hot).select("a", "b", "n").collect())
    hot_keys, hot_counts = np.array([h[0] for h in hot], np.int64), np.array([h[1] for h in hot], np.int64)
    top = highest[np.array(both.identity)] == totals
    held = spark.sparkContext.broadcast((totals, top, hot_keys, hot_counts, highest))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, top, hot_keys, hot_counts, highest = held.value

        def summed(of: pa.Array, values: np.ndarray) -> np.ndarray:
            ends = np.concatenate([[0], np.cumsum(values)])
            lengths = np.concatenate([[0], np.cumsum(pc.list_value_length(of).to_numpy())])
            return ends[lengths[1:]] - ends[lengths[:-1]]

        for part in batches:
            rows, tokens, times, keys, often = part.columns
            t, n = tokens.flatten().to_numpy(), times.flatten().to_numpy()
            k, m = keys.flatten().to_numpy(), often.flatten().to_numpy()
            at = np.searchsorted(hot_keys, k)
            known = np.zeros(len(k), bool)
            inside = at < len(hot_keys)
            known[inside] = hot_keys[at[inside]] == k[inside]
            count = np.zeros(len(k), np.int64)
            count[known] = hot_counts[at[known]]
            is_top = known & (count == highest[k % size])
            sums = summed(tokens, n * totals[t]) + summed(keys, m * count)
            tops = summed(tokens, n * top[t]) + summed(keys, m * is_top)
            of = np.repeat(np.arange(len(rows)), pc.list_value_length(keys).to_numpy())[~known]
            starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(rows)))]).astype(np.int32)
            left = [pa.ListArray.from_arrays(starts, pa.array(x[~known], pa.int64())) for x in (k, m)]
            yield pa.RecordBatch.from_arrays([rows, pa.array(sums, pa.int64()), pa.array(tops, pa.int64()), *left], ["row", "s", "t", "key", "m"])

    wanted = read.select(F.col(row).alias("row"), same, same_n, other, other_n)
    looked = stored(wanted.mapInArrow(look_up, "row bigint, s bigint, t bigint, key array<bigint>, m array<bigint>"), "token-sums")
    cold = pairs.where(~F.col("same") & ~is_hot).join(F.broadcast(best), "b")
    cold = cold.select((F.col("a") * size + F.col("b")).alias("key"), "n", (F.col("n") == F.col("most")).cast("long").alias("top"))
    asked = looked.select("row", F.explode(F.arrays_zip("key", "m")).alias("x")).select("row", "x.key", "x.m")
    met = asked.join(cold, "key").select("row", (F.col("m") * F.col("n")).alias("s"), (F.col("m") * F.col("top")).alias("t"))
    sums = looked.select("row", "s", "t").union(met).groupBy("row").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    sums = sums.select(F.col("row").alias(row), F.col("t").alias("n_best"), F.col("s").alias("count_sum"))
    kept = [c for c in read.columns if c not in {row, same, same_n, other, other_n}]
    whole = read.select(row, *kept, F.col("n_groups").alias("n_links")).join(sums, row)
    return whole.select(*[c for c in kept if c not in RESULT], *RESULT)
