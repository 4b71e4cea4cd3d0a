"""PII: well-formed identifiers, and unseen ones by bootstrapped contextual extraction.

The base finds emails, IP addresses, card and phone numbers by their form. These are the seeds. Candidates are what no
base span touches and looks like an identifier: emails with `[at]`, ` at `, `[dot]` and the like, addresses with `[.]`,
` dot ` or colons, digit groups across blanks, brackets and dashes, and other tokens with at least `DIGITS` digits. The
first two can only become emails and addresses, the others any kind. Lexical patterns are the one to `CONTEXT` words on
either side. Patterns and instances make a graph, built by sums over the corpus: a pattern's confidence for a kind is the
believed share of what it stands beside, believed / (all + `DOUBT`); an instance is as believed as its best pattern.
`ROUNDS` times the beliefs move over the graph by joins. Candidates beside a pattern with a confidence of at least `SURE`
become spans of the kind of their surest pattern.

Cases: null texts are empty; an entity without words on a side has no patterns there; spans of
the base never change; equal places of several kinds are all kept, in the order of the kinds; rows are told apart by (id,
hash of the text), so repeated rows are one document that is counted once for each row and returned as often; other
columns take no part.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.llm.text import rows_of, stored

# Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
DIGITS = 5
CONTEXT = 3
DOUBT = 2.0
SURE = 0.8
ROUNDS = 3

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always begins at the first digit of a run, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Unusual writings; the signs between the parts stand once, so that a match is found in linear time.
DOT = r"(?:\.|\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20(?:dot|\.)\x20)"
AT = re.compile(r"\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20(?:at|@)\x20|@", re.I)
HOST = re.compile(rf"[a-z0-9-]+({DOT}[a-z0-9-]+)*", re.I)
SPLIT_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
COLON_IP = re.compile(r"(?<![0-9a-z:])(?:[0-9a-f]{0,4}:){3,7}[0-9a-f]{1,4}(?![0-9a-z:])", re.I)
GROUP = re.compile(r"\+?\(?[0-9]+\)?")
GROUPS = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9]{1,6}(?![0-9])\)?(?:(?:[\x20./-]{1,2}\(?|(?<=\)))[0-9]{1,6}(?![0-9A-Za-z])\)?)*")
MOST = 19
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "\"'()[]{}<>.,;:!?*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each `@` on; what stands before it reaches back to the end of the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def around(text: str, start: int, end: int) -> list[str]:
    """Patterns of a place: `<` and the words before, `>` and the words after, A-Z lower-cased, signs at their ends left out."""
    head = [w for x in text[max(0, start - 200) : start].split()[-2 * CONTEXT :] if (w := x.strip(EDGE).lower())]
    tail = [w for x in text[end : end + 200].split()[: 2 * CONTEXT] if (w := x.strip(EDGE).lower())]
    left = ["<" + " ".join(head[-n:]) for n in range(1, min(CONTEXT, len(head)) + 1)]
    return left + [">" + " ".join(tail[:n]) for n in range(1, min(CONTEXT, len(tail)) + 1)]


def digit_runs(text: str) -> Iterator[tuple[int, int]]:
    """Digit groups that belong together: a blank is crossed up to seven digits, and between groups of equal length."""
    for m in GROUPS.finditer(text):
        start, end, last, sizes = m.start(), m.start(), m.start(), []
        for g in GROUP.finditer(text, m.start(), m.end()):
            size = sum(map(str.isdigit, g.group()))
            blank = sizes and " " in text[last : g.start()]
            if blank and sum(sizes) >= 7 and size != sizes[-1] and [*sizes, size] != [4, 6, 5]:
                if DIGITS <= sum(sizes) <= MOST:
                    yield start, end
                start, sizes = g.start(), []
            sizes.append(size)
            last = end = g.end()
        if DIGITS <= sum(sizes) <= MOST:
            yield start, end


def candidates(text: str) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, the only kind it can have), in the order in which they are preferred."""
    done = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        host = HOST.match(text, m.end()) if start < m.start() else None
        # A bare word `at` makes an email only before a name with dots.
        if host and (m.group().strip().lower() != "at" or host.group(1)):
            yield start, host.end(), "email"
            done = host.end()
    for form in (SPLIT_IP, COLON_IP):
        for m in form.finditer(text):
            yield *m.span(), "ip"
    for a, b in digit_runs(text):
        yield a, b, None
    for m in TOKEN.finditer(text):
        raw = m.group()
        if sum(map(raw.count, "0123456789")) >= DIGITS:
            yield m.start() + len(raw) - len(raw.lstrip(EDGE)), m.start() + len(raw.rstrip(EDGE)), None


def occurrences(text: str | None) -> list[dict]:
    """Base spans (with kind) and candidates (without), each with its patterns and its value."""
    if not text:
        return []
    found = [(a, b, k, None) for a, b, k in base_spans(text)]
    # Starts of disjoint taken stretches and their ends; base spans that overlap are one stretch.
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for a, b, _, _ in found):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for a, b, form in candidates(text):
        i = bisect(ends, a)
        if i < len(starts) and starts[i] < b:
            continue
        starts.insert(i, a)
        ends.insert(i, b)
        found.append((a, b, None, form))
    return [{"start": a, "end": b, "kind": k, "form": f, "patterns": around(text, a, b), "value": text[a:b].lower()} for a, b, k, f in found]


def patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) from (pattern, value, kind, form, n); kind is null for candidates, form if it is open."""
    size = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.sum("n").alias("seeds"))
    seeds = stored(seeds.join(size, "pattern"), "pii-seeds")
    open_ = stored(edges.where("kind is null").select("pattern", "value", "form", "n"), "pii-candidates")
    found = seeds.select("pattern", "kind", "all", (F.col("seeds") / (F.col("all") + DOUBT)).alias("confidence"))
    fits = F.coalesce(F.col("form") == F.col("kind"), F.lit(True))
    for step in range(rounds):
        belief = open_.join(found, "pattern").where(fits).groupBy("value", "kind").agg(F.max("confidence").alias("belief"))
        gain = open_.join(belief, "value").where(fits).groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("gain"))
        both = seeds.drop("all").join(gain, ["pattern", "kind"], "full").join(size, "pattern")
        mass = F.coalesce("seeds", F.lit(0)) + F.coalesce("gain", F.lit(0.0))
        found = stored(both.select("pattern", "kind", "all", (mass / (F.col("all") + DOUBT)).alias("confidence")), f"pii-round{step}")
    return found.select("pattern", "kind", "confidence")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind number, kind, end), sorted."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("form", pa.string()), ("patterns", pa.list_(pa.string())), ("value", pa.string())])
    key = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            found = pa.array([occurrences(t) for t in part.column(2).to_pylist()], pa.list_(item))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], ["doc_id", "th", "found"])

    shape = f"doc_id {key}, th bigint, found array<struct<start:bigint,end:bigint,kind:string,form:string,patterns:array<string>,value:string>>"
    scanned = stored(given.mapInArrow(run, shape), "pii-scan")
    each = scanned.select("doc_id", "th", F.explode("found").alias("x")).select("doc_id", "th", "x.*")
    each = each.select("*", F.explode("patterns").alias("pattern")).drop("patterns")
    edges = each.groupBy("pattern", "value", "kind", "form").agg(F.count("*").alias("n"))
    trusted = patterns(edges).where(F.col("confidence") >= sure).select("pattern", F.col("kind").alias("found_kind"), "confidence")
    new = each.where("kind is null").join(trusted, "pattern").where(F.coalesce(F.col("form") == F.col("found_kind"), F.lit(True)))
    # One kind for each place: that of its surest pattern.
    best = F.min(F.struct((-F.col("confidence")).alias("doubt"), "found_kind"))["found_kind"].alias("found_kind")
    new = new.groupBy("doc_id", "th", "start", "end").agg(best)
    new = new.select("doc_id", "th", entry(F.col("start"), F.col("found_kind"), F.col("end")).alias("span"))
    new = new.groupBy(F.col("doc_id").alias("d_"), F.col("th").alias("t_")).agg(F.collect_list("span").alias("new"))
    base = F.sort_array(F.transform(F.filter("found", lambda x: x["kind"].isNotNull()), lambda x: entry(x["start"], x["kind"], x["end"])))
    rows = scanned.select("doc_id", "th", base.alias("base"))
    out = rows.join(new, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("t_")), "left")
    return out.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("new", F.array().cast(out.schema["base"].dataType)))).alias("spans"))


def entry(start, kind, end):
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    return F.struct(start.alias("start"), number.alias("number"), kind.alias("kind"), end.alias("end"))


def listed(spans):
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))
