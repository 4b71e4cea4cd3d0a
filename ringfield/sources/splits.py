"""Records of large files, cut by many tasks, with places that do not depend on how the files were split.

Spark's text reader splits a file wherever it likes and hands out pieces up to a separator. For lines that is a line feed; a JSON
document, which may be one line of any length, is read in pieces up to a closing brace. What a piece means (its byte
offset, whether it begins inside a string, how deeply it is nested) follows from what stands before it. Each block of
the file is summed up for both cases, that it begins inside a string or not; the sums of a file's blocks, a row each,
are put in order; and every piece then knows its place. Only the pieces of one block are ever put in order together.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

BLOCK = ["file", "block"]

def _in_block(last: int = -1) -> WindowSpec:
    """Pieces of the same block up to this one (0) or the one before."""
    return W.partitionBy(*BLOCK).orderBy("seq").rowsBetween(W.unboundedPreceding, last)


def _blocks() -> WindowSpec:
    """Earlier blocks of the same file."""
    return W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)


def _read(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, seq, size, value): pieces in the order of the file; the separator is left out."""
    pieces = spark.read.option("lineSep", separator).text(path)
    meta = [F.col(f"_metadata.{m}").alias(n) for m, n in (("file_path", "file"), ("file_block_start", "block"), ("file_size", "size"))]
    return pieces.select(*meta, F.monotonically_increasing_id().alias("seq"), "value")


def _before(column: str | Column, over: WindowSpec | None = None) -> Column:
    return F.coalesce(F.sum(column).over(over or _in_block()), F.lit(0))


def _with_blocks(pieces: DataFrame, sums: DataFrame) -> DataFrame:
    return pieces.join(sums, BLOCK)


def file_numbers(df: DataFrame) -> DataFrame:
    """(file, file_no): files numbered by name. One row for each file."""
    return df.select("file").distinct().withColumn("file_no", F.row_number().over(W.orderBy("file")) - 1)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds an id made of the file's number and the byte offset `start`: the same however the files are split."""
    numbers = file_numbers(df)
    return df.join(numbers, "file").withColumn(name, F.col("file_no") * F.lit(1 << 44) + F.col("start")).drop("file_no")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): lines with the byte offset at which they begin."""
    pieces = _read(spark, path, "\n").withColumn("bytes", F.octet_length("value").cast("long") + 1)
    placed = pieces.withColumn("at", _before("bytes"))
    sums = pieces.groupBy(*BLOCK).agg(F.sum("bytes").alias("bytes"))
    sums = sums.select(*BLOCK, _before("bytes", _blocks()).alias("first"))
    whole = _with_blocks(placed, sums)
    return whole.select("file", (F.col("first") + F.col("at")).alias("start"), F.regexp_replace("value", "\r$", "").alias("line"))


def _count(text: Column, letter: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(letter)))).cast("long")


@F.arrow_udf(IntegerType())
def _opening(values: pa.Array, depths: pa.Array, levels: pa.Array) -> pa.Array:
    """Position (from 1) of the brace that opens a record, in pieces that begin outside of strings and above a record."""
    out = []
    for text, depth, level in zip(values.to_pylist(), depths.to_pylist(), levels.to_pylist()):
        quoted = escaped = False
        found = 0
        for at, c in enumerate(text):
            if escaped:
                escaped = False
            elif quoted:
                escaped, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                if c == "{" and depth == level:
                    found = at + 1
                    break
                depth += 1
            elif c == "]":
                depth -= 1
        out.append(found)
    return pa.array(out, pa.int32())


def json_records(spark: SparkSession, path: str, collection: str = "") -> DataFrame:
    """(file, start, record): the objects of JSON files as text, with their byte offsets.

    Files hold one object a line, or anywhere one after the other; a file in which a first-level array of the name
    `collection` (any name, if empty) begins holds the objects of its first-level arrays instead. A file that
    ends inside a string or an object, or has other text between its objects, is an error.
    """
    pieces = _read(spark, path, "}")
    plain = F.regexp_replace("value", r"\\.", "")
    parts = F.split(plain, '"')
    outside, inside = (F.array_join(F.filter(parts, lambda p, n: n % 2 == side), "") for side in (0, 1))

    def deeper(text: Column) -> Column:
        return _count(text, "{") + _count(text, "[") - _count(text, "]")

    marked = pieces.select(
        *BLOCK, "size", "seq", "value", F.octet_length("value").cast("long").alias("bytes"), (F.size(parts) - 1).cast("long").alias("quotes"),
        deeper(outside).alias("up0"), deeper(inside).alias("up1"),
    )
    placed = marked.withColumns({"at": _before(F.col("bytes") + 1), "parity": _before("quotes") % 2})
    # What the piece and its closing brace do to the depth, if the block begins outside (0) or inside (1) a string.
    for case in (0, 1):
        starts = (F.col("parity") + case) % 2
        closes = F.when((starts + F.col("quotes")) % 2 == 0, 1).otherwise(0)
        placed = placed.withColumn(f"up{case}_", F.when(starts == 0, F.col("up0")).otherwise(F.col("up1"))).withColumn(f"net{case}", F.col(f"up{case}_") - closes)
    sums = placed.groupBy(*BLOCK).agg(F.sum(F.col("bytes") + 1).alias("bytes"), (F.sum("quotes") % 2).alias("odd"), F.sum("net0").alias("net0"), F.sum("net1").alias("net1"))
    sums = sums.withColumns({"case": _before("odd", _blocks()) % 2, "first": _before("bytes", _blocks())})
    sums = sums.withColumn("net", F.when(F.col("case") == 0, F.col("net0")).otherwise(F.col("net1"))).withColumn("base", _before("net", _blocks()))
    known = _with_blocks(placed, sums.select(*BLOCK, "case", "first", "base"))
    net, up = (F.when(F.col("case") == 0, F.col(f"{n}0{s}")).otherwise(F.col(f"{n}1{s}")) for n, s in (("net", ""), ("up", "_")))
    known = known.select(
        *BLOCK, "seq", "value", "bytes", "size", (F.col("first") + F.col("at")).alias("offset"), ((F.col("parity") + F.col("case")) % 2).alias("quoted"),
        net.alias("net"), up.alias("up"), "base", F.col("quotes"),
    )
    known = known.withColumn("depth", F.col("base") + _before("net")).withColumn("ends", F.col("depth") + F.col("up"))
    # The last piece of a file is not closed, unless the file ends with a brace.
    open_end = F.col("offset") + F.col("bytes") >= F.col("size")
    name = f'"{collection}"' if collection else '"[^"]*"'
    lists = F.max((F.col("depth") <= 1) & (F.col("quoted") == 0) & F.col("value").rlike(rf"^[^\[]*{name}\s*:\s*\["))
    in_string = F.when((F.col("quoted") + F.col("quotes")) % 2 == 1, 1).otherwise(0)
    is_last = F.col("offset") + F.col("bytes") + 1 >= F.col("size")
    left = F.max(F.when(open_end, F.col("ends") + in_string).when(is_last, F.col("depth") + F.col("net") + in_string))
    files = known.groupBy("file").agg(F.when(lists, 2).otherwise(0).alias("level"), left.alias("left"))
    states = known.join(files, "file").where(
        F.when(F.coalesce(F.col("left"), F.lit(0)) != 0, F.raise_error(F.concat(F.lit("incomplete JSON: "), F.col("file")))).otherwise(True)
    )
    level = F.col("level")
    opens = (F.col("depth") <= level) & (F.col("ends") > level) & ~open_end
    plainly = (F.col("depth") == level) & (F.col("quoted") == 0)
    first = F.when(plainly, F.instr("value", "{")).otherwise(_opening("value", F.col("depth").cast("int"), level))
    # Pieces that open a record are few among those of a document's head, and only they are looked through letter by letter.
    heads = states.where(opens & ~plainly).withColumn("from", first)
    others = states.where(~opens | plainly).withColumn("from", F.when(opens, F.instr("value", "{")))
    states = heads.unionByName(others).withColumn("from", F.when(F.col("from") > 0, F.col("from")))
    between = F.regexp_replace(F.when(F.col("from").isNotNull(), F.substring("value", F.lit(1), F.col("from") - 1)).otherwise(F.col("value")), r"[\s,\[\]]", "")
    stray = plainly & (level == 0) & (between != "")
    states = states.withColumn("start", F.col("offset") + F.octet_length(F.substring("value", F.lit(1), F.col("from") - 1)))
    states = states.where(F.when(stray, F.raise_error(F.concat(F.lit("text between JSON objects: "), F.col("file")))).otherwise(True))
    # A piece belongs to the last record opened, in its block or in an earlier one.
    states = states.withColumn("own", F.last("start", True).over(_in_block(0)))
    lasts = states.groupBy(*BLOCK).agg(F.max("start").alias("start"))
    lasts = lasts.select(*BLOCK, F.last("start", True).over(_blocks()).alias("carried"))
    owned = states.join(lasts, BLOCK).withColumn("start", F.coalesce("own", "carried"))
    held = owned.where((F.col("from").isNotNull()) | (F.col("depth") > level))
    text = F.when(F.col("from").isNotNull(), F.expr("substring(value, from)")).otherwise(F.col("value"))
    rows = held.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("offset", text.alias("t")))).alias("p"))
    return rows.select("file", "start", F.concat(F.array_join(F.transform("p", lambda p: p["t"]), "}"), F.lit("}")).alias("record"))
