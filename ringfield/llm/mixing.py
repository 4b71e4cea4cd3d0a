"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Sources share `share` times all words by their weights; no source passes `most` times its own words, what is above is
shared again. The level of this water filling has a closed form: over sources in the order of (cap / weight), it is the
largest (total - caps before) / (weights from here on), or 0.

Every document of a source should be taken target / size times. The whole part is taken; the fraction is rounded by the
pivotal method: two documents with fractions p and q fight, and the mass moves until one of them is 0 or 1, each outcome
with the probability that keeps both expectations. Documents of a source are put into groups of about `GROUP` of similar
length; within a group the fights are a fold over the group's array, and the one fraction left over goes to the next
level, where groups are `GROUP` times fewer. After log(n) levels one fraction per source is left, which a hash decides.
Chance comes from hashes of the document, so reruns agree and no order of rows matters.

Cases: null texts have size 0, as empty ones; documents of size 0 and sources without words take 0 words; null sources
are one source, the last; repeated rows are rounded each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfield.llm.text import stored

GROUP = 64
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
CLASSES = 64


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of (source, size); one row for each source, the only table that is ordered whole."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * most
    levelled = ranked.withColumn("weight", weight).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(whole) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest
    filled = levelled.withColumn("level", F.greatest(level, F.lit(0.0)))
    lifted = filled.withColumn("level", F.max("level").over(whole))
    return lifted.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def chance(*of: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def rounded(docs: DataFrame, seed: int = 0) -> DataFrame:
    """`docs` (source, size, h, p, row) with `extra` 0 or 1 instead of p; `row` is carried along."""
    sure = docs.where("p <= 0 or p >= 1").select("source", "row", (F.col("p") >= 1).cast("int").alias("extra"))
    open_ = docs.where("p > 0 and p < 1")
    grade = F.least(F.floor(F.log2(F.col("size") + 1) * 3), F.lit(CLASSES - 1)).cast("int")
    counted = open_.withColumn("grade", grade)
    groups = stored(counted.groupBy("source", "grade").agg(F.ceil(F.count("*") / GROUP).alias("groups")), "mix-groups")
    most = groups.agg(F.max("groups")).first()[0] or 0
    # Few rows (sources times grades); null sources are told apart by the null-safe comparison.
    g = groups.select(F.col("source").alias("s_"), F.col("grade").alias("g_"), "groups")
    level = counted.join(g, counted["source"].eqNullSafe(g["s_"]) & (counted["grade"] == g["g_"]))
    level = level.select("source", "grade", F.pmod(F.xxhash64("h", F.lit(seed)), F.col("groups")).alias("part"), "h", "p", "row")
    done = [sure]
    step, keys = 0, ["source", "grade", "part"]
    while True:
        item = F.struct("h", "p", "row")
        row_type = docs.schema["row"].dataType.simpleString()
        start = F.struct(
            F.expr(f"cast(null as struct<h:bigint,p:double,row:{row_type}>)").alias("left"),
            F.expr(f"cast(array() as array<struct<row:{row_type},extra:int>>)").alias("done"),
        )
        level = level.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
        salt = seed + 1 + step
        result = level.select(*keys, F.aggregate("items", start, lambda s, x: meet(s, x, salt, row_type)).alias("r"))  # noqa: B023
        result = stored(result, f"mix-level{step}")
        done.append(result.select("source", F.explode("r.done").alias("d")).select("source", "d.row", "d.extra"))
        rest = result.where("r.left is not null").select(*keys, "r.left.*")
        if keys == ["source"]:
            last = (chance(F.col("h"), F.lit(seed - 1)) < F.col("p")).cast("int")
            done.append(rest.select("source", "row", last.alias("extra")))
            break
        step += 1
        if most > 1:
            most = -(-most // GROUP)
            level = rest.withColumn("part", F.floor(F.col("part") / GROUP))
        else:
            # One fraction for each grade is left.
            keys, level = ["source"], rest.drop("grade", "part")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def meet(state: Column, item: Column, salt: int, row_type: str) -> Column:
    """One fight: the holder (if any) against the next item."""
    left, done = state["left"], state["done"]
    a, b = left["p"], item["p"]
    total = a + b
    draw = chance(left["h"], item["h"], F.lit(salt))
    under = total < 1
    # Below 1: one goes to 0, the other holds the sum. From 1 on: one goes to 1, the other holds the rest.
    item_holds = F.when(under, draw < b / total).otherwise(draw < (1 - a) / (2 - total))
    mass = F.when(under, total).otherwise(total - 1)
    holder = F.when(item_holds, item).otherwise(left)
    loser = F.when(item_holds, left).otherwise(item)
    over = F.struct(loser["row"].alias("row"), F.when(under, 0).otherwise(1).alias("extra"))
    kept = F.struct(holder["h"].alias("h"), mass.alias("p"), holder["row"].alias("row"))
    whole = mass <= 1e-12
    ended = F.struct(holder["row"].alias("row"), F.lit(0).alias("extra"))
    nothing = F.expr(f"cast(null as struct<h:bigint,p:double,row:{row_type}>)")
    fought = F.struct(
        F.when(whole, nothing).otherwise(kept).alias("left"),
        F.concat(done, F.when(whole, F.array(over, ended)).otherwise(F.array(over))).alias("done"),
    )
    return F.when(left.isNull(), F.struct(item.alias("left"), done.alias("done"))).otherwise(fought)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for each row of `docs`."""
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "mix-sizes")
    goal = targets(sized.select("source", "size"))
    goal = goal.select(F.col("source").alias("s_"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    full = sized.join(goal, sized["source"].eqNullSafe(goal["s_"])).drop("s_").withColumn("rate", rate)
    near = F.abs(F.col("rate") - F.round("rate")) < 1e-9
    base = F.when(near, F.round("rate")).otherwise(F.floor("rate"))
    base = F.when(F.col("size") == 0, 0).otherwise(base).cast("long")
    p = F.when(near | (F.col("size") == 0), 0.0).otherwise(F.col("rate") - F.floor("rate"))
    row = F.struct("doc_id", "size", "source_size", "target", base.alias("base"))
    items = full.select("source", "size", F.xxhash64("doc_id", "size", "source").alias("h"), p.alias("p"), row.alias("row"))
    done = rounded(items, seed)
    copies = F.col("row.base") + F.col("extra")
    return done.select(
        "row.doc_id", "row.size", "row.source_size", "row.target", (F.col("row.size") * copies).alias("taken"), copies.alias("copies"), "source"
    )
