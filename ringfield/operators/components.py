"""Connected components, and the order of sides in closed chains, of graphs given as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.operators.skew import shuffled
from ringfield.session import cut_lineage


def connected_components(nodes: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, label): `label` is the smallest id reachable through `pairs(keys, a, b)`.

    Large and small stars in turn. A link points from the larger id to the smaller. The large star hangs every node that is
    larger than its neighbour on the smallest neighbour of that one; the small star hangs all smaller neighbours of a node
    on the smallest of them. Links never grow in number, and about log(n) squared rounds leave one star for each component,
    whatever the graph. Only minima are aggregated, which combine before the shuffle; a node with many
    links makes a skewed join, whose output needs no partitioning, so AQE splits it. Links are checkpointed each round;
    it ends with the round that changes none (number and digest of the links are equal).
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    links = pairs.where(F.col("a") != F.col("b")).select(*keys, high.alias("u"), low.alias("v")).distinct()
    links = cut_lineage(links)
    known = None
    while True:
        digest = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*keys, "u", "v"))).first()
        if digest == known or digest[0] == 0:
            break
        known = digest
        least = links.groupBy(*keys, F.col("u").alias("v")).agg(F.min("v").alias("m"))
        hung = links.join(shuffled(least), [*keys, "v"], "left").select(*keys, "u", F.coalesce("m", "v").alias("v"))
        roots = hung.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        moved = hung.join(shuffled(roots), [*keys, "u"]).where(F.col("v") != F.col("m")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(moved.unionByName(roots.select(*keys, "u", F.col("m").alias("v"))).distinct())
    labels = shuffled(links.select(*keys, F.col("u").alias("id"), F.col("v").alias("label")))
    joined = nodes.select(*keys, "id").join(labels, [*keys, "id"], "left")
    return joined.withColumn("label", F.coalesce("label", "id"))


def cycle_order(chain: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, label, ahead): for closed chains given as `chain(keys, id, next)`, every id having one predecessor.

    `label` is the smallest id of the cycle and `ahead` the steps that lead to it (0 for itself), so a cycle reads from its
    label on by falling `ahead`. Pointer doubling: each id knows the smallest id of the next 1, 2, 4, ... steps and where it
    stands; a round joins each id with the one its pointer shows, on unique keys, and a cycle of n ids
    needs about log n rounds. When a round changes nothing, every id knows the smallest of its cycle.
    """
    start = chain.select(*keys, "id", F.col("next").alias("to"), F.col("id").alias("label"), F.lit(0).cast("long").alias("ahead"))
    state, step = cut_lineage(start), 1
    while True:
        theirs = state.select(
            *keys, F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("label").alias("seen"), F.col("ahead").alias("more")
        )
        joined = state.join(shuffled(theirs), [*keys, "to"])
        lower = F.col("seen") < F.col("label")
        state = cut_lineage(
            joined.select(
                *keys, "id", F.col("beyond").alias("to"), F.least("label", "seen").alias("label"),
                F.when(lower, F.col("more") + step).otherwise(F.col("ahead")).alias("ahead"), lower.alias("moved"),
            )
        )
        if state.where("moved").isEmpty():
            return state.select(*keys, "id", "label", "ahead")
        state, step = state.drop("moved"), step * 2
