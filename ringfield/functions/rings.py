"""Column expressions on one ring: `ARRAY<STRUCT<i: DOUBLE, j: DOUBLE>>`.

All are narrow: no shuffle, no window, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(i: Column, j: Column) -> Column:
    return F.struct(i.alias("i"), j.alias("j"))


def following(ring: Column, k: Column) -> Column:
    """The vertex after position k, wrapping to the first."""
    return F.get(ring, (k + 1) % F.size(ring))


def distance(a: Column, b: Column) -> Column:
    di, dj = a["i"] - b["i"], a["j"] - b["j"]
    return F.sqrt(di * di + dj * dj)


def ring_edges(ring: Column) -> Column:
    """Array of (k, i1, j1, i2, j2), closing edge included."""

    def edge(p: Column, k: Column) -> Column:
        q = following(ring, k)
        return F.struct(
            k.alias("k"), p["i"].alias("i1"), p["j"].alias("j1"), q["i"].alias("i2"), q["j"].alias("j2")
        )

    return F.transform(ring, edge)


def doubled_area(ring: Column) -> Column:
    """Signed shoelace sum of i1*j2 - i2*j1; a positive ring is called clockwise here."""
    terms = F.transform(
        ring, lambda p, k: p["i"] * following(ring, k)["j"] - following(ring, k)["i"] * p["j"]
    )
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def area(ring: Column) -> Column:
    return F.abs(doubled_area(ring)) * F.lit(0.5)


def is_clockwise(ring: Column) -> Column:
    return doubled_area(ring) > 0


def orient(ring: Column, clockwise: bool = True) -> Column:
    agrees = is_clockwise(ring) if clockwise else ~is_clockwise(ring)
    return F.when(agrees, ring).otherwise(F.reverse(ring))


def box(ring: Column) -> Column:
    """Tight bounds as STRUCT<r0, c0, r1, c1>."""
    rows, cols = F.transform(ring, lambda p: p["i"]), F.transform(ring, lambda p: p["j"])
    return F.struct(
        F.array_min(rows).alias("r0"),
        F.array_min(cols).alias("c0"),
        F.array_max(rows).alias("r1"),
        F.array_max(cols).alias("c1"),
    )


def centre(ring: Column) -> Column:
    """Mean of the vertices (not the area centroid)."""
    total = F.aggregate(
        ring,
        F.struct(F.lit(0.0).alias("i"), F.lit(0.0).alias("j")),
        lambda t, p: F.struct((t["i"] + p["i"]).alias("i"), (t["j"] + p["j"]).alias("j")),
    )
    return point(total["i"] / F.size(ring), total["j"] / F.size(ring))


def diameter(ring: Column) -> Column:
    """Largest distance between two vertices."""
    return F.array_max(
        F.transform(ring, lambda p: F.array_max(F.transform(ring, lambda q: distance(p, q))))
    )


def shift(ring: Column, di: Column, dj: Column) -> Column:
    return F.transform(ring, lambda p: point(p["i"] + di, p["j"] + dj))


def scale(ring: Column, factor: Column) -> Column:
    return F.transform(ring, lambda p: point(p["i"] * factor, p["j"] * factor))


def swap(ring: Column) -> Column:
    return F.transform(ring, lambda p: point(p["j"], p["i"]))


def snap(ring: Column) -> Column:
    return F.transform(ring, lambda p: point(F.rint(p["i"]), F.rint(p["j"])))


def closes(ring: Column, eps: float = 1.0) -> Column:
    """True when the last vertex repeats the first (L1 distance below eps)."""
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    near = F.abs(first["i"] - last["i"]) + F.abs(first["j"] - last["j"]) < F.lit(eps)
    return (F.size(ring) > 1) & near


def strip_closing(ring: Column, eps: float = 1.0) -> Column:
    return F.when(closes(ring, eps), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def drop_doubles(ring: Column, eps: float = 0.1) -> Column:
    """Keep a vertex when its successor lies further away than eps."""
    return F.filter(ring, lambda p, k: distance(following(ring, k), p) > F.lit(eps))


def pad(ring: Column, length: Column) -> Column:
    """Repeat the last vertex up to `length`."""
    missing = F.greatest(length - F.size(ring), F.lit(0))
    return F.concat(ring, F.array_repeat(F.get(ring, F.size(ring) - 1), missing))


def cut_at_nan(ring: Column) -> Column:
    """Everything before the first NaN separator."""
    stops = F.transform(ring, lambda p: F.isnan(p["i"]) | F.isnan(p["j"]))
    stop = F.array_position(stops, True)
    return F.when(stop > 0, F.slice(ring, F.lit(1), (stop - 1).cast("int"))).otherwise(ring)


def cyclic_match(a: Column, b: Column, metric: str = "l2") -> Column:
    """Best rotation of `a` onto `b` as STRUCT<mean, shift, distances>.

    The shorter ring repeats its last vertex. `metric="sum"` is the absolute
    sum of the two coordinate differences, kept for comparison with older runs.
    """
    length = F.greatest(F.size(a), F.size(b))

    def gap(p: Column, q: Column) -> Column:
        if metric == "sum":
            return F.abs((p["i"] - q["i"]) + (p["j"] - q["j"]))
        return distance(p, q)

    def padded(ring: Column) -> Column:
        return pad(F.coalesce(ring, F.array()), length)

    def best(pair: Column) -> Column:
        n = pair["n"]

        def attempt(s: Column) -> Column:
            gaps = F.zip_with(F.slice(pair["a"], n - s + 1, n), pair["b"], gap)
            total = F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g)
            return F.struct((total / n).alias("mean"), s.alias("shift"), gaps.alias("distances"))

        return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), attempt))

    # Bound once and turned by slices of two rounds: places are not worked out again for each coordinate of each pair.
    twice = F.concat(padded(a), padded(a))
    pairs = F.array(F.struct(twice.alias("a"), padded(b).alias("b"), length.alias("n")))
    return F.get(F.transform(pairs, best), F.lit(0))


def strips(ring: Column) -> Column:
    """Sides of a ring as signed linear functions of the row: array of (lo, hi, at_lo, slope, sign).

    The ring is the signed sum of the strips between its sides and a base line;
    sides along the base line have no width and are left out.
    """
    turn = F.signum(doubled_area(ring))
    marked = F.transform(ring, lambda p, k: F.struct(p.alias("p"), following(ring, k).alias("q")))

    def strip(m: Column) -> Column:
        p, q = m["p"], m["q"]
        forward = p["i"] < q["i"]
        return F.struct(
            F.least(p["i"], q["i"]).alias("lo"),
            F.greatest(p["i"], q["i"]).alias("hi"),
            F.when(forward, p["j"]).otherwise(q["j"]).alias("at_lo"),
            ((q["j"] - p["j"]) / (q["i"] - p["i"])).alias("slope"),
            F.when(forward, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("way"),
        )

    found = F.transform(F.filter(marked, lambda m: m["p"]["i"] != m["q"]["i"]), strip)
    return F.struct(turn.alias("turn"), found.alias("sides"))


def strip_overlap(a: Column, b: Column, base: Column) -> Column:
    """Area shared by two simple rings given as `strips`: exact, for any orientation and without convexity.

    It is the signed sum, over pairs of sides, of the integral of the lower of
    two linear functions: closed form, no clipping. `base` lies below both.
    Pass stored or settled columns, the expression reads them once per side.
    """

    def shared(s: Column, t: Column) -> Column:
        lo, hi = F.greatest(s["lo"], t["lo"]), F.least(s["hi"], t["hi"])
        width = hi - lo
        s0 = s["at_lo"] - base + s["slope"] * (lo - s["lo"])
        s1 = s["at_lo"] - base + s["slope"] * (hi - s["lo"])
        t0 = t["at_lo"] - base + t["slope"] * (lo - t["lo"])
        t1 = t["at_lo"] - base + t["slope"] * (hi - t["lo"])
        d0, d1 = s0 - t0, s1 - t1
        spread = F.abs(d0) + F.abs(d1)
        gap = F.when(d0 * d1 >= 0, spread * 0.5).otherwise((d0 * d0 + d1 * d1) / (spread * 2.0))
        lower = (s0 + s1 + t0 + t1) * 0.25 - gap * 0.5
        return F.when(width > 0, s["way"] * t["way"] * width * lower).otherwise(F.lit(0.0))

    def against(total: Column, s: Column) -> Column:
        return F.aggregate(b["sides"], total, lambda acc, t: acc + shared(s, t))

    return a["turn"] * b["turn"] * F.aggregate(a["sides"], F.lit(0.0), against)
