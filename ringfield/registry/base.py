"""Registration, and the SQL text of the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "buildings": """
        SELECT CAST(o_custkey % 16 AS BIGINT) AS image_id, o_orderkey AS poly_id,
          CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS is_l,
          CAST((o_orderkey * 37) % 4900 AS DOUBLE) AS r0,
          CAST((o_orderkey * 101 + o_custkey * 13) % 4900 AS DOUBLE) AS c0,
          CAST(8 + o_custkey % 23 AS DOUBLE) AS h, CAST(8 + o_orderkey % 29 AS DOUBLE) AS w, o_custkey AS ck
        FROM orders""",
    "images": """
        SELECT DISTINCT image_id, 5000 AS height, 5000 AS width,
          CAST(CASE WHEN image_id % 2 = 0 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS pixelsize,
          CAST(500000 + image_id * 4096 AS DOUBLE) AS x0, CAST(4000000 - image_id * 2048 AS DOUBLE) AS y0
        FROM buildings""",
    "vertices": """
        SELECT b.image_id, b.poly_id, b.is_l,
          CAST(CASE WHEN b.poly_id % 2 = 1 THEN (CASE WHEN b.is_l = 1 THEN 5 ELSE 3 END) - t.k ELSE t.k END AS INT) AS k,
          b.r0 + t.fi * CAST(0.5 AS DOUBLE) * b.h AS i, b.c0 + t.fj * CAST(0.5 AS DOUBLE) * b.w AS j, b.ck
        FROM buildings b JOIN (VALUES
          (0,0,0,0),(0,1,0,2),(0,2,2,2),(0,3,2,0),
          (1,0,0,0),(1,1,0,2),(1,2,1,2),(1,3,1,1),(1,4,2,1),(1,5,2,0)) AS t(is_l, k, fi, fj) ON b.is_l = t.is_l""",
    "pred": """
        SELECT image_id, poly_id, k, is_l, ck,
          i + (((ck * 7 + k * 3) % 33) - 16) * CAST(0.25 AS DOUBLE) AS i,
          j + (((poly_id * 5 + k * 11) % 33) - 16) * CAST(0.25 AS DOUBLE) AS j
        FROM vertices""",
    "view_vertices": """
        SELECT v.view_id, p.image_id, p.poly_id, p.k, p.ck,
          p.i + v.m * 3 * (p.ck % 8) * CAST(0.25 AS DOUBLE) AS i, p.j + v.m * 4 * (p.ck % 8) * CAST(0.25 AS DOUBLE) AS j
        FROM vertices p CROSS JOIN (VALUES ('ref', 0), ('mid', 1), ('rec', 2)) AS v(view_id, m)""",
    "ring_edges": """
        SELECT image_id, poly_id, k, i AS i1, j AS j1, ck,
          CASE WHEN k = n - 1 THEN first_value(i) OVER w ELSE lead(i) OVER w END AS i2,
          CASE WHEN k = n - 1 THEN first_value(j) OVER w ELSE lead(j) OVER w END AS j2
        FROM (SELECT *, count(*) OVER (PARTITION BY image_id, poly_id) AS n FROM vertices)
        WINDOW w AS (PARTITION BY image_id, poly_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "boxes": """
        SELECT image_id, poly_id, min(i) AS r0, min(j) AS c0, max(i) AS r1, max(j) AS c1, count(*) AS n
        FROM vertices GROUP BY image_id, poly_id""",
    "rects": """
        SELECT image_id, poly_id, r0, c0, r0 + h * (CASE WHEN is_l = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS r1, c0 + w AS c1 FROM buildings
        UNION ALL
        SELECT image_id, poly_id, r0 + h * 0.5::DOUBLE, c0, r0 + h, c0 + w * 0.5::DOUBLE FROM buildings WHERE is_l = 1""",
    "areas": """
        SELECT image_id, poly_id, sum((r1 - r0) * (c1 - c0)) AS area FROM rects GROUP BY image_id, poly_id""",
    "distances": """
        SELECT v.image_id, v.poly_id, v.k, v.ck, sqrt((v.i - p.i) * (v.i - p.i) + (v.j - p.j) * (v.j - p.j)) AS d
        FROM vertices v JOIN pred p USING (image_id, poly_id, k)""",
    "cells": """
        SELECT vec_id AS image_id, CAST((p - 1) // 8 AS INT) AS i, CAST((p - 1) % 8 AS INT) AS j,
          CAST(embedding[p] AS DOUBLE) AS value, label AS band
        FROM (SELECT *, unnest(range(1, 65)) AS p FROM embeddings)""",
    "thresholds": "SELECT CAST(n AS DOUBLE) * 0.25::DOUBLE AS threshold FROM range(0, 65) AS t(n)",
    "runs": """
        SELECT concat(event_type, '_', CAST(user_id % 10 AS VARCHAR)) AS run_name, ts, event_id FROM events""",
}
NEEDS = {
    "images": ["buildings"], "vertices": ["buildings"], "pred": ["vertices"], "view_vertices": ["vertices"],
    "ring_edges": ["vertices"], "boxes": ["vertices"], "rects": ["buildings"], "areas": ["rects"],
    "distances": ["pred"],
}


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in NEEDS.get(name, []):
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_views(body: str, *names: str, recursive: bool = False, once: bool = False, **extra: str) -> str:
    """`body` behind the WITH clauses of the derived views it uses; `once` has each of them evaluated once."""
    how = "AS MATERIALIZED" if once else "AS"
    clauses = [f"{n} {how} ({VIEWS[n].strip()})" for n in _closure(list(names))]
    clauses += [f"{n} {how} ({text.strip()})" for n, text in extra.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(clauses) + "\n" + body.strip()


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


# Portable counterpart of functions.numeric.uniform; `{ids}` is a list of text expressions.
def uniform_sql(seed: int, *ids: str) -> str:
    text = ", ':', ".join([*[f"CAST({i} AS VARCHAR)" for i in ids], f"'{seed}'"])
    return f"(CAST(CAST(concat('0x', substr(md5(concat({text})), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0)"
