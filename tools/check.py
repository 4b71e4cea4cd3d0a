"""Run registered queries next to their SQL in DuckDB: python tools/check.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ringfield.registry import ORACLES, QUERIES  # noqa: E402
from ringfield.session import local_session  # noqa: E402

ROOT = "/root/testdata"


def rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    clean = [[None if isinstance(v, float) and math.isnan(v) else v for v in c] for c in columns]
    return names, sorted(zip(*clean), key=repr)


def kinds(table):
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


def compare(spark, con, name: str, sf_dir: str) -> str:
    start = time.time()
    found = QUERIES[name](spark, sf_dir).toArrow()
    took = time.time() - start
    if name not in ORACLES:
        return f"rows {found.num_rows:>8} {took:6.1f}s"
    start = time.time()
    wanted = con.execute(ORACLES[name]).to_arrow_table()
    sql_took = time.time() - start
    mine, theirs = rows(found), rows(wanted)
    note = ""
    if mine[0] != theirs[0]:
        return f"NAMES {mine[0]} != {theirs[0]}"
    a, b = kinds(found), kinds(wanted)
    differ = {n: (a[n], b[n]) for n in a if a[n] != b[n]}
    if differ:
        note = f" TYPES {differ}"
    if len(mine[1]) != len(theirs[1]):
        return f"COUNT {len(mine[1])} != {len(theirs[1])}{note}"
    bad = [(x, y) for x, y in zip(mine[1], theirs[1]) if x != y]
    if bad:
        return f"VALUES {len(bad)} of {len(mine[1])}, e.g. {bad[0]}{note}"
    return f"ok   {len(mine[1]):>8} {took:6.1f}s (sql {sql_took:.1f}s){note}"


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"{ROOT}/{sf}"
    names = [n for n in QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = local_session()
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    failures = 0
    for name in names:
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            text = str(error)
            result = f"ERROR {type(error).__name__}: {text[:600]}"
        failures += not result.startswith(("ok", "rows"))
        print(f"{name:32} {result}", flush=True)
    print(f"{len(names)} queries, {failures} failed")


if __name__ == "__main__":
    main()
