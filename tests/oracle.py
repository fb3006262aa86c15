"""Compare the queries with their SQL on the given tables. Also usable by hand: python tests/oracle.py sf [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [_cell(x) for x in v]
    if isinstance(v, dict):
        return {k: _cell(x) for k, x in v.items()}
    return v


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(repr(_cell(r[i])) for i in order) for r in rows])


def compare(df, con, sql) -> str:
    """Empty when equal, else what differs."""
    got_cols, got = _table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_cols, want = _table([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    return "" if not diff else f"{len(diff)} of {len(got)} rows differ, first:\n   spark {diff[0][0]}\n   duck  {diff[0][1]}"


def main() -> int:
    import __spark_entry__ as e
    from sessionmeter.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            note = compare(df, con, oracles[name]) if name in oracles else f"no SQL, {df.count()} rows"
        except Exception as err:  # noqa: BLE001
            note = f"{type(err).__name__}: {str(err)[:1500]}"
        bad += bool(note) and not note.startswith("no SQL")
        print(f"{name:32s} {time.time() - t:6.2f}s {note or 'ok'}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
