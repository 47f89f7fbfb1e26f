"""Compare registered queries with their SQL twins: ``python tests/oracle.py [sf dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for r in pdf.itertuples(index=False):
        out = []
        for v in r:
            if v is None or v is pd.NA or (isinstance(v, float) and v != v):
                out.append("~")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                out.append(str(bool(v)))
            elif hasattr(v, "dtype") or isinstance(v, (int, float)):
                out.append(repr(float(v) + 0.0))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    got, want = fn(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    for c in got.columns:
        a, b = got[c].dtype, want[c].dtype
        whole = [d.kind in "iu" or (d.kind == "f" and s.isna().any() and (s.dropna() % 1 == 0).all()) for d, s in ((a, got[c]), (b, want[c]))]  # bigints with nulls arrive as doubles
        if len(got) and whole[0] != whole[1] and "O" not in (a.kind, b.kind):
            return f"type of {c}: {a} != {b}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def session():
    from tests.conftest import make_session

    return make_session()


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = session(), connect(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for n in names:
        start = time.time()
        try:
            if n in oracles:
                err = compare(spark, con, sf_dir, entry.queries()[n], oracles[n])
            else:
                pdf = entry.queries()[n](spark, sf_dir).toPandas()
                err = None if len(pdf) else "no rows"
        except Exception as e:  # noqa: BLE001
            err = f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql " if n in oracles else "rows"
        print(f"{'FAIL' if err else 'ok  '} {kind} {n:28s} {time.time() - start:6.2f}s {err or ''}", flush=True)
        if err:
            failed.append(n)
    print(f"{len(names) - len(failed)}/{len(names)} ok", failed)
