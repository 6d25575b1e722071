"""Run registered queries beside their SQL twins and compare every value.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import collections
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def difference(df, con, sql: str) -> str | None:
    """None when names, row multiset and values agree, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    expected = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    got = collections.Counter(repr(tuple(r)) for r in df.select(order).collect())
    want = collections.Counter(repr(tuple(r[i] for i in at)) for r in expected)
    if got == want:
        return None
    extra, missing = got - want, want - got
    return (
        f"rows {sum(got.values())} vs {sum(want.values())}; only spark {sum(extra.values())}, only sql {sum(missing.values())}"
        f"\n   spark {sorted(extra)[:2]}\n   sql   {sorted(missing)[:2]}"
    )


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from driftloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, bad = local_session(), connect(sf), 0
    sqls = oracle_sql()
    for name, fn in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                diff = difference(df, con, sqls[name])
                verdict = "ok" if diff is None else f"DIFF {diff}"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += verdict[:2] not in ("ok", "ro")
        print(f"{name}: {verdict[:1500]} [{time.time() - start:.1f}s]", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
