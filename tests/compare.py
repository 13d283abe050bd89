"""Runs queries against their SQL in DuckDB: same columns, same kinds, same rows in any order."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT"}


def differences(df, sql: str, con) -> list[str]:
    rel = con.sql(sql)
    theirs, kinds = rel.columns, dict(zip(rel.columns, map(str, rel.types), strict=True))
    out = []
    if sorted(df.columns) != sorted(theirs):
        return [f"columns {sorted(df.columns)} against {sorted(theirs)}"]
    out += [f"{c}: {t} against {kinds[c]}" for c, t in df.dtypes if KINDS.get(t, t) != kinds[c]]
    a, b = rows(df.columns, df.collect()), rows(theirs, rel.fetchall())
    if len(a) != len(b):
        out.append(f"{len(a)} rows against {len(b)}")
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        out.append(f"rows differ: only here {sorted(sa - sb)[:3]}, only there {sorted(sb - sa)[:3]}")
    return out


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from quarry.session import local_session

    spark = local_session(cores=os.environ.get("CORES", "4"))
    spark.sparkContext.setLogLevel("ERROR")
    import importlib

    sf_dir, names = sys.argv[1], sys.argv[2:]
    module = importlib.import_module(os.environ.get("CATALOG", "quarry.catalog"))
    con = duck(sf_dir)
    bad = 0

    def late(*_):
        raise TimeoutError("too slow")

    import signal

    signal.signal(signal.SIGALRM, late)
    for name in names or module.QUERIES:
        began = time.time()
        signal.alarm(int(os.environ.get("SECONDS_EACH", "60")))
        try:
            df = module.QUERIES[name](spark, sf_dir)
            if name in module.ORACLES:
                found = differences(df, module.ORACLES[name], con)
            else:
                found = [] if df.count() >= 0 else ["nothing"]
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        bad += bool(found)
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - began:.1f}s" + "".join(f"\n      {f[:900]}" for f in found), flush=True)
    print(bad, "bad")
