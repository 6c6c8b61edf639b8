"""Runs queries against their SQL and says what differs."""

import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    import datetime
    import decimal

    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def differences(spark, queries, oracle, sf_dir, names=None):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = {}
    for name in names or oracle:
        began = time.time()
        df = queries[name](spark, sf_dir)
        cols = sorted(df.columns)
        got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
        took = time.time() - began
        rel = con.execute(oracle[name])
        have = [d[0] for d in rel.description]
        want = sorted(tuple(canon(v) for _, v in sorted(zip(have, r, strict=True))) for r in rel.fetchall())
        if cols != sorted(have):
            out[name] = f"columns {cols} against {sorted(have)}"
        elif got != want:
            first = next(((a, b) for a, b in zip(got, want, strict=False) if a != b), None)
            out[name] = f"{len(got)} against {len(want)} rows, {sum(a != b for a, b in zip(got, want, strict=False))} differ: {first}"
        print(f"{name}: {len(got)} rows, {took:.1f} s {'DIFFERS ' + out[name][:600] if name in out else ''}", flush=True)
    return out


if __name__ == "__main__":
    import os
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    names = [n for n in o if not sys.argv[2:] or any(x in n for x in sys.argv[2:])]
    print("bad:", sorted(differences(s, q, o, sys.argv[1], names)))
