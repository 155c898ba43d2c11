"""Holds queries against their SQL in DuckDB on one folder of tables: python tests/compare.py [folder] [name ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(folder) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def normal(x):
    if isinstance(x, float):
        return None if math.isnan(x) else 0.0 if x == 0 else x
    if isinstance(x, (list, tuple)):
        return tuple(map(normal, x))
    return x


def differences(spark, con, folder, query, sql):
    """What differs between the two results; empty if nothing does."""
    df = query(spark, folder)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = sorted((tuple(normal(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall()), key=str)
    have = sorted((tuple(normal(r[c]) for c in sorted(names)) for r in df.collect()), key=str)
    if len(want) != len(have):
        return f"{len(have)} rows and {len(want)}"
    bad = [(h, w) for h, w in zip(have, want, strict=True) if h != w]
    return f"{len(bad)} of {len(want)} rows, such as {bad[:2]}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, queries, oracles = connect(folder), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or oracles:
        began = time.time()
        try:
            said = differences(spark, con, folder, queries[name], oracles[name]) if name in oracles else f"{queries[name](spark, folder).count()} rows, no SQL"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
