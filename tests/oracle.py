"""Compare queries with their SQL on DuckDB: python tests/oracle.py [SF_DIR] [NAME...]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(str(tuple(r[k] for k in order)) for r in rows)


def differences(spark, name, sf, con):
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf)
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(e.oracle_sql()[name])
    theirs = canonical([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} {theirs[0]}"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(ours[1])} and {len(theirs[1])} rows, {len(bad)} differ, such as {bad[:1]}" if bad or len(ours[1]) != len(theirs[1]) else ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    con = connect(sf)
    for name in sys.argv[2:] or e.queries():
        began = time.time()
        try:
            said = differences(spark, name, sf, con) if name in e.oracle_sql() else f"rows only: {len(e.queries()[name](spark, sf).toPandas())}"
        except Exception as x:
            said = f"FAILED {type(x).__name__} {str(x)[:900]}"
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
