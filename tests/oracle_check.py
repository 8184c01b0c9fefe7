"""Compare registered queries with their SQL twins: python tests/oracle_check.py [sf dir] [names...]"""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def norm(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return round(float(v), 9)
        return str(v)

    rows = [tuple(one(v) for v in r) for r in pdf.astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
}


def type_gaps(df, described):
    """Columns whose types do not correspond."""
    other = {row[0]: row[1] for row in described}
    return [f"{c}: {t} vs {other.get(c)}" for c, t in df.dtypes if KINDS.get(t) != other.get(c)]


def compare(spark, con, name, query, sql, folder):
    started = time.time()
    df = query(spark, folder)
    got = df.toPandas()
    took = time.time() - started
    want = con.execute(sql).df() if sql else None
    types = type_gaps(df, con.execute(f"DESCRIBE {sql}").fetchall()) if sql else []
    if want is None:
        return f"no twin: {len(got)} rows", took, False
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}", took, False
    a, b = norm(got), norm(want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", took, False
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, e.g.\n   spark {diff[0][0]}\n   sql   {diff[0][1]}", took, False
    return f"ok {len(a)} rows {types or ''}", took, True


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(folder), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        try:
            text, took, ok = compare(spark, con, name, query, sqls.get(name), folder)
        except Exception as err:
            text, took, ok = f"{type(err).__name__}: {str(err)[:700]}", 0.0, False
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name:24s} {took:6.2f}s  {text}", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
