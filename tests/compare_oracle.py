"""Run registered queries beside their SQL and report differences: python tests/compare_oracle.py [sf_dir] [name …]"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    return f"{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_plain(r[k]) for k in order) for r in rows)


def difference(spark_df, relation) -> str:
    """Empty when both hold the same rows under the same column names."""
    names = relation.columns
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    ours, theirs = rows_of(spark_df.columns, spark_df.collect()), rows_of(names, relation.fetchall())
    extra, missing = ours - theirs, theirs - ours
    if not extra and not missing:
        return ""
    return f"{sum(ours.values())} vs {sum(theirs.values())} rows; only ours {list(extra)[:3]}; only theirs {list(missing)[:3]} ({sum(extra.values())}/{sum(missing.values())})"


def main() -> None:
    import __spark_entry__ as entry
    from roadweave.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                took = time.time()
                relation = con.sql(sql[name])
                told = difference(df, relation) or "ok"
            else:
                took, told = time.time(), f"rows {df.count()}"
        except Exception as e:  # report and go on with the next query
            took, told = time.time(), f"ERROR {type(e).__name__} {str(e)[:600]}"
        print(f"{name:24s} {took - start:7.2f} {time.time() - start:7.2f}  {told}", flush=True)


if __name__ == "__main__":
    main()
