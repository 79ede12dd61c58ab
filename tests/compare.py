"""Compares registered queries with their SQL: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return a == b


def difference(got, sql: str, sf_dir: str) -> str | None:
    """None if a DataFrame has the rows of the SQL; else what differs."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    order = sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    expected = sorted((tuple(r[names.index(c)] for c in order) for r in found.fetchall()), key=key)
    rows = sorted((tuple(r) for r in got.select(*order).collect()), key=key)
    if len(rows) != len(expected):
        return f"{len(rows)} and {len(expected)} rows"
    wrong = [(a, b) for a, b in zip(rows, expected) if not all(map(same, a, b))]
    return f"{len(wrong)} rows differ in {order}, such as {wrong[0]}" if wrong else None


def main(sf_dir: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry

    from tidemark.session import session

    spark = session("compare", "local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g", spark_ui_enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    sql, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            problem = difference(df, sql[name], sf_dir) if name in sql else f"no SQL; {df.count()} rows"
        except Exception as e:  # reported, so that the rest is compared too
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem) and name in sql
        print(f"{name}: {problem or 'same'} ({time.time() - start:.1f} s)", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
