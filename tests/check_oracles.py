"""Run registered queries against their oracle SQL and report differences.

Usage: python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows_of(frame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)].astype(object)
    ordered = ordered.where(ordered.notnull(), None)
    return sorted(map(tuple, ordered.values.tolist()), key=repr)


def compare(spark_df, con, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return ""
    only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"values spark={only_a} oracle={only_b}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from codequarry.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(queries())
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for name in wanted:
        began = time.time()
        try:
            frame = queries()[name](spark, sf_dir)
            types = {f.name: f.dataType.simpleString() for f in frame.schema}
            if name not in oracle_sql():
                print(f"ran  {name:28s} {frame.count()} rows, no oracle", flush=True)
                continue
            problem = compare(frame, con, oracle_sql()[name])
            other = dict(zip([d[0] for d in con.execute(oracle_sql()[name]).description],
                             [str(d[1]).lower() for d in con.description]))
        except Exception as error:  # report and go on with the next query
            problem, types, other = f"{type(error).__name__}: {str(error)[:600]}", {}, {}
        spark.catalog.clearCache()
        alias = {"string": "varchar", "int": "integer"}
        odd = {c: (t, other.get(c)) for c, t in types.items() if alias.get(t, t) != other.get(c)}
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - began:6.1f}s {problem} {odd or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
