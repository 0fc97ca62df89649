"""Run registered queries beside their SQL checks.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_cell(r[i]) for i in order) for r in rows])


# What the check returns for a Spark type.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(df, con, sql: str) -> str | None:
    """A description of the first difference, or None."""
    result = con.execute(sql)
    want_cols, want = _sorted_rows([d[0] for d in result.description], result.fetchall())
    kinds = {d[0]: str(d[1]) for d in result.description}
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != kinds.get(name):
            return f"{name} is {kind}, expected {kinds.get(name)}"
    got_cols, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(want)} rows differ, first:\n  {wrong[0][0]}\n  {wrong[0][1]}"
    return None if want else "no rows"


def main() -> None:
    import __spark_entry__ as entry
    from beaconry.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--explain", action="store_true")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    con, sqls = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if args.names and name not in args.names:
            continue
        begin = time.time()
        try:
            df = query(spark, sf_dir)
            if args.explain:
                df.explain("formatted")
            problem = compare(df, con, sqls[name]) if name in sqls else f"(no check) {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - begin:6.2f}s  {problem or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
