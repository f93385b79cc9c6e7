"""Run registered queries against their SQL checks: ``python tests/check.py [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def oracle_rows(sql: str, folder: str) -> tuple[dict[str, str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    kinds = dict(zip(names, [str(d[1]) for d in done.description]))
    return kinds, done.fetchall()


def text_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(text_of, value)) + "]"
    return str(value)


def canonical(names: list[str], rows: list) -> list[tuple[str, ...]]:
    order = [names.index(n) for n in sorted(names)]
    return sorted(tuple(text_of(row[i]) for i in order) for row in rows)


def difference(df, sql: str, folder: str) -> tuple[str | None, int]:
    """What differs between a query and its SQL check, or None."""
    rows = [tuple(r) for r in df.collect()]
    kinds, expected = oracle_rows(sql, folder)
    if sorted(df.columns) != sorted(kinds):
        return f"columns {sorted(df.columns)} != {sorted(kinds)}", len(rows)
    a, b = canonical(df.columns, rows), canonical(list(kinds), expected)
    if a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = [r for r in a if r not in sb], [r for r in b if r not in sa]
        return f"rows {len(a)}/{len(b)}, differing {len(only_a)}/{len(only_b)} {sorted(kinds)}\n S {only_a[:3]}\n D {only_b[:3]}", len(rows)
    odd = {n: (t, kinds[n]) for n, t in df.dtypes if KINDS.get(t, t) != kinds[n]}
    return (f"types {odd}" if odd else None), len(rows)


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from lectern.session import local_session

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    if os.environ.get("CHECK_PLAIN"):
        # A session with nothing set but its size, as another caller may bring it.
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").getOrCreate()
    else:
        spark = local_session("check")
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [q for q in queries if not names or any(n in q for n in names)]
    bad = 0
    for name in chosen:
        start = time.time()
        n = 0
        try:
            if name in oracles:
                diff, n = difference(queries[name](spark, folder), oracles[name], folder)
                verdict = "ok" if diff is None else f"DIFF {diff[:1500]}"
            else:
                n = len(queries[name](spark, folder).collect())
                verdict = "rows only"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAIL {str(error)[:1800]}"
        took = time.time() - start
        bad += verdict.startswith(("DIFF", "FAIL"))
        print(f"{name}: {n} rows {took:.1f}s {verdict}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad, {sum(q in oracles for q in chosen)} with sql")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
