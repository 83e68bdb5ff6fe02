"""Side-by-side check of the named queries against their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    return str(v)


def rows_of(columns, rows, order):
    places = [columns.index(c) for c in order]
    return sorted(tuple(_cell(r[i]) for i in places) for r in rows)


def differences(spark_df, con, sql):
    """Text that names the first difference, or None when columns, types, row count and values agree."""
    relation = con.sql(sql)
    left, right = spark_df.columns, relation.columns
    if sorted(left) != sorted(right):
        return f"columns {sorted(left)} vs {sorted(right)}"
    order = sorted(left)
    kinds = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    sql_kinds = dict(zip(relation.columns, map(str, relation.types)))
    alike = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "date": {"DATE"}}
    odd = [f"{c}: {kinds[c]}/{sql_kinds[c]}" for c in order if sql_kinds[c] not in alike.get(kinds[c], set())]
    a = rows_of(left, [tuple(r) for r in spark_df.collect()], order)
    b = rows_of(right, relation.fetchall(), order)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            bad = sum(p != q for p, q in zip(a, b))
            return f"{bad} rows differ, first {dict(zip(order, x))} vs {dict(zip(order, y))}"
    return f"types {odd}" if odd else None


if __name__ == "__main__":
    from flowguard.session import build_session
    import __spark_entry__ as entry
    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, function in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            result = function(spark, folder)
            if sql is None:
                print(f"rows {name}: {result.count()} rows, {time.time() - start:.1f}s", flush=True)
                continue
            problem = differences(result, con, sql)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
