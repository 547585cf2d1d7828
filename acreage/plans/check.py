"""Local correctness check: run registered queries in Spark and their oracle
SQL in DuckDB on the same parquet tables, compare row count, column names and
an order-insensitive hash of the values.

    python -m acreage.plans.check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

from acreage.plans.bindings import TABLES
from acreage.plans.catalog import oracle_sql, queries


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"))
    return len(rows), cols, hashlib.md5("\n".join(rows).encode()).hexdigest()


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_diffs(spark_df, con, sql: str) -> list:
    """Columns whose Spark type and DuckDB type differ."""
    st = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    dd = {d[0]: d[1] for d in con.execute(f"DESCRIBE ({sql})").fetchall()}
    return [(c, st[c], dd.get(c)) for c in st if SPARK_TO_DUCK.get(st[c], st[c]) != dd.get(c)]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    from acreage.session import build_session
    spark = build_session()
    con = duck(a.sf)
    qs, orc = queries(), oracle_sql()
    names = a.names or sorted(qs)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = qs[n](spark, a.sf)
            sp = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {n}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if n not in orc:
            print(f"rows-only {n}: {len(sp)} rows {dt:.1f}s")
            continue
        try:
            du = con.execute(orc[n]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {n}: {str(e)[:400]}")
            bad += 1
            continue
        a1, a2 = digest(sp), digest(du)
        td = type_diffs(sdf, con, orc[n])
        ok = a1 == a2 and not td
        if td:
            print(f"   type differences: {td}")
        bad += not ok
        print(f"{'ok ' if ok else 'MISMATCH'} {n}: spark {a1[0]} rows {dt:.1f}s, duck {a2[0]} rows"
              + ("" if ok else f"\n   spark cols {a1[1]}\n   duck  cols {a2[1]}"))
        if not ok and a1[0] == a2[0] and a1[1] == a2[1]:
            cols = a1[1]
            s1 = sp[cols].sort_values(cols).reset_index(drop=True)
            s2 = du[cols].sort_values(cols).reset_index(drop=True)
            for i in range(min(len(s1), 400)):
                r1 = [_norm(x) for x in s1.iloc[i].tolist()]
                r2 = [_norm(x) for x in s2.iloc[i].tolist()]
                if r1 != r2:
                    print("   first diff spark:", r1[:12], "\n              duck :", r2[:12])
                    break
    print(f"{len(names) - bad}/{len(names)} passed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
