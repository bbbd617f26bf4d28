"""Side-by-side run of the Spark queries and their oracle SQL.

    python -m fixtures.compare sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from fixtures.domain import DRIVER_TABLES
from fixtures.oracle import ORACLE
from fixtures.queries import QUERIES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float).round(9).map(repr)
        else:
            df[c] = df[c].map(lambda v: "<null>" if v is None or v is pd.NaT or v != v else str(v))
    return df.sort_values(list(df.columns), ignore_index=True)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    t0 = time.time()
    ours = QUERIES[name](spark, sf_dir).toPandas()
    t1 = time.time()
    theirs = con.execute(ORACLE[name]).df()
    t2 = time.time()
    took = f"{len(ours)} rows, spark {t1 - t0:.1f}s, oracle {t2 - t1:.1f}s"
    if sorted(ours.columns) != sorted(theirs.columns):
        return False, f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    a, b = _canonical(ours), _canonical(theirs)
    if len(a) != len(b):
        extra = pd.concat([a.assign(side="spark"), b.assign(side="oracle")]).drop_duplicates(list(a.columns), keep=False)
        return False, f"{took}; oracle {len(b)} rows\n{extra.head(6).to_string()}"
    unequal = (a != b).any(axis=1)
    if unequal.any():
        return False, f"{took}; {unequal.sum()} rows differ\n{a[unequal].head(3).to_string()}\n{b[unequal].head(3).to_string()}"
    return True, took


def main() -> None:
    from platematch.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(**{"spark.ui.showConsoleProgress": "false"}), duck(sf_dir)
    failed = []
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the others
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed or "none")


if __name__ == "__main__":
    main()
