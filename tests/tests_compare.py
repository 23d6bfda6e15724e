"""A Spark result against DuckDB's over the same tables."""

import glob
import math
import os


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return str(x)


def compare(df, sql, folder, duckdb):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    wanted = sorted((tuple(cell(dict(zip(names, r))[c]) for c in sorted(names)) for r in result.fetchall()), key=repr)
    got = sorted((tuple(cell(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted):
        assert g == w
