"""What the tests share."""

import os


def same_rows(df, sql, sf_dir):
    """Whether Spark's rows are DuckDB's, numbers to nine figures."""
    import glob
    import math

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = sorted(c[0] for c in found.description)
    assert sorted(df.columns) == names

    def cell(x):
        if isinstance(x, float):
            return "null" if math.isnan(x) else f"{x:.9g}"
        return "null" if x is None else f"{float(x):.9g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)

    order = [c[0] for c in found.description]
    want = sorted(tuple(cell(r[order.index(c)]) for c in names) for r in found.fetchall())
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    assert got == want
