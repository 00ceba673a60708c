import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def same(spark, run, sql):
    """Whether a query and its SQL agree on the smallest tables: columns, and rows in any order."""
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = run(spark, SF)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = con.execute(f"SELECT {quoted} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, (tuple(r) for r in want)))
    return len(got)
