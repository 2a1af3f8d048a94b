"""A query's rows against its SQL's, in any order."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def compare(spark, folder, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = sorted(tuple(shown(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    have = [c[0] for c in cur.description]
    assert sorted(have) == names
    theirs = sorted(tuple(shown(r[have.index(n)]) for n in names) for r in cur.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
