import math

import duckdb

DATA = "/root/testdata"


def oracle(sf):
    import os

    con = duckdb.connect()
    for t in sorted(os.listdir(f"{DATA}/{sf}")):
        con.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{sf}/{t}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(rows, columns, result):
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert got == want
