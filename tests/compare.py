"""Multiset comparison of a Spark result with a DuckDB one."""

from collections import Counter


def plain(v):
    if isinstance(v, float):
        return None if v != v else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def same(df, con, sql) -> None:
    cols = sorted(df.columns)
    mine = Counter(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    other = Counter(repr([plain(r[i]) for i in at]) for r in cur.fetchall())
    assert mine == other, (list((mine - other))[:2], list((other - mine))[:2])
