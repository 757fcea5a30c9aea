"""Row-by-row comparison of a DataFrame with a DuckDB result, without order."""

import os

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables(con, folder):
    for name in NAMES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def _key(row):
    return tuple((x is None, isinstance(x, (int, float)), x if isinstance(x, (int, float)) else str(x)) for x in row)


def same(df, result):
    columns = sorted(df.columns)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=_key)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(columns).collect()), key=_key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
