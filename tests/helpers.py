"""Order-free comparison of two DataFrames."""

import math


def rows_of(df, digits=7):
    def plain(x):
        if isinstance(x, float):
            return "NaN" if math.isnan(x) else round(x, digits) + 0.0
        return x

    cols = sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df.select(cols).collect()), key=repr)


def same(a, b, digits=7):
    assert sorted(a.columns) == sorted(b.columns)
    left, right = rows_of(a, digits), rows_of(b, digits)
    assert len(left) == len(right)
    for x, y in zip(left, right):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-6)), (x, y)
