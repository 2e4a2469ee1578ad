"""Comparison of a Spark result with a DuckDB result: same columns, same rows in any order."""

from __future__ import annotations

import math


def shown(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{shown(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def assert_same(df, cursor) -> None:
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted("|".join(shown(dict(zip(names, r))[c]) for c in order) for r in cursor.fetchall())
    got = sorted("|".join(shown(r[c]) for c in order) for r in df.collect())
    assert len(got) == len(want)
    assert got == want
