"""Compares a Spark result with DuckDB's on the same tables."""

import math


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or getattr(getattr(v, "dtype", None), "kind", "") == "f":
        return f"{float(v):.9g}"
    return str(v)


def rows(frame):
    import pandas as pd

    names = sorted(frame.columns)
    return sorted(tuple("NULL" if v is pd.NaT else cell(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


def numbers_alike(frame):
    """Whole floats (integers with nulls) read as integers on both sides."""
    import pandas as pd

    out = frame.copy()
    for c in out.columns:
        if out[c].dtype.kind == "f" and (out[c].dropna() % 1 == 0).all():
            out[c] = out[c].map(lambda v: None if v != v else int(v)).astype(object)
        elif out[c].dtype.kind in "iu":
            out[c] = pd.Series([None if pd.isna(v) else int(v) for v in out[c]], index=out.index, dtype=object)
    return out
