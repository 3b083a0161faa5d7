"""Rows that folds in Python make, as typed frames."""

from __future__ import annotations

import pandas as pd


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def framed(rows: list, schema: str) -> pd.DataFrame:
    """Tuples or dicts as a frame of a schema; what is missing is null in every type."""
    out = {}
    for i, column in enumerate(schema.split(", ")):
        name, kind = column.split(" ", 1)
        values = [r.get(name) if isinstance(r, dict) else r[i] for r in rows]
        if kind == "bigint":
            out[name] = pd.Series([None if pd.isna(v) else int(v) for v in values], dtype="Int64")
        elif kind == "double":
            out[name] = pd.Series(values, dtype="float64")
        elif kind == "boolean":
            out[name] = pd.Series(values, dtype="boolean")
        else:
            out[name] = pd.Series([None if isinstance(v, float) else v for v in values], dtype=object)
    return pd.DataFrame(out)
