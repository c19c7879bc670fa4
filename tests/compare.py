"""Row sets of two engines as comparable lists."""

from __future__ import annotations

import math
from decimal import Decimal


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float | Decimal):
        return f"{float(value):.5f}"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return str(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(relation):
    return sorted(relation.columns), rows(relation.columns, relation.fetchall())
