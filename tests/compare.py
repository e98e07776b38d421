"""Rows of two results in an order and form that can be compared."""

import math
from decimal import Decimal


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float | Decimal):
        return f"{float(v):.10g}"
    return str(v)


def rows(records: list[dict]) -> list[tuple]:
    return sorted(tuple(cell(r[k]) for k in sorted(r)) for r in records)
