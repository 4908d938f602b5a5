"""Rows of a query and of its SQL in one form."""

import math


def norm(v):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return None if math.isnan(float(v)) else round(float(v), 6)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v if isinstance(v, int) else str(v)


def rows(found) -> list:
    return sorted((tuple(norm(x) for x in r) for r in found), key=lambda r: tuple(map(str, r)))
