"""Column-expression helpers (all JVM-side, inside whole-stage codegen)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "lookup", "clip", "floor_days", "lit_date", "week_label",
    "month_label", "stable_id", "half_even", "bool_ratio", "safe_ratio",
]


def lit_date(d: dt.date | str) -> Column:
    return F.lit(str(d)).cast("date")


def lookup(col: Column | str, mapping: dict, default=None) -> Column:
    """Small literal map lookup as a CASE chain; unknown keys give ``default``."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if default is not None:
        expr = expr.otherwise(F.lit(default))
    return expr


def clip(c: Column, lo=None, hi=None) -> Column:
    """pandas ``clip``: bounds applied, null stays null (``greatest`` would turn null into the bound)."""
    out = c
    if lo is not None:
        out = F.when(out < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(hi), F.lit(hi)).otherwise(out)
    return out


def floor_days(later: Column, earlier: Column) -> Column:
    """Floor of a timestamp difference in days (``Timedelta.days`` semantics)."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def week_label(d: Column) -> Column:
    """Monday-to-Sunday week label ``YYYY-MM-DD/YYYY-MM-DD``."""
    start = F.to_date(F.date_trunc("week", d))
    return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"),
                    F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def stable_id(*parts: Column | str) -> Column:
    """Deterministic row id (same on retries and recomputation, unlike ``uuid()``)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def bool_ratio(cond: Column) -> Column:
    """Share of rows where ``cond`` holds (false for null), as an aggregate."""
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def safe_ratio(num: Column, den: Column, default=0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def half_even(c: Column, n: int = 0) -> Column:
    """NumPy/pandas ``round(n)``: scale, round half to even (``rint``), unscale."""
    c = F.col(c) if isinstance(c, str) else c
    if n == 0:
        return F.rint(c)
    k = float(10 ** n)
    return F.rint(c * F.lit(k)) / F.lit(k)
