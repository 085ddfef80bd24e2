"""Null handling, type tests, measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def zero(value) -> Column:
    return F.coalesce(_col(value), F.lit(0))


def net_sales(draw="draw_amount", adj="adj_amount", admin="adj_admin_amount", returns="ret_amount") -> Column:
    """Draw plus both adjustments less returns; missing parts count as zero."""
    return _col(draw) + zero(adj) + zero(admin) - zero(returns)


def case_map(value, mapping: dict, default=None) -> Column:
    value = _col(value)
    out = None
    for key, label in mapping.items():
        out = F.when(value == key, label) if out is None else out.when(value == key, label)
    return out.otherwise(default)


def null_safe_ne(left, right) -> Column:
    return ~_col(left).eqNullSafe(_col(right))


def is_numeric(text) -> Column:
    return _col(text).try_cast("decimal(38,10)").isNotNull()


def is_date(text, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(_col(text), F.lit(pattern)).isNotNull()


def int_div(left, right) -> Column:
    """Whole-number division, truncated towards zero."""
    return F.call_function("div", _col(left), _col(right))


def ratio_percent(part, whole) -> Column:
    """part / whole * 100 over whole-number decimals."""
    return _col(part).cast("decimal(18,0)") / _col(whole).cast("decimal(18,0)") * 100
