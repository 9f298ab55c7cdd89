"""Legacy arithmetic: overflow, division by zero and impossible casts give null.

Spark's non-ANSI mode wraps integers and saturates casts instead, so these go through the try_ functions, which mean
the same in either mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def legacy_add(a, b) -> Column:
    return F.try_add(_col(a), _col(b))


def legacy_subtract(a, b) -> Column:
    return F.try_subtract(_col(a), _col(b))


def legacy_multiply(a, b) -> Column:
    return F.try_multiply(_col(a), _col(b))


def legacy_divide(a, b) -> Column:
    return F.try_divide(_col(a), _col(b))


def legacy_mod(a, b) -> Column:
    return F.try_mod(_col(a), _col(b))


def legacy_cast(c, to: str) -> Column:
    return _col(c).try_cast(to)


def legacy_sum(c) -> Column:
    return F.try_sum(_col(c))


def legacy_avg(c) -> Column:
    return F.try_avg(_col(c))
