"""Joins by any of the usual type names, unions of equal types, exchanges, and filters written as Python lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_JOINS = {
    "inner": "inner", "cross": "cross", "outer": "full", "full": "full", "fullouter": "full", "left": "left", "leftouter": "left",
    "right": "right", "rightouter": "right", "semi": "left_semi", "leftsemi": "left_semi", "anti": "left_anti", "leftanti": "left_anti",
}


def join_type(name: str) -> str:
    """Case, blanks and underscores do not count."""
    try:
        return _JOINS[name.replace("_", "").replace(" ", "").lower()]
    except KeyError:
        raise ValueError(f"there is no join type {name!r}; there are {', '.join(sorted(_JOINS))}") from None


def join(left: DataFrame, right: DataFrame, on: Column | str | list[str] | None = None, how: str = "inner") -> DataFrame:
    """A join by condition or by common columns; without either, a cross join."""
    kind = join_type(how)
    if on is None and kind in ("inner", "cross"):
        return left.crossJoin(right)
    return left.join(right, on, kind)


def strict_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION ALL by position of inputs whose types are equal; nothing is coerced."""
    a, b = [f.dataType for f in left.schema.fields], [f.dataType for f in right.schema.fields]
    if len(a) != len(b):
        raise ValueError(f"{len(a)} columns and {len(b)} columns")
    if odd := [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x.simpleString() != y.simpleString()]:
        raise ValueError(f"columns {odd} differ in type")
    return left.unionAll(right)


def exchange(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n partitions by hash of the keys, or round robin without keys."""
    return df.repartition(n, *keys) if keys else df.repartition(n)


class _Fields:
    """Attributes are columns."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


def typed(f: Callable[[_Fields], Column]) -> Column:
    """A column from a lambda over a row: typed(lambda r: (r.age > 3) & (r.name == "x"))."""
    out = f(_Fields())
    if not isinstance(out, Column):
        return F.lit(out)
    return out
