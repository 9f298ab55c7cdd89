"""Rows as dataclasses: a schema from a class, a table from its objects, and objects from a table."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import types
import typing
from collections.abc import Iterator
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

X = TypeVar("X")

_ATOMS = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), datetime.date: T.DateType(), datetime.datetime: T.TimestampType(), decimal.Decimal: T.DecimalType(38, 18)}


def _type(hint: Any) -> tuple[T.DataType, bool]:
    """(type, nullable) of an annotation."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) != 1 or len(rest) == len(args):
            raise TypeError(f"{hint} is no column type")
        return _type(rest[0])[0], True
    if origin is list:
        t, nullable = _type(args[0])
        return T.ArrayType(t, nullable), False
    if origin is dict:
        (k, _), (v, nullable) = _type(args[0]), _type(args[1])
        return T.MapType(k, v, nullable), False
    if dataclasses.is_dataclass(hint):
        return schema_of(hint), False
    if hint in _ATOMS:
        return _ATOMS[hint], False
    raise TypeError(f"{hint} is no column type")


def schema_of(cls: type) -> T.StructType:
    """Fields in order; X | None is a nullable X."""
    hints = typing.get_type_hints(cls)
    return T.StructType([T.StructField(f.name, *_type(hints[f.name])) for f in dataclasses.fields(cls)])


def from_objects(spark: SparkSession, cls: type[X], objects: list[X]) -> DataFrame:
    return spark.createDataFrame([dataclasses.asdict(o) for o in objects], schema_of(cls))


def _decode(hint: Any, v: Any) -> Any:
    if v is None:
        return None
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        return _decode(next(a for a in args if a is not type(None)), v)
    if origin is list:
        return [_decode(args[0], x) for x in v]
    if origin is dict:
        return {_decode(args[0], k): _decode(args[1], x) for k, x in v.items()}
    if dataclasses.is_dataclass(hint):
        return _object(hint, v)
    return bytes(v) if hint is bytes else v


def _object(cls: type[X], row: Any) -> X:
    by = {k.lower(): x for k, x in row.asDict().items()}
    hints = typing.get_type_hints(cls)
    out = {}
    for f in dataclasses.fields(cls):
        if f.name.lower() not in by:
            raise ValueError(f"the row has no field {f.name}")
        out[f.name] = _decode(hints[f.name], by[f.name.lower()])
        if out[f.name] is None and not _type(hints[f.name])[1]:
            raise ValueError(f"{f.name} is null")
    return cls(**out)


def objects(df: DataFrame, cls: type[X]) -> Iterator[X]:
    """The rows by field name, partition by partition."""
    names = [f.name for f in dataclasses.fields(cls)]
    return (_object(cls, r) for r in df.select(*names).toLocalIterator())
