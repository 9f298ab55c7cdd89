"""read(): Parquet and Delta tables with checked options and time travel."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..delta import DeltaTable

# Fixed names: the options a reader knows.
OPTIONS = {
    "parquet": {"mergeSchema", "recursiveFileLookup", "pathGlobFilter", "modifiedBefore", "modifiedAfter", "datetimeRebaseMode", "int96RebaseMode"},
    "delta": {"versionAsOf", "timestampAsOf"},
}
_SUFFIX = re.compile(r"^(?P<path>.+)@(?:v(?P<version>\d+)|(?P<time>\d{14}|\d{17}))$")


def canonical(format: str, options: dict[str, str]) -> dict[str, str]:
    """Option names in their proper case; unknown ones are an error."""
    if format not in OPTIONS:
        raise ValueError(f"there is no source {format!r}")
    names = {n.lower(): n for n in OPTIONS[format]}
    if unknown := [k for k in options if k.lower() not in names]:
        raise ValueError(f"{format} has no options {unknown}")
    return {names[k.lower()]: str(v) for k, v in options.items()}


def _instant(text: str) -> datetime:
    out = datetime.fromisoformat(text.strip())
    return out if out.tzinfo else out.replace(tzinfo=timezone.utc)


def time_travel(path: str, options: dict[str, str]) -> tuple[str, int | None, datetime | None]:
    """(path, version, instant). An option makes the path literal; else a suffix @v<N> or @yyyyMMddHHmmss[SSS] counts."""
    version, when = options.get("versionAsOf"), options.get("timestampAsOf")
    if version is not None and when is not None:
        raise ValueError("either versionAsOf or timestampAsOf")
    if version is not None:
        if not re.fullmatch(r"\d+", version):
            raise ValueError(f"{version!r} is no version")
        return path, int(version), None
    if when is not None:
        return path, None, _instant(when)
    m = _SUFFIX.match(path)
    if not m:
        return path, None, None
    if m["version"]:
        return m["path"], int(m["version"]), None
    at = datetime.strptime(m["time"][:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    return m["path"], None, at + timedelta(milliseconds=int(m["time"][14:] or 0))


def read(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table. Delta: the version is fixed when this is called, and the table brings its own schema."""
    format = format.lower()
    options = canonical(format, options)
    if format == "delta":
        if schema is not None:
            raise ValueError("a delta table has a schema of its own")
        path, version, when = time_travel(path, options)
        return DeltaTable(spark, path).read(version, when)
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).parquet(path)
