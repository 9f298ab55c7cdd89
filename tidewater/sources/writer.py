"""write(): Parquet, Delta and in-memory tables under the four save modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..delta import DeltaTable

MODES = {"append": "append", "overwrite": "overwrite", "error": "error", "errorifexists": "error", "ignore": "ignore"}
FORMATS = {"parquet", "delta", "memory"}
DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


class MemoryTables:
    """Named tables of a session, held as temporary views over cached frames."""

    def __init__(self):
        self.frames: dict[str, DataFrame] = {}

    def write(self, df: DataFrame, name: str, mode: str) -> None:
        old = self.frames.get(name)
        if old is not None:
            if mode == "error":
                raise ValueError(f"table {name} exists")
            if mode == "ignore":
                return
        # StorageLevel of persist(): memory, then the executors' disks; lineage stays, so a lost executor is no loss
        new = (old.unionAll(df) if old is not None and mode == "append" else df).persist()
        new.count()
        new.createOrReplaceTempView(name)
        self.frames[name] = new

    def read(self, name: str) -> DataFrame:
        return self.frames[name]

    def drop(self, name: str) -> None:
        if (df := self.frames.pop(name, None)) is not None:
            df.sparkSession.catalog.dropTempView(name)
            df.unpersist()


MEMORY = MemoryTables()


def _flag(options: dict[str, str], name: str) -> bool:
    return str(options.get(name.lower(), "false")).lower() == "true"


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] = (), **options) -> None:
    """Writes df. A table that makes the mode a no-op or an error does so before df is computed."""
    spark = df.sparkSession
    try:
        mode = MODES[mode.replace("_", "").lower()]
    except KeyError:
        raise ValueError(f"there is no save mode {mode!r}") from None
    if format not in FORMATS:
        raise ValueError(f"there is no sink {format!r}")
    if format == "memory":
        return MEMORY.write(df, path, mode)
    if format == "parquet":
        return df.write.mode(mode).options(**options).partitionBy(*partition_by).parquet(path)
    options = {k.lower(): v for k, v in options.items()}
    if unknown := set(options) - {"mergeschema", "overwriteschema", "partitionoverwritemode"}:
        raise ValueError(f"delta has no options {sorted(unknown)}")
    merge, replace = _flag(options, "mergeSchema"), _flag(options, "overwriteSchema")
    dynamic = str(options.get("partitionoverwritemode", spark.conf.get(DYNAMIC, "static"))).lower() == "dynamic"
    if merge and mode != "append":
        raise ValueError("mergeSchema goes with append only")
    if replace and mode != "overwrite":
        raise ValueError("overwriteSchema goes with overwrite only")
    exists = DeltaTable.is_table(spark, path)
    if exists and mode == "error":
        raise ValueError(f"{path} is a table")
    if exists and mode == "ignore":
        return None
    if not exists:
        nullable = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema.fields])
        DeltaTable.create(spark, path, nullable, list(partition_by), rows=df)
        return None
    table = DeltaTable(spark, path)
    if partition_by and list(partition_by) != table.snapshot().partition_columns and not replace:
        raise ValueError(f"the table is partitioned by {table.snapshot().partition_columns}")
    if mode == "append":
        table.append(df, merge_schema=merge)
    else:
        table.overwrite(df, overwrite_schema=replace, dynamic=dynamic and not replace)
    return None
