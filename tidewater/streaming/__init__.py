"""An extension: a stream written to a table exactly once, through the table's writer transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..delta import DeltaTable


def write_stream(df: DataFrame, path: str, checkpoint: str, app_id: str, **trigger) -> StreamingQuery:
    """Appends each micro-batch as transaction (app_id, batch); a batch that is run again commits nothing."""

    def put(batch: DataFrame, number: int) -> None:
        DeltaTable(batch.sparkSession, path).append(batch, txn=(app_id, number))

    return df.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(put).start()
