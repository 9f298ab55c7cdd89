"""Sessions: UTC, ANSI arithmetic unless told otherwise, and guards on what an action may return or take."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

TIMEOUT_MS, MAX_ROWS, MAX_BYTES = "tidewater.execution.timeoutMs", "tidewater.execution.maxResultRows", "tidewater.execution.maxResultBytes"
DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.caseSensitive": "false"}


class ResultTooLarge(Exception):
    pass


class QueryTimeout(Exception):
    pass


def session(app_name: str = "tidewater", master: str | None = None, config: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    config = dict(config or {})
    if MAX_BYTES in config:  # Spark itself stops a job whose results exceed this
        config.setdefault("spark.driver.maxResultSize", config[MAX_BYTES])
    return builder.config(map=DEFAULTS | config).getOrCreate()


@contextmanager
def ansi(spark: SparkSession, on: bool):
    """ANSI or legacy arithmetic for the block."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", str(on).lower())
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@dataclass
class Metrics:
    """What an action took, from Spark's own books: seconds to plan and to run, rows, stages, tasks, bytes read from files and spilled to disk."""

    planning_s: float = 0.0
    execution_s: float = 0.0
    rows: int = 0
    stages: int = 0
    tasks: int = 0
    bytes_read: int = 0
    bytes_spilled: int = 0


def collect(df: DataFrame, timeout_ms: int | None = None, max_rows: int | None = None, metrics: Metrics | None = None) -> list[Row]:
    """collect() within the session's limits: at most so many rows, by one row more being asked for; cancelled in time."""
    spark = df.sparkSession
    timeout_ms = timeout_ms or int(spark.conf.get(TIMEOUT_MS, "0")) or None
    max_rows = max_rows if max_rows is not None else int(spark.conf.get(MAX_ROWS, "0")) or None
    group, sc = f"tidewater-{uuid.uuid4().hex}", spark.sparkContext
    found: dict = {}

    def work() -> None:
        sc.setJobGroup(group, "tidewater.collect", interruptOnCancel=True)
        try:
            began = time.time()
            df._jdf.queryExecution().executedPlan()
            found["planned"] = time.time() - began
            began = time.time()
            found["rows"] = (df if max_rows is None else df.limit(max_rows + 1)).collect()
            found["took"] = time.time() - began
        except Exception as e:
            found["error"] = e

    if timeout_ms is None:
        work()
    else:
        from pyspark import InheritableThread

        thread = InheritableThread(target=work)
        thread.start()
        thread.join(timeout_ms / 1000)
        if thread.is_alive():
            sc.cancelJobGroup(group)
            thread.join(30)
            raise QueryTimeout(f"took more than {timeout_ms} ms")
    if "error" in found:
        raise found["error"]
    if max_rows is not None and len(found["rows"]) > max_rows:
        raise ResultTooLarge(f"more than {max_rows} rows")
    if metrics is not None:
        tracker = sc.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
        metrics.planning_s, metrics.execution_s, metrics.rows = found["planned"], found["took"], len(found["rows"])
        metrics.stages, metrics.tasks = len(stages), sum(s.numTasks for s in stages if s)
        sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        kept = [sc._jsc.sc().statusStore().lastStageAttempt(s.stageId) for s in stages if s]
        metrics.bytes_read, metrics.bytes_spilled = sum(k.inputBytes() for k in kept), sum(k.diskBytesSpilled() for k in kept)
    return found["rows"]


def explained(df: DataFrame, mode: str = "simple") -> str:
    """The plan as text: simple, extended, codegen, cost or formatted."""
    spark = df.sparkSession
    explain_mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(explain_mode)


def shown(df: DataFrame, n: int = 20, truncate: bool | int = True) -> str:
    """What show() prints."""
    return df._show_string(n, truncate, False)


