"""Streams over alert rows: tail, deduplication, trends, rates, session counters, limiter, dispatch (STR-07 to STR-11, SNK-13)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowguard.operators.analytics import session_counters
from flowguard.sources.stores import fan_out
from flowguard.streaming.flows import ROCKSDB


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """SRC-11: a folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def alert_tail(spark: SparkSession, path: str, schema: T.StructType, since: datetime | None = None, files_per_trigger: int = 50) -> DataFrame:
    """Alerts whose event time is after `since`, by default after the newest that is stored now. `arrivals` follows the
    order in which alerts are stored instead."""
    if since is None:
        since = spark.read.schema(schema).parquet(path).agg(F.max("timestamp")).first()[0]
    rows = read_stream(spark, path, schema, files_per_trigger)
    return rows if since is None else rows.where(F.col("timestamp") > F.lit(since))


def mark_end(spark: SparkSession, path: str, schema: T.StructType, cursor: str) -> None:
    """Write the present end of an alert table, the names of the files it shows now, to the folder `cursor`, once.

    A cursor that is already there stays, so that a query which starts again from its checkpoint goes on where it was.
    Names and not times tell what is new: a file may be written early and shown late.
    """
    files = spark.read.schema(schema).parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    try:
        files.write.mode("errorifexists").parquet(cursor)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise


def arrivals(spark: SparkSession, path: str, schema: T.StructType, cursor: str, files_per_trigger: int = 50) -> DataFrame:
    """STR-07: every alert stored after `mark_end` wrote `cursor`, whatever its event time: late alerts and alerts of the
    same instant as stored ones are shown too. What has been shown since is tracked by the query's checkpoint."""
    rows = read_stream(spark, path, schema, files_per_trigger).withColumn("_file", F.col("_metadata.file_path"))
    seen = spark.read.schema("file string").parquet(cursor).select(F.col("file").alias("_file"), F.lit(True).alias("_seen"))
    return rows.join(seen, "_file", "left").where("_seen IS NULL").select(*schema.names)


def distinct_feed(alerts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """STR-09: the first row of each id within the watermark."""
    return alerts.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])


def trend(alerts: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """STR-10: totals per tumbling window. Append mode writes a window once the watermark has passed it, update mode
    each early state as well; `run_to_table` merges those by window."""
    benign = F.col("attack_type") == "BENIGN"
    return alerts.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width)).agg(
        F.count("*").alias("total"), F.count_if(benign).alias("benign"), F.count_if(~benign).alias("attacks")).select(
        F.col("window.start").alias("start"), "total", "benign", "attacks")


def rates(alerts: DataFrame, width_seconds: int = 60, slide_seconds: int = 10, delay: str = "10 minutes") -> DataFrame:
    """STR-11: alerts per second and attack type over a sliding minute, in the modes of `trend`."""
    window = F.window("timestamp", f"{width_seconds} seconds", f"{slide_seconds} seconds")
    return alerts.withWatermark("timestamp", delay).groupBy(window, "attack_type").agg(F.count("*").alias("alerts")).select(
        F.col("window.end").alias("at"), "attack_type", "alerts", (F.col("alerts") / float(width_seconds)).alias("per_second"))


def session_metrics(events: DataFrame, since: datetime | None = None) -> DataFrame:
    """STR-08: running session counters; a reset is a later `since`. Written in complete mode."""
    rows = events if since is None else events.where(F.col("timestamp") >= F.lit(since))
    return session_counters(rows)


class _Limiter(StatefulProcessor):
    """Admits a request while fewer than `limit` were admitted in the last window. The state holds the admitted times of
    one window, at most `limit` of them, and is dropped one window after the last."""

    def __init__(self, limit: int, micros: int):
        self.limit, self.micros = limit, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getValueState("admitted", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])
        times = deque(self.admitted.get()[0] if self.admitted.exists() else ())
        verdicts = np.ones(len(batch), bool)
        for i, at in enumerate(batch["at"].tolist()):
            while times and at - times[0] >= self.micros:
                times.popleft()
            if len(times) < self.limit:
                times.append(at)
            else:
                verdicts[i] = False
        self.admitted.update((list(times),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((times[-1] + self.micros) // 1000 + 1)
        yield pd.DataFrame({"client": key[0], "seq": batch["seq"].to_numpy(), "at": batch["at"].to_numpy(), "admitted": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.admitted.clear()
        return iter(())

    def close(self) -> None:
        pass


def admitted_requests(events: DataFrame, limit: int = 500, seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """STR-08: the limiter that counts only admitted requests; `events` holds (client, seq, at in microseconds).

    Requests later than `delay` behind the newest are not counted. A client that is silent for a window is forgotten.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = events.select("client", "seq", "at", F.timestamp_micros("at").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("client").transformWithStateInPandas(
        statefulProcessor=_Limiter(limit, seconds * 1_000_000), outputStructType="client string, seq bigint, at bigint, admitted boolean",
        outputMode="Append", timeMode="EventTime")


def dispatch(alerts: DataFrame, targets: dict[str, Callable[[DataFrame], None]], log: str, checkpoint: str):
    """SNK-13 on a stream: every micro-batch goes to all targets, its status rows to the table `log`; the unstarted writer.

    A batch that runs again after a failure replaces its own status rows.
    """
    def handle(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            fan_out(batch, targets).write.mode("overwrite").parquet(f"{log.rstrip('/')}/batch={number}")
    return alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
