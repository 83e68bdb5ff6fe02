"""Tables that grow: alerts, audit events, indicators, mitigation history (SRC-08 to SRC-12, SNK-02 to SNK-05, SNK-11, SNK-13)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from flowguard.functions.constants import DEFAULT_BLACKLIST, DEFAULT_MALICIOUS, DEFAULT_WHITELIST
from flowguard.operators.alerts import newest
from flowguard.session import cut_lineage
from flowguard.sources.documents import entries

INDICATOR_SCHEMA = "ip string, list_type string, category string, threat_score int, first_seen string, seq bigint"
INDICATOR_FILE = T.StructType([
    T.StructField("whitelist", T.ArrayType(T.StringType())),
    T.StructField("blacklist", T.ArrayType(T.StringType())),
    T.StructField("known_malicious_ips", T.MapType(T.StringType(), T.StructType([
        T.StructField("category", T.StringType()), T.StructField("threat_score", T.IntegerType()), T.StructField("first_seen", T.StringType())]))),
])
HISTORY_FILE = T.StructType([T.StructField("history", T.ArrayType(T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("playbook", T.StringType()), T.StructField("attack_type", T.StringType()),
    T.StructField("target_ip", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("actions_taken", T.ArrayType(T.StructType([
        T.StructField("action", T.StringType()), T.StructField("target_port", T.IntegerType()), T.StructField("limit", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("details", T.StructType([
            T.StructField("ip", T.StringType()), T.StructField("rule_name", T.StringType()), T.StructField("reason", T.StringType()),
            T.StructField("blocked_at", T.StringType()), T.StructField("duration_sec", T.IntegerType()), T.StructField("status", T.StringType())]))]))),
])))])


def _read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: the alert table, partitioned by day."""
    return spark.read.parquet(path)


def append_alerts(batch: DataFrame, path: str, same_day_ids: bool = True) -> DataFrame:
    """SNK-02: append alerts whose id is new; of equal ids the first wins. Returns the rows written, which are settled.

    Only the id column of the stored table is read, and only for the days that occur in the batch, as ids of
    `build_alerts` carry their time. With ids that may return on another day, `same_day_ids=False` reads all stored ids.
    """
    columns = batch.columns
    first = batch.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("timestamp", *[c for c in columns if c not in ("id", "timestamp")])).alias("a")).select("a.*")
    fresh = cut_lineage(first.withColumn("day", F.to_date("timestamp")))
    stored = _read_if_present(batch.sparkSession, path)
    if stored is not None:
        known = stored.select("id", "day")
        if same_day_ids:
            days = [r[0] for r in fresh.select("day").distinct().collect()]
            known = known.where(F.col("day").isin(days))
        fresh = cut_lineage(fresh.join(known.select("id"), "id", "left_anti"))
    fresh.select(*columns, "day").write.mode("append").partitionBy("day").parquet(path)
    return fresh.drop("day")


def append_csv(batch: DataFrame, path: str) -> None:
    """SNK-03."""
    batch.write.mode("append").option("header", True).option("escape", '"').csv(path)


def export_alerts(df: DataFrame, condition: Column, path: str, kind: str = "csv", limit: int | None = None) -> None:
    """SNK-04 and SNK-05: all matching alerts, or with `limit` the newest so many.

    CSV leaves out the probabilities and still has its header when nothing matches.
    """
    rows = df.where(condition) if limit is None else newest(df.where(condition), limit)
    if kind == "csv":
        rows.drop("class_probabilities").write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export kind {kind!r}")


def default_indicators(spark: SparkSession) -> DataFrame:
    rows = [(ip, "whitelist", None, None, None, 0) for ip in DEFAULT_WHITELIST]
    rows += [(ip, "blacklist", None, None, None, 0) for ip in DEFAULT_BLACKLIST]
    rows += [(ip, "malicious_ip", category, score, seen, 0) for ip, category, score, seen in DEFAULT_MALICIOUS]
    return spark.createDataFrame(rows, INDICATOR_SCHEMA)


def read_indicators(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC-09: indicator lists of a JSON file as one tall table, read by many tasks; the defaults when there is no file."""
    if path is None:
        return default_indicators(spark)
    try:
        found = entries(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return default_indicators(spark)
        raise
    none, member = F.lit(None), F.col("member")
    plain = F.get_json_object(F.concat(F.lit('{"v":'), "text", F.lit("}")), "$.v")
    listed = found.where(member.isin("whitelist", "blacklist")).select(
        plain.alias("ip"), member.alias("list_type"), none.cast("string").alias("category"), none.cast("int").alias("threat_score"), none.cast("string").alias("first_seen"))
    one = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), INDICATOR_FILE["known_malicious_ips"].dataType)
    feed = found.where(member == "known_malicious_ips").select(F.explode(one).alias("ip", "e")).select(
        "ip", F.lit("malicious_ip").alias("list_type"), "e.category", "e.threat_score", "e.first_seen")
    return listed.unionByName(feed).withColumn("seq", F.lit(0).cast("bigint"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: mitigation history, one row per action with its block details; the file is read by many tasks."""
    record = F.from_json("text", HISTORY_FILE["history"].dataType.elementType)
    records = entries(spark, path).where("member = 'history'").select(record.alias("r")).select("r.*")
    return records.select("timestamp", "playbook", "attack_type", "target_ip", "status", F.posexplode("actions_taken").alias("step", "a")).select(
        "timestamp", "playbook", "attack_type", "target_ip", "status", "step", "a.action", "a.target_port", "a.limit", "a.details.*"
    ).toDF("timestamp", "playbook", "attack_type", "target_ip", "status", "step", "action", "target_port", "limit",
           "ip", "rule_name", "reason", "blocked_at", "duration_sec", "block_status")


def write_document(members: dict[str, DataFrame], path: str, named: tuple[str, ...] = ()) -> None:
    """One JSON document with an array per member, or an object for the `named` ones, whose entries are the rows' `text`.

    The entries are sorted and written line by line; nothing is gathered in memory. One file is written by one task.
    """
    lines = None
    for number, (name, rows) in enumerate(members.items()):
        ends = ("{", "}") if name in named else ("[", "]")
        first = rows.agg(F.min("text").alias("first"))  # one row
        body = rows.groupBy("text").agg(F.count("*").alias("n")).join(first).select(
            F.lit(3 * number + 1).alias("part"), F.when(F.col("text") == F.col("first"), F.col("text")).otherwise(F.concat(F.lit(","), "text")).alias("value"),
            (F.col("text") != F.col("first")).alias("later"), "n")
        again = body.select("part", F.when(F.col("later"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"), F.lit(True).alias("later"), (F.col("n") - 1).alias("n"))
        body = body.withColumn("n", F.lit(1).cast("bigint")).unionByName(again.where("n > 0")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
        frame = rows.sparkSession.createDataFrame([(3 * number, f'{"," if number else "{"}{json.dumps(name)}: {ends[0]}', False), (3 * number + 2, ends[1], False)],
                                                  "part int, value string, later boolean")
        part = frame.unionByName(body.select("part", "value", "later"))
        lines = part if lines is None else lines.unionByName(part)
    lines = lines.unionByName(lines.sparkSession.createDataFrame([(3 * len(members), "}", False)], "part int, value string, later boolean"))
    lines.repartition(1).sortWithinPartitions("part", "later", "value").select("value").write.mode("overwrite").text(path)


# ---- audit -------------------------------------------------------------------------------------

AUDIT_SCHEMA = "id string, timestamp timestamp, event_type string, username string, ip_address string, action string, status string, details string"


def audit_rows(spark: SparkSession, events: list[dict]) -> DataFrame:
    """AUD-01: events with defaults filled; details become JSON text (EXP-12)."""
    rows = [(e["id"], e["timestamp"], e["event_type"], e.get("username", "system"), e.get("ip_address", "127.0.0.1"),
             e.get("action", "execute"), e.get("status", "success"), json.dumps(e.get("details", {}))) for e in events]
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def append_audit(batch: DataFrame, path: str) -> None:
    """SNK-11: append, partitioned by day."""
    batch.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def read_audit(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """SRC-12: audit rows of the table, or of its CSV form."""
    if kind == "csv":
        return spark.read.schema(AUDIT_SCHEMA).option("header", True).option("escape", '"').option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return spark.read.parquet(path)


def audit_details(df: DataFrame, fields: list[str]) -> DataFrame:
    """EXP-12: named fields of the JSON details as columns."""
    return df.select("*", *[F.get_json_object("details", f"$.{f}").alias(f) for f in fields])


# ---- fan-out -----------------------------------------------------------------------------------


def fan_out(batch: DataFrame, targets: dict[str, Callable[[DataFrame], None]]) -> DataFrame:
    """SNK-13: write one alert batch to every target and return a status row per alert and target.

    A target that fails is recorded and does not stop the others. The batch is computed once for all of them.
    """
    batch = batch.persist()
    ids = batch.select(F.col("id").alias("alert_id"), "timestamp")
    status = None
    for name, write in targets.items():
        try:
            write(batch)
            done = True
        except Exception:  # noqa: BLE001 - any sink error is an outcome to record
            done = False
        rows = ids.withColumns({"target": F.lit(name), "success": F.lit(done)})
        status = rows if status is None else status.unionByName(rows)
    if status is None:
        raise ValueError("no targets configured")
    settled = cut_lineage(status)
    batch.unpersist()
    return settled
