"""Building, filtering, paging and deduplicating alert rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.functions.constants import ALERT_DEFAULTS
from flowguard.functions.risk import is_threat

# Days covered by each time preset.
PRESET_DAYS = {"24h": 1, "7d": 7, "30d": 30}
SEARCH_FIELDS = ["id", "src_ip", "dst_ip", "attack_type"]
ALERT_COLUMNS = ["id", "timestamp", "attack_type", "confidence", "risk_score", "risk_level", "src_ip", "dst_ip",
                 "protocol", "dst_port", "prediction_time_ms", "class_probabilities"]

# Alternative field names of an incoming event.
EVENT_ALIASES = {
    "attack_type": "Attack_Type",
    "confidence": "Prediction_Confidence",
    "risk_score": "Risk_Score",
    "risk_level": "Risk_Level",
    "prediction_time_ms": "Prediction_Time_ms",
}


def equal_filters(**wanted) -> Column:
    """FIL-01, FIL-04, FIL-07: AND of equalities; None, empty text and "All" switch a filter off."""
    condition = F.lit(True)
    for name, value in wanted.items():
        if value not in (None, "", "All"):
            condition = condition & (F.col(name) == F.lit(value))
    return condition


def time_filter(as_of: datetime, preset: str = "all", start: datetime | None = None, end: datetime | None = None,
                column: str = "timestamp") -> Column:
    """FIL-02: a preset wins over dates; a date range holds both ends and needs both."""
    if preset in PRESET_DAYS:
        return F.col(column) >= F.lit(as_of) - F.make_dt_interval(F.lit(PRESET_DAYS[preset]))
    if start is not None and end is not None:
        return F.col(column).between(F.lit(start), F.lit(end))
    return F.lit(True)


def text_filter(search: str | None, fields: list[str] | None = None) -> Column:
    """FIL-03: case-insensitive substring in any field; % and _ keep their pattern meaning."""
    if not search:
        return F.lit(True)
    condition = F.lit(False)
    for name in fields or SEARCH_FIELDS:
        condition = condition | F.col(name).ilike(f"%{search}%")
    return condition


def day_filter(day: str, column: str = "timestamp") -> Column:
    """FIL-05: one calendar day as a range, so files and date partitions are skipped."""
    start = F.lit(day).cast("date").cast("timestamp")
    return (F.col(column) >= start) & (F.col(column) < start + F.make_dt_interval(F.lit(1)))


def newest(df: DataFrame, limit: int, column: str = "timestamp", tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(column).desc(), F.col(tie)).limit(limit)


def query_alerts(df: DataFrame, limit: int = 100, **wanted) -> DataFrame:
    """FIL-01."""
    return newest(df.where(equal_filters(**wanted)), limit)


def history_filter(as_of: datetime, time_range: str = "all", attack_type: str | None = None, risk_level: str | None = None,
                   search: str | None = None, start: datetime | None = None, end: datetime | None = None) -> Column:
    return (time_filter(as_of, time_range, start, end)
            & equal_filters(attack_type=attack_type, risk_level=risk_level) & text_filter(search))


def page_totals(df: DataFrame, condition: Column, page: int, page_size: int) -> DataFrame:
    """SRT-01: row and page totals of a filter; at least one page."""
    pages = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.count("*") / F.lit(page_size)))
    return df.where(condition).agg(F.count("*").alias("total"), F.lit(page).alias("page"),
                                   F.lit(page_size).alias("page_size"), pages.alias("total_pages"))


def page_rows(df: DataFrame, condition: Column, page: int, page_size: int) -> DataFrame:
    """SRT-01: one page, newest first."""
    ordered = df.where(condition).orderBy(F.col("timestamp").desc(), F.col("id"))
    return ordered.offset((page - 1) * page_size).limit(page_size)


def rows_after(df: DataFrame, cursor: int, limit: int = 50, sequence: str = "seq") -> DataFrame:
    """FIL-06: the next rows behind a cursor, oldest first."""
    return df.where(F.col(sequence) > cursor).orderBy(sequence).limit(limit)


def next_cursor(rows: DataFrame, cursor: int, sequence: str = "seq") -> DataFrame:
    return rows.agg(F.coalesce(F.max(sequence), F.lit(cursor)).alias("cursor"))


def normalise_event(df: DataFrame) -> DataFrame:
    """PRJ-12: first name, then its alternative, then the default."""
    present = set(df.columns)
    picked = []
    for name, default in ALERT_DEFAULTS.items():
        names = [n for n in (name, "latency_ms" if name == "prediction_time_ms" else None, EVENT_ALIASES.get(name)) if n in present]
        picked.append(F.coalesce(*[F.col(n) for n in names], F.lit(default)).cast(_kind(default)).alias(name))
    rest = [c for c in ("id", "timestamp", "class_probabilities") if c in present]
    return df.select(*rest, *picked)


def _kind(default) -> T.DataType:
    return {float: T.DoubleType(), int: T.IntegerType(), str: T.StringType()}[type(default)]


def build_alerts(predictions: DataFrame, at: Column, key: list[str]) -> DataFrame:
    """PRJ-13: prediction rows to alert rows.

    The id is the time plus a hash of the row's own key, so it is stable when a task is run again and
    two rows of the same millisecond do not share it.
    """
    present = set(predictions.columns)

    def value(source: str, name: str) -> Column:
        default = F.lit(ALERT_DEFAULTS[name])
        return F.coalesce(F.col(source), default) if source in present else default
    stamp = F.date_format(at, "yyyyMMddHHmmss")
    probabilities = (
        F.coalesce(F.to_json("Class_Probabilities"), F.lit("{}")) if "Class_Probabilities" in present else F.lit("{}"))
    return predictions.select(
        F.concat(F.lit("ALT-"), stamp, F.lit("-"), F.lower(F.hex(F.xxhash64(at, *key)))).alias("id"),
        at.alias("timestamp"),
        value("Attack_Type", "attack_type").alias("attack_type"),
        (F.coalesce(F.col("Prediction_Confidence"), F.lit(1.0)) if "Prediction_Confidence" in present else F.lit(1.0)).alias("confidence"),
        value("Risk_Score", "risk_score").alias("risk_score"),
        value("Risk_Level", "risk_level").alias("risk_level"),
        value("_src_ip", "src_ip").alias("src_ip"),
        value("_dst_ip", "dst_ip").alias("dst_ip"),
        value("_protocol", "protocol").alias("protocol"),
        value("_dst_port", "dst_port").cast("int").alias("dst_port"),
        (F.coalesce(F.col("Prediction_Time_ms"), F.lit(0.03)) if "Prediction_Time_ms" in present else F.lit(0.03)).alias("prediction_time_ms"),
        probabilities.alias("class_probabilities"),
    )


def feed_view(df: DataFrame) -> DataFrame:
    """PRJ-16: one line of the live feed."""
    return df.select(
        "id", "timestamp",
        F.coalesce("attack_type", F.lit("BENIGN")).alias("attack"),
        F.coalesce("confidence", F.lit(0.99)).alias("confidence"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("risk_level", F.lit("Low")).alias("risk_level"),
        F.coalesce("src_ip", F.lit("192.168.1.1")).alias("src_ip"),
        F.coalesce(F.when(F.col("dst_port") != 0, F.col("dst_port")), F.lit(80)).alias("dst_port"),
        F.coalesce(F.floor(F.col("prediction_time_ms") * 1000 + 0.5) / 1000.0, F.lit(0.035)).alias("latency_ms"),
    )


def feed_filter(level: str = "All", attack: str = "All", ip: str = "") -> Column:
    """FIL-08 over `feed_view`."""
    condition = equal_filters(risk_level=level, attack=attack)
    return condition & F.contains(F.lower("src_ip"), F.lit(ip.strip().lower())) if ip.strip() else condition


def latest_feed(df: DataFrame, limit: int = 50) -> DataFrame:
    """SRT-04: the newest distinct items. A limit is the feature: the feed shows 50."""
    return newest(df.dropDuplicates(["id"]), limit)


def notify(df: DataFrame) -> DataFrame:
    """FIL-10: only High and Critical are announced."""
    return df.where(F.col("risk_level").isin("High", "Critical"))


def merge_feed(live: DataFrame, stored: DataFrame, limit: int = 10) -> DataFrame:
    """SET-04: the newest stored Critical alerts join the live feed under a prefixed id, one row per id."""
    recent = newest(stored.where(F.col("risk_level") == "Critical"), limit)
    tagged = recent.withColumn("id", F.concat(F.lit("DB-"), F.col("id")))
    return live.unionByName(tagged).dropDuplicates(["id"])


def threat_rows(df: DataFrame) -> DataFrame:
    """FIL-09."""
    return df.withColumn("is_threat", is_threat(F.col("attack_type"), F.col("risk_level")))


def expand_batch(counts: DataFrame, confidence: float, risk: float, latency: float) -> DataFrame:
    """AGG-14: one alert per counted record, all with the batch averages.

    `counts` holds (attack_type, n). Each class is first cut into blocks of 100,000, which are spread
    over the cluster before the second explode, so one frequent class does not fill one task.
    """
    block = 100_000
    blocks = counts.where(F.col("n") > 0).select(
        "attack_type", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block))).alias("block"))
    spread = blocks.repartition("attack_type", "block")
    first = F.col("block") * block + 1
    last = F.least(F.col("n"), (F.col("block") + 1) * block)
    return spread.select("attack_type", F.explode(F.sequence(first, last)).alias("record")).select(
        "attack_type", "record",
        F.lit(confidence).alias("confidence"), F.lit(risk).alias("risk_score"),
        F.when(F.col("attack_type") == "BENIGN", "Low").otherwise("Critical").alias("risk_level"),
        F.lit(latency).alias("prediction_time_ms"),
        F.lit("CSV-Batch").alias("src_ip"), F.lit("API-Server").alias("dst_ip"),
        F.lit("TCP").alias("protocol"), F.lit(80).alias("dst_port"))
