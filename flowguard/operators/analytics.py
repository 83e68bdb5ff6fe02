"""Totals, breakdowns and trends over alert rows (AGG-01 to AGG-10, AGG-12, AGG-15, AGG-16)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.functions.risk import time_label
from flowguard.operators.alerts import day_filter, newest, time_filter
from flowguard.operators.distributed import running_totals

LEVELS = ["Critical", "High", "Medium", "Low"]
BENIGN = "BENIGN"


def _benign() -> Column:
    return F.col("attack_type") == BENIGN


def _level_counts(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("risk_level") == level).alias(f"{prefix}{level.lower()}") for level in LEVELS]


def _rounded_avg(name: str, digits: int) -> Column:
    return F.round(F.coalesce(F.avg(name), F.lit(0.0)), digits)


def alert_totals(df: DataFrame) -> DataFrame:
    """AGG-01: all-time totals; zeros over an empty table."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(~_benign()).alias("attacks"),
        F.count_if(_benign()).alias("benign"),
        _rounded_avg("confidence", 4).alias("average_confidence"),
        _rounded_avg("prediction_time_ms", 3).alias("average_latency"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last_time"))


def dashboard_metrics(df: DataFrame) -> DataFrame:
    """AGG-02: totals with the four severity counts, one pass."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(~_benign()).alias("attacks"),
        F.count_if(_benign()).alias("benign"),
        _rounded_avg("confidence", 4).alias("average_confidence"),
        _rounded_avg("prediction_time_ms", 3).alias("average_latency"),
        *_level_counts(),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last_time"))


def severity_counts(df: DataFrame) -> DataFrame:
    """AGG-03."""
    return df.agg(*_level_counts())


def top_attacks(df: DataFrame, limit: int = 10) -> DataFrame:
    """AGG-04: most frequent attack types, name as tie-break."""
    return df.groupBy("attack_type").agg(
        F.count("*").alias("alert_count"),
        F.round(F.avg("confidence"), 4).alias("average_confidence"),
        F.round(F.avg("risk_score"), 2).alias("average_risk_score"),
    ).orderBy(F.col("alert_count").desc(), "attack_type").limit(limit)


def trend(df: DataFrame, as_of: datetime, time_range: str = "all", points: int | None = None) -> DataFrame:
    """AGG-05: hourly for the last day, else daily, in time order; with `points` only the latest so many."""
    totals = df.where(time_filter(as_of, time_range)).groupBy(
        time_label(F.col("timestamp"), time_range == "24h").alias("time")
    ).agg(
        F.count("*").alias("total"), F.count_if(_benign()).alias("benign"), F.count_if(~_benign()).alias("attacks"))
    return (totals if points is None else totals.orderBy(F.col("time").desc()).limit(points)).orderBy("time")


def daily_report(df: DataFrame, day: str) -> DataFrame:
    """AGG-06 in tidy form: (section, name, value) with totals, averages and counts per attack and risk.

    One grouping over (attack, level) partials feeds every section, so the day is read once.
    """
    partial = df.where(day_filter(day)).groupBy("attack_type", "risk_level").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum("risk_score").alias("r"))
    return breakdown(partial, {"average_confidence": ("c", 4), "average_risk_score": ("r", 2)}, "total_alerts")


def breakdown(partial: DataFrame, averages: dict[str, tuple[str, int]], total_name: str) -> DataFrame:
    """Unfold (attack_type, risk_level, n, sums) partials into tidy sections by grouping sets."""
    entries = F.array(
        F.struct(F.lit("attack").alias("section"), F.col("attack_type").alias("name")),
        F.struct(F.lit("risk").alias("section"), F.col("risk_level").alias("name")),
        F.struct(F.lit("total").alias("section"), F.lit(None).cast("string").alias("name")),
    )
    sums = [s for s, _ in averages.values()]
    grouped = partial.select(F.explode(entries).alias("e"), "n", *sums).groupBy("e.section", "e.name").agg(
        F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])
    lines = F.when(F.col("section") != "total", F.array(_line("section", F.col("name"), F.col("n").cast("double")))).otherwise(
        F.array(_line("section", F.lit(total_name), F.col("n").cast("double")),
                *[_line("section", F.lit(k), F.round(F.col(s) / F.col("n"), d)) for k, (s, d) in averages.items()]))
    return grouped.select(F.inline(lines))


def _line(section: str, name: Column, value: Column) -> Column:
    return F.struct(F.col(section).alias("section"), name.alias("name"), value.alias("value"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """AGG-08 over scored rows, same tidy form as the daily report."""
    partial = predictions.groupBy("attack_type", "risk_level").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum("risk_score").alias("r"),
        F.sum("prediction_time_ms").alias("t"))
    averages = {"average_confidence": ("c", 4), "average_risk_score": ("r", 2), "average_latency_ms": ("t", 3)}
    return breakdown(partial, averages, "total_records_predicted")


def partial_totals(df: DataFrame) -> DataFrame:
    """A mergeable summary of one part of the alerts."""
    return df.agg(
        F.count("*").alias("n"), F.count_if(~_benign()).alias("attacks"),
        F.avg("confidence").alias("avg_confidence"), F.avg("prediction_time_ms").alias("avg_latency"),
        F.max("timestamp").alias("last_time"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """AGG-09: counts add up, averages are weighted by count, the latest time wins."""
    n = F.sum("n")
    return partials.agg(
        n.alias("total"), F.sum("attacks").alias("attacks"),
        F.round(F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("avg_confidence")), n), F.lit(0.0)), 4).alias("average_confidence"),
        F.round(F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("avg_latency")), n), F.lit(0.0)), 3).alias("average_latency"),
        F.date_format(F.max("last_time"), "yyyy-MM-dd HH:mm:ss").alias("last_time"))


def session_counters(df: DataFrame, count: str = "count") -> DataFrame:
    """AGG-10: weighted counters; any unknown level counts as Low, the attack name is compared in upper case."""
    weight = F.col(count)
    level = F.initcap(F.lower("risk_level"))
    known = F.when(level.isin("Critical", "High", "Medium"), level).otherwise("Low")
    benign = F.upper("attack_type") == BENIGN

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0).cast("bigint"))

    def mean(name: str, digits: int) -> Column:
        return F.round(F.coalesce(F.try_divide(F.sum(F.col(name) * weight), F.sum(weight)), F.lit(0.0)), digits)
    return df.agg(
        F.coalesce(F.sum(weight), F.lit(0).cast("bigint")).alias("prediction_count"),
        total(~benign).alias("attack_count"), total(benign).alias("benign_count"),
        mean("latency_ms", 3).alias("average_latency_ms"), mean("confidence", 4).alias("average_confidence"),
        *[total(known == lv).alias(f"{lv.lower()}_alerts") for lv in LEVELS])


def running_confidence(df: DataFrame, groups: list[str], order: list[str], rows_per_task: int = 1_000_000) -> DataFrame:
    """AGG-16: running mean confidence and running threat count in event order.

    Confidence is summed in whole millionths, so the result does not depend on how the rows were split.
    """
    threat = F.when(F.col("risk_level").isin("High", "Critical") | (F.upper("attack_type") != BENIGN), 1).otherwise(0)
    summed = running_totals(
        df, groups, order,
        {"seen": F.lit(1).cast("bigint"), "confidence_sum": F.round(F.col("confidence") * 1_000_000).cast("bigint"),
         "threats": threat.cast("bigint")}, rows_per_task)
    return summed.withColumn("average_confidence", F.col("confidence_sum") / 1_000_000 / F.col("seen")).drop("confidence_sum")


def indicator_counts(indicators: DataFrame) -> DataFrame:
    """AGG-12."""
    return indicators.groupBy("list_type").agg(F.count("*").alias("rules"))


def report_dataset(df: DataFrame, as_of: datetime, session: DataFrame | None = None, model: DataFrame | None = None) -> DataFrame:
    """AGG-15: summary, severity, top ten attacks and the newest fifty alerts as one nested row, with the
    one-row frames of session counters and model metadata when given.

    The lists are collected only after their limits, so the row has a fixed maximum size.
    """
    summary = alert_totals(df).select(F.struct("*").alias("summary"), F.lit(1).alias("k"))
    severity = severity_counts(df).select(F.struct("*").alias("severity"), F.lit(1).alias("k"))
    attacks = top_attacks(df, 10).agg(F.sort_array(F.collect_list(F.struct("alert_count", "attack_type", "average_confidence")), False).alias("top_attacks"))
    latest = newest(df, 50).agg(F.sort_array(F.collect_list(F.struct("timestamp", "id", "attack_type", "risk_level")), False).alias("latest"))
    parts = [severity, attacks.withColumn("k", F.lit(1)), latest.withColumn("k", F.lit(1))]
    parts += [f.limit(1).select(F.struct("*").alias(name), F.lit(1).alias("k")) for name, f in (("session", session), ("model", model)) if f is not None]
    for part in parts:
        summary = summary.join(part, "k")
    return summary.drop("k").withColumn("as_of", F.lit(as_of))
