"""Named queries over the alert view."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from flowguard.functions.risk import top_probabilities
from flowguard.operators import alerts as ops
from flowguard.operators import analytics as stats
from flowguard.plans.catalog import query
from flowguard.sources import views

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S')"
ROW = ["id", "timestamp", "attack_type", "confidence", "risk_score", "risk_level", "src_ip", "dst_ip", "protocol", "dst_port"]
ROW_SQL = f"id, {STAMP} AS timestamp, attack_type, round(confidence, 4) AS confidence, risk_score, risk_level, src_ip, dst_ip, protocol, dst_port"


def _row(df):
    return df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "confidence", F.round("confidence", 4)).select(*ROW)


@query("top_attacks", "alerts", """
    SELECT attack_type, count(*) AS alert_count, round(avg(confidence), 4) AS average_confidence,
           round(avg(risk_score), 2) AS average_risk_score
    FROM alerts GROUP BY attack_type ORDER BY alert_count DESC, attack_type LIMIT 10""")
def top_attacks(spark, folder):
    return stats.top_attacks(views.alerts(spark, folder))


@query("alert_summary", "alerts", """
    SELECT count(*) AS total, count(*) FILTER (attack_type <> 'BENIGN') AS attacks, count(*) FILTER (attack_type = 'BENIGN') AS benign,
           round(coalesce(avg(confidence), 0), 4) AS average_confidence, round(coalesce(avg(prediction_time_ms), 0), 3) AS average_latency,
           strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_time FROM alerts""")
def alert_summary(spark, folder):
    return stats.alert_totals(views.alerts(spark, folder))


LEVEL_SQL = ", ".join(f"count(*) FILTER (risk_level = '{lv}') AS {lv.lower()}" for lv in stats.LEVELS)


@query("dashboard_metrics", "alerts", f"""
    SELECT count(*) AS total, count(*) FILTER (attack_type <> 'BENIGN') AS attacks, count(*) FILTER (attack_type = 'BENIGN') AS benign,
           round(coalesce(avg(confidence), 0), 4) AS average_confidence, round(coalesce(avg(prediction_time_ms), 0), 3) AS average_latency,
           {LEVEL_SQL}, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_time FROM alerts""")
def dashboard_metrics(spark, folder):
    return stats.dashboard_metrics(views.alerts(spark, folder))


@query("severity_counts", "alerts", f"SELECT {LEVEL_SQL} FROM alerts")
def severity_counts(spark, folder):
    return stats.severity_counts(views.alerts(spark, folder))


TREND_SQL = """
    SELECT strftime(timestamp, '{fmt}') AS time, count(*) AS total, count(*) FILTER (attack_type = 'BENIGN') AS benign,
           count(*) FILTER (attack_type <> 'BENIGN') AS attacks
    FROM alerts {where} GROUP BY 1"""


@query("trend_hourly", "alerts", TREND_SQL.format(fmt="%Y-%m-%d %H:00", where=f"WHERE timestamp >= {AS_OF_SQL} - INTERVAL 1 DAY"))
def trend_hourly(spark, folder):
    return stats.trend(views.alerts(spark, folder), AS_OF, "24h")


@query("trend_daily", "alerts", TREND_SQL.format(fmt="%Y-%m-%d", where=""))
def trend_daily(spark, folder):
    return stats.trend(views.alerts(spark, folder), AS_OF, "all")


@query("daily_report", "alerts", """
    WITH day AS (SELECT * FROM alerts WHERE timestamp >= TIMESTAMP '2024-01-15' AND timestamp < TIMESTAMP '2024-01-16')
    SELECT 'attack' AS section, attack_type AS name, count(*)::DOUBLE AS value FROM day GROUP BY attack_type
    UNION ALL SELECT 'risk', risk_level, count(*)::DOUBLE FROM day GROUP BY risk_level
    UNION ALL SELECT 'total', 'total_alerts', count(*)::DOUBLE FROM day
    UNION ALL SELECT 'total', 'average_confidence', round(avg(confidence), 4) FROM day
    UNION ALL SELECT 'total', 'average_risk_score', round(avg(risk_score), 2) FROM day""")
def daily_report(spark, folder):
    return stats.daily_report(views.alerts(spark, folder), "2024-01-15")


@query("prediction_summary", "alerts", """
    SELECT 'attack' AS section, attack_type AS name, count(*)::DOUBLE AS value FROM alerts GROUP BY attack_type
    UNION ALL SELECT 'risk', risk_level, count(*)::DOUBLE FROM alerts GROUP BY risk_level
    UNION ALL SELECT 'total', 'total_records_predicted', count(*)::DOUBLE FROM alerts
    UNION ALL SELECT 'total', 'average_confidence', round(avg(confidence), 4) FROM alerts
    UNION ALL SELECT 'total', 'average_risk_score', round(avg(risk_score), 2) FROM alerts
    UNION ALL SELECT 'total', 'average_latency_ms', round(avg(prediction_time_ms), 3) FROM alerts""")
def prediction_summary(spark, folder):
    return stats.prediction_summary(views.alerts(spark, folder))


@query("merge_partials", "alerts", """
    SELECT count(*) AS total, count(*) FILTER (attack_type <> 'BENIGN') AS attacks, round(avg(confidence), 4) AS average_confidence,
           round(avg(prediction_time_ms), 3) AS average_latency, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_time
    FROM alerts""")
def merge_partials(spark, folder):
    alerts = views.alerts(spark, folder)
    parts = [stats.partial_totals(alerts.where(F.col("protocol") == p)) for p in ("TCP", "UDP", "ICMP")]
    return stats.merge_partials(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("session_counters", "alerts", """
    WITH s AS (SELECT *, event_id % 4 + 1 AS n, prediction_time_ms AS l FROM alerts)
    SELECT sum(n)::BIGINT AS prediction_count, sum(CASE WHEN attack_type <> 'BENIGN' THEN n ELSE 0 END)::BIGINT AS attack_count,
           sum(CASE WHEN attack_type = 'BENIGN' THEN n ELSE 0 END)::BIGINT AS benign_count,
           round(sum(l * n) / sum(n), 3) AS average_latency_ms, round(sum(confidence * n) / sum(n), 4) AS average_confidence,
           sum(CASE WHEN event_id % 11 <> 0 AND risk_level = 'Critical' THEN n ELSE 0 END)::BIGINT AS critical_alerts,
           sum(CASE WHEN event_id % 11 <> 0 AND risk_level = 'High' THEN n ELSE 0 END)::BIGINT AS high_alerts,
           sum(CASE WHEN event_id % 11 <> 0 AND risk_level = 'Medium' THEN n ELSE 0 END)::BIGINT AS medium_alerts,
           sum(CASE WHEN event_id % 11 = 0 OR risk_level = 'Low' THEN n ELSE 0 END)::BIGINT AS low_alerts
    FROM s""")
def session_counters(spark, folder):
    events = views.alerts(spark, folder).select(
        F.lower("attack_type").alias("attack_type"), "confidence", F.col("prediction_time_ms").alias("latency_ms"),
        F.when(F.col("event_id") % 11 == 0, "SEVERE").otherwise(F.upper("risk_level")).alias("risk_level"),
        (F.col("event_id") % 4 + 1).alias("count"))
    return stats.session_counters(events)


@query("running_confidence", "alerts", """
    SELECT id, src_ip, seen, threats, average_confidence FROM (
      SELECT id, src_ip, count(*) OVER w AS seen,
             (sum(CASE WHEN risk_level IN ('High', 'Critical') OR attack_type <> 'BENIGN' THEN 1 ELSE 0 END) OVER w)::BIGINT AS threats,
             sum(round(confidence * 1000000)::BIGINT) OVER w / 1000000.0::DOUBLE / count(*) OVER w AS average_confidence
      FROM alerts WINDOW w AS (PARTITION BY src_ip ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING))""")
def running_confidence(spark, folder):
    alerts = views.alerts(spark, folder).select("id", "src_ip", "timestamp", "event_id", "risk_level", "attack_type", "confidence")
    return stats.running_confidence(alerts, ["src_ip"], ["timestamp", "event_id"]).select("id", "src_ip", "seen", "threats", "average_confidence")


@query("alert_filter", "alerts", f"""
    SELECT {ROW_SQL} FROM alerts WHERE protocol = 'TCP' AND risk_level = 'High' AND attack_type = 'DoS Hulk'
    ORDER BY alerts.timestamp DESC, id LIMIT 100""")
def alert_filter(spark, folder):
    return _row(ops.query_alerts(views.alerts(spark, folder), protocol="TCP", risk_level="High", attack_type="DoS Hulk", src_ip=None))


@query("alert_search", "alerts", f"""
    SELECT {ROW_SQL} FROM alerts WHERE id ILIKE '%hulk%' OR src_ip ILIKE '%hulk%' OR dst_ip ILIKE '%hulk%' OR attack_type ILIKE '%hulk%'""")
def alert_search(spark, folder):
    return _row(views.alerts(spark, folder).where(ops.history_filter(AS_OF, search="hulk", attack_type="All")))


@query("alert_time_range", "alerts", f"SELECT {ROW_SQL} FROM alerts WHERE alerts.timestamp >= {AS_OF_SQL} - INTERVAL 7 DAY")
def alert_time_range(spark, folder):
    window = ops.time_filter(AS_OF, "7d", datetime(2024, 1, 1), datetime(2024, 1, 2))
    return _row(views.alerts(spark, folder).where(window))


@query("alert_date_range", "alerts", f"""
    SELECT {ROW_SQL} FROM alerts WHERE alerts.timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08 12:00:00'""")
def alert_date_range(spark, folder):
    return _row(views.alerts(spark, folder).where(ops.time_filter(AS_OF, "all", datetime(2024, 1, 5), datetime(2024, 1, 8, 12))))


@query("alert_page", "alerts", f"""
    SELECT {ROW_SQL} FROM alerts WHERE risk_level = 'Critical' ORDER BY alerts.timestamp DESC, id LIMIT 20 OFFSET 40""")
def alert_page(spark, folder):
    return _row(ops.page_rows(views.alerts(spark, folder), ops.history_filter(AS_OF, risk_level="Critical"), 3, 20))


@query("alert_page_totals", "alerts", """
    SELECT count(*) AS total, 3 AS page, 20 AS page_size, greatest(1, ceil(count(*) / 20.0))::BIGINT AS total_pages
    FROM alerts WHERE risk_level = 'Critical'""")
def alert_page_totals(spark, folder):
    return ops.page_totals(views.alerts(spark, folder), ops.history_filter(AS_OF, risk_level="Critical"), 3, 20)


@query("alert_tail", "alerts", f"""
    SELECT {ROW_SQL} FROM alerts WHERE event_id > 500 ORDER BY event_id LIMIT 50""")
def alert_tail(spark, folder):
    return _row(ops.rows_after(views.alerts(spark, folder), 500, 50, "event_id"))


@query("alert_tail_cursor", "alerts", """
    SELECT max(event_id) AS cursor FROM (SELECT event_id FROM alerts WHERE event_id > 500 ORDER BY event_id LIMIT 50)""")
def alert_tail_cursor(spark, folder):
    return ops.next_cursor(ops.rows_after(views.alerts(spark, folder), 500, 50, "event_id"), 500, "event_id")


@query("feed_latest", "alerts", f"SELECT {ROW_SQL} FROM alerts ORDER BY alerts.timestamp DESC, id LIMIT 50")
def feed_latest(spark, folder):
    alerts = views.alerts(spark, folder)
    return _row(ops.latest_feed(alerts.unionByName(alerts)))


@query("feed_view", "alerts", """
    SELECT id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, attack_type AS attack, round(confidence, 4) AS confidence, risk_score,
           risk_level, src_ip, CASE WHEN dst_port <> 0 THEN dst_port ELSE 80 END AS dst_port,
           floor(prediction_time_ms * 1000 + 0.5) / 1000.0 AS latency_ms
    FROM alerts WHERE risk_level = 'High' AND contains(src_ip, '203.0')""")
def feed_view(spark, folder):
    feed = ops.feed_view(views.alerts(spark, folder)).where(ops.feed_filter("High", "All", " 203.0 "))
    return feed.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).withColumn("confidence", F.round("confidence", 4))


@query("feed_merge", "alerts", """
    SELECT id, attack_type, risk_level FROM alerts WHERE risk_level IN ('High', 'Critical')
    UNION ALL SELECT * FROM (SELECT 'DB-' || id, attack_type, risk_level FROM alerts WHERE risk_level = 'Critical'
                             ORDER BY timestamp DESC, id LIMIT 10)""")
def feed_merge(spark, folder):
    alerts = views.alerts(spark, folder).select("id", "attack_type", "risk_level", "timestamp")
    return ops.merge_feed(ops.notify(alerts), alerts).select("id", "attack_type", "risk_level")


@query("notify_high", "alerts", f"SELECT {ROW_SQL} FROM alerts WHERE risk_level IN ('High', 'Critical')")
def notify_high(spark, folder):
    return _row(ops.notify(views.alerts(spark, folder)))


@query("threat_flags", "alerts", """
    SELECT attack_type, risk_level, risk_level IN ('High', 'Critical') OR attack_type <> 'BENIGN' AS is_threat, count(*) AS alerts
    FROM alerts GROUP BY ALL""")
def threat_flags(spark, folder):
    return ops.threat_rows(views.alerts(spark, folder)).groupBy("attack_type", "risk_level", "is_threat").agg(F.count("*").alias("alerts"))


@query("normalise_event", "alerts", """
    SELECT id, CASE WHEN event_id % 3 = 0 THEN 'BENIGN' ELSE attack_type END AS attack_type,
           CASE WHEN event_id % 2 = 0 THEN 0.99 ELSE round(confidence, 4) END AS confidence, 0.0::DOUBLE AS risk_score, risk_level,
           prediction_time_ms, src_ip, '10.0.0.1' AS dst_ip, 'TCP' AS protocol, dst_port
    FROM alerts""")
def normalise_event(spark, folder):
    raw = views.alerts(spark, folder).select(
        "id", F.when(F.col("event_id") % 3 == 1, F.col("attack_type")).alias("attack_type"),
        F.when(F.col("event_id") % 3 == 2, F.col("attack_type")).alias("Attack_Type_2"),
        F.when(F.col("event_id") % 2 == 1, F.round("confidence", 4)).alias("Prediction_Confidence"),
        F.col("risk_level").alias("Risk_Level"), F.col("prediction_time_ms").alias("latency_ms"), "src_ip", "dst_port")
    raw = raw.withColumn("attack_type", F.coalesce("attack_type", "Attack_Type_2")).drop("Attack_Type_2")
    return ops.normalise_event(raw)


@query("expand_batch_alerts", "alerts", """
    WITH c AS (SELECT attack_type, count(*) AS n FROM alerts GROUP BY attack_type),
         a AS (SELECT round(avg(confidence), 4) AS confidence, round(avg(risk_score), 2) AS risk_score,
                      round(avg(prediction_time_ms), 3) AS prediction_time_ms FROM alerts)
    SELECT attack_type, unnest(range(1, n + 1)) AS record, confidence, risk_score,
           CASE WHEN attack_type = 'BENIGN' THEN 'Low' ELSE 'Critical' END AS risk_level, prediction_time_ms,
           'CSV-Batch' AS src_ip, 'API-Server' AS dst_ip, 'TCP' AS protocol, 80 AS dst_port
    FROM c, a""")
def expand_batch_alerts(spark, folder):
    alerts = views.alerts(spark, folder)
    mean = alerts.agg(F.round(F.avg("confidence"), 4), F.round(F.avg("risk_score"), 2), F.round(F.avg("prediction_time_ms"), 3)).first()
    return ops.expand_batch(alerts.groupBy("attack_type").agg(F.count("*").alias("n")), *mean)


@query("report_dataset", "alerts", f"""
    WITH top AS (SELECT attack_type, count(*) AS n FROM alerts GROUP BY attack_type ORDER BY n DESC, attack_type LIMIT 10),
         latest AS (SELECT id, alerts.timestamp AS t FROM alerts ORDER BY alerts.timestamp DESC, id LIMIT 50)
    SELECT count(*) AS total, {LEVEL_SQL}, (SELECT string_agg(attack_type, ',' ORDER BY n DESC, attack_type DESC) FROM top) AS attacks,
           (SELECT string_agg(id, ',' ORDER BY t DESC, id DESC) FROM latest) AS latest
    FROM alerts""")
def report_dataset(spark, folder):
    report = stats.report_dataset(views.alerts(spark, folder), AS_OF)
    return report.select(
        F.col("summary.total").alias("total"), *[F.col(f"severity.{lv.lower()}").alias(lv.lower()) for lv in stats.LEVELS],
        F.array_join("top_attacks.attack_type", ",").alias("attacks"), F.array_join("latest.id", ",").alias("latest"))


@query("top_probabilities", "scored", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, r AS place, k AS class, p AS probability FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, price, l_shipdate ORDER BY p DESC, k) AS r
      FROM (SELECT *, unnest(['c0', 'c1', 'c2']) AS k, unnest([p0, p1, p2]) AS p FROM scored)) WHERE r <= 2""")
def top_two(spark, folder):
    scored = views.scored(spark, folder)
    probabilities = F.create_map(F.lit("c0"), F.col("p0"), F.lit("c1"), F.col("p1"), F.lit("c2"), F.col("p2"))
    ranked = scored.select(*views.FLOW_KEY[:4], F.posexplode(top_probabilities(probabilities, 2)).alias("place", "e"))
    return ranked.select(*views.FLOW_KEY[:4], (F.col("place") + 1).cast("bigint").alias("place"),
                         F.col("e.key").alias("class"), F.col("e.value").alias("probability"))
