"""Named queries that build flows from packets, enrich and answer alerts, and run streams."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from flowguard.functions import text
from flowguard.functions.constants import FLOW_FEATURES
from flowguard.functions.net import is_internal
from flowguard.operators import alerts as alert_ops
from flowguard.operators import analytics, enrich, flows, respond
from flowguard.plans.catalog import query
from flowguard.session import checkpoint_root, table_state
from flowguard.sources import stores, views
from flowguard.streaming import feed
from flowguard.streaming import flows as stream

STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S')"
HOUR = 3600
IDLE = 6 * HOUR

# ---- packets to flows --------------------------------------------------------------------------

META = ["_src_ip", "_src_port", "_dst_ip", "_dst_port", "_protocol", "_packets"]
PACKET_SQL = """
    n AS (SELECT seq, ts, epoch_us(ts) AS us, protocol, src_ip, dst_ip, length,
                 CASE WHEN protocol IN ('TCP', 'UDP') THEN src_port ELSE 0 END AS sp, CASE WHEN protocol IN ('TCP', 'UDP') THEN dst_port ELSE 0 END AS dp,
                 CASE WHEN protocol = 'TCP' THEN flags ELSE '' END AS flags, CASE WHEN protocol = 'TCP' THEN window_size ELSE 0 END AS win,
                 CASE WHEN protocol = 'TCP' THEN header_len ELSE 20 END AS hdr
          FROM packets WHERE protocol IN ('TCP', 'UDP', 'ICMP', 'IP')),
    k AS (SELECT *, src_ip || ':' || sp AS src, dst_ip || ':' || dp AS dst,
                 protocol || '|' || least(src_ip || ':' || sp, dst_ip || ':' || dp) || '|' || greatest(src_ip || ':' || sp, dst_ip || ':' || dp) AS key FROM n),
    g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY key ORDER BY us, seq) > {idle}, true) AS opens FROM k),
    se AS (SELECT *, sum(opens::INT) OVER (PARTITION BY key ORDER BY us, seq) AS session FROM g)"""
IDLE_SQL = PACKET_SQL.format(idle=IDLE * 1_000_000) + ", fl AS (SELECT *, session AS flow FROM se)"
FEATURE_SQL = """
    fo AS (SELECT *, first(src) OVER w AS opener, first(dst) OVER w AS answerer, first(src_ip) OVER w AS oip, first(sp) OVER w AS op,
                  first(dst_ip) OVER w AS aip, first(dp) OVER w AS ap, (us - lag(us) OVER (PARTITION BY key, flow ORDER BY us, seq)) / 1e6 AS gap
           FROM fl WINDOW w AS (PARTITION BY key, flow ORDER BY us, seq)),
    fd AS (SELECT *, src = opener AS fwd, (us - lag(us) OVER (PARTITION BY key, flow, src = opener ORDER BY us, seq)) / 1e6 AS dgap FROM fo),
    ft AS (SELECT key, flow, greatest(0.001, (max(us) - min(us)) / 1e6) AS sec, sum(length) AS bytes, count(*) AS packets,
                  coalesce(sum(length) FILTER (fwd), 0)::DOUBLE AS "Total Length of Fwd Packets", max(ap)::DOUBLE AS "Destination Port",
                  coalesce(max(length) FILTER (fwd), 0)::DOUBLE AS "Fwd Packet Length Max", coalesce(max(length) FILTER (NOT fwd), 0)::DOUBLE AS "Bwd Packet Length Max",
                  coalesce(stddev_pop(gap) FILTER (gap > 0), 0)::DOUBLE AS iat, coalesce(min(dgap) FILTER (fwd), 0)::DOUBLE AS fmin,
                  coalesce(sum(hdr) FILTER (fwd), 0)::DOUBLE AS "Fwd Header Length", coalesce(sum(hdr) FILTER (NOT fwd), 0)::DOUBLE AS "Bwd Header Length",
                  count(*) FILTER (NOT fwd) AS bwd, count(*) FILTER (contains(flags, 'F'))::DOUBLE AS "FIN Flag Count", count(*) FILTER (contains(flags, 'P'))::DOUBLE AS "PSH Flag Count",
                  coalesce(first(win ORDER BY us, seq) FILTER (fwd), 0)::DOUBLE AS "Init_Win_bytes_forward", coalesce(first(win ORDER BY us, seq) FILTER (NOT fwd), 0)::DOUBLE AS "Init_Win_bytes_backward",
                  count(*) FILTER (fwd AND length - (20 + hdr) > 0)::DOUBLE AS "act_data_pkt_fwd", least(20, min(hdr) FILTER (fwd))::DOUBLE AS "min_seg_size_forward",
                  max(oip) AS _src_ip, max(op)::INT AS _src_port, max(aip) AS _dst_ip, max(ap)::INT AS _dst_port, max(protocol) AS _protocol, min(ts) AS t0, max(ts) AS t1
           FROM fd GROUP BY key, flow)
    SELECT "Destination Port", "Total Length of Fwd Packets", "Fwd Packet Length Max", "Bwd Packet Length Max", round(bytes / sec, 6) AS "Flow Bytes/s",
           round(iat * 2e6) / 2e6 AS "Flow IAT Std", round(fmin, 6) AS "Fwd IAT Min", "Fwd Header Length", "Bwd Header Length", round(bwd / sec, 6) AS "Bwd Packets/s",
           "FIN Flag Count", "PSH Flag Count", "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward",
           0.0::DOUBLE AS "Active Mean", 0.0::DOUBLE AS "Active Std", 0.0::DOUBLE AS "Active Max", 0.0::DOUBLE AS "Idle Std",
           _src_ip, _src_port, _dst_ip, _dst_port, _protocol, packets AS _packets, strftime(t0, '%Y-%m-%d %H:%M:%S.%f') AS _start_time,
           strftime(t1, '%Y-%m-%d %H:%M:%S.%f') AS _last_seen
    FROM ft"""
# A day-long active timeout: the starts of a session follow one another, so they are found by recursion.
ACTIVE = 24 * HOUR
ACTIVE_SQL = "WITH RECURSIVE " + PACKET_SQL.format(idle=IDLE * 1_000_000) + f""",
    nx AS (SELECT *, lead(us) OVER (PARTITION BY key, session ORDER BY us, seq) AS next_us, lead(seq) OVER (PARTITION BY key, session ORDER BY us, seq) AS next_seq FROM se),
    li AS (SELECT a.key, a.session, a.us, a.seq, min_by(b.next_us, (b.us, b.seq)) AS to_us, min_by(b.next_seq, (b.us, b.seq)) AS to_seq
           FROM nx a JOIN nx b ON a.key = b.key AND a.session = b.session AND b.us > a.us + {ACTIVE * 1_000_000} GROUP BY ALL),
    st AS (SELECT key, session, us, seq FROM se WHERE opens
           UNION SELECT li.key, li.session, to_us, to_seq FROM li JOIN st ON li.key = st.key AND li.session = st.session AND li.us = st.us AND li.seq = st.seq
           WHERE to_us IS NOT NULL),
    fl AS (SELECT se.*, sum((st.us IS NOT NULL)::INT) OVER (PARTITION BY se.key ORDER BY se.us, se.seq) AS flow
           FROM se LEFT JOIN st ON se.key = st.key AND se.session = st.session AND se.us = st.us AND se.seq = st.seq)"""


def _printed(df):
    # Half a microsecond is the finest step of the deviation of two gaps, so it rounds without ties.
    df = df.withColumn("Flow IAT Std", F.round(F.col("Flow IAT Std") * 2e6) / 2e6)
    exact = {"Flow Bytes/s": 6, "Fwd IAT Min": 6, "Bwd Packets/s": 6}
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return df.select(
        *[F.round(f"`{c}`", exact[c]).alias(c) if c in exact else F.col(f"`{c}`") for c in FLOW_FEATURES], *META,
        F.date_format("_start_time", stamp).alias("_start_time"), F.date_format("_last_seen", stamp).alias("_last_seen"))


@query("flow_features_batch", "packets", f"WITH {IDLE_SQL}, {FEATURE_SQL}")
def flow_features_batch(spark, folder):
    return _printed(flows.flow_features(views.packets(spark, folder), IDLE, None, 24 * HOUR))


@query("flow_idle_split", "packets", f"""
    WITH {IDLE_SQL} SELECT seq, first(seq) OVER (PARTITION BY key, flow ORDER BY us, seq) AS flow_start FROM fl""")
def flow_idle_split(spark, folder):
    sessions = flows.idle_sessions(flows.network_packets(views.packets(spark, folder)), IDLE, 24 * HOUR)
    return sessions.select("seq", F.col("start.seq").alias("flow_start"))


@query("flow_active_split", "packets", f"{ACTIVE_SQL} SELECT seq, first(seq) OVER (PARTITION BY key, flow ORDER BY us, seq) AS flow_start FROM fl")
def flow_active_split(spark, folder):
    sessions = flows.idle_sessions(flows.network_packets(views.packets(spark, folder)), IDLE, 24 * HOUR)
    return flows.active_flows(sessions, ACTIVE, IDLE).select("seq", F.col("start.seq").alias("flow_start"))


@query("flow_features_active", "packets", f"{ACTIVE_SQL}, {FEATURE_SQL}")
def flow_features_active(spark, folder):
    return _printed(flows.flow_features(views.packets(spark, folder), IDLE, ACTIVE, 24 * HOUR))


PARTS = 4
ROWS_PER_FILE = 1_000_000
_SPLIT: dict[tuple, tuple[str, int]] = {}


def event_stream(spark, folder):
    """The event log as four micro-batches in order of time, null times first.

    Each holds as many files as its size asks for, dealt in turn. They are written once for the present state of the files.
    """
    events, place = views.table(spark, folder, "events"), (spark.sparkContext.applicationId, table_state(spark, f"{folder}/events.parquet"))
    if place not in _SPLIT:
        path = f"{checkpoint_root(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        cuts = events.select(at.cast("double").alias("at")).approxQuantile("at", [k / PARTS for k in range(1, PARTS)], 0.01)
        files = -(-events.count() // (PARTS * ROWS_PER_FILE)) or 1
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            below = F.lit(True) if high is None else at <= high
            inside = at.isNull() | below if low is None else (at > low) & below
            events.where(inside).repartition(files).write.mode("append").parquet(path)
        _SPLIT[place] = (path, files)
    path, files = _SPLIT[place]
    return feed.read_stream(spark, path, events.schema, files)


def _streamed(spark, folder, active):
    packets = views.packet_columns(event_stream(spark, folder))
    closed, state = stream.run_to_table(stream.closed_flows(packets, IDLE, active, "1 hour"))
    return _printed(stream.state_features(closed.unionByName(stream.open_flows(spark, state))))


@query("stream_flows", "packets", f"WITH {IDLE_SQL}, {FEATURE_SQL}")
def stream_flows(spark, folder):
    return _streamed(spark, folder, None)


@query("stream_flows_active", "packets", f"{ACTIVE_SQL}, {FEATURE_SQL}")
def stream_flows_active(spark, folder):
    return _streamed(spark, folder, ACTIVE)


# ---- streams over alerts -----------------------------------------------------------------------


def _alert_stream(spark, folder):
    return views.alert_columns(event_stream(spark, folder))


@query("stream_trends", "alerts", """
    SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M') AS start, count(*) AS total, count(*) FILTER (attack_type = 'BENIGN') AS benign,
           count(*) FILTER (attack_type <> 'BENIGN') AS attacks FROM alerts GROUP BY 1""")
def stream_trends(spark, folder):
    table, _ = stream.run_to_table(feed.trend(_alert_stream(spark, folder)), "update", ["start"])
    return table.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("stream_rates", "alerts", """
    WITH w AS (SELECT attack_type, epoch_us(alerts.timestamp) // 10000000 + unnest(range(1, 7)) AS slot FROM alerts)
    SELECT slot * 10 AS at, attack_type, count(*) AS alerts, round(count(*) / 60.0::DOUBLE, 6) AS per_second FROM w GROUP BY ALL""")
def stream_rates(spark, folder):
    table, _ = stream.run_to_table(feed.rates(_alert_stream(spark, folder)), "update", ["at", "attack_type"])
    return table.select(F.unix_seconds("at").alias("at"), "attack_type", "alerts", F.round("per_second", 6).alias("per_second"))


@query("stream_dedup", "alerts", "SELECT id, attack_type FROM alerts")
def stream_dedup(spark, folder):
    doubled = _alert_stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    table, _ = stream.run_to_table(feed.distinct_feed(doubled))
    return table.select("id", "attack_type")


@query("stream_tail", "alerts", f"""
    WITH n AS (SELECT max(alerts.timestamp) AS newest FROM alerts WHERE event_id % 5 < 3)
    SELECT id, {STAMP} AS timestamp, CASE WHEN timestamp < newest THEN 'late' WHEN timestamp = newest THEN 'equal' ELSE 'after' END AS place
    FROM alerts, n WHERE event_id % 5 >= 3
    UNION ALL SELECT 'again-' || id, {STAMP}, 'equal' FROM alerts, n WHERE event_id % 5 < 3 AND timestamp = newest""")
def stream_tail(spark, folder):
    # Three fifths of the alerts are stored before the tail starts; the others, most of them older than the newest
    # stored one, and copies of the newest under another id come after it.
    alerts = views.alerts(spark, folder).select("id", "timestamp", "event_id")
    root = f"{checkpoint_root(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    store, cursor = f"{root}/alerts", f"{root}/cursor"
    first = alerts.where("event_id % 5 < 3")
    first.write.parquet(store)
    feed.mark_end(spark, store, alerts.schema, cursor)
    newest = spark.read.parquet(store).agg(F.max("timestamp")).first()[0]
    alerts.where("event_id % 5 >= 3").write.mode("append").parquet(store)
    first.where(F.col("timestamp") == F.lit(newest)).withColumn("id", F.concat(F.lit("again-"), "id")).write.mode("append").parquet(store)
    table, _ = stream.run_to_table(feed.arrivals(spark, store, alerts.schema, cursor))
    at = F.col("timestamp")
    place = F.when(at < F.lit(newest), "late").when(at == F.lit(newest), "equal").otherwise("after")
    return table.select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), place.alias("place"))


@query("stream_session", "alerts", f"""
    SELECT count(*) AS prediction_count, count(*) FILTER (attack_type <> 'BENIGN') AS attack_count, count(*) FILTER (attack_type = 'BENIGN') AS benign_count,
           round(avg(prediction_time_ms), 3) AS average_latency_ms, round(avg(confidence), 4) AS average_confidence,
           {", ".join(f"count(*) FILTER (risk_level = '{lv}') AS {lv.lower()}_alerts" for lv in analytics.LEVELS)}
    FROM alerts WHERE timestamp >= TIMESTAMP '2024-01-10'""")
def stream_session(spark, folder):
    events = _alert_stream(spark, folder).withColumnRenamed("prediction_time_ms", "latency_ms").withColumn("count", F.lit(1).cast("bigint"))
    table, _ = stream.run_to_table(feed.session_metrics(events, datetime(2024, 1, 10)), "complete")
    return table


@query("stream_limiter", "", f"""
    WITH RECURSIVE q AS (SELECT '10.1.0.' || (user_id % 250) AS client, event_id AS seq, epoch_us(ts) AS us FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY us, seq) AS i FROM q),
    l AS (SELECT client, seq, us, i, [us] AS times, true AS admitted FROM r WHERE i = 1
          UNION ALL
          SELECT client, seq, us, i, CASE WHEN len(f) < 3 THEN list_append(f, us) ELSE f END, len(f) < 3
          FROM (SELECT r.client, r.seq, r.us, r.i, list_filter(l.times, lambda x: r.us - x < {12 * HOUR * 1_000_000}) AS f
                FROM l JOIN r ON r.client = l.client AND r.i = l.i + 1))
    SELECT client, seq, us AS "at", admitted FROM l""")
def stream_limiter(spark, folder):
    requests = event_stream(spark, folder).select(
        F.concat(F.lit("10.1.0."), (F.col("user_id") % 250).cast("string")).alias("client"), F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    table, _ = stream.run_to_table(feed.admitted_requests(requests, 3, 12 * HOUR))
    return table


# ---- enrichment --------------------------------------------------------------------------------

LOOKUP_SQL = """
    lk AS (SELECT ip, list_type, category, threat_score FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY
             CASE list_type WHEN 'whitelist' THEN 1 WHEN 'blacklist' THEN 2 ELSE 3 END, seq DESC) AS r FROM ioc) WHERE r = 1),
    mt AS (SELECT alerts.*, ip IS NOT NULL AS ioc_matched, coalesce(list_type, 'none') AS ioc_type,
                  CASE list_type WHEN 'whitelist' THEN 'allow' WHEN 'blacklist' THEN 'block' WHEN 'malicious_ip' THEN 'flag' ELSE 'inspect' END AS ioc_action,
                  CASE list_type WHEN 'whitelist' THEN 0 WHEN 'blacklist' THEN 100 WHEN 'malicious_ip' THEN coalesce(threat_score, 80) ELSE 0 END AS ioc_score,
                  CASE WHEN list_type = 'malicious_ip' THEN coalesce(category, 'Threat Feed') END AS ioc_category
           FROM alerts LEFT JOIN lk ON src_ip = ip),
    ov AS (SELECT * REPLACE (CASE ioc_action WHEN 'allow' THEN 0.0::DOUBLE WHEN 'block' THEN 100.0::DOUBLE ELSE risk_score END AS risk_score,
                             CASE ioc_action WHEN 'allow' THEN 'Low' WHEN 'block' THEN 'Critical' ELSE risk_level END AS risk_level) FROM mt)"""
MATCH = ["id", "src_ip", "ioc_matched", "ioc_type", "ioc_action", "ioc_score", "ioc_category"]


@query("ioc_match", "alerts ioc", f"WITH {LOOKUP_SQL} SELECT {', '.join(MATCH)} FROM mt")
def ioc_match(spark, folder):
    return enrich.match_indicators(views.alerts(spark, folder), views.ioc(spark, folder)).select(*MATCH)


@query("ioc_match_salted", "alerts ioc", f"WITH {LOOKUP_SQL} SELECT {', '.join(MATCH)} FROM mt")
def ioc_match_salted(spark, folder):
    # The form for indicator tables too large to broadcast.
    return enrich.match_indicators(views.alerts(spark, folder), views.ioc(spark, folder), broadcast_rows=0, salts=4, hot_share=0.01).select(*MATCH)


@query("ioc_counts", "ioc", "SELECT list_type, count(*) AS rules FROM ioc GROUP BY list_type")
def ioc_counts(spark, folder):
    return analytics.indicator_counts(views.ioc(spark, folder))


EDIT_SQL = """
    ed AS (SELECT '203.0.113.' || (s_suppkey % 250) AS ip, CASE WHEN s_suppkey % 2 = 0 THEN 'whitelist' ELSE 'blacklist' END AS list_type,
                  'Manual ' || s_suppkey AS category, '2026-07-26' AS first_seen, s_suppkey + 1000000 AS seq FROM supplier WHERE s_suppkey % 5 = 0),
    la AS (SELECT ip, max_by(list_type, seq) AS list_type, max(seq) AS seq FROM ed GROUP BY ip),
    bl AS (SELECT ip, max_by(category, seq) AS category, max(seq) AS seq FROM ed WHERE list_type = 'blacklist' GROUP BY ip)"""


@query("ioc_edits", "ioc", f"""
    WITH {EDIT_SQL}
    SELECT ip, list_type, category, threat_score, seq FROM ioc WHERE list_type <> 'malicious_ip' AND ip NOT IN (SELECT ip FROM la)
    UNION ALL SELECT ip, list_type, category, threat_score, seq FROM ioc WHERE list_type = 'malicious_ip' AND ip NOT IN (SELECT ip FROM bl)
    UNION ALL SELECT ip, list_type, NULL, NULL, seq FROM la UNION ALL SELECT ip, 'malicious_ip', category, 100, seq FROM bl""")
def ioc_edits(spark, folder):
    key = F.col("s_suppkey")
    edits = views.table(spark, folder, "supplier").where(key % 5 == 0).select(
        F.concat(F.lit("203.0.113."), (key % 250).cast("string")).alias("ip"), F.when(key % 2 == 0, "whitelist").otherwise("blacklist").alias("list_type"),
        F.concat(F.lit("Manual "), key.cast("string")).alias("category"), F.lit("2026-07-26").alias("first_seen"), (key + 1000000).alias("seq"))
    return enrich.apply_edits(views.ioc(spark, folder), edits).drop("first_seen")


@query("socket_attribution", "packets", """
    WITH inv AS (SELECT port, max_by(process, seq) AS process FROM (
        SELECT (CASE WHEN s_suppkey % 10 = 0 THEN 443 ELSE 40000 + s_suppkey % 90 END)::INT AS port, 'proc' || (s_suppkey % 7) AS process, s_suppkey AS seq FROM supplier) GROUP BY port)
    SELECT seq, coalesce(a.process, b.process, 'unknown') AS process FROM packets LEFT JOIN inv a ON a.port = src_port LEFT JOIN inv b ON b.port = dst_port""")
def socket_attribution(spark, folder):
    key = F.col("s_suppkey")
    inventory = views.table(spark, folder, "supplier").select(
        F.when(key % 10 == 0, 443).otherwise(F.lit(40000) + key % 90).cast("int").alias("port"),
        F.concat(F.lit("proc"), (key % 7).cast("string")).alias("process"), key.alias("seq"))
    return enrich.attribute_sockets(views.packets(spark, folder), inventory).select("seq", "process")


REPUTATION_SQL = """
    SELECT id, src_ip, risk_score, risk_level, CASE WHEN NOT internal AND off THEN 85 ELSE 0 END AS threat_score, NOT internal AND off AS is_malicious,
           CASE WHEN internal THEN 'Internal IP / Private Subnet' WHEN off THEN 'AbuseIPDB Score: 85%|OTX Pulses: 3' ELSE '' END AS tags,
           CASE WHEN internal THEN 0 ELSE 3 END AS providers
    FROM (SELECT *, starts_with(src_ip, '10.') OR starts_with(src_ip, '192.168.') AS internal, starts_with(src_ip, '185.') OR starts_with(src_ip, '198.') AS off FROM ov)"""


def _reputation_row(df):
    return df.select("id", "src_ip", "risk_score", "risk_level", "threat_score", "is_malicious",
                     F.array_join("reputation_tags", "|").alias("tags"), F.size("provider_results").alias("providers"))


@query("reputation_enrich", "alerts ioc", f"WITH {LOOKUP_SQL} {REPUTATION_SQL}")
def reputation_enrich(spark, folder):
    return _reputation_row(enrich.enrich_alerts(views.alerts(spark, folder), views.ioc(spark, folder)))


@query("enriched_feed", "alerts ioc", f"WITH {LOOKUP_SQL} {REPUTATION_SQL} ORDER BY ov.timestamp DESC, id LIMIT 20".replace("ov.timestamp", "timestamp"))
def enriched_feed(spark, folder):
    return _reputation_row(enrich.enriched_feed(views.alerts(spark, folder), views.ioc(spark, folder), 20))


@query("reputation_feeds", "alerts ioc", """
    WITH ab AS (SELECT ip, max(coalesce(threat_score, 60)) AS score FROM ioc WHERE list_type = 'malicious_ip' AND seq % 3 <> 0 GROUP BY ip),
         pu AS (SELECT ip, count(*)::INT AS pulses FROM ioc WHERE list_type = 'blacklist' GROUP BY ip)
    SELECT id, CASE WHEN NOT internal AND score > 50 THEN score ELSE 0 END AS threat_score, NOT internal AND (coalesce(score, 0) > 50 OR coalesce(pulses, 0) > 0) AS is_malicious,
           CASE WHEN internal THEN 'Internal IP / Private Subnet' ELSE concat_ws('|', CASE WHEN score > 50 THEN 'AbuseIPDB Score: ' || score || '%' END,
                CASE WHEN pulses > 0 THEN 'OTX Pulses: ' || pulses END) END AS tags
    FROM (SELECT *, starts_with(src_ip, '10.') OR starts_with(src_ip, '192.168.') AS internal FROM alerts LEFT JOIN ab ON src_ip = ab.ip LEFT JOIN pu ON src_ip = pu.ip)""")
def reputation_feeds(spark, folder):
    listed = views.ioc(spark, folder)
    as_of = datetime(2024, 1, 31, 12)
    # An entry fetched two hours ago has outlived its time to live and is not used.
    abuse = enrich.fresh(listed.where("list_type = 'malicious_ip'").withColumn(
        "fetched_at", F.lit(as_of) - F.when(F.col("seq") % 3 == 0, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 10 MINUTES"))), as_of)
    abuse = abuse.groupBy("ip").agg(F.max(F.coalesce("threat_score", F.lit(60))).alias("abuse_score"), F.count("*").cast("int").alias("reports"))
    pulses = listed.where("list_type = 'blacklist'").groupBy("ip").agg(F.count("*").cast("int").alias("pulse_count"))
    rows = enrich.reputation(views.alerts(spark, folder), abuse=abuse, pulses=pulses)
    return rows.select("id", "threat_score", "is_malicious", F.array_join("reputation_tags", "|").alias("tags"))


@query("internal_addresses", "alerts", """
    SELECT id, starts_with(src_ip, '10.') OR starts_with(src_ip, '192.168.') OR starts_with(src_ip, '127.') OR starts_with(src_ip, '172.16.') OR starts_with(src_ip, '172.31.') AS compatible,
           regexp_matches(src_ip, '^(10\\.|127\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') AS strict FROM alerts""")
def internal_addresses(spark, folder):
    ip = F.col("src_ip")
    return views.alerts(spark, folder).select("id", is_internal(ip).alias("compatible"), is_internal(ip, strict=True).alias("strict"))


NUMBER_SQL = "CASE risk_level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 4 WHEN 'High' THEN 7 WHEN 'Critical' THEN 10 ELSE 1 END"


@query("siem_lines", "alerts", f"""
    WITH a AS (SELECT *, {NUMBER_SQL} AS num, round(risk_score, 1)::VARCHAR AS score, round(confidence, 3)::VARCHAR AS conf FROM alerts)
    SELECT id, 'CEF:0|FlowGuard|flow-analytics|1.0.0|ALERT-' || attack_type || '|' || attack_type || ' Intrusion Detected|' || num || '|src=' || src_ip || ' dst=' || dst_ip
             || ' dport=' || dst_port || ' proto=' || protocol || ' cn1=' || score || ' cn1Label=RiskScore msg=Confidence: ' || conf AS cef,
           'LEEF:1.0|FlowGuard|flow-analytics|1.0.0|' || attack_type || '|devTime=' || {STAMP} || chr(9) || 'src=' || src_ip || chr(9) || 'dst=' || dst_ip || chr(9)
             || 'dstPort=' || dst_port || chr(9) || 'proto=' || protocol || chr(9) || 'sev=' || num || chr(9) || 'riskScore=' || score AS leef,
           '<134>1 ' || {STAMP} || ' flowguard flow-engine - ' || id || ' [threat@flowguard attack="' || attack_type || '" risk="' || score || '"] Threat Alert: '
             || attack_type || ' from ' || src_ip || ' targeting ' || dst_ip || ':' || dst_port AS rfc5424,
           '{{"syslog_header":"<134>1 ' || {STAMP} || ' flowguard flow-engine","alert":{{"id":"' || id || '","src_ip":"' || src_ip || '","dst_port":' || dst_port || '}}}}' AS envelope,
           '{{"event":{{"id":"' || id || '"}},"sourcetype":"flowguard:alert","source":"flowguard"}}' AS collector, 'flowguard-alerts/_doc/' || id AS document
    FROM a""")
def siem_lines(spark, folder):
    alerts = views.alerts(spark, folder).withColumns({"risk_score": F.round("risk_score", 1), "confidence": F.round("confidence", 3)})
    return alerts.select(
        "id", text.cef_line().alias("cef"), text.leef_line().alias("leef"), text.rfc5424_line().alias("rfc5424"),
        text.json_envelope(["id", "src_ip", "dst_port"]).alias("envelope"), text.collector_event(["id"]).alias("collector"), text.document_path().alias("document"))


# ---- response ----------------------------------------------------------------------------------

DECISION_SQL = """
    pb AS (SELECT *, CASE attack_type WHEN 'DoS Hulk' THEN 'dos_mitigation' WHEN 'PortScan' THEN 'port_scan_containment' WHEN 'Bot' THEN 'botnet_isolation'
                     WHEN 'SSH-Patator' THEN 'brute_force_isolation' ELSE 'generic' END AS playbook FROM alerts),
    ac AS (SELECT id, timestamp, attack_type, src_ip, playbook, 0 AS step, CASE playbook WHEN 'dos_mitigation' THEN 'firewall_block' WHEN 'port_scan_containment' THEN 'temporary_quarantine'
                  WHEN 'generic' THEN 'auto_block' ELSE 'emergency_isolation' END AS action,
                  CASE playbook WHEN 'dos_mitigation' THEN 7200 WHEN 'port_scan_containment' THEN 1800 WHEN 'generic' THEN 3600 ELSE 86400 END AS duration_sec, NULL::INT AS target_port
           FROM pb WHERE playbook <> 'generic' OR risk_score >= 70
           UNION ALL SELECT id, timestamp, attack_type, src_ip, playbook, 1, CASE playbook WHEN 'dos_mitigation' THEN 'rate_limit' ELSE 'terminate_tcp_session' END, NULL,
                  CASE playbook WHEN 'dos_mitigation' THEN dst_port END FROM pb WHERE playbook IN ('dos_mitigation', 'botnet_isolation', 'brute_force_isolation'))"""


@query("playbook_decisions", "alerts", f"""
    WITH {DECISION_SQL} SELECT id AS alert_id, playbook, attack_type, src_ip AS target_ip, step, action, duration_sec, target_port,
      CASE WHEN step = 0 THEN 'FLOWGUARD_BLOCK_' || replace(src_ip, '.', '_') END AS rule_name FROM ac""")
def playbook_decisions(spark, folder):
    rows = respond.action_rows(respond.decide(views.alerts(spark, folder)))
    return rows.select("alert_id", "playbook", "attack_type", "target_ip", "step", "action", "duration_sec", "target_port", "rule_name")


BLOCK_SQL = DECISION_SQL + """,
    bk AS (SELECT src_ip AS ip, max(struct_pack(t := timestamp, i := id, d := duration_sec)) AS b FROM ac WHERE step = 0 GROUP BY src_ip),
    un AS (SELECT '203.0.113.' || (s_suppkey % 250) AS ip, max(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (s_suppkey % 900)) AS at_time FROM supplier GROUP BY 1)"""


def _unblocks(spark, folder):
    key = F.col("s_suppkey")
    return views.table(spark, folder, "supplier").select(
        F.concat(F.lit("203.0.113."), (key % 250).cast("string")).alias("ip"),
        (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(hours=(key % 900).cast("int"))).alias("timestamp"))


@query("active_blocks", "alerts", f"""
    WITH {BLOCK_SQL} SELECT bk.ip, strftime(b.t, '%Y-%m-%d %H:%M:%S') AS blocked_at, b.d AS duration_sec, b.i AS alert_id
    FROM bk LEFT JOIN un ON bk.ip = un.ip WHERE at_time IS NULL OR at_time < b.t""")
def active_blocks(spark, folder):
    blocks = respond.active_blocks(respond.decide(views.alerts(spark, folder)), _unblocks(spark, folder))
    return blocks.select("ip", F.date_format("blocked_at", "yyyy-MM-dd HH:mm:ss").alias("blocked_at"), "duration_sec", "alert_id")


@query("unexpired_blocks", "alerts", f"""
    WITH {BLOCK_SQL} SELECT ip, b.d AS duration_sec FROM bk WHERE b.t + INTERVAL 1 SECOND * b.d > TIMESTAMP '2024-01-30 18:00:00'""")
def unexpired_blocks(spark, folder):
    blocks = respond.active_blocks(respond.decide(views.alerts(spark, folder)), as_of=datetime(2024, 1, 30, 18))
    return blocks.select("ip", "duration_sec")


@query("mitigation_summary", "alerts", f"""
    WITH {BLOCK_SQL} SELECT (SELECT count(*) FROM alerts) AS total_playbooks_executed, (SELECT count(*) FROM bk) AS active_blocks_count,
      (SELECT string_agg(id, ',' ORDER BY t DESC, id DESC) FROM (SELECT id, alerts.timestamp AS t FROM alerts ORDER BY alerts.timestamp DESC, id DESC LIMIT 10)) AS recent""")
def mitigation_summary(spark, folder):
    records = respond.decide(views.alerts(spark, folder))
    table = respond.mitigation_summary(records, respond.active_blocks(records))
    return table.select("total_playbooks_executed", "active_blocks_count", F.array_join("recent_actions.alert_id", ",").alias("recent"))


@query("latest_history", "alerts", "SELECT id AS alert_id FROM alerts ORDER BY timestamp DESC, id DESC LIMIT 500")
def latest_history(spark, folder):
    return respond.newest_records(respond.decide(views.alerts(spark, folder))).select("alert_id")


@query("delivery_log", "alerts", """
    SELECT id AS alert_id, event_id % 7 <> 0 AND event_id % 5 <> 0 AS overall_success, 2 AS targets FROM alerts""")
def delivery_log(spark, folder):
    alerts = views.alerts(spark, folder)
    status = [alerts.select(F.col("id").alias("alert_id"), "timestamp", F.lit(name).alias("target"), (F.col("event_id") % k != 0).alias("success"))
              for name, k in (("search", 7), ("collector", 5))]
    log = respond.delivery_log(status[0].unionByName(status[1]))
    return log.select("alert_id", "overall_success", F.size("dispatches").alias("targets"))


# ---- audit -------------------------------------------------------------------------------------


@query("audit_query", "audit", f"""
    SELECT id, {STAMP} AS timestamp, event_type, username, status, json_extract_string(details, '$.k') AS k
    FROM audit WHERE event_type = 'ERROR' AND status = 'failure' ORDER BY audit.timestamp DESC, id LIMIT 100""")
def audit_query(spark, folder):
    rows = views.audit(spark, folder).where(alert_ops.equal_filters(event_type="ERROR", username=None, status="failure"))
    return stores.audit_details(alert_ops.newest(rows, 100), ["k"]).select(
        "id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "event_type", "username", "status", "k")


@query("burst_detection", "audit", """
    WITH r AS (SELECT ip_address, epoch_us(timestamp) AS us, count(*) AS requests FROM audit GROUP BY ALL),
         c AS (SELECT *, (sum(requests) OVER (PARTITION BY ip_address ORDER BY us RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW))::BIGINT AS in_window FROM r)
    SELECT ip_address, us, requests, in_window, in_window > 2 AS limited FROM c""")
def burst_detection(spark, folder):
    # Requests of one user lie hours apart in the test table, hence the twelve-hour window.
    table = enrich.request_bursts(views.audit(spark, folder), "ip_address", "timestamp", 2, 12 * HOUR)
    return table.select("ip_address", F.unix_micros("timestamp").alias("us"), "requests", "in_window", "limited")
