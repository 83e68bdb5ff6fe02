"""Named queries that write the test tables through the sinks and read them back through the sources.

Each writes whole tables below the checkpoint folder, settles its result and removes what it wrote.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from flowguard.operators import alerts as alert_ops
from flowguard.operators import features, profiling, respond
from flowguard.plans import training
from flowguard.plans.catalog import query
from flowguard.plans.flow_queries import event_stream
from flowguard.session import cut_lineage, scratch_folder
from flowguard.sources import flow_files, stores, views
from flowguard.streaming import feed

STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S')"
FLOW = ["l_orderkey", "l_partkey", "quantity", "price", "label"]


def _numbers(df):
    """CSV brings text; the flow columns get their types back."""
    kinds = {"l_orderkey": "bigint", "l_partkey": "bigint", "quantity": "double", "price": "double"}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in FLOW if c in df.columns])


@query("csv_round_trip", "flows", f"SELECT {', '.join(FLOW)} FROM flows")
def csv_round_trip(spark, folder):
    flows = views.flows(spark, folder).select(*FLOW)
    with scratch_folder(spark) as place:
        flows.where("label <> 'R'").write.option("header", True).csv(f"{place}/day")
        flows.where("label = 'R'").select(*reversed(FLOW)).write.mode("append").option("header", True).csv(f"{place}/day")
        return cut_lineage(_numbers(flow_files.load_merged(spark, flow_files.scan_directory(spark, f"{place}/day"))))


@query("recursive_scan", "flows", """
    SELECT l_orderkey, l_partkey, quantity, NULL::DOUBLE AS price, label FROM flows WHERE label = 'A'
    UNION ALL SELECT l_orderkey, l_partkey, quantity, price, NULL FROM flows WHERE label <> 'A'""")
def recursive_scan(spark, folder):
    flows = views.flows(spark, folder).select(*FLOW)
    with scratch_folder(spark) as place:
        flows.where("label = 'A'").drop("price").write.option("header", True).csv(f"{place}/raw.v2/a")
        flows.where("label <> 'A'").drop("label").write.option("header", True).csv(f"{place}/raw.v2/b/c")
        return cut_lineage(_numbers(flow_files.load_merged(spark, flow_files.find_csv_files(spark, f"{place}/raw.v2"), strict=False)))


@query("typed_csv", "flows", f"SELECT {', '.join(FLOW)} FROM flows")
def typed_csv(spark, folder):
    flows = views.flows(spark, folder).select(*FLOW)
    with scratch_folder(spark) as place:
        flows.write.option("header", True).csv(place)
        return cut_lineage(flow_files.read_csv(spark, place, flows.schema))


@query("split_round_trip", "flows", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, price, l_shipdate, r > floor(0.2::DOUBLE * n + 0.5) AS is_train
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m, l_orderkey, l_partkey, l_suppkey, l_linenumber, price, l_shipdate) AS r,
                 count(*) OVER (PARTITION BY label) AS n FROM flows)""")
def split_round_trip(spark, folder):
    split = features.stratified_split(views.flows(spark, folder), "label", views.flow_mix(), views.FLOW_KEY)
    with scratch_folder(spark) as place:
        flow_files.write_table(split, place, ["split"])
        train, test = flow_files.load_split(spark, place)
        return cut_lineage(train.select(*views.FLOW_KEY, F.lit(True).alias("is_train")).unionByName(test.select(*views.FLOW_KEY, F.lit(False).alias("is_train"))))


@query("append_twice_keeps_first", "alerts", f"""
    SELECT id, {STAMP} AS timestamp, CASE WHEN event_id % 2 = 0 THEN attack_type ELSE 'second' END AS attack_type, risk_score FROM alerts""")
def append_twice_keeps_first(spark, folder):
    alerts = views.alerts(spark, folder)
    with scratch_folder(spark) as place:
        stores.append_alerts(alerts.where("event_id % 2 = 0"), place)
        stores.append_alerts(alerts.withColumn("attack_type", F.lit("second")), place)
        stores.append_alerts(alerts.withColumn("attack_type", F.lit("third")), place, same_day_ids=False)
        stored = stores.read_alerts(spark, place)
        return cut_lineage(stored.select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "attack_type", "risk_score"))


@query("append_csv", "alerts", "SELECT id, attack_type, src_ip FROM alerts")
def append_csv(spark, folder):
    alerts = views.alerts(spark, folder).select("id", "attack_type", "src_ip", "event_id")
    with scratch_folder(spark) as place:
        stores.append_csv(alerts.where("event_id % 3 = 0").drop("event_id"), place)
        stores.append_csv(alerts.where("event_id % 3 <> 0").drop("event_id"), place)
        return cut_lineage(flow_files.read_csv(spark, place))


@query("export_csv", "alerts", "SELECT id, attack_type, risk_score FROM alerts WHERE risk_level = 'High'")
def export_csv(spark, folder):
    alerts = views.alerts(spark, folder).withColumn("class_probabilities", F.lit("{}"))
    with scratch_folder(spark) as place:
        stores.export_alerts(alerts, alert_ops.equal_filters(risk_level="High"), place)
        written = flow_files.read_csv(spark, place)
        return cut_lineage(written.select("id", "attack_type", F.col("risk_score").cast("double").alias("risk_score")))


@query("export_json", "alerts", "SELECT id, src_ip, dst_port, risk_score FROM alerts WHERE attack_type = 'Bot'")
def export_json(spark, folder):
    with scratch_folder(spark) as place:
        stores.export_alerts(views.alerts(spark, folder), alert_ops.equal_filters(attack_type="Bot"), place, "json")
        return cut_lineage(spark.read.schema("id string, src_ip string, dst_port int, risk_score double").json(place))


@query("export_newest", "alerts", "SELECT id FROM alerts ORDER BY timestamp DESC, id DESC LIMIT 500")
def export_newest(spark, folder):
    # A limit that the caller asks for.
    with scratch_folder(spark) as place:
        stores.export_alerts(views.alerts(spark, folder), F.lit(True), place, "json", 500)
        return cut_lineage(spark.read.schema("id string").json(place))


@query("predictions_csv", "scored", """
    SELECT l_orderkey, l_partkey, ['BENIGN', 'DDoS', 'PortScan'][pred + 1] AS attack_type, greatest(p0, p1, p2) AS confidence, round_even(p1, 4) AS ddos FROM scored""")
def predictions_csv(spark, folder):
    given = views.scored(spark, folder).withColumn("probabilities", F.array("p0", "p1", "p2"))
    with scratch_folder(spark) as place:
        flow_files.write_predictions(training.prediction_table(given, "given", ["BENIGN", "DDoS", "PortScan"], ["l_orderkey", "l_partkey"]), place)
        written = spark.read.option("header", True).option("escape", '"').csv(place)
        return cut_lineage(written.select(
            F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_partkey").cast("bigint").alias("l_partkey"), F.col("Attack_Type").alias("attack_type"),
            F.col("Prediction_Confidence").cast("double").alias("confidence"),
            F.try_element_at(F.from_json("Class_Probabilities", "map<string,double>"), F.lit("DDoS")).alias("ddos")))


@query("summary_files", "flows", """
    SELECT 'classes' AS kind, label AS name, count(*)::DOUBLE AS value FROM flows GROUP BY label
    UNION ALL SELECT 'report', 'rows', count(*)::DOUBLE FROM flows""")
def summary_files(spark, folder):
    flows = views.flows(spark, folder)
    with scratch_folder(spark) as place:
        flow_files.write_summaries({"classes": profiling.class_distribution(flows, "label")}, f"{place}/tables")
        flow_files.write_json(flows.agg(F.count("*").alias("rows")), f"{place}/report")
        classes = flow_files.read_csv(spark, f"{place}/tables/classes").select(F.lit("classes").alias("kind"), F.col("class").alias("name"), F.col("rows").cast("double").alias("value"))
        report = spark.read.schema("rows double").json(f"{place}/report").select(F.lit("report").alias("kind"), F.lit("rows").alias("name"), F.col("rows").alias("value"))
        return cut_lineage(classes.unionByName(report))


@query("indicator_file", "ioc", """
    SELECT DISTINCT ip, list_type, NULL AS category, NULL::INT AS threat_score FROM ioc WHERE list_type <> 'malicious_ip'
    UNION ALL SELECT ip, 'malicious_ip', max_by(category, seq), max_by(coalesce(threat_score, 0), seq) FROM ioc WHERE list_type = 'malicious_ip' GROUP BY ip""")
def indicator_file(spark, folder):
    listed = views.ioc(spark, folder)
    feed_rows = listed.where("list_type = 'malicious_ip'").groupBy("ip").agg(
        F.max_by("category", "seq").alias("category"), F.max_by(F.coalesce("threat_score", F.lit(0)), "seq").alias("threat_score"), F.first("first_seen").alias("first_seen"))
    entry = F.to_json(F.create_map("ip", F.struct("category", "threat_score", "first_seen")))
    members = {name: listed.where(F.col("list_type") == name).select(F.concat(F.lit('"'), "ip", F.lit('"')).alias("text")).distinct() for name in ("whitelist", "blacklist")}
    members["known_malicious_ips"] = feed_rows.select(entry.substr(F.lit(2), F.length(entry) - 2).alias("text"))
    with scratch_folder(spark) as place:
        stores.write_document(members, place, ("known_malicious_ips",))
        return cut_lineage(stores.read_indicators(spark, place).select("ip", "list_type", "category", "threat_score"))


@query("history_file", "", """
    SELECT '203.0.113.' || (s_suppkey % 250) AS ip, 'RULE_' || s_suppkey AS rule_name, (s_suppkey % 7 * 600)::INT AS duration_sec, 'block' AS action, 0 AS step FROM supplier
    UNION ALL SELECT NULL, NULL, NULL, 'rate_limit', 1 FROM supplier""")
def history_file(spark, folder):
    key, none = F.col("s_suppkey"), F.lit(None).cast("string")
    details = F.struct(F.concat(F.lit("203.0.113."), (key % 250).cast("string")).alias("ip"), F.concat(F.lit("RULE_"), key.cast("string")).alias("rule_name"),
                       (key % 7 * 600).cast("int").alias("duration_sec"))
    actions = F.array(F.struct(F.lit("block").alias("action"), none.alias("limit"), details.alias("details")),
                      F.struct(F.lit("rate_limit").alias("action"), F.lit("10/s").alias("limit"), F.lit(None).cast(
                          "struct<ip:string,rule_name:string,duration_sec:int>").alias("details")))
    records = views.table(spark, folder, "supplier").select(F.struct(F.lit("generic").alias("playbook"), actions.alias("actions_taken")).alias("r"))
    with scratch_folder(spark) as place:
        stores.write_document({"history": records.select(F.to_json("r").alias("text"))}, place)
        return cut_lineage(stores.read_history(spark, place).select("ip", "rule_name", "duration_sec", "action", "step"))


@query("audit_round_trip", "audit", f"SELECT id, {STAMP} AS timestamp, event_type, status, json_extract_string(details, '$.k') AS k FROM audit")
def audit_round_trip(spark, folder):
    rows = views.audit(spark, folder)
    with scratch_folder(spark) as place:
        stores.append_audit(rows.where("status = 'success'"), f"{place}/table")
        stores.append_audit(rows.where("status <> 'success'"), f"{place}/table")
        columns = ["id", "timestamp", "event_type", "username", "ip_address", "action", "status", "details"]
        stores.append_csv(stores.read_audit(spark, f"{place}/table").select(
            *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "timestamp" else c for c in columns]), f"{place}/csv")
        back = stores.audit_details(stores.read_audit(spark, f"{place}/csv", "csv"), ["k"])
        return cut_lineage(back.select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "event_type", "status", "k"))


@query("alert_build", "scored", """
    SELECT l_orderkey, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (m % 86400), '%Y%m%d%H%M%S') AS stamp,
           ['BENIGN', 'DDoS', 'PortScan'][pred + 1] AS attack_type, greatest(p0, p1, p2) AS confidence, '192.168.1.1' AS src_ip, 1.5::DOUBLE AS prediction_time_ms FROM scored""")
def alert_build(spark, folder):
    given = views.scored(spark, folder).withColumns({
        "probabilities": F.array("p0", "p1", "p2"), "at": F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(secs=(F.col("m") % 86400).cast("decimal(18,6)"))})
    table = training.prediction_table(given, "given", ["BENIGN", "DDoS", "PortScan"], [*views.FLOW_KEY, "at"], 1.5)
    built = alert_ops.build_alerts(table.withColumn("_src_ip", F.lit("192.168.1.1")), F.col("at"), views.FLOW_KEY)
    ids = table.select("l_orderkey", F.concat(F.lit("ALT-"), F.date_format("at", "yyyyMMddHHmmss"), F.lit("-"), F.lower(F.hex(F.xxhash64("at", *views.FLOW_KEY)))).alias("id"))
    return built.join(ids.distinct(), "id").select("l_orderkey", F.substring("id", 5, 14).alias("stamp"), "attack_type", "confidence", "src_ip", "prediction_time_ms")


def _broken(batch):
    raise RuntimeError("target is down")


@query("fan_out_status", "alerts", """
    SELECT id AS alert_id, 'search' AS target, true AS success FROM alerts UNION ALL SELECT id, 'collector', false FROM alerts""")
def fan_out_status(spark, folder):
    alerts = views.alerts(spark, folder).select("id", "timestamp", "attack_type")
    with scratch_folder(spark) as place:
        return stores.fan_out(alerts, {"search": lambda batch: batch.write.parquet(place), "collector": _broken}).drop("timestamp")


@query("stream_fan_out", "alerts", "SELECT id AS alert_id, attack_type, false AS overall_success, 2 AS targets FROM alerts")
def stream_fan_out(spark, folder):
    alerts = views.alert_columns(event_stream(spark, folder)).select("id", "timestamp", "attack_type")
    with scratch_folder(spark) as place:
        targets = {"search": lambda batch: batch.write.mode("append").parquet(f"{place}/search"), "collector": _broken}
        feed.dispatch(alerts, targets, f"{place}/log", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
        log = respond.delivery_log(spark.read.parquet(f"{place}/log").drop("batch"))
        written = spark.read.parquet(f"{place}/search")
        return cut_lineage(log.join(written.select(F.col("id").alias("alert_id"), "attack_type"), "alert_id").select(
            "alert_id", "attack_type", "overall_success", F.size("dispatches").alias("targets")))


@query("column_types", "flows", """
    SELECT * FROM (VALUES ('bigint', 3::BIGINT), ('double', 6::BIGINT), ('string', 3::BIGINT), ('int', 1::BIGINT)) v(type, columns)
    WHERE (SELECT count(*) FROM flows) > 0""")
def column_types(spark, folder):
    return profiling.type_counts(views.flows(spark, folder))
