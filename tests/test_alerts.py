"""Risk, alert stores, indicators, playbooks, lines, audit: values worked out by hand."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowguard.functions import risk, text
from flowguard.functions.net import is_internal
from flowguard.operators import alerts, analytics, enrich, respond
from flowguard.sources import stores


@pytest.mark.parametrize("attack,confidence,score,level", [
    ("PortScan", 0.5, 37.5, "Medium"), ("PortScan", 1.0, 50.0, "High"), ("DoS Slowloris", 1.0, 75.0, "Critical"),
    ("Something new", 1.0, 75.0, "Critical"), ("BENIGN", 0.0, 20.0, "Low"), ("BENIGN", 1.0, 0.0, "Low"),
    ("BENIGN", 0.98160, 0.37, "Low"), ("BENIGN", 0.99745, 0.05, "Low"), ("Heartbleed", 1.0, 100.0, "Critical"), ("BENIGN", -9.0, 100.0, "Critical")])
def test_risk(spark, attack, confidence, score, level):
    row = spark.createDataFrame([(attack, confidence)], "a string, c double").select(risk.risk_score(F.col("a"), F.col("c")).alias("s")).select(
        "s", risk.risk_level(F.col("s")).alias("l")).first()
    assert (row["s"], row["l"]) == (score, level)


def test_names_confidence_and_maps(spark):
    df = spark.createDataFrame([(4, [0.1, 0.7, 0.2]), (99, None)], "i int, p array<double>")
    rows = df.select(risk.attack_name(F.col("i")).alias("n"), risk.confidence_of(F.col("p")).alias("c"), risk.probability_map(F.col("p"), F.lit("X")).alias("m")).collect()
    assert (rows[0]["n"], rows[0]["c"], rows[0]["m"]) == ("DoS Hulk", 0.7, {"BENIGN": 0.1, "Bot": 0.7, "DDoS": 0.2})
    assert (rows[1]["n"], rows[1]["c"], rows[1]["m"]) == ("99", 1.0, {"X": 1.0})


def test_internal_ranges(spark):
    ips = ["10.1.1.1", "192.168.0.1", "127.0.0.1", "172.16.0.1", "172.20.0.1", "172.31.0.1", "172.32.0.1", "8.8.8.8"]
    rows = spark.createDataFrame([(ip,) for ip in ips], "ip string").select("ip", is_internal(F.col("ip")).alias("a"), is_internal(F.col("ip"), True).alias("b")).collect()
    assert [r["a"] for r in rows] == [True, True, True, True, False, True, False, False]
    assert [r["b"] for r in rows] == [True, True, True, True, True, True, False, False]


ALERT = ("ALT-TEST-0001", datetime(2024, 1, 2, 3, 4, 5), "DoS Hulk", 0.999, 90.0, "Critical", "185.220.101.5", "10.0.0.1", "TCP", 80, 1.5, '{"DoS Hulk":0.999}')
SCHEMA = "id string, timestamp timestamp, attack_type string, confidence double, risk_score double, risk_level string, src_ip string, dst_ip string, protocol string, dst_port int, prediction_time_ms double, class_probabilities string"


def test_alert_store_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "alerts")
    again = ALERT[:2] + ("Bot",) + ALERT[3:]
    assert stores.append_alerts(spark.createDataFrame([ALERT], SCHEMA), path).count() == 1
    stores.append_alerts(spark.createDataFrame([again, ("B",) + ALERT[1:], ("B",) + ALERT[1:]], SCHEMA), path)
    stores.append_alerts(spark.createDataFrame([again], SCHEMA), path, same_day_ids=True)
    table = stores.read_alerts(spark, path)
    assert sorted(r["id"] for r in table.collect()) == ["ALT-TEST-0001", "B"]
    assert alerts.query_alerts(table, src_ip="185.220.101.5", attack_type="DoS Hulk").count() == 2
    plan = table.where(alerts.day_filter("2024-01-02"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(timestamp" in plan


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([ALERT], SCHEMA)
    stores.export_alerts(df, F.lit(False), str(tmp_path / "none"))
    assert "class_probabilities" not in spark.read.option("header", True).csv(str(tmp_path / "none")).columns
    assert len(spark.read.option("header", True).csv(str(tmp_path / "none")).columns) == 11
    stores.export_alerts(df, F.lit(True), str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).first()["id"] == "ALT-TEST-0001"
    stores.append_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["class_probabilities"] == '{"DoS Hulk":0.999}'


def test_empty_totals(spark):
    empty = spark.createDataFrame([], SCHEMA)
    row = analytics.alert_totals(empty).first()
    assert (row["total"], row["attacks"], row["average_confidence"], row["last_time"]) == (0, 0, 0.0, None)
    page = alerts.page_totals(empty, F.lit(True), 1, 20).first()
    assert (page["total"], page["total_pages"]) == (0, 1)


def test_preset_wins_over_dates(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 20, 30)], "timestamp timestamp")
    condition = alerts.time_filter(datetime(2024, 1, 31), "7d", datetime(2024, 1, 1), datetime(2024, 1, 2))
    assert [r[0].day for r in df.where(condition).collect()] == [30]
    assert df.where(alerts.time_filter(datetime(2024, 1, 31), "all", datetime(2024, 1, 1), None)).count() == 3


def test_alert_ids_differ_and_repeat(spark):
    at = F.lit(datetime(2024, 1, 1))
    df = spark.range(1000).withColumn("Attack_Type", F.lit("Bot"))
    once = alerts.build_alerts(df, at, ["id"])
    assert once.columns == alerts.ALERT_COLUMNS
    assert once.select("id").distinct().count() == 1000
    assert sorted(once.collect()) == sorted(alerts.build_alerts(df, at, ["id"]).collect())


def test_default_indicators(spark, tmp_path):
    for listed in (stores.read_indicators(spark, None), stores.read_indicators(spark, str(tmp_path / "absent.json"))):
        assert listed.count() == 9
    df = spark.createDataFrame([("185.220.101.5", 10.0, "Low"), ("127.0.0.1", 90.0, "Critical"), ("9.9.9.9", 40.0, "Medium")], "src_ip string, risk_score double, risk_level string")
    rows = {r["src_ip"]: r for r in enrich.enrich_alerts(df, listed).collect()}
    assert (rows["185.220.101.5"]["ioc_type"], rows["185.220.101.5"]["ioc_score"], rows["185.220.101.5"]["risk_level"]) == ("blacklist", 100, "Critical")
    assert (rows["127.0.0.1"]["ioc_type"], rows["127.0.0.1"]["risk_score"], rows["127.0.0.1"]["reputation_tags"]) == ("whitelist", 0.0, ["Internal IP / Private Subnet"])
    assert (rows["9.9.9.9"]["ioc_type"], rows["9.9.9.9"]["ioc_action"], rows["9.9.9.9"]["risk_score"]) == ("none", "inspect", 40.0)
    assert rows["185.220.101.5"]["threat_score"] == 85 and rows["185.220.101.5"]["provider_results"]["AbuseIPDB"]["total_reports"] == 12


def test_indicator_file(spark, tmp_path):
    path = tmp_path / "ioc.json"
    path.write_text(json.dumps({"whitelist": ["1.1.1.1"], "blacklist": ["2.2.2.2"], "known_iocs": {},
                                "known_malicious_ips": {"3.3.3.3": {"category": "C2", "threat_score": 7, "first_seen": "2026-01-01"}, "4.4.4.4": {}}}, indent=1))
    listed = stores.read_indicators(spark, str(path))
    lookup = {r["ip"]: r for r in enrich.indicator_lookup(listed).collect()}
    assert lookup["3.3.3.3"]["ioc_category"] == "C2" and lookup["4.4.4.4"]["ioc_category"] == "Threat Feed" and lookup["4.4.4.4"]["ioc_score"] == 80


def test_edits(spark):
    base = stores.default_indicators(spark)
    edits = spark.createDataFrame([("127.0.0.1", "blacklist", "Manual Block", "2026-07-26", 1), ("9.9.9.9", "blacklist", "X", "2026-07-26", 2), ("9.9.9.9", "whitelist", None, None, 3)],
                                  "ip string, list_type string, category string, first_seen string, seq bigint")
    after = enrich.apply_edits(base, edits)
    assert {(r["list_type"], r["threat_score"]) for r in after.where("ip = '127.0.0.1'").collect()} == {("blacklist", None), ("malicious_ip", 100)}
    assert {(r["list_type"], r["threat_score"]) for r in after.where("ip = '9.9.9.9'").collect()} == {("whitelist", None), ("malicious_ip", 100)}


def test_history_file(spark, tmp_path):
    path = tmp_path / "history.json"
    path.write_text(json.dumps({"history": [{"timestamp": "2026-01-01 00:00:00", "playbook": "dos_mitigation", "attack_type": "DDoS", "target_ip": "1.2.3.4", "status": "completed", "actions_taken": [
        {"action": "firewall_block", "details": {"ip": "1.2.3.4", "rule_name": "R", "reason": "x", "blocked_at": "t", "duration_sec": 7200, "status": "simulated"}},
        {"action": "rate_limit", "target_port": 80, "limit": "10 req/s"}]}]}, indent=2))
    rows = stores.read_history(spark, str(path)).orderBy("step").collect()
    assert (rows[0]["duration_sec"], rows[0]["rule_name"], rows[1]["target_port"], rows[1]["limit"]) == (7200, "R", 80, "10 req/s")


@pytest.mark.parametrize("score,actions", [(69.9, 0), (70.0, 1)])
def test_generic_playbook(spark, score, actions):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1), "Heartbleed", "1.2.3.4", score, 80)], "id string, timestamp timestamp, attack_type string, src_ip string, risk_score double, dst_port int")
    row = respond.decide(df).first()
    assert len(row["actions_taken"]) == actions
    if actions:
        assert row["actions_taken"][0]["duration_sec"] == 3600 and row["actions_taken"][0]["reason"] == "High-Risk Alert (70.0/100)"
        assert row["actions_taken"][0]["rule_name"] == "FLOWGUARD_BLOCK_1_2_3_4"


def test_lines(spark):
    row = spark.createDataFrame([ALERT], SCHEMA).select(text.cef_line("V", "P").alias("c"), text.leef_line("V", "P").alias("l"), text.rfc5424_line("h", "app", "7", "e").alias("r")).first()
    assert row["c"] == "CEF:0|V|P|1.0.0|ALERT-DoS Hulk|DoS Hulk Intrusion Detected|10|src=185.220.101.5 dst=10.0.0.1 dport=80 proto=TCP cn1=90.0 cn1Label=RiskScore msg=Confidence: 0.999"
    assert row["l"].split("\t")[-2:] == ["sev=10", "riskScore=90.0"]
    assert row["r"] == '<134>1 2024-01-02 03:04:05 h app 7 ALT-TEST-0001 [e attack="DoS Hulk" risk="90.0"] Threat Alert: DoS Hulk from 185.220.101.5 targeting 10.0.0.1:80'


def test_session_level_words(spark):
    df = spark.createDataFrame([("benign", "SEVERE", 2, 1.0, 0.5), ("DDoS", "critical", 3, 2.0, 1.0)], "attack_type string, risk_level string, count bigint, latency_ms double, confidence double")
    row = analytics.session_counters(df).first()
    assert (row["low_alerts"], row["critical_alerts"], row["benign_count"], row["average_latency_ms"], row["average_confidence"]) == (2, 3, 2, 1.6, 0.8)


def test_audit(spark, tmp_path):
    rows = stores.audit_rows(spark, [{"id": "1", "timestamp": datetime(2024, 1, 1), "event_type": "LOGIN", "details": {"k": "v"}},
                                     {"id": "2", "timestamp": datetime(2024, 1, 2), "event_type": "LOGOUT", "status": "denied"}])
    stores.append_audit(rows, str(tmp_path / "a"))
    found = stores.audit_details(stores.read_audit(spark, str(tmp_path / "a")).where(alerts.equal_filters(event_type="LOGIN", username="system")), ["k"]).collect()
    assert [(r["status"], r["k"], r["ip_address"]) for r in found] == [("success", "v", "127.0.0.1")]
    (tmp_path / "a.csv").write_text('id,timestamp,event_type,username,ip_address,action,status,details\nA,2026-01-01 00:00:00,LOGIN,u,1.1.1.1,x,success,"{""k"": 1}"\n')
    assert stores.audit_details(stores.read_audit(spark, str(tmp_path / "a.csv"), "csv"), ["k"]).first()["k"] == "1"


def test_fan_out_records_failures(spark, tmp_path):
    def broken(batch):
        raise OSError("unreachable")
    batch = spark.createDataFrame([ALERT], SCHEMA)
    status = stores.fan_out(batch, {"lines": lambda b: b.select(text.cef_line().alias("value")).write.text(str(tmp_path / "lines")), "bad": broken})
    log = respond.delivery_log(status).first()
    assert log["overall_success"] is False and [(d["target"], d["success"]) for d in log["dispatches"]] == [("bad", False), ("lines", True)]
    assert spark.read.text(str(tmp_path / "lines")).count() == 1


def test_expand_skips_empty_classes(spark):
    rows = alerts.expand_batch(spark.createDataFrame([("BENIGN", 0), ("Bot", 250_001)], "attack_type string, n bigint"), 0.9, 1.0, 0.1)
    assert rows.count() == 250_001 and rows.agg(F.max("record")).first()[0] == 250_001


def test_report_holds_its_parts(spark):
    df = spark.createDataFrame([ALERT], SCHEMA)
    model = spark.createDataFrame([("forest", 20)], "name string, features int")
    row = analytics.report_dataset(df, datetime(2024, 1, 3), analytics.severity_counts(df), model).first()
    assert (row["summary"]["total"], row["session"]["critical"], row["model"]["name"], row["latest"][0]["id"]) == (1, 1, "forest", "ALT-TEST-0001")
