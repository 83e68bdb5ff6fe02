"""The live path: packets to flows to scores to stored, enriched alerts; and the alert tail."""

from datetime import datetime, timedelta

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowguard.functions.constants import FLOW_FEATURES
from flowguard.operators import alerts, enrich, respond
from flowguard.operators.cleaning import align_features
from flowguard.plans import training
from flowguard.sources import stores
from flowguard.streaming import feed
from flowguard.streaming import flows as stream

SCHEMA = "seq bigint, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, length int, flags string, window int, header_len int"
START = datetime(2024, 1, 1)
META = ["_src_ip", "_dst_ip", "_protocol", "_dst_port", "_start_time"]


def _packets(spark, path):
    rows = []
    for flow in range(12):
        for n in range(2 + flow):
            rows.append((len(rows), START + timedelta(seconds=30 * flow + n * 0.5), f"185.0.0.{flow}", 1000 + flow, "10.0.0.1", 80, "TCP", 100, "A", 512, 20))
    for part in range(3):
        spark.createDataFrame(rows[len(rows) * part // 3:len(rows) * (part + 1) // 3], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _model(spark):
    rows = [tuple([float(i)] * 20) + (float(i > 5),) for i in range(12)]
    vectors = VectorAssembler(inputCols=FLOW_FEATURES, outputCol="features")
    df = spark.createDataFrame(rows, FLOW_FEATURES + ["label_index"])
    return PipelineModel([vectors, DecisionTreeClassifier(featuresCol="features", labelCol="label_index").fit(vectors.transform(df))])


def test_packets_become_stored_alerts(spark, tmp_path):
    _packets(spark, str(tmp_path / "in"))
    model, store = _model(spark), str(tmp_path / "alerts")

    def score(batch):
        aligned = align_features(stream.state_features(batch), keep=META, check_empty=False)
        table = training.prediction_table(training.predict(model, aligned), "tree", ["BENIGN", "DDoS"], META)
        return alerts.build_alerts(table, F.col("_start_time"), META)
    closed = stream.closed_flows(feed.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema))
    writer = stream.score_stream(closed, score, lambda batch: stores.append_alerts(batch, store, same_day_ids=True), str(tmp_path / "state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    stored = stores.read_alerts(spark, store)
    assert stored.count() >= 9 and stored.select("id").distinct().count() == stored.count()
    assert {r[0] for r in stored.select("attack_type").distinct().collect()} <= {"BENIGN", "DDoS"}
    tail = feed.alert_tail(spark, store, stored.schema, START + timedelta(seconds=45))
    shown, _ = stream.run_to_table(tail.select("id", "timestamp"))
    assert shown.count() == stored.where(F.col("timestamp") > F.lit(START + timedelta(seconds=45))).count() > 0
    enriched = enrich.enrich_alerts(stored, stores.default_indicators(spark))
    assert enriched.where("is_malicious").count() == stored.count()
    assert respond.decide(enriched).count() == stored.count()


def test_tail_starts_at_the_current_end_and_dispatch_logs_every_target(spark, tmp_path):
    path, schema = str(tmp_path / "alerts"), "id string, timestamp timestamp"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    write([("a", START), ("b", START + timedelta(seconds=9))])
    kind = spark.createDataFrame([], schema).schema
    tail = feed.alert_tail(spark, path, kind)
    write([("c", START + timedelta(seconds=5)), ("d", START + timedelta(seconds=10))])
    assert [r["id"] for r in stream.run_to_table(tail)[0].collect()] == ["d"]

    def broken(batch):
        raise RuntimeError("down")
    targets = {"good": lambda batch: batch.write.mode("append").parquet(str(tmp_path / "good")), "bad": broken}
    writer = feed.dispatch(feed.read_stream(spark, path, kind), targets, str(tmp_path / "log"), str(tmp_path / "state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 8 and log.where("success").count() == 4 and log.select("batch").distinct().count() == 2
    assert spark.read.parquet(str(tmp_path / "good")).count() == 4


def test_arrivals_show_late_and_equal_alerts_and_go_on_after_a_restart(spark, tmp_path):
    path, cursor, schema = str(tmp_path / "alerts"), str(tmp_path / "cursor"), "id string, timestamp timestamp"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    kind = spark.createDataFrame([], schema).schema
    write([("a", START), ("b", START + timedelta(seconds=9))])
    feed.mark_end(spark, path, kind, cursor)
    write([("late", START - timedelta(days=1)), ("same", START + timedelta(seconds=9))])

    def run():
        feed.mark_end(spark, path, kind, cursor)  # starting again does not move the cursor
        tail = feed.arrivals(spark, path, kind, cursor)
        tail.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(
            availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert run() == ["late", "same"]
    write([("old", START - timedelta(days=2)), ("nulled", None)])  # stored between two runs
    assert run() == ["late", "nulled", "old", "same"]
