"""Flows from packets: hand-made cases, a sequential reading of the rules, and stream against batch."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowguard.functions.constants import FLOW_FEATURES
from flowguard.operators import flows
from flowguard.streaming import feed
from flowguard.streaming import flows as stream

SCHEMA = "seq bigint, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, length int, flags string, window int, header_len int"
START = datetime.fromtimestamp(1_700_000_000, timezone.utc)


def packet(seq, second, src="A", dst="B", length=100, protocol="TCP", flags="A", window=512, header=20):
    ports = {"A": 1000, "B": 80, "C": 2000}
    return (seq, START + timedelta(seconds=second), src, ports[src], dst, ports[dst], protocol, length, flags, window, header)


def starts(spark, rows, idle=2.0, active=None, slice_seconds=3):
    df = flows.idle_sessions(flows.network_packets(spark.createDataFrame(rows, SCHEMA)), idle, slice_seconds)
    if active:
        df = flows.active_flows(df, active, idle)
    return {r["seq"]: r["s"] for r in df.select("seq", F.col("start.seq").alias("s")).collect()}


def sequential(rows, idle, active):
    """The rules read one packet at a time."""
    result, open_flows = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (r[6], *sorted([(r[2], r[3]), (r[4], r[5])]))
        flow = open_flows.get(key)
        if flow and (r[1] - flow["last"]).total_seconds() > idle:
            flow = None
        if flow is None:
            flow = {"start": r[1], "seq": r[0]}
        flow["last"] = r[1]
        result[r[0]] = flow["seq"]
        open_flows[key] = None if active and (r[1] - flow["start"]).total_seconds() > active else flow
    return result


def test_one_packet(spark):
    row = spark.createDataFrame([(1, START + timedelta(seconds=0.1), "192.168.1.50", 54321, "10.0.0.1", 80, "UDP", 500, None, None, None)], SCHEMA)
    flow = flows.flow_features(row).first()
    assert flow["Destination Port"] == 80.0 and flow["Total Length of Fwd Packets"] == 500.0
    assert flow["Fwd Header Length"] == 20.0 and flow["act_data_pkt_fwd"] == 1.0 and flow["min_seg_size_forward"] == 20.0
    assert flow["Init_Win_bytes_forward"] == 0.0 and flow["Flow IAT Std"] == 0.0 and flow["Flow Bytes/s"] == 500_000.0
    assert flow["Active Mean"] == flow["Idle Std"] == 0.0


def test_two_flows_by_idle_gap(spark):
    rows = [packet(1, 0), packet(2, 1.0), packet(3, 1.5, "B", "A"), packet(4, 4.2)]
    table = flows.flow_features(spark.createDataFrame(rows, SCHEMA)).orderBy("_start_time").collect()
    assert [f["_packets"] for f in table] == [3, 1]
    assert table[0]["Bwd Packets/s"] == pytest.approx(1 / 1.5) and table[0]["Total Length of Fwd Packets"] == 200.0
    assert table[0]["Fwd IAT Min"] == 1.0 and table[0]["Flow IAT Std"] == pytest.approx(0.25)


def test_gap_of_exactly_the_timeout_stays(spark):
    assert set(starts(spark, [packet(1, 0), packet(2, 2.0), packet(3, 4.000001)]).values()) == {1, 3}


def test_active_timeout_counts_the_closing_packet(spark):
    rows = [packet(i, i) for i in range(13)]
    assert starts(spark, rows, active=10.0) == {i: 0 if i <= 11 else 12 for i in range(13)}


@pytest.mark.parametrize("seed", range(3))
def test_active_split_equals_sequential_reading(spark, seed):
    rng = random.Random(seed)
    second, rows = 0.0, []
    for i in range(400):
        second += rng.choice([0.0, 0.1, 0.7, 1.3, 1.9, 2.0] * 6 + [2.5])
        src, dst = rng.choice([("A", "B"), ("B", "A"), ("A", "B"), ("A", "C")])
        rows.append(packet(i, round(second, 3), src, dst))
    rng.shuffle(rows)
    assert starts(spark, rows, active=10.0) == sequential(rows, 2.0, 10.0)


def test_not_network_packets_are_dropped(spark):
    rows = [packet(1, 0, protocol="ARP"), packet(2, 0, protocol="ICMP"), packet(3, 0, protocol="IP")]
    kept = flows.network_packets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["seq"], r["src_port"], r["window"], r["header_len"]) for r in kept) == [(2, 0, 0, 20), (3, 0, 0, 20)]


def test_first_window_per_direction(spark):
    rows = [packet(1, 0, window=111), packet(2, 0.5, "B", "A", window=222), packet(3, 1, window=333)]
    flow = flows.flow_features(spark.createDataFrame(rows, SCHEMA)).first()
    assert (flow["Init_Win_bytes_forward"], flow["Init_Win_bytes_backward"]) == (111.0, 222.0)


def _table(df):
    stamps = {c: F.date_format(c, "HH:mm:ss.SSSSSS").alias(c) for c in ("_start_time", "_last_seen")}
    columns = [F.round(f"`{c}`", 6) for c in FLOW_FEATURES] + ["_src_ip", "_dst_ip", "_src_port", "_protocol", "_packets", *stamps.values()]
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_stream_equals_batch_over_files(spark, tmp_path):
    rng = random.Random(11)
    second, rows = 0.0, []
    for i in range(300):
        second += rng.choice([0.1, 0.4, 1.1, 1.9, 3.0])
        src, dst = rng.choice([("A", "B"), ("B", "A"), ("A", "C")])
        rows.append(packet(i, round(second, 3), src, dst, 60 + i, rng.choice(["TCP", "TCP", "UDP"]), rng.choice(["A", "FA", "PA"]), i))
    for part in range(5):
        spark.createDataFrame(rows[part * 60:(part + 1) * 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    packets = feed.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    closed, state = stream.run_to_table(stream.closed_flows(packets))
    open_now = stream.open_flows(spark, state)
    assert closed.count() > 10 and open_now.count() >= 1
    batch = flows.flow_features(spark.createDataFrame(rows, SCHEMA), slice_seconds=5)
    assert _table(stream.state_features(closed.unionByName(open_now))) == _table(batch)


def test_timer_closes_a_silent_flow(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([packet(1, 0)], [packet(2, 60, "A", "C")], [packet(3, 120, "A", "C")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    closed, _ = stream.run_to_table(stream.closed_flows(feed.read_stream(spark, path, spark.createDataFrame([], SCHEMA).schema)))
    assert ("B", 1) in {(r["answerer_ip"], r["fwd_packets"]) for r in closed.collect()}


def test_limiter_counts_only_admitted(spark, tmp_path):
    rng, rows = random.Random(2), []
    for i in range(200):
        rows.append(("a" if rng.random() < 0.8 else "b", i, rng.randrange(600) * 1_000_000))
    rows.sort(key=lambda r: (r[2], r[1]))
    spark.createDataFrame(rows, "client string, seq bigint, at bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = feed.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "client string, seq bigint, at bigint").schema)
    table, _ = stream.run_to_table(feed.admitted_requests(events, limit=5, seconds=60))
    found = {r["seq"]: r["admitted"] for r in table.collect()}
    times = {"a": [], "b": []}
    for client, seq, at in rows:
        times[client] = [t for t in times[client] if at - t < 60_000_000]
        assert found[seq] == (len(times[client]) < 5)
        if len(times[client]) < 5:
            times[client].append(at)


def test_a_busy_conversation_ends_soon(spark):
    """200,000 packets of one conversation inside one slice; the active timeout splits them."""
    n = F.col("id")
    rows = spark.range(200_000).select(
        n.alias("seq"), F.timestamp_micros(n * 500).alias("ts"), F.lit("A").alias("src_ip"), F.lit(1).alias("src_port"), F.lit("B").alias("dst_ip"),
        F.lit(80).alias("dst_port"), F.lit("TCP").alias("protocol"), F.lit(60).alias("length"), F.lit("A").alias("flags"), F.lit(9).alias("window"), F.lit(20).alias("header_len"))
    table = flows.flow_features(rows, 2.0, 60.0).orderBy("_start_time").collect()
    assert [f["_packets"] for f in table] == [120_002, 79_998]


def _busy(spark, n):
    """Nine of ten packets belong to one conversation, one every 500 microseconds; the rest to 200 others."""
    i = F.col("id")
    other = i % 10 == 9
    return spark.range(n).select(
        i.alias("seq"), F.timestamp_micros(i * 500).alias("ts"), F.when(other, F.concat(F.lit("C"), (i / 10 % 200).cast("int").cast("string"))).otherwise(
            F.when(i % 3 == 1, "B").otherwise("A")).alias("src_ip"), F.when(~other & (i % 3 == 1), 80).otherwise(1000).alias("src_port"),
        F.when(~other & (i % 3 == 1), "A").otherwise("B").alias("dst_ip"), F.when(~other & (i % 3 == 1), 1000).otherwise(80).alias("dst_port"), F.lit("TCP").alias("protocol"),
        (60 + i % 100).cast("int").alias("length"), F.when(i % 50 == 0, "FA").otherwise("PA").alias("flags"), (i % 1000).cast("int").alias("window"),
        (20 + i % 3 * 4).cast("int").alias("header_len"))


def test_a_busy_conversation_is_spread_over_tasks(spark, tmp_path):
    """2,000,000 packets in one micro-batch: no task of the first step and no state of the second reads a tenth of them."""
    packets = _busy(spark, 2_000_000)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        dealt = stream._keyed(packets, 1.0).repartition(64, *stream.KEY, "slice")
        read = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(read) == 2_000_000 and max(read) < 200_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    packets.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = feed.read_stream(spark, str(tmp_path / "in"), packets.schema)
    closed, state = stream.run_to_table(stream.closed_flows(source, 2.0, 60.0))
    flows_ = closed.unionByName(stream.open_flows(spark, state))
    busy = sorted(r["n"] for r in flows_.where("'A' IN (opener_ip, answerer_ip)").select((F.col("fwd_packets") + F.col("bwd_packets")).alias("n")).collect())
    # Every flow of the busy conversation ends with the first packet later than a minute.
    assert sum(busy) == 1_800_000 and len(busy) == 17 and set(busy[1:]) <= {108_001, 108_002}
    progress = flows_.agg(F.sum("fwd_bytes"), F.sum("bwd_bytes")).first()
    assert progress[0] + progress[1] == packets.agg(F.sum("length")).first()[0]


def test_runs_are_few_and_carry_packets_only_for_a_timeout(spark):
    packets = _busy(spark, 100_000)
    for active in (None, 60.0):
        cut = stream.cut_into_runs(2_000_000, active is not None)
        kinds = "protocol string, low_ip string, low_port int, high_ip string, high_port int, ts timestamp, " + ", ".join(f"{n} {t}" for n, t in stream.RUN) + ", body binary"
        runs = stream._keyed(packets, 1.0).repartition(*stream.KEY, "slice").mapInArrow(cut, kinds)
        hot = runs.where("low_ip = 'A'").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"), F.sum(F.expr("packets_0 + packets_1")).alias("packets")).first()
        assert hot["n"] == 50 and hot["packets"] == 90_000
        assert hot["bytes"] == (None if active is None else 21 * 90_000)
