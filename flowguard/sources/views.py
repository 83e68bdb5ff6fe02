"""Projections that give the TPC-H-like test tables the shape of flows, alerts, packets and indicators.

Each view is a pure projection of a whole table; `flowguard.plans.oracle` holds the same rules as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions.risk import risk_level, risk_score
from flowguard.operators.distributed import mix

FLOW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price", "l_shipdate"]
FLOW_NUMBERS = ["quantity", "price", "discount", "tax", "linenumber", "supp"]
DIRTY_NUMBERS = ["quantity", "price", "discount", "tax", "one", "quantity_copy", "price_linear"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flow_mix():
    """Repeatable order of flows for sampling and splitting."""
    return mix(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("bigint"))


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per flow: key, six numeric features, one text feature, a label."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_linenumber").cast("double").alias("linenumber"),
        F.col("l_suppkey").cast("double").alias("supp"),
        F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("label"),
    )


def dirty_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Flows with planted nulls, infinities, text junk, padded labels, copies of rows and of columns."""
    base = flows(spark, folder).withColumn("m", flow_mix())
    m = F.col("m")
    return base.select(
        "l_orderkey", "l_partkey",
        F.when(m % 17 == 0, F.lit(None)).otherwise(F.col("quantity")).alias("quantity"),
        F.when(m % 101 == 0, F.lit(float("inf"))).when(m % 103 == 0, F.lit(float("-inf"))).otherwise(F.col("price")).alias("price"),
        F.when(m % 29 == 0, F.lit("n/a")).when(m % 31 == 0, F.lit(None))
        .otherwise(F.concat(F.lit(" "), F.col("linenumber").cast("int").cast("string"), F.lit(" "))).alias("linetext"),
        "discount",
        F.when(m % 13 == 0, F.lit(float("nan"))).otherwise(F.col("tax")).alias("tax"),
        F.lit(1.0).alias("one"),
        F.col("quantity").alias("quantity_full"),
        F.col("quantity").alias("quantity_copy"),
        (F.col("price") * 2.0 + 1.0).alias("price_linear"),
        F.lit(None).cast("double").alias("empty"),
        F.concat(F.lit(" "), F.col("label"), F.lit(" ")).alias(" Label "),
        F.explode(F.when(m % 19 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve-column alerts without the probability text, from the event log."""
    return alert_columns(table(spark, folder, "events"))


def alert_columns(events: DataFrame) -> DataFrame:
    """The alert projection, also used on a stream of the event log."""
    user, event = F.col("user_id"), F.col("event_id")
    host = F.pmod(user, F.lit(250)).cast("string")
    attack = (
        F.when(F.col("event_type") == "view", "BENIGN").when(F.col("event_type") == "click", "PortScan")
        .when(F.col("event_type") == "error", "DoS Hulk").when(F.col("event_type") == "purchase", "Bot")
        .otherwise("SSH-Patator")
    )
    network = (
        F.when(user % 5 == 0, "185.220.101.").when(user % 5 == 1, "10.0.0.").when(user % 5 == 2, "192.168.1.")
        .when(user % 5 == 3, "172.20.0.").otherwise("203.0.113.")
    )
    base = events.select(
        "event_id",
        F.concat(F.lit("ALT-"), event.cast("string")).alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        attack.alias("attack_type"),
        (F.lit(1.0) - (event % 500) / F.lit(1000.0)).alias("confidence"),
        F.concat(network, host).alias("src_ip"),
        F.concat(F.lit("10.0.1."), (event % 50).cast("string")).alias("dst_ip"),
        F.when(event % 3 == 0, "TCP").when(event % 3 == 1, "UDP").otherwise("ICMP").alias("protocol"),
        F.get_json_object("props", "$.k").cast("int").alias("dst_port"),
        (F.col("value") / 100.0).alias("prediction_time_ms"),
    )
    scored = base.withColumn("risk_score", risk_score(F.col("attack_type"), F.col("confidence")))
    return scored.withColumn("risk_level", risk_level(F.col("risk_score")))


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of conversations between a user host and one of four servers; direction alternates."""
    return packet_columns(table(spark, folder, "events"))


def packet_columns(events: DataFrame) -> DataFrame:
    """The packet projection, also used on a stream of the event log."""
    user, event = F.col("user_id"), F.col("event_id")
    client = F.concat(F.lit("192.168.1."), F.pmod(user, F.lit(250)).cast("string"))
    server = F.concat(F.lit("10.0.0."), F.pmod(user, F.lit(4)).cast("string"))
    outward = event % 3 != 0
    protocol = F.when(user % 7 == 6, "ARP").when(user % 7 == 5, "ICMP").when(user % 7 == 4, "UDP").otherwise("TCP")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(outward, client).otherwise(server).alias("src_ip"),
        F.when(outward, F.lit(40000) + F.pmod(user, F.lit(1000)).cast("int")).otherwise(F.lit(443)).alias("src_port"),
        F.when(outward, server).otherwise(client).alias("dst_ip"),
        F.when(outward, F.lit(443)).otherwise(F.lit(40000) + F.pmod(user, F.lit(1000)).cast("int")).alias("dst_port"),
        protocol.alias("protocol"),
        (F.lit(40) + k).alias("length"),
        F.when(F.col("event_type") == "error", "FA").when(F.col("event_type") == "click", "PA").otherwise("A").alias("flags"),
        (F.lit(1000) + k).alias("window"),
        F.when(event % 2 == 0, 20).otherwise(32).alias("header_len"),
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """True class, predicted class and three probabilities per flow by a fixed rule."""
    m = flow_mix()
    base = flows(spark, folder).select(
        *FLOW_KEY, "quantity", "discount", "label",
        F.when(F.col("label") == "A", 0).when(F.col("label") == "N", 1).otherwise(2).alias("y"), m.alias("m"))
    guess = F.when(F.col("m") % 10 < 7, F.col("y")).otherwise((F.col("y") + 1 + F.col("m") % 2) % 3).cast("int")
    top = F.lit(0.5) + (F.col("m") % 400) / F.lit(1000.0)
    rest = F.lit(1.0) - top
    share = (F.col("m") % 7 + 1) / F.lit(8.0)

    def probability(k: int):
        after = (F.col("pred") + 1) % 3
        return F.when(F.col("pred") == k, top).when(after == k, rest * share).otherwise(rest * (F.lit(1.0) - share))
    return base.withColumn("pred", guess).select("*", *[F.round(probability(k), 6).alias(f"p{k}") for k in range(3)])


def ioc(spark: SparkSession, folder: str) -> DataFrame:
    """Indicator rows from suppliers: an address may sit on several lists."""
    key = F.col("s_suppkey")
    network = F.when(key % 3 == 0, "185.220.101.").when(key % 3 == 1, "203.0.113.").otherwise("10.0.0.")
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, folder, "supplier").join(F.broadcast(nation), "s_nationkey").select(
        F.concat(network, F.pmod(key, F.lit(250)).cast("string")).alias("ip"),
        F.when(key % 4 == 0, "whitelist").when(key % 4 == 1, "blacklist").otherwise("malicious_ip").alias("list_type"),
        F.when(key % 4 >= 2, F.when(key % 8 != 2, F.col("n_name"))).alias("category"),
        F.when(key % 4 >= 2, F.when(key % 8 != 3, (key % 100).cast("int"))).alias("threat_score"),
        F.lit("2026-01-01").alias("first_seen"),
        key.alias("seq"),
    )


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """Audit rows from the event log; the JSON properties serve as details."""
    event, user = F.col("event_id"), F.col("user_id")
    return table(spark, folder, "events").select(
        F.concat(F.lit("AUD-"), event.cast("string")).alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.upper("event_type").alias("event_type"),
        F.concat(F.lit("user"), (user % 20).cast("string")).alias("username"),
        F.concat(F.lit("10.1.0."), (user % 250).cast("string")).alias("ip_address"),
        F.lit("execute").alias("action"),
        F.when(event % 10 == 0, "denied").when(event % 10 < 3, "failure").otherwise("success").alias("status"),
        F.col("props").alias("details"),
    )
