"""Response decisions as tables: playbooks, mitigation records, block lists, delivery logs (RSP-*, SNK-12 to SNK-14).

Nothing here runs a command; the rows say what should be done.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.functions.text import block_rule_name

# Playbook names of the three families, block seconds and reasons.
DOS_PLAYBOOKS = ["dos_mitigation", "ddos_containment"]
SCAN_PLAYBOOKS = ["port_scan_containment", "recon_containment"]
BOT_PLAYBOOKS = ["botnet_isolation", "brute_force_isolation"]
DOS_SECONDS, SCAN_SECONDS, BOT_SECONDS, DEFAULT_SECONDS = 7200, 1800, 86400, 3600
SCAN_REASON = "PortScan Containment Playbook"
BOT_REASON = "Botnet C2 Isolation Playbook"
RATE_LIMIT = "10 req/s"
GENERIC_RISK = 70
BLOCKING = ["firewall_block", "temporary_quarantine", "emergency_isolation", "auto_block"]


def playbook_for(attack: Column) -> Column:
    """The playbook that fits an attack name; anything else is handled by its risk."""
    name = F.lower(attack)
    return (
        F.when(name.startswith("ddos"), "ddos_containment").when(name.startswith("dos"), "dos_mitigation")
        .when(name.contains("portscan"), "port_scan_containment").when(name.contains("recon"), "recon_containment")
        .when(name.startswith("bot"), "botnet_isolation")
        .when(name.contains("patator") | name.contains("brute force"), "brute_force_isolation")
        .otherwise("generic"))


def _action(name: str, ip: Column, reason: Column | None = None, seconds: int | None = None, port: Column | None = None, limit: str | None = None) -> Column:
    blocks = seconds is not None
    return F.struct(
        F.lit(name).alias("action"), ip.alias("ip"),
        (block_rule_name(ip) if blocks else F.lit(None).cast("string")).alias("rule_name"),
        (reason if reason is not None else F.lit(None).cast("string")).alias("reason"),
        F.lit(seconds).cast("int").alias("duration_sec"),
        (port.cast("int") if port is not None else F.lit(None).cast("int")).alias("target_port"),
        F.lit(limit).cast("string").alias("rate_limit"))


def decide(alerts: DataFrame, playbook: Column | None = None) -> DataFrame:
    """RSP-01 and RSP-02: one mitigation record per alert with its list of actions."""
    book = playbook if playbook is not None else playbook_for(F.col("attack_type"))
    ip = F.col("src_ip")
    chosen = alerts.withColumn("playbook", book)
    name = F.col("playbook")
    generic_reason = F.concat(F.lit("High-Risk Alert ("), F.col("risk_score").cast("string"), F.lit("/100)"))
    generic = F.array(_action("auto_block", ip, generic_reason, DEFAULT_SECONDS))
    actions = (
        F.when(name.isin(DOS_PLAYBOOKS), F.array(
            _action("firewall_block", ip, F.concat(F.lit("Auto-Triggered: "), name), DOS_SECONDS),
            _action("rate_limit", ip, port=F.col("dst_port"), limit=RATE_LIMIT)))
        .when(name.isin(SCAN_PLAYBOOKS), F.array(_action("temporary_quarantine", ip, F.lit(SCAN_REASON), SCAN_SECONDS)))
        .when(name.isin(BOT_PLAYBOOKS), F.array(
            _action("emergency_isolation", ip, F.lit(BOT_REASON), BOT_SECONDS), _action("terminate_tcp_session", ip)))
        .when(F.col("risk_score") >= GENERIC_RISK, generic)
        .otherwise(F.filter(generic, lambda a: F.lit(False))))
    return chosen.select(
        F.col("id").alias("alert_id"), "timestamp", "playbook", "attack_type", ip.alias("target_ip"),
        actions.alias("actions_taken"), F.lit("completed").alias("status"))


def action_rows(records: DataFrame) -> DataFrame:
    """SRC-10: one row per action of a nested record."""
    return records.select("alert_id", "timestamp", "playbook", "attack_type", "target_ip", F.posexplode("actions_taken").alias("step", "a")).select(
        "alert_id", "timestamp", "playbook", "attack_type", "target_ip", "step", "a.*")


def active_blocks(records: DataFrame, unblocks: DataFrame | None = None, as_of: datetime | None = None) -> DataFrame:
    """RSP-03: the latest block per address (WIN-06), without those released since (JOIN-10).

    Blocks last until released; with `as_of` they also end after their duration. The latest block is an
    aggregate, so an address with very many alerts is combined before the shuffle.
    """
    blocks = action_rows(records).where(F.col("action").isin(BLOCKING))
    latest = blocks.groupBy("ip").agg(F.max_by(
        F.struct("rule_name", "reason", F.col("timestamp").alias("blocked_at"), "duration_sec", "alert_id"), F.struct("timestamp", "alert_id")).alias("b")).select("ip", "b.*")
    if unblocks is not None:
        released = unblocks.groupBy("ip").agg(F.max("timestamp").alias("_released"))
        latest = latest.join(released, "ip", "left").where("_released IS NULL OR _released < blocked_at").drop("_released")
    if as_of is not None:
        ends = F.col("blocked_at") + F.make_dt_interval(secs=F.col("duration_sec"))
        latest = latest.where(ends > F.lit(as_of))
    return latest


def mitigation_summary(records: DataFrame, blocks: DataFrame, recent: int = 10) -> DataFrame:
    """AGG-13 as one row; the list is limited before it is collected."""
    last = newest_records(records, recent).agg(F.sort_array(F.collect_list(F.struct("timestamp", "alert_id", "playbook")), False).alias("recent_actions"))
    parts = [records.agg(F.count("*").alias("total_playbooks_executed")), blocks.agg(F.count("*").alias("active_blocks_count")), last]
    keyed = [p.withColumn("_k", F.lit(1)) for p in parts]
    return keyed[0].join(keyed[1], "_k").join(keyed[2], "_k").drop("_k")


def newest_records(records: DataFrame, keep: int = 500, column: str = "timestamp", tie: str = "alert_id") -> DataFrame:
    """SNK-12: the history keeps its last 500 records."""
    return records.orderBy(F.col(column).desc(), F.col(tie).desc()).limit(keep)


def delivery_log(status: DataFrame) -> DataFrame:
    """SNK-14: per alert, whether every target succeeded and how each did.

    `status` holds (alert_id, timestamp, target, success); an alert has one row per configured target.
    """
    return status.groupBy("alert_id").agg(
        F.max("timestamp").alias("timestamp"), F.bool_and("success").alias("overall_success"),
        F.sort_array(F.collect_set(F.struct("target", "success"))).alias("dispatches"))
