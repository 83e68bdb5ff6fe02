"""Alert line formats for log collectors (EXP-06 to EXP-09, EXP-14) and rule names (EXP-11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowguard.functions.risk import literal_map

# Severity number per risk level, 1 for anything else.
SEVERITY_NUMBER = {"Low": 1, "Medium": 4, "High": 7, "Critical": 10}
# Fixed value: facility local0, severity informational.
SYSLOG_PRIORITY = 134


def severity_number(level: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(SEVERITY_NUMBER), level), F.lit(1))


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def cef_line(vendor: str = "FlowGuard", product: str = "flow-analytics", version: str = "1.0.0", event_prefix: str = "ALERT-") -> Column:
    """EXP-06 over the alert columns."""
    attack = F.col("attack_type")
    return F.concat(
        F.lit(f"CEF:0|{vendor}|{product}|{version}|{event_prefix}"), attack, F.lit("|"), attack, F.lit(" Intrusion Detected|"),
        severity_number(F.col("risk_level")).cast("string"),
        F.lit("|src="), F.col("src_ip"), F.lit(" dst="), F.col("dst_ip"), F.lit(" dport="), _text("dst_port"),
        F.lit(" proto="), F.col("protocol"), F.lit(" cn1="), _text("risk_score"),
        F.lit(" cn1Label=RiskScore msg=Confidence: "), _text("confidence"),
    )


def leef_line(vendor: str = "FlowGuard", product: str = "flow-analytics", version: str = "1.0.0") -> Column:
    """EXP-07 over the alert columns; fields are separated by tabs."""
    return F.concat(
        F.lit(f"LEEF:1.0|{vendor}|{product}|{version}|"), F.col("attack_type"), F.lit("|"),
        F.concat_ws(
            "\t",
            F.concat(F.lit("devTime="), _timestamp_text()),
            F.concat(F.lit("src="), F.col("src_ip")),
            F.concat(F.lit("dst="), F.col("dst_ip")),
            F.concat(F.lit("dstPort="), _text("dst_port")),
            F.concat(F.lit("proto="), F.col("protocol")),
            F.concat(F.lit("sev="), severity_number(F.col("risk_level")).cast("string")),
            F.concat(F.lit("riskScore="), _text("risk_score")),
        ),
    )


def rfc5424_line(host: str = "flowguard", app: str = "flow-engine", process: str = "-", element: str = "threat@flowguard") -> Column:
    """EXP-08 over the alert columns."""
    return F.concat(
        F.lit(f"<{SYSLOG_PRIORITY}>1 "), _timestamp_text(), F.lit(f" {host} {app} {process} "), F.col("id"),
        F.lit(f" [{element} attack=\""), F.col("attack_type"), F.lit("\" risk=\""), _text("risk_score"),
        F.lit("\"] Threat Alert: "), F.col("attack_type"), F.lit(" from "), F.col("src_ip"),
        F.lit(" targeting "), F.col("dst_ip"), F.lit(":"), _text("dst_port"),
    )


def json_envelope(columns: list[str], host: str = "flowguard", app: str = "flow-engine") -> Column:
    """EXP-09, the default format."""
    header = F.concat(F.lit(f"<{SYSLOG_PRIORITY}>1 "), _timestamp_text(), F.lit(f" {host} {app}"))
    return F.to_json(F.struct(header.alias("syslog_header"), F.struct(*columns).alias("alert")))


def collector_event(columns: list[str], sourcetype: str = "flowguard:alert", source: str = "flowguard") -> Column:
    """EXP-14: the envelope of an event collector."""
    return F.to_json(F.struct(F.struct(*columns).alias("event"), F.lit(sourcetype).alias("sourcetype"), F.lit(source).alias("source")))


def document_path(index: str = "flowguard-alerts") -> Column:
    """EXP-14: the document address of an alert in a search index."""
    return F.concat(F.lit(f"{index}/_doc/"), F.col("id"))


def block_rule_name(ip: Column, prefix: str = "FLOWGUARD_BLOCK_") -> Column:
    """EXP-11."""
    return F.concat(F.lit(prefix), F.translate(ip, ".", "_"))


def _timestamp_text() -> Column:
    return F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
