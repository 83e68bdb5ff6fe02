"""Indicator matching, reputation, socket attribution and burst detection (JOIN-02, JOIN-08, JOIN-11, CTI-*, WIN-05)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.functions.net import is_internal, starts_with_any
from flowguard.operators.alerts import query_alerts
from flowguard.operators.distributed import lookup_join, running_totals

# List precedence (first wins), action and score per list, defaults of a feed entry.
LIST_PRIORITY = {"whitelist": 1, "blacklist": 2, "malicious_ip": 3}
LIST_ACTION = {"whitelist": "allow", "blacklist": "block", "malicious_ip": "flag"}
LIST_SCORE = {"whitelist": 0, "blacklist": 100}
FEED_SCORE = 80
FEED_CATEGORY = "Threat Feed"

# Prefixes and figures of the offline reputation rule.
OFFLINE_PREFIXES = ["185.", "198."]
OFFLINE_ABUSE, OFFLINE_REPORTS, OFFLINE_PULSES = 85, 12, 3
ABUSE_LIMIT = 50
PROVIDERS = ["AbuseIPDB", "AlienVault", "GreyNoise"]


def _choose(column: Column, values: dict, otherwise: Column) -> Column:
    result = otherwise
    for key, value in values.items():
        result = F.when(column == key, F.lit(value)).otherwise(result)
    return result


def indicator_lookup(indicators: DataFrame) -> DataFrame:
    """One row per address: the list that decides, and the newest entry of that list."""
    priority = _choose(F.col("list_type"), LIST_PRIORITY, F.lit(9))
    best = indicators.groupBy("ip").agg(F.min_by(
        F.struct("list_type", "category", "threat_score"), F.struct(priority.alias("p"), (-F.col("seq")).alias("s"))).alias("e"))
    kind = F.col("e.list_type")
    listed = kind == "malicious_ip"
    score = _choose(kind, LIST_SCORE, F.coalesce(F.col("e.threat_score"), F.lit(FEED_SCORE)))
    return best.select(
        "ip", kind.alias("ioc_type"), _choose(kind, LIST_ACTION, F.lit("flag")).alias("ioc_action"), score.cast("int").alias("ioc_score"),
        F.when(listed, F.coalesce("e.category", F.lit(FEED_CATEGORY))).alias("ioc_category"))


def match_indicators(df: DataFrame, indicators: DataFrame, address: str = "src_ip", **limits) -> DataFrame:
    """JOIN-02: type, action, score and category of each row's address."""
    lookup = indicator_lookup(indicators).withColumnRenamed("ip", address)
    joined = lookup_join(df, lookup, [address], **limits)
    return joined.withColumns({
        "ioc_matched": F.col("ioc_type").isNotNull(), "ioc_type": F.coalesce("ioc_type", F.lit("none")),
        "ioc_action": F.coalesce("ioc_action", F.lit("inspect")), "ioc_score": F.coalesce("ioc_score", F.lit(0))})


def override_risk(df: DataFrame) -> DataFrame:
    """EXP-04: an allowed address is Low/0, a blocked one Critical/100."""
    return df.withColumns({
        "risk_level": F.when(F.col("ioc_action") == "allow", "Low").when(F.col("ioc_action") == "block", "Critical").otherwise(F.col("risk_level")),
        "risk_score": F.when(F.col("ioc_action") == "allow", 0.0).when(F.col("ioc_action") == "block", 100.0).otherwise(F.col("risk_score"))})


def fresh(feed: DataFrame, as_of: datetime, ttl_seconds: int = 3600) -> DataFrame:
    """CTI-04: entries younger than the time to live."""
    return feed.where(F.col("fetched_at") > F.lit(as_of) - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def reputation(df: DataFrame, address: str = "src_ip", abuse: DataFrame | None = None, pulses: DataFrame | None = None,
               providers: list[str] | None = None, strict_internal: bool = False, **limits) -> DataFrame:
    """CTI-02, with the offline rule of CTI-03 for a provider that has no feed table.

    `abuse` holds (ip, abuse_score, reports) and `pulses` (ip, pulse_count), one row per address.
    """
    enabled = set(providers or PROVIDERS)
    offline = starts_with_any(F.col(address), OFFLINE_PREFIXES)
    if abuse is not None:
        df = lookup_join(df, abuse.select(F.col("ip").alias(address), F.col("abuse_score").alias("_abuse"), F.col("reports").alias("_reports")), [address], **limits)
    else:
        df = df.withColumns({"_abuse": F.when(offline, OFFLINE_ABUSE), "_reports": F.when(offline, OFFLINE_REPORTS)})
    if pulses is not None:
        df = lookup_join(df, pulses.select(F.col("ip").alias(address), F.col("pulse_count").alias("_pulses")), [address], **limits)
    else:
        df = df.withColumn("_pulses", F.when(offline, OFFLINE_PULSES))
    internal = is_internal(F.col(address), strict_internal)
    score = F.coalesce("_abuse", F.lit(0)) if "AbuseIPDB" in enabled else F.lit(0)
    pulse = F.coalesce("_pulses", F.lit(0)) if "AlienVault" in enabled else F.lit(0)
    abused, pulsed = ~internal & (score > ABUSE_LIMIT), ~internal & (pulse > 0)
    tags = F.array_compact(F.array(
        F.when(internal, "Internal IP / Private Subnet"),
        F.when(abused, F.concat(F.lit("AbuseIPDB Score: "), score.cast("string"), F.lit("%"))),
        F.when(pulsed, F.concat(F.lit("OTX Pulses: "), pulse.cast("string")))))
    return df.withColumns({
        "threat_score": F.when(abused, score).otherwise(0), "is_malicious": abused | pulsed, "reputation_tags": tags,
        "provider_results": F.when(internal, F.create_map().cast(_PROVIDER_MAP)).otherwise(_provider_map(enabled, score, pulse))}
    ).drop("_abuse", "_reports", "_pulses")


_PROVIDER_MAP = "map<string,struct<abuse_confidence_score:int,total_reports:int,pulse_count:int,classification:string>>"


def _provider_map(enabled: set[str], score: Column, pulse: Column) -> Column:
    none = F.lit(None).cast("int")
    figures = {
        "AbuseIPDB": (score, F.coalesce("_reports", F.lit(0)), none, F.lit(None).cast("string")),
        "AlienVault": (none, none, pulse, F.lit(None).cast("string")),
        "GreyNoise": (none, none, none, F.lit("benign")),
    }
    entries = []
    for name in PROVIDERS:
        if name in enabled:
            a, r, p, c = figures[name]
            entries += [F.lit(name), F.struct(a.cast("int").alias("abuse_confidence_score"), r.cast("int").alias("total_reports"),
                                              p.cast("int").alias("pulse_count"), c.alias("classification"))]
    return F.create_map(*entries).cast(_PROVIDER_MAP)


def enrich_alerts(alerts: DataFrame, indicators: DataFrame, abuse: DataFrame | None = None, pulses: DataFrame | None = None, **limits) -> DataFrame:
    """CTI-01: indicator match, risk override, then reputation, which never changes the risk."""
    return reputation(override_risk(match_indicators(alerts, indicators, **limits)), abuse=abuse, pulses=pulses, **limits)


def enriched_feed(alerts: DataFrame, indicators: DataFrame, limit: int = 20) -> DataFrame:
    """CTI-05: the newest alerts, enriched, with their number."""
    rows = enrich_alerts(query_alerts(alerts, limit), indicators)
    return rows.withColumn("feed_count", F.count("*").over(Window.partitionBy(F.lit(1))))


def apply_edits(indicators: DataFrame, edits: DataFrame) -> DataFrame:
    """JOIN-11 and SET-03: whitelist and blacklist edits in sequence order.

    `edits` holds (ip, list_type, category, first_seen, seq). The last edit of an address decides its list; any
    blacklist edit also replaces its feed entry with score 100.
    """
    black = F.col("list_type") == "blacklist"
    last = edits.groupBy("ip").agg(
        F.max_by("list_type", "seq").alias("list_type"), F.max("seq").alias("seq"),
        F.max_by(F.struct("category", "first_seen", "seq"), F.when(black, F.col("seq"))).alias("entry"))
    listed = indicators.where("list_type <> 'malicious_ip'").join(last.select("ip"), "ip", "left_anti")
    feed = indicators.where("list_type = 'malicious_ip'").join(last.where("entry IS NOT NULL").select("ip"), "ip", "left_anti")
    none = F.lit(None)
    moved = last.select("ip", "list_type", none.cast("string").alias("category"), none.cast("int").alias("threat_score"),
                        none.cast("string").alias("first_seen"), "seq")
    entered = last.where("entry IS NOT NULL").select(
        "ip", F.lit("malicious_ip").alias("list_type"), "entry.category", F.lit(100).alias("threat_score"), "entry.first_seen", "entry.seq")
    parts = [p.select("ip", "list_type", "category", "threat_score", "first_seen", "seq") for p in (listed, feed, moved, entered)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def attribute_sockets(flows: DataFrame, inventory: DataFrame, default: str = "unknown", **limits) -> DataFrame:
    """JOIN-08: owner of the source port, else of the destination port, else the default.

    `inventory` holds (port, process, seq); the newest entry of a port counts.
    """
    owners = inventory.groupBy("port").agg(F.max_by("process", "seq").alias("process"))
    by_source = lookup_join(flows, owners.select(F.col("port").alias("src_port"), F.col("process").alias("_by_src")), ["src_port"], **limits)
    by_both = lookup_join(by_source, owners.select(F.col("port").alias("dst_port"), F.col("process").alias("_by_dst")), ["dst_port"], **limits)
    return by_both.withColumn("process", F.coalesce("_by_src", "_by_dst", F.lit(default))).drop("_by_src", "_by_dst")


def request_bursts(events: DataFrame, client: str = "client_ip", ts: str = "ts", limit: int = 120, seconds: int = 60) -> DataFrame:
    """WIN-05: requests per client in the sliding window that ends at each instant; the far end is open.

    A request counts from its instant on and is taken back one window later, so the count at any instant is one running
    total. It is summed by slices of the time line, so a client with any share of the log is spread, and the work does
    not grow with the requests in a window.
    """
    micros = seconds * 1_000_000
    per_instant = events.groupBy(client, F.unix_micros(ts).alias("_at")).agg(F.count("*").alias("requests"))
    steps = F.array(F.struct(F.col("_at").alias("_at"), F.col("requests").alias("requests"), F.col("requests").alias("_step")),
                    F.struct((F.col("_at") + micros).alias("_at"), F.lit(0).cast("bigint").alias("requests"), (-F.col("requests")).alias("_step")))
    merged = per_instant.select(client, F.inline(steps)).groupBy(client, "_at").agg(F.sum("requests").alias("requests"), F.sum("_step").alias("_step"))
    counted = running_totals(merged, [client], ["_at"], {"in_window": F.col("_step")}).where("requests > 0")
    return counted.select(client, F.timestamp_micros("_at").alias(ts), "requests", "in_window", (F.col("in_window") > limit).alias("limited"))
