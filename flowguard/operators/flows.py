"""Packets to bidirectional flows in batch (FIL-13, JOIN-07, WIN-03, WIN-04, STR-01 to STR-05).

A conversation of any length is cut into time slices; only one row per conversation and slice crosses
slices, so a conversation that holds a large share of the packets is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.functions.net import conversation_key, endpoint
from flowguard.functions.risk import per_second
from flowguard.operators.distributed import SLICE, carry_forward, previous_value
from flowguard.session import cut_lineage

PORTED = ["TCP", "UDP"]
NETWORK = ["TCP", "UDP", "ICMP", "IP"]
MICROS = 1_000_000


def network_packets(packets: DataFrame) -> DataFrame:
    """FIL-13: drop what is not IP, set ports to 0 where there are none, and name both endpoints."""
    ported = F.col("protocol").isin(PORTED)
    tcp = F.col("protocol") == "TCP"
    rows = packets.where(F.col("protocol").isin(NETWORK)).withColumns({
        "src_port": F.when(ported, F.col("src_port")).otherwise(0).cast("int"),
        "dst_port": F.when(ported, F.col("dst_port")).otherwise(0).cast("int"),
        "flags": F.when(tcp, F.coalesce("flags", F.lit(""))).otherwise(""),
        "window": F.when(tcp, F.coalesce("window", F.lit(8192))).otherwise(0).cast("int"),
        "header_len": F.when(tcp, F.coalesce("header_len", F.lit(20))).otherwise(20).cast("int"),
        "length": F.coalesce("length", F.lit(60)).cast("int")})
    src, dst = endpoint(F.col("src_ip"), F.col("src_port")), endpoint(F.col("dst_ip"), F.col("dst_port"))
    return rows.withColumns({"src": src, "dst": dst, "key": conversation_key(F.col("protocol"), src, dst), "at": F.unix_micros("ts")})


def idle_sessions(packets: DataFrame, idle_seconds: float = 2.0, slice_seconds: int = 3600) -> DataFrame:
    """STR-02: a gap longer than the idle timeout starts a new flow; `start` is its first packet (at, seq)."""
    idle = round(idle_seconds * MICROS)
    rows = packets.withColumn(SLICE, F.floor(F.col("at") / (slice_seconds * MICROS)))
    gaps = previous_value(rows, ["key"], ["at", "seq"], F.col("at"), "_before")
    opens = F.col("_before").isNull() | (F.col("at") - F.col("_before") > idle)
    node = F.struct("at", "seq")
    return carry_forward(gaps, ["key"], ["at", "seq"], F.when(opens, node), "start").drop("_before", SLICE)


def active_flows(sessions: DataFrame, active_seconds: float = 10.0, idle_seconds: float = 2.0) -> DataFrame:
    """STR-03: the first packet later than the active timeout closes its flow and belongs to it; the next
    packet starts another. Replaces `start` within each idle session.

    Where a flow ends depends on where it began, so the starts of a session form a chain. Every packet
    is linked to the start that would follow it (both lie within the active timeout plus two idle gaps,
    hence within two time slices), and the chain is followed from the session start by pointer doubling:
    a session of n flows takes log2(n) rounds whatever its length.
    """
    active, idle = round(active_seconds * MICROS), round(idle_seconds * MICROS)
    reach = active + 2 * idle
    rows = sessions.withColumn("node", F.struct("at", "seq"))
    bounds = rows.groupBy("key", "start").agg(F.max("at").alias("_end"))
    numbered = bounds.where(F.col("_end") - F.col("start.at") > active).select("key", "start", F.monotonically_increasing_id().alias("session"))
    long = cut_lineage(numbered)  # written, so the numbers stay
    if long.isEmpty():
        return sessions
    chained = rows.join(long, ["key", "start"])
    nodes = cut_lineage(chained.select("session", "node"))
    marks = _chain(_links(nodes, active, reach), long.select("session", F.col("start").alias("node")))
    starts = _last_mark(nodes, marks, reach)
    moved = chained.join(starts, ["session", "node"]).withColumn("start", F.col("mark"))
    kept = rows.join(long, ["key", "start"], "left_anti")
    return kept.select(*sessions.columns).unionByName(moved.select(*sessions.columns))


def _two_slices(nodes: DataFrame, reach: int, offset: int) -> DataFrame:
    """Each node in its own slice of length `reach`, and as context in the slice `offset` away."""
    own = F.floor(F.col("node.at") / reach)
    return nodes.withColumn("_own", own).withColumn(SLICE, F.explode(F.array(own, own + offset)))


def _links(nodes: DataFrame, active: int, reach: int) -> DataFrame:
    """node -> the start that follows a flow begun at node: the successor of its closing packet."""
    seen = _two_slices(nodes, reach, -1).withColumn("_back", -F.col("node.at"))
    order = Window.partitionBy("session", SLICE).orderBy("node")
    followed = seen.withColumn("_next", F.lead("node").over(order))
    # Backwards in time the frame only grows, so each packet enters the minimum once.
    later = Window.partitionBy("session", SLICE).orderBy("_back").rangeBetween(Window.unboundedPreceding, -(active + 1))
    linked = followed.withColumn("next", F.min_by("_next", "node").over(later))
    return linked.where(F.col("_own") == F.col(SLICE)).where("next IS NOT NULL").select("session", "node", "next")


def _chain(links: DataFrame, marks: DataFrame) -> DataFrame:
    """Nodes reached from each session start by following links."""
    jump = cut_lineage(links)
    while not jump.isEmpty():
        reached = marks.join(jump, ["session", "node"]).select("session", F.col("next").alias("node"))
        marks = cut_lineage(marks.unionByName(reached).distinct())
        further = jump.select("session", F.col("node").alias("next"), F.col("next").alias("_far"))
        jump = cut_lineage(jump.join(further, ["session", "next"]).select("session", "node", F.col("_far").alias("next")))
    return marks


def _last_mark(nodes: DataFrame, marks: DataFrame, reach: int) -> DataFrame:
    """The flow start of every node: the last mark at or before it, at most one slice back."""
    flagged = nodes.join(marks.withColumn("mark", F.col("node")), ["session", "node"], "left")
    seen = _two_slices(flagged, reach, 1)
    upto = Window.partitionBy("session", SLICE).orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    carried = seen.withColumn("mark", F.last("mark", ignorenulls=True).over(upto))
    return carried.where(F.col("_own") == F.col(SLICE)).select("session", "node", "mark")


def flow_features(packets: DataFrame, idle_seconds: float = 2.0, active_seconds: float | None = 10.0, slice_seconds: int = 3600) -> DataFrame:
    """STR-05: the twenty features and the metadata of every flow of a packet table (STR-04: all are closed)."""
    sessions = idle_sessions(network_packets(packets), idle_seconds, slice_seconds)
    if active_seconds is None:
        return features_of_long(sessions, slice_seconds)
    return features_of(active_flows(cut_lineage(sessions), active_seconds, idle_seconds))


FLOW = ["key", "start"]


def features_of(rows: DataFrame) -> DataFrame:
    """Aggregate packets that know their flow (`key`, `start`) when an active timeout bounds each flow.

    The first packet sets the direction. All windows and the aggregate share one exchange by flow.
    """
    order = Window.partitionBy(*FLOW).orderBy("at", "seq")
    directed = rows.withColumns({
        "opener": F.first("src").over(order), "answerer": F.first("dst").over(order), "_before": F.lag("at").over(order)})
    sided = directed.withColumn("fwd", F.col("src") == F.col("opener"))
    same_side = Window.partitionBy(*FLOW, "fwd").orderBy("at", "seq")
    return summarise(sided.withColumn("_before_dir", F.lag("at").over(same_side)), FLOW)


def features_of_long(rows: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """The same for flows without an upper length, which are handled time slice by time slice."""
    opening = (F.col("start.at") == F.col("at")) & (F.col("start.seq") == F.col("seq"))
    sliced = rows.withColumn(SLICE, F.floor(F.col("at") / (slice_seconds * MICROS)))
    ends = F.when(opening, F.struct(F.col("src").alias("opener"), F.col("dst").alias("answerer")))
    directed = carry_forward(sliced, FLOW, ["at", "seq"], ends, "_ends").withColumns({
        "opener": F.col("_ends.opener"), "answerer": F.col("_ends.answerer"), "fwd": F.col("src") == F.col("_ends.opener")}).drop("_ends")
    gaps = previous_value(directed, FLOW, ["at", "seq"], F.col("at"), "_before")
    gaps = previous_value(gaps, [*FLOW, "fwd"], ["at", "seq"], F.col("at"), "_before_dir")
    return summarise(gaps, FLOW)


def summarise(rows: DataFrame, flow: list[str]) -> DataFrame:
    """The feature aggregate over rows with `fwd`, `_before` and `_before_dir`."""
    forward = F.col("fwd")

    def of(side: Column, value: Column) -> Column:
        return F.when(side, value)

    def total(side: Column, value: Column) -> Column:
        return F.coalesce(F.sum(of(side, value)), F.lit(0)).cast("double")
    gap = (F.col("at") - F.col("_before")) / float(MICROS)
    forward_gap = (F.col("at") - F.col("_before_dir")) / float(MICROS)
    place = F.struct("at", "seq")
    payload = F.col("length") - (F.lit(20) + F.col("header_len"))
    seconds = (F.max("at") - F.min("at")) / float(MICROS)
    summed = rows.groupBy(*flow).agg(
        F.first("opener").alias("opener"), F.first("answerer").alias("answerer"),
        seconds.alias("seconds"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("packets"),
        F.sum("length").cast("double").alias("bytes"), F.count_if(~forward).cast("double").alias("bwd_packets"),
        total(forward, F.col("length")).alias("Total Length of Fwd Packets"),
        F.coalesce(F.max(of(forward, F.col("length"))), F.lit(0)).cast("double").alias("Fwd Packet Length Max"),
        F.coalesce(F.max(of(~forward, F.col("length"))), F.lit(0)).cast("double").alias("Bwd Packet Length Max"),
        F.coalesce(F.stddev_pop(F.when(gap > 0, gap)), F.lit(0.0)).alias("Flow IAT Std"),
        F.coalesce(F.min(of(forward, forward_gap)), F.lit(0.0)).alias("Fwd IAT Min"),
        total(forward, F.col("header_len")).alias("Fwd Header Length"),
        total(~forward, F.col("header_len")).alias("Bwd Header Length"),
        F.count_if(F.col("flags").contains("F")).cast("double").alias("FIN Flag Count"),
        F.count_if(F.col("flags").contains("P")).cast("double").alias("PSH Flag Count"),
        F.coalesce(F.min_by(of(forward, F.col("window")), F.when(forward, place)), F.lit(0)).cast("double").alias("Init_Win_bytes_forward"),
        F.coalesce(F.min_by(of(~forward, F.col("window")), F.when(~forward, place)), F.lit(0)).cast("double").alias("Init_Win_bytes_backward"),
        F.count_if(forward & (payload > 0)).cast("double").alias("act_data_pkt_fwd"),
        F.least(F.lit(20), F.min(of(forward, F.col("header_len")))).cast("double").alias("min_seg_size_forward"))
    zero = F.lit(0.0)
    return summed.select(
        F.col("answerer.port").cast("double").alias("Destination Port"),
        "Total Length of Fwd Packets", "Fwd Packet Length Max", "Bwd Packet Length Max",
        per_second(F.col("bytes"), F.col("seconds")).alias("Flow Bytes/s"), "Flow IAT Std", "Fwd IAT Min",
        "Fwd Header Length", "Bwd Header Length", per_second(F.col("bwd_packets"), F.col("seconds")).alias("Bwd Packets/s"),
        "FIN Flag Count", "PSH Flag Count", "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward",
        zero.alias("Active Mean"), zero.alias("Active Std"), zero.alias("Active Max"), zero.alias("Idle Std"),
        F.col("opener.ip").alias("_src_ip"), F.col("opener.port").alias("_src_port"),
        F.col("answerer.ip").alias("_dst_ip"), F.col("answerer.port").alias("_dst_port"), F.col("key.protocol").alias("_protocol"),
        F.timestamp_micros("first_at").alias("_start_time"), F.timestamp_micros("last_at").alias("_last_seen"), F.col("packets").alias("_packets"))
