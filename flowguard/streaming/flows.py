"""Packets to flows as a stateful stream (STR-01 to STR-06)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowguard.functions.risk import per_second
from flowguard.operators.flows import MICROS, network_packets
from flowguard.session import checkpoint_root

KEY = ["protocol", "low_ip", "low_port", "high_ip", "high_port"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# One open flow: no lists, only counts, sums, extremes and last times. Times are microseconds.
STATE = [
    ("opener_ip", "string"), ("opener_port", "int"), ("answerer_ip", "string"), ("answerer_port", "int"),
    ("first_at", "bigint"), ("last_at", "bigint"), ("last_fwd", "bigint"), ("fwd_gap_min", "bigint"),
    ("fwd_packets", "bigint"), ("bwd_packets", "bigint"), ("fwd_bytes", "bigint"), ("bwd_bytes", "bigint"),
    ("fwd_max", "int"), ("bwd_max", "int"), ("gaps", "bigint"), ("gap_mean", "double"), ("gap_m2", "double"),
    ("fwd_header", "bigint"), ("bwd_header", "bigint"), ("fin", "bigint"), ("psh", "bigint"),
    ("fwd_window", "int"), ("bwd_window", "int"), ("data_packets", "bigint"), ("min_segment", "int"),
]
STATE_SCHEMA = ", ".join(f"{n} {t}" for n, t in STATE)
NAMES = [n for n, _ in STATE]
OUTPUT_SCHEMA = "protocol string, " + STATE_SCHEMA


#: What a worker keeps of each packet that a cut may still divide.
PACKED = np.dtype([("at", "<i8"), ("length", "<i4"), ("header", "<i4"), ("window", "<i4"), ("marks", "u1")])
SIDE, FIN, PSH = 1, 2, 4
#: A run of packets without an idle gap inside one time slice; sides are the lower and the higher end of the conversation,
#: as the run does not know which of them opened the flow.
RUN = [("first_at", "bigint"), ("last_at", "bigint"), ("first_side", "bigint"), ("gaps", "bigint"), ("gap_mean", "double"), ("gap_m2", "double"),
       ("fin", "bigint"), ("psh", "bigint")]
SIDED = ["packets", "bytes", "most", "header", "window", "first", "last", "least_gap", "data", "least_header"]
RUN += [(f"{n}_{side}", "bigint") for side in (0, 1) for n in SIDED]
NEVER = np.iinfo(np.int64).max


def summarise_runs(p: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts, sums, extremes and gaps of consecutive runs of packets, which begin at `starts`; -1 where there is none."""
    n, at = len(p), p["at"]
    lengths = np.diff(np.append(starts, n))
    run = np.repeat(np.arange(len(starts)), lengths)
    gap = np.diff(at, prepend=0)
    gap[starts] = 0
    seconds = np.where(gap > 0, gap, 0) / MICROS
    count = np.add.reduceat((gap > 0).astype(np.int64), starts)
    mean = np.add.reduceat(seconds, starts) / np.maximum(count, 1)
    off = np.where(gap > 0, seconds - mean[run], 0.0)
    marks = p["marks"]
    out = {"first_at": at[starts], "last_at": at[starts + lengths - 1], "first_side": (marks[starts] & SIDE).astype(np.int64), "gaps": count, "gap_mean": mean,
           "gap_m2": np.add.reduceat(off * off, starts), "fin": np.add.reduceat((marks & FIN > 0).astype(np.int64), starts),
           "psh": np.add.reduceat((marks & PSH > 0).astype(np.int64), starts)}
    for side in (0, 1):
        mine = (marks & SIDE) == side
        places = np.flatnonzero(mine)
        first = np.minimum.reduceat(np.where(mine, np.arange(n), n), starts)
        last = np.maximum.reduceat(np.where(mine, np.arange(n), -1), starts)
        held = last >= 0
        least = np.full(len(starts), NEVER)
        same = run[places[1:]] == run[places[:-1]]
        np.minimum.at(least, run[places[1:]][same], np.diff(at[places])[same])

        def total(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(np.where(mine, values, 0).astype(np.int64), starts)

        def at_places(values: np.ndarray, index: np.ndarray, none: int) -> np.ndarray:
            return np.where(held, values[np.where(held, index, 0)].astype(np.int64), none)
        out |= {f"packets_{side}": total(np.ones(n, np.int64)), f"bytes_{side}": total(p["length"]),
                f"most_{side}": np.maximum.reduceat(np.where(mine, p["length"], 0).astype(np.int64), starts), f"header_{side}": total(p["header"]),
                f"window_{side}": at_places(p["window"], first, 0), f"first_{side}": at_places(at, first, -1), f"last_{side}": at_places(at, last, -1),
                f"least_gap_{side}": np.where(least == NEVER, -1, least), f"data_{side}": total(p["length"] - (20 + p["header"]) > 0),
                f"least_header_{side}": np.minimum.reduceat(np.where(mine, p["header"], 20).astype(np.int64), starts)}
    return out


def _only_run(p: np.ndarray) -> dict:
    return {n: v[0].item() for n, v in summarise_runs(p, np.zeros(1, np.int64)).items()}


def cut_into_runs(idle: int, packed: bool):
    """Runs of a worker's packets. All packets of one (conversation, slice) are in one worker, and many of them share it."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # the worker's share of one micro-batch
        if not sum(map(len, held)):
            return
        rows = pa.Table.from_batches(held).to_pandas()
        group = rows.groupby([*KEY, "slice"], sort=False).ngroup().to_numpy()
        order = np.lexsort((rows["seq"].to_numpy(), rows["at"].to_numpy(), group))
        p = np.empty(len(rows), PACKED)
        for name, column in (("at", "at"), ("length", "length"), ("header", "header_len"), ("window", "window"), ("marks", "marks")):
            p[name] = rows[column].to_numpy()[order]
        group = group[order]
        starts = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(p["at"], prepend=0) > idle))
        out = rows[KEY].iloc[order[starts]].reset_index(drop=True)
        found = summarise_runs(p, starts)
        ends = np.append(starts[1:], len(p))
        body = [p[i:j].tobytes() for i, j in zip(starts, ends)] if packed else [None] * len(starts)
        table = pa.Table.from_pandas(out, preserve_index=False)
        stamp = pa.array(found["last_at"]).cast(pa.timestamp("us", "UTC"))
        columns = [*table.columns, stamp, *[pa.array(found[n]) for n, _ in RUN], pa.array(body, pa.binary())]
        yield from pa.table(columns, names=[*KEY, "ts", *[n for n, _ in RUN], "body"]).to_batches()
    return cut


def _opened(key: tuple, side: int, at: int) -> dict:
    """An empty flow opened by a packet of one side of the conversation."""
    ends = [(key[1], key[2]), (key[3], key[4])]
    return dict.fromkeys(NAMES, 0) | {
        "opener_ip": ends[side][0], "opener_port": ends[side][1], "answerer_ip": ends[1 - side][0], "answerer_port": ends[1 - side][1],
        "first_at": at, "last_at": at, "last_fwd": -1, "fwd_gap_min": -1, "gap_mean": 0.0, "gap_m2": 0.0, "min_segment": 20}


def _add_gaps(flow: dict, n: int, mean: float, m2: float) -> None:
    """Chan's formula for the deviation of two lots."""
    if n:
        total, shift = flow["gaps"] + n, mean - flow["gap_mean"]
        flow["gap_m2"] += m2 + shift * shift * flow["gaps"] * n / total
        flow["gap_mean"] += shift * n / total
        flow["gaps"] = total


def _add(flow: dict, run: dict, opener: int) -> None:
    """Append a run to a flow whose opener is the given side."""
    between = run["first_at"] - flow["last_at"]
    if between > 0:
        _add_gaps(flow, 1, between / MICROS, 0.0)
    _add_gaps(flow, run["gaps"], run["gap_mean"], run["gap_m2"])
    flow["last_at"] = max(run["last_at"], flow["last_at"])
    flow["fin"] += run["fin"]
    flow["psh"] += run["psh"]
    for name, side in (("fwd", opener), ("bwd", 1 - opener)):
        if not run[f"packets_{side}"]:
            continue
        if flow[f"{name}_packets"] == 0:
            flow[f"{name}_window"] = run[f"window_{side}"]
        flow[f"{name}_packets"] += run[f"packets_{side}"]
        flow[f"{name}_bytes"] += run[f"bytes_{side}"]
        flow[f"{name}_max"] = max(flow[f"{name}_max"], run[f"most_{side}"])
        flow[f"{name}_header"] += run[f"header_{side}"]
    if run[f"packets_{opener}"]:
        gaps = [g for g in (run[f"least_gap_{opener}"], flow["fwd_gap_min"]) if g >= 0]
        if flow["last_fwd"] >= 0:
            gaps.append(run[f"first_{opener}"] - flow["last_fwd"])
        flow["fwd_gap_min"] = min(gaps, default=-1)
        flow["last_fwd"] = run[f"last_{opener}"]
        flow["data_packets"] += run[f"data_{opener}"]
        flow["min_segment"] = min(flow["min_segment"], run[f"least_header_{opener}"])


class FlowProcessor(StatefulProcessor):
    """One open flow per conversation, fed with runs. A gap beyond the idle timeout closes it, by the next packet or by a
    timer; a packet beyond the active timeout closes it and belongs to it."""

    def __init__(self, idle_seconds: float, active_seconds: float | None):
        self.idle = round(idle_seconds * MICROS)
        self.active = None if active_seconds is None else round(active_seconds * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Runs of a micro-batch arrive in any order. A run is added whole; only one that a timeout cuts is looked into.
        runs = [r for part in rows for r in part.to_dict("records")]
        runs.sort(key=lambda r: r["first_at"])
        open_flow = dict(zip(NAMES, self.flow.get(), strict=True)) if self.flow.exists() else None
        closed = []
        for run in runs:
            if open_flow is not None and run["first_at"] - open_flow["last_at"] > self.idle:
                closed.append(open_flow)
                open_flow = None
            if open_flow is None:
                open_flow = _opened(key, run["first_side"], run["first_at"])
            if self.active is not None and run["last_at"] > open_flow["first_at"] + self.active:
                packets, i = np.frombuffer(run["body"], PACKED), 0
                while i < len(packets):  # one round per flow, not per packet
                    if open_flow is None:
                        open_flow = _opened(key, int(packets["marks"][i]) & SIDE, int(packets["at"][i]))
                    late = i + int(np.searchsorted(packets["at"][i:], open_flow["first_at"] + self.active, side="right"))
                    _add(open_flow, _only_run(packets[i:late + 1]), self._side(key, open_flow))
                    if late < len(packets):
                        closed.append(open_flow)
                        open_flow = None
                    i = late + 1
            else:
                _add(open_flow, run, self._side(key, open_flow))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if open_flow is None:
            self.flow.clear()
        else:
            self.flow.update(tuple(open_flow[n] for n in NAMES))
            self.handle.registerTimer((open_flow["last_at"] + self.idle) // 1000 + 1)
        if closed:
            yield self._frame(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.flow.exists():
            open_flow = dict(zip(NAMES, self.flow.get(), strict=True))
            self.flow.clear()
            yield self._frame(key, [open_flow])

    def close(self) -> None:
        pass

    @staticmethod
    def _side(key, flow: dict) -> int:
        return 0 if (flow["opener_ip"], flow["opener_port"]) == (key[1], key[2]) else 1

    @staticmethod
    def _frame(key, flows: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame(flows, columns=NAMES)
        frame.insert(0, "protocol", key[0])
        return frame


def _keyed(packets: DataFrame, slice_seconds: float) -> DataFrame:
    rows = network_packets(packets).where("at IS NOT NULL")
    marks = F.when(F.col("src") != F.col("key.low"), SIDE).otherwise(0) + F.when(F.col("flags").contains("F"), FIN).otherwise(0) + F.when(
        F.col("flags").contains("P"), PSH).otherwise(0)
    return rows.select(
        "protocol", F.col("key.low.ip").alias("low_ip"), F.col("key.low.port").alias("low_port"), F.col("key.high.ip").alias("high_ip"),
        F.col("key.high.port").alias("high_port"), F.floor(F.col("at") / round(slice_seconds * MICROS)).alias("slice"), "at", "seq", "length", "header_len", "window",
        marks.alias("marks"))


def closed_flows(packets: DataFrame, idle_seconds: float = 2.0, active_seconds: float | None = 10.0, watermark: str = "5 seconds",
                 slice_seconds: float = 1.0) -> DataFrame:
    """Raw flow states as they close; `packets` is a stream with an event-time column `ts`.

    The packets of a micro-batch are dealt by (conversation, time slice) and summed to runs there, so a busy conversation
    is spread over as many workers as it has slices. The stateful step sees one row per run. Where an active timeout
    may cut a run, the row also carries 21 bytes of each packet. A run is late if its last packet is; packets without
    a time belong to no flow.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = "protocol string, low_ip string, low_port int, high_ip string, high_port int, ts timestamp, " + ", ".join(f"{n} {t}" for n, t in RUN) + ", body binary"
    runs = (_keyed(packets, slice_seconds).repartition(*KEY, "slice")
            .mapInArrow(cut_into_runs(round(idle_seconds * MICROS), active_seconds is not None), kinds).withWatermark("ts", watermark))
    return runs.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=FlowProcessor(idle_seconds, active_seconds), outputStructType=OUTPUT_SCHEMA, outputMode="Append", timeMode="EventTime")


def open_flows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """STR-04: the flows still open when a query has ended, read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "flow").load(checkpoint)
    return state.select(F.col("key.protocol").alias("protocol"), "value.*")


def state_features(flows: DataFrame) -> DataFrame:
    """STR-05 from closed flow states: the same columns as the batch form."""
    seconds = (F.col("last_at") - F.col("first_at")) / float(MICROS)
    zero = F.lit(0.0)

    def number(name: str):
        return F.col(name).cast("double")
    return flows.select(
        number("answerer_port").alias("Destination Port"), number("fwd_bytes").alias("Total Length of Fwd Packets"),
        number("fwd_max").alias("Fwd Packet Length Max"), number("bwd_max").alias("Bwd Packet Length Max"),
        per_second(number("fwd_bytes") + number("bwd_bytes"), seconds).alias("Flow Bytes/s"),
        F.when(F.col("gaps") > 0, F.sqrt(F.col("gap_m2") / F.col("gaps"))).otherwise(0.0).alias("Flow IAT Std"),
        F.when(F.col("fwd_gap_min") >= 0, F.col("fwd_gap_min") / float(MICROS)).otherwise(0.0).alias("Fwd IAT Min"),
        number("fwd_header").alias("Fwd Header Length"), number("bwd_header").alias("Bwd Header Length"),
        per_second(number("bwd_packets"), seconds).alias("Bwd Packets/s"), number("fin").alias("FIN Flag Count"), number("psh").alias("PSH Flag Count"),
        number("fwd_window").alias("Init_Win_bytes_forward"), number("bwd_window").alias("Init_Win_bytes_backward"),
        number("data_packets").alias("act_data_pkt_fwd"), number("min_segment").alias("min_seg_size_forward"),
        zero.alias("Active Mean"), zero.alias("Active Std"), zero.alias("Active Max"), zero.alias("Idle Std"),
        F.col("opener_ip").alias("_src_ip"), F.col("opener_port").alias("_src_port"), F.col("answerer_ip").alias("_dst_ip"),
        F.col("answerer_port").alias("_dst_port"), F.col("protocol").alias("_protocol"),
        F.timestamp_micros("first_at").alias("_start_time"), F.timestamp_micros("last_at").alias("_last_seen"),
        (F.col("fwd_packets") + F.col("bwd_packets")).alias("_packets"))


def run_to_table(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> tuple[DataFrame, str]:
    """Run a stream over everything available into a table below the checkpoint folder.

    Append mode writes each row once. Update mode writes the changed rows of every micro-batch into a folder of their
    own, and the table shows the latest row of each `key`. Complete mode, for results of a few rows, rewrites the table.
    Returns the table and the query's checkpoint. Rows go from executors to files, never through the driver.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/rows").outputMode("append").start()
    elif mode == "update":
        query = writer.outputMode("update").foreachBatch(
            lambda rows, batch: rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")).start()
    else:
        query = writer.outputMode(mode).foreachBatch(
            lambda rows, batch: rows.write.mode("overwrite").parquet(f"{root}/rows")).start()
    query.awaitTermination()
    table = spark.read.schema(stream.schema).parquet(f"{root}/rows")
    if mode == "update":
        numbered = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/rows")
        latest = numbered.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
        table = latest.select("row.*")
    return table, f"{root}/state"


def score_stream(flows: DataFrame, score: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], object], checkpoint: str):
    """STR-06: closed flows are scored and stored per micro-batch; returns the unstarted writer.

    `score` turns flow features into alert rows, `store` appends them; both run on the cluster.
    """
    def handle(batch: DataFrame, number: int) -> None:
        store(score(batch))
    return flows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
