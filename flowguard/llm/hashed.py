"""Hashed n-grams as numpy slots, and bounded labelled samples of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import small_join, uniform

_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x85EBCA6B)  # odd multipliers; any would do
_POWERS = np.cumprod(np.full(64, 0x9E3779B1, np.uint32), dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def byte_grams(data: bytes, n: int, bits: int) -> np.ndarray:
    """Slot of every run of n bytes."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < n:
        return np.empty(0, np.uint32)
    h = b[:len(b) - n + 1] + np.uint32(n)
    for j in range(1, n):
        h = h * _STEP ^ b[j:len(b) - n + 1 + j]
    return (h * _MIX) >> np.uint32(32 - bits)


def word_hashes(data: bytes) -> np.ndarray:
    """One 32-bit hash for each word between ASCII white space."""
    b = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[b]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.empty(0, np.uint32)
    at = np.cumsum(inside & ~np.concatenate(([False], inside[:-1]))) - 1
    place = np.arange(len(b)) - starts[np.maximum(at, 0)]
    return np.add.reduceat((b.astype(np.uint32) + np.uint32(1)) * _POWERS[place & 63] * inside, starts, dtype=np.uint32) * _MIX


def word_grams(words: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Slot of every run of n words."""
    if len(words) < n:
        return np.empty(0, np.uint32)
    h = words[:len(words) - n + 1].copy()
    for j in range(1, n):
        h = (h * _STEP) ^ words[j:len(words) - n + 1 + j]
    return (h * _MIX) >> np.uint32(32 - bits)


def shares(groups: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots over all groups (group i moved up by i * width) and each slot's share of its group."""
    slots, values = [], []
    for i, g in enumerate(groups):
        if len(g):
            distinct, count = np.unique(g, return_counts=True)
            slots.append(distinct.astype(np.int32) + i * width)
            values.append((count / len(g)).astype(np.float32))
    if not slots:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    return np.concatenate(slots), np.concatenate(values)


def labelled_sample(rows: DataFrame, label: str, identity: str, per_label: int, labels: int, seed: int) -> DataFrame:
    """About `per_label` rows of each of the `labels` most frequent labels, chosen by a hash of their identity.

    Both bounds are what a classifier is fitted on; nothing else is. Adds `weight`, the rows that each chosen row stands for.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__rows")).orderBy(F.desc("__rows"), label).limit(labels)
    known = small_join(rows, counts, [label], [identity]).where(F.col("__rows").isNotNull())
    share = F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("__rows"))
    chosen = known.where(uniform(seed, F.coalesce(F.col(identity).cast("string"), F.lit(""))) < share)
    return chosen.withColumn("weight", 1.0 / share).drop("__rows")


def collect_features(rows: DataFrame, text: str, carry: list[str], groups: Callable[[str], list[np.ndarray]], width: int) -> pa.Table:
    """The sampled rows' slots and shares, counted on the executors; a row holds at most one entry per slot."""
    keep = rows.select(*carry, text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep.select(*carry).schema.fields] + ["slots array<int>", "shares array<float>"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shares(groups(t or ""), width) for t in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(carry))), pa.array([s for s, _ in found], pa.list_(pa.int32())),
                 pa.array([v for _, v in found], pa.list_(pa.float32()))], names=[*carry, "slots", "shares"])
    return keep.mapInArrow(count, schema).toArrow()


def as_arrays(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    slots, values = table.column("slots").combine_chunks(), table.column("shares").combine_chunks()
    s, v, o = slots.values.to_numpy(), values.values.to_numpy(), slots.offsets.to_numpy()
    return [(s[o[i]:o[i + 1]], v[o[i]:o[i + 1]]) for i in range(len(slots))]
