"""Building blocks that keep exact answers while no single task receives a whole group.

The work is split into slices whose partial results are combined through a small table, in the same way at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.session import cut_lineage

SLICE = "_slice"
MIX_PRIME = 2147483647
#: A dimension is broadcast only below both of these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def mix(*keys: Column) -> Column:
    """Portable integer mix in [0, 2^31-1) of bigint key columns; equal in any SQL engine."""
    factors = [48271, 69621, 39373, 16807, 30269, 65539]
    factors += [10007 + 1009 * i for i in range(len(keys) - len(factors))]
    total = sum((F.pmod(k, F.lit(MIX_PRIME)) * F.lit(f) for k, f in zip(keys, factors[:len(keys)], strict=True)), F.lit(0).cast("bigint"))
    return F.pmod(total, F.lit(MIX_PRIME))


def _fits(df: DataFrame, rows: int, size: int) -> bool:
    """True when the frame is within both bounds, by one counting job."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    found = df.agg(F.count("*").alias("n"), F.sum(sum(texts, F.lit(24 * len(df.columns)))).alias("bytes")).first()
    return found["n"] <= rows and (found["bytes"] or 0) <= size


def lookup_join(fact: DataFrame, dimension: DataFrame, on: list[str], how: str = "left", broadcast_rows: int = BROADCAST_ROWS,
                broadcast_bytes: int = BROADCAST_BYTES, salts: int = 32, hot_share: float = 0.001, hot: DataFrame | None = None,
                key_share: float = 0.05) -> DataFrame:
    """Join a large frame to a dimension that is unique on `on`.

    The dimension is broadcast only after its rows and bytes were checked. A larger one is shuffled; keys that hold
    more than `hot_share` of the facts (there can be at most 1 / hot_share of them) are spread over `salts` tasks, and
    only their dimension rows are repeated. Hot keys come from a sample of the keys, as a missed one costs time and no
    row; a caller that knows them passes them.
    """
    if _fits(dimension, broadcast_rows, broadcast_bytes):
        return fact.join(F.broadcast(dimension), on, how)
    if hot is None:
        counted = cut_lineage(fact.select(*on).sample(key_share, seed=7).groupBy(*on).agg(F.count("*").alias("_n")))
        total = counted.agg(F.sum("_n")).first()[0] or 0
        hot = counted.where(F.col("_n") > F.lit(total * hot_share))
    marks = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    hashed = [F.col(f"`{f.name}`") for f in fact.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int")
    salted_fact = fact.join(marks, on, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_dimension = dimension.join(marks, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted_fact.join(salted_dimension, [*on, "_salt"], how).drop("_salt")


def _join_back(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    renamed = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & rows[k].eqNullSafe(renamed[f"_r_{k}"])
    return rows.join(renamed, condition, "left").drop(*[f"_r_{k}" for k in keys])


def add_slices(df: DataFrame, keys: list[str], slices: int) -> DataFrame:
    """Number of a contiguous range of the sort order, by Spark's range partitioning.

    The rows are written, since a range bound that is sampled again may differ. Equal keys share a slice.
    """
    ranged = df.repartitionByRange(max(1, slices), *[F.col(f"`{k}`") for k in keys])
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))


def count_below(df: DataFrame, bounds: Column, value: Column, name: str, size: int, strict: bool = True) -> DataFrame:
    """How many entries of a sorted array are below `value` (or equal, unless strict), by binary search.

    One projection per step keeps the search inside generated code; `size` is the largest array length.
    """
    out = df.withColumn(name, F.lit(0))
    step = 1 << (max(size, 1).bit_length() - 1)
    while step:
        ahead = F.get(bounds, F.col(name) + F.lit(step - 1))
        passed = (value > ahead) if strict else (value >= ahead)
        out = out.withColumn(name, F.when(passed, F.col(name) + F.lit(step)).otherwise(F.col(name)))
        step >>= 1
    return out


def running_totals(df: DataFrame, groups: list[str], order: list[str], sums: dict[str, Column],
                   rows_per_task: int = 1_000_000) -> DataFrame:
    """Exact inclusive running sums in `order` within each group.

    The sort order is cut into slices of about `rows_per_task` rows, and at least as many as there are shuffle
    partitions: each slice sums on its own and adds the totals of the slices before it. `order` should be unique within
    a group.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(sums)
    sliced = add_slices(df, [*groups, *order], max(least, math.ceil(df.count() / rows_per_task)))
    partial = sliced.groupBy(*groups, SLICE).agg(*[F.sum(sums[n]).alias(f"_total_{n}") for n in names])
    earlier = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = partial.select(
        *groups, SLICE, *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names])
    local = Window.partitionBy(*groups, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.select("*", *[F.sum(sums[n]).over(local).alias(n) for n in names])
    joined = _join_back(summed, offsets, [*groups, SLICE])
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in names])


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`lag(value)` per key for a frame with a `_slice` column that grows with the order.

    A key of any size is handled slice by slice; only one row per (key, slice) crosses slices.
    """
    tagged = df.withColumn("_value", value)
    last = tagged.groupBy(*keys, SLICE).agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    edges = last.select(*keys, SLICE, F.lag("_last").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_edge"))
    local = Window.partitionBy(*keys, SLICE).orderBy(*order)
    lagged = tagged.withColumn(name, F.lag("_value").over(local))
    return _join_back(lagged, edges, [*keys, SLICE]).withColumn(name, F.coalesce(F.col(name), F.col("_edge"))).drop("_value", "_edge")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Last non-null `value` at or before each row of a key, split by `_slice` as in `previous_value`."""
    tagged = df.withColumn("_value", value)
    last = tagged.groupBy(*keys, SLICE).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    edges = last.select(*keys, SLICE, F.last("_last", ignorenulls=True).over(earlier).alias("_edge"))
    local = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = tagged.withColumn(name, F.last("_value", ignorenulls=True).over(local))
    return _join_back(carried, edges, [*keys, SLICE]).withColumn(name, F.coalesce(F.col(name), F.col("_edge"))).drop("_value", "_edge")


def pick_lowest(df: DataFrame, group: str, quotas: dict, mixed: Column, ties: list[str], name: str = "picked",
                rows: int | None = None, rows_in_bucket: int = 50_000) -> DataFrame:
    """Mark exactly `quotas[g]` rows of each group, those with the lowest mixed key.

    Rows are counted per (group, mix bucket); whole buckets below the quota are taken without a shuffle and only the
    single bucket at the quota, about `rows_in_bucket` rows, is sorted. A caller that has counted passes `rows`.
    """
    return pick_several(df, group, {name: quotas}, mixed, ties, rows, rows_in_bucket)


def pick_several(df: DataFrame, group: str, quotas: dict[str, dict], mixed: Column, ties: list[str], rows: int | None = None,
                 rows_in_bucket: int = 50_000) -> DataFrame:
    """`pick_lowest` for several sets of quotas at once, one mark per set: rows are counted once, and the buckets at any
    quota are sorted once."""
    rows = df.count() if rows is None else rows
    tagged = df.withColumn("_mix", mixed)
    buckets = max(16, rows // rows_in_bucket)
    tagged = tagged.withColumn("_bucket", F.floor(F.col("_mix") * F.lit(buckets) / F.lit(MIX_PRIME)))
    counted = tagged.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("_n").over(Window.partitionBy(group))
    reachable = [F.struct(F.lit(name).alias("_name"), F.least(_of_group(wanted, group, 0), F.col("_whole")).alias("_quota")) for name, wanted in quotas.items()]
    filled = counted.select("*", F.sum("_n").over(upto).alias("_upto"), whole.alias("_whole")).select("*", F.inline(F.array(*reachable)))
    cuts = (
        filled.where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select("_name", F.col(group).cast("string"), "_bucket", (F.col("_quota") - (F.col("_upto") - F.col("_n"))).alias("_need")).collect()
    )
    cut = {name: _of_group({c[1]: c[2] for c in cuts if c[0] == name}, group, -1) for name in quotas}
    need = {name: _of_group({c[1]: c[3] for c in cuts if c[0] == name}, group, 0) for name in quotas}
    at_a_cut = F.lit(False)
    for c in cut.values():
        at_a_cut = at_a_cut | (F.col("_bucket") == c)
    settled = tagged.where(~at_a_cut).withColumns({name: F.col("_bucket") < c for name, c in cut.items()})
    place = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_mix", *ties))
    boundary = tagged.where(at_a_cut).withColumn("_place", place).withColumns(
        {name: (F.col("_bucket") < c) | ((F.col("_bucket") == c) & (F.col("_place") <= need[name])) for name, c in cut.items()}).drop("_place")
    return settled.unionByName(boundary).drop("_mix", "_bucket")


def _of_group(pairs: dict, group: str, absent: int) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(pairs), F.col(group).cast("string")), F.lit(absent).cast("bigint"))


def _literal_map(pairs: dict) -> Column:
    """Group name to whole number. Callers pass one entry per class, a set they have already counted."""
    named = {str(k): int(v) for k, v in pairs.items() if k is not None}
    if not named:
        return F.lit(None).cast("map<string,bigint>")
    return F.map_from_arrays(F.array(*[F.lit(k) for k in named]), F.array(*[F.lit(v).cast("bigint") for v in named.values()]))


def group_counts(df: DataFrame, group: str, max_groups: int = 10_000) -> dict:
    """Rows per class on the driver; refuses a column that is not a class label."""
    found = df.groupBy(group).agg(F.count("*").alias("n")).limit(max_groups + 1).collect()
    if len(found) > max_groups:
        raise ValueError(f"column {group!r} has more than {max_groups} distinct values and is no class label")
    return {r[0]: r[1] for r in found}


def _measure(name: str) -> Column:
    value = F.col(f"`{name}`").cast("double") + F.lit(0.0)
    return F.when(~F.isnan(value), value)


SIGN = (1 << 63) - 1


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ SIGN, bits)


def from_bits(bits: int) -> float:
    return float(np.array([bits ^ SIGN if bits < 0 else bits], np.int64).view(np.float64)[0])


def _add_counters(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counters (bucket, cells, lowest, highest) of several lots as one lot, one per bucket."""
    bucket, n, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=bucket[order[0]] - 1)) if len(order) else order
    if not len(order):
        return bucket, n, low, high
    return bucket[order][starts], np.add.reduceat(n[order], starts), np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)


def _count_buckets(wanted: list[np.ndarray], shift: int, held: int):
    """Cells per bucket of 16 further bits, below the wanted prefixes of each column; one lot of counters per column and task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: list[list[tuple[np.ndarray, ...]]] = [[] for _ in wanted]
        for batch in batches:
            for i, prefixes in enumerate(wanted):
                if not len(prefixes):
                    continue
                values = batch.column(i).to_numpy(zero_copy_only=False)
                bits = ordered_bits(values[~np.isnan(values)])
                if shift < 48:
                    bits = bits[np.isin(bits >> (shift + 16), prefixes)]
                bits = np.sort(bits)
                bucket = bits >> shift
                starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)) if len(bits) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(bits)) - 1 if len(bits) else starts
                lots[i].append((bucket[starts], ends - starts + 1, bits[starts], bits[ends]))
                if sum(len(lot[0]) for lot in lots[i]) > held:
                    lots[i] = [_add_counters(lots[i])]
        for i, lot in enumerate(lots):
            if lot:
                bucket, n, low, high = _add_counters(lot)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), i, np.int32)), pa.array(bucket >> 16 if shift < 48 else np.zeros(len(bucket), np.int64)),
                                                  pa.array(bucket), pa.array(n.astype(np.int64)), pa.array(low), pa.array(high)],
                                                 names=["i", "parent", "bucket", "n", "low", "high"])
    return count


def exact_percentiles(df: DataFrame, columns: list[str], probabilities: list[float], rows_per_task: int = 100_000) -> dict[str, list[float | None]]:
    """Linear-interpolated percentiles of each column, nulls and NaN ignored.

    Radix selection on the bits of the doubles, in an order that keeps theirs: a pass counts the cells per bucket of 16
    bits, the next one looks only below the buckets that hold a wanted rank. After at most four passes the bits are the
    value; a bucket whose lowest and highest cell agree is one at once. A task keeps one lot of counters per column, adds
    them up whenever there are more than `rows_per_task`, and sends nothing else; cells never leave their task.
    """
    if not columns:
        return {}
    cells = df.select(*[_measure(c).alias(f"_c{i}") for i, c in enumerate(columns)]).persist()
    try:
        everything = [np.zeros(1, np.int64)] * len(columns)
        top = _counters(cells, everything, 48, rows_per_task).orderBy("i", "bucket").collect()  # at most 65,536 a column
        sizes = [0] * len(columns)
        for r in top:
            sizes[r["i"]] += r["n"]
        ranks = [sorted({r for p in probabilities for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) if n else [] for n in sizes]
        values: dict[tuple[int, int], float] = {}
        open_ = _settle([(i, rank, rank) for i, some in enumerate(ranks) for rank in some], {i: [r for r in top if r["i"] == i] for i in range(len(columns))}, values)
        for shift in (32, 16, 0):
            if not open_:
                break
            open_ = _narrow(cells, open_, shift, len(columns), rows_per_task, values)
    finally:
        cells.unpersist()
    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        result[c] = []
        for p in probabilities:
            place = p * (sizes[i] - 1)
            if sizes[i]:
                low, high = values[i, math.floor(place)], values[i, math.ceil(place)]
                result[c].append(low if low == high else low + (high - low) * (place - math.floor(place)))
            else:
                result[c].append(None)
    return result


def _counters(cells: DataFrame, wanted: list[np.ndarray], shift: int, held: int) -> DataFrame:
    counted = cells.mapInArrow(_count_buckets(wanted, shift, held), "i int, parent bigint, bucket bigint, n bigint, low bigint, high bigint")
    return counted.groupBy("i", "parent", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _settle(targets: list[tuple[int, int, int]], counters: dict, values: dict) -> list[tuple[int, int, int, int]]:
    """Targets (column, rank, place) in sorted counters: known values are noted, the others are (column, rank, bucket, place)."""
    left = []
    for i, rank, place in targets:
        for r in counters[i]:
            if place < r["n"]:
                if r["low"] == r["high"]:
                    values[i, rank] = from_bits(r["low"])
                else:
                    left.append((i, rank, r["bucket"], place))
                break
            place -= r["n"]
    return left


def _narrow(cells: DataFrame, targets: list[tuple[int, int, int, int]], shift: int, width: int, held: int, values: dict) -> list[tuple[int, int, int, int]]:
    """One more pass for the targets whose bucket holds several values."""
    wanted = [np.array(sorted({b for j, _, b, _ in targets if j == i}), np.int64) for i in range(width)]
    sought = cells.sparkSession.createDataFrame(targets, "i int, rank bigint, parent bigint, place bigint")
    upto = F.sum("n").over(Window.partitionBy("i", "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # at most 65,536 buckets
    summed = _counters(cells, wanted, shift, held).withColumn("upto", upto).join(F.broadcast(sought), ["i", "parent"])
    left = []
    for r in summed.where("upto > place AND upto - n <= place").collect():  # one row per target
        if r["low"] == r["high"]:
            values[r["i"], r["rank"]] = from_bits(r["low"])
        else:
            left.append((r["i"], r["rank"], r["bucket"], r["place"] - (r["upto"] - r["n"])))
    return left
