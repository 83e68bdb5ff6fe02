"""Validation and profiling of whole tables (DQ-01 to DQ-11, EDA-01 to EDA-09, AGG-07)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowguard.functions.numbers import is_infinite, is_missing, numeric_columns, quoted, text_columns, to_number
from flowguard.operators.distributed import exact_percentiles
from flowguard.session import cut_lineage


def _tall(df: DataFrame, values: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate pass over the table, reshaped to a row per column name."""
    aggregates = [e.alias(f"{m}_{i}") for i, measures in enumerate(values.values()) for m, e in measures.items()]
    wide = df.agg(*aggregates)
    lines = [
        F.struct(F.lit(name).alias("feature"), *[F.col(f"{m}_{i}").alias(m) for m in measures])
        for i, (name, measures) in enumerate(values.items())]
    return wide.select(F.inline(F.array(*lines)))


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def missing_values(df: DataFrame) -> DataFrame:
    """DQ-03: missing cells per column, with the share of rows and whether the column is empty."""
    types = _types(df)
    rows = F.count("*")
    counted = _tall(df, {c: {"missing": F.count_if(is_missing(c, types[c])), "rows": rows} for c in df.columns})
    return counted.select(
        "feature", "missing",
        F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("rows")), F.lit(0.0)).alias("missing_pct"),
        ((F.col("missing") == F.col("rows")) & (F.col("rows") > 0)).alias("is_empty"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """DQ-04: every copy after the first; null equals null."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    rows, extra = F.sum("_n"), F.sum(F.col("_n") - 1)
    return copies.agg(
        F.coalesce(extra, F.lit(0).cast("bigint")).alias("duplicate_rows"),
        F.coalesce(F.try_divide(extra * 100.0, rows), F.lit(0.0)).alias("duplicate_pct"))


def duplicate_names(names: list[str]) -> list[str]:
    """DQ-05 over the raw header."""
    stripped = [n.strip() for n in names]
    return sorted({n for n in stripped if stripped.count(n) > 1})


def duplicate_columns(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, str]]:
    """DQ-06: pairs (kept, copy) of equal numeric columns; a column with a missing value equals none.

    One pass gives every column a fingerprint that copies must share; a second pass compares only
    columns with the same fingerprint row by row. No sample is involved, so nothing is missed.
    """
    names = columns or numeric_columns(df.schema)
    types = _types(df)
    if len(names) < 2:
        return []

    def value(c: str) -> Column:
        return quoted(c).cast("double") + F.lit(0.0)
    prints = df.agg(*[
        F.struct(F.count_if(is_missing(c, types[c])).alias("gaps"), F.min(value(c)).alias("lo"), F.max(value(c)).alias("hi"),
                 F.bit_xor(F.xxhash64(value(c))).alias("x"), F.sum(F.xxhash64(value(c)).cast("decimal(38,0)")).alias("s")).alias(f"f{i}")
        for i, c in enumerate(names)]).first()
    alike: dict[tuple, list[str]] = {}
    for i, c in enumerate(names):
        mark = tuple(prints[f"f{i}"])
        if mark[0] == 0:
            alike.setdefault(mark, []).append(c)
    pairs = [p for group in alike.values() for p in combinations(group, 2)]
    if not pairs:
        return []
    differing = df.agg(*[F.count_if(F.coalesce(value(a) != value(b), F.lit(True))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first()
    found, copies = [], set()
    for i, (a, b) in enumerate(pairs):
        if differing[f"d{i}"] == 0 and a not in copies and b not in copies:
            found.append((a, b))
            copies.add(b)
    return found


def infinite_values(df: DataFrame) -> DataFrame:
    """DQ-07: columns that hold infinities."""
    names = numeric_columns(df.schema)
    return _tall(df, {c: {"infinite": F.count_if(is_infinite(quoted(c)))} for c in names}).where("infinite > 0")


def mixed_text(df: DataFrame, label: str | None = None) -> DataFrame:
    """DQ-08: text columns that are partly numbers, with the cells that are not."""
    names = text_columns(df.schema, {label} if label else set())
    counted = _tall(df, {c: {
        "invalid": F.count_if(to_number(quoted(c)).isNull() & quoted(c).isNotNull()),
        "parsed": F.count(to_number(quoted(c)))} for c in names})
    return counted.where("invalid > 0 AND parsed > 0").select("feature", "invalid")


def constant_columns(df: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """DQ-09 and DQ-10: constant columns (nulls ignored) and numeric columns of low or undefined variance."""
    numbers = set(numeric_columns(df.schema))
    types = _types(df)

    def present(c: str) -> Column:
        return F.when(~is_missing(c, types[c]), quoted(c))
    measures = {}
    for c in df.columns:
        spread = F.var_samp(present(c)) if c in numbers else F.lit(None).cast("double")
        same = F.coalesce(F.min(present(c)) == F.max(present(c)), F.lit(True))
        measures[c] = {"is_constant": same, "variance": F.max(F.lit(None).cast("double")) if c not in numbers else spread,
                       "is_numeric": F.max(F.lit(c in numbers))}
    low = F.col("is_numeric") & ~F.col("is_constant") & (
        F.col("variance").isNull() | F.isnan("variance") | (F.col("variance") < threshold))
    return _tall(df, measures).select("feature", "is_constant", F.coalesce(low, F.lit(False)).alias("is_low_variance"))


def validation_summary(df: DataFrame) -> DataFrame:
    """DQ-01 to DQ-11 as (metric, value)."""
    rows = df.count()
    spark = df.sparkSession
    if rows == 0:
        return spark.createDataFrame([("error: dataset is empty", 0.0)], "metric string, value double")
    gaps = missing_values(df).agg(F.sum("missing").alias("n")).first()["n"]
    copies = duplicate_rows(df).first()
    values = [
        ("total_rows", rows), ("total_columns", len(df.columns)),
        ("duplicate_rows_count", copies["duplicate_rows"]), ("duplicate_rows_percentage", copies["duplicate_pct"]),
        ("missing_values_count", gaps), ("overall_null_percentage", 100.0 * gaps / (rows * len(df.columns))),
        ("constant_features_count", constant_columns(df).where("is_constant").count()),
        ("duplicate_columns_count", len(duplicate_columns(df))),
        ("infinite_values_count", infinite_values(df).agg(F.coalesce(F.sum("infinite"), F.lit(0)).alias("n")).first()["n"]),
    ]
    return spark.createDataFrame([(m, float(v)) for m, v in values], "metric string, value double")


def column_types(df: DataFrame) -> DataFrame:
    """DQ-02."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "feature string, type string")


def type_counts(df: DataFrame) -> DataFrame:
    """DQ-02: columns per type."""
    return column_types(df).groupBy("type").agg(F.count("*").alias("columns"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """AGG-07: count and share per class, and whether the smallest class is below 5 %."""
    counted = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("rows"))
    classes = Window.partitionBy(F.lit(1))
    shares = counted.withColumn("percentage", F.col("rows") * 100.0 / F.sum("rows").over(classes))
    return shares.withColumn("imbalanced", F.min("percentage").over(classes) < 5.0)


def feature_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """EDA-01 and SRT-02: nine statistics per feature, largest variance first; undefined becomes 0."""
    cuts = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
    types = _types(df)

    def present(c: str) -> Column:
        return F.when(~is_missing(c, types[c]), quoted(c).cast("double"))
    moments = _tall(df, {c: {
        "mean": F.avg(present(c)), "std": F.stddev_samp(present(c)), "min": F.min(present(c)),
        "p25": F.max(F.lit(cuts[c][0])), "p50": F.max(F.lit(cuts[c][1])), "p75": F.max(F.lit(cuts[c][2])),
        "max": F.max(present(c)), "variance": F.var_samp(present(c))} for c in columns})
    zeroed = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(c) for c in moments.columns if c != "feature"]
    return moments.select("feature", *zeroed).orderBy(F.col("variance").desc(), "feature")


def key_features(statistics: DataFrame, top: int = 6, least: float = 1e-5) -> DataFrame:
    """FIL-12 and SRT-06 over `feature_statistics`."""
    return statistics.where(F.col("variance") > least).orderBy(F.col("variance").desc(), "feature").limit(top)


def top_variance_correlations(df: DataFrame, columns: list[str], top: int = 20, least: float = 1e-5) -> DataFrame:
    """SRT-06: correlations among the columns of largest variance."""
    leaders = [r["feature"] for r in key_features(feature_statistics(df, columns), top, least).collect()]
    return matrix_table(df, pearson_matrix(df, leaders))


def iqr_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float, float]]:
    """Quartiles and the strict outlier bounds per column."""
    bounds = {}
    for c, (q1, q3) in exact_percentiles(df, columns, [0.25, 0.75]).items():
        nan = float("nan")
        bounds[c] = (nan, nan, nan, nan) if q1 is None else (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return bounds


def iqr_outliers(df: DataFrame, columns: list[str], whiskers: bool = False) -> DataFrame:
    """EDA-02, and with `whiskers` EDA-07: quartiles, outliers, extreme values inside the bounds."""
    bounds = iqr_bounds(df, columns)
    types = _types(df)
    measures = {}
    for c in columns:
        q1, q3, low, high = bounds[c]
        value = F.when(~is_missing(c, types[c]), quoted(c).cast("double"))
        measures[c] = {
            "outliers": F.count_if((value < low) | (value > high)), "rows": F.count("*"),
            "q1": F.max(F.lit(q1)), "q3": F.max(F.lit(q3)), "iqr": F.max(F.lit(q3 - q1))}
        if whiskers:
            inside = F.when((value >= low) & (value <= high), value)
            measures[c] |= {"whisker_low": F.min(inside), "whisker_high": F.max(inside)}
    extra = ["whisker_low", "whisker_high"] if whiskers else []
    return _tall(df, measures).select(
        "feature", "outliers", F.coalesce(F.try_divide(F.col("outliers") * 100.0, F.col("rows")), F.lit(0.0)).alias("outlier_pct"),
        "q1", "q3", "iqr", *extra)


def _present(c: str, types: dict[str, T.DataType]) -> Column:
    return F.when(~is_missing(c, types[c]), quoted(c).cast("double") + F.lit(0.0))


def pearson_matrix(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """EDA-03: correlation of every pair (upper triangle) over all rows where both are present; null where undefined.

    Each task adds up products of whole column blocks, once for all pairs: with absent values set to zero and their
    absence kept as a second block, the products give every pair its own count, sums and squares. A task sends one row
    per pair. Values are shifted by their column's mean first, so large offsets cost no digits.
    """
    k, types = len(columns), _types(df)
    if k < 2:
        return {}
    values = df.select(*[_present(c, types).alias(f"v{i}") for i, c in enumerate(columns)])
    means = values.agg(*[F.avg(F.when(~is_infinite(F.col(f"v{i}")), F.col(f"v{i}"))).alias(f"m{i}") for i in range(k)]).first()
    shift = np.array([means[f"m{i}"] or 0.0 for i in range(k)])
    first, second = np.triu_indices(k, 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares, products, infinite = (np.zeros((k, k)) for _ in range(5))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = (~np.isnan(x)).astype(float)
            endless = np.isinf(x)
            x = np.where((there > 0) & ~endless, x - shift, 0.0)
            n += there.T @ there
            sums += x.T @ there
            squares += (x * x).T @ there
            products += x.T @ x
            infinite += endless.T.astype(float) @ there
        parts = [n[first, second], sums[first, second], sums[second, first], squares[first, second], squares[second, first], products[first, second],
                 infinite[first, second] + infinite[second, first]]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), *(pa.array(p) for p in parts)],
                                         names=["i", "j", "n", "a", "b", "aa", "bb", "ab", "endless"])

    added = values.mapInArrow(add, "i int, j int, n double, a double, b double, aa double, bb double, ab double, endless double")
    rows = added.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab", "endless")]).collect()  # one row per pair
    found: dict[tuple[str, str], float | None] = dict.fromkeys(combinations(columns, 2))
    for r in rows:
        left, right = r["n"] * r["aa"] - r["a"] ** 2, r["n"] * r["bb"] - r["b"] ** 2
        flat = left <= 1e-12 * r["n"] * r["aa"] or right <= 1e-12 * r["n"] * r["bb"]
        if not r["endless"] and not flat:
            found[columns[r["i"]], columns[r["j"]]] = max(-1.0, min(1.0, (r["n"] * r["ab"] - r["a"] * r["b"]) / math.sqrt(left * right)))
    return found


#: Entries of the rank tables that every task may hold: values times gap patterns, over all columns of few values.
MOST_RANKS = 4_000_000
#: Bytes of rows that a task sorts at once when a column of many values is ranked.
SORTED_BYTES = 16 << 20


def spearman_matrix(df: DataFrame, columns: list[str], rows_per_task: int = 1_000_000, few_values: int = 1_000_000) -> dict[tuple[str, str], float | None]:
    """EDA-04: correlation of average ranks, for every pair over the rows where both are present.

    A column's ranks within a pair depend on the other column only through its gaps, so a column has one rank for each
    column with gaps. Columns of few values, whose rank tables together have at most `MOST_RANKS` entries, are looked up
    where the rows lie. For the others the rows are sorted by one column after the other, see `_products_of_many`. Products
    of all pairs are added up per task.
    """
    k, types = len(columns), _types(df)
    if k < 2:
        return {}
    names = [f"v{i}" for i in range(k)]
    base = df.select(*[_present(c, types).alias(n) for c, n in zip(columns, names)])
    seen = base.agg(F.count("*").alias("rows"), *[F.struct(F.count(n).alias("n"), F.approx_count_distinct(n).alias("values")).alias(n) for n in names]).first()
    holed = [i for i in range(k) if seen[names[i]]["n"] < seen["rows"]]
    slot = np.array([1 + holed.index(i) if i in holed else 0 for i in range(k)])  # slot 0 counts all rows
    width = len(holed) + 1
    few, held = [], 0
    for i in sorted(range(k), key=lambda i: seen[names[i]]["values"]):
        held += seen[names[i]]["values"] * width
        if seen[names[i]]["values"] <= few_values and held <= MOST_RANKS:
            few.append(i)
    many = [i for i in range(k) if i not in few]
    counts = [f"n{s}" for s in range(width)]
    tables = {}
    if few:
        known = base.mapInArrow(_count_values(few, holed), ", ".join(["i int, v double", *[f"{c} bigint" for c in counts]]))
        for i, part in known.groupBy("i", "v").agg(*[F.sum(c).alias(c) for c in counts]).orderBy("i", "v").toPandas().groupby("i"):
            n = part[counts].to_numpy(float)
            tables[i] = (part["v"].to_numpy(), n.cumsum(axis=0) - (n - 1) / 2 - (n.sum(axis=0) + 1) / 2)
    added = base.mapInArrow(_rank_products(k, df.sparkSession.sparkContext.broadcast(tables), slot, width), "i int, j int, ab double, aa double, bb double")
    if many:
        added = added.unionByName(_products_of_many(base, many, holed, slot, tables, seen["rows"], rows_per_task))
    found: dict[tuple[str, str], float | None] = dict.fromkeys(combinations(columns, 2))
    for r in added.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("ab", "aa", "bb")]).collect():  # one row per pair
        scale = math.sqrt(r["aa"] * r["bb"])
        found[columns[r["i"]], columns[r["j"]]] = r["ab"] / scale if scale else None
    return found


def _count_values(wanted: list[int], holed: list[int]):
    """Per batch and wanted column: how often each value occurs in all rows and in those where each column with gaps is present."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = ~np.isnan(x)
            beside = np.column_stack([np.ones(len(x), np.int64), there[:, holed].astype(np.int64)])
            for i in wanted:
                order = np.flatnonzero(there[:, i])
                yield _value_batch(i, *_summed(x[order, i], beside[order]))
    return count


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the sums of their counts."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")
    values = values[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[starts], np.add.reduceat(counts[order], starts, axis=0)


def _value_batch(i: int, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(values), i, np.int32)), pa.array(values), *[pa.array(np.ascontiguousarray(c)) for c in counts.T]]
    return pa.RecordBatch.from_arrays(columns, names=["i", "v", *[f"n{s}" for s in range(counts.shape[1])]])


@dataclass
class _Ranking:
    """What every task knows of the columns of many values (`many`): the cuts between their slices, and per slot how many rows
    are below each slice, in it, and in all. Slice 2p + 1 holds the value of cut p alone, slice 2p what lies before it.

    `tables` are the rank tables of the other columns, whose codes (places in their table, from 1) are packed into whole
    numbers: `packed` gives each one's (number, factor, size).
    """
    many: list[int]
    slot: np.ndarray
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    packed: dict[int, tuple[int, int, int]]
    rank: str
    cuts: list[np.ndarray]
    below: list[np.ndarray]
    inside: list[np.ndarray]

    def record(self, step: int) -> np.dtype:
        """A row on its way to the sort by column `step`: codes, marks of the present ones of `many`, values of the columns still
        to come, and for those the ranks of the columns before. Ranks are centred and doubled, so they are whole; 0 where absent."""
        left = len(self.many) - step
        numbers = 1 + max((n for n, _, _ in self.packed.values()), default=-1)
        return np.dtype([("codes", "<i8", (numbers,)), ("there", "u1", (-(-len(self.many) // 8),)), ("v", "<f8", (left,)), ("r", self.rank, (step, left))])

    def slices(self, step: int, values: np.ndarray) -> np.ndarray:
        cuts = self.cuts[step]
        place = np.searchsorted(cuts, values)
        return 2 * place + (np.append(cuts, np.nan)[place] == values)

    def sent(self, step: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that still meet a column, and the partition of each for the sort by column `step`. Absent values and values of a
        cut are ranked without a sort, so these rows are spread by their content."""
        v = rows["v"]
        rows = rows[~np.isnan(v).all(axis=1)]
        at = self.slices(step, rows["v"][:, 0])
        words = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).astype(np.uint32)
        mixed = (words * (np.arange(words.shape[1], dtype=np.uint32) * np.uint32(2654435761) + np.uint32(40503))).sum(axis=1, dtype=np.uint32)
        alone = np.isnan(rows["v"][:, 0]) | (at % 2 == 1)
        return rows, np.where(alone, (mixed ^ (mixed >> 15)) & 0x7FFFFFFF, at // 2).astype(np.int32)


def _products_of_many(base: DataFrame, many: list[int], holed: list[int], slot: np.ndarray, tables: dict, rows: int, rows_per_task: int) -> DataFrame:
    """Sums of products of centred ranks for all pairs with a column of many values.

    Cuts from quantiles part the values of such a column into slices of about equal rows, and a value that fills a slice is a cut
    itself. One pass counts the rows per slice and slot. Then the rows move once per column to the tasks of its slices, are
    sorted there and ranked from the counts; a row carries codes, the values of the columns to come, and its ranks that pair
    with them. So no rank returns to a row by a join, and neither counts nor ranks of single values are moved.
    """
    spark, width = base.sparkSession, len(holed) + 1
    packed, room = {}, []
    for i, (values, _) in sorted(tables.items()):
        size = len(values) + 1
        if not room or room[-1] * size >= 1 << 62:
            room.append(1)
        packed[i], room[-1] = (len(room) - 1, room[-1], size), room[-1] * size
    ranking = _Ranking(many, slot, tables, packed, "<i4" if 2 * rows < 1 << 31 else "<i8", [], [], [])
    widest = max(ranking.record(step).itemsize for step in range(len(many)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * widest // SORTED_BYTES), -(-rows // rows_per_task))
    asked = F.lit([(p + 1) / parts for p in range(parts - 1)]) if parts > 1 else F.lit([0.5])
    cuts = base.agg(*[F.percentile_approx(f"v{i}", asked, max(10_000, 10 * parts)).alias(f"v{i}") for i in many]).first()
    ranking.cuts = [np.unique(np.array(cuts[f"v{i}"] or [], float)) for i in many]
    counts = [f"n{s}" for s in range(width)]
    counted = base.mapInArrow(_count_slices(ranking, holed), ", ".join(["i int, v double", *[f"{c} bigint" for c in counts]]))
    found = counted.groupBy("i", "v").agg(*[F.sum(c).alias(c) for c in counts]).toPandas()  # a few rows per column and task
    for step, i in enumerate(many):
        n = np.zeros((2 * len(ranking.cuts[step]) + 1, width), np.int64)
        mine = found[found["i"] == i]
        n[mine["v"].to_numpy(int)] = mine[counts].to_numpy(np.int64)
        ranking.below.append(np.concatenate([np.zeros((1, width), np.int64), n.cumsum(axis=0)]))
        ranking.inside.append(n)
    shared = spark.sparkContext.broadcast(ranking)
    schema = "part int, record binary, i int, j int, ab double, aa double, bb double"
    moved = base.mapInArrow(_records(shared), schema)
    for step in range(len(many)):
        moved = moved.repartitionById(parts, "part").mapInArrow(_ranked_by(shared, step), schema)
    return moved.where("record IS NULL").select("i", "j", "ab", "aa", "bb")


def _count_slices(ranking: _Ranking, holed: list[int]):
    """Per task, column of many values and slice: its rows, in all and where each column with gaps is present."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros((len(holed) + 1, 2 * len(cuts) + 1), np.int64) for cuts in ranking.cuts]
        for batch in batches:
            x = _matrix(batch)
            there = ~np.isnan(x)
            for step, i in enumerate(ranking.many):
                held = np.flatnonzero(there[:, i])
                at = ranking.slices(step, x[held, i])
                n[step][0] += np.bincount(at, minlength=n[step].shape[1])
                for s, j in enumerate(holed, 1):
                    n[step][s] += np.bincount(at[there[held, j]], minlength=n[step].shape[1])
        for step, i in enumerate(ranking.many):
            some = np.flatnonzero(n[step][0])
            yield _value_batch(i, some.astype(float), n[step][:, some].T)
    return count


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)


def _records(shared: Broadcast):
    """The rows as records on their way to the sort by the first column of many values."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = shared.value
        for batch in batches:
            x = _matrix(batch)
            rows = np.zeros(len(x), ranking.record(0))
            for i, (number, factor, _) in ranking.packed.items():
                held = np.flatnonzero(~np.isnan(x[:, i]))
                rows["codes"][held, number] += factor * (1 + np.searchsorted(ranking.tables[i][0], x[held, i]))
            rows["v"] = x[:, ranking.many]
            rows["there"] = np.packbits(~np.isnan(rows["v"]), axis=1)
            yield _sent_batch(*ranking.sent(0, rows))
    return make


def _sent_batch(rows: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.dtype.itemsize))
    record = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(rows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part), record, *[pa.nulls(len(rows), t) for t in (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())]],
                                      names=["part", "record", "i", "j", "ab", "aa", "bb"])


#: Records that are sent on at once.
SENT = 1 << 16


def _ranked_by(shared: Broadcast, step: int):
    """Ranks the records of a task by one column, adds up their products with the columns known so far, and sends them on to the next.
    Sums that reach the task pass through. Only records whose rank needs the sort are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = shared.value
        kind, sums, held = ranking.record(step), {}, []
        for batch in batches:
            done = batch.filter(pc.is_null(batch.column(1)))
            if len(done):
                yield done
            records = batch.column(1).drop_null()
            if not len(records):
                continue
            offsets = np.frombuffer(records.buffers()[1], np.int32)[records.offset:records.offset + len(records) + 1]
            rows = np.frombuffer(records.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].copy().view(kind)
            at = ranking.slices(step, rows["v"][:, 0])
            alone = np.isnan(rows["v"][:, 0]) | (at % 2 == 1)
            held.append(rows[~alone])
            if alone.any():
                yield from _ranked(ranking, step, rows[alone], at[alone], sums)
        if held:
            rows = np.concatenate(held)
            held.clear()
            rows = rows[np.argsort(rows["v"][:, 0], kind="stable")]
            yield from _ranked(ranking, step, rows, ranking.slices(step, rows["v"][:, 0]), sums)
        if sums:
            i, j = (pa.array([pair[e] for pair in sums], pa.int32()) for e in (0, 1))
            part = pa.array(np.arange(len(sums), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part, pa.nulls(len(sums), pa.binary()), i, j, *[pa.array([float(s[e]) for s in sums.values()]) for e in range(3)]],
                                             names=["part", "record", "i", "j", "ab", "aa", "bb"])
    return run


def _ranked(ranking: _Ranking, step: int, rows: np.ndarray, at: np.ndarray, sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The records after the sort by column `step`. They come in order of that column, or are the only ones of slices of one value or absent."""
    many, me = ranking.many, ranking.many[step]
    v, marks = rows["v"][:, 0], np.unpackbits(rows["there"], axis=1, count=len(many)).astype(bool)
    mine = np.flatnonzero(marks[:, step])
    at, sorted_ = at[mine], len(mine) > 0 and at[mine[0]] % 2 == 0
    if sorted_:
        # Rows of one value, where they begin and end, and where their slice begins.
        first = np.flatnonzero(np.append(True, v[mine][1:] != v[mine][:-1]))
        ends = np.append(first[1:], len(mine))
        group = np.repeat(np.arange(len(first)), ends - first)
        opened = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        begun = opened[np.searchsorted(opened, first, side="right") - 1]

    def rank(there: np.ndarray, s: int) -> np.ndarray:
        """Twice the centred rank of the present rows within slot `s`; 0 where the slot's column is absent."""
        whole = ranking.below[step][-1, s]
        if sorted_:
            upto = np.append(0, np.cumsum(there))
            found = (2 * (ranking.below[step][at[first], s] + upto[first] - upto[begun]) + upto[ends] - upto[first] - whole)[group]
        else:
            found = 2 * ranking.below[step][at, s] + ranking.inside[step][at, s] - whole
        return np.where(there, found, 0)

    def add(other: int, a: np.ndarray, b: np.ndarray) -> None:
        pair = min(me, other), max(me, other)
        sums[pair] = sums.get(pair, np.zeros(3)) + np.array([a @ b, a @ a, b @ b])

    for i, (number, factor, size) in ranking.packed.items():
        code = rows["codes"][mine, number] // factor % size
        theirs = np.append(0.0, ranking.tables[i][1][:, ranking.slot[me]])[code]
        add(i, rank(code > 0, ranking.slot[i]) / 2.0, theirs)
    for t in range(step):
        add(many[t], rank(marks[mine, t], ranking.slot[many[t]]) / 2.0, rows["r"][mine, t, 0] / 2.0)
    if step + 1 == len(many):
        return
    onward = np.zeros(len(rows), ranking.record(step + 1))
    onward["codes"], onward["there"], onward["v"], onward["r"][:, :step] = rows["codes"], rows["there"], rows["v"][:, 1:], rows["r"][:, :, 1:]
    for u in range(step + 1, len(many)):
        onward["r"][mine, step, u - step - 1] = rank(marks[mine, u], ranking.slot[many[u]])
    for start in range(0, len(rows), SENT):
        yield _sent_batch(*ranking.sent(step + 1, onward[start:start + SENT]))


def _rank_products(k: int, shared: Broadcast, slot: np.ndarray, width: int):
    """Sums of products of centred ranks over the rows of a task, for all pairs of columns with a rank table at once."""
    first, second = np.triu_indices(k, 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        products, squares = np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            x = _matrix(batch)
            there = ~np.isnan(x)
            step = max(1, (1 << 21) // (k * k))
            for at in range(0, len(x), step):
                n = min(step, len(x) - at)
                block = np.zeros((n, k, k))
                for i in tables:
                    mine = np.zeros((n, width))
                    held = np.flatnonzero(there[at:at + n, i])
                    mine[held] = tables[i][1][np.searchsorted(tables[i][0], x[at + held, i])]
                    block[:, i, :] = mine[:, slot]
                both = there[at:at + n, :, None] & there[at:at + n, None, :]
                block *= both
                products += np.einsum("nij,nji->ij", block, block)
                squares += np.einsum("nij,nij->ij", block, block)
        some = np.isin(first, list(tables)) & np.isin(second, list(tables))
        i, j = first[some], second[some]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(products[i, j]), pa.array(squares[i, j]),
                                          pa.array(squares[j, i])], names=["i", "j", "ab", "aa", "bb"])
    return add


def matrix_table(df: DataFrame, matrix: dict[tuple[str, str], float | None]) -> DataFrame:
    rows = [(a, b, None if v is None or math.isnan(v) else float(v)) for (a, b), v in matrix.items()]
    return df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, coefficient double")


def strong_pairs(matrix: DataFrame, threshold: float = 0.90) -> DataFrame:
    """EDA-05: pairs beyond the threshold, strongest first, with their sign."""
    return matrix.where(F.abs("coefficient") > threshold).orderBy(F.abs("coefficient").desc(), "feature_1", "feature_2")


def value_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    types = _types(df)
    wide = [F.struct(F.min(F.when(~is_missing(c, types[c]), quoted(c).cast("double"))).alias("lo"),
                     F.max(F.when(~is_missing(c, types[c]), quoted(c).cast("double"))).alias("hi")).alias(f"x{i}") for i, c in enumerate(columns)]
    row = df.agg(*wide).first()
    return {c: (row[f"x{i}"]["lo"], row[f"x{i}"]["hi"]) for i, c in enumerate(columns)}


def histogram(df: DataFrame, columns: list[str], bins: int = 30, split: Column | None = None) -> DataFrame:
    """EDA-06: equal-width bins per feature, the last one closed; optionally split by a group.

    A cell becomes one number, its feature and bin; they are counted before anything is shuffled and named afterwards.
    """
    ranges = {c: r for c, r in value_ranges(df, columns).items() if r[0] is not None}
    types = _types(df)
    group = split if split is not None else F.lit("all")
    codes, names = [], []
    for i, (c, (low, high)) in enumerate(ranges.items()):
        value = quoted(c).cast("double")
        width = (high - low) / bins
        place = F.least(F.lit(bins - 1), F.floor((value - low) / width)).cast("int") if width else F.lit(0)
        codes.append(F.when(~is_missing(c, types[c]), F.lit(i * bins) + place))
        names.append(F.struct(F.lit(c).alias("feature"), F.lit(low).alias("low"), F.lit(width).alias("width")))
    if not codes:
        return df.sparkSession.createDataFrame([], f"part {df.select(group).schema[0].dataType.simpleString()}, feature string, bin int, bin_start double, bin_end double, rows bigint")
    counted = df.select(group.alias("part"), F.explode(F.array(*codes)).alias("code")).where("code IS NOT NULL").groupBy("part", "code").agg(F.count("*").alias("rows"))
    named = counted.select("part", F.get(F.array(*names), F.expr(f"code div {bins}").cast("int")).alias("c"), (F.col("code") % bins).alias("bin"), "rows")
    return named.select(
        "part", "c.feature", "bin", (F.col("c.low") + F.col("bin") * F.col("c.width")).alias("bin_start"),
        (F.col("c.low") + (F.col("bin") + 1) * F.col("c.width")).alias("bin_end"), "rows")


def density(df: DataFrame, columns: list[str], bins: int = 30, points: int = 50, split: Column | None = None) -> DataFrame:
    """EDA-08: Gaussian-smoothed density on a grid, from the histogram; bandwidth by Scott's rule.

    The smoothing works on at most `bins` rows per feature and part, whatever the table size.
    """
    bars = histogram(df, columns, bins, split).withColumn("centre", (F.col("bin_start") + F.col("bin_end")) / 2)
    bars = cut_lineage(bars)
    spread = bars.groupBy("part", "feature").agg(
        F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("centre")).alias("s1"),
        F.sum(F.col("rows") * F.col("centre") * F.col("centre")).alias("s2"),
        F.min("bin_start").alias("lo"), F.max("bin_end").alias("hi"))
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) ** 2))
    shaped = spread.withColumn("bandwidth", deviation * F.pow("n", F.lit(-0.2))).where("bandwidth > 0")
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    grid = shaped.select("part", "feature", "n", "bandwidth", F.posexplode(
        F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * step)).alias("point", "x"))
    z = (F.col("x") - F.col("centre")) / F.col("bandwidth")
    kernel = F.col("rows") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))
    return grid.join(bars.select("part", "feature", "centre", "rows"), ["part", "feature"]).groupBy(
        "part", "feature", "point", "x").agg(F.sum(kernel).alias("density"))


def missingness_matrix(df: DataFrame, key: list[str], rows: int | None = None, fallback: int = 15) -> DataFrame:
    """EDA-09: null flags per row; columns with gaps, else the first fifteen.

    Every row by default; `rows` asks for a repeatable sample of a picture's size.
    """
    gaps = [r["feature"] for r in missing_values(df.drop(*key)).where("missing > 0").collect()]
    shown = gaps or [c for c in df.columns if c not in key][:fallback]
    types = _types(df)
    sample = df if rows is None else df.orderBy(F.xxhash64(*key), *key).limit(rows)
    return sample.select(*key, *[is_missing(c, types[c]).alias(c) for c in shown])
