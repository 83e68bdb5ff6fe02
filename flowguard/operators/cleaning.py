"""Header handling, repair, imputation and alignment of flow tables (PRJ-01 to PRJ-10, PRJ-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.functions.constants import FLOW_FEATURES
from flowguard.functions.numbers import (finite_or_null, finite_or_zero, is_infinite, is_missing, numeric_columns, quoted,
                                         text_columns, to_number)
from flowguard.operators.distributed import exact_percentiles


def strip_names(df: DataFrame) -> DataFrame:
    """PRJ-01."""
    return df.toDF(*[c.strip() for c in df.columns])


def resolve_label(df: DataFrame, label: str = "Label", required: bool = False) -> str | None:
    """PRJ-02: the column whose name equals `label` apart from case."""
    for name in df.columns:
        if name.lower() == label.lower():
            return name
    if required:
        raise ValueError(f"label column {label!r} not found among {df.columns}")
    return None


def coerce_numbers(df: DataFrame, label: str | None) -> DataFrame:
    """PRJ-03 and PRJ-04: trim the label, turn every other text column into numbers."""
    text = set(text_columns(df.schema, {label} if label else set()))
    return df.select(*[
        F.trim(quoted(c).cast("string")).alias(c) if c == label
        else to_number(quoted(c)).alias(c) if c in text
        else quoted(c) for c in df.columns])


def infinite_to_null(df: DataFrame, label: str | None = None) -> DataFrame:
    """PRJ-05: infinities and NaN become missing in numeric columns."""
    numbers = set(numeric_columns(df.schema, {label} if label else set()))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*[
        finite_or_null(quoted(c)).alias(c) if c in numbers and kinds[c] in ("double", "float") else quoted(c) for c in df.columns])


def infinite_total(df: DataFrame) -> DataFrame:
    """PRJ-05: how many infinite cells there are."""
    numbers = numeric_columns(df.schema)
    total = sum((F.count_if(is_infinite(quoted(c))) for c in numbers), F.lit(0).cast("bigint"))
    return df.agg(total.alias("infinite_cells"))


def fill_values(df: DataFrame, columns: list[str], strategy: str, strict: bool = False) -> dict[str, float]:
    """PRJ-06: one fill value per column; an all-null column gets 0.0.

    An unknown strategy means 0.0, or an error with `strict`.
    """
    if strategy == "median":
        found = {c: v[0] for c, v in exact_percentiles(df, columns, [0.5]).items()}
    elif strategy == "mean":
        row = df.agg(*[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first() if columns else {}
        found = {c: row[f"m{i}"] for i, c in enumerate(columns)}
    elif strategy == "zero" or not strict:
        found = dict.fromkeys(columns, 0.0)
    else:
        raise ValueError(f"unknown imputation strategy {strategy!r}")
    return {c: 0.0 if v is None else float(v) for c, v in found.items()}


def impute(df: DataFrame, strategy: str = "median", label: str | None = None, strict: bool = False) -> DataFrame:
    """PRJ-06: fill only the columns that have missing values."""
    numbers = numeric_columns(df.schema, {label} if label else set())
    types = {f.name: f.dataType for f in df.schema.fields}
    if not numbers:
        return df
    gaps = df.agg(*[F.count_if(is_missing(c, types[c])).alias(f"g{i}") for i, c in enumerate(numbers)]).first()
    holed = [c for i, c in enumerate(numbers) if gaps[f"g{i}"]]
    fills = fill_values(df, holed, strategy, strict)
    return df.select(*[
        F.coalesce(F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")), F.lit(fills[c])).alias(c) if c in fills else quoted(c)
        for c in df.columns])


def clean_flows(df: DataFrame, label: str = "Label", strategy: str = "median", drop: list[str] | None = None) -> DataFrame:
    """The whole cleaning pass: names, label, numbers, infinities, imputation, then exact duplicates (PRJ-07)."""
    named = strip_names(df)
    target = resolve_label(named, label)
    kept = drop_columns(named, drop or [])
    repaired = infinite_to_null(coerce_numbers(kept, target), target)
    return impute(repaired, strategy, target).dropDuplicates()


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """PRJ-08: configured columns, when present."""
    return df.drop(*[n for n in names if n in df.columns])


def split_features(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """PRJ-09: the frame with features first and the label last, and the feature names."""
    features = [c for c in df.columns if c != label]
    return df.select(*[quoted(c) for c in features], quoted(label)), features


def align_features(df: DataFrame, expected: list[str] | None = None, keep: list[str] | None = None, check_empty: bool = True) -> DataFrame:
    """PRJ-10: exactly the expected features in order; missing and non-finite values are 0.0."""
    if check_empty and not df.isStreaming and df.isEmpty():
        raise ValueError("no rows to score")
    present = set(df.columns)
    return df.select(
        *[quoted(c) for c in keep or []],
        *[finite_or_zero(quoted(c)).alias(c) if c in present else F.lit(0.0).alias(c) for c in expected or FLOW_FEATURES])


def metadata_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """PRJ-11: names that start with an underscore are metadata, the rest are features."""
    return [c for c in df.columns if c.startswith("_")], [c for c in df.columns if not c.startswith("_")]


# Request defaults per feature, in the order of the feature vector.
REQUEST_DEFAULTS = dict(zip(FLOW_FEATURES, [
    80.0, 120.0, 60.0, 1460.0, 5000.0, 1200.0, 10.0, 40.0, 40.0, 15.0,
    0.0, 1.0, 8192.0, 255.0, 2.0, 20.0, 0.0, 0.0, 0.0, 0.0,
], strict=True))


def fill_request_defaults(df: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """PRJ-15: a field that was not given takes its default."""
    values = defaults or REQUEST_DEFAULTS
    present = set(df.columns)
    return df.select(
        *[quoted(c) for c in df.columns if c not in values],
        *[F.coalesce(quoted(c).cast("double"), F.lit(v)).alias(c) if c in present else F.lit(v).alias(c) for c, v in values.items()])
