"""Number repair expressions: text coercion, infinities and missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql import functions as F

INF = float("inf")


def to_number(value: Column) -> Column:
    """PRJ-04: number or null; padded text and the usual spellings of infinity are numbers."""
    return value.try_cast("double")


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(INF)


def finite_or_null(value: Column) -> Column:
    """PRJ-05: training policy, infinities and NaN become missing."""
    return F.when(~is_infinite(value) & ~F.isnan(value), value)


def finite_or_zero(value: Column) -> Column:
    """PRJ-10: scoring policy, anything that is not a finite number becomes 0.0."""
    return F.coalesce(finite_or_null(to_number(value)), F.lit(0.0))


def is_missing(name: str, dtype: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def numeric_columns(schema: T.StructType, exclude: set[str] | None = None) -> list[str]:
    skip = exclude or set()
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(schema: T.StructType, exclude: set[str] | None = None) -> list[str]:
    skip = exclude or set()
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def quoted(name: str) -> Column:
    """A column whose name may hold dots or blanks."""
    return F.col(f"`{name}`")
