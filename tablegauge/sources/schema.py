"""Column kinds and the columns table: schema metadata as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_TEXT = (T.StringType, T.CharType, T.VarcharType)

COLUMNS_TABLE = "dataset string, ordinal int, column string, dtype string, kind string"


def kind(dtype: T.DataType) -> str:
    """numeric, boolean, string, temporal or other."""
    if isinstance(dtype, _INTEGRAL + _FLOATING + (T.DecimalType,)):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, _TEXT):
        return "string"
    if isinstance(dtype, _TEMPORAL):
        return "temporal"
    return "other"


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGRAL)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATING)


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    """Names of the columns of the given kinds, in table order."""
    return [f.name for f in df.schema.fields if kind(f.dataType) in kinds]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "numeric")


def text_columns(df: DataFrame, temporal_as_string: bool = False) -> list[str]:
    """String columns; with temporal_as_string also dates, as an untyped CSV would have them."""
    return columns_of(df, "string", "temporal") if temporal_as_string else columns_of(df, "string")


def missing(df: DataFrame, name: str) -> Column:
    """True where the value is null, or NaN in a floating column."""
    col = F.col(f"`{name}`")
    if is_floating(df.schema[name].dataType):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def known(df: DataFrame, name: str) -> Column:
    """The value with NaN turned into null."""
    col = F.col(f"`{name}`")
    if is_floating(df.schema[name].dataType):
        return F.when(~F.isnan(col), col)
    return col


def require_numeric(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"column {name!r} is not in the table; it has {df.columns}")
    if kind(df.schema[name].dataType) != "numeric":
        raise ValueError(f"column {name!r} is not numeric")


def columns_table(
    spark: SparkSession, tables: dict[str, DataFrame], lower: bool = False
) -> DataFrame:
    """One row per column of each table. Reads schemas only, no data."""
    rows = [
        (name, i, f.name.lower() if lower else f.name, f.dataType.simpleString(), kind(f.dataType))
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, COLUMNS_TABLE)
