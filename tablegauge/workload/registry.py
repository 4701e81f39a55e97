"""Registration of queries and small helpers to shape their output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.session import prepare
from tablegauge.sources.schema import kind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The test tables of one folder, read on first use: `t.orders`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register `fn(t)` under `name`; `sql` is the equivalent statement for the check."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(prepare(spark), folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def plain(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles and print dates as text, so results compare across engines."""
    out = []
    for f in df.schema.fields:
        c, name = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if name in ("double", "float"):
            out.append((F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name))
        elif name == "date":
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif kind(f.dataType) == "temporal":
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        elif name in ("int", "smallint", "tinyint"):
            out.append(c.cast("long").alias(f.name))
        elif name.startswith("array"):
            out.append(F.concat_ws(",", c).alias(f.name))
        else:
            out.append(c.alias(f.name))
    return df.select(*out)
