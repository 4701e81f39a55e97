"""Join helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.session import keep

# a fitted table of more rows or bytes than this is joined by shuffle
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def fits_broadcast(kept: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be sent to every executor, by its rows and the bytes of its cells."""
    cells = F.octet_length(F.to_json(F.struct("*"))) + 16 * len(kept.columns)
    found = kept.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(cells), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= rows and found["bytes"] <= size


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False
) -> DataFrame:
    """Equi-join on `keys` where null equals null, keeping one copy of the keys.

    `small` asks for a broadcast; callers set it only for a right side whose row
    count is fixed by parameters, not by the data.
    """
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    if small:
        renamed = F.broadcast(renamed)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def join_fitted(
    df: DataFrame, fitted: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a large table with statistics fitted per key, without shuffling it if they are small.

    Runs one job: the statistics are written to the shared folder and measured. Up to
    `limit` rows and BROADCAST_BYTES they are broadcast; beyond it the join is a shuffle
    join, where adaptive execution splits a key that holds many rows.
    """
    kept = keep(fitted)
    return join_null_safe(df, kept, keys, how, small=fits_broadcast(kept, limit))


def one_row(df: DataFrame):
    """The single row of `df` as a struct column for use in another table's expressions.

    Planned as a scalar subquery, so a fitted statistic needs no join.
    """
    return df.selectExpr("struct(*) AS _fit").scalar()
