"""Running totals and ranks that do not put a busy key's rows into one task.

A plain window over `partitionBy(key).orderBy(t)` sends every row of a key to one
task, which is right for keys of ordinary size. Keys with more than BUSY_ROWS rows
are counted out first and cut into chunks that follow the sort order: chunk totals
are summed with partial aggregation, a short window over the totals gives every
chunk its starting value, and only the rows of one chunk are sorted together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.plans.joins import fits_broadcast, join_null_safe
from tablegauge.session import keep

# a key with more rows than this is cut into chunks
BUSY_ROWS = 2_000_000

# Steps per factor e of magnitude: a bin is about 0.025 % wide at any scale.
BIN_STEPS = 4096
# ln of the smallest positive double is about -744.4; the shift keeps bins positive.
BIN_SHIFT = 746.0


def value_bin(value: Column, steps: int = BIN_STEPS) -> Column:
    """A whole number that never decreases along Spark's ascending order, fine at every scale.

    Null comes first and NaN last, as in that order.
    """
    # infinite values stay between the finite ones and the ends
    size = F.least(F.floor((F.ln(F.abs(value)) + BIN_SHIFT) * steps), F.lit(1 << 59))
    return (
        F.when(value.isNull(), F.lit(-(1 << 60)))
        .when(F.isnan(value.cast("double")), F.lit(1 << 60))
        .when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")
    )


def by_load(
    df: DataFrame,
    keys: Sequence[str],
    plain: Callable[[DataFrame], DataFrame],
    chunked: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """`plain` for keys of ordinary size and `chunked` for busy ones, together.

    Runs one job that counts rows per key. The busy keys, at most rows / BUSY_ROWS, part the
    two sides; they are broadcast only if their bytes fit.
    """
    if not keys:
        return chunked(df)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    busy = keep(counts.filter(F.col("_rows") > BUSY_ROWS).select(*keys))
    if busy.isEmpty():
        return plain(df)
    small = fits_broadcast(busy)
    calm = join_null_safe(df, busy, keys, "left_anti", small=small)
    loud = join_null_safe(df, busy, keys, "left_semi", small=small)
    return plain(calm).unionByName(chunked(loud))


def cut(df: DataFrame, keys: Sequence[str], chunk: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """Add `_cut`, a struct of keys and chunk columns, and return the chunk names.

    One struct serves as window partition and as join key, so the rows are shuffled
    once for both. Null keys stay: structs with equal fields are equal, nulls too.
    """
    names = [f"_chunk{i}" for i in range(len(chunk))]
    parts = [F.col(k).alias(k) for k in keys] + [c.alias(n) for c, n in zip(chunk, names)]
    return df.withColumn("_cut", F.struct(*parts)), names


def _earlier_chunks(keys: Sequence[str], names: Sequence[str]):
    return (
        Window.partitionBy(*[f"_cut.{k}" for k in keys])
        .orderBy(*[f"_cut.{n}" for n in names])
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def chunk_starts(tagged: DataFrame, keys: Sequence[str], names: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """(_cut, _s_<c>): totals of all earlier chunks of the key, from map-side combined chunk totals."""
    totals = tagged.groupBy("_cut").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = _earlier_chunks(keys, names)
    return totals.select(
        "_cut",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums],
    )


def add_totals(rows: DataFrame, starts: DataFrame, order: Sequence[Column], sums: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """`keep` and `<c>_upto` of rows that carry `_cut`: start of the chunk + running sum inside it."""
    inside = Window.partitionBy("_cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inside).alias(f"_l_{c}") for c in sums])
    return local.join(starts, "_cut").select(
        *keep, *[(F.col(f"_s_{c}") + F.col(f"_l_{c}")).alias(f"{c}_upto") for c in sums]
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[Column],
    order: Sequence[Column],
    sums: Sequence[str],
) -> DataFrame:
    """Add `<c>_upto`, the running total of each column in `sums`, row by row.

    `chunk` must not decrease along `order`. Rows should be unique in (keys, order).
    """

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return part.select("*", *[F.sum(c).over(w).alias(f"{c}_upto") for c in sums])

    def chunked(part: DataFrame) -> DataFrame:
        tagged, names = cut(part, keys, chunk)
        return add_totals(tagged, chunk_starts(tagged, keys, names, sums), order, sums, df.columns)

    return by_load(df, keys, plain, chunked)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[Column],
    order: Sequence[Column],
    carried: str,
) -> DataFrame:
    """Add `<carried>_last`: the latest non-null `carried` at or before each row."""

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return part.withColumn(f"{carried}_last", F.last(carried, ignorenulls=True).over(w))

    def chunked(part: DataFrame) -> DataFrame:
        tagged, names = cut(part, keys, chunk)
        tagged = tagged.withColumn("_order", F.struct(*order))
        ends = tagged.groupBy("_cut").agg(
            F.max_by(carried, F.when(F.col(carried).isNotNull(), F.col("_order"))).alias("_end")
        )
        before = _earlier_chunks(keys, names)
        starts = ends.select("_cut", F.last("_end", ignorenulls=True).over(before).alias("_from"))
        inside = Window.partitionBy("_cut").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
        local = tagged.withColumn("_here", F.last(carried, ignorenulls=True).over(inside))
        return local.join(starts, "_cut").select(
            *df.columns, F.coalesce("_here", "_from").alias(f"{carried}_last")
        )

    return by_load(df, keys, plain, chunked)


def ordered_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tiebreak: str,
    sums: Sequence[str],
    tie_block: int = 65536,
    bin_of=value_bin,
) -> DataFrame:
    """Add `<c>_upto`, running totals by (value, tiebreak) within `keys`.

    Equal values are first summed as one row, so a value shared by a third of all
    rows costs no more than any other; its rows are then added up in blocks of the
    integer tiebreak.
    """
    keys = list(keys)

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(value, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
        return part.select("*", *[F.sum(c).over(w).alias(f"{c}_upto") for c in sums])

    def chunked(part: DataFrame) -> DataFrame:
        per_value = part.groupBy(*keys, value).agg(*[F.sum(c).alias(f"_v_{c}") for c in sums])
        placed = running_totals(
            per_value, keys, [bin_of(F.col(value))], [F.col(value)], [f"_v_{c}" for c in sums]
        )
        below = placed.select(
            *keys, value, *[(F.col(f"_v_{c}_upto") - F.col(f"_v_{c}")).alias(f"_below_{c}") for c in sums]
        )
        within = running_totals(
            part, [*keys, value], [F.floor(F.col(tiebreak) / F.lit(tie_block))], [F.col(tiebreak)], sums
        )
        joined = join_null_safe(within, below, [*keys, value])
        return joined.select(
            *df.columns, *[(F.col(f"_below_{c}") + F.col(f"{c}_upto")).alias(f"{c}_upto") for c in sums]
        )

    return by_load(df, keys, plain, chunked)


def rank_rows(
    df: DataFrame, value: str, tiebreak: str, keys: Sequence[str] = (), tie_block: int = 65536, bin_of=value_bin
) -> DataFrame:
    """Add `row_rank`, the 1-based position by (value, tiebreak) within `keys`."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    out = ordered_totals(ones, keys, value, tiebreak, ["_one"], tie_block, bin_of)
    return out.select(*df.columns, F.col("_one_upto").alias("row_rank"))


def ntile_of(rank: Column, n: Column, tiles: int) -> Column:
    """SQL ntile from a 1-based rank and the row count: the first n mod tiles are one longer."""
    short = F.floor(n / tiles)
    longer = F.pmod(n, F.lit(tiles))
    edge = longer * (short + 1)
    return (
        F.when(rank <= edge, F.floor((rank - 1) / (short + 1)))
        .otherwise(longer + F.floor((rank - 1 - edge) / F.greatest(short, F.lit(1))))
        .cast("long")
        + 1
    )
