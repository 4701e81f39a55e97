"""Sessions per entity, and per-entity trailing counts, safe for very busy entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.math import micros
from tablegauge.plans.ordered import add_totals, by_load, chunk_starts, cut, running_totals

SECOND = 1_000_000
HOUR = 3600 * SECOND


def sessions(
    df: DataFrame, user: str, ts: str, gap_seconds: int = 1800, flags: dict[str, Column] | None = None
) -> DataFrame:
    """One row per session: user, session_no, start_us, end_us, n_events and a count per flag.

    A new session starts after a pause longer than the gap. Events are first counted
    per user and slot of one gap length. Two events of one slot can never be a gap
    apart, so slots are never split between sessions and only the slots, at most
    17,520 per user and year for half an hour, are put in order. Rows without a time
    belong to no session.
    """
    flags = flags or {}
    gap = gap_seconds * SECOND
    t = micros(F.col(ts))
    df = df.where(t.isNotNull())
    slots = df.groupBy(user, F.floor(t / gap).alias("_slot")).agg(
        F.min(t).alias("_a"),
        F.max(t).alias("_b"),
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(c).alias(name) for name, c in flags.items()],
    )
    w = Window.partitionBy(user).orderBy("_slot")
    fresh = F.coalesce(F.col("_a") - F.lag("_b").over(w) > gap, F.lit(True))
    numbered = slots.withColumn("_new", fresh.cast("long")).withColumn("session_no", F.sum("_new").over(w))
    return numbered.groupBy(user, "session_no").agg(
        F.min("_a").alias("start_us"),
        F.max("_b").alias("end_us"),
        F.sum("n_events").alias("n_events"),
        *[F.sum(name).alias(name) for name in flags],
    )


def trailing_counts(
    df: DataFrame,
    user: str,
    ts: str,
    windows: dict[str, tuple[int, Column | None]],
    chunk_seconds: int = 600,
) -> DataFrame:
    """(user, event_us, <name>...): rows of the user in the last N seconds, per event time.

    `windows` maps a column name to (seconds, test or None). For busy users a row at
    time t counts for event times in [t, t + seconds]: it enters as +1 at t and leaves
    as -1 just after t + seconds, so every count is one running total per (user, chunk).
    Rows without a time are in no window and give no row.
    """
    t = micros(F.col(ts))
    df = df.where(t.isNotNull())
    hit = {n: (F.lit(1) if c is None else F.when(c, 1).otherwise(0)).cast("long") for n, (_, c) in windows.items()}
    names = list(windows)

    def plain(part: DataFrame) -> DataFrame:
        # one shuffle by user serves the merge of equal times and the windows
        rows = part.select(user, t.alias("event_us"), *[hit[n].alias(n) for n in names]).repartition(user)
        merged = rows.groupBy(user, "event_us").agg(*[F.sum(n).alias(n) for n in names])
        frame = lambda n: (
            Window.partitionBy(user).orderBy("event_us").rangeBetween(-windows[n][0] * SECOND, 0)
        )
        return merged.select(user, "event_us", *[F.sum(n).over(frame(n)).alias(n) for n in names])

    def chunked(part: DataFrame) -> DataFrame:
        zero = F.lit(0).cast("long")

        def change(at: Column, sign: int, span: int | None) -> Column:
            cells = [
                (hit[n] * sign if span is None or windows[n][0] == span else zero).alias(n) for n in names
            ]
            real = F.lit(1 if span is None else 0).cast("long")
            return F.struct(at.alias("event_us"), real.alias("_real"), *cells)

        spans = sorted({s for s, _ in windows.values()})
        moves = [change(t, 1, None)] + [change(t + (s * SECOND + 1), -1, s) for s in spans]
        rows = part.select(user, F.inline(F.array(*moves)))
        tagged, chunk_names = cut(rows, [user], [F.floor(F.col("event_us") / (chunk_seconds * SECOND))])
        starts = chunk_starts(tagged, [user], chunk_names, names)
        # one shuffle by chunk serves the merge of equal times, the running sum and the join
        merged = tagged.repartition("_cut").groupBy("_cut", "event_us").agg(
            F.sum("_real").alias("_real"), *[F.sum(n).alias(n) for n in names]
        )
        kept = [f"_cut.{user}", "event_us", "_real"]
        totals = add_totals(merged, starts, [F.col("event_us")], names, kept)
        return totals.filter(F.col("_real") > 0).select(
            user, "event_us", *[F.col(f"{n}_upto").alias(n) for n in names]
        )

    return by_load(df, [user], plain, chunked)


def trailing_frame_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, name: str) -> DataFrame:
    """Count over the literal `rows preceding` frame: min(position, rows + 1)."""
    numbered = position(df, keys, order)
    return numbered.withColumn(name, F.least(F.col("position"), F.lit(rows + 1).cast("long"))).drop("position")


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False, chunk_seconds: int = 600) -> DataFrame:
    """Add `position`, the 1-based place of each row by (time, key) within `keys`.

    `order` is (time column, unique key). Rows are numbered per (keys, time chunk).
    """
    ts, key = order
    t = micros(F.col(ts))
    sign = -1 if descending else 1
    staged = df.withColumns({"_one": F.lit(1).cast("long"), "_t": t * sign})
    out = running_totals(
        staged, keys, [F.floor(F.col("_t") / (chunk_seconds * SECOND))], [F.col("_t"), F.col(key)], ["_one"]
    )
    return out.select(*df.columns, F.col("_one_upto").alias("position"))
