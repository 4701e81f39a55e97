"""What Spark SQL has no distributed form for: as-of joins, point-in-range joins, quantiles and distinct counts per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.math import micros
from tablegauge.plans.joins import BROADCAST_ROWS, fits_broadcast, join_null_safe, one_row
from tablegauge.plans.ordered import carry_last
from tablegauge.plans.quantiles import quantiles
from tablegauge.session import keep


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    chunk_seconds: int = 600,
) -> DataFrame:
    """Each left row with the values of the latest right row at or before it, null if none.

    Both sides are merged by time and the last right values are carried forward. Null keys
    and times match nothing: such facts are left out and such probes get nulls.
    Work is cut by key and time chunk, so one busy key does not fill one task.
    """
    keys = list(keys)
    none = lambda: F.lit(None)
    carried = F.struct(*[F.col(v).alias(v) for v in values])
    facts = right.select(
        *keys, micros(F.col(right_ts)).alias("_t"), F.lit(0).alias("_side"), carried.alias("_v")
    )
    # of right rows at the same instant any one may answer; the largest is taken
    facts = facts.dropna(subset=[*keys, "_t"]).groupBy(*keys, "_t", "_side").agg(F.max("_v").alias("_v"))
    probes = left.select(
        *keys, micros(F.col(left_ts)).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row")
    )
    merged = facts.unionByName(probes, allowMissingColumns=True)
    chunk = F.floor(F.col("_t") / (chunk_seconds * 1_000_000))
    filled = carry_last(merged, keys, [chunk], [F.col("_t"), F.col("_side")], "_v")
    timed = F.col("_t").isNotNull()
    return filled.filter(F.col("_side") == 1).select("_row.*", *[F.when(timed, F.col(f"_v_last.{v}")).alias(v) for v in values])


def grouped_statistics(
    df: DataFrame, by: Sequence[str], column: str, probs: dict[str, float], others: dict[str, Column], exact: bool = True,
) -> DataFrame:
    """Per group: the named quantiles of a column (linear form), and other aggregates.

    `percentile` and `median` keep a group's different values in one task; here bins of values
    are counted, and only those that hold a wanted rank are looked into. Null keys are a group.
    exact=False sketches the quantiles. A group without known values has null quantiles.
    """
    by = list(by)
    found = quantiles(df, [column], list(dict.fromkeys(probs.values())), by, exact=exact)
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(name) for name, p in probs.items()])
    rest = df.groupBy(*by).agg(*[c.alias(name) for name, c in others.items()])
    return join_null_safe(rest, wide, by, "left")


def grouped_distinct(df: DataFrame, by: Sequence[str], columns: dict[str, str], others: dict[str, Column]) -> DataFrame:
    """Per group: exact numbers of different known values of the named columns, and other aggregates.

    Spark expands several `count(DISTINCT)` into one row per group and value, and each of these
    carries the states of the other aggregates: a sketch of 13 KB for every value. Here the
    others are aggregated by group alone, and each column's values on their own. Null keys are
    a group.
    """
    by = list(by)
    found = df.groupBy(*by).agg(*[c.alias(name) for name, c in others.items()])
    for name, column in columns.items():
        # count(DISTINCT) of one column alone is grouped by its values, in partial sums
        one = df.groupBy(*by).agg(F.count_distinct(F.col(f"`{column}`")).alias(name))
        found = join_null_safe(found, one, by)
    return found.select(*by, *columns, *others)


# whole numbers that units are held to, and levels that halve them
UNITS = 1 << 61
LEVELS = 62
# points of one node beyond which its pairs are dealt to several tasks
HOT_POINTS = 1_000_000


def _unit(c: Column, width: float) -> Column:
    """The unit a number lies in; infinite ones are held to the ends, null and NaN have none."""
    v = c.cast("double") / F.lit(float(width))
    return F.when(~F.isnan(v), F.floor(F.greatest(F.least(v, F.lit(float(UNITS))), F.lit(-float(UNITS)))).cast("long"))


def range_nodes(low: Column, high: Column) -> Column:
    """The nodes (level, at) that together hold the units low to high - 1: at most two a level.

    Node (level, at) holds the units from at * 2^level on, 2^level of them. On each level the
    rest of the range gives away its first unit if that is odd, and its last if that is even,
    and goes on in units of twice the size.
    """
    levels = F.ceil(F.log2(F.greatest(high - low, F.lit(1)).cast("double"))).cast("int")
    whole_shift = lambda x, k: F.call_function("shiftright", x, k)

    def ends(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first, after = whole_shift(low + size - 1, k), whole_shift(high, k)
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        node = lambda at: F.struct(k.cast("int").alias("level"), at.alias("at"))
        left = F.when(odd(first) & (first < after), node(first))
        right = F.when(odd(after) & (first + F.when(odd(first), 1).otherwise(0) < after), node(after - 1))
        return F.array_compact(F.array(left, right))

    return F.when(low < high, F.flatten(F.transform(F.sequence(F.lit(0), levels), ends)))


def range_join(
    points: DataFrame, ranges: DataFrame, point: Column, low: Column, high: Column, width: float,
    broadcast_rows: int = BROADCAST_ROWS, hot_points: int = HOT_POINTS,
) -> DataFrame:
    """Pairs with low <= point < high, matched through nodes of halved units of the given width.

    A range is listed under the nodes that hold its units, two for each doubling of its length
    at most; a point looks up the nodes above its unit, on the levels that ranges use. The width
    only sets how many pairs are looked at that don't match. Null and NaN points and limits, and
    ranges without extent, match nothing.

    Runs a job: the nodes of the ranges are written and measured. If they are few they are sent
    to the points, which are not shuffled then. Otherwise nodes and points are joined by node,
    and a node of more than hot_points points is dealt to several tasks.
    """
    held = ranges.withColumns({"_low": _unit(low, width), "_high": _unit(high, width)}).where(low < high)
    listed = held.withColumn("_node", F.explode(range_nodes(F.col("_low"), F.col("_high") + 1)))
    listed = keep(listed.select(*ranges.columns, F.col("_node.level").alias("_level"), F.col("_node.at").alias("_at")))
    # as many levels as a long has bits at most
    levels = listed.agg(F.sort_array(F.collect_set("_level")).alias("levels"))
    placed = points.withColumn("_unit", _unit(point, width)).withColumn("_levels", one_row(levels)).where(F.col("_unit").isNotNull())
    looked = placed.withColumn("_level", F.explode("_levels.levels")).withColumn("_at", F.expr("shiftright(_unit, _level)")).drop("_unit", "_levels")
    on = ["_level", "_at"]
    if fits_broadcast(listed, broadcast_rows):
        found = looked.join(F.broadcast(listed), on)
    else:
        nodes = listed.select(*on).distinct()
        full = looked.select(*on).join(nodes, on, "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_points)
        hot = keep(full.select(*on, F.ceil(F.col("_n") / hot_points).cast("int").alias("_parts")))
        # nodes in every part of theirs; a point in one of them
        parts = lambda df: join_null_safe(df, hot, on, "left", small=fits_broadcast(hot, broadcast_rows)).withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        dealt = parts(listed).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        spread = parts(looked).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")).drop("_parts")
        found = spread.join(dealt, [*on, "_part"]).drop("_part")
    return found.where((point >= low) & (point < high)).drop(*on)
