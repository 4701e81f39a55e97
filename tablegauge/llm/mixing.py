"""Mixing sources to target weights by repetition rates.

Words are summed per source, targets are set from weights and stop at a multiple of the
source's size, and each document is taken floor(rate) times, once more if a coin seeded by
its id falls below the fraction. Only DataFrame functions run here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import BROADCAST_BYTES, keep, null_safe, split_words, whole
from tablegauge.llm.order import numbered

WEIGHTS = (1, 2, 3)
MOST = 3
# a coin is this many hexadecimal digits of a digest
COIN_DIGITS = 13


def coin(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key, a text, and the seed alone."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, COIN_DIGITS), 16, 10).cast("double")
    return digits / F.lit(float(16**COIN_DIGITS))


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: source, source_size, weight, target.

    Sources in order of their code points, null last, get the weights in turn. All sizes
    together are shared by weight; a target stops at `most` times its source's size and the
    excess is shared among the others by weight until none is above.
    """
    totals = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    placed = numbered(totals, [F.col("source").asc_nulls_last()])
    turns = F.array(*[F.lit(w) for w in weights])
    each = keep(placed.select("source", "source_size", turns[(F.col("place") % len(weights)).cast("int")].cast("long").alias("weight")))
    cap = most * F.col("source_size")
    # One round fixes every source that its share would carry over its cap. Each round reads
    # one row; fixed sources stay fixed, so rounds end when their number stays the same.
    share, fixed = 0.0, -1
    while True:
        over = cap < share * F.col("weight") if fixed >= 0 else F.lit(False)
        r = each.agg(
            F.sum("source_size").alias("total"), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weights"), F.count_if(over).alias("n"),
        ).first()
        if r["n"] == fixed or not r["weights"]:
            break
        share, fixed = (r["total"] - r["capped"]) / r["weights"], r["n"]
    reached = share * F.col("weight")
    return each.withColumn("target", F.when(cap < reached, cap.cast("double")).otherwise(reached))


def with_targets(sized: DataFrame, source: str, size: str, weights: Sequence[int], most: int, broadcast_bytes: int) -> DataFrame:
    """sized with source_size and target of each row's source, as the struct _mix."""
    targets = keep(source_targets(sized, source, size, weights, most))
    own = targets.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.lit(0))).first()[0]
    found = targets.select(F.col("source").alias("_source"), F.struct("source_size", "target").alias("_mix"))
    if own <= broadcast_bytes:
        found = F.broadcast(found)
    return null_safe(sized.withColumn("_source", F.col(source)), found, ["_source"], "left").drop("_source")


def takes(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS,
    most: int = MOST, seed: str = "mix", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """docs as the struct `row` with size, source_size, target and copies of each row.

    Null and empty texts have size 0 and take part like any other. A source of size 0 has
    target 0 and is not taken. Null is a source of its own. Rows with the same doc_id share a
    coin; rows without one share it if their texts are equal. Names of other columns don't matter.
    """
    t = whole(f"`{text}`")
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.concat(F.lit("null:"), F.md5(t)))
    rows = docs.select(
        F.struct("*").alias("row"), key.alias("_id"), F.col(f"`{source}`").alias("_name"),
        F.size(split_words(t)).cast("long").alias("size"),
    )
    mixed = with_targets(rows, "_name", "size", weights, most, broadcast_bytes)
    rate = F.when(F.col("_mix.source_size") > 0, F.col("_mix.target") / F.col("_mix.source_size")).otherwise(F.lit(0.0))
    extra = F.when(coin(F.col("_id"), seed) < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))
    return mixed.select("row", "size", "_mix.source_size", "_mix.target", (F.floor(rate) + extra).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as it is taken, with its columns.

    Rows without words are not taken: they add none. An empty table stays empty.
    """
    taken = takes(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
