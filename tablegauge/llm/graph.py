"""Connected components of a large graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import keep


def _stars(links: DataFrame, to_larger: bool) -> DataFrame:
    """Tie each node's larger (or smaller) neighbours to the least node of its neighbourhood."""
    both = links.select(F.col("a").alias("n"), F.col("b").alias("m"))
    if to_larger:
        both = both.unionByName(links.select(F.col("b").alias("n"), F.col("a").alias("m")))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("least"))
    if to_larger:
        tied = both.where("m > n").join(least, "n").select(F.col("m").alias("a"), F.col("least").alias("b"))
    else:
        tied = both.join(least, "n").select(F.col("m").alias("a"), F.col("least").alias("b"))
        tied = tied.unionByName(least.select(F.col("n").alias("a"), F.col("least").alias("b")))
    return tied.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per linked node: node, root, the least node reachable.

    Alternates large and small stars: every round ties nodes to the least node of their
    neighbourhood, which ends after about log(n) rounds with each node tied to its root. No
    task holds a neighbourhood: least neighbours are partial aggregates and joins. Links of a
    node to itself and repeated links change nothing; nulls are ignored.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    links = keep(links.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    state = mark(links)
    while state[0]:
        links = keep(_stars(_stars(links, True), False))
        then, state = state, mark(links)
        if then == state:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
