"""Evaluation metrics over a table of predictions. Each returns one row unless noted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.math import ratio, share_of_true
from tablegauge.plans.joins import join_fitted, join_null_safe, one_row
from tablegauge.plans.ordered import ordered_totals, running_totals, value_bin
from tablegauge.plans.quantiles import quantile_row
from tablegauge.session import keep

# centroids that are compared in one row
CLUSTER_BLOCK = 1000


# --- classification -------------------------------------------------------------------


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn with precision, recall, f1, accuracy and false_positive_rate."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(fp, fp + tn).alias("false_positive_rate"),
    )


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: equal scores are one row from here on.

    Rows without a score (null or NaN) are left out.
    """
    s = F.col(score).cast("double")
    return df.where(s.isNotNull() & ~F.isnan(s)).groupBy(s.alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties half."""
    points = running_totals(_by_score(df, label, score), [], [value_bin(F.col("_s"))], [F.col("_s")], ["_neg"])
    below = F.col("_neg_upto") - F.col("_neg")
    won = F.col("_pos").cast("double") * (below + 0.5 * F.col("_neg"))
    return points.agg(ratio(F.sum(won), F.sum("_pos").cast("double") * F.sum("_neg")).alias("roc_auc"))


def pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall it adds."""
    down = _by_score(df, label, score).withColumn("_d", -F.col("_s"))
    points = running_totals(down, [], [value_bin(F.col("_d"))], [F.col("_d")], ["_pos", "_neg"])
    precision = ratio(F.col("_pos_upto"), F.col("_pos_upto") + F.col("_neg_upto"))
    return points.agg(ratio(F.sum(F.col("_pos") * precision), F.sum("_pos")).alias("pr_auc"))


# --- regression and forecasting ---------------------------------------------------------


def regression_metrics(df: DataFrame, actual: str, predicted: str, exact: bool = True) -> DataFrame:
    """rmse, mae, r2, mape (percent, zero actuals left out), median_ae; exact=False sketches the median."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    known = df.filter(a.isNotNull() & p.isNotNull())
    err = known.withColumn("_ae", F.abs(a - p))
    # residual over total sum of squares; var_pop keeps the total stable for large values
    out = err.agg(
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg("_ae").alias("mae"),
        (1 - ratio(F.avg((a - p) * (a - p)), F.var_pop(a))).alias("r2"),
        (F.avg(F.when(a != 0, F.abs((a - p) / a))) * 100).alias("mape"),
    )
    return out.withColumn("median_ae", quantile_row(err, {"q": ("_ae", 0.5)}, exact=exact).getField("q"))


def forecast_metrics(
    df: DataFrame, actual: str, forecast: str, lower: str | None = None, upper: str | None = None
) -> DataFrame:
    """smape (percent), bias (forecast - actual), and the share of actuals inside the interval."""
    a, f = F.col(actual).cast("double"), F.col(forecast).cast("double")
    known = df.filter(a.isNotNull() & f.isNotNull())
    parts = [
        (F.avg(F.coalesce(ratio(2 * F.abs(f - a), F.abs(a) + F.abs(f)), F.lit(0.0))) * 100).alias("smape"),
        F.avg(f - a).alias("bias"),
    ]
    if lower and upper:
        parts.append(share_of_true((a >= F.col(lower)) & (a <= F.col(upper))).alias("coverage"))
    return known.agg(*parts)


def naive_baseline(series: DataFrame, value: str = "value", lag: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Add `naive`: the value `lag` periods before. A series has one row per period."""
    w = Window.partitionBy(*keys).orderBy("period")
    return series.withColumn("naive", F.lag(value, lag).over(w))


# --- clustering ---------------------------------------------------------------------------


def _dims(df: DataFrame, vector: str, label: str) -> DataFrame:
    return df.select(label, F.posexplode(vector).alias("_pos", "_x")).withColumn("_x", F.col("_x").cast("double"))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, n, centroid): sums per label and dimension, then one short array per label."""
    means = _dims(df, vector, label).groupBy(label, "_pos").agg(
        F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("_n")
    )
    return means.groupBy(label).agg(
        F.max("_n").alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("centroid"),
    )


def _distance2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def cluster_metrics(df: DataFrame, vector: str, label: str) -> DataFrame:
    """inertia, calinski_harabasz, davies_bouldin for labelled vectors of equal length."""
    c = centroids(df, vector, label)
    near = join_fitted(df.select(label, vector), c, [label]).withColumn(
        "_d2", _distance2(F.col(vector), F.col("centroid"))
    )
    spread = near.groupBy(label).agg(F.sum("_d2").alias("_w"), F.avg(F.sqrt("_d2")).alias("_s"))
    full = keep(join_null_safe(c, spread, [label]))
    middle = _dims(df, vector, label).groupBy("_pos").agg(F.avg("_x").alias("_m"))
    middle = middle.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"])
    ).scalar()
    # every centroid meets the others block by block, each block in a row of its own
    blocks = max(1, -(-full.count() // CLUSTER_BLOCK))
    block = F.pmod(F.xxhash64(label), F.lit(blocks))
    parts = full.groupBy(block.alias("_block")).agg(F.collect_list(F.struct(label, "centroid", "_s")).alias("_all"))
    spread_out = full.select(label, "centroid", "_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"))
    similarity = F.transform(
        F.filter("_all", lambda o: o[label] != F.col(label)),
        lambda o: F.try_divide(F.col("_s") + o["_s"], F.sqrt(_distance2(F.col("centroid"), o["centroid"]))),
    )
    worst = spread_out.join(parts, "_block").select(label, F.array_max(similarity).alias("_worst")).groupBy(label).agg(F.max("_worst").alias("_worst"))
    rated = join_null_safe(full, worst, [label]).withColumn("_mid", middle)
    sums = rated.agg(
        F.sum("_w").alias("inertia"),
        F.sum(F.col("n") * _distance2(F.col("centroid"), F.col("_mid"))).alias("_b"),
        F.sum("n").alias("_n"),
        F.count(F.lit(1)).alias("_k"),
        F.avg("_worst").alias("davies_bouldin"),
    )
    between, within = ratio(F.col("_b"), F.col("_k") - 1), ratio(F.col("inertia"), F.col("_n") - F.col("_k"))
    return sums.select("inertia", ratio(between, within).alias("calinski_harabasz"), "davies_bouldin")


def silhouette(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean silhouette with squared Euclidean distance. Runs one job in pyspark.ml."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    ready = df.select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("prediction"),
    )
    score = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(ready)
    return df.sparkSession.createDataFrame([(float(score),)], "silhouette double")


# --- ranking ----------------------------------------------------------------------------------


def top_k(df: DataFrame, user: str, item: str, score: str, k: int) -> DataFrame:
    """The k best rows per user with `place`. The rank filter also runs before the shuffle.

    Rows without a score (null or NaN) come last.
    """
    s = F.col(score).cast("double")
    w = Window.partitionBy(user).orderBy(F.when(~F.isnan(s), s).desc_nulls_last(), F.col(item).asc())
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def ranking_at_k(df: DataFrame, user: str, item: str, score: str, relevance: str, k: int = 10) -> DataFrame:
    """precision, recall, hit_rate and ndcg at k over users with a relevant item; coverage over items.

    The four columns are written once: each part reads them, and none works out the table anew.
    """
    df = keep(df.select(user, item, score, relevance))
    rel = F.col(relevance).cast("double")
    top = top_k(df, user, item, score, k)
    got = top.groupBy(user).agg(
        F.count_if(rel > 0).alias("_hits"), F.sum(rel / F.log2(F.col("place") + 1)).alias("_dcg")
    )
    totals = df.groupBy(user).agg(F.count_if(rel > 0).alias("_relevant"))
    ideal = (
        top_k(df, user, item, relevance, k)
        .groupBy(user)
        .agg(F.sum(rel / F.log2(F.col("place") + 1)).alias("_idcg"))
    )
    per = got.join(totals, user).join(ideal, user).filter(F.col("_relevant") > 0)
    items = one_row(df.agg(F.count_distinct(item).alias("n")))
    shown = one_row(top.agg(F.count_distinct(item).alias("n")))
    return (
        per.agg(
            F.avg(F.col("_hits") / k).alias("precision_at_k"),
            F.avg(ratio(F.col("_hits"), F.col("_relevant"))).alias("recall_at_k"),
            share_of_true(F.col("_hits") > 0).alias("hit_rate"),
            F.avg(ratio(F.col("_dcg"), F.col("_idcg"))).alias("ndcg_at_k"),
        )
        .withColumns({"_i": items, "_s": shown})
        .withColumn("coverage", ratio(F.col("_s.n"), F.col("_i.n")))
        .drop("_i", "_s")
    )


def mrr_map(df: DataFrame, user: str, item: str, score: str, relevance: str) -> DataFrame:
    """mrr and map over users with a relevant item, from the full ranking of every user.

    `item` is an integer and breaks ties. Places are running totals per (user, score
    bin) with equal scores counted first, so neither a user with very many rows nor a
    score that many items share is one task. Rows without a score come last.
    """
    staged = df.select(
        user, item, F.coalesce(F.nanvl(-F.col(score).cast("double"), F.lit(float("inf"))), F.lit(float("inf"))).alias("_down"), F.lit(1).cast("long").alias("_one"),
        (F.col(relevance) > 0).cast("long").alias("_rel"),
    )
    placed = ordered_totals(staged, [user], "_down", item, ["_one", "_rel"])
    per = placed.filter(F.col("_rel") == 1).groupBy(user).agg(
        F.max(1 / F.col("_one_upto")).alias("_rr"), F.avg(F.col("_rel_upto") / F.col("_one_upto")).alias("_ap")
    )
    return per.agg(F.avg("_rr").alias("mrr"), F.avg("_ap").alias("map"))


def expected_reciprocal_rank(df: DataFrame, user: str, item: str, score: str, relevance: str, k: int = 10, top_grade: int = 1) -> DataFrame:
    """err: expected 1/place at which a user stops, over the k best rows."""
    stop = (F.pow(F.lit(2.0), F.col(relevance)) - 1) / (2.0 ** top_grade)
    listed = (
        top_k(df, user, item, score, k)
        .groupBy(user)
        .agg(F.sort_array(F.collect_list(F.struct("place", stop.alias("r")))).alias("_l"))
    )
    start = F.struct(F.lit(0.0).alias("e"), F.lit(1.0).alias("left"))
    walk = F.aggregate(
        "_l",
        start,
        lambda acc, s: F.struct(
            (acc["e"] + acc["left"] * s["r"] / s["place"]).alias("e"), (acc["left"] * (1 - s["r"])).alias("left")
        ),
    )
    return listed.agg(F.avg(walk["e"]).alias("err"))


def list_diversity(df: DataFrame, user: str, item: str, score: str, category: str, k: int = 10) -> DataFrame:
    """Mean number of distinct categories in a user's k best rows."""
    per = top_k(df, user, item, score, k).groupBy(user).agg(F.count_distinct(category).alias("_n"))
    return per.agg(F.avg("_n").alias("diversity"))
