"""Ordered operators against brute force on tables where one key holds a third of the rows."""

import bisect
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablegauge.operators import evaluation, features, relational
from tablegauge.plans import ordered, quantiles, sessions

START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True, params=["no busy keys", "busy keys"])
def load(request, monkeypatch):
    """Every test runs with all keys ordinary and with the larger keys counted as busy."""
    if request.param == "busy keys":
        monkeypatch.setattr(ordered, "BUSY_ROWS", 100)


@pytest.fixture(scope="module")
def log():
    """Events: user 0 has a third of the rows, a third of its rows share one instant, one user is null."""
    rnd = random.Random(7)
    out = []
    for i in range(3000):
        user = 0 if i % 3 == 0 else rnd.choice([1, 2, 3, None])
        at = 86_400 if user == 0 and i % 9 == 0 else rnd.randrange(0, 5 * 86_400)
        out.append((i, user, START + dt.timedelta(seconds=at, microseconds=rnd.choice([0, 1, 999_999])), rnd.choice("abc"), rnd.choice([0.0, -1.5, 2.0, 1e9, rnd.random()])))
    return out


@pytest.fixture(scope="module")
def events(spark, log):
    return spark.createDataFrame(log, "id long, user long, ts timestamp, kind string, value double").repartition(5)


def by_user(log):
    out = {}
    for r in log:
        out.setdefault(r[1], []).append(r)
    return out


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def test_trailing_counts(events, log):
    got = features.trailing_counts(
        events, "user", "ts", {"hour": (3600, None), "day_a": (86_400, F.col("kind") == "a")}
    ).collect()
    want = set()
    for user, rs in by_user(log).items():
        times = sorted(us(r[2]) for r in rs)
        marked = sorted(us(r[2]) for r in rs if r[3] == "a")
        for t in set(times):
            hour = bisect.bisect_right(times, t) - bisect.bisect_left(times, t - 3600 * 10**6)
            day = bisect.bisect_right(marked, t) - bisect.bisect_left(marked, t - 86_400 * 10**6)
            want.add((user, t, hour, day))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_sessions(events, log):
    got = sessions.sessions(events, "user", "ts", 1800, {"n_a": F.col("kind") == "a"})
    want = []
    for user, rs in by_user(log).items():
        rs = sorted(rs, key=lambda r: (r[2], r[0]))
        cur = None
        for r in rs:
            t = us(r[2])
            if cur is None or t - cur[2] > 1800 * 10**6:
                cur = [user, t, t, 0, 0]
                want.append(cur)
            cur[2], cur[3], cur[4] = t, cur[3] + 1, cur[4] + (r[3] == "a")
    assert {(r["user"], r["start_us"], r["end_us"], r["n_events"], r["n_a"]) for r in got.collect()} == {tuple(w) for w in want}


def test_a_pause_of_exactly_the_gap_stays_in_the_session(spark):
    times = [START, START + dt.timedelta(minutes=30), START + dt.timedelta(minutes=60, microseconds=1)]
    df = spark.createDataFrame([(1, t) for t in times], "user int, ts timestamp")
    assert sorted(r["n_events"] for r in sessions.sessions(df, "user", "ts").collect()) == [1, 2]


def test_recency_rank_and_views(events, log):
    ranked = {r["id"]: r["recency_rank"] for r in features.row_recency_rank(events, "user", "ts", "id").collect()}
    views = {(r["user"], r["purchase_no"]): r["views"] for r in features.views_before_purchase(
        events, "user", "ts", "id", F.col("kind") == "a", F.col("kind") == "b").collect()}
    want_views = {}
    for user, rs in by_user(log).items():
        down = sorted(rs, key=lambda r: (r[2], r[0]), reverse=True)
        assert [ranked[r[0]] for r in down] == list(range(1, len(rs) + 1))
        seen, no = 0, 0
        for r in reversed(down):
            seen += r[3] == "a"
            if r[3] == "b":
                no += 1
                want_views[user, no] = seen
                seen = 0
    assert views == want_views


def test_rank_rows_with_a_value_a_third_of_rows_share(spark):
    rnd = random.Random(3)
    data = [(i, 5.0 if i % 3 == 0 else rnd.choice([-1.0, 0.0, 1e-9, rnd.random() * 1e6])) for i in range(2000)]
    df = spark.createDataFrame(data, "k long, v double").repartition(4)
    got = {r["k"]: r["row_rank"] for r in ordered.rank_rows(df, "v", "k", tie_block=64).collect()}
    assert [got[k] for k, _ in sorted(data, key=lambda r: (r[1], r[0]))] == list(range(1, 2001))


@pytest.mark.parametrize("n,tiles", [(1, 5), (4, 5), (5, 5), (13, 5), (17, 4)])
def test_ntile(spark, n, tiles):
    df = spark.range(1, n + 1)
    got = [r["t"] for r in df.select("id", ordered.ntile_of(F.col("id"), F.lit(n), tiles).alias("t")).orderBy("id").collect()]
    want = [r["t"] for r in df.selectExpr("id", f"ntile({tiles}) OVER (ORDER BY id) AS t").orderBy("id").collect()]
    assert got == want


def test_value_bin_never_decreases(spark):
    values = sorted([0.0, -0.0, 5e-324, -5e-324, 1e-300, 1.0, -1.0, 1e300, -1e300, 1.7976931348623157e308, float("inf"), float("-inf"), 3.0, 3.0000001])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    bins = [r["b"] for r in df.select("i", ordered.value_bin(F.col("v")).alias("b")).orderBy("i").collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    n = [1, 2, 501, 1000][seed]
    a = np.where(rng.random(n) < 0.33, 7.0, rng.normal(0, 10.0 ** rng.integers(-6, 6, n)))
    b = rng.integers(-3, 3, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "g": np.arange(n) % 2})).repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in quantiles.quantiles(df, ["a", "b"], probs).collect():
        assert r["quantile"] == pytest.approx(np.quantile({"a": a, "b": b}[r["column"]], r["prob"]), rel=1e-12, abs=1e-300)
    for r in quantiles.quantiles(df, ["a"], probs, ["g"]).collect():
        assert r["quantile"] == pytest.approx(np.quantile(a[np.arange(n) % 2 == r["g"]], r["prob"]), rel=1e-12, abs=1e-300)
    for r in quantiles.quantiles(df, ["a"], probs, interpolate=False).collect():
        assert r["quantile"] == np.quantile(a, r["prob"], method="inverted_cdf")


def test_asof_join(spark, events, log):
    right = events.filter("kind = 'a'").select("user", F.col("ts").alias("rt"), F.col("id").alias("rid"))
    left = events.filter("kind = 'b'").select("user", "ts", "id")
    got = {r["id"]: r["rid"] for r in relational.asof_join(left, right, ["user"], "ts", "rt", ["rid"]).collect()}
    want = {}
    for user, rs in by_user(log).items():
        marks = sorted((r[2], r[0]) for r in rs if r[3] == "a")
        for r in rs:
            if r[3] == "b":
                i = bisect.bisect_right(marks, (r[2], float("inf")))
                # a null key matches nothing
                want[r[0]] = marks[i - 1][1] if i and user is not None else None
    assert got == want


def test_range_join(spark):
    rnd = random.Random(5)
    points = [(i, rnd.choice([3.0, rnd.uniform(-50, 50)])) for i in range(400)]
    ranges = [(j, lo, lo + rnd.choice([0.0, 1.0, 25.0])) for j, lo in enumerate(rnd.uniform(-60, 60) for _ in range(60))]
    p = spark.createDataFrame(points, "i int, x double")
    r = spark.createDataFrame(ranges, "j int, lo double, hi double")
    out = relational.range_join(p, r, F.col("x"), F.col("lo"), F.col("hi"), 10.0)
    got = sorted((a["i"], a["j"]) for a in out.collect())
    assert got == sorted((i, j) for i, x in points for j, lo, hi in ranges if lo <= x < hi)


def test_auc_with_many_equal_scores(spark):
    rnd = random.Random(1)
    data = [(rnd.randrange(2), 0.5 if i % 3 == 0 else round(rnd.random(), 2)) for i in range(600)]
    df = spark.createDataFrame(data, "y int, s double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluation.roc_auc(df, "y", "s").first()[0] == pytest.approx(want)


def test_mrr_map(spark):
    rnd = random.Random(2)
    data = [(0 if i % 3 == 0 else rnd.randrange(1, 9), i, rnd.choice([1.0, rnd.random()]), int(rnd.random() < 0.2)) for i in range(900)]
    df = spark.createDataFrame(data, "u int, i int, s double, rel int").repartition(4)
    rr, ap = [], []
    for u in {d[0] for d in data}:
        rels = [d[3] for d in sorted((d for d in data if d[0] == u), key=lambda d: (-d[2], d[1]))]
        places = [k + 1 for k, r in enumerate(rels) if r]
        if places:
            rr.append(1 / places[0])
            ap.append(sum((n + 1) / p for n, p in enumerate(places)) / len(places))
    got = evaluation.mrr_map(df, "u", "i", "s", "rel").first()
    assert got["mrr"] == pytest.approx(sum(rr) / len(rr)) and got["map"] == pytest.approx(sum(ap) / len(ap))


def test_null_times_and_scores_give_one_result_whatever_the_key_size(spark, monkeypatch):
    nan = float("nan")
    rows = [(u, None if i % 5 == 0 else i * 40, (None, nan, -1.0, 2.0, 0.5)[i % 5], i, i % 2) for u in (1, 2, None) for i in range(40)]
    df = spark.createDataFrame(rows, "user long, s long, score double, item long, rel int").withColumn("ts", F.timestamp_seconds("s"))
    found = []
    for limit in (2_000_000, 0):
        monkeypatch.setattr(ordered, "BUSY_ROWS", limit)
        counts = trailing_counts(df, "user", "ts", {"n": (600, None)})
        ranks = ordered.rank_rows(df.withColumn("k", F.monotonically_increasing_id()), "score", "k", ["user"])
        found.append((
            sorted(map(repr, counts.collect())), sorted(repr((r.user, r.k, r.row_rank)) for r in ranks.collect()),
            evaluation.mrr_map(df, "user", "item", "score", "rel").first(), evaluation.roc_auc(df, "rel", "score").first(),
            evaluation.pr_auc(df, "rel", "score").first(),
        ))
    assert found[0][:2] == found[1][:2]
    assert [tuple(round(x, 12) for x in r) for r in found[0][2:]] == [tuple(round(x, 12) for x in r) for r in found[1][2:]]
    whole = df.where("score is not null and not isnan(score)")
    assert evaluation.roc_auc(whole, "rel", "score").first() == found[0][3]
    assert all("None" not in r.split("event_us=")[1] for r in found[0][0])


def test_as_of_join_leaves_null_keys_and_times_unmatched(spark):
    facts = spark.createDataFrame([(1, None, 10), (None, 5, 20), (1, 5, 30)], "k int, s long, v int").withColumn("f", F.timestamp_seconds("s"))
    probes = spark.createDataFrame([(1, 4), (1, 6), (None, 9), (1, None)], "k int, s long").withColumn("t", F.timestamp_seconds("s"))
    got = asof_join(probes, facts.drop("s"), ["k"], "t", "f", ["v"]).collect()
    assert sorted(((r.k, r.s, r.v) for r in got), key=repr) == sorted([(1, 4, None), (1, 6, 30), (None, 9, None), (1, None, None)], key=repr)


def test_null_times_and_scores_give_one_result_whatever_the_key_size(spark, monkeypatch):
    nan = float("nan")
    rows = [(u, None if i % 5 == 0 else i * 40, (None, nan, -1.0, 2.0, 0.5)[i % 5], i, i % 2) for u in (1, 2, None) for i in range(40)]
    df = spark.createDataFrame(rows, "user long, s long, score double, item long, rel int").withColumn("ts", F.timestamp_seconds("s"))
    df = df.withColumn("k", F.coalesce("user", F.lit(9)) * 1000 + F.col("item"))
    found = []
    for limit in (2_000_000, 0):
        monkeypatch.setattr(ordered, "BUSY_ROWS", limit)
        counts = sessions.trailing_counts(df, "user", "ts", {"n": (600, None)})
        ranks = ordered.rank_rows(df, "score", "k", ["user"])
        found.append((
            sorted(map(repr, counts.collect())), sorted((r.k, r.row_rank) for r in ranks.collect()),
            evaluation.mrr_map(df, "user", "item", "score", "rel").first(), evaluation.roc_auc(df, "rel", "score").first(),
            evaluation.pr_auc(df, "rel", "score").first(),
        ))
    assert found[0][:2] == found[1][:2]
    assert [tuple(round(x, 12) for x in r) for r in found[0][2:]] == [tuple(round(x, 12) for x in r) for r in found[1][2:]]
    whole = df.where("score is not null and not isnan(score)")
    assert evaluation.roc_auc(whole, "rel", "score").first() == found[0][3]
    assert len(found[0][0]) == 3 * 32 and not any("event_us=None" in r for r in found[0][0])
    first = evaluation.top_k(df, "user", "item", "score", 8).where("user = 1").collect()
    assert {r.score for r in first} == {2.0}


def test_as_of_join_leaves_null_keys_and_times_unmatched(spark):
    facts = spark.createDataFrame([(1, None, 10), (None, 5, 20), (1, 5, 30)], "k int, s long, v int").withColumn("f", F.timestamp_seconds("s"))
    probes = spark.createDataFrame([(1, 4), (1, 6), (None, 9), (1, None)], "k int, s long").withColumn("t", F.timestamp_seconds("s"))
    got = relational.asof_join(probes, facts.drop("s"), ["k"], "t", "f", ["v"]).collect()
    assert sorted(((r.k, r.s, r.v) for r in got), key=repr) == sorted([(1, 4, None), (1, 6, 30), (None, 9, None), (1, None, None)], key=repr)


@pytest.mark.parametrize("offset", [0, 10**15, 1_700_000_000_000_000])
def test_bins_follow_the_data(spark, offset):
    n = 20_000
    df = spark.range(n).select((F.lit(offset) + F.col("id") * 100_000_000).cast("double").alias("v"))
    got = {r.prob: r.quantile for r in quantiles.quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    want = df.toPandas()["v"].quantile([0.0, 0.25, 0.5, 0.99, 1.0])
    assert all(got[p] == pytest.approx(want[p], rel=1e-12) for p in got)
    low = float(offset)
    assert df.groupBy(ordered.value_bin(F.col("v") - low)).count().agg(F.max("count")).first()[0] < n / 500


def test_infinite_values_and_offsets_keep_quantiles_exact(spark):
    rows = [float("-inf"), -5.0, 0.0, 1e15, 1e15 + 1, 1e15 + 2, float("inf")]
    df = spark.createDataFrame([(v,) for v in rows] + [(float("nan"),), (None,)], "v double")
    got = {r.prob: r.quantile for r in quantiles.quantiles(df, ["v"], [i / 6 for i in range(7)], interpolate=False).collect()}
    assert set(got.values()) <= set(rows) and got[0.0] == rows[0] and got[1.0] == rows[-1] and got[0.5] == 1e15
