"""Digests, samples, sketches, ranges and drift against plain computation."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import profile as P
from tablegauge.operators import quality as Q
from tablegauge.operators import relational as J
from tablegauge.operators import risks as R
from tablegauge.plans import digests as D
from tablegauge.plans import sketches as K
from tablegauge.plans.facts import column_facts, repeats
from tablegauge.plans.quantiles import quantiles


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "a", 0.0, [1, None], dt.datetime(2024, 1, 1, 0, 0, 0, 1)), (1, "a", -0.0, [1, None], dt.datetime(2024, 1, 1, 0, 0, 0, 1)),
        (1, "a", 0.0, [None, 1], dt.datetime(2024, 1, 1, 0, 0, 0, 1)), (1, "a", 0.0, [1, None], dt.datetime(2024, 1, 1, 0, 0, 0, 2)),
        (None, "1", float("nan"), None, None), (None, "1", float("nan"), None, None), (1, None, None, [], None), (None, None, None, None, None),
        (1, None, None, [None], None), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "a int, b string, c double, d array<int>, e timestamp").repartition(3)


def test_repeated_rows_are_those_that_grouping_finds(spark, odd):
    for names in (None, ["a"], ["c"], ["d"], ["a", "b"], ["b", "a"], ["e"]):
        cells = [f"`{c}`" for c in names or odd.columns]
        want = odd.groupBy(*[F.col(c) for c in cells]).count().agg(F.sum("count"), F.sum(F.col("count") - 1)).first()
        assert tuple(repeats(odd, names).first()) == tuple(want)
    assert tuple(repeats(odd.where("false")).first()) == (0, 0)


def test_rows_that_share_a_digest_are_counted_by_their_cells(spark):
    df = spark.range(1000).select((F.col("id") % 700).alias("id"), F.lit("x").alias("t"))
    weak = lambda seed: F.col("id") % 3 if seed < 3 else F.xxhash64("id")
    assert tuple(D.repeated_rows(df, df.columns, weak).first()) == (1000, 300)
    # and where the third digest fails to tell, as two rows in 2^192 would
    assert D.repeated_rows(df, df.columns, lambda seed: F.col("id") % 3).first()["duplicate_rows"] == 997


def test_distinct_counts_with_nulls_and_nan(spark, odd):
    got = {r["column"]: r["distinct_values"] for r in P.distinct_counts(odd).collect()}
    assert got == {"a": 1, "b": 2, "c": 1, "e": 2}
    facts = {r["column"]: (r["distinct"], r["variety"], r["lowest"]) for r in column_facts(odd).collect()}
    assert facts["b"] == (2, 2, "1") and facts["a"][1] == 1
    assert P.distinct_counts(odd.where("false")).agg(F.sum("distinct_values")).first()[0] == 0


@pytest.mark.parametrize("n", [1, 3, 8])
def test_samples_against_plain_python(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, i % 90, i % 90]), rng.choice(["a", "b", None, f"t{i % 50}"]), float(i % 13), "same", f"own{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k int, few string, x double, one string, many string").repartition(6)
    want = {}
    for i, name in enumerate(df.columns):
        first = {}
        for r in rows:
            if r[i] is not None:
                key = math.inf if r[0] is None else r[0]
                first[str(r[i])] = min(first.get(str(r[i]), math.inf), key)
        want[name] = [v for v, _ in sorted(first.items(), key=lambda kv: (kv[1], kv[0]))[:n]]
    got = {r["column"]: r["samples"] for r in P.column_samples(df, "k", n).collect()}
    assert got == want
    part = {r["column"]: r["samples"] for r in P.column_samples(df, "k", n, ["few", "one"]).collect()}
    assert part == {c: want[c] for c in ("few", "one")}


def test_states_merge_to_the_whole(spark, tmp_path):
    folder = str(tmp_path / "states")
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("a"), (F.col("id") % 7).cast("string").alias("b"), F.lit(None).cast("double").alias("c"),
                                    (F.col("id") % 3).cast("string").alias("day"))
    for day in "012":
        K.store_states(K.distinct_states(df.where(F.col("day") == day), ["a", "b", "c"]), folder, day)
    K.store_states(K.distinct_states(df.where("day = '1'"), ["a", "b", "c"]), folder, "1")  # again: replaced
    assert K.stored_states(spark, folder).count() == 9
    got = {r["column"]: r["distinct_values"] for r in K.merged_distinct(K.stored_states(spark, folder)).collect()}
    assert abs(got["a"] - 20_000) <= K.distinct_error() * 20_000 and got["b"] == 7 and not got["c"]
    one = {r["column"]: r["distinct_values"] for r in K.merged_distinct(K.stored_states(spark, folder, ["0"])).collect()}
    assert one["b"] == 7 and abs(one["a"] - 20_000) <= K.distinct_error() * 20_000
    per = K.merged_distinct(K.distinct_states(df, ["a", "b"], ["day"]), ["day"])
    assert per.count() == 6
    issues = lambda exact: {r["column"] for r in Q.check_high_cardinality(df.withColumn("t", F.col("a").cast("string")), exact=exact).collect()}
    assert issues(True) == issues(False) == {"t"}


def test_sketched_quantiles(spark):
    df = spark.range(50_000).select(F.exp(F.col("id") / 5000.0).alias("v"), (F.col("id") % 2).alias("g"), F.lit(None).cast("double").alias("none"))
    for group in ([], ["g"]):
        found = quantiles(df, ["v"], [0.1, 0.5, 0.99], group, exact=False).collect()
        for r in found:
            rank = 5000 * math.log(r["quantile"]) / 50_000
            assert abs(rank - r["prob"]) <= K.rank_error() + 1e-3
        assert len(found) == 3 * (2 if group else 1)
    assert quantiles(df, ["none"], [0.5], exact=False).first()["quantile"] is None
    assert abs(P.column_summary(df, "v", exact=False).first()["median"] / math.exp(5) - 1) < 0.05


def brute_ranges(points, ranges):
    return Counter((p, lo, hi) for p in points for lo, hi in ranges if p is not None and lo is not None and hi is not None and lo <= p < hi)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "hot_points": 20}])
def test_range_join_against_all_pairs(spark, options):
    rng = random.Random(2)
    points = [rng.choice([rng.uniform(-50, 50), float(rng.randrange(-40, 40)), 3.0]) for _ in range(300)] + [None, float("nan"), 1e300, -1e300]
    ranges = [(a := rng.uniform(-60, 60), a + rng.choice([0.0, 0.3, 1.0, 7.5, 60.0])) for _ in range(120)]
    ranges += [(-5.0, 5.0), (5.0, -5.0), (None, 1.0), (0.0, float("inf")), (float("-inf"), 0.0), (3.0, 3.0)]
    left = spark.createDataFrame([(p,) for p in points], "p double").repartition(4)
    right = spark.createDataFrame(ranges, "lo double, hi double")
    got = J.range_join(left, right, F.col("p"), F.col("lo"), F.col("hi"), 1.0, **options)
    plain = [p for p in points if p is not None and not math.isnan(p)]
    assert Counter(map(tuple, got.collect())) == brute_ranges(plain, [r for r in ranges])
    assert got.columns == ["p", "lo", "hi"]


def test_a_wide_range_has_few_nodes(spark):
    df = spark.createDataFrame([(0, 1_000_000), (1, 1_000_001), (-700_001, 299_998), (5, 6), (7, 7)], "lo long, hi long")
    rows = df.select("lo", "hi", J.range_nodes(F.col("lo"), F.col("hi")).alias("n")).collect()
    for r in rows:
        units = sorted((n["at"] << n["level"], (n["at"] + 1) << n["level"]) for n in r["n"] or [])
        assert len(units) < 100
        covered = [u for u in units]
        if r["lo"] < r["hi"]:
            assert covered[0][0] == r["lo"] and covered[-1][1] == r["hi"] and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
        else:
            assert not covered


def test_drift_against_plain_python(spark):
    rng = random.Random(4)
    make = lambda n, shift: [(rng.choice([None, 1e9 + rng.gauss(shift, 3.0)]), rng.choice(["a", "b", None, f"c{rng.randrange(4)}"]), rng.randrange(5)) for _ in range(n)]
    old, new = make(500, 0.0), make(300, 2.0)
    schema = "x double, t string, k int"
    got = {r["column"]: r for r in R.drift_report(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    for i, c in enumerate(("x", "t", "k")):
        a, b = [r[i] for r in old if r[i] is not None], [r[i] for r in new if r[i] is not None]
        if c != "t":
            ordered, edges = sorted(a), []
            for p in range(1, 10):
                at = p / 10 * (len(ordered) - 1)
                k = math.floor(at)
                edges.append(ordered[k] + (ordered[min(k + 1, len(ordered) - 1)] - ordered[k]) * (at - k))
            label = lambda v: sum(v > e for e in edges)
            mean = lambda v: sum(v) / len(v)
            sd = math.sqrt(sum((v - mean(a)) ** 2 for v in a) / (len(a) - 1))
            assert got[c]["mean_shift"] == pytest.approx((mean(b) - mean(a)) / sd, abs=1e-6)
        else:
            label = lambda v: v
            assert got[c]["mean_shift"] is None
        pa, pb = Counter(map(label, a)), Counter(map(label, b))
        psi = sum((q - p) * math.log(q / p) for p, q in ((max(pa[k] / len(a), 1e-4), max(pb[k] / len(b), 1e-4)) for k in pa | pb))
        assert got[c]["psi"] == pytest.approx(psi, rel=1e-6) and got[c]["drift"] == (psi > 0.2)
        assert got[c]["null_rate_change"] == pytest.approx((1 - len(b) / 300) - (1 - len(a) / 500))
    near = {r["column"]: r["psi"] for r in R.drift_report(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), exact=False).collect()}
    assert near["t"] == got["t"]["psi"] and abs(near["x"] - got["x"]["psi"]) < 0.1


def test_grouped_statistics(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.uniform(0, 9)])) for _ in range(300)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = J.grouped_statistics(df, ["g"], "v", {"q": 0.3, "m": 0.5}, {"n": F.count("v")})
    want = df.groupBy("g").agg(F.percentile("v", 0.3).alias("q"), F.median("v").alias("m"), F.count("v").alias("n")).collect()
    want = {r["g"]: r for r in want}
    for r in got.collect():
        assert r["n"] == want[r["g"]]["n"] and r["q"] == pytest.approx(want[r["g"]]["q"]) and r["m"] == pytest.approx(want[r["g"]]["m"])
    assert got.count() == 4


def test_grouped_distinct_carries_no_sketch_per_value(spark):
    rows = [(("a", "b", None)[i % 3], i % 50 if i % 11 else None, i % 700) for i in range(4000)]
    df = spark.createDataFrame(rows + rows, "g string, s long, p long")
    sketch = {"about": F.approx_count_distinct("s", 0.01)}
    got = {r.g: tuple(r)[1:] for r in J.grouped_distinct(df, ["g"], {"suppliers": "s", "parts": "p"}, sketch).collect()}
    for g in ("a", "b", None):
        own = [(s, p) for k, s, p in rows if k == g]
        n = len({s for s, _ in own if s is not None})
        assert got[g][:2] == (n, len({p for _, p in own})) and abs(got[g][2] - n) <= 0.03 * n
    assert J.grouped_distinct(df.where("false"), ["g"], {"parts": "p"}, sketch).count() == 0


def test_distinct_query_expands_no_rows(spark, tmp_path):
    """Expanded rows are grouped by value, each with a sketch."""
    from tablegauge import workload

    rows = [("ab"[i % 2], i % 40, i % 300) for i in range(2000)]
    spark.createDataFrame(rows, "l_returnflag string, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = workload.load()[0]["g5_distinct"](spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {("a", 20, 150, True), ("b", 20, 150, True)}
    assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()
