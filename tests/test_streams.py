"""Streams over several files against their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablegauge.streaming import streams as S

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files in time order, one row each per minute, every fifth an error."""
    path = str(tmp_path_factory.mktemp("events"))
    for part in range(3):
        rows = [
            (part * 100 + i, START + dt.timedelta(minutes=part * 100 + i), i % 3, "error" if i % 5 == 0 else "view", float(i))
            for i in range(100)
        ]
        spark.createDataFrame(rows, "id long, ts timestamp, user long, kind string, value double").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def shuffled(spark, folder, tmp_path_factory):
    """The same rows in twelve files, none of them in time order."""
    path = str(tmp_path_factory.mktemp("shuffled"))
    spark.read.parquet(folder).repartition(12, (F.col("id") * 7919) % 12).write.mode("overwrite").parquet(path)
    return path


def key(r):
    return tuple(r)


BUILDS = [
    lambda df: S.failed_rate(df, "ts", F.col("kind") == "error"),
    lambda df: S.login_attempts(df, "ts", "user", F.col("kind") == "error"),
    lambda df: S.session_stream(df, "ts", "user", "90 seconds"),
    lambda df: S.active_users(df, "ts", "user"),
]


@pytest.mark.parametrize("build", BUILDS)
@pytest.mark.parametrize("source, max_files", [("shuffled", None), ("folder", 1), ("folder", 2)])
def test_streams_equal_batch(spark, request, build, source, max_files):
    """Twelve files in no order as one batch; files in time order in several batches."""
    path = request.getfixturevalue(source)
    got = S.run_closed(S.stream_table(spark, path, "*.parquet", max_files), "ts", build)
    want = sorted(map(key, build(spark.read.parquet(path)).collect()))
    assert sorted(map(key, got.collect())) == want and want


@pytest.mark.parametrize("build", BUILDS)
def test_a_stream_that_loses_a_window_differs(spark, folder, build):
    """Nothing fills up what the stream doesn't give."""
    lossy = S.stream_table(spark, folder, "*.parquet").filter("id NOT BETWEEN 120 AND 240 AND user <> 1")
    got = S.run_closed(lossy, "ts", build)
    want = sorted(map(key, build(spark.read.parquet(folder)).collect()))
    assert sorted(map(key, got.collect())) != want
    none = S.run_closed(S.stream_table(spark, folder, "*.parquet").filter("id < 0"), "ts", build)
    assert none.count() == 0


def test_without_the_closing_batch_windows_stay_open(spark, folder):
    rate = BUILDS[0]
    open_end = S.run_available(rate(S.stream_table(spark, folder, "*.parquet"))).count()
    assert open_end < S.run_closed(S.stream_table(spark, folder, "*.parquet"), "ts", rate).count() == 5


def test_null_times_are_in_no_window(spark, folder, tmp_path):
    rows = spark.read.parquet(folder).withColumn("ts", F.when(F.col("id") % 2 == 0, F.col("ts")))
    rows.write.parquet(str(tmp_path / "nulls"))
    got = S.run_closed(S.stream_table(spark, str(tmp_path / "nulls"), "*.parquet"), "ts", BUILDS[0])
    assert sorted(map(key, got.collect())) == sorted(map(key, BUILDS[0](rows.filter("ts IS NOT NULL")).collect()))


def test_late_rows_are_not_dropped_in_silence(spark, shuffled):
    several = S.stream_table(spark, shuffled, "*.parquet", max_files=1)
    with pytest.raises(ValueError, match="later than the watermark"):
        S.run_closed(several, "ts", BUILDS[0])


def test_dedup_across_files(spark, folder):
    stream = S.stream_table(spark, folder, "*.parquet", max_files=1)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert S.run_available(S.dedup(twice, "ts", ["id"])).count() == 300


def test_a_refit_changes_later_rows_only(spark, folder, tmp_path):
    source, fits, out = (str(tmp_path / n) for n in ("source", "fits", "out"))
    part = lambda low, high: spark.read.parquet(folder).where(f"id BETWEEN {low} AND {high}")
    fit = lambda top: S.fit_zscore(spark.createDataFrame([(float(i % top),) for i in range(1000)], "value double"), "value", fits)
    run = lambda: S.run_available(S.zscore_stream(S.stream_table(spark, source, "*.parquet"), fits, "value"), again=out)
    # mean 4.5, deviation 2.87: values above 13.1
    part(0, 99).write.parquet(source)
    fit(10)
    assert sorted(r["id"] for r in run().collect()) == list(range(14, 100))
    # mean 49.5, deviation 28.9: no value of 100 rows is far away
    fit(100)
    part(100, 199).write.mode("append").parquet(source)
    assert sorted(r["id"] for r in run().collect()) == list(range(14, 100))
    fit(10)
    part(200, 209).withColumn("value", F.lit(50.0)).write.mode("append").parquet(source)
    assert sorted(r["id"] for r in run().collect()) == [*range(14, 100), *range(200, 210)]
    assert run().count() == 96  # nothing new
    # no spread: nothing is flagged
    S.fit_zscore(spark.createDataFrame([(1.0,)] * 5, "value double"), "value", str(tmp_path / "flat"))
    assert S.run_available(S.zscore_stream(S.stream_table(spark, folder, "*.parquet"), str(tmp_path / "flat"), "value")).count() == 0
