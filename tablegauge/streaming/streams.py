"""Structured Streaming forms of the time-bounded metrics.

Each builder takes a streaming DataFrame (or a batch one) and returns the transformed
DataFrame; `run_available` drives one to the end of the available input, and `run_closed` also
closes the windows that are still open there.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.math import share_of_true
from tablegauge.session import new_folder

FAIL_LIMIT = 0.05
# time of the row that ends an input: the watermark passes every earlier window
END_OF_TIME = dt.datetime(9999, 12, 1, tzinfo=dt.timezone.utc)


def stream_table(spark: SparkSession, folder: str, file: str, max_files: int | None = None) -> DataFrame:
    """File-source stream over the files of `folder` whose name matches `file`.

    A listing is not in event-time order, so by default all files that are there make one
    batch and none of their rows can be late. `max_files` per batch is for files that come
    in time order; `run_available` refuses a result from which late rows were dropped.
    """
    schema = spark.read.option("pathGlobFilter", file).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def event_time(df: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Turn the time column into a watermarked timestamp; later rows than the delay are dropped."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def failed_rate(df: DataFrame, ts: str, failed: Column, delay: str = "10 minutes") -> DataFrame:
    """(period, events, value, alert) per tumbling hour; alert above 5 % failures."""
    per = (
        event_time(df, ts, delay)
        .groupBy(F.window(ts, "1 hour"))
        .agg(F.count(F.lit(1)).alias("events"), share_of_true(failed).alias("value"))
    )
    return per.select(
        F.col("window.start").alias("period"), "events", "value", (F.col("value") > FAIL_LIMIT).alias("alert")
    )


def login_attempts(df: DataFrame, ts: str, user: str, is_login: Column, delay: str = "10 minutes") -> DataFrame:
    """(period, user, attempts) per sliding hour, every five minutes."""
    # the condition names the time as well, so that it stays above the watermark, which all rows move
    login = F.when(F.col(ts).isNotNull(), is_login)
    per = (
        event_time(df, ts, delay)
        .filter(login)
        .groupBy(F.window(ts, "1 hour", "5 minutes"), user)
        .agg(F.count(F.lit(1)).alias("attempts"))
    )
    return per.select(F.col("window.start").alias("period"), user, "attempts")


def session_stream(df: DataFrame, ts: str, user: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(user, start, seconds, events) per session; a session ends after a pause of the gap."""
    per = (
        event_time(df, ts, delay)
        .groupBy(F.session_window(ts, gap), user)
        .agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    )
    seconds = (F.unix_micros("_b") - F.unix_micros("_a")) / 1_000_000
    return per.select(user, F.col("_a").alias("start"), seconds.alias("seconds"), "events")


def dedup(df: DataFrame, ts: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """One row per key within the watermark delay."""
    timed = event_time(df, ts, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else timed.dropDuplicates(list(keys))


def active_users(df: DataFrame, ts: str, user: str, delay: str = "10 minutes") -> DataFrame:
    """(period, users): approximate distinct users per day, one sketch per day as state."""
    per = event_time(df, ts, delay).groupBy(F.window(ts, "1 day")).agg(F.approx_count_distinct(user).alias("users"))
    return per.select(F.col("window.start").alias("period"), "users")


def fit_zscore(history: DataFrame, column: str, folder: str) -> None:
    """Write (mean, sd, fitted) of the history's column as the newest fit of the folder."""
    fit = history.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd")).withColumn("fitted", F.current_timestamp())
    fit.write.mode("append").parquet(folder)


def zscore_stream(df: DataFrame, fits: str, column: str, limit: float = 3.0) -> DataFrame:
    """Rows of the stream further than `limit` deviations from the newest fitted mean, with z.

    A join of the stream with the one row that `fit_zscore` wrote last. The folder is read when
    the query starts, and again at every start: with `run_available(again=...)` each run is a
    batch with the fit of its time, and earlier rows keep their flags. A history without spread
    flags nothing.
    """
    # one row, whatever the number of fits
    newest = df.sparkSession.read.parquet(fits).agg(F.max_by(F.struct("mean", "sd"), "fitted").alias("_fit")).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(newest), "_one").withColumn("_sd", F.nullif(F.col("_fit.sd"), F.lit(0.0)))
    found = joined.withColumn("z", (F.col(column) - F.col("_fit.mean")) / F.col("_sd")).filter(F.abs("z") > limit)
    return found.select(*[F.col(f"`{c}`") for c in df.columns], "z")


def _run(df: DataFrame, out: str, mode: str) -> None:
    """One run of the query over what its source holds; raises if it dropped late rows."""
    spark = df.sparkSession
    option = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(option)
    spark.conf.set(option, "1000000")  # the count of late rows is taken from all batches
    try:
        query = (
            df.writeStream.format("parquet")
            .outputMode(mode)
            .option("checkpointLocation", f"{out}/progress")
            .trigger(availableNow=True)
            .start(f"{out}/rows")
        )
        query.awaitTermination()
    finally:
        spark.conf.set(option, before)
    late = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    if late:
        raise ValueError(f"{late} rows came later than the watermark allows and were dropped; read more files at once or allow more delay")


def run_available(df: DataFrame, mode: str = "append", again: str | None = None) -> DataFrame:
    """Process what the source holds, write it below the shared folder, and return that table.

    Progress and output live on shared storage, so a lost executor or driver resumes. `again` is
    a folder of an earlier run: the query goes on where that ended, and the table has the rows of
    all runs. A stream gives out a window only after the watermark has passed it; `run_closed` is
    for queries with windows. Raises if the stream dropped late rows.
    """
    out = again or new_folder(df.sparkSession, "stream")
    _run(df, out, mode)
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/rows")


def run_closed(stream: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`run_available` of build(stream), and then a closing batch of the same query.

    The source is the stream together with a folder of end marks. It is empty until the stream's
    input has been processed; then one row arrives there that has only a time, later than every
    window. It moves the watermark past all open windows, which the query gives out itself. The
    mark's own window stays open and never comes out. `build` has to put the watermark on all
    rows (`event_time`) before it filters. Rows of the mark's time or later stay open too.
    """
    spark = stream.sparkSession
    out = new_folder(spark, "stream")
    marks, schema = f"{out}/marks", stream.schema
    row = {f.name: END_OF_TIME if f.name == ts else None for f in schema.fields}
    mark = spark.createDataFrame([row], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]))
    mark.limit(0).write.parquet(marks)
    df = build(stream.unionByName(spark.readStream.schema(schema).parquet(marks)))
    _run(df, out, "append")
    mark.write.mode("append").parquet(marks)
    _run(df, out, "append")
    return spark.read.schema(df.schema).parquet(f"{out}/rows")
