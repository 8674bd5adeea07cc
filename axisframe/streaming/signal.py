"""Operators over streams of (channel, sample, value) rows with an event time ``ts``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def binned(stream: DataFrame, width: str, lateness: str = "10 seconds", keys: tuple[str, ...] = ("channel",), slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) bins of the time axis: count, mean and variance; rows later than ``lateness`` are left out."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    got = stream.withWatermark("ts", lateness).groupBy(at.alias("bin"), *keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    return got.select(F.col("bin.start").alias("start"), F.col("bin.end").alias("end"), *keys, "n", "mean", "variance")


def running_moments(stream: DataFrame, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Mean and variance of all so far, for output mode "update" or "complete"."""
    return stream.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def sessions(stream: DataFrame, gap: str, lateness: str = "10 seconds", keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Stretches of a channel without a pause of ``gap``. Rows are merged to sessions before they move, so a channel's task gets sessions, not its rows."""
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    got = stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("s"), *keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return got.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n", "mean")


def averages(stream: DataFrame, fast: float = 0.5, slow: float = 0.975) -> DataFrame:
    """(channel, sample, value, fast, slow): recursive averages of each channel in the order of samples inside a micro-batch; the state goes on from batch to batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("sample")
        f, s = state.get if state.exists else (0.0, float(rows["value"].iloc[:10].mean()))
        fs, ss = [], []
        for v in rows["value"]:
            f = fast * f + (1 - fast) * (v - s)
            s = slow * s + (1 - slow) * v
            fs.append(f)
            ss.append(s)
        state.update((f, s))
        yield pd.DataFrame({"channel": key[0], "sample": rows["sample"].to_numpy(), "value": rows["value"].to_numpy(), "fast": fs, "slow": ss})

    return stream.select("channel", "sample", "value").groupBy("channel").applyInPandasWithState(step, "channel int, sample long, value double, fast double, slow double", "fast double, slow double", "append", GroupStateTimeout.NoTimeout)


def epochs(events: DataFrame, signal: DataFrame, before: str, after: str, lateness: str = "10 seconds") -> DataFrame:
    """Stream-stream interval join: the samples of the event's source from ``before`` before it to ``after`` after it.

    Time is cut into bins as long as the whole interval. An event meets the samples of the two or three bins that its
    interval touches, by equality: a sample isn't held against all events of its source, and a source is dealt over tasks.
    """
    begin, end = F.expr(f"event_ts - interval {before}"), F.expr(f"event_ts + interval {after}")
    width = F.lit(max(1, events.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + interval {before} + interval {after})").first()[0]))
    bin_of = lambda t: F.floor(F.unix_micros(t) / width)
    e = events.withWatermark("event_ts", lateness).withColumn("event_bin", F.explode(F.sequence(bin_of(begin), bin_of(end))))
    s = signal.withWatermark("ts", lateness).withColumn("bin", bin_of(F.col("ts")))
    inside = F.expr(f"esrc = event_esrc AND bin = event_bin AND ts >= event_ts - interval {before} AND ts <= event_ts + interval {after}")
    return e.select("event", F.col("esrc").alias("event_esrc"), "event_ts", "event_bin").join(s, inside).select("event", "esrc", "channel", "ts", "value", (F.col("ts").cast("double") - F.col("event_ts").cast("double")).alias("time"))
