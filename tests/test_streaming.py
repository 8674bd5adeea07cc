"""Streams give what batches give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe.functions.algebra import running_averages
from axisframe.streaming import signal as streams

SCHEMA = "esrc string, channel int, sample long, ts timestamp, value double"


@pytest.fixture
def stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(400).select(F.lit("rec").alias("esrc"), (F.col("id") % 2).cast("int").alias("channel"), F.expr("id div 2").alias("sample"), F.timestamp_seconds(F.expr("id div 2") * 0.5).alias("ts"), F.sin("id").alias("value"))
    for k in range(2):
        rows.where(f"sample >= {100 * k} AND sample < {100 * (k + 1)}").coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), spark.read.parquet(src)


def drain(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_bins(stream, tmp_path):
    live, batch = stream
    got = drain(streams.binned(live, "10 seconds"), "append", tmp_path, "bins").orderBy("start", "channel").toPandas()
    want = batch.groupBy(F.window("ts", "10 seconds").start.alias("start"), "channel").agg(F.avg("value").alias("mean")).orderBy("start", "channel").toPandas()
    want = want[: len(got)]
    assert len(got) > 10
    np.testing.assert_allclose(got["mean"], want["mean"])


def test_moments(stream, tmp_path):
    live, batch = stream
    got = drain(streams.running_moments(live), "complete", tmp_path, "moments").orderBy("channel").toPandas()
    want = batch.groupBy("channel").agg(F.var_samp("value").alias("variance")).orderBy("channel").toPandas()
    np.testing.assert_allclose(got["variance"], want["variance"])


def test_sessions(stream, tmp_path):
    live, _ = stream
    assert drain(streams.sessions(live.where("sample % 100 < 40"), "5 seconds"), "append", tmp_path, "sess").count() >= 2


def test_averages(stream, tmp_path):
    pytest.importorskip("google.protobuf")
    live, batch = stream
    got = drain(streams.averages(live), "append", tmp_path, "avgs").where("channel = 0").orderBy("sample").toPandas()
    x = batch.where("channel = 0").orderBy("sample").toPandas()["value"].to_numpy()
    np.testing.assert_allclose(got["fast"], running_averages(x))


def test_epochs(spark, stream, tmp_path):
    live, _ = stream
    src = str(tmp_path / "ev")
    spark.createDataFrame([(1, "rec", 20.0), (2, "rec", 60.0)], "event int, esrc string, at double").select("event", "esrc", F.timestamp_seconds("at").alias("event_ts")).write.parquet(src)
    events = spark.readStream.schema("event int, esrc string, event_ts timestamp").parquet(src)
    got = drain(streams.epochs(events, live, "2 seconds", "3 seconds"), "append", tmp_path, "eps")
    assert got.groupBy("event", "channel").count().select("count").distinct().collect() == [(11,)]
