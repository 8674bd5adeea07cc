"""A Parquet store of one recording: samples by channel, with gain, sample rate, channels and annotations beside them."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest whole number of a stored type.
INTEGERS = {"short": 2**15 - 1, "int": 2**31 - 1}


def gain_of(signal: DataFrame, dtype: str, buffer: float = 0.1) -> float:
    """Volts a step so that the largest value, and a share of ``buffer`` more, fits the type."""
    top = signal.agg(F.max(F.abs("value"))).first()[0] or 0.0
    return (top * 2 * (1 + buffer)) / (INTEGERS[dtype] * 2) or 1.0


def quantise(value, gain: float, dtype: str):
    """Whole steps, cut towards 0."""
    return (value / F.lit(float(gain))).cast(dtype)


class SignalStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- making

    @classmethod
    def create(cls, signal: DataFrame, path: str, samplerate: float, dtype: str = "double", gain: float | None = None, gain_buffer: float = 0.1, channels: DataFrame | None = None, annotations: DataFrame | None = None) -> SignalStore:
        """From (channel, sample, value). Whole-number types keep value / gain; without a gain it is taken from the largest value."""
        store = cls(signal.sparkSession, path)
        if dtype in INTEGERS and gain is None:
            gain = gain_of(signal, dtype, gain_buffer)
        store._write_meta({"samplerate": float(samplerate), "dtype": dtype, "gain": float(gain or 1.0)})
        store._write(signal, "overwrite")
        if channels is None:
            channels = signal.select("channel").distinct().select(F.col("channel").alias("number"), F.concat(F.lit("Ch"), F.col("channel")).alias("name"))
        store.set_channels(channels)
        if annotations is not None:
            store.set_annotations(annotations)
        return store

    def _write_meta(self, meta: dict) -> None:
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")

    @property
    def meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/meta").first()[0])

    def _write(self, signal: DataFrame, mode: str, partitions: str | None = None) -> None:
        m = self.meta
        value = quantise(F.col("value"), m["gain"], m["dtype"]) if m["dtype"] in INTEGERS else F.col("value").cast(m["dtype"])
        rows = signal.select("channel", "sample", value.alias("value"))
        # channels are folders; long ones are split by runs of samples, each sorted, so readers skip by sample
        rows = rows.repartition("channel", F.floor(F.col("sample") / (1 << 22))).sortWithinPartitions("channel", "sample")
        writer = rows.write.mode(mode).partitionBy("channel")
        if partitions:
            writer = writer.option("partitionOverwriteMode", partitions)
        writer.parquet(f"{self.path}/samples")

    # -- reading

    def signal(self, esrc: str | None = None) -> DataFrame:
        m = self.meta
        rows = self.spark.read.parquet(f"{self.path}/samples")
        value = F.col("value").cast("double") * F.lit(m["gain"]) if m["dtype"] in INTEGERS else F.col("value").cast("double")
        return rows.select(F.lit(esrc or self.path).alias("esrc"), F.col("channel").cast("int").alias("channel"), "sample", value.alias("value"))

    @property
    def samplerate(self) -> float:
        return self.meta["samplerate"]

    def channels(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/channels")

    def annotations(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/annotations")

    # -- changing

    def append(self, signal: DataFrame) -> None:
        """More samples of every channel; their numbers count on from the last one stored."""
        last = self.spark.read.parquet(f"{self.path}/samples").agg(F.max("sample")).first()[0]
        end = 0 if last is None else last + 1
        self._write(signal.withColumn("sample", F.col("sample") + end), "append")

    def append_stream(self, stream: DataFrame, checkpoint: str, **trigger):
        """A stream of (channel, sample, value) appended micro-batch by micro-batch; its sample numbers count on from the last one stored when it began.

        The start is kept beside the store under the checkpoint's name, and samples that are stored already are left
        out, so a query that is started anew, or a micro-batch that is run again, stores nothing twice.
        """
        start = f"{self.path}/streams/{hashlib.md5(checkpoint.encode()).hexdigest()}"
        try:
            end = int(self.spark.read.text(start).first()[0])
        except AnalysisException:
            last = self.spark.read.parquet(f"{self.path}/samples").agg(F.max("sample")).first()[0]
            end = 0 if last is None else last + 1
            self.spark.createDataFrame([(str(end),)], "start string").coalesce(1).write.text(start)

        def write(part: DataFrame, number: int) -> None:
            stored = self.spark.read.parquet(f"{self.path}/samples").select("channel", "sample")
            fresh = part.select("channel", (F.col("sample") + end).alias("sample"), "value")
            self._write(fresh.join(stored.where(F.col("sample") >= end), ["channel", "sample"], "left_anti"), "append")

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def set_channel(self, channel: int, signal: DataFrame) -> None:
        """The channel's samples become those of (sample, value); other channels stay."""
        self._write(signal.select(F.lit(channel).alias("channel"), "sample", "value"), "overwrite", "dynamic")

    def set_channels(self, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/channels")

    def set_annotations(self, table: DataFrame) -> None:
        """(onset, duration, annotation)"""
        table.select("onset", "duration", "annotation").write.mode("overwrite").parquet(f"{self.path}/annotations")


def read_pulses(spark: SparkSession, path: str, label: str = "UP") -> DataFrame:
    """(time) of the rows of a tab-separated pulse log that have this label."""
    rows = spark.read.csv(path, sep="\t", schema="time string, duration string, label string")
    return rows.where(F.trim("label") == label).select(F.trim("time").cast("long").alias("time"))
