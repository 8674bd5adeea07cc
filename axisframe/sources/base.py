"""What all readers of recordings share: one schema, partitions by channel and sample range, and pushed filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SIGNAL = "esrc string, channel int, sample long, value double"
ANNOTATION = "esrc string, onset double, duration string, annotation string"


@dataclass
class Span(InputPartition):
    channels: tuple[int, ...]
    start: int
    stop: int


class SignalReader(DataSourceReader):
    """Subclasses give ``source``, ``channels`` {number: samples} and ``load(channel numbers, start, stop)``."""

    per_partition = 1 << 22
    together = False  # all channels of a stretch lie together in the file

    def __init__(self):
        self.keep: set[int] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on channel and sample choose what is read; Spark applies all of them again."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name == "channel" and isinstance(f, EqualTo | In):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keep = found if self.keep is None else self.keep & found
            elif name == "sample":
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), f.value + 1 if self.high is None else min(self.high, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    top = f.value + isinstance(f, LessThanOrEqual)
                    self.high = top if self.high is None else min(self.high, top)
            yield f

    def partitions(self) -> list[Span]:
        chosen = {c: n for c, n in self.channels.items() if self.keep is None or c in self.keep}
        groups = [tuple(chosen)] if self.together and chosen else [(c,) for c in chosen]
        out = []
        for g in groups:
            end = max(chosen[c] for c in g)
            end = end if self.high is None else min(end, self.high)
            step = max(1, self.per_partition // len(g))
            out += [Span(g, s, min(s + step, end)) for s in range(self.low, end, step)]
        return out or [Span((), 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        step = 1 << 18
        for s in range(span.start, span.stop, step):
            for channel, values in self.load(span.channels, s, min(s + step, span.stop)):
                n = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([self.source] * n, pa.string()), pa.array(np.full(n, channel, np.int32)), pa.array(np.arange(s, s + n)), pa.array(np.asarray(values, float))],
                    ["esrc", "channel", "sample", "value"],
                )


@dataclass
class Stretch(InputPartition):
    start: int
    stop: int


class RowReader(DataSourceReader):
    """Rows of ``read_rows(start, stop)`` of a file of ``end`` places from ``first`` on, ``step`` of them a task."""

    def __init__(self, read_rows, first: int, end: int, step: int):
        self.read_rows, self.first, self.end, self.step = read_rows, first, end, max(1, step)

    def partitions(self) -> list[Stretch]:
        return [Stretch(s, min(s + self.step, self.end)) for s in range(self.first, self.end, self.step)] or [Stretch(0, 0)]

    def read(self, partition):
        yield from self.read_rows(partition.start, partition.stop)


class Recording(DataSource):
    """Base of user sources: give ``reader`` a :class:`SignalReader` and register the class with ``spark.dataSource.register``."""

    def schema(self):
        return SIGNAL


def all_data(signal: DataFrame, samplerate: float, channels: list[int] | None = None) -> DataFrame:
    """Whole signals with ``time`` in seconds."""
    if channels is not None:
        signal = signal.where(F.col("channel").isin(sorted(channels)))
    return signal.withColumn("time", F.col("sample") / F.lit(float(samplerate)))


def from_array(spark, data, esrc: str = "array") -> DataFrame:
    """A (channel, sample) array in the driver's memory as signal rows; channels are numbered from 0."""
    import pandas as pd

    data = np.asarray(data, float)
    c, s = np.indices(data.shape)
    return spark.createDataFrame(pd.DataFrame({"esrc": esrc, "channel": c.ravel().astype("int32"), "sample": s.ravel(), "value": data.ravel()}), SIGNAL)


def default_channels(spark, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("number"), F.concat(F.lit("Ch"), F.col("id")).alias("name"))
