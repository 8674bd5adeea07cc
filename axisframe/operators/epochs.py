"""Events and the stretches of signal around them."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.timecube import TimeCube


def add_fields(events: DataFrame, **fields: Column | object) -> DataFrame:
    """New columns; a Spark type gives an empty one of that type. A name that is there already is an error."""
    from pyspark.sql.types import DataType

    if there := set(fields) & set(events.columns):
        raise ValueError(f"the events have {sorted(there)} already")
    return events.withColumns({k: v if isinstance(v, Column) else F.lit(None).cast(v) if isinstance(v, DataType) else F.lit(v) for k, v in fields.items()})


def remove_fields(events: DataFrame, *names: str) -> DataFrame:
    """Without these columns; unknown names are ignored."""
    return events.drop(*names)


def window(start: float, end: float, samplerate: float, buffer: float = 0.0) -> tuple[int, int, int]:
    """(first sample relative to the event, number of samples, buffer samples); the buffer is in the first two."""
    if end < start:
        raise ValueError("the end lies before the start")
    if buffer < 0:
        raise ValueError("a buffer can't be negative")
    step = 1 / samplerate
    pad = math.ceil(buffer / step)
    first = math.ceil((abs(start) - step / 2) / step) * (0 if start == 0 else math.copysign(1, start))
    n = math.ceil((end - step / 2) / step) - first + 1
    return int(first) - pad, int(n) + 2 * pad, pad


def choose_channels(channels: DataFrame, chosen) -> list[int] | None:
    """Sorted channel numbers from numbers, names, or a dict of fields and values; ``channels`` is (number, name, ...). None: all."""
    if chosen is None:
        return None
    if isinstance(chosen, dict):
        test = F.lit(True)
        for k, v in chosen.items():
            test = test & F.col(k).isin(list(v) if isinstance(v, list | tuple | set) else [v])
        return sorted(r[0] for r in channels.where(test).select("number").collect())
    chosen = [chosen] if isinstance(chosen, str | int) else list(chosen)
    names = [c for c in chosen if isinstance(c, str)]
    found = {r[1]: r[0] for r in channels.where(F.col("name").isin(names)).select("number", "name").collect()} if names else {}
    if missing := set(names) - set(found):
        raise ValueError(f"no channels {sorted(missing)}")
    return sorted({found[c] if isinstance(c, str) else int(c) for c in chosen})


def check_windows(events: DataFrame, signal: DataFrame, first: int, n: int) -> None:
    """Every window must lie inside its source's samples. One pass over the bounds of the sources, not over the cells."""
    bounds = signal.groupBy("esrc").agg(F.min("sample").alias("lo"), F.max("sample").alias("hi"))
    bad = events.join(bounds, "esrc", "left").where(F.col("lo").isNull() | (F.col("sample0") + first < F.col("lo")) | (F.col("sample0") + (first + n - 1) > F.col("hi")))
    row = bad.select("esrc", "sample0").first()
    if row:
        raise OSError(f"source {row[0]!r} has no whole window around sample {row[1]}")


def epochs(
    events: DataFrame, signal: DataFrame, samplerate: float, start: float, end: float, buffer: float = 0.0, channels: Iterable[int] | None = None,
    resample: float | None = None, band=None, kind: str = "stop", order: int = 4, keep_buffer: bool = False, in_seconds: bool = True, check: bool = True,
) -> TimeCube:
    """Cube (channel, event, time) of the signal around each event.

    ``events``: (event, esrc, eoffset); offsets are seconds, or samples if not ``in_seconds``. ``signal``: (esrc, channel,
    sample, value). A window is turned into its samples first, so the join is an equality on (esrc, sample), never a
    range. Filtering and resampling see the buffer, which is cut off in the end unless it is kept.
    """
    for c in ("esrc", "eoffset", "event"):
        if c not in events.columns:
            raise ValueError(f"the events need a field {c!r}")
    first, n, pad = window(start, end, samplerate, buffer)
    sample0 = F.rint(F.col("eoffset") * samplerate).cast("long") if in_seconds else F.col("eoffset").cast("long")
    placed = events.select("event", "esrc", sample0.alias("sample0"))
    if check:
        check_windows(placed, signal, first, n)
    wanted = placed.select("event", "esrc", F.posexplode(F.sequence(F.col("sample0") + first, F.col("sample0") + (first + n - 1))).alias("time_idx", "sample"))
    if channels is not None:
        signal = signal.where(F.col("channel").isin([int(c) for c in channels]))
    step = 1 / samplerate
    cells = signal.join(wanted, ["esrc", "sample"]).select(
        F.col("channel").cast("int").alias("channel_idx"), "channel", F.col("event").cast("int").alias("event_idx"), "event", "time_idx", (F.lit(first * step) + F.col("time_idx") * F.lit(step)).alias("time"), F.col("value").cast("double").alias("value")
    )
    out = TimeCube(cells, ("channel", "event", "time"), tdim="time", samplerate=samplerate)
    if band is not None:
        out = out.filtered(band, kind, order)
    if resample is not None and resample != samplerate:
        out = out.resampled(resample)
    return out if keep_buffer or not pad else out.remove_buffer(buffer)
