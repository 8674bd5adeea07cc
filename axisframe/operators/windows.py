"""Running and ranking operators along an axis.

Each series is one window partition. Where a single series is longer than a task should hold, ``cumsum`` works in
chunks: sums of chunks first, then each chunk on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.cube import Cube


def _over(cube: Cube, d: str):
    return Window.partitionBy(*cube.keys(d)).orderBy(f"{d}_idx").rowsBetween(Window.unboundedPreceding, 0)


def cumsum(cube: Cube, dim: int | str = 0, chunk: int | None = None) -> Cube:
    d, v = cube.axis(dim), F.col(cube.value)
    if chunk is None:
        return cube.with_(cube.df.withColumn(cube.value, F.sum(v).over(_over(cube, d))))
    # positions of a series in runs of ``chunk``: no task holds more than a run, or a sum for each run
    rest = cube.keys(d)
    part = cube.df.withColumn("__chunk", F.floor(F.col(f"{d}_idx") / chunk))
    before = part.groupBy(*rest, "__chunk").agg(F.sum(v).alias("__sum"))
    w = Window.partitionBy(*rest).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("__before", F.coalesce(F.sum("__sum").over(w), F.lit(0))).drop("__sum")
    inner = Window.partitionBy(*rest, "__chunk").orderBy(f"{d}_idx").rowsBetween(Window.unboundedPreceding, 0)
    df = part.withColumn(cube.value, F.sum(v).over(inner)).join(before, [*rest, "__chunk"]).withColumn(cube.value, F.col(cube.value) + F.col("__before"))
    return cube.with_(df.select(*cube.df.columns))


def cumprod(cube: Cube, dim: int | str = 0) -> Cube:
    d = cube.axis(dim)
    return cube.with_(cube.df.withColumn(cube.value, F.product(cube.value).over(_over(cube, d))))


def _ordered(cube: Cube, d: str, by, *ties):
    return Window.partitionBy(*cube.keys(d)).orderBy(by, *ties)


def argsort(cube: Cube, dim: int | str = -1) -> Cube:
    """At each rank the position of that value; labels keep their places. Ties by position."""
    d = cube.axis(dim)
    ranked = cube.df.withColumn("__rank", (F.row_number().over(_ordered(cube, d, F.col(cube.value), F.col(f"{d}_idx"))) - 1).cast("int"))
    table = cube.axis_table(d).select(F.col(f"{d}_idx").alias("__rank"), F.col(d).alias("__label"))
    df = ranked.withColumn(cube.value, F.col(f"{d}_idx")).join(table, "__rank").withColumn(f"{d}_idx", F.col("__rank")).withColumn(d, F.col("__label"))
    return cube.with_(df.select(*cube.df.columns))


def sort_axis(cube: Cube, dim: int | str = -1) -> Cube:
    """Values sorted within each series, and the axis' labels sorted on their own: labels no longer belong to values."""
    d = cube.axis(dim)
    ranked = cube.df.withColumn("__rank", (F.row_number().over(_ordered(cube, d, F.col(cube.value))) - 1).cast("int"))
    table = cube.axis_table(d).select((F.row_number().over(Window.orderBy(d)) - 1).cast("int").alias("__rank"), F.col(d).alias("__label"))
    df = ranked.join(table, "__rank").withColumn(f"{d}_idx", F.col("__rank")).withColumn(d, F.col("__label"))
    return cube.with_(df.select(*cube.df.columns))


def sort_with_labels(cube: Cube, dim: int | str = -1) -> Cube:
    """Values sorted within each series; each keeps its label."""
    d = cube.axis(dim)
    return cube.with_(cube.df.withColumn(f"{d}_idx", (F.row_number().over(_ordered(cube, d, F.col(cube.value), F.col(f"{d}_idx"))) - 1).cast("int")))


def rankdata(cube: Cube, dim: int | str = -1, scaled: bool = False) -> Cube:
    """Ranks from 1 within each series, ties at their average; ``scaled`` maps them to 0..1."""
    d = cube.axis(dim)
    peers = Window.partitionBy(*cube.keys(d), cube.value)
    rank = F.rank().over(_ordered(cube, d, F.col(cube.value))) + (F.count("*").over(peers) - 1) / 2
    if scaled:
        rank = (rank - 1) / (F.count("*").over(Window.partitionBy(*cube.keys(d))) - 1)
    return cube.with_(cube.df.withColumn(cube.value, rank.cast("double")))


def zero_crossings(cube: Cube, dim: int | str = -1) -> Cube:
    """1 where the sign differs from that of the cell before, else 0; the first cell is 0."""
    d = cube.axis(dim)
    w = _ordered(cube, d, F.col(f"{d}_idx"))
    s = F.signum(cube.value)
    return cube.with_(cube.df.withColumn(cube.value, F.coalesce((s != F.lag(s).over(w)).cast("int"), F.lit(0))))


def local_maxima(cube: Cube, dim: int | str = -1) -> Cube:
    """Cells that are maxima: above both sides, a flat top counted at its middle (the lower one of two)."""
    d, v = cube.axis(dim), F.col(cube.value)
    rest = cube.keys(d)
    w = _ordered(cube, d, F.col(f"{d}_idx"))
    # runs of equal values
    runs = cube.df.withColumn("__new", F.coalesce((v != F.lag(v).over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tops = runs.groupBy(*rest, "__run").agg(F.min(f"{d}_idx").alias("__lo"), F.max(f"{d}_idx").alias("__hi"), F.first(v).alias("__v"))
    o = Window.partitionBy(*rest).orderBy("__run")
    tops = tops.withColumns({"__before": F.lag("__v").over(o), "__after": F.lead("__v").over(o)})
    tops = tops.where("__v > __before AND __v > __after").select(*rest, F.floor((F.col("__lo") + F.col("__hi")) / 2).cast("int").alias(f"{d}_idx"))
    return cube.with_(cube.df.join(tops, [*rest, f"{d}_idx"], "left_semi").select(*cube.df.columns))


def dilate(cube: Cube, radius: int, dim: int | str = -1):
    """(other axes, position) within ``radius`` before to ``radius`` - 1 after a cell that is not 0, once each, inside the axis."""
    d = cube.axis(dim)
    rest = cube.keys(d)
    n = cube.length(d)
    at = F.explode(F.sequence(F.col(f"{d}_idx") - radius, F.col(f"{d}_idx") + radius - 1)).alias(f"{d}_idx")
    return cube.df.where(F.col(cube.value) != 0).select(*rest, at).where((F.col(f"{d}_idx") >= 0) & (F.col(f"{d}_idx") < n)).distinct()


def unwrap(cube: Cube, dim: int | str = -1) -> Cube:
    """Angles along an axis without jumps of more than pi: each such jump is made up for by whole turns from there on."""
    d = cube.axis(dim)
    step = F.col(cube.value) - F.lag(cube.value).over(_ordered(cube, d, F.col(f"{d}_idx")))
    turn = F.lit(2 * math.pi)
    short = F.pmod(step + math.pi, turn) - math.pi
    short = F.when((short == -math.pi) & (step > 0), F.lit(math.pi)).otherwise(short)
    made_up = F.when(F.abs(step) < math.pi, F.lit(0.0)).otherwise(F.coalesce(short - step, F.lit(0.0)))
    df = cube.df.withColumn("__made_up", made_up)
    return cube.with_(df.withColumn(cube.value, F.col(cube.value) + F.sum("__made_up").over(_over(cube, d))).drop("__made_up"))


def zscored(cube: Cube, dim: int | str = -1, base: Column | None = None, ddof: int = 1) -> Cube:
    """Values less their series' mean, by its standard deviation, both taken over the cells where ``base`` holds (all without it).

    Moments are partial aggregates, joined back to the cells; no window holds a series.
    """
    d = cube.axis(dim)
    rest, v = cube.keys(d), F.col(cube.value)
    inside = v if base is None else F.when(base, v)
    moments = cube.df.groupBy(*rest).agg(F.avg(inside).alias("__mean"), (F.stddev_samp(inside) if ddof == 1 else F.stddev_pop(inside)).alias("__sd"))
    df = cube.df.join(moments, rest) if rest else cube.df.crossJoin(F.broadcast(moments))  # one row
    return cube.with_(df.withColumn(cube.value, (v - F.col("__mean")) / F.col("__sd")).select(*cube.df.columns))


METHODS = {
    "unwrap": unwrap, "zscored": zscored, "cumsum": cumsum, "cumprod": cumprod, "argsort": argsort, "sort_axis": sort_axis, "sort_with_labels": sort_with_labels, "rankdata": rankdata,
    "zero_crossings": zero_crossings, "local_maxima": local_maxima, "dilate": dilate,
}
