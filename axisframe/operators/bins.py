"""Binning along an axis: equal runs of positions, or label intervals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.cube import Cube, compact
from .reduce import aggregate


def bin_of(position: Column, n: int, k: int) -> Column:
    """Bin of a position when ``n`` are dealt to ``k`` bins in order; the first ``n % k`` bins get one more."""
    q, r = divmod(n, k)
    return F.when(position < r * (q + 1), F.floor(position / (q + 1))).otherwise(r + F.floor((position - r * (q + 1)) / max(q, 1))).cast("int")


def _apply(function: str | Callable[[Column], Column], v: Column) -> Column:
    """A named reduction, or any function from a column to an aggregate (a grouped-aggregate pandas UDF too)."""
    return aggregate(function, v) if isinstance(function, str) else function(v)


def make_bins(cube: Cube, dim: int | str, bins: int | Sequence[Sequence], function: str | Callable[[Column], Column] = "mean", labels: str | list = "function", exact: bool = True) -> Cube:
    """The axis in bins, each reduced by ``function``.

    ``bins``: a number of runs (equal ones if ``exact``, else nearly equal), or intervals ``[low, high]`` or
    ``[low, high, label]`` that take labels with low <= label < high and may overlap or leave gaps. ``labels``:
    ``"function"`` applies the function to the axis' labels, ``"sequential"`` numbers the bins, a list names them.
    """
    d, v = cube.axis(dim), F.col(cube.value).cast("double")
    if isinstance(bins, int):
        n = cube.length(d)
        if bins < 1 or (exact and n % bins):
            raise ValueError(f"{n} positions don't make {bins} equal bins")
        count = bins
        names = None
        binned = compact(cube, d).df.withColumn("__bin", bin_of(F.col(f"{d}_idx"), n, bins))
    else:
        count = len(bins)
        if any(len(b) not in (2, 3) for b in bins) or len({len(b) for b in bins}) > 1:
            raise ValueError("each interval needs two limits, and all of them a label or none")
        names = [b[2] for b in bins] if count and len(bins[0]) == 3 else None
        # few intervals: each cell finds its own without a join
        inside = F.array(*(F.when((F.col(d) >= b[0]) & (F.col(d) < b[1]), F.lit(i)) for i, b in enumerate(bins)))
        binned = cube.df.withColumn("__bin", F.explode(F.array_compact(inside)))
    if isinstance(labels, list):
        if len(labels) != count:
            raise ValueError(f"{len(labels)} labels for {count} bins")
        names = labels
    elif labels not in ("function", "sequential"):
        raise ValueError("labels are 'function', 'sequential' or a list")
    keys = cube.keys(d)
    if names is not None:
        label = F.element_at(F.array(*(F.lit(x) for x in names)), F.col("__bin") + 1)
    elif labels == "sequential":
        label = F.col("__bin")
    else:
        label = None
    if label is None:  # over the axis' own labels, each once
        table = binned.select("__bin", f"{d}_idx", d).distinct().groupBy("__bin").agg(_apply(function, F.col(d).cast("double")).alias(d))
        out = binned.groupBy(*keys, "__bin").agg(_apply(function, v).alias(cube.value)).join(table, "__bin")
    else:
        out = binned.groupBy(*keys, "__bin").agg(_apply(function, v).alias(cube.value)).withColumn(d, label)
    return cube.with_(out.select(*(c for x in cube.dims for c in ((F.col("__bin").alias(f"{d}_idx"), F.col(d)) if x == d else (F.col(f"{x}_idx"), F.col(x)))), cube.value))


METHODS = {"make_bins": make_bins}
