"""Joining cubes along an axis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cube import Cube


def _same_axis(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def extend(cube: Cube, others: Cube | list[Cube], dim: int | str, check: bool = True) -> Cube:
    """Cubes one after the other along an axis. Names must match, and the other axes' labels too (each cube is checked)."""
    d = cube.axis(dim)
    others = [others] if isinstance(others, Cube) else list(others)
    parts, offset = [cube.df], cube.length(d)
    for o in others:
        if o.dims != cube.dims:
            raise ValueError(f"axes differ: {o.dims} and {cube.dims}")
        if check and not all(_same_axis(cube.axis_table(x), o.axis_table(x)) for x in cube.dims if x != d):
            raise ValueError("labels of the other axes differ")
        parts.append(o.df.withColumnRenamed(o.value, cube.value).withColumn(f"{d}_idx", (F.col(f"{d}_idx") + offset).cast("int")).select(*cube.df.columns))
        offset += o.length(d)
    return cube.with_(reduce(DataFrame.unionByName, parts))


METHODS = {"extend": extend}
