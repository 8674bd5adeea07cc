"""Operators on axes: order, shape, repetition, new axes."""

from __future__ import annotations

from collections.abc import Iterable
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cube import Cube, check_names, compact, take


def transpose(cube: Cube, *dims: int | str) -> Cube:
    """Axes in the given order; reversed without one. Rows don't move."""
    names = tuple(cube.axis(d) for d in dims) or cube.dims[::-1]
    if sorted(names) != sorted(cube.dims):
        raise ValueError(f"{names} is no permutation of {cube.dims}")
    return cube.with_(cube.df, names)


def swapaxes(cube: Cube, a: int | str, b: int | str) -> Cube:
    a, b = cube.axis(a), cube.axis(b)
    return cube.with_(cube.df, tuple({a: b, b: a}.get(d, d) for d in cube.dims))


def squeeze(cube: Cube) -> Cube:
    """Axes of length 1 go."""
    return cube.drop_axes(*(d for d, n in zip(cube.dims, cube.shape, strict=True) if n == 1))


def ordinal(cube: Cube) -> Column:
    """Row-major number of a cell."""
    shape, at = cube.shape, F.lit(0).cast("long")
    for d, n in zip(cube.dims, shape, strict=True):
        at = at * n + F.col(f"{d}_idx")
    return at


def ravel(cube: Cube, name: str = "cell") -> Cube:
    """One axis of row-major numbers."""
    at = ordinal(cube)
    return cube.with_(cube.df.select(at.cast("int").alias(f"{name}_idx"), at.alias(name), cube.value), (name,))


def reshape(cube: Cube, shape: Iterable[int]) -> Cube:
    """Row-major cells under a new shape (one length may be -1); axes become dim1.. with labels 0.."""
    old, shape = prod(cube.shape), list(shape)
    if shape.count(-1) == 1:
        rest = prod(n for n in shape if n != -1)
        shape[shape.index(-1)] = old // rest if rest else 0
    if prod(shape) != old or min(shape, default=1) < 0:
        raise ValueError(f"{old} cells don't fit the shape {shape}")
    at, cols = ordinal(cube), []
    for i in range(len(shape)):
        place = (F.floor(at / prod(shape[i + 1 :])) % shape[i]).cast("int")
        cols += [place.alias(f"dim{i + 1}_idx"), place.alias(f"dim{i + 1}")]
    return cube.with_(cube.df.select(*cols, cube.value), tuple(f"dim{i + 1}" for i in range(len(shape))))


def resize(cube: Cube, *_):
    raise NotImplementedError("a labelled cube can't be resized")


def repeat(cube: Cube, repeats: int | list[int], dim: int | str | None = None) -> Cube:
    """Each position of an axis (of all cells, flattened, if none is named) so many times; the new axis is numbered."""
    cube = ravel(cube) if dim is None else cube
    d = cube.axis(0 if dim is None else dim)
    if isinstance(repeats, int):
        n = F.lit(repeats)
        first = F.col(f"{d}_idx") * repeats
    else:
        if len(repeats) != cube.length(d):
            raise ValueError("a number of repeats for each position is needed")
        ends = [0]
        for r in repeats:
            ends.append(ends[-1] + r)
        pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col(f"{d}_idx") + 1)
        n, first = pick(repeats), pick(ends[:-1])
    copies = cube.df.where(n > 0).withColumn("__first", first.cast("int")).withColumn("__k", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    at = F.col("__first") + F.col("__k")
    df = copies.withColumn(f"{d}_idx", at).withColumn(d, at)
    return cube.with_(df.select(*cube.df.columns))


def diagonal(cube: Cube, a: int | str = 0, b: int | str = 1) -> Cube:
    """Cells whose positions on two axes agree; the two become the last axis, ``diagonal``."""
    a, b = cube.axis(a), cube.axis(b)
    rest = tuple(d for d in cube.dims if d not in (a, b))
    df = cube.df.where(F.col(f"{a}_idx") == F.col(f"{b}_idx"))
    return cube.with_(df.select(*(c for d in rest for c in (f"{d}_idx", d)), F.col(f"{a}_idx").alias("diagonal_idx"), F.col(f"{a}_idx").alias("diagonal"), cube.value), (*rest, "diagonal"))


def add_dim(cube: Cube, name: str, labels: Iterable | DataFrame) -> Cube:
    """A new first axis along which all cells are repeated. Labels given as a list are few; a DataFrame (``<name>_idx``, ``<name>``) may be long."""
    check_names([name, *cube.dims])
    if not isinstance(labels, DataFrame):
        labels = cube.df.sparkSession.createDataFrame(list(enumerate(labels)), [f"{name}_idx", name]).withColumn(f"{name}_idx", F.col(f"{name}_idx").cast("int"))
    return cube.with_(labels.select(f"{name}_idx", name).crossJoin(cube.df), (name, *cube.dims))


def compress(cube: Cube, mask: Iterable[bool], dim: int | str) -> Cube:
    """Positions of an axis where the mask (as long as the axis or shorter) is true."""
    return take(cube, [i for i, x in enumerate(mask) if x], dim)


def nonzero(cube: Cube) -> DataFrame:
    """Positions of the cells that are not 0 (NaN is not 0)."""
    return cube.df.where(F.col(cube.value) != 0).select(*(f"{d}_idx" for d in cube.dims))


def to_series(cube: Cube, dim: int | str) -> DataFrame:
    """One row for each combination of the other axes: ``labels`` and ``values`` of the axis, in its order."""
    d = cube.axis(dim)
    cells = F.array_sort(F.collect_list(F.struct(F.col(f"{d}_idx").alias("i"), F.col(d).alias("label"), F.col(cube.value).cast("double").alias("v"))))
    return cube.df.groupBy(*cube.keys(d)).agg(cells.alias("__cells")).select(*cube.keys(d), F.col("__cells.label").alias("labels"), F.col("__cells.v").alias("values"))


def from_series(series: DataFrame, cube: Cube, dim: str, value: str = "values", labels: str = "labels") -> Cube:
    """The inverse of :func:`to_series`: a cube like ``cube`` whose axis ``dim`` comes last."""
    rest = tuple(d for d in cube.dims if d != dim)
    keys = [c for d in rest for c in (f"{d}_idx", d)]
    df = series.select(*keys, F.posexplode(F.arrays_zip(F.col(labels).alias("label"), F.col(value).alias("v"))).alias(f"{dim}_idx", "__x"))
    return cube.with_(df.select(*keys, f"{dim}_idx", F.col("__x.label").alias(dim), F.col("__x.v").alias(cube.value)), (*rest, dim))


def flat(cube: Cube, condition: Column) -> Cube:
    """The cells where a condition over any axes holds, in row-major order along one axis ``cell``, labelled with their row-major numbers."""
    from .statistics import sorted_ranks

    chosen = cube.df.where(condition).select(ordinal(cube).alias("cell"), cube.value)
    ranked = sorted_ranks(chosen, F.col("cell"))
    return cube.with_(ranked.select((F.col("__rank") - 1).cast("int").alias("cell_idx"), "cell", cube.value), ("cell",))


def repeat_to_match(cube: Cube, other: Cube) -> Cube:
    """The cube's cells repeated along the axes that ``other`` has besides, in the order of the other's axes."""
    if missing := set(cube.dims) - set(other.dims):
        raise ValueError(f"the other cube has no axes {sorted(missing)}")
    df = cube.df
    for d in other.dims:
        if d not in cube.dims:
            df = df.crossJoin(other.axis_table(d))
    return cube.with_(df.select(*(c for d in other.dims for c in (f"{d}_idx", d)), cube.value), other.dims)


METHODS = {
    "flat": flat, "repeat_to_match": repeat_to_match, "transpose": transpose, "swapaxes": swapaxes, "squeeze": squeeze, "ravel": ravel, "flatten": ravel, "reshape": reshape, "resize": resize, "repeat": repeat,
    "diagonal": diagonal, "add_dim": add_dim, "compress": compress, "nonzero": nonzero, "take": take, "compact": compact, "to_series": to_series,
}
