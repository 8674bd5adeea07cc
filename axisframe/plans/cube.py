"""Labelled cubes as DataFrames.

A cube is one row a cell: for every axis ``<axis>_idx`` (position, int) and ``<axis>`` (label), and a value column.
Everything here only builds plans; axis lengths are counted when an operator can't do without.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import from_driver
from .predicate import Predicate

_NAME = re.compile(r"[a-zA-Z_]\w*\Z")
NAN = float("nan")


def check_names(names: Iterable[str]) -> tuple[str, ...]:
    names = tuple(names)
    for n in names:
        if not isinstance(n, str) or not _NAME.match(n):
            raise ValueError(f"{n!r} is not a name for an axis")
    if len(set(names)) != len(names):
        raise ValueError(f"axis names repeat: {names}")
    return names


class Axis:
    """``cube[name]``: comparisons give column conditions on the axis' labels, to be joined by ``& | ^``."""

    def __init__(self, cube: Cube, name: str):
        self.cube, self.name, self.label, self.position = cube, name, F.col(name), F.col(f"{name}_idx")

    def __lt__(self, x):
        return self.label < x

    def __le__(self, x):
        return self.label <= x

    def __gt__(self, x):
        return self.label > x

    def __ge__(self, x):
        return self.label >= x

    def __eq__(self, x):
        return self.label == x

    def __ne__(self, x):
        return self.label != x

    __hash__ = None

    def is_in(self, values) -> Column:
        return self.label.isin(list(values))

    def index(self, positions) -> Column:
        """Condition on positions instead of labels."""
        return self.position.isin([positions] if isinstance(positions, int) else list(positions))

    def labels(self) -> DataFrame:
        return self.cube.axis_table(self.name)


@dataclass(frozen=True, eq=False)
class Cube:
    df: DataFrame
    dims: tuple[str, ...]
    value: str = "value"
    attrs: dict[str, Any] = field(default_factory=dict)
    #: attributes of single axes, such as units
    axis_attrs: dict[str, dict[str, Any]] = field(default_factory=dict)
    _lengths: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        check_names(self.dims)
        missing = {c for d in self.dims for c in (d, f"{d}_idx")} | {self.value}
        if missing := missing - set(self.df.columns):
            raise ValueError(f"the cube's columns {sorted(missing)} are missing")

    # -- making

    @staticmethod
    def from_positions(df: DataFrame, dims: Iterable[str], value: str = "value", **kw) -> Cube:
        """From columns of 0-based positions named like the axes; the positions are the labels."""
        dims = check_names(dims)
        return Cube(df.select(*(c for d in dims for c in (F.col(d).cast("int").alias(f"{d}_idx"), F.col(d))), value), dims, value, **kw)

    @staticmethod
    def from_labels(df: DataFrame, dims: Iterable[str], value: str = "value", **kw) -> Cube:
        """From label columns: positions follow the labels' order. Only each axis' distinct labels are sorted."""
        dims = check_names(dims)
        out = df.select(*dims, value)
        for d in dims:
            table = out.select(d).distinct().withColumn(f"{d}_idx", (F.row_number().over(Window.orderBy(d)) - 1).cast("int"))
            out = out.join(table, d)
        return Cube(out.select(*(c for d in dims for c in (f"{d}_idx", d)), value), dims, value, **kw)

    @staticmethod
    def from_array(spark: SparkSession, array, dims: dict[str, Iterable] | None = None, **kw) -> Cube:
        """From a NumPy array in the driver's memory; without ``dims`` axes are dim1.. with labels 0.."""
        import numpy as np
        import pandas as pd

        array = np.asarray(array)
        dims = dims if dims is not None else {f"dim{i + 1}": range(n) for i, n in enumerate(array.shape)}
        labels = {d: list(v) for d, v in dims.items()}
        if tuple(map(len, labels.values())) != array.shape:
            raise ValueError(f"axes of lengths {[len(v) for v in labels.values()]} don't fit the shape {array.shape}")
        at = np.indices(array.shape).reshape(array.ndim, -1)
        cols = {}
        for i, (d, v) in enumerate(labels.items()):
            cols[f"{d}_idx"], cols[d] = at[i].astype("int32"), pd.Series(v).to_numpy()[at[i]]
        cols["value"] = array.ravel()
        df = spark.createDataFrame(pd.DataFrame(cols))
        return Cube(df.withColumns({f"{d}_idx": F.col(f"{d}_idx").cast("int") for d in labels}), check_names(labels), **kw)

    def with_(self, df: DataFrame, dims: tuple[str, ...] | None = None, value: str | None = None) -> Cube:
        """The same cube over other rows: attributes stay."""
        dims = self.dims if dims is None else dims
        return replace(self, df=df, dims=dims, value=value or self.value, axis_attrs={k: v for k, v in self.axis_attrs.items() if k in dims}, _lengths={})

    # -- description

    def axis(self, which: int | str) -> str:
        """Name of an axis given by name or (also negative) number."""
        if isinstance(which, str):
            if which not in self.dims:
                raise ValueError(f"no axis {which!r} among {self.dims}")
            return which
        if not -len(self.dims) <= which < len(self.dims):
            raise ValueError(f"no axis {which} among {len(self.dims)}")
        return self.dims[which]

    def keys(self, *without: str) -> list[str]:
        return [c for d in self.dims if d not in without for c in (f"{d}_idx", d)]

    def axis_table(self, dim: int | str) -> DataFrame:
        """(position, label) of an axis, once each."""
        d = self.axis(dim)
        return self.df.select(f"{d}_idx", d).distinct()

    def length(self, dim: int | str) -> int:
        d = self.axis(dim)
        if d not in self._lengths:
            self._lengths[d] = self.df.agg(F.countDistinct(f"{d}_idx")).first()[0]
        return self._lengths[d]

    @property
    def shape(self) -> tuple[int, ...]:
        missing = [d for d in self.dims if d not in self._lengths]
        if missing:
            row = self.df.agg(*(F.countDistinct(f"{d}_idx") for d in missing)).first()
            self._lengths.update(zip(missing, row, strict=True))
        return tuple(self._lengths[d] for d in self.dims)

    def metadata(self) -> str:
        """All that is not in rows, as JSON."""
        return json.dumps({"dims": self.dims, "value": self.value, "attrs": self.attrs, "axis_attrs": self.axis_attrs}, sort_keys=True, default=str)

    @staticmethod
    def from_metadata(df: DataFrame, text: str) -> Cube:
        m = json.loads(text)
        return Cube(df, tuple(m["dims"]), m["value"], m["attrs"], m["axis_attrs"])

    def to_array(self):
        """The dense array, in the driver's memory: for small cubes and tests. Missing cells are NaN."""
        import numpy as np

        pdf = self.df.select(*(f"{d}_idx" for d in self.dims), self.value).toPandas()
        at = [np.unique(pdf[f"{d}_idx"], return_inverse=True) for d in self.dims]
        if not self.dims:
            return pdf[self.value].to_numpy()
        out = np.full([len(u) for u, _ in at], np.nan, object if pdf[self.value].dtype == object else float)
        out[tuple(i for _, i in at)] = pdf[self.value]
        return out

    def labels(self, dim: int | str) -> list:
        d = self.axis(dim)
        return [r[1] for r in self.axis_table(d).orderBy(f"{d}_idx").collect()]

    # -- selection

    def predicate(self, text: str, **params) -> Predicate:
        return Predicate(text, {d: F.col(d) for d in self.dims}, params)

    def _condition(self, conditions, params: dict) -> Column:
        axes = {k: v for k, v in params.items() if k in self.dims}
        rest = {k: v for k, v in params.items() if k not in self.dims}
        out = F.lit(True)
        for c in conditions:
            out = out & (self.predicate(c, **rest).column if isinstance(c, str) else c)
        for d, chosen in axes.items():  # a mask or positions
            chosen = list(chosen) if not isinstance(chosen, Column) else chosen
            if isinstance(chosen, list):
                if chosen and all(isinstance(x, bool) for x in chosen):
                    chosen = [i for i, x in enumerate(chosen) if x]
                chosen = F.col(f"{d}_idx").isin([int(x) for x in chosen])
            out = out & chosen
        return out

    def where(self, *conditions: str | Column, **params) -> Cube:
        """Cells where all conditions hold; every axis stays. Keywords named like an axis are masks or positions, others parameters."""
        return self.with_(self.df.where(self._condition(conditions, params)))

    select = where

    def find(self, *conditions: str | Column, **params) -> DataFrame:
        """Positions of the cells where all conditions hold."""
        return self.df.where(self._condition(conditions, params)).select(*(f"{d}_idx" for d in self.dims))

    def __getitem__(self, key):
        """``cube['time']``: the axis. ``cube['time > 0', "ch == 'Cz'"]``: cells; an axis that ``==`` leaves one label of is dropped.
        Integers, slices, lists, masks, ``None`` and ``...`` go by position, axis after axis."""
        if isinstance(key, str) and key in self.dims:
            return Axis(self, key)
        keys = key if isinstance(key, tuple) else (key,)
        if any(isinstance(k, str | Column) for k in keys):
            out, drop = self, []
            for k in keys:
                if isinstance(k, str):
                    p = self.predicate(k)
                    if p.equality and self.axis_table(p.names[0]).where(p.column).limit(2).count() == 1:
                        drop.append(p.names[0])
                    k = p.column
                out = out.with_(out.df.where(k))
            return out.drop_axes(*drop)
        return self._at(keys)

    def drop_axes(self, *dims: str) -> Cube:
        return self.with_(self.df.drop(*(c for d in dims for c in (d, f"{d}_idx"))), tuple(d for d in self.dims if d not in dims)) if dims else self

    def _at(self, keys: tuple) -> Cube:
        if keys.count(...) > 1 if not any(isinstance(k, list) for k in keys) else False:
            raise ValueError("one ... at most")
        real = [k for k in keys if k is not None and k is not ...]
        if len(real) > len(self.dims):
            raise ValueError(f"too many indices for {len(self.dims)} axes")
        if ... not in [k for k in keys if not isinstance(k, list)]:
            keys = (*keys, ...)
        out, at, dims, fresh, drop = self, 0, [], 0, []
        for k in keys:
            if k is ...:
                skip = len(self.dims) - len(real)
                dims += self.dims[at : at + skip]
                at += skip
                continue
            if k is None:
                d = f"newaxis_{fresh}"
                fresh += 1
                out = out.with_(out.df.withColumns({d: F.lit(0), f"{d}_idx": F.lit(0)}))
                dims.append(d)
                continue
            d = self.dims[at]
            at += 1
            dims.append(d)
            if isinstance(k, int):
                n = self.length(d) if k < 0 else 0
                out = out.with_(out.df.where(F.col(f"{d}_idx") == (k + n)))
                drop.append(d)
            elif isinstance(k, slice):
                n = self.length(d) if k.step not in (None, 1) or (k.start or 0) < 0 or (k.stop or 0) < 0 else None
                if n is None:
                    test = F.col(f"{d}_idx") >= (k.start or 0)
                    test = test if k.stop is None else test & (F.col(f"{d}_idx") < k.stop)
                    out = out.with_(out.df.where(test).withColumn(f"{d}_idx", F.col(f"{d}_idx") - (k.start or 0)))
                else:
                    start, stop, step = k.indices(n)
                    at_ = F.col(f"{d}_idx")
                    away = (at_ - start) if step > 0 else (F.lit(start) - at_)
                    test = (at_ >= start) & (at_ < stop) if step > 0 else (at_ <= start) & (at_ > stop)
                    out = out.with_(out.df.where(test & (away % abs(step) == 0)).withColumn(f"{d}_idx", F.floor(away / abs(step)).cast("int")))
            else:
                k = [i for i, x in enumerate(k) if x] if len(k) and all(isinstance(x, bool) for x in k) else [int(i) for i in k]
                n = self.length(d) if any(i < 0 for i in k) else 0
                out = take(out, [i + n if i < 0 else i for i in k], d)
        out = out.with_(out.df, tuple(dims))
        return out.drop_axes(*drop)

    # -- values

    def map(self, f: Callable[[Column], Column]) -> Cube:
        """Any column expression of the value: arithmetic with scalars, ufuncs."""
        return self.with_(self.df.withColumn(self.value, f(F.col(self.value))))

    def update(self, condition: str | Column, new: Column | float, **params) -> Cube:
        """The value becomes ``new`` where the condition holds."""
        test = self._condition([condition], params)
        return self.with_(self.df.withColumn(self.value, F.when(test, new if isinstance(new, Column) else F.lit(new)).otherwise(F.col(self.value))))

    def relabel(self, dim: int | str, labels: DataFrame) -> Cube:
        """The axis gets the labels of (``<dim>_idx``, ``<dim>``)."""
        d = self.axis(dim)
        order = [c for c in self.df.columns]
        return self.with_(self.df.drop(d).join(labels.select(f"{d}_idx", d), f"{d}_idx").select(*order))

    def combine(self, other: Cube, f: Callable[[Column, Column], Column]) -> Cube:
        """Cell by cell with another cube of the same axes, matched by position, never by label; one with fewer axes is repeated along the others."""
        if len(self.dims) != len(other.dims):
            few, many = sorted((self, other), key=lambda c: len(c.dims))
            if not set(few.dims) < set(many.dims):
                raise ValueError("both cubes need the same number of axes, or one only axes of the other")
            if few is self:
                return other.combine(self, lambda a, b: f(b, a))
            shared = [f"{d}_idx" for d in other.dims]
            joined = self.df.join(other.df.select(*shared, F.col(other.value).alias("__other")), shared)
            return self.with_(joined.withColumn(self.value, f(F.col(self.value), F.col("__other"))).select(*self.df.columns))
        right = other.df.select(*(F.col(f"{o}_idx").alias(f"{d}_idx") for d, o in zip(self.dims, other.dims, strict=True)), F.col(other.value).alias("__other"))
        joined = self.df.join(right, [f"{d}_idx" for d in self.dims])
        return self.with_(joined.withColumn(self.value, f(F.col(self.value), F.col("__other"))).select(*self.df.columns))

    def _arith(self, x, f):
        return self.combine(x, f) if isinstance(x, Cube) else self.map(lambda v: f(v, F.lit(x)))

    def __add__(self, x):
        return self._arith(x, lambda a, b: a + b)

    def __sub__(self, x):
        return self._arith(x, lambda a, b: a - b)

    def __mul__(self, x):
        return self._arith(x, lambda a, b: a * b)

    def __truediv__(self, x):
        return self._arith(x, lambda a, b: a / b)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, x):
        return self.map(lambda v: F.lit(x) - v)

    def __rtruediv__(self, x):
        return self.map(lambda v: F.lit(x) / v)

    def __neg__(self):
        return self.map(lambda v: -v)

    # -- operators that live in their own modules

    def __getattr__(self, name: str):
        from ..operators import METHODS

        if name in METHODS:
            f = METHODS[name]
            return lambda *a, **k: f(self, *a, **k)
        raise AttributeError(name)


def compact(cube: Cube, dim: int | str) -> Cube:
    """Positions of an axis become 0, 1, 2, ... again after a selection. The rank is over the axis, not over the cells."""
    d = cube.axis(dim)
    table = cube.df.select(F.col(f"{d}_idx").alias("__old")).distinct().withColumn("__new", (F.row_number().over(Window.orderBy("__old")) - 1).cast("int"))
    df = cube.df.join(table, F.col(f"{d}_idx") == F.col("__old"))
    return cube.with_(df.withColumn(f"{d}_idx", F.col("__new")).select(*cube.df.columns))


def take(cube: Cube, positions: Iterable[int], dim: int | str) -> Cube:
    """Those positions of an axis, in that order; repeats give repeated cells."""
    d = cube.axis(dim)
    chosen = list(positions)
    spark = cube.df.sparkSession
    table = from_driver(spark, [(i, int(p)) for i, p in enumerate(chosen)], "__new int, __old int")
    df = cube.df.join(table, F.col(f"{d}_idx") == F.col("__old"))
    return cube.with_(df.withColumn(f"{d}_idx", F.col("__new")).select(*cube.df.columns))
