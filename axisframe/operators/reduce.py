"""Reductions over an axis, or over the whole cube.

NaN behaves as in NumPy: plain reductions give NaN where a cell is NaN, the nan* ones leave NaN out. All are partial
aggregates: each task reduces its own cells before the shuffle by the axes that stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.cube import NAN, Cube


def real(v: Column) -> Column:
    """The value where it is not NaN, else null, so that aggregates leave it out."""
    return F.when(~F.isnan(v), v)


def spread(v: Column, ddof: int) -> Column:
    """Variance with ``ddof`` taken from the number of values; NaN where none are left over."""
    n = F.count(v)
    if ddof == 0:
        return F.coalesce(F.var_pop(v), F.lit(NAN))
    return F.when(n > ddof, F.var_pop(v) * n / (n - ddof)).otherwise(F.lit(NAN))


def _guard(v: Column, agg: Column) -> Column:
    return F.when(F.max(F.isnan(v)), F.lit(NAN)).otherwise(agg)


def _first(v: Column, at: Column, sign: int) -> Column:
    """Position of the first NaN, else of the first extreme."""
    return F.min_by(at, F.struct(F.when(F.isnan(v), 0).otherwise(1), F.when(F.isnan(v), F.lit(0.0)).otherwise(v * sign), at))


def aggregate(name: str, v: Column, ddof: int = 0) -> Column:
    """The aggregate expression of a reduction by name, over a column of doubles."""
    table: dict[str, Callable[[], Column]] = {
        "sum": lambda: F.sum(v), "mean": lambda: F.avg(v), "min": lambda: _guard(v, F.min(v)), "max": lambda: F.max(v),
        "ptp": lambda: _guard(v, F.max(v) - F.min(v)), "prod": lambda: F.product(v), "var": lambda: spread(v, ddof), "std": lambda: F.sqrt(spread(v, ddof)),
        "all": lambda: F.bool_and(v != 0), "any": lambda: F.bool_or(v != 0), "nanmean": lambda: F.coalesce(F.avg(real(v)), F.lit(NAN)),
        "nanvar": lambda: spread(real(v), ddof), "nanstd": lambda: F.sqrt(spread(real(v), ddof)), "count": lambda: F.count(v), "median": lambda: F.median(v),
    }
    if name not in table:
        raise ValueError(f"no reduction {name!r} among {sorted(table)}")
    return table[name]()


def reduce(cube: Cube, name: str, dim: int | str | None = None, ddof: int = 0) -> Cube:
    """A named reduction; the axis goes, attributes stay. ``None`` reduces all to a cube without axes."""
    v = F.col(cube.value).cast("double")
    if dim is None:
        return cube.with_(cube.df.agg(aggregate(name, v, ddof).alias(cube.value)), ())
    d = cube.axis(dim)
    keys = cube.keys(d)
    return cube.with_(cube.df.groupBy(*keys).agg(aggregate(name, v, ddof).alias(cube.value)), tuple(x for x in cube.dims if x != d))


def extreme(cube: Cube, dim: int | str | None, sign: int) -> Cube:
    v = F.col(cube.value).cast("double")
    if dim is None:  # position in row-major order
        from .reshape import ordinal

        df = cube.df.withColumn("__at", ordinal(cube))
        return cube.with_(df.agg(_first(v, F.col("__at"), sign).alias(cube.value)), ())
    d = cube.axis(dim)
    return cube.with_(cube.df.groupBy(*cube.keys(d)).agg(_first(v, F.col(f"{d}_idx"), sign).alias(cube.value)), tuple(x for x in cube.dims if x != d))


def argmin(cube: Cube, dim=None) -> Cube:
    return extreme(cube, dim, 1)


def argmax(cube: Cube, dim=None) -> Cube:
    return extreme(cube, dim, -1)


def trace(cube: Cube, a: int | str = 0, b: int | str = 1) -> Cube:
    from .reshape import diagonal

    return reduce(diagonal(cube, a, b), "sum", "diagonal")


def _named(name: str, spreads: bool):
    if spreads:
        return lambda cube, dim=None, ddof=0: reduce(cube, name, dim, ddof)
    return lambda cube, dim=None: reduce(cube, name, dim)


METHODS = {n: _named(n, n in ("var", "std", "nanvar", "nanstd")) for n in ("sum", "mean", "min", "max", "ptp", "prod", "var", "std", "all", "any", "nanmean", "nanvar", "nanstd", "median")}
METHODS |= {"argmin": argmin, "argmax": argmax, "trace": trace, "reduce": reduce}
